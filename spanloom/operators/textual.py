"""Lines, occurrences, tokens and sentences of documents, all with character offsets.

Each document text is one row, and so are its pieces until they are exploded: arrays of pieces and of their offsets are
made inside the row, so neither texts nor pieces are shuffled; only a table that is small as a whole is first dealt out to
all cores.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.offsets import exclusive_sums, placed_words, sentence_bounds
from spanloom.functions.text import BRACKET_ESCAPES, match_pattern, split_token
from spanloom.operators.ranges import points_in_intervals
from spanloom.session import spread

# Fixed value: end of a sentence after a first non-blank character: terminal marks before space, a newline, text end.
SENTENCE = "(?s)\\S.*?(?::?(?::?[.!?。！？]+(?=\\s+))|:?(?=\\n+)|:?(?=\\s*\\z))"
NEWLINE_SENTENCE = "(?s)\\S.*?(?::?(?=\\n+)|:?(?=\\s*\\z))"

# Corrections of the sentence split, on text with one sentence per line. Each keeps the length.
SPLIT_FIRST = [
    (r"\b([a-z]+\?) ([A-Z][a-z]+)\b", "$1\n$2"),
    (r"\b([a-z]+ \.) ([A-Z][a-z]+)\b", "$1\n$2"),
    (r"\n([.!?]+)\n", " $1\n"),
]
SPLIT_IN_BRACKETS = [
    (r"(\([^\[\]\(\)]*)\n([^\[\]\(\)]*\))", "$1 $2"),
    (r"(\[[^\[\]\(\)]*)\n([^\[\]\(\)]*\])", "$1 $2"),
    (r"(\([^\(\)]{0,250})\n([^\(\)]{0,250}\))", "$1 $2"),
    (r"(\[[^\[\]]{0,250})\n([^\[\]]{0,250}\])", "$1 $2"),
    (r"(\((?:[^\(\)]|\([^\(\)]*\)){0,250})\n((?:[^\(\)]|\([^\(\)]*\)){0,250}\))", "$1 $2"),
    (r"(\[(?:[^\[\]]|\[[^\[\]]*\]){0,250})\n((?:[^\[\]]|\[[^\[\]]*\]){0,250}\])", "$1 $2"),
]
SPLIT_LAST = [
    (r"\.\n([a-z]{3}[a-z-]{0,}[ \.\:\,\;])", ". $1"),
    (r"\b([A-Z]\.)\n([a-z]{3,})\b", "$1 $2"),
    (r"\b((?:[A-Z]\.|[A-Z][a-z]{3,}) [A-Z]\.)\n([A-Z][a-z]{3,})\b", "$1 $2"),
    (r"\n((?:and|or|but|nor|yet) )", " $1"),
    (
        r"\n((?:of|in|by|as|on|at|to|via|for|with|that|than|from|into|upon|after|while|during|within|through|between"
        r"|whereas|whether) )",
        " $1",
    ),
    (r"\b(e\.)\n(g\.)", "$1 $2"),
    (r"\b(i\.)\n(e\.)", "$1 $2"),
    (r"\b(i\.)\n(v\.)", "$1 $2"),
    (r"\b(e\. ?g\.|i\. ?e\.|i\. ?v\.|vs\.|cf\.|Dr\.|Mr\.|Ms\.|Mrs\.)\n", "$1 "),
    (r"\b([Aa]pprox\.|[Nn]o\.|[Ff]igs?\.)\n(\d+)", "$1 $2"),
    (r"(\.\s*)\n(\s*,)", "$1 $2"),
]

# Separations made by the treebank-like tokenizer, in order of application.
TOKEN_FIRST = [
    (r"\.\.\.", " ... "),
    (r"([,;:@#]) ", " $1 "),
    (r" ([,;:@#])", " $1 "),
    (r"\$", " \\$ "),
    (r"%", " % "),
    (r"&", " & "),
    (r"([,:;])([\[\])}>\"']* +)", " $1$2"),
    (r"(\.+)([\[\])}>\"']* +)\z", " $1$2"),
    (r"\?", " ? "),
    (r"!", " ! "),
    (r"((?:=/)?<+(?:/=|--+>?)?)", " $1 "),
    (r"((?:<?--+|=/)?>+(?:/=)?)", " $1 "),
    (r"(<?--+>?)", " $1 "),
    (r"\(([^ A-Z()\[\]{}]+)\)-", "-LRB-$1-RRB--"),
]
TOKEN_BRACKETS = [
    (r"(?<![ (\[{])\(([^ ()\[\]{}]*)\)", "-LRB-$1-RRB-"),
    (r"\(([^ ()\[\]{}]*)\)(?![ )\]}/-])", "-LRB-$1-RRB-"),
    (r"(?<![ (\[{])\[([^ ()\[\]{}]*)\]", "-LSB-$1-RSB-"),
    (r"\[([^ ()\[\]{}]*)\](?![ )\]}/-])", "-LSB-$1-RSB-"),
    (r"(?<![ (\[{])\{([^ ()\[\]{}]*)\}", "-LCB-$1-RCB-"),
    (r"\{([^ ()\[\]{}]*)\}(?![ )\]}/-])", "-LCB-$1-RCB-"),
]
TOKEN_LAST = [
    (r"\(", " -LRB- "),
    (r"\)", " -RRB- "),
    (r"\[", " -LSB- "),
    (r"\]", " -RSB- "),
    (r"\{", " -LCB- "),
    (r"\}", " -RCB- "),
    (r" ('+)", " $1 "),
    (r"(?<![35'])('+) ", " $1 "),
    (r"'s ", " 's "),
    (r"'S ", " 'S "),
    (r"'m ", " 'm "),
    (r"'M ", " 'M "),
    (r"'d ", " 'd "),
    (r"'D ", " 'D "),
    (r"'ll ", " 'll "),
    (r"'re ", " 're "),
    (r"'ve ", " 've "),
    (r"n't ", " n't "),
    (r"'LL ", " 'LL "),
    (r"'RE ", " 'RE "),
    (r"'VE ", " 'VE "),
    (r"N'T ", " N'T "),
    (r" Cannot ", " Can not "),
    (r" cannot ", " can not "),
    (r" D'ye ", " D' ye "),
    (r" d'ye ", " d' ye "),
    (r" Gimme ", " Gim me "),
    (r" gimme ", " gim me "),
    (r" Gonna ", " Gon na "),
    (r" gonna ", " gon na "),
    (r" Gotta ", " Got ta "),
    (r" gotta ", " got ta "),
    (r" Lemme ", " Lem me "),
    (r" lemme ", " lem me "),
    (r" More'n ", " More 'n "),
    (r" more'n ", " more 'n "),
    (r"'Tis ", " 'T is "),
    (r"'tis ", " 't is "),
    (r"'Twas ", " 'T was "),
    (r"'twas ", " 't was "),
    (r" Wanna ", " Wan na "),
    (r" wanna ", " wan na "),
    (r"  +", " "),
]


def apply_rules(col, rules):
    for pattern, replacement in rules:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def until_stable(col, rules, rounds):
    """Apply ``rules`` until the text stops changing, at most ``rounds`` times (a column that bounds the changes)."""
    start = F.struct(F.lit(None).cast("string").alias("prev"), col.alias("cur"))

    def step(state, _):
        changed = F.struct(state["cur"].alias("prev"), apply_rules(state["cur"], rules).alias("cur"))
        return F.when(state["prev"].isNull() | (state["prev"] != state["cur"]), changed).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), rounds), start, step)["cur"]


def numbered_pieces(df: DataFrame, keep, array, number, piece) -> DataFrame:
    """One row per element of an array that is costly to make.

    The outer form keeps the planner from also testing the array for emptiness beforehand, which would make it twice.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(number, piece)).filter(F.col(number).isNotNull())


TEXT_BLOCK = 1024


def text_blocks(text):
    """A text as blocks of equally many characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))


def text_at(blocks, start, size):
    """The ``size`` characters at ``start`` of a text in blocks: the work grows with the piece, not with the text."""
    first = F.floor(start / TEXT_BLOCK).cast("int")
    last = F.floor((start + F.greatest(size, F.lit(1)) - 1) / TEXT_BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    found = F.substr(near, (start - first * TEXT_BLOCK + 1).cast("int"), size.cast("int"))
    return F.when(start >= 0, found)


# W01
def running_offsets(df: DataFrame, doc, order, text, sep=1) -> DataFrame:
    """Adds start and end of each piece of a document, pieces being ``sep`` characters apart."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    length = F.length(text)
    start = F.coalesce(F.sum(length + sep).over(before), F.lit(0))
    return df.withColumn("start", start.cast("long")).withColumn("end", (F.col("start") + length).cast("long"))


def _exploded(df, keep, arrays, number):
    """One row per element of arrays of equal length, which become columns of their own names."""
    rows = numbered_pieces(df, keep, F.arrays_zip(*arrays), number, "_piece")
    return rows.select(*keep, number, *[F.col(f"_piece.{a}").alias(a) for a in arrays])


def split_with_offsets(docs: DataFrame, separator: str, number, piece, start) -> DataFrame:
    """The pieces of each text between a separator of one character, with their starts."""
    cut = spread(docs.select("doc_id", "text")).select("doc_id", F.split("text", separator).alias(piece))
    placed = cut.withColumn(start, exclusive_sums(F.transform(piece, lambda x: F.length(x) + 1)))
    return _exploded(placed, ["doc_id"], [piece, start], number)


# S03
def lines_with_offsets(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, start, end) of the lines of each document."""
    rows = split_with_offsets(docs, "\n", "line_no", "line", "start")
    return rows.withColumn("end", F.col("start") + F.length("line"))


def with_occurrences(docs, pattern, start="start", hit="text", source="text"):
    """Adds arrays of the starts and texts of the matches of a pattern, where the texts are dealt out to all cores."""
    return with_matches(spread(docs), pattern, start, hit, source)


def with_matches(docs, pattern, start="start", hit="text", source="text"):
    """Adds arrays of the starts and texts of the matches of a pattern.

    What lies between matches comes from a split on the same pattern; running lengths of both give the starts.
    """
    cut = docs.withColumns(
        {
            "_gaps": F.transform(F.split(source, pattern, -1), F.length),
            "_hits": F.regexp_extract_all(source, F.lit(pattern), F.lit(0)),
        }
    )
    gaps = F.slice("_gaps", F.lit(1), F.size("_hits"))  # without what follows the last match
    passed = exclusive_sums(F.zip_with(gaps, F.transform("_hits", F.length), lambda g, h: g + h))
    placed = cut.withColumn("_passed", passed)
    starts = F.zip_with("_passed", gaps, lambda p, g: p + g)
    return placed.withColumn(start, starts).withColumn(hit, F.col("_hits")).drop("_gaps", "_hits", "_passed")


# C12
def occurrences(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, occ_no, start, end, text) of the non-overlapping matches of a pattern that matches at least one character."""
    found = with_occurrences(docs.select("doc_id", F.col("text").alias("_text")), pattern, source="_text")
    rows = _exploded(found, ["doc_id"], ["start", "text"], "occ_no")
    return rows.select(
        "doc_id", "occ_no", "start", (F.col("start") + F.length("text")).cast("long").alias("end"), "text"
    )


def text_occurrences(docs: DataFrame, text: str, mode="word", match_case=False) -> DataFrame:
    """Occurrences of a search text; an invalid regular expression has none."""
    pattern = match_pattern(text, mode, match_case)
    if pattern is None:
        return occurrences(docs.limit(0), "a")
    return occurrences(docs, pattern)


# C15
def whitespace_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, token_no, start, end, text) of the runs of non-blank characters."""
    return occurrences(docs, "\\S+").withColumnRenamed("occ_no", "token_no")


# What a text must hold for a rule with this pattern to apply; it is found much faster than the pattern.
TOKEN_SIGNS = {
    TOKEN_FIRST[10][0]: "<",
    TOKEN_FIRST[11][0]: ">",
    TOKEN_FIRST[12][0]: "--",
    TOKEN_LAST[6][0]: " '",
    TOKEN_LAST[7][0]: "' ",
    TOKEN_LAST[-1][0]: "  ",
}


def _token_rule(pattern, replacement):
    """A rule of the tokenizer as a function of a text; without signs of a pattern it is a plain replacement."""
    new = replacement.replace("\\$", "$")
    if re.fullmatch(r"(?:[^\\.^$*+?{}\[\]|()]|\\[^a-zA-Z0-9])+", pattern):
        old = re.sub(r"\\(.)", r"\1", pattern)
        return lambda text: text.replace(old, new)
    sign = next((b for b, e in BRACKET_ESCAPES.items() if e in replacement), TOKEN_SIGNS.get(pattern, ""))
    find, back = re.compile(pattern.replace("\\z", "\\Z")), re.sub(r"\$(\d)", r"\\\1", new)
    return lambda text: find.sub(back, text) if sign in text else text


def _token_rules(rules):
    made = [_token_rule(*rule) for rule in rules]

    def apply(text):
        for rule in made:
            text = rule(text)
        return text

    return apply


_token_first, _token_brackets, _token_last = map(_token_rules, (TOKEN_FIRST, TOKEN_BRACKETS, TOKEN_LAST))
_quote_after = re.compile('([ (\\[{<])"')


def _spaced(text):
    text = " " + re.sub(r" *(\n*)\Z", "", text) + " "
    text = _token_first(_quote_after.sub('\\1 " ', text) if '"' in text else text)
    while (changed := _token_brackets(text)) != text:
        text = changed
    text = _token_last(text).replace('"', ' " ')
    for bracket, name in BRACKET_ESCAPES.items():
        text = text.replace(name, bracket)
    return text


@F.arrow_udf(T.StringType())
def spaced_text(texts: pa.Array) -> pa.Array:
    """Texts with blanks added between treebank-like tokens. Most rules are plain, which Python applies fastest."""
    return pa.array([None if x is None else _spaced(x) for x in texts.to_pylist()], pa.string())


def treebank_text(docs: DataFrame) -> DataFrame:
    """Documents with column ``spaced``: the text with blanks added between treebank-like tokens, nothing else changed."""
    return docs.withColumn("spaced", spaced_text("text"))


def treebank_tokens(docs: DataFrame, same=None) -> DataFrame:
    """(doc_id, token_no, start, end, text) of treebank-like tokens.

    A token never spans a blank, so its place among the non-blank characters of the document gives its offset. A column
    named ``same`` tells whether the text has the token at its place, compared there and in the row.
    """
    cut = treebank_text(spread(docs.select("doc_id", "text"))).withColumn("_words", placed_words("text", "spaced"))
    known = cut.withColumns({"start": F.col("_words.start"), "_same": F.col("_words.same")})
    placed = known.withColumn("token", F.slice("_words.token", F.lit(1), F.size("start")))
    arrays = ["token", "start"]
    if same:
        placed = placed.withColumnRenamed("_same", same)
        arrays.append(same)
    rows = _exploded(placed, ["doc_id"], arrays, "token_no")
    return rows.select(
        "doc_id", "token_no", "start", (F.col("start") + F.length("token")).alias("end"), F.col("token").alias("text"),
        *arrays[2:],
    )


def tokens(docs: DataFrame, mode="whitespace", same=None) -> DataFrame:
    if mode == "whitespace" and same is None:
        return whitespace_tokens(docs)
    if mode == "treebank":
        return treebank_tokens(docs, same)
    raise ValueError(f"unknown tokenization {mode!r}")


# C16
def search_tokens(token_table: DataFrame) -> DataFrame:
    """Tokens with leading and trailing non-word characters split off, offsets kept."""
    parts = token_table.select(
        "doc_id",
        "token_no",
        F.col("start").alias("token_start"),
        split_token(F.col("text")).alias("parts"),
    )
    rows = numbered_pieces(parts, ["doc_id", "token_no", "token_start", "parts"], F.col("parts"), "part_no", "text")
    passed = F.aggregate(
        F.slice("parts", F.lit(1), F.col("part_no")), F.lit(0), lambda acc, p: acc + F.length(p)
    )
    start = F.col("token_start") + passed
    return rows.select(
        "doc_id",
        "token_no",
        "part_no",
        start.cast("long").alias("start"),
        (start + F.length("text")).cast("long").alias("end"),
        "text",
    )


# C17
def newline_sentences(docs: DataFrame) -> DataFrame:
    return occurrences(docs, NEWLINE_SENTENCE).withColumnRenamed("occ_no", "sentence_no")


def regex_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, start, end): sentence ends by pattern, corrected, with the text's own newlines kept.

    The corrections run on the sentences written one per line and never change its length, so a position there maps
    back to the text by the sentence it falls in. A newline of the text ends a sentence; one that no sentence touches is
    an empty sentence of its own.
    """
    found = with_occurrences(docs.select("doc_id", "text"), SENTENCE, "_starts", "_sentences")
    solo = F.transform("_sentences", lambda s: F.replace(s, F.lit("\n"), F.lit(" ")))
    joined = found.withColumn("joined", F.array_join(solo, "\n"))
    breaks = F.length("joined") - F.length(F.replace("joined", F.lit("\n"), F.lit("")))
    sized = joined.withColumns({"breaks": breaks, "refined": apply_rules(F.col("joined"), SPLIT_FIRST)})
    for rule in SPLIT_IN_BRACKETS:
        sized = sized.withColumn("refined", until_stable(F.col("refined"), [rule], F.col("breaks") + 1))
    lines = F.split(apply_rules(F.col("refined"), SPLIT_LAST), "\n")
    bounds = sentence_bounds(
        "_starts",
        F.transform("_sentences", F.length),
        F.transform(lines, F.length),
        F.transform(F.split("text", "\n"), F.length),
        F.length("text"),
        ~F.rlike("text", F.lit("\\S")),
    )
    at = F.transform(F.sequence(F.lit(1), F.size("bounds"), F.lit(2)), lambda i: F.struct(
        F.get("bounds", i - 1).alias("start"), F.get("bounds", i).alias("end")))
    pairs = F.when(F.size("bounds") > 0, at)
    rows = numbered_pieces(sized.select("doc_id", bounds.alias("bounds")), ["doc_id"], pairs, "sentence_no", "s")
    return rows.select("doc_id", "sentence_no", "s.start", "s.end")


def sentences(docs: DataFrame, mode="regex") -> DataFrame:
    if mode == "regex":
        return regex_sentences(docs)
    if mode == "newline":
        return newline_sentences(docs).drop("text")
    raise ValueError(f"unknown sentence split {mode!r}")


def sentence_at(points: DataFrame, sentence_table: DataFrame, point="start") -> DataFrame:
    """Adds the 1-based number of the sentence each offset falls in; the gap before a sentence belongs to it."""
    before = Window.partitionBy("doc_id").orderBy("sentence_no")
    reach = sentence_table.select(
        "doc_id",
        (F.col("sentence_no") + 1).alias("sentence"),
        F.coalesce(F.lag("end").over(before), F.lit(0)).alias("reach_start"),
        F.greatest(F.col("end"), F.lag("end").over(before)).alias("reach_end"),
    )
    return points_in_intervals(points, reach, ["doc_id"], point, "reach_start", "reach_end")


# C18
def sentence_newlines(docs: DataFrame, sentence_table: DataFrame) -> DataFrame:
    """Documents with the blank after each sentence written as a newline; the length does not change."""
    following = Window.partitionBy("doc_id").orderBy("sentence_no")
    breaks = (
        sentence_table.withColumn("next_start", F.lead("start").over(following))
        .filter(F.col("end") < F.col("next_start"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list("end")).alias("breaks"))
    )
    joined = docs.join(breaks, "doc_id", "left").withColumn(
        "breaks", F.coalesce("breaks", F.array().cast("array<bigint>"))
    )
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.col("breaks"))
    ends = F.concat(F.col("breaks"), F.array(F.length("text").cast("bigint")))
    pieces = F.zip_with(
        starts, ends, lambda s, e: F.substr(F.col("text"), (s + 1).cast("int"), (e - s).cast("int"))
    )
    marked = F.transform(
        pieces,
        lambda p, i: F.when(
            (i > 0) & F.rlike(F.substring(p, 1, 1), F.lit("^\\s")), F.concat(F.lit("\n"), F.substr(p, F.lit(2)))
        ).otherwise(p),
    )
    return joined.withColumn("text", F.when(F.col("text").isNotNull(), F.array_join(marked, ""))).select(*docs.columns)
