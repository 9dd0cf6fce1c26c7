"""Column functions over text: cleaning, norm forms, n-grams, spans. All are built-in expressions."""

import html
import re

import pyarrow as pa
from pyspark.errors import SparkRuntimeException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters folded by the post cleaner; ñ becomes two letters and is handled apart.
POST_ACCENTS = ("úùüóòíìéèáà", "uuuooiieeaa")

# Accented Latin letters and their plain form, for type names.
TYPE_ACCENTS = (
    "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ",
    "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy",
)

# Characters that cannot stand in a type name, and their replacement.
TYPE_NAME_MAP = {
    "<": "_lt_",
    ">": "_gt_",
    "+": "_plus_",
    "?": "_question_",
    "&": "_amp_",
    ":": "_colon_",
    ".": "_period_",
    "!": "_exclamation_",
}
POS_NAME_MAP = {
    "'": "__SINGLEQUOTE__",
    '"': "__DOUBLEQUOTE__",
    "$": "__DOLLAR__",
    ",": "__COMMA__",
    ".": "__DOT__",
    ":": "__COLON__",
    "`": "__BACKTICK__",
}

# Treebank bracket escapes.
BRACKET_ESCAPES = {"(": "-LRB-", ")": "-RRB-", "[": "-LSB-", "]": "-RSB-", "{": "-LCB-", "}": "-RCB-"}
XML_ESCAPES = {**BRACKET_ESCAPES, "/": "\\/", "*": "\\*"}

# The HTML entities that occur in article text.


def replace_all(col: Column, mapping: dict, invert=False) -> Column:
    """Literal replacements one after the other, in the order of ``mapping``."""
    for old, new in mapping.items():
        col = F.replace(col, F.lit(new if invert else old), F.lit(old if invert else new))
    return col


def quoted(text: str) -> str:
    """A pattern that matches ``text`` literally."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


# C01
def clean_post(col: Column) -> Column:
    """Lower-case, fold accents, blank out punctuation, then drop links to the end of their line."""
    folded = F.replace(F.translate(F.lower(col), *POST_ACCENTS), F.lit("ñ"), F.lit("gn"))
    return F.regexp_replace(F.regexp_replace(folded, "[.\\-:,?]", " "), "http.+", " ")


# C02
def to_ascii(col: Column) -> Column:
    """Without newlines and without non-ASCII characters."""
    return F.regexp_replace(F.replace(col, F.lit("\n"), F.lit("")), "[^\\x00-\\x7F]", "")


# C04
def drop_tags(col: Column) -> Column:
    return F.regexp_replace(col, "(?s)<[^>]*>", "")


@F.arrow_udf(T.StringType())
def unescaped(texts: pa.Array) -> pa.Array:
    """Named and numeric character references resolved; a no-break space becomes a blank."""
    found = [x if x is None or "&" not in x else html.unescape(x).replace("\xa0", " ") for x in texts.to_pylist()]
    return pa.array(found, pa.string())


def strip_tags(col: Column) -> Column:
    """Text of an HTML fragment: tags dropped, character references resolved."""
    return unescaped(drop_tags(col))


# C05
def drop_blank_lines(col: Column) -> Column:
    return F.array_join(F.filter(F.split(col, "\n"), lambda line: F.trim(line) != ""), "\n")


# C06
def language_model_text(*cols: Column) -> Column:
    """Per field: lines stripped, blank lines dropped, joined with '. '; fields joined with a newline."""

    def one(col):
        lines = F.transform(F.split(F.coalesce(col, F.lit("")), "\n"), lambda line: F.trim(line))
        return F.array_join(F.filter(lines, lambda line: line != ""), ". ")

    return F.concat_ws("\n", *[one(c) for c in cols])


# C07
def ellipsis(col: Column, n: int) -> Column:
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


# C08
def norm_form(col: Column) -> Column:
    """Form under which dictionary names are searched."""
    return F.replace(F.trim(F.lower(col)), F.lit("-"), F.lit(" "))


# C09
def storage_form(col: Column) -> Column:
    """Type name as stored on disk: spaces become '_', accents fold, other non-ASCII goes, the rest becomes '_'."""
    folded = F.translate(F.replace(col, F.lit(" "), F.lit("_")), *TYPE_ACCENTS)
    return F.regexp_replace(F.regexp_replace(folded, "[^\\x00-\\x7F]", ""), "[^a-zA-Z0-9_-]", "_")


# C10
def map_type(col: Column) -> Column:
    return replace_all(col, TYPE_NAME_MAP)


def escape_pos(col: Column) -> Column:
    return replace_all(col, POS_NAME_MAP)


# C13
def ngrams(col: Column, n=3) -> Column:
    """Array of the n-grams of a string, in order; strings shorter than n are padded with \\x01."""
    padded = F.rpad(col, n, "\x01")
    src = F.when(F.length(col) < n, padded).otherwise(col)
    return F.transform(F.sequence(F.lit(1), F.length(src) - (n - 1)), lambda i: F.substr(src, i, F.lit(n)))


def ngram_set(col: Column, n=3) -> Column:
    """Set form of :func:`ngrams`: the k-th repeat of a gram is written as the gram followed by k.

    Sorting puts equal grams side by side, so a gram's repeat number is its distance from its first position.
    """
    grams = F.array_sort(ngrams(col, n))
    return F.transform(
        grams,
        lambda g, i: F.when(F.array_position(grams, g) == i + 1, g).otherwise(
            F.concat(g, (i + 2 - F.array_position(grams, g)).cast("string"))
        ),
    )


# C14
def ptb_escape(col: Column, xml=False) -> Column:
    return replace_all(col, XML_ESCAPES if xml else BRACKET_ESCAPES)


def ptb_unescape(col: Column, xml=False) -> Column:
    return replace_all(col, XML_ESCAPES if xml else BRACKET_ESCAPES, invert=True)


def ptb_unescape_conll(col: Column) -> Column:
    """Brackets, then double back-ticks and double apostrophes as a quote, then the escaped slash."""
    out = replace_all(col, BRACKET_ESCAPES, invert=True)
    return replace_all(out, {"``": '"', "''": '"', "\\/": "/"})


# C16
def split_token(col: Column) -> Column:
    """Leading and trailing non-word characters of a token split off, as an array."""
    lead = F.regexp_extract(col, "(?U)^(\\W+)(?=.)", 1)
    rest = F.substr(col, F.length(lead) + 1)
    trail = F.regexp_extract(rest, "(?U)^.+?(\\W+)$", 1)
    core = F.substr(rest, F.lit(1), F.length(rest) - F.length(trail))
    return F.filter(F.array(lead, core, trail), lambda p: p != "")


# C19
def case_initial(col: Column) -> Column:
    """Lower the first letter of a capitalized word; needs two lower-case letters after it, so abbreviations stay."""
    return F.when(
        F.regexp_like(col, F.lit("^[A-Z][a-z]{2,}")),
        F.concat(F.lower(F.substring(col, 1, 1)), F.substr(col, F.lit(2))),
    ).otherwise(col)


def case_words(col: Column) -> Column:
    return F.array_join(F.transform(F.split(col, " "), case_initial), " ")


# C20
def id_space(col: Column) -> Column:
    """Ontology prefix of a term id; an all-lower-case prefix is put in upper case."""
    head = F.substring_index(col, ":", 1)
    return F.when(
        F.contains(col, F.lit(":")),
        F.when(F.regexp_like(head, F.lit("^[a-z]*$")), F.upper(head)).otherwise(head),
    ).otherwise(F.regexp_extract(col, "^(.[A-Za-z_]+)", 1))


# C23
def natural_key(col: Column) -> Column:
    """Sort key under which runs of digits compare as numbers: each is led by its length without leading zeros."""
    def keyed(run):
        number = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(F.rlike(run, F.lit("^[0-9]")), F.concat(F.format_string("%010d", F.length(number)), number)).otherwise(run)

    return F.array_join(F.transform(F.regexp_extract_all(F.lower(col), F.lit("[0-9]+|[^0-9]+"), F.lit(0)), keyed), "")


# C24
def split_role(col: Column) -> Column:
    """struct(role, num): the trailing digits apart; a role keeps at least its first character."""
    return F.struct(
        F.regexp_extract(col, "(?s)^(.+?)[0-9]*$", 1).alias("role"),
        F.regexp_extract(col, "(?s)^.+?([0-9]*)$", 1).alias("num"),
    )


def role_base(col: Column) -> Column:
    """Role without any trailing digits."""
    return F.regexp_replace(col, "[0-9]+$", "")


# C25
def parse_experiment(col: Column) -> Column:
    """struct(branch, experiment) of 'branch/experiment' or 'branch-experiment'; null when neither has two parts."""

    def two(sep):
        parts = F.split(col, sep)
        pair = F.struct(F.get(parts, F.lit(0)).alias("branch"), F.get(parts, F.lit(1)).alias("experiment"))
        return F.when(F.size(parts) == 2, pair)

    return F.coalesce(two("/"), two("-"))


# C26
def span_text(text: Column, spans: Column, sep=" ") -> Column:
    """Covered text of a list of spans (0-based, end excluded), joined with ``sep``."""
    return F.array_join(
        F.transform(spans, lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"])), sep
    )


# C27
def squeeze(col: Column) -> Column:
    return F.regexp_replace(col, " +", " ")


# F19
def text_match(col: Column, text: str, mode="word", match_case=False, match_empty="***") -> Column:
    """Does ``col`` contain ``text`` as a word, as a substring, or as a regular expression?

    Empty text and the stand-in for it match everything. A pattern that is not a regular expression matches nothing.
    """
    if text is None or text in ("", match_empty):
        return F.lit(True)
    pattern = match_pattern(text, mode, match_case)
    return F.lit(False) if pattern is None else F.rlike(col, F.lit(pattern))


def _checked(pattern):
    """``pattern`` if the engine that will run it accepts it, else None; made to match one character at least.

    A named group holds what follows the start of a match; if nothing has been consumed at its end, the engine goes on to
    another way to match.
    """
    spark = SparkSession.active()
    probe = spark.createDataFrame([("",), ("a B 1_.-",)], "text string")
    try:
        hits = probe.select(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits")).collect()
    except SparkRuntimeException:
        return None
    if not any("" in r["hits"] for r in hits):
        return pattern
    flags, body = re.match(r"(\(\?[a-zA-Z]+\))?(.*)", pattern, re.S).groups()
    if re.search(r"\\[1-9]", body):
        return None
    return f"{flags or ''}(?=(?<rest>[\\s\\S]*))(?:{body})(?!\\k<rest>\\z)"


def match_pattern(text: str, mode="word", match_case=False):
    """The regular expression behind :func:`text_match`, or None when ``text`` is not a valid one."""
    flags = "(?U)" if match_case else "(?iuU)"
    if mode == "word":
        return f"{flags}\\b{quoted(text)}\\b"
    if mode == "substring":
        return flags + quoted(text)
    if mode == "regex":
        return _checked(flags + text)
    raise ValueError(f"unknown match mode {mode!r}")


# F22 helper
def bullet_lines(items: Column, indent="\t* ") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(indent), x)), "\n")


# C11
def weighted_similarity(distance: Column, a: Column, b: Column) -> Column:
    """1 - distance / (100 * longer length), for a weighted distance from :mod:`spanloom.operators.similarity`."""
    return 1 - distance / (F.greatest(F.length(a), F.length(b)) * 100.0)


# M06
def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    exps = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda x: x / total)
