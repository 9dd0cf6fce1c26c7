"""Occurrences of many texts in documents, at the boundaries of search tokens.

A dictionary of bounded size becomes an automaton that finds all its texts in one pass over a document, in the document's
own row: neither documents nor tokens are shuffled. A larger dictionary is cut into several automata, each run in a pass of
its own; beyond that, tokens and texts meet by their first token in a shuffle.
"""

import functools
import uuid

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.textual import search_tokens, whitespace_tokens
from spanloom.session import cut_lineage, spread

PIECE_CHARS = 2_000_000  # of the texts in one automaton, which takes some tens of bytes for each
MAX_PIECES = 8

# The word characters of the tokenizer's own pattern, and the blanks between its words.
WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]")
BLANK = frozenset(" \t\n\x0b\f\r")


@functools.lru_cache(maxsize=1 << 16)
def _is_word(char):
    return WORD.match(char) is not None


def _all_other(text, at, step):
    """Whether all characters from ``at`` to the end of the blank-separated word, going by ``step``, are no word characters."""
    while 0 <= at < len(text) and text[at] not in BLANK:
        if _is_word(text[at]):
            return False
        at += step
    return True


def starts_token(text, at):
    """Whether a search token starts at ``at``, a place that holds no blank.

    Runs of other characters at either end of a word are tokens of their own; of a word of such characters only, the last
    one is.
    """
    if at == 0 or text[at - 1] in BLANK:
        return True
    if _is_word(text[at]):
        return not _is_word(text[at - 1]) and _all_other(text, at - 1, -1)
    if _is_word(text[at - 1]):
        return _all_other(text, at, 1)
    last = at + 1 == len(text) or text[at + 1] in BLANK
    return last and _all_other(text, at - 1, -1)


def ends_token(text, end):
    """Whether a search token ends before ``end``: there the text or the word ends, or another token starts."""
    if text[end - 1] in BLANK:
        return False
    return end == len(text) or text[end] in BLANK or starts_token(text, end)


_automata = {}


def _automaton(key, texts):
    """The automaton of one piece; a worker process keeps the last one, as its tasks share it."""
    import ahocorasick

    if key not in _automata:
        _automata.clear()
        found = ahocorasick.Automaton()
        for text in texts.value:
            found.add_word(text, len(text))
        found.make_automaton()
        _automata[key] = found
    return _automata[key]


def _found(key, texts):
    def run(batches):
        automaton = _automaton(key, texts)
        for batch in batches:
            rows, starts, ends, hits = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for last, length in automaton.iter(text) if text and len(automaton) else ():
                    start, end = last + 1 - length, last + 1
                    if starts_token(text, start) and ends_token(text, end):
                        rows.append(row)
                        starts.append(start)
                        ends.append(end)
                        hits.append(text[start:end])
            doc = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            columns = [doc, pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(hits, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "text"])

    return run


def _by_automata(docs, texts, pieces):
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, end long, text string"
    texts = texts.withColumn("_piece", F.pmod(F.xxhash64("text"), F.lit(pieces)))
    parts, docs = [], spread(docs.select("doc_id", "text"))
    for piece in range(pieces):
        rows = texts.filter(F.col("_piece") == piece).select("text").toArrow()  # of bounded size
        shared = spark.sparkContext.broadcast(sorted(rows.column("text").to_pylist()))
        run = _found(uuid.uuid4().hex, shared)
        parts.append(docs.mapInArrow(run, schema))
    return functools.reduce(DataFrame.unionByName, parts)


def first_tokens(text):
    """The search tokens a text can begin with, where it stands at token boundaries of a document.

    A leading run of non-word characters is one token, or all but its last character when nothing else is in the word.
    """
    word = F.regexp_extract(text, "^\\S+", 0)
    run = F.regexp_extract(word, "(?U)^\\W+", 0)
    core = F.regexp_extract(word, "(?U)^.*\\w", 0)
    short = F.substr(run, F.lit(1), F.length(run) - 1)
    alone = (run == word) & (F.length(run) > 1)
    return F.when(run == "", F.array(core)).when(alone, F.array(run, short)).otherwise(F.array(run))


def _by_first_tokens(docs, texts):
    """Candidates start at a token that can open a text and have its length, so they grow with the tokens only."""
    lengths = (
        texts.withColumn("token", F.explode(first_tokens(F.col("text"))))
        .groupBy("token")
        .agg(F.collect_set(F.length("text")).alias("lengths"))
    )
    toks = cut_lineage(search_tokens(whitespace_tokens(docs)).select("doc_id", "start", "end", "text"))
    tries = (
        toks.select("doc_id", "start", F.col("text").alias("token"))
        .join(lengths, "token")
        .select("doc_id", "start", F.explode("lengths").alias("length"))
        .withColumn("end", F.col("start") + F.col("length"))
    )
    tries = tries.join(toks.select("doc_id", "end").distinct(), ["doc_id", "end"], "left_semi")
    cut = F.substr("_text", (F.col("start") + 1).cast("int"), F.col("length"))
    cut = tries.join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id").withColumn("text", cut)
    return cut.join(texts, "text", "left_semi").select("doc_id", "start", "end", "text")


def mentions(docs: DataFrame, texts: DataFrame, piece_chars=PIECE_CHARS, max_pieces=MAX_PIECES) -> DataFrame:
    """(doc_id, start, end, text) wherever one of ``texts`` (text, distinct, not led by a blank) stands in a document.

    It has to start where a search token starts and to end where one ends. Overlapping places are all reported. The two
    bounds choose between automata and shuffle; the result is the same.
    """
    texts = cut_lineage(texts.select("text"))
    chars = texts.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    pieces = -(-chars // piece_chars)
    if pieces <= max_pieces:
        return _by_automata(docs, texts, max(pieces, 1))
    return _by_first_tokens(docs, texts)
