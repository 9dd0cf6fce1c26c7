"""Byte-pair merges: counting pairs, learning, encoding."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut_lineage

END = "</w>"
ROUNDS_PER_CUT = 4


def word_vocabulary(words: DataFrame, column="word") -> DataFrame:
    """(symbols, freq): distinct words as blank-separated characters with an end mark."""
    counts = words.groupBy(column).agg(F.count(F.lit(1)).alias("freq"))
    spaced = F.concat(F.regexp_replace(F.col(column), "(?s)(.)", "$1 "), F.lit(END))
    return counts.select(spaced.alias("symbols"), "freq")


def _pairs_of(symbols):
    """The neighbouring symbols of a word as an array of structs."""
    parts = F.split(symbols, " ")
    return F.zip_with(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("first"), b.alias("second")),
    )


# A18
def pair_counts(vocab: DataFrame) -> DataFrame:
    """(first, second, freq): neighbouring symbols weighted by the frequency of their words."""
    rows = vocab.filter(F.contains("symbols", F.lit(" "))).select("freq", F.explode(_pairs_of("symbols")).alias("p"))
    return rows.groupBy("p.first", "p.second").agg(F.sum("freq").alias("freq"))


def _apart(symbols):
    """Symbols with blanks of their own on both sides, so that a pair is a plain piece of text and repeats don't overlap."""
    return F.concat(F.lit(" "), F.replace(symbols, F.lit(" "), F.lit("  ")), F.lit(" "))


def _together(apart):
    return F.replace(F.trim(apart), F.lit("  "), F.lit(" "))


def merge_pairs(apart, pairs):
    """Every occurrence of each pair, from the left, written as one symbol."""
    for first, second in pairs:
        apart = F.replace(apart, F.lit(f" {first}  {second} "), F.lit(f" {first}{second} "))
    return apart


def _comes_first(tied, pair, chosen):
    """Whether merging ``chosen`` can make a pair out of ``tied`` that is as frequent as ``pair`` and sorted before it."""
    left = {tied[0], *[a + b for a, b in chosen if b == tied[0]]}
    right = {tied[1], *[a + b for a, b in chosen if a == tied[1]]}
    return any((a, b) < pair for a in left for b in right if (a, b) != tied)


def _safe_run(top, room, known):
    """The first pairs of ``top``, in order, that come one after the other whatever the earlier ones change.

    Merging (a, b) only lowers counts of pairs that end in a or begin with b, and makes new pairs that are no more
    frequent than such a pair. So pairs can be taken together as long as none of them begins with the end, or ends with
    the beginning, of one before it. A run also ends where a new pair of the same frequency may come in between, and after
    a pair of equal symbols or whose merged symbol is ``known``: there counts can rise. ``top`` (first, second, freq) shows
    all pairs of a frequency only if something less frequent follows.
    """
    chosen, ends, begins = [], set(), set()
    for i, (first, second, freq) in enumerate(top):
        if len(chosen) == room or first in ends or second in begins:
            break
        tied = [p for p in top[i + 1 :] if p[2] == freq] if chosen else []
        if tied and (top[-1][2] == freq or any(_comes_first(p[:2], (first, second), chosen) for p in tied)):
            break
        chosen.append((first, second))
        ends.add(second)
        begins.add(first)
        if first == second or first + second in known:
            break
        known.add(first + second)
    return chosen


# U02
def learn_merges(vocab: DataFrame, k: int, look_ahead=1000):
    """The first k merges, most frequent pair first (ties by pair), as a list; and the vocabulary after them.

    Pair frequencies are kept as a table. A round takes the run of top pairs that no merge in it can reorder, merges them
    all at once in the words that hold one, and corrects the frequencies by what those words lose and gain; other words
    only pass a filter. The driver sees the ``look_ahead`` most frequent pairs of a round, and once the symbols of
    several characters that the vocabulary starts with.
    """
    merges, rounds = [], 0
    vocab = cut_lineage(vocab.select(_apart(F.col("symbols")).alias("word"), "freq"))
    symbols = vocab.select(F.explode(F.split(_together(F.col("word")), " ")).alias("s")).filter(F.length("s") > 1).distinct()
    known = {r["s"] for r in symbols.collect()}
    counts = cut_lineage(pair_counts(vocab.select(_together(F.col("word")).alias("symbols"), "freq")))
    while len(merges) < k:
        top = counts.orderBy(F.desc("freq"), "first", "second").limit(look_ahead).collect()
        run = _safe_run([tuple(r) for r in top], k - len(merges), known)
        if not run:
            break
        merges += run
        merged = merge_pairs(F.col("word"), run)
        if len(merges) < k:
            touched = vocab.select("word", merged.alias("merged"), "freq").filter("word <> merged")
            both = F.array(
                F.struct(F.col("word").alias("w"), (-F.col("freq")).alias("freq")),
                F.struct(F.col("merged").alias("w"), F.col("freq").alias("freq")),
            )
            change = touched.select(F.explode(both).alias("c")).select(_together(F.col("c.w")).alias("symbols"), "c.freq")
            counts = counts.unionByName(pair_counts(change)).groupBy("first", "second").agg(F.sum("freq").alias("freq"))
            counts = cut_lineage(counts.filter("freq > 0"))
        vocab = vocab.select(merged.alias("word"), "freq")
        rounds += 1
        if rounds % ROUNDS_PER_CUT == 0:
            vocab = cut_lineage(vocab)
    return merges, vocab.select(_together(F.col("word")).alias("symbols"), "freq")


def _encode_word(word, ranks):
    """Symbols of a word after applying the learned merges in the order they were learned."""
    symbols = [*word, END]
    while len(symbols) > 1:
        ranked = [(ranks[p], p) for p in zip(symbols, symbols[1:], strict=False) if p in ranks]
        if not ranked:
            break
        pair, out, i = min(ranked)[1], [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


# U03
def encode(words: DataFrame, merges, column="word") -> DataFrame:
    """Adds ``symbols``: each distinct word is encoded once and joined back. A one-character word stays as it is."""
    ranks = {pair: i for i, pair in enumerate(merges)}

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: [w] if len(w) == 1 else _encode_word(w, ranks))

    coder = F.pandas_udf(run, "array<string>")
    distinct = words.select(column).distinct().withColumn("symbols", coder(F.col(column)))
    return words.join(distinct, column)
