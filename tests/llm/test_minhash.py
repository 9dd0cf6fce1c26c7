"""MinHash components against brute force."""

import random
import re

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.llm import arrays, minhash

from .conftest import DOCUMENTS, edited, text

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def shingles(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words)} if len(words) == 1 else set(zip(words, words[1:]))


def expected(data):
    sets = [shingles(t) for _, t in data]
    top = list(range(len(data)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if root(j) == root(i) and data[j][0] is not None]
        least = min(ids) if ids else None
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=repr)


def found(spark, data, **options):
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    return rows(minhash.near_duplicates(df, **options), *COLUMNS)


def groups(seed, sizes):
    """Copies of base texts with some words changed, so that similarities lie on both sides of the limit."""
    r, data = random.Random(seed), []
    for g, copies in enumerate(sizes):
        base = text(1000 * seed + g, r.choice([1, 2, 3, 6, 12, 40, 120, 500]))
        for _ in range(copies):
            number = len(data)
            edits = r.randrange(0, max(1, len(base.split(" ")) // 12) + 1)
            data.append((number * 7 % 4999, edited(base, number, edits)))
    return data


def test_components_equal_brute_force(spark):
    data = groups(3, [1, 2, 3, 12, 1, 2, 30, 5, 5, 60] * 3)
    shared = text(99, 60)  # a passage that many otherwise different texts hold
    data += [(5000 + i, shared + " " + text(500 + i, 1 + i % 25)) for i in range(80)]
    assert found(spark, data) == expected(data)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    shared = text(7, 90)
    data = [(i, shared + " " + text(50 + i, 8 + i % 30)) for i in range(120)] + groups(5, [40, 40])[:80]
    want = expected(data)
    for members in (1024, 16, 3):
        monkeypatch.setattr(minhash, "MEMBERS", members)
        assert found(spark, data) == want


def test_odd_rows(spark, odd, odd_rows):
    data = [(r[0], r[1]) for r in odd_rows]
    assert rows(minhash.near_duplicates(odd), *COLUMNS) == expected(data)
    without = [(None, "a b c d e f g h i j k"), (None, "a b c d e f g h i j k"), (None, "x"), (4, "a b c d e f g h i j k l")]
    assert found(spark, without) == [
        (4, 11, 4, True), (None, 1, None, True), (None, 10, 4, False), (None, 10, 4, False)
    ]


def test_no_rows_and_clashing_columns(spark, nothing):
    assert minhash.near_duplicates(nothing).count() == 0
    df = spark.createDataFrame([(2, "a b c", "en", "s", 1), (1, "A  b\nc", "en", "s", 1)], DOCUMENTS)
    for extra in ("class", "signature", "kept", "component_id", "n", "root", "rows", "bucket"):
        df = df.withColumn(extra, F.lit("x"))
    assert rows(minhash.near_duplicates(df), *COLUMNS) == [(1, 2, 1, True), (2, 2, 1, False)]


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.95])
def test_signatures_meet_and_are_verified(similarity):
    """Sets of a given similarity share a band and pass the verification; the share of equal bytes estimates it."""
    r = np.random.default_rng(8)
    least, lost, total = minhash.least_matches(80), 0, 0
    for _ in range(150):
        size = int(r.integers(20, 400))
        both = int(np.ceil(2 * size * similarity / (1 + similarity)))
        pool = arrays.mix(r.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64))
        x, y = pool[:size], pool[size - both :]
        one, two = minhash.signatures([np.sort(x), np.sort(y)])
        bands = (one == two).reshape(minhash.BANDS, minhash.ROWS).all(axis=1)
        lost += not bands.any() or (one == two).sum() < least
        total += (one == two).mean() - both / (2 * size - both)
    assert lost == 0 and abs(total / 150) < 0.01


def test_parity_sketches_bound_the_difference():
    r = np.random.default_rng(9)
    for _ in range(200):
        pool = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
        x, y = pool[: r.integers(1, 1500)], pool[r.integers(0, 800) : r.integers(900, 3000)]
        a, b = (np.frombuffer(minhash.sketch_of(s), dtype=np.uint64) for s in (x, y))
        short = min(len(a), len(b))
        odd = int(np.bitwise_count(minhash._folded(a, short) ^ minhash._folded(b, short)).sum())
        assert odd <= len(np.setxor1d(x, y))
