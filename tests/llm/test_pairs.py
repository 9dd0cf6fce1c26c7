"""N-gram join against brute force."""

import random
import re

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from spanloom.llm import arrays, ngram_join

from .conftest import edited, text


def shingles(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


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
        group = [data[j][0] for j in range(len(data)) if root(j) == root(i) and data[j][0] is not None]
        out.append((d, len(sets[i]), min(group) if group else None))
    return sorted(out, key=repr)


def found(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    return rows(ngram_join.ngram_components(df), "doc_id", "n_shingles", "component_id")


def test_components_equal_brute_force(spark):
    data, number = [], 0
    r = random.Random(3)
    for g in range(25):
        base = text(g, r.choice([3, 5, 6, 9, 20, 60, 150, 700]))
        for c in range(r.choice([1, 2, 3, 12])):
            number += 1
            size = len(base.split(" "))
            data.append((number * 7 % 1009, edited(base, number, r.randrange(0, max(1, size // 25) + 1))))
    shared = text(99, 60)  # a passage that many otherwise different texts hold
    for i in range(60):
        data.append((2000 + i, shared + " " + text(500 + i, r.choice([2, 8, 12, 20, 60]))))
    assert found(spark, data) == expected(data)


def test_chain_of_near_copies_is_one_component(spark):
    base = [f"t{i}" for i in range(120)]
    data = []
    for i in range(30):
        base[(i * 17) % 120] = f"n{i}"
        data.append((i, " ".join(base)))
    assert found(spark, data) == expected(data)


def test_odd_rows(spark, odd, nothing, odd_rows):
    assert rows(ngram_join.ngram_components(odd), "doc_id", "n_shingles", "component_id") == expected(
        [(r[0], r[1]) for r in odd_rows]
    )
    assert ngram_join.ngram_components(nothing).count() == 0
    wide = odd.withColumns({c: F.lit("x") for c in ("class", "gone", "signature")})
    kept = ngram_join.one_per_component(wide)
    assert kept.columns == wide.columns
    assert rows(kept, "doc_id") == sorted([(i,) for i in (1, 2, 3, 4, 6, 8, 8, 9, 10, None)], key=repr)


def test_signatures_meet_for_every_similar_pair():
    r = np.random.default_rng(1)
    for size in [1, 2, 3, 5, 7, 12, 40, 90, 130, 300, 600, 2500]:
        for _ in range(20):
            pool = arrays.mix(np.sort(r.choice(2**62, size * 2, replace=False)).astype(np.uint64))
            common = int(r.integers(max(1, int(size * 0.8)), size + 1))
            extra = int(r.integers(0, size - common + 1)) if size > common else 0
            x = np.sort(pool[:size])
            y = np.sort(np.concatenate([pool[:common], pool[size : size + extra]]))
            inter = len(np.intersect1d(x, y))
            if 100 * inter >= 80 * len(np.union1d(x, y)):
                assert set(ngram_join._signatures(x, 80).tolist()) & set(ngram_join._signatures(y, 80).tolist())


def test_sketches_reject_no_link():
    r = np.random.default_rng(2)
    for size in [1, 4, 30, 200, 3000]:
        x = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(len(x) * 0.9)], r.integers(0, 2**63, size // 20).astype(np.uint64)]))
        inter = len(np.intersect1d(x, y))
        if len(y) and 100 * inter >= 80 * (len(x) + len(y) - inter):
            a, b = ngram_join._sketch(x), ngram_join._sketch(y)
            bits = min(len(a), len(b)) * 8
            assert ngram_join._near(80, len(x), len(y), ngram_join._words_of(a, bits), ngram_join._words_of(b, bits))
