"""Vector codes, clusters and MinHash components against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.llm import clusters, codes, tables

SCHEMA = "vec_id long, embedding array<double>, label int"


def sample(n, size, seed=1, groups=12):
    """Clustered vectors with equal ones, ties, nulls and what has to be left out."""
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(size)] for _ in range(groups)]
    out = []
    for i in range(n):
        base = r.choice(centers)
        vector = [x + r.gauss(0, 0.3) for x in base] if i % 5 else [round(x) / 4 for x in base]
        out.append((i * 7 % n, vector, r.choice([None, 1, 2, 3])))
    out += [(n + 1, None, 1), (n + 2, [1.0] * (size - 1) + [None], 1), (n + 3, [math.inf] * size, None)]
    out += [(n + 4, [math.nan] * size, 2), (n + 5, [0.0] * size, 3), (5, [0.5] * size, 3), (None, [0.25] * size, 3)]
    out += [(6, out[6][1], None), (n + 6, [1.0] * (size - 2), 1), (n + 7, [], 1)]
    return out


def usable(data, size):
    return [
        (i, v, label) for i, v, label in data
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]


def gap(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y))


def best(x, entries):
    return min((gap(x, e), k) for k, e in enumerate(entries))


def moved(points, owners, entries):
    out = []
    for k, e in enumerate(entries):
        mine = [p for p, o in zip(points, owners) if o == k]
        out.append([sum(c) // len(mine) for c in zip(*mine)] if mine else e)
    return out


def last(x):
    return (x is None, x)


def plain_codes(data, size, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in usable(data, size)]
    first = sorted(kept, key=lambda r: (last(r[0]), r[1]))[:entries]
    width = size // parts
    cut = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(parts)]
    books = [[v[p * width : (p + 1) * width] for _, v, _ in first] for p in range(parts)]
    for _ in range(rounds):
        books = [moved(c, [best(x, b)[1] for x in c], b) for c, b in zip(cut, books)]
    found = [[best(x, b) for x in c] for c, b in zip(cut, books)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(f[r][0] for f in found) for r in range(len(kept))]
    out = []
    for r, (i, _, label) in enumerate(kept):
        total = sum(e for e, k in zip(errors, kept) if k[2] == label)
        out.append((i, "".join("%02x" % f[r][1] for f in found), errors[r], total, digest))
    return sorted(out, key=repr)


CODE_COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize("entries,scale", [(16, 1024), (70, 3), (256, 1024)])
def test_codes_equal_plain_python(spark, entries, scale):
    data = sample(240, 8)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    found = rows(codes.compress(df, entries=entries, scale=scale), *CODE_COLUMNS)
    assert found == plain_codes(data, 8, codes.PARTS, entries, codes.ROUNDS, scale)


def test_slices_give_exactly_the_box():
    r = np.random.default_rng(4)
    entries = r.integers(-20, 20, (100, 5))
    points = r.integers(-25, 25, (200, 5))
    radius = r.integers(0, 30, 200)
    point, entry = codes.Slices(entries).candidates(points, radius)
    inside = (np.abs(points[:, None, :] - entries[None]) <= radius[:, None, None]).all(axis=2)
    assert list(zip(point.tolist(), entry.tolist())) == [tuple(x) for x in np.argwhere(inside).tolist()]
    squares = np.array([0, 1, 3, 4, 8, 9, (1 << 62) - 1, 1 << 62])
    assert codes.root(squares).tolist() == [math.isqrt(x) for x in squares.tolist()]


def test_slices_leave_out_most_entries_of_clustered_points():
    r = np.random.default_rng(5)
    centers = r.integers(-10_000, 10_000, (256, 16))
    points = centers[r.integers(0, 256, 2000)] + r.integers(-200, 200, (2000, 16))
    index = codes.Slices(centers)
    point, _ = index.candidates(points, codes.root(index.first_bound(points)))
    assert len(point) < 2000 * 256 * 0.2


def plain_clusters(data, size, count, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in usable(data, size)]
    draw = {i: hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~" for i, _ in kept}
    points = [v for _, v in kept]
    centers = [v for _, v in sorted(kept, key=lambda r: (draw[r[0]], r[1]))[:count]]
    for _ in range(rounds):
        centers = moved(points, [best(x, centers)[1] for x in points], centers)
    found = [best(x, centers) for x in points]
    inertia = sum(d for d, _ in found)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(
        ((i, k, d, sum(x for x, o in found if o == k), inertia, digests[k]) for (i, _), (d, k) in zip(kept, found)), key=repr
    )


CLUSTER_COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("count,scale", [(40, 256), (7, 2), (400, 256)])
def test_clusters_equal_plain_python(spark, count, scale):
    data = sample(300, 10, seed=2)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    found = clusters.cluster(df, count=count, scale=scale, components=10)
    assert rows(found, *CLUSTER_COLUMNS) == plain_clusters(data, 10, count, clusters.ROUNDS, scale)


def test_pivot_bounds_hold_and_spare_measurements():
    r = np.random.default_rng(3)
    centers = r.integers(-3000, 3000, (40, 64))
    points = centers[r.integers(0, 40, 3000)] + r.integers(-150, 150, (3000, 64))
    pivots = clusters.choose_pivots(centers, clusters.PIVOTS)
    bounds = clusters.Bounds(pivots, centers)
    cached = clusters.squared(points, pivots)
    exact = np.sqrt(clusters.squared(points, centers).astype(float))
    assert (bounds.least(cached) <= exact).all()
    owner, distance, measured = clusters.nearest(points, cached, centers, bounds)
    assert (owner == exact.argmin(axis=1)).all() and (distance == clusters.squared(points, centers).min(axis=1)).all()
    assert measured < 0.5 * exact.size
    same = np.zeros((5, 64), dtype=np.int64)  # all pivots alike: no pair bounds anything
    assert len(clusters.choose_pivots(same, 4)) == 1


@pytest.mark.parametrize("operator", [codes.compress, clusters.cluster])
def test_nothing_to_learn_from(spark, operator):
    for data in ([], [(1, None, 1), (2, [None] * 64, 2)]):
        out = operator(spark.createDataFrame(data, SCHEMA))
        assert out.count() == 0 and "vec_id" in out.columns
    one = operator(spark.createDataFrame([(3, [0.1] * 64, None)], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["vec_id"] == 3


def test_clashing_columns_and_kinds(spark):
    data = [(i, [float(i % 7), 1.0, float(i), 0.0], 1) for i in range(30)]
    plain = spark.createDataFrame(data, SCHEMA)
    odd = plain.select(F.col("vec_id").cast("int"), F.col("embedding").cast("array<float>"), F.col("label").cast("string"))
    for extra in ("code", "key", "values", "error", "n", "cluster", "distance", "cached"):
        odd = odd.withColumn(extra, F.lit(None))
    assert rows(codes.compress(odd), *CODE_COLUMNS) == rows(codes.compress(plain), *CODE_COLUMNS)
    wide, narrow = (clusters.cluster(x, components=4) for x in (odd, plain))
    assert rows(wide, *CLUSTER_COLUMNS) == rows(narrow, *CLUSTER_COLUMNS)


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9] * 64, 1)], SCHEMA)
    for operator in (codes.compress, clusters.cluster):
        with pytest.raises(ValueError, match="64 bits"):
            operator(df)
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], SCHEMA))


def test_lookup_splits_hot_keys(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2, 3, 3, None, 4])], "k long, i long")
    keyed = df.filter("k < 4").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("m"))
    for share in (2, 10_000):
        got = rows(tables.lookup(df, keyed, "k", "n", "left", hot_share=share), "k", "i", "m")
        want = rows(df.join(keyed.drop("n"), "k", "left"), "k", "i", "m")
        assert got == want
