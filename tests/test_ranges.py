import random

from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import ranges
from spanloom.operators.ranking import global_row_number


def spans(seed, n, docs=2):
    # One document holds most spans.
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        start = rnd.randrange(0, 400)
        out.append((0 if rnd.random() < 0.8 else rnd.randrange(docs), f"T{i}", start, start + rnd.randrange(1, 60)))
    return out


def test_overlapping_pairs_match_brute_force(spark):
    data = spans(1, 60)
    df = spark.createDataFrame(data, "doc_id int, ann_id string, start int, end int")
    got = rows(ranges.overlapping_pairs(df, df, ["doc_id"], bucket=16), "doc_id", "ann_id_a", "ann_id_b")
    want = sorted(
        ((a[0], a[1], b[1]) for a in data for b in data if a[0] == b[0] and b[2] < a[3] and b[3] > a[2]), key=repr
    )
    assert got == want


def test_points_and_covers_match_brute_force(spark):
    data = spans(2, 50)
    df = spark.createDataFrame(data, "doc_id int, ann_id string, start int, end int")
    points = spark.createDataFrame([(0, p) for p in range(0, 460, 7)], "doc_id int, at int")
    got = rows(ranges.points_in_intervals(points, df, ["doc_id"], "at", "start", "end", bucket=32), "at", "ann_id")
    assert got == sorted(
        ((p, s[1]) for p in range(0, 460, 7) for s in data if s[0] == 0 and s[2] <= p < s[3]), key=repr
    )
    inner = df.filter("end - start < 10")
    found = rows(ranges.covers(df, inner, ["doc_id"], bucket=16), "ann_id")
    small = [s for s in data if s[3] - s[2] < 10]
    assert found == sorted(
        ((a[1],) for a in data if any(b[0] == a[0] and b[2] >= a[2] and b[3] <= a[3] for b in small)), key=repr
    )


def test_chunked_windows_equal_plain_ones(spark):
    df = spark.range(100).select(F.lit("d").alias("doc_id"), F.col("id").alias("n"), (F.col("id") % 7).alias("v"))
    total = ranges.running_total(df, ["doc_id"], "n", "v", "t", chunk=8)
    assert rows(total, "n", "t") == sorted(((i, sum(x % 7 for x in range(i))) for i in range(100)), key=repr)
    prev = ranges.previous_row(df, ["doc_id"], "n", ["v"], chunk=8)
    assert rows(prev, "n", "prev_v") == sorted(((i, None if i == 0 else (i - 1) % 7) for i in range(100)), key=repr)
    sparse = df.withColumn("v", F.when(F.col("n") % 30 == 5, F.col("n")))
    last = ranges.last_before(sparse, ["doc_id"], "n", "v", "l", chunk=8)

    def want(i):
        return max((x for x in range(i) if x % 30 == 5), default=None)

    assert rows(last, "n", "l") == sorted(((i, want(i)) for i in range(100)), key=repr)


def test_global_row_number_with_a_hot_value(spark):
    df = spark.range(200).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    got = rows(global_row_number(df, [F.col("k"), F.col("id")], "place"), "id", "place")
    order = sorted(range(200), key=lambda i: (1 if i % 2 == 0 else i, i))
    assert got == sorted(((i, order.index(i) + 1) for i in range(200)), key=repr)
