"""Streams over several batches against the same rows at once."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows

from spanloom.operators.logs import annotation_spans
from spanloom.streaming.flows import annotation_time_stream, latest_spans

SCHEMA = "line_no long, time timestamp, user string, document string, state string, action string"


def told(spark, folder, data, batches, **options):
    """The last revisions after a stream over ``batches`` equal parts of ``data``, and the query."""
    size = -(-len(data) // batches)
    for k in range(batches):
        part = spark.createDataFrame(data[k * size : (k + 1) * size], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/log")
    log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    query = annotation_time_stream(log, **options).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= batches
    return rows(latest_spans(spark.read.parquet(f"{folder}/out")), "user", "line_no", "seconds"), query


def log_rows(n, time):
    r = random.Random(5)
    return [
        (i, time(i, r), "u%d" % r.randrange(3), "doc", r.choice(["START", "FINISH"]),
         r.choice(["spanSelected", "createSpan", "getDocument"]))
        for i in range(n)
    ]


def at_once(spark, data):
    spans = annotation_spans(spark.createDataFrame(data, SCHEMA), keys=("document", "user"))
    return rows(spans, "user", "line_no", "seconds")


BEGIN = datetime(2024, 1, 1)


@pytest.mark.parametrize("order", ["by line", "by chance"])
def test_annotation_time_over_batches(spark, tmp_path, order):
    data = log_rows(600, lambda i, r: BEGIN + timedelta(days=r.randrange(400), seconds=r.randrange(86400)))
    placed = list(data)
    if order == "by chance":
        random.Random(6).shuffle(placed)
    got, _ = told(spark, str(tmp_path), placed, 6, lines_per_page=16)
    assert got == at_once(spark, data) and len(got) > 20


def test_annotation_time_forgets_what_can_not_change(spark, tmp_path):
    data = log_rows(800, lambda i, r: BEGIN + timedelta(hours=i))
    got, query = told(spark, str(tmp_path), data, 8, lateness="2 days", lines_per_page=16)
    assert got == at_once(spark, data)
    # Two days are 48 of the 800 lines: three users with a few pages each, and a book each.
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 60


@pytest.mark.parametrize("step", [1, 1000])
def test_pages_hold_lines_however_far_apart(spark, tmp_path, step):
    data = [(i * step, *rest) for i, *rest in log_rows(120, lambda i, r: BEGIN + timedelta(minutes=i))]
    placed = sorted(data, key=lambda row: (row[0] // step * 37) % 120)
    got, query = told(spark, str(tmp_path), placed, 3, lines_per_page=32)
    assert got == at_once(spark, data) and got
    # A page or two and a book for each of three users.
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 15
