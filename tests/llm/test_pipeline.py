"""The pipeline's stages, each against a plain version of its decision, and the registered names."""

import re

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

from spanloom.llm.queries import QUERIES
from spanloom.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut_lineage(stage(spark, docs, FOLDER))
        assert after.columns == columns
        kept[name] = (docs, after)
        docs = after
    before, after = kept["language"]
    assert after.count() >= 0.99 * before.count()
    before, after = kept["near_duplicates"]
    left = {r["doc_id"]: r["text"] for r in after.collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for i, t in left.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in words.items()}
    pairs = [(i, j) for i in sets for j in sets if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    assert not pairs and len(left) < before.count()
    before, after = kept["benchmark_leaks"]
    items = [re.sub(r"\W+", " ", r["text"]).lower() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in before.collect() if any(i in re.sub(r"\W+", " ", r["text"]).lower() for i in items)}
    assert leaked == {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    before, after = kept["source_mix"]
    size = F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    total = [df.agg(size).first()[0] for df in (before, after)]
    assert abs(total[1] - total[0]) < 0.2 * total[0] and after.groupBy("doc_id").count().filter("count > 3").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == docs.count()


def test_stages_take_odd_rows_and_nothing(spark, odd, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, FOLDER).count() <= 3 * odd.count()
        assert stage(spark, nothing, FOLDER).count() == 0


def test_names():
    names = entry.queries()
    assert {"pipeline", *QUERIES} <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
