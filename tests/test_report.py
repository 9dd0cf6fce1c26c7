"""The performance report read back whole."""

from spanloom.operators import datasets as D
from spanloom.plans import learning  # noqa: F401
from spanloom.plans.registry import PLANS

FOLDER = "/root/testdata/sf0.001"


def test_performance_report_has_all_models_and_rows(spark):
    documents, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    got = PLANS["k07_performance_report"](spark, FOLDER).collect()
    test = D.split(documents.select("doc_id", "text").join(labels, "doc_id"), "doc_id", 0.3).filter("part = 'test'")
    assert len(got) == len({(r["model_name"], r["model_class_name"]) for r in got}) == 13
    assert {r["analysis_rows"] for r in got} == {test.count()}
    assert {r["sources"] for r in got} == {f"{FOLDER}/documents.parquet"}


def test_all_models_meet_the_texts_in_one_join(spark):
    from spanloom.operators.metrics import prediction_analysis

    truth = spark.createDataFrame([(1, "one", 1), (2, "two", 0)], "k long, text string, y int")
    preds = {(f"m{i}", "C"): spark.createDataFrame([(1, i % 2), (2, 1)], "k long, pred_y int") for i in range(3)}
    made = prediction_analysis(truth, preds, ["y"], key="k")
    assert made.columns == ["k", "text", "y", "pred_y", "assert_y", "model_name", "model_class_name"]
    want = sorted(r for i in range(3) for r in ((1, "one", 1, i % 2, i % 2, f"m{i}", "C"), (2, "two", 0, 1, 0, f"m{i}", "C")))
    assert sorted(map(tuple, made.collect())) == want
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
