"""Report and sample writers."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import clean_post, to_ascii
from spanloom.operators.metrics import order_report


def _stamp(now, pattern):
    return (now or datetime.now()).strftime(pattern)


# K07
def save_reports(performance: DataFrame, analysis: DataFrame, sources, folder: str, n_texts: int, now=None) -> str:
    """Writes the performance (a row per model, by accuracy), the sources and the per-row analysis; returns the name."""
    name = f"{folder}/report-{_stamp(now, '%Y_%m_%d_%H%M%S')}-{n_texts}t"
    spark = performance.sparkSession
    # A row per model and per source file: small by nature, so one file each.
    order_report(performance).coalesce(1).write.csv(f"{name}-performance", header=True)
    spark.createDataFrame([(s,) for s in sources], "source string").coalesce(1).write.csv(f"{name}-sources", header=True)
    analysis.write.csv(f"{name}-analysis", header=True, escape='"')
    return name


def read_report(spark, name: str, performance_schema, analysis_schema):
    """The three parts of a written report: performance, sources, analysis. Texts of the analysis may span lines."""
    performance = spark.read.csv(f"{name}-performance", header=True, schema=performance_schema)
    sources = spark.read.csv(f"{name}-sources", header=True, schema="source string")
    analysis = spark.read.csv(f"{name}-analysis", schema=analysis_schema, escape='"', multiLine=True)
    return performance, sources, analysis


# K08
def sample_lines(sample: DataFrame, text: str) -> DataFrame:
    """Cleaned texts of a sample, one line each, a blank line after each."""
    cleaned = sample.select(to_ascii(clean_post(F.col(text))).alias("value"))
    return cleaned.select(F.concat("value", F.lit("\n")).alias("value"))


def write_sample(sample: DataFrame, text: str, folder: str, annotator: str, n: int, seed: int, now=None) -> str:
    """Writes the lines of a sample and an empty annotation file next to them; returns the name."""
    name = f"{folder}/{annotator}-sample_{n}-randstate_{seed}-{_stamp(now, '%Y-%m-%d_%H%M%S')}"
    sample_lines(sample, text).write.text(f"{name}.txt")
    sample.sparkSession.createDataFrame([], "value string").write.text(f"{name}.ann")
    return name


# K10
SUMMARY_SCHEMA = "date timestamp, description string, metrics map<string,double>, args map<string,string>"


def write_summary(spark, path: str, branch: str, experiment: str, description: str, metrics: dict, args: dict, now=None):
    """Adds one row to the experiments table, partitioned by branch and experiment."""
    row = (now or datetime.now(), description, {k: float(v) for k, v in metrics.items()}, {k: str(v) for k, v in args.items()})
    table = spark.createDataFrame([row], SUMMARY_SCHEMA).withColumns({"branch": F.lit(branch), "experiment": F.lit(experiment)})
    table.write.mode("append").partitionBy("branch", "experiment").parquet(path)


def read_summaries(spark, path: str) -> DataFrame:
    """Experiments with a readable summary, newest first."""
    def listing(column):
        return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(
            F.lit("\t* "), e["key"], F.lit(" = "), e["value"].cast("string"))), "\n")

    rows = spark.read.parquet(path)
    summary = F.concat(F.lit("DATE: "), F.col("date").cast("string"), F.lit("\nDESCRIPTION: "), "description",
                       F.lit("\nMETRICS:\n"), listing("metrics"), F.lit("\nARGS:\n"), listing("args"))
    return rows.withColumn("summary", summary).orderBy(F.desc("date"))
