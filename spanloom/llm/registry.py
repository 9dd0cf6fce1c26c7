"""Queries of this folder: name -> callable(spark, folder), and the SQL of those that SQL can state."""

QUERIES = {}
ORACLES = {}


class Tables:
    """Readers of the tables under one folder."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register
