"""Registered queries: a Spark plan over the driver's tables and, where SQL can say it, the same result in SQL."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

PLANS = {}
ORACLES = {}

PLAIN = (T.StringType, T.LongType, T.DoubleType, T.BooleanType, T.TimestampType, T.DateType)


class Tables:
    """Lazy readers for the tables under one scale-factor folder."""

    def __init__(self, spark, folder):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _widened(df):
    """Integer columns as BIGINT, so both engines report the same schema."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("long").alias(f.name)
            if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def plan(name, sql=None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        def run(spark, folder):
            return _widened(fn(Tables(spark, folder)))

        run.__doc__ = fn.__doc__
        run.__name__ = name
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register
