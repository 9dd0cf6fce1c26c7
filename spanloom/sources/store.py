"""Versioned Parquet tables: every write goes to a new folder, so a table is never overwritten while it is read."""

import importlib
import json
import uuid
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import articles as A
from spanloom.session import cut_lineage


class ArticleStore(Protocol):
    """What a store must offer; every method takes and gives DataFrames."""

    def get_all(self, limit=-1, scraped=None, order=()) -> DataFrame: ...

    def save(self, rows: DataFrame) -> None: ...

    def delete(self, urls: DataFrame) -> None: ...

    def filter_known_urls(self, urls: DataFrame) -> DataFrame: ...

    def filter_scraped_urls(self, urls: DataFrame) -> DataFrame: ...

    def was_scraped(self, urls: DataFrame) -> DataFrame: ...


STORE_METHODS = ["get_all", "save", "delete", "filter_known_urls", "filter_scraped_urls", "was_scraped"]


class VersionedTable:
    """A table under ``path``, split by a hash of ``key`` into buckets; a change rewrites only the buckets it touches.

    A version is one small file that names the data folder of each bucket. It is created under the next number and never
    overwritten, so of two writers one gets the number and the other repeats its change on top. Older versions stay
    readable until ``keep`` newer ones exist; then their files, and data folders that nothing names any more, go.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key="url", buckets=16, keep=2):
        self.spark, self.path, self.schema, self.key, self.buckets, self.keep = spark, path, schema, key, buckets, keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = jvm.org.apache.commons.io.IOUtils

    def _manifest(self, version):
        """{bucket: data folder} of a version, or None if its writer did not finish."""
        stream = self._fs.open(self._path(f"{self.path}/versions/{version}"))
        try:
            return {int(k): v for k, v in json.loads(self._text.toString(stream, "UTF-8")).items()}
        except ValueError:
            return None
        finally:
            stream.close()

    def _versions(self):
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = (status.getPath().getName() for status in self._fs.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def current_version(self):
        return next((v for v in reversed(self._versions()) if self._manifest(v) is not None), None)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, manifest, only=None):
        paths = [f"{self.path}/data/{folder}/_bucket={b}" for b, folder in manifest.items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version=None) -> DataFrame:
        version = self.current_version() if version is None else version
        return self._read({} if version is None else self._manifest(version))

    def change(self, keys: DataFrame, new_rows) -> int:
        """Replaces the buckets of ``keys`` by ``new_rows(their present rows)``; returns the version written."""
        touched = {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}  # at most ``buckets`` rows
        columns = self.spark.createDataFrame([], self.schema).columns
        while True:
            known = self._versions()
            current = self.current_version()
            manifest = {} if current is None else self._manifest(current)
            folder = uuid.uuid4().hex
            rows = new_rows(self._read(manifest, touched)).select(*columns).withColumn("_bucket", self._bucket())
            rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
            written = {
                int(status.getPath().getName().split("=")[1])
                for status in self._fs.listStatus(self._path(f"{self.path}/data/{folder}"))
                if status.getPath().getName().startswith("_bucket=")
            }
            merged = {b: f for b, f in manifest.items() if b not in touched} | {b: folder for b in written}
            version = (known[-1] if known else 0) + 1
            if self._claim(version, merged):
                self._clean()
                return version

    def _claim(self, version, manifest):
        try:
            stream = self._fs.create(self._path(f"{self.path}/versions/{version}"), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName() or "already exists" in str(error):
                return False
            raise
        stream.write(bytearray(json.dumps(manifest), "utf-8"))
        stream.close()
        return True

    def _clean(self):
        """Removes what only versions before the last ``keep`` name; folders of unfinished writers are left alone."""
        versions = self._versions()
        old, kept = versions[: -self.keep], versions[-self.keep :]
        used = {f for v in kept for f in (self._manifest(v) or {}).values()}
        for v in old:
            for folder in set((self._manifest(v) or {}).values()) - used:
                self._fs.delete(self._path(f"{self.path}/data/{folder}"), True)
            self._fs.delete(self._path(f"{self.path}/versions/{v}"), False)


class ParquetStore:
    """The article store on a versioned table."""

    def __init__(self, spark: SparkSession, path: str, buckets=16):
        self.table = VersionedTable(spark, path, A.ARTICLE_SCHEMA, buckets=buckets)

    def rows(self) -> DataFrame:
        return self.table.read()

    def get_all(self, limit=-1, scraped=None, order=()) -> DataFrame:
        return A.get_all(self.rows(), limit, scraped, order)

    def save(self, rows: DataFrame) -> None:
        """Adds rows or puts them in place of those with their url, last write wins; of several the latest scraped."""
        ranked = rows.withColumn("version", F.coalesce(F.unix_micros("last_scraped"), F.lit(0)))
        self.table.change(ranked, lambda present: A.upsert(present, ranked))

    def delete(self, urls: DataFrame) -> None:
        self.table.change(urls, lambda present: A.delete(present, urls))

    def filter_known_urls(self, urls: DataFrame) -> DataFrame:
        return A.filter_known(urls, self.rows())

    def filter_scraped_urls(self, urls: DataFrame) -> DataFrame:
        return A.filter_known(urls, self.rows(), scraped_only=True)

    def was_scraped(self, urls: DataFrame) -> DataFrame:
        return A.was_scraped(urls, self.rows())


class TieredStore(ParquetStore):
    """A hot table for what is pending and a cold one for what is complete; ``content`` may cut texts that move."""

    def __init__(self, spark: SparkSession, hot: str, cold: str, content=None, buckets=16):
        super().__init__(spark, hot, buckets)
        self.cold = VersionedTable(spark, cold, A.ARTICLE_SCHEMA, buckets=buckets)
        self.content = content

    def get_all(self, limit=-1, scraped=None, order=()) -> DataFrame:
        return A.get_all_tiered(self.rows(), self.cold.read(), limit, scraped, order).drop("tier")

    def filter_known_urls(self, urls: DataFrame) -> DataFrame:
        return A.filter_known(urls, self.rows().unionByName(self.cold.read()))

    def filter_scraped_urls(self, urls: DataFrame) -> DataFrame:
        return A.filter_known(urls, self.rows().unionByName(self.cold.read()), scraped_only=True)

    def was_scraped(self, urls: DataFrame) -> DataFrame:
        return A.was_scraped(urls, self.rows().unionByName(self.cold.read()))

    def delete(self, urls: DataFrame) -> None:
        super().delete(urls)
        self.cold.change(urls, lambda present: A.delete(present, urls))

    def move(self) -> None:
        """Moves what is ready: the cold table is written before the hot one loses the rows, so a failure loses nothing."""
        ready = cut_lineage(A.with_flags(self.rows()).filter("is_ready").select("url"))
        if ready.isEmpty():
            return
        chosen = self.rows().join(ready, "url", "left_semi")
        self.cold.change(ready, lambda cold: A.move_ready(chosen, cold, content=self.content)[0])
        self.table.change(ready, lambda hot: hot.join(ready, "url", "left_anti"))


# U04
def load_store(module: str, name: str, *args, **options):
    """An instance of a user's store class, checked for the methods a store needs."""
    cls = getattr(importlib.import_module(module), name)
    missing = [m for m in STORE_METHODS if not callable(getattr(cls, m, None))]
    if missing:
        raise TypeError(f"{module}.{name} is no article store; it lacks {missing}")
    return cls(*args, **options)
