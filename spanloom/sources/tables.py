"""Table, text and url-list readers; JSON records."""

import re
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import cut_lineage, spread


# S05
def read_table(spark: SparkSession, path, schema, multi_line=True) -> DataFrame:
    """CSV with an explicit schema (ids stay whole numbers).

    Quoted fields may span lines; a file is then read by one task, so turn ``multi_line`` off for large files without.
    """
    return spark.read.csv(path, schema=schema, header=True, multiLine=multi_line, escape='"', mode="FAILFAST")


def read_table_or_empty(spark: SparkSession, path, schema) -> DataFrame:
    """Like :func:`read_table`, and no rows when the file is not there yet."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)
    return read_table(spark, path, schema) if found else spark.createDataFrame([], schema)


def is_folder(spark: SparkSession, path) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop_path).isDirectory()


# S06
def query(spark: SparkSession, sql: str, **tables) -> DataFrame:
    """A SQL query over the session's catalog; ``{name}`` in the text stands for a given DataFrame."""
    return spark.sql(sql, **tables)


def query_jdbc(spark: SparkSession, url, sql, **options) -> DataFrame:
    """The same against a remote warehouse; pass partitionColumn, bounds and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


FILES_AT_ONCE = 4096
BYTES_AT_ONCE = 4 << 20


def _file_system(folder):
    where = folder if "://" in folder or folder.startswith("/") else folder.replace(":", "://", 1)
    return pafs.FileSystem.from_uri(where)


def _listed(pattern):
    """(path, name) of the files of folders that match a pattern of * and ?; hidden ones are left out."""
    match = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern), re.DOTALL).fullmatch

    def run(batches):
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                fs, root = _file_system(folder)
                found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
                names = [f.base_name for f in found if f.type == pafs.FileType.File and match(f.base_name) and f.base_name[0] not in "._"]
                for at in range(0, len(names), FILES_AT_ONCE):
                    part = names[at : at + FILES_AT_ONCE]
                    yield pa.RecordBatch.from_arrays([pa.array([folder] * len(part)), pa.array(part)], ["folder", "name"])

    return run


def _contents(batches):
    def rows(names, texts):
        ids = [n[:-4] if n.endswith(".txt") else "" for n in names]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], ["doc_id", "text"])

    for batch in batches:
        names, texts, size, known = [], [], 0, {}
        for folder, name in zip(batch.column("folder").to_pylist(), batch.column("name").to_pylist()):
            if folder not in known:
                known[folder] = _file_system(folder)
            fs, root = known[folder]
            with fs.open_input_stream(f"{root}/{name}", compression=None) as file:
                texts.append(file.read())
            names.append(name)
            size += len(texts[-1])
            if size > BYTES_AT_ONCE or len(names) >= FILES_AT_ONCE:
                yield rows(names, texts)
                names, texts, size = [], [], 0
        yield rows(names, texts)


def _folders(spark, path):
    """Folders of a path whose last part is a pattern of * and ?, if tasks can list them themselves; else none."""
    parent, _, pattern = path.rpartition("/") if isinstance(path, str) else ("", "", "")
    if not parent or not re.search("[*?]", pattern) or re.search(r"[\[\]{}\\]", path):
        return [], pattern
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
    found = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    folders = [f.getPath().toString() for f in found or () if f.isDirectory()]
    try:
        return [f for f in folders if _file_system(f)], pattern
    except (pa.ArrowException, OSError):
        return [], pattern


# S02
def read_documents(spark: SparkSession, path) -> DataFrame:
    """(doc_id, text): whole text files, the document id being the file name without its suffix.

    Where the last part of the path is a pattern, tasks list a folder each and read many files one after the other; the
    driver knows the folders only. Other paths, and stores that only Spark reads, go through Spark's own reader.
    """
    folders, pattern = _folders(spark, path)
    if folders:
        given = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(len(folders))
        files = cut_lineage(given.mapInArrow(_listed(pattern), "folder string, name string"))
        n = files.count()
        if n:
            parts = max(spark.sparkContext.defaultParallelism, -(-n // FILES_AT_ONCE))
            read = files.repartition(parts).mapInArrow(_contents, "doc_id string, text binary")
            return read.select("doc_id", F.col("text").cast("string").alias("text"))
    df = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)\\.txt$", 1)
    return df.select(name.alias("doc_id"), F.col("value").alias("text"))


def write_documents(docs: DataFrame, folder: str, folders=0) -> None:
    """One text file <doc_id>.txt per row of (doc_id, text); tasks write straight into the shared folder.

    With ``folders``, files are dealt out to so many folders below it, which can be listed at the same time.
    """
    def write(batches):
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        made = {root}
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                home = f"{root}/{zlib.crc32(str(name).encode()) % folders}" if folders else root
                if home not in made:
                    fs.create_dir(home, recursive=True)
                    made.add(home)
                with fs.open_output_stream(f"{home}/{name}.txt") as file:
                    file.write((text or "").encode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")], ["doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spread(docs.select("doc_id", "text")).mapInArrow(write, f"doc_id {kind}").write.format("noop").mode("overwrite").save()


# S28
def read_url_list(spark: SparkSession, paths) -> DataFrame:
    """One url per line, trimmed, blank lines dropped."""
    lines = spark.read.text(paths).select(F.trim("value").alias("url"))
    return lines.filter("url <> ''")


# K09
RECORD_OPTIONS = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSZ", "ignoreNullFields": "false"}


def to_json_rows(df: DataFrame) -> DataFrame:
    """(json): each record with timestamps as text and nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), RECORD_OPTIONS).alias("json"))


def from_json_rows(df: DataFrame, schema, column="json") -> DataFrame:
    """Records of a JSON column; a field the schema does not have is an error."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    known = F.array(*[F.lit(f.name) for f in fields.fields])
    extra = F.array_except(F.json_object_keys(column), known)
    bad = F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", ")))
    checked = F.when(F.size(extra) > 0, bad.cast("string")).otherwise(F.col(column))
    parsed = df.select(F.from_json(checked, fields, {k: v for k, v in RECORD_OPTIONS.items() if k == "timestampFormat"}).alias("r"))
    return parsed.select("r.*")
