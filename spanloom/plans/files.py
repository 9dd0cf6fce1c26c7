"""Queries that write the given tables as files into the shared folder and read them back through the file sources."""

import uuid

from pyspark.sql import functions as F

from spanloom.plans.registry import plan
from spanloom.plans.texts import CLEAN_SQL
from spanloom.session import ensure_checkpoint_dir
from spanloom.sources import reports, standoff, tables


def _folder(t, name):
    """A fresh folder next to the checkpoints."""
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@plan("s02_read_documents", "SELECT CAST(doc_id AS varchar) AS doc_id, text FROM documents")
def _(t):
    folder = _folder(t, "texts")
    docs = t.documents.select(F.col("doc_id").cast("string"), "text")
    # So many folders that none gets too long to be listed by one task.
    tables.write_documents(docs, folder, folders=1 + docs.count() // 10_000)
    return tables.read_documents(t.spark, f"{folder}/*/*.txt")


@plan("s05_read_table", "SELECT doc_id, source, text FROM documents")
def _(t):
    """Quotes, separators and line ends inside the fields survive."""
    folder = _folder(t, "table")
    rows = t.documents.select("doc_id", "source", "text")
    rows.write.csv(folder, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
                   ignoreTrailingWhiteSpace=False)
    return tables.read_table(t.spark, folder, rows.schema)


@plan("s27_list_collection", "SELECT CAST(doc_id AS varchar) AS doc_id, length(text) AS size, true AS dated FROM documents")
def _(t):
    folder = _folder(t, "collection")
    docs = t.documents.select(F.col("doc_id").cast("string"), "text")
    tables.write_documents(docs, folder)
    stats = docs.select("doc_id", F.length("text").alias("size"))
    found = standoff.list_collection(t.spark, folder, stats)
    return found.select("doc_id", "size", F.col("modified").isNotNull().alias("dated"))


@plan("s28_read_url_list", "SELECT url FROM pages")
def _(t):
    """Lines with blanks around the urls, and blank lines between them."""
    folder = _folder(t, "urls")
    t.pages.select(F.concat(F.lit("  "), "url", F.lit(" \n   \n")).alias("value")).write.text(folder)
    return tables.read_url_list(t.spark, folder)


@plan("k08_write_sample", f"SELECT value FROM (SELECT {CLEAN_SQL} AS value FROM documents) WHERE value <> ''")
def _(t):
    """The sample's lines, written with an empty annotation file next to them, and read from both files."""
    name = reports.write_sample(t.documents, "text", _folder(t, "sample"), "ana", 10, 1)
    return t.spark.read.text([f"{name}.txt", f"{name}.ann"], lineSep="\n").filter("value <> ''")


@plan("u05_batch_callback", "SELECT url FROM pages WHERE starts_with(url, 'https://') ORDER BY url LIMIT 20")
def _(t):
    """The urls handed to the callback: the first ones up to the limit, while all others are saved, too."""
    from spanloom.plans.learning import _stream
    from spanloom.sources.store import ParquetStore
    from spanloom.streaming.flows import discover_urls

    folder = _folder(t, "discovery")
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    entry = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), url, F.lit("</loc></url></urlset>"))
    store = ParquetStore(t.spark, f"{folder}/articles")
    # Nothing may be handed over; the table is there all the same.
    t.spark.createDataFrame([], "url string").write.parquet(f"{folder}/handed")
    discover_urls(
        _stream(t, "pages").select(entry.alias("xml")), store, f"{folder}/progress", limit=20, prefix="https://",
        on_batch=lambda urls: urls.select("url").write.mode("append").parquet(f"{folder}/handed"),
    )
    return t.spark.read.schema("url string").parquet(f"{folder}/handed")
