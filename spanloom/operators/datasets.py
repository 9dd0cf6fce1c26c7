"""Assembly of data sets: sampling, splits, batches, cleaning, joins with labels."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.labels import IRRELEVANT, NOT_A_SERVICE, PROBLEM, encode_label
from spanloom.functions.text import drop_blank_lines
from spanloom.functions.urls import is_irrelevant_url
from spanloom.operators.articles import attach_labels, filter_known, latest, split_scrapable
from spanloom.operators.ranking import global_row_number


def hash_key(key, seed):
    """Text key of a reproducible random order; ``key`` must identify a row."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


# S07
def ordered_batches(df: DataFrame, order, batch_size: int, n_batches=None) -> DataFrame:
    """Adds ``batch_id``: rows in the given total order, ``batch_size`` to a batch; real batches, without overlap."""
    numbered = global_row_number(df, order, "_row")
    batched = numbered.withColumn("batch_id", F.floor((F.col("_row") - 1) / batch_size).cast("long")).drop("_row")
    return batched if n_batches is None else batched.filter(F.col("batch_id") < n_batches)


# O03
def shuffle(df: DataFrame, key: str, seed=42) -> DataFrame:
    return df.orderBy(hash_key(key, seed))


# O04
def sample_n(df: DataFrame, key: str, n: int, seed=42) -> DataFrame:
    """n rows without replacement; asking for more than there are is an error."""
    if df.limit(n).count() < n:
        raise ValueError(f"cannot sample {n} rows: the table has fewer")
    return df.orderBy(hash_key(key, seed)).limit(n)


# J03
def available(rows: DataFrame, taken: DataFrame, key="id") -> DataFrame:
    """Rows whose id is not taken yet."""
    return rows.join(taken.select(key), key, "left_anti")


# A17
def sampling_report(rows: DataFrame, taken: DataFrame, sample: DataFrame, key="id") -> DataFrame:
    """Sizes of the whole, the taken, the available and the sampled set."""
    parts = rows.select(key, F.lit("total").alias("what"))
    for df, what in ((taken, "taken"), (available(rows, taken, key), "available"), (sample, "sampled")):
        parts = parts.unionByName(df.select(key, F.lit(what).alias("what")))
    return parts.agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("total", "taken", "available", "sampled")])


# O06
def split(df: DataFrame, key: str, frac=0.3, seed=42, stratify=None) -> DataFrame:
    """Adds ``part`` (train or test): exactly the share ``frac`` (rounded up) in test, per class when stratified."""
    hashed = df.withColumn("_hash", hash_key(key, seed))
    order = ["_hash"] if stratify is None else [stratify, "_hash"]
    numbered = global_row_number(hashed, [F.col(c) for c in order], "_row")
    if stratify is None:
        n_test = math.ceil(df.count() * frac)
        part = F.when(F.col("_row") <= n_test, "test").otherwise("train")
        return numbered.withColumn("part", part).drop("_row", "_hash")
    # One row per class: the first position and the size of the class in the total order.
    classes = numbered.groupBy(stratify).agg((F.min("_row") - 1).alias("_first"), F.count(F.lit(1)).alias("_size"))
    placed = numbered.join(classes, stratify)
    is_test = F.col("_row") - F.col("_first") <= F.ceil(F.col("_size") * frac)
    return placed.withColumn("part", F.when(is_test, "test").otherwise("train")).drop("_row", "_hash", "_first", "_size")


# O07
def best(df: DataFrame, score: str, n=6, tie=()) -> DataFrame:
    return df.orderBy(F.desc(score), *tie).limit(n)


def worst(df: DataFrame, score: str, n=6, tie=()) -> DataFrame:
    return df.orderBy(F.asc(score), *tie).limit(n)


# O09
def position_slices(df: DataFrame, order, sizes) -> DataFrame:
    """Adds ``part`` by position in a total order; ``sizes`` are (name, rows) pairs, rows after the last are left out."""
    total = sum(n for _, n in sizes)
    numbered = global_row_number(df, order, "_row").filter(F.col("_row") <= total)
    part, reach = F.lit(sizes[-1][0]), total
    for (name, _), (_, n) in zip(reversed(sizes[:-1]), reversed(sizes[1:]), strict=True):
        reach -= n
        part = F.when(F.col("_row") <= reach, F.lit(name)).otherwise(part)
    return numbered.withColumn("part", part).drop("_row")


# A12
def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


# J17
def uncaptured_lines(lines: DataFrame, captured: DataFrame, text="line") -> DataFrame:
    """Lines whose text is not among the captured ones."""
    return lines.join(captured.select(text).distinct(), text, "left_anti")


# F11
def trim_columns(df: DataFrame, columns, label=None) -> DataFrame:
    """Only the named columns; ``label`` is renamed to 'label'."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = df.select(*columns)
    return out if label is None else out.withColumnRenamed(label, "label")


# Columns of a client's data set and their names here.
CLIENT_COLUMNS = {
    "text": "content",
    "tipo_de_evento": "label",
    "tags": "categories",
    "Link de la noticia ": "url",
    "tipo de evento": "label_relevance",
    "servicio_resumido": "label_service",
}
KEPT_CLIENT_COLUMNS = [
    "url", "title", "content", "author", "categories", "date", "label_relevance", "label_service",
]
TRAINING_COLUMNS = ["url", "title", "content", "author", "categories", "date", "label", "source"]
IRRELEVANT_COLUMNS = [
    "label_relevance", "label_service", "content", "title", "author", "date", "last_scraped", "categories", "url",
]


# F12
def reformat_client(df: DataFrame, now=None) -> DataFrame:
    renamed = df.withColumnsRenamed({k: v for k, v in CLIENT_COLUMNS.items() if k in df.columns})
    kept = renamed.select(*[c for c in renamed.columns if c in KEPT_CLIENT_COLUMNS])
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return kept.withColumns({"source": F.lit("CLIENT"), "label_relevance": F.lit(PROBLEM), "last_scraped": stamp})


# F13
def wrangle_irrelevant(df: DataFrame, order) -> DataFrame:
    """Labelled as irrelevant, complete rows with title and content only, blank lines dropped, first row per url."""
    labelled = df.withColumns({"label_relevance": F.lit(IRRELEVANT), "label_service": F.lit(NOT_A_SERVICE)})
    full = labelled.dropna().filter((F.length("content") >= 1) & (F.length("title") >= 1))
    clean = full.withColumn("content", drop_blank_lines(F.col("content")))
    return latest(clean, ["url"], order).select(*[c for c in df.columns if c in IRRELEVANT_COLUMNS],
                                                 *[c for c in ("label_relevance", "label_service") if c not in df.columns])


# U10
def concat_datasets(frames, columns=None, label=None) -> DataFrame:
    """Data sets on top of each other, missing columns null; each must have the label column."""
    out = None
    for i, df in enumerate(frames):
        if label is not None and label not in df.columns:
            raise ValueError(f"data set {i} has no column {label}")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out if columns is None else out.select(*[c for c in columns if c in out.columns])


# U11
def append_taken(taken: DataFrame, new: DataFrame, key="id") -> DataFrame:
    return taken.select(key).union(new.select(key)).distinct()


# U12
def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(line, side, n): lines one side has more often; blank lines do not count.

    Both sides are counted before they meet, so a line repeated many times is one row in the shuffle.
    """
    def counted(df, name):
        return df.filter(F.trim("line") != "").groupBy("line").agg(F.count(F.lit(1)).alias(name))

    both = counted(a, "n_a").join(counted(b, "n_b"), "line", "full_outer").na.fill(0, ["n_a", "n_b"])
    extra = F.col("n_a") - F.col("n_b")
    return both.filter(extra != 0).select(
        "line", F.when(extra > 0, "first").otherwise("second").alias("side"), F.abs(extra).alias("n")
    )


# U13
def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


# U14
def training_frame(df: DataFrame, columns, label: str, labels, seed=42) -> DataFrame:
    """(x, y): text columns joined by newlines and the label's id; duplicates and rows with nulls dropped, shuffled."""
    coded = df.withColumn(label, encode_label(F.col(label), labels)).dropDuplicates()
    kept = coded.select(*columns, label).dropna()
    rows = kept.select(F.concat_ws("\n", *columns).alias("x"), F.col(label).alias("y"))
    return rows.orderBy(F.md5(F.concat("x", F.lit(f":{seed}"))))


# U17
def irrelevant_urls(urls: DataFrame, training: DataFrame, positives: DataFrame, limit=-1, sections=None) -> DataFrame:
    """Urls of irrelevant sections that are in neither set, by url, up to a limit."""
    found = urls.select("url").distinct().filter(is_irrelevant_url(F.col("url"), sections))
    used = training.select("url").unionByName(positives.select("url"))
    fresh = found.join(used, "url", "left_anti").orderBy("url")
    return fresh if limit < 0 else fresh.limit(limit)


# J18
def confirmation_set(positives: DataFrame, training: DataFrame, candidates: DataFrame, store: DataFrame, domains,
                     n=-1, seed=42, sections=None) -> DataFrame:
    """Scraped positives with their label, and irrelevant articles unknown to both, in random order.

    ``positives`` is (url, label), ``candidates`` (url), ``store`` the scraped articles.
    """
    good = split_scrapable(filter_known(positives, training.withColumn("last_scraped", F.lit(None)))
                           .join(positives, "url"), domains).filter("scrapable").drop("scrapable")
    others = irrelevant_urls(candidates, training, good, n, sections)
    positive = attach_labels(store, good)
    negative = store.join(others, "url", "left_semi").withColumn("label", F.lit(IRRELEVANT))
    return positive.unionByName(negative).orderBy(F.md5(F.concat("url", F.lit(f":{seed}"))))
