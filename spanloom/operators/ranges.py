"""Offset joins and running totals that stay parallel when one document is huge.

A plain window over a document, or a join on the document id alone, sends the whole document to one task. The helpers
here cut the offset axis into chunks first, so that the unit of work is (document, chunk).
"""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from spanloom.session import cut_lineage

DEFAULT_BUCKET = 1024
DEFAULT_CHUNK = 65536


def bucket_of(offset: Column, width: int) -> Column:
    return F.floor(offset / F.lit(width)).cast("long")


def bucket_range(start: Column, end: Column, width: int) -> Column:
    """Every bucket that [start, end) touches; an empty span touches the bucket of its start."""
    return F.sequence(bucket_of(start, width), bucket_of(F.greatest(end - 1, start), width))


def points_in_intervals(points, intervals, keys, point, start, end, bucket=DEFAULT_BUCKET, how="inner"):
    """Join each row of ``points`` with the intervals where start <= point < end, within ``keys``.

    A point lies in one bucket and an interval is repeated once per bucket it touches, so each match is found once.
    """
    left = points.withColumn("_bucket", bucket_of(F.col(point), bucket))
    right = intervals.filter(F.col(end) > F.col(start)).withColumn(
        "_bucket", F.explode(bucket_range(F.col(start), F.col(end), bucket))
    )
    left, right = left.alias("p"), right.alias("i")
    same = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*keys, "_bucket"]]
    inside = (F.col(f"p.{point}") >= F.col(f"i.{start}")) & (F.col(f"p.{point}") < F.col(f"i.{end}"))
    joined = left.join(right, [*same, inside], how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bucket")
    kept = [F.col(f"p.{c}") for c in points.columns]
    kept += [F.col(f"i.{c}") for c in intervals.columns if c not in points.columns]
    return joined.select(*kept)


def overlapping_pairs(left, right, keys, start="start", end="end", bucket=DEFAULT_BUCKET, suffixes=("_a", "_b")):
    """Pairs of spans that share at least one character, within ``keys``.

    Both sides are repeated per touched bucket; a pair is kept only in the first bucket the two have in common, so no
    distinct is needed. Columns other than the keys get the suffixes.
    """
    a_sfx, b_sfx = suffixes

    def spread(df, suffix):
        df = df.select(*keys, *[F.col(c).alias(c + suffix) for c in df.columns if c not in keys])
        first = bucket_of(F.col(start + suffix), bucket)
        return df.withColumn("_first" + suffix, first).withColumn(
            "_bucket", F.explode(bucket_range(F.col(start + suffix), F.col(end + suffix), bucket))
        )

    pairs = spread(left, a_sfx).join(spread(right, b_sfx), [*keys, "_bucket"])
    return pairs.filter(
        (F.col(start + b_sfx) < F.col(end + a_sfx))
        & (F.col(end + b_sfx) > F.col(start + a_sfx))
        & (F.col("_bucket") == F.greatest("_first" + a_sfx, "_first" + b_sfx))
    ).drop("_bucket", "_first" + a_sfx, "_first" + b_sfx)


def covered_by(inner, outer, keys, start="start", end="end", condition=None, how="left_semi", bucket=DEFAULT_BUCKET):
    """Rows of ``inner`` that do (semi) or do not (anti) lie inside a row of ``outer``.

    The inner span is looked up by the bucket of its start only: any span covering it also covers that bucket.
    ``condition`` may add a test over the aliases ``inner`` and ``outer``.
    """
    left = inner.withColumn("_bucket", bucket_of(F.col(start), bucket)).alias("inner")
    right = outer.withColumn("_bucket", F.explode(bucket_range(F.col(start), F.col(end), bucket))).alias("outer")
    on = [F.col(f"inner.{k}") == F.col(f"outer.{k}") for k in [*keys, "_bucket"]]
    on.append(F.col(f"outer.{start}") <= F.col(f"inner.{start}"))
    on.append(F.col(f"outer.{end}") >= F.col(f"inner.{end}"))
    if condition is not None:
        on.append(condition)
    return left.join(right, on, how).drop("_bucket")


def covers(outer, inner, keys, start="start", end="end", condition=None, how="left_semi", bucket=DEFAULT_BUCKET):
    """Rows of ``outer`` that do (semi) or do not (anti) hold a row of ``inner``.

    The outer row is repeated per touched bucket, so the kept row keys are found first and joined back once.
    """
    row_id = [*keys, "ann_id"]
    spread = outer.select(*row_id, start, end, *[c for c in outer.columns if c not in [*row_id, start, end]])
    spread = spread.withColumn("_bucket", F.explode(bucket_range(F.col(start), F.col(end), bucket))).alias("outer")
    small = inner.withColumn("_bucket", bucket_of(F.col(start), bucket)).alias("inner")
    on = [F.col(f"inner.{k}") == F.col(f"outer.{k}") for k in [*keys, "_bucket"]]
    on.append(F.col(f"outer.{start}") <= F.col(f"inner.{start}"))
    on.append(F.col(f"outer.{end}") >= F.col(f"inner.{end}"))
    if condition is not None:
        on.append(condition)
    found = spread.join(small, on, "left_semi").select(*row_id).distinct()
    return outer.join(found, row_id, how)


def running_total(df, keys, order, value, out, chunk=DEFAULT_CHUNK, tie=()):
    """Exclusive running sum of ``value`` in the order of the integer column ``order`` within ``keys``.

    Two steps: totals per (keys, chunk of the order axis), then rows within a chunk. A document with most of the rows is
    therefore spread over its chunks.
    """
    with_chunk = df.withColumn("_chunk", bucket_of(F.col(order), chunk))
    totals = with_chunk.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = (
        Window.partitionBy(*keys, "_chunk").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = with_chunk.join(base, [*keys, "_chunk"])
    total = F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))
    return joined.withColumn(out, total.cast("long")).drop("_chunk", "_base")


def row_numbers(df, keys, order, out, chunk=DEFAULT_CHUNK, tie=()):
    """1-based row number within ``keys`` by ``order`` (then ``tie``), chunked like :func:`running_total`."""
    counted = running_total(df.withColumn("_one", F.lit(1)), keys, order, "_one", out, chunk, tie)
    return counted.withColumn(out, F.col(out) + 1).drop("_one")


def previous_row(df, keys, order, columns, prefix="prev_", chunk=DEFAULT_CHUNK):
    """Values of ``columns`` in the row at ``order`` - 1 (``order`` dense within ``keys``), without one task per key.

    The last row of each chunk is also sent to the next chunk as context and dropped after the lag.
    """
    chunk_no = bucket_of(F.col(order), chunk)
    homes = F.when(
        F.col(order) % F.lit(chunk) == F.lit(chunk - 1), F.array(chunk_no, chunk_no + 1)
    ).otherwise(F.array(chunk_no))
    spread = df.withColumn("_home", F.explode(homes))
    window = Window.partitionBy(*keys, "_home").orderBy(order)
    for column in columns:
        spread = spread.withColumn(prefix + column, F.lag(column).over(window))
    return spread.filter(F.col("_home") == chunk_no).drop("_home")


def last_before(df, keys, order, value, out, chunk=DEFAULT_CHUNK):
    """Adds the last non-null ``value`` among the rows strictly before each row, without one task per key.

    The last value of each chunk is carried over to the following chunks on a table of one row per chunk.
    """
    with_chunk = df.withColumn("_chunk", bucket_of(F.col(order), chunk))
    place = F.when(F.col(value).isNotNull(), F.col(order))
    ends = with_chunk.groupBy(*keys, "_chunk").agg(F.max_by(value, place).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_chunk", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    within = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = with_chunk.join(carried, [*keys, "_chunk"])
    found = F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("_carried"))
    return joined.withColumn(out, found).drop("_chunk", "_carried")


class Chunks:
    """Running values of one table in one shuffle: all windows share the chunks of the order column.

    ``df`` is the table with its chunk as a column, which must stay until the last step. Only keys with rows in several
    chunks need anything carried over. These are looked for once; if there are none, nothing is read twice.
    """

    def __init__(self, df, keys, order, chunk=DEFAULT_CHUNK):
        self.keys, self.order = list(keys), order
        self.df = df.withColumn("_chunk", bucket_of(F.col(order), chunk))
        ends = self.df.groupBy(*keys).agg(F.min("_chunk").alias("_low"), F.max("_chunk").alias("_high"))
        self.long = cut_lineage(ends.filter("_low < _high").select(*keys))
        if self.long.isEmpty():
            self.long = None

    def _window(self):
        # Without keys in several chunks, what is grouped by more than the keys later needs no shuffle of its own.
        return Window.partitionBy(*self.keys, *([] if self.long is None else ["_chunk"])).orderBy(self.order)

    def _carried(self, df, per_chunk, before):
        """One row per chunk of the keys that have several: what comes from the chunks before it."""
        earlier = Window.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        ends = df.join(self.long, self.keys, "left_semi").groupBy(*self.keys, "_chunk").agg(per_chunk.alias("_end"))
        return cut_lineage(ends.select(*self.keys, "_chunk", before(F.col("_end")).over(earlier).alias("_base")))

    def _based(self, df, base):
        return df.join(base, [*self.keys, "_chunk"], "left")

    def based(self, rows, df, per_chunk, before, out):
        """``rows`` (one per chunk) with what comes from the chunks before theirs, taken from the rows of ``df``."""
        return self._based(rows, self._carried(df, per_chunk, before)).withColumnRenamed("_base", out)

    def total(self, df, value, out):
        """Exclusive running sum of ``value``."""
        passed = F.sum(value).over(self._window().rowsBetween(Window.unboundedPreceding, -1))
        made = df.withColumn(out, F.coalesce(passed, F.lit(0)).cast("long"))
        if self.long is None:
            return made
        base = self._carried(df, F.sum(value), F.sum)
        return self._based(made, base).withColumn(out, F.col(out) + F.coalesce("_base", F.lit(0))).drop("_base")

    def highest(self, df, value, out):
        """The largest ``value`` up to and including each row; nulls are passed over."""
        made = df.withColumn(out, F.max(value).over(self._window().rowsBetween(Window.unboundedPreceding, 0)))
        if self.long is None:
            return made
        base = self._carried(df, F.max(value), F.max)
        return self._based(made, base).withColumn(out, F.greatest(F.col(out), F.col("_base"))).drop("_base")

    def since(self, df, total, restart, out):
        """A total that never falls, counted anew from each row where ``restart`` holds."""
        made = self.highest(df.withColumn("_mark", F.when(restart, F.col(total))), "_mark", "_from")
        return made.withColumn(out, F.col(total) - F.coalesce("_from", F.lit(0))).drop("_mark", "_from")

    def previous(self, df, columns, prefix="prev_"):
        """Values of ``columns`` in the row before, whose place need not be the one just before."""
        values = F.struct(*[F.col(c).alias(c) for c in columns])
        made = df.withColumn("_prev", F.lag(values).over(self._window()))
        if self.long is not None:
            base = self._carried(df, F.max_by(values, F.col(self.order)), lambda end: F.last(end, ignorenulls=True))
            made = self._based(made, base).withColumn("_prev", F.coalesce("_prev", "_base")).drop("_base")
        return made.withColumns({prefix + c: F.col(f"_prev.{c}") for c in columns}).drop("_prev")
