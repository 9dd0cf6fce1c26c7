"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact inner products.

Vectors are scaled to at most unit length and given one more component so that all have length one; the largest inner
product with a query is then the smallest Euclidean distance. A table hashes a vector by ``HASHES`` Gaussian projections
cut into slots of width ``WIDTH``. A query visits buckets in the order of their estimated success: the squared distance
from its projections to the bucket's slots, the least over all tables. How far it goes is fitted: on a bounded sample of
``SAMPLE`` rows the share of all rows is found that has to be visited for the wanted recall.

Rows of a table are packed into chunks by bucket; a bucket with more rows than a chunk spans several. A task gets one
chunk and one block of the queries, multiplies the vectors of each bucket with the queries that visit it, and hands on
only the best of each query. All rows are indexed, and every row of a visited bucket is scored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.langid import draw_of
from spanloom.session import cut_lineage

TABLES = 2
HASHES = 4
WIDTH = 0.8
SLOTS = 5  # slots on either side of 0; the outer ones are open, so a table has at most (2 * SLOTS) ** HASHES buckets
SAMPLE = 8192
SAMPLE_QUERIES = 256
RECALL = 0.955
CHUNK_ROWS = 16384
QUERY_ROWS = 16384


class Index:
    """Projections, occupied buckets with their first chunk and number of chunks, and the share of rows to visit."""

    def __init__(self, dimension, scale, least, seed=7):
        rng = np.random.default_rng(seed)
        self.scale, self.least = scale, least
        self.lines = rng.normal(size=(dimension + 1, TABLES * HASHES))
        self.offsets = rng.uniform(0, WIDTH, size=TABLES * HASHES)
        self.share = 1.0

    def projected(self, vectors, queries=False):
        """Positions on all lines in units of slots."""
        if queries:
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            lifted = np.hstack([unit, np.zeros((len(unit), 1))])
        else:
            small = vectors / self.scale
            rest = np.sqrt(np.maximum(1 - (small**2).sum(axis=1, keepdims=True), 0))
            lifted = np.hstack([small, rest])
        return (lifted @ self.lines + self.offsets) / WIDTH

    def keys(self, vectors):
        """Bucket number per row and table: the slots as digits."""
        slots = np.clip(np.floor(self.projected(vectors)), -SLOTS, SLOTS - 1).astype(np.int64) + SLOTS
        powers = (2 * SLOTS) ** np.arange(HASHES)
        return np.stack([slots[:, t * HASHES : (t + 1) * HASHES] @ powers for t in range(TABLES)], axis=1)

    def costs(self, queries, table, keys):
        """Estimated effort to reach each bucket of a table: squared distance to its slots, one row per query."""
        at = self.projected(queries, queries=True)[:, table * HASHES : (table + 1) * HASHES]
        total = np.zeros((len(queries), len(keys)))
        for j in range(HASHES):
            slot = (keys // (2 * SLOTS) ** j) % (2 * SLOTS) - SLOTS
            low = np.where(slot == -SLOTS, -np.inf, slot)
            high = np.where(slot == SLOTS - 1, np.inf, slot + 1)
            gap = np.maximum(np.maximum(low - at[:, j : j + 1], at[:, j : j + 1] - high), 0)
            total += gap**2
        return total

    def limits(self, queries, buckets):
        """Per query the cost up to which buckets are visited, so that about ``share`` of the rows are.

        ``buckets``: per table (keys, row counts). A row counts once for each table, so the numbers are per table.
        """
        cost = np.hstack([self.costs(queries, t, keys) for t, (keys, _) in enumerate(buckets)])
        rows = np.concatenate([counts for _, counts in buckets])
        order = np.argsort(cost, axis=1, kind="stable")
        upto = np.cumsum(rows[order], axis=1)
        wanted = max(self.share * rows.sum(), min(self.least * TABLES, rows.sum()))
        place = np.minimum((upto < wanted).sum(axis=1), len(rows) - 1)
        return np.take_along_axis(cost, np.take_along_axis(order, place[:, None], 1), 1)[:, 0]


def _matrix(column):
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 1)


def _calibrated(index, sample, neighbours, total):
    """Least share of rows to visit so that the sample's own nearest rows are found with the wanted recall."""
    n = len(sample)
    queries = sample[: min(SAMPLE_QUERIES, n)]
    nearest = max(1, min(n - 1, round(neighbours * n / total)))
    score = queries @ sample.T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    best = np.argpartition(-score, nearest - 1, axis=1)[:, :nearest]
    keys = index.keys(sample)
    buckets, effort = [], []
    for t in range(TABLES):
        names, place, counts = np.unique(keys[:, t], return_inverse=True, return_counts=True)
        buckets.append((names, counts))
        effort.append(index.costs(queries, t, names)[:, place.ravel()])
    needed = np.take_along_axis(np.minimum.reduce(effort), best, 1)
    low, high = 0.0, 1.0
    for _ in range(12):
        index.share = (low + high) / 2
        reached = (needed <= _plain_limits(index, queries, buckets)[:, None]).mean()
        low, high = (low, index.share) if reached >= RECALL else (index.share, high)
    return high


def _plain_limits(index, queries, buckets):
    cost = np.hstack([index.costs(queries, t, keys) for t, (keys, _) in enumerate(buckets)])
    rows = np.concatenate([counts for _, counts in buckets])
    order = np.argsort(cost, axis=1, kind="stable")
    place = np.minimum((np.cumsum(rows[order], axis=1) < index.share * rows.sum()).sum(axis=1), len(rows) - 1)
    return np.take_along_axis(cost, np.take_along_axis(order, place[:, None], 1), 1)[:, 0]


def _keyed(index):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = index.value.keys(_matrix(batch.column("vector")))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id"),
                        batch.column("vector"),
                        pa.array(np.full(batch.num_rows, t, dtype=np.int64)),
                        pa.array(keys[:, t]),
                    ],
                    ["vec_id", "vector", "table", "key"],
                )

    return run


def _packed(buckets, rows_per_chunk):
    """First chunk and number of chunks of every bucket; small buckets share a chunk, in the order given."""
    first, number, chunk, held = [], [], 0, 0
    for _, counts in buckets:
        for c in counts:
            if held and held + c > rows_per_chunk:
                chunk, held = chunk + 1, 0
            need = -(-int(c) // rows_per_chunk)
            first.append(chunk)
            number.append(need)
            if need > 1:
                chunk, held = chunk + need, 0
            else:
                held += c
        chunk, held = chunk + 1, 0  # a chunk belongs to one table
    return np.array(first), np.array(number)


def _directed(plan):
    """One row per query and chunk that holds a bucket which the query visits."""

    def run(batches):
        index, buckets, first, number = plan.value
        chunks = [np.arange(f, f + n) for f, n in zip(first, number)]
        for batch in batches:
            if not batch.num_rows:
                continue
            queries = _matrix(batch.column("vector"))
            for a in range(0, len(queries), 256):
                part = queries[a : a + 256]
                cost = np.hstack([index.costs(part, t, keys) for t, (keys, _) in enumerate(buckets)])
                limit = index.limits(part, buckets)
                rows, to = [], []
                for i in range(len(part)):
                    visited = np.unique(np.concatenate([chunks[b] for b in np.flatnonzero(cost[i] <= limit[i])]))
                    rows.append(np.full(len(visited), a + i))
                    to.append(visited)
                rows, to = np.concatenate(rows), np.concatenate(to)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(to),
                        batch.column("block").take(pa.array(rows)),
                        batch.column("vec_id").take(pa.array(rows)),
                        batch.column("vector").take(pa.array(rows)),
                        pa.array(limit[rows - a]),
                    ],
                    ["chunk", "block", "query_id", "query", "effort"],
                )

    return run


def _scored(plan, k):
    """Best ``k`` rows of each query within one chunk."""

    def run(rows, asked):
        index = plan.value[0]
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                          "score": pa.array([], pa.float64())})
        if not rows.num_rows or not asked.num_rows:
            return empty
        names, vectors = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector"))
        order = np.lexsort((names, rows.column("key").to_numpy()))
        names, vectors, keys = names[order], vectors[order], rows.column("key").to_numpy()[order]
        table = int(rows.column("table")[0].as_py())
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(at, len(keys)))
        numbers, limit = asked.column("query_id").to_numpy(), asked.column("effort").to_numpy()
        queries = _matrix(asked.column("query"))
        by_name = np.argsort(names, kind="stable")
        starts = np.flatnonzero(np.append(True, names[by_name][1:] != names[by_name][:-1]))
        out = [[], [], []]
        step = max(1, (1 << 22) // len(names))
        for a in range(0, len(queries), step):
            part, who = queries[a : a + step], numbers[a : a + step]
            visited = index.costs(part, table, keys[at]) <= limit[a : a + step, None]
            score = part @ vectors.T
            score[~np.repeat(visited, sizes, axis=1)] = -np.inf
            score[who[:, None] == names[None, :]] = -np.inf
            # The place of a row counts only for the best row of its vec_id.
            best = np.maximum.reduceat(score[:, by_name], starts, axis=1) if len(starts) < len(names) else score
            width = min(k, len(starts))
            floor = np.partition(best, len(starts) - width, axis=1)[:, len(starts) - width]
            for i in range(len(part)):
                # Rows within rounding of the last place are scored again in a fixed order of additions.
                near = np.flatnonzero(score[i] >= floor[i] - 1e-9 * (1 + abs(floor[i])) if np.isfinite(floor[i])
                                      else np.isfinite(score[i]))
                exact = (vectors[near] * part[i]).sum(axis=1)
                best = np.lexsort((names[near], -exact))
                keep, seen = [], set()
                for j in best:
                    if names[near[j]] not in seen:
                        seen.add(names[near[j]])
                        keep.append(j)
                        if len(keep) == k:
                            break
                out[0].append(np.full(len(keep), who[i]))
                out[1].append(names[near[keep]])
                out[2].append(exact[keep])
        return pa.table([np.concatenate(x) for x in out], names=["query_id", "vec_id", "score"])

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector): rows with a vec_id and a vector without nulls or non-finite numbers that isn't zero."""
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.filter("vec_id IS NOT NULL").filter(
        vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)
    )
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))


def search(embeddings: DataFrame, is_query, k=20, least_visited=0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which the Column ``is_query`` holds.

    ``embeddings`` has (vec_id, embedding). Nearness is the inner product in double precision, ties go to the smaller
    vec_id, and a row is never its own neighbour. Rows with the same vec_id count as one vector whose score is the best
    of theirs. Vectors that are null, zero, hold a null or non-finite number, or have another length than most take no
    part. Queries with fewer than ``k`` candidates get all of them. A query visits the fitted share of the rows, but at
    least ``least_visited`` rows, and in any case more than ``k``; a number above the table's size gives exact results.
    Further columns are ignored; an empty table gives an
    empty result.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    shapes = rows.groupBy(F.size("vector").alias("d")).agg(
        F.count(F.lit(1)).alias("n"),
        F.approx_count_distinct("vec_id").alias("ids"),
        F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).alias("norm"),
    )
    shape = shapes.orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shape is None or shape["n"] < 2:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("vector") == shape["d"])
    index = Index(shape["d"], shape["norm"], max(least_visited, k + 1))

    drawn = rows.filter(draw_of(F.col("vec_id")) < F.lit(min(1.0, SAMPLE / shape["n"]))).limit(2 * SAMPLE)
    sample = drawn.toPandas().sort_values("vec_id").drop_duplicates("vec_id")["vector"].tolist()  # about SAMPLE rows
    if len(sample) > 1:
        index.share = _calibrated(index, np.array(sample, dtype=np.float64), k, shape["ids"])

    kind = f"vec_id long, vector {rows.schema['vector'].dataType.simpleString()}, table long, key long"
    keyed = cut_lineage(rows.mapInArrow(_keyed(spark.sparkContext.broadcast(index)), kind))
    # At most TABLES * (2 * SLOTS) ** HASHES rows, however large the table is.
    # How far a query goes is counted in vectors, so that copies don't take the place of others.
    counts = keyed.groupBy("table", "key").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("vec_id").alias("ids")
    ).toPandas().sort_values(["table", "key"])
    buckets = [(g["key"].to_numpy(), g["ids"].to_numpy()) for _, g in counts.groupby("table")]
    first, number = _packed([(g["key"].to_numpy(), g["n"].to_numpy()) for _, g in counts.groupby("table")], CHUNK_ROWS)
    plan = spark.sparkContext.broadcast((index, buckets, first, number))

    places = counts.assign(first=first, number=number)[["table", "key", "first", "number"]]
    located = keyed.join(F.broadcast(spark.createDataFrame(places)), ["table", "key"])
    salt = F.pmod(F.xxhash64("vec_id"), F.col("number"))
    located = located.select("vec_id", "vector", "table", "key", (F.col("first") + salt).cast("long").alias("chunk"))

    asked = rows.filter(is_query)
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    kind = f"chunk long, block long, query_id long, query {rows.schema['vector'].dataType.simpleString()}, effort double"
    directed = asked.mapInArrow(_directed(plan), kind)
    spread = located.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = spread.groupBy("chunk", "block").cogroup(directed.groupBy("chunk", "block")).applyInArrow(
        _scored(plan, k), "query_id long, vec_id long, score double"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_search(embeddings: DataFrame, is_query, k=20, queries_at_once=200) -> DataFrame:
    """The true neighbours of at most ``queries_at_once`` queries, to measure recall against: one pass over all rows."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    asked = rows.filter(is_query).orderBy(draw_of(F.col("vec_id"))).limit(queries_at_once).toPandas()
    held = spark.sparkContext.broadcast((asked["vec_id"].to_numpy(), np.array(asked["vector"].tolist(), dtype=np.float64)))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            who, queries = held.value
            names, vectors = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"))
            score = (queries[:, None, :] * vectors[None, :, :]).sum(axis=2) if len(names) < 64 else queries @ vectors.T
            score[who[:, None] == names[None, :]] = -np.inf
            width = min(k, len(names))
            top = np.argpartition(-score, width - 1, axis=1)[:, :width]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(who, width)), pa.array(names[top].ravel()),
                 pa.array(np.take_along_axis(score, top, 1).ravel())],
                ["query_id", "vec_id", "score"],
            ).filter(pa.array(np.isfinite(np.take_along_axis(score, top, 1).ravel())))

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the rows of ``true`` that ``found`` has, too."""
    hits = true.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    return hits.count() / max(1, true.count())
