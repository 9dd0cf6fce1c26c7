"""Centroid clustering on integers, pruned by Ptolemaic pivots.

For points x, c and pivots p, s Ptolemy's inequality says d(x, c) d(p, s) >= |d(x, p) d(c, s) - d(x, s) d(c, p)|. The
distances of all vectors to a few fixed pivots are written once beside the vectors; a round only measures its centroids
against the pivots, and every pivot pair gives a lower bound for every vector and centroid. Bounds are rounded down by
more than floating-point arithmetic can be off. The centroid with the least bound is measured exactly; what its distance
does not rule out is measured exactly too, in integers, so the result is that of measuring everything.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import arrays as A
from spanloom.llm import vectors as V
from spanloom.session import cut_lineage

CENTROIDS = 40
ROUNDS = 5
SCALE = 256
COMPONENTS = 64
SEED = 2
PIVOTS = 4
SLACK = 1e-12  # far above the rounding errors of the few operations in a bound
BLOCK = 1024


def squared(points, others):
    """Exact squared distances (point, other)."""
    out = np.empty((len(points), len(others)), dtype=np.int64)
    for j, other in enumerate(others):
        gap = points - other
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def choose_pivots(points, count):
    """Up to ``count`` different points: the first one, then always the farthest from those chosen."""
    chosen = [0]
    gap = squared(points, points[:1])[:, 0]
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, squared(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


class Bounds:
    """Lower bounds of the distances between vectors and centroids from their distances to the pivots."""

    def __init__(self, pivots, centroids):
        self.pairs = [(i, j) for i in range(len(pivots)) for j in range(i)]
        self.between = np.sqrt(squared(pivots, pivots).astype(np.float64))
        self.near = np.sqrt(squared(centroids, pivots).astype(np.float64))

    def least(self, cached):
        """(vector, centroid) bounds; ``cached`` has the squared pivot distances of the vectors."""
        far = np.sqrt(cached.astype(np.float64))
        out = np.zeros((len(cached), len(self.near)))
        for p, s in self.pairs:
            one = far[:, p : p + 1] * self.near[:, s]
            two = far[:, s : s + 1] * self.near[:, p]
            sure = np.abs(one - two) - SLACK * (one + two)
            np.maximum(out, sure * ((1 - SLACK) / self.between[p, s]), out=out)
        return out


def nearest(points, cached, centroids, bounds):
    """Nearest centroid of each point, ties to the smaller number, its squared distance, and the pairs measured."""
    least = bounds.least(cached)
    gap = points - centroids[np.argmin(least, axis=1)]
    reach = np.einsum("ij,ij->i", gap, gap)
    row, centroid = np.nonzero(least * least * (1 - SLACK) <= reach[:, None] * (1 + SLACK))
    gap = points[row] - centroids[centroid]
    distance = np.einsum("ij,ij->i", gap, gap)
    best = np.minimum.reduceat(distance, np.searchsorted(row, np.arange(len(points))))
    hit = np.flatnonzero(distance == best[row])
    _, first = np.unique(row[hit], return_index=True)
    return centroid[hit[first]], best, len(row)


def _cached(pivots, width):
    def run(batches):
        for batch in batches:
            lists = []
            for a in range(0, len(batch), BLOCK):
                lists.append(squared(V.matrix(batch.column("values").slice(a, BLOCK), width), pivots))
            flat = np.concatenate(lists).ravel() if lists else np.zeros(0, dtype=np.int64)
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(pivots))
            column = pa.ListArray.from_arrays(offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "cached"])

    return A.lean(run)


def _assigned(batch, pivots, centroids, bounds):
    for a in range(0, len(batch), BLOCK):
        piece = batch.slice(a, BLOCK)
        points = V.matrix(piece.column("values"), centroids.shape[1])
        cached = V.matrix(piece.column("cached"), len(pivots))
        yield a, a + len(piece), points, *nearest(points, cached, centroids, bounds)[:2]


def _summed(pivots, centroids):
    def run(batches):
        bounds = Bounds(pivots, centroids)
        totals = V.Totals(1, *centroids.shape)
        for batch in batches:
            for _, _, points, centroid, _ in _assigned(batch, pivots, centroids, bounds):
                totals.add(0, centroid, points)
        yield totals.batch()

    return A.lean(run)


def _labelled(pivots, centroids):
    def run(batches):
        bounds = Bounds(pivots, centroids)
        for batch in batches:
            cluster, distance = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch), dtype=np.int64)
            for a, b, _, found, gap in _assigned(batch, pivots, centroids, bounds):
                cluster[a:b], distance[a:b] = found, gap
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    return A.lean(run)


def cluster(
    vectors: DataFrame, count=CENTROIDS, rounds=ROUNDS, scale=SCALE, components=COMPONENTS, seed=SEED, pivots=PIVOTS
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of ``vectors`` (vec_id, embedding).

    Components count as floor(scale * x). The first centroids are the ``count`` vectors with the least hex sha256 of
    ``seed:vec_id``; each of ``rounds`` rounds assigns all vectors to their nearest centroid (squared distance, ties to the
    smaller number) and moves every centroid that has vectors to their floored mean; then all are assigned once more.

    Only vectors of exactly ``components`` components, none null or non-finite, take part. Every row is a vector of its
    own, so repeated rows and vec_ids count as often as they occur; equal vec_ids are ordered by their components, and
    null ones come last as first centroids. Fewer rows than ``count`` give fewer centroids; an empty table, or one
    without such vectors, gives an empty result. Further columns are ignored. Components too large for exact 64-bit
    distances raise a ValueError.
    """
    spark = vectors.sparkSession
    kind = vectors.select("vec_id").schema["vec_id"].dataType.simpleString()
    vector = F.col("embedding")
    kept = vectors.filter(V.finite(vector) & (F.size(vector) == components))
    kept = kept.select("vec_id", V.scaled(vector, scale).alias("values"))
    V.check_magnitude(kept, "values", components)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(F.asc_nulls_last(draw), "values").limit(count).collect()
    if not first:
        return spark.createDataFrame(
            [],
            f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string",
        )
    centroids = np.array([r["values"] for r in first], dtype=np.int64).reshape(len(first), components)
    fixed = choose_pivots(centroids, pivots)
    table = cut_lineage(
        kept.mapInArrow(_cached(fixed, components), f"vec_id {kind}, values array<long>, cached array<long>")
    )
    for _ in range(rounds):
        partial = table.select("values", "cached").mapInArrow(_summed(fixed, centroids), V.sums_schema(components))
        centroids = V.moved(partial, centroids[None])[0]
    found = cut_lineage(
        table.mapInArrow(_labelled(fixed, centroids), f"vec_id {kind}, cluster int, distance long")
    )
    # One row per centroid from here on.
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [
        (number, sums.get(number, 0), sum(sums.values()),
         hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest())
        for number, centroid in enumerate(centroids)
    ]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
