"""Small helpers on DataFrames: private column names, connected components, positions."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut_lineage


def fresh(df, stem):
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{stem}_{uuid.uuid4().hex[:6]}"
    return name


def is_small(df, rows):
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def with_bound(df, rows):
    """A broadcast hint only after the size of ``df`` was checked; beyond it, the planner joins by shuffle."""
    return F.broadcast(df) if is_small(df, rows) else df


def lookup(df, keyed, key, count, how="inner", hot_share=10_000):
    """``df`` joined with ``keyed``, which has one row per ``key`` and in ``count`` the number of rows of ``df`` with it.

    A key that holds more than one in ``hot_share`` of all rows would make one task too large. There are at most
    ``hot_share`` such keys, so they are sent to all tasks and their rows stay where they are; the rest is shuffled.
    ``count`` is not part of the result; with ``how`` "left", rows of ``df`` without a match are kept. Both are read
    twice, so they should be written tables or cheap.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(keyed.filter(F.col(count) * hot_share > total))
    cold = keyed.filter(F.col(count) * hot_share <= total).drop(count)
    frequent = df.join(hot.drop(count), key)
    rare = df.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return frequent.unionByName(rare)


def _local_forest(batches):
    """Spanning forest of the edges of one partition: (node, least node of its local tree)."""
    import numpy as np
    import pyarrow as pa

    parent = {}

    def root(x):
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                parent.setdefault(min(x, y), min(x, y))
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.array(nodes, dtype=np.int64)), pa.array(np.array([root(x) for x in nodes], dtype=np.int64))],
        ["a", "b"],
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge in (a long, b long); root is the least node of its component.

    Each partition first reduces its edges to a forest; then every node's larger neighbours and, in turn, its smaller
    ones are hung on the least of them until only stars are left. Each round is written as a table, so no round is
    repeated if an executor is lost, and nothing is gathered on the driver.
    """
    edges = edges.filter("a <> b").select("a", "b")
    current = cut_lineage(edges.repartition("a").mapInArrow(_local_forest, "a long, b long"))
    while True:
        both = current.union(current.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        top = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(top, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        current = cut_lineage(small.union(top.select("a", F.col("m").alias("b"))).distinct())
        # Stars: every node hangs on one root, and no root hangs on another node.
        again = current.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
        chained = current.join(current.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        if again.union(chained).isEmpty():
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
