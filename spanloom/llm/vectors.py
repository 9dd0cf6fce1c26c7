"""Vectors as exact integers: what the code and cluster operators share."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def finite(column):
    """Whether a vector is there and holds neither null nor a non-finite component."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return column.isNotNull() & ~bad


def scaled(column, factor):
    """Components as integers floor(factor * x), x as double."""
    return F.transform(column, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))


def check_magnitude(df, column, width):
    """Raises if squared distances over ``width`` components of ``column`` (array<long>) could leave 64 bits."""
    most = df.select(F.max(F.array_max(F.transform(column, F.abs))).alias("most")).first()["most"]
    if most is not None and max(width, 1) * (2 * most + 1) ** 2 >= 1 << 63:
        raise ValueError(f"components as large as {most} have no exact squared distance in 64 bits")


def matrix(column, width):
    """Rows of a list column of integers as an int64 matrix of ``width`` columns."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.int64).reshape(len(column), width)


def sums_schema(width):
    return ", ".join(["part int", "entry int", "n long"] + [f"s{i} long" for i in range(width)])


class Totals:
    """Running componentwise sums and counts of the members of each entry of each part, for one task."""

    def __init__(self, parts, entries, width):
        self.count = np.zeros((parts, entries), dtype=np.int64)
        self.total = np.zeros((parts, entries, width), dtype=np.int64)

    def add(self, part, entry, values):
        order = np.argsort(entry, kind="stable")
        entry = entry[order]
        at = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
        if self.total.shape[2]:
            self.total[part, entry[at]] += np.add.reduceat(values[order], at, axis=0)
        self.count[part, entry[at]] += np.diff(np.append(at, len(entry)))

    def batch(self):
        part, entry = np.nonzero(self.count)
        columns = [part.astype(np.int32), entry.astype(np.int32), self.count[part, entry]]
        columns += list(self.total[part, entry].T)
        names = ["part", "entry", "n"] + [f"s{i}" for i in range(self.total.shape[2])]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)


def moved(partial, book):
    """``book`` (part, entry, position) with every entry that has members replaced by their floored mean.

    ``partial`` has one row per task, part and entry; only one row per part and entry reaches the driver.
    """
    width = book.shape[2]
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]
    out = book.copy()
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        total = np.array([row[f"s{i}"] for i in range(width)], dtype=np.int64)
        out[row["part"], row["entry"]] = total // row["n"]
    return out
