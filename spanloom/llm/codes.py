"""Product codes of vectors, assigned by slice-and-intersect bitmasks.

Each part of a vector is replaced by the number of its nearest codebook entry. For every dimension the entries'
coordinates are sorted, and position k of that order carries a bit mask of the first k entries. A radius around a
coordinate is a range of positions; two prefix masks, one exclusive-or, give the entries in the range, and the AND of
the masks of all dimensions gives exactly the entries inside the box. With the distance to any entry as the radius, the
box holds the nearest entry, so only the entries left in the mask are measured. All arithmetic is on integers.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import arrays as A
from spanloom.llm import vectors as V
from spanloom.llm.tables import lookup
from spanloom.session import cut_lineage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
NEIGHBOURS = 8  # entries next to a point on the widest dimension that give it its first radius
BLOCK = 512


def root(squares):
    """Largest integers whose squares are at most ``squares``."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


class Slices:
    """Entries of one codebook (entry, position) with sorted coordinates and prefix masks per dimension."""

    def __init__(self, entries):
        self.entries = entries
        count, width = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.order = order.T
        self.coordinates = np.ascontiguousarray(np.take_along_axis(entries, order, 0).T)
        self.prefix = np.zeros((width, count + 1, (count + 63) // 64), dtype=np.uint64)
        for k in range(count):
            self.prefix[:, k + 1] = self.prefix[:, k]
            e = self.order[:, k]
            self.prefix[np.arange(width), k + 1, e // 64] |= np.uint64(1) << (e % 64).astype(np.uint64)
        self.widest = int(np.argmax(np.ptp(entries, axis=0))) if width else 0

    def first_bound(self, points):
        """Squared distance of each point to the nearest of a few entries next to it on the widest dimension."""
        count = len(self.entries)
        place = np.searchsorted(self.coordinates[self.widest], points[:, self.widest])
        place = np.clip(place[:, None] + np.arange(NEIGHBOURS) - NEIGHBOURS // 2, 0, count - 1)
        gap = self.entries[self.order[self.widest][place]] - points[:, None, :]
        return np.einsum("ijk,ijk->ij", gap, gap).min(axis=1)

    def candidates(self, points, radius):
        """(point, entry) of all entries that differ from a point by at most its radius in every dimension, sorted."""
        words = self.prefix.shape[2]
        mask = np.full((len(points), words), ~np.uint64(0))
        for d, line in enumerate(self.coordinates):
            low = np.searchsorted(line, points[:, d] - radius, "left")
            high = np.searchsorted(line, points[:, d] + radius, "right")
            mask &= self.prefix[d, high] ^ self.prefix[d, low]
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(bits[:, : len(self.entries)])

    def nearest(self, points):
        """Number of the nearest entry, ties to the lower one, and its squared distance, for each row of points."""
        if not self.entries.shape[1]:
            return np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=np.int64)
        point, entry = self.candidates(points, root(self.first_bound(points)))
        gap = points[point] - self.entries[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        least = np.minimum.reduceat(distance, np.searchsorted(point, np.arange(len(points))))
        hit = np.flatnonzero(distance == least[point])
        _, first = np.unique(point[hit], return_index=True)
        return entry[hit[first]], least


def _assigned(batch, books, width):
    """Blocks of (first row, last row, per part the points, entry numbers and squared distances)."""
    for a in range(0, len(batch), BLOCK):
        piece = batch.slice(a, BLOCK)
        values = V.matrix(piece.column("values"), width * len(books))
        out = []
        for p, book in enumerate(books):
            points = values[:, p * width : (p + 1) * width]
            out.append((points, *book.nearest(points)))
        yield a, a + len(piece), out


def _summed(book):
    def run(batches):
        books = [Slices(b) for b in book]
        totals = V.Totals(*book.shape)
        for batch in batches:
            for _, _, found in _assigned(batch, books, book.shape[2]):
                for p, (points, entry, _) in enumerate(found):
                    totals.add(p, entry, points)
        yield totals.batch()

    return A.lean(run)


def _coded(book):
    def run(batches):
        books = [Slices(b) for b in book]
        size = 2 * len(books)
        for batch in batches:
            code, error = [], np.zeros(len(batch), dtype=np.int64)
            for a, b, found in _assigned(batch, books, book.shape[2]):
                digits = np.stack([entry for _, entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                code += [digits[i : i + size] for i in range(0, len(digits), size)]
                error[a:b] = sum(distance for _, _, distance in found)
            columns = [batch.column("vec_id"), batch.column("key"), pa.array(code, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "key", "code", "error"])

    return A.lean(run)


def _learned(vectors, parts, entries, rounds, scale):
    """(table vec_id, key, values; codebooks), or (table, None) if no vector is left."""
    vector = F.col("embedding")
    kept = vectors.filter(V.finite(vector)).select("vec_id", F.to_json(F.struct("label")).alias("key"), vector)
    common = kept.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return kept, None
    if common["size"] % parts:
        raise ValueError(f"vectors of {common['size']} components can't be cut into {parts} equal parts")
    width = common["size"] // parts
    kept = kept.filter(F.size("embedding") == common["size"])
    kept = cut_lineage(kept.select("vec_id", "key", V.scaled(vector, scale).alias("values")))
    V.check_magnitude(kept, "values", width)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "values").limit(entries).collect()
    book = np.array([r["values"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    book = np.ascontiguousarray(book)
    for _ in range(rounds):
        book = V.moved(kept.select("values").mapInArrow(_summed(book), V.sums_schema(width)), book)
    return kept, book


def codebooks_digest(book):
    """Hex sha256 of all components as decimal integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for x in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector of ``vectors`` (vec_id, embedding, label).

    Components count as floor(scale * x); a vector is cut into ``parts`` equal consecutive parts. A part's codebook starts
    as that part of the vectors with the ``entries`` (at most 256) least vec_ids; each of ``rounds`` rounds assigns all
    parts and moves every used entry to the floored mean of its parts. ``code`` has two hex digits for each part's
    nearest entry, ``error`` is the sum of its squared distances and ``label_error`` that sum over all rows of a label.

    Vectors that are null or hold null or non-finite components take no part, nor do those of another length than the
    most frequent one (of two, the shorter). Every row is a vector of its own, so repeated rows and vec_ids count as often
    as they occur; equal vec_ids are ordered by their components, and null ones come last. Rows with a null label are one
    label. An empty table, or one without vectors, gives an empty result; fewer rows than entries give smaller codebooks.
    Further columns are ignored. Components too large for exact 64-bit distances, or a length that ``parts`` does not
    divide, raise a ValueError.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries: a code has two hex digits for each part")
    kept, book = _learned(vectors.select("vec_id", "embedding", "label"), parts, entries, rounds, scale)
    kind = vectors.select("vec_id").schema["vec_id"].dataType.simpleString()
    if book is None:
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string"
        )
    coded = cut_lineage(kept.mapInArrow(_coded(book), f"vec_id {kind}, key string, code string, error long"))
    per_label = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return lookup(coded, per_label, "key", "n").select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(book)).alias("codebooks_sha256")
    )
