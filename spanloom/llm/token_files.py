"""Token-ID output: flat unsigned integer files with 64-bit document offsets, in ascending doc_id order.

Documents are dealt out by ranges of doc_id and sorted; each partition writes three files into a folder that all executors
share:

* ``part-NNNNN.bin``: the token ids of its documents one after the other, little-endian, 16 bits wide if the vocabulary
  allows it, else 32,
* ``part-NNNNN.idx``: the 64-bit offset of each document inside that file, and the end,
* ``part-NNNNN.doc``: the 64-bit doc_id of each document (the least 64-bit number for a null).

A table ``manifest`` holds one row per partition with its numbers of documents and tokens; their prefix sums are the
partition bases, so the position of any token in the whole corpus is base + offset. Readers map the files into memory.
Files are written under a name of their attempt and then renamed, so a repeated task leaves whole files.

Encoding is the work of the tokenizers library. A byte-level tokenizer first cuts a text into pieces by a fixed pattern
and never merges across them, so it is enough to hand every distinct piece of a run of texts to the library once; the cut
itself is done on arrays. Texts with characters beyond the scripts listed here, or with a special token's own string, go
to the library whole.
"""

import functools
import os
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import arrays as A
from spanloom.session import cut_lineage, ensure_checkpoint_dir

END_ID = 2
NO_ID = -(1 << 63)
CACHED_PIECES = 1_000_000
TEXTS_AT_ONCE = 1 << 20  # bytes
U = np.uint64

#: Scripts whose characters have had their classes for long: Latin to Cyrillic, general punctuation, currency signs.
_KNOWN_RANGES = ((0x0000, 0x0530), (0x2000, 0x2070), (0x20A0, 0x20C0))
OTHER, LETTER, DIGIT, SPACE, UNKNOWN = 0, 1, 2, 3, 4


@functools.cache
def _classes():
    """Class of every code point below 0x2100 for the piece pattern; UNKNOWN sends the text to the library."""
    table = np.full(0x2101, UNKNOWN, dtype=np.uint8)
    blanks = {*range(9, 14), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}
    for low, high in _KNOWN_RANGES:
        for c in range(low, high):
            kind = unicodedata.category(chr(c))
            if c in blanks:
                table[c] = SPACE
            elif kind != "Cn":
                table[c] = {"L": LETTER, "N": DIGIT}.get(kind[0], OTHER)
    return table


def _piece_starts(points, rows):
    """Marks the first character of every piece.

    Pieces are runs of letters, of digits or of other signs, each with one blank before it if there is one; of a longer
    run of white space the last character stands alone or goes to what follows. The contractions 's 't 're 've 'm 'll 'd
    are pieces of their own where a run of signs begins with the apostrophe.
    ``rows`` are the offsets of the texts in ``points``.
    """
    n = len(points)
    kind = _classes()[np.minimum(points, 0x2100)]
    first = np.zeros(n + 1, dtype=bool)
    first[rows] = True
    starts = first[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last_space = space.copy()
    last_space[:-1] &= ~space[1:] & ~first[1:n]
    last_space[-1:] = False
    starts |= last_space  # before a word, the last one of several blanks is cut off ...
    joins = np.zeros(n, dtype=bool)
    joins[1:] = last_space[:-1] & (points[:-1] == 32)
    starts &= ~joins  # ... and goes to the word if it is a plain blank
    quote = np.flatnonzero((points == 39) & starts)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    if len(quote):
        padded = np.append(points, [0, 0])
        one, two = padded[quote + 1], np.where(first[np.minimum(quote + 2, n)], 0, padded[quote + 2])
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        starts[quote[single | double] + 1] = False
        for hits, length in ((quote[single], 2), (quote[double & ~single], 3)):
            ends = hits + length
            starts[ends[ends < n]] = True
            middle = hits + 2
            if length == 3:
                starts[middle] = False
    return starts


class Encoder:
    """Token ids of texts, equal to the library's own for whole texts."""

    def __init__(self, definition, cached=CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        import json

        self.tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        cut = parts.get("pre_tokenizer") or {}
        self.by_pieces = (
            cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
            and not parts.get("normalizer")
            and not parts.get("truncation")
            and parts["model"].get("type") == "BPE"
            and not parts["model"].get("dropout")
        )
        self.added = [t["content"] for t in parts.get("added_tokens", [])]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.cached = cached
        self._forget()

    def _forget(self):
        self.names = np.zeros(0, dtype=U)
        self.begin, self.count = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(0, dtype=np.uint32)

    def whole(self, text):
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, names, pieces):
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.array([len(x) for x in found], dtype=np.int64)
        begin = (len(self.ids) + np.cumsum(count) - count).astype(np.int32)
        count = count.astype(np.int32)
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(count.sum()))])
        at = np.searchsorted(self.names, names)
        self.names = np.insert(self.names, at, names)
        self.begin, self.count = np.insert(self.begin, at, begin), np.insert(self.count, at, count)

    def many(self, texts):
        """(ids, number of ids of each text) of a run of texts."""
        special = [i for i, t in enumerate(texts) if not self.by_pieces or any(a in t for a in self.added)]
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        rows = np.concatenate([[0], np.cumsum(lengths)])
        if not len(points):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        strange = _classes()[np.minimum(points, 0x2100)] == UNKNOWN
        if special or strange.any():
            odd = np.zeros(len(texts), dtype=bool)
            odd[special] = True
            odd[np.searchsorted(rows, np.flatnonzero(strange), "right") - 1] = True
            plain, counts = self.many([t for t, o in zip(texts, odd) if not o])
            ends = iter(np.split(plain, np.cumsum(counts)[:-1]) if len(counts) else [])
            parts = [self.whole(t) if o else next(ends) for t, o in zip(texts, odd)]
            return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)

        starts = np.flatnonzero(_piece_starts(points, rows))
        ends = np.append(starts[1:], len(points))
        names, example, which = np.unique(A.span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.names, names), max(len(self.names) - 1, 0))
        new = self.names[at] != names if len(self.names) else np.ones(len(names), dtype=bool)
        before = self.names, self.begin, self.count, self.ids
        if new.any():
            self._learn(names[new], [joined[starts[i] : ends[i]] for i in example[new]])
        at = np.searchsorted(self.names, names)[which]
        count = self.count[at].astype(np.int64)
        total = np.cumsum(count)
        ids = self.ids[np.repeat(self.begin[at] - (total - count), count) + np.arange(total[-1])]
        if len(self.names) > self.cached:  # full: the pieces met first, the frequent ones among them, stay
            self.names, self.begin, self.count, self.ids = before
        upto = np.concatenate([[0], total])[np.searchsorted(starts, rows)]
        return ids, np.diff(upto)


@functools.lru_cache(maxsize=1)
def _encoder(definition):
    """The encoder of a worker process: its later tasks go on with the pieces that earlier ones have met."""
    return Encoder(definition)


def _open(folder):
    """(file system, path) of a folder given as a URI or a plain path."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace(":", "://", 1))


def _writer(folder, definition, end_id):
    def run(batches):
        encoder = _encoder(definition.value)
        kind = np.dtype("<u4" if encoder.wide else "<u2")
        number = TaskContext.get().partitionId()
        fs, root = _open(folder)
        attempt = uuid.uuid4().hex
        names = {x: f"{root}/part-{number:05d}.{x}" for x in ("bin", "idx", "doc")}
        files = {x: fs.open_output_stream(f"{path}.{attempt}") for x, path in names.items()}
        documents, tokens = 0, 0
        files["idx"].write(np.zeros(1, dtype="<i8").tobytes())
        for batch in batches:
            numbers = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)
            text = pc.fill_null(batch.column("text"), "")
            sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            first = 0
            while first < len(sizes):
                last = max(int(np.searchsorted(upto, upto[first] + TEXTS_AT_ONCE, "right")) - 1, first + 1)
                ids, counts = encoder.many(text.slice(first, last - first).to_pylist())
                ends = np.cumsum(counts)
                ids = np.insert(ids.astype(kind), ends, kind.type(end_id))
                files["bin"].write(ids.tobytes())
                files["idx"].write((tokens + ends + np.arange(1, len(ends) + 1)).astype("<i8").tobytes())
                files["doc"].write(numbers[first:last].astype("<i8").tobytes())
                documents, tokens = documents + last - first, tokens + len(ids)
                first = last
        for x, path in names.items():
            files[x].close()
            fs.move(f"{path}.{attempt}", path)
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int64()) for v in (number, documents, tokens, kind.itemsize)],
            ["part", "documents", "tokens", "width"],
        )

    return A.lean(run)


def write_token_files(documents: DataFrame, definition: str, folder: str = None, end_id=END_ID) -> str:
    """Write the token files of ``documents`` (doc_id, text) and their manifest; returns the folder.

    ``definition`` is the JSON text of a tokenizer. Every document gets ``end_id`` after its tokens. Order: doc_id (null
    first), then a hash of the text; repeated rows are written as often as they occur, a null text counts as empty. Further columns are
    ignored; an empty table gives files without documents. Without ``folder``, a new one in the shared checkpoint folder
    is taken.
    """
    spark = documents.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range bounds go through the driver, so repeated ids are told apart by a hash and not by their texts.
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(parts, F.col("doc_id"), tie) if parts > 1 else rows.coalesce(1)
    written = ordered.sortWithinPartitions(F.col("doc_id"), tie, F.col("text")).mapInArrow(
        _writer(folder, spark.sparkContext.broadcast(definition), end_id),
        "part long, documents long, tokens long, width long",
    )
    written.write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark, folder: str) -> DataFrame:
    """(part, documents, tokens, width, base, first_document): one row per partition, bases by prefix sums."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema("part long, documents long, tokens long, width long").parquet(f"{folder}/manifest")
    return rows.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn(
        "first_document", F.coalesce(F.sum("documents").over(before), F.lit(0))
    )


def mapped(folder, part, width):
    """(ids, offsets, doc_ids) of one partition's files: memory-mapped if the folder is mounted, else read."""
    fs, root = _open(folder)
    out = []
    for x, kind in (("bin", f"<u{width}"), ("idx", "<i8"), ("doc", "<i8")):
        path = f"{root}/part-{part:05d}.{x}"
        if isinstance(fs, pafs.LocalFileSystem):
            empty = os.path.getsize(path) == 0
            out.append(np.zeros(0, dtype=kind) if empty else np.memmap(path, dtype=kind, mode="r"))
        else:
            with fs.open_input_file(path) as file:
                out.append(np.frombuffer(file.read(), dtype=kind))
    return out


def _reader(folder):
    def run(batches):
        for batch in batches:
            for part, width, base in zip(*(batch.column(c).to_pylist() for c in ("part", "width", "base"))):
                ids, offsets, numbers = mapped(folder, part, width)
                for a in range(0, len(numbers), 4096):
                    b = min(a + 4096, len(numbers))
                    checks = [
                        zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(a, b)
                    ]
                    doc = np.array(numbers[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc, mask=doc == NO_ID),
                            pa.array(np.array(offsets[a:b]) + base),
                            pa.array(np.diff(offsets[a : b + 1])),
                            pa.array(checks, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_token_files(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    start counts all ids before the document's first one, n_tokens includes the end id, and ids_crc32 is the CRC-32 of
    all its ids as little-endian unsigned 32-bit integers.
    """
    parts = cut_lineage(manifest(spark, folder).filter("documents > 0").select("part", "width", "base"))
    spread = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    return spread.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
