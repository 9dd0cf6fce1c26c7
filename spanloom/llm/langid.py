"""Language identification with a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, kernel ridge.

k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G(x) is the set of byte n-grams of orders 1 to 3 of the whole text
(A-Z lower-cased, everything but letters is a blank), hashed into ``BINS`` bins. Landmarks are training texts; a text's
kernel values with them, times the inverse root of the landmarks' own kernel matrix, are its features. One ridge regressor
per language is fitted on a bounded sample of labelled texts, at most ``PER_LANGUAGE`` each; its share of the landmarks
is the same for every language. Scoring multiplies batches of presence vectors with one small matrix inside the tasks.

Whether a language claims a text at all is another question, since the ridge outputs of a text without any likeness are
the bias, which may be large. A text's likeness to a language is the mean log share of the language's sample texts that
hold each of its n-grams; the cut lies below the likeness of sample texts to languages fitted without them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm import arrays as A

BINS = 8192
ORDERS = 3
PER_LANGUAGE = 400
LANDMARKS = 160
RIDGE = 1e-2
ROWS_AT_ONCE = 512
UNDETERMINED = "und"
MARGIN = 0.5
SHORT_MARGIN = 8.0
LEAST_SHARE = 0.01

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def presence(data, offsets):
    """A row of flags per text: which n-gram bins occur in it."""
    rows = len(offsets) - 1
    seen = np.zeros((rows, BINS), dtype=bool)
    folded = _FOLD[data].astype(np.uint32)
    code = np.zeros(len(folded), dtype=np.uint32)
    flat = seen.reshape(-1)
    place = np.repeat(np.arange(rows, dtype=np.int64) * BINS, np.diff(offsets))
    last = np.repeat(offsets[1:], np.diff(offsets))
    shift = np.uint32(32 - int(np.log2(BINS)))
    position = np.arange(len(folded))
    for order in range(ORDERS):
        # code[i] stands for the n-gram that starts at byte i.
        n = len(folded) - order
        if n <= 0:
            break
        code = code[:n] * _FACTORS[0] + (folded[order:] + np.uint32(order + 1)) * _FACTORS[1]
        bins = (code ^ (code >> np.uint32(15))) * _FACTORS[2] >> shift
        whole = position[:n] + order < last[:n]
        flat[(place[:n] + bins)[whole]] = True
    return seen


def _batches(column):
    """(first row, presence matrix) of successive runs of texts."""
    for first, last, data, offsets in A.text_chunks(column):
        for a in range(0, last - first, ROWS_AT_ONCE):
            b = min(a + ROWS_AT_ONCE, last - first)
            yield first + a, presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _samples(batches):
    for batch in batches:
        for first, seen in _batches(batch.column("text")):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").slice(first, len(seen)),
                    batch.column("draw").slice(first, len(seen)),
                    pa.array([np.packbits(x).tobytes() for x in seen], pa.binary()),
                ],
                ["lang", "draw", "bins"],
            )


class LanguageModel:
    """Languages, landmark rows and one weight column per language; log shares of the n-grams and the cut of likeness."""

    def __init__(self, languages, landmarks, weights, bias, shares, floor):
        self.languages, self.landmarks, self.weights, self.bias = languages, landmarks, weights, bias
        self.shares, self.floor = shares, floor

    def scores(self, seen):
        """Ridge outputs, one column per language, for a matrix of presence rows."""
        x = seen.astype(np.float32)
        size = np.maximum(x.sum(axis=1, keepdims=True), 1)
        return (x @ self.landmarks.T) / np.sqrt(size) @ self.weights + self.bias

    def claimed(self, seen, margin=MARGIN):
        """Whether some language is like each row, with more leeway the fewer n-grams a text has."""
        size = np.maximum(seen.sum(axis=1), 1)
        return _likeness(seen, self.shares) >= self.floor - margin - SHORT_MARGIN / np.sqrt(size)


def _log_shares(rows, labels, languages):
    """Log share of each language's rows that hold each bin."""
    held = np.stack([rows[labels == i].sum(axis=0, dtype=np.float64) for i in range(languages)])
    return np.log((held + 0.5) / (np.bincount(labels, minlength=languages)[:, None] + 1)).astype(np.float32)


def _likeness(seen, shares):
    x = seen.astype(np.float32)
    return (x @ shares.T).max(axis=1) / np.maximum(x.sum(axis=1), 1)


def _floor(languages, labels, rows):
    """Likeness that all but ``LEAST_SHARE`` of the sample texts reach, each half scored by the other half's shares."""
    half = np.arange(len(rows)) % 2 == 0
    if len(rows) < 2:
        return -np.inf
    found = [_likeness(rows[part], _log_shares(rows[~part], labels[~part], len(languages))) for part in (half, ~half)]
    return float(np.quantile(np.concatenate(found), LEAST_SHARE))


def _fitted(languages, labels, rows, landmarks, ridge):
    x = rows.astype(np.float32)
    unit = x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    share = max(1, landmarks // len(languages))
    order = np.concatenate([np.flatnonzero(labels == i)[:share] for i in range(len(languages))])
    marks = unit[order]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    features = (unit @ marks.T).astype(np.float64) @ root
    targets = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(labels, minlength=len(languages))[labels]
    weight = weight / weight.sum()
    mean, level = weight @ features, weight @ targets
    centered = (features - mean) * np.sqrt(weight)[:, None]
    solved = np.linalg.solve(
        centered.T @ centered + ridge / len(order) * np.eye(len(order)),
        centered.T @ ((targets - level) * np.sqrt(weight)[:, None]),
    )
    bias = (level - mean @ solved).astype(np.float32)
    shares, floor = _log_shares(rows, labels, len(languages)), _floor(languages, labels, rows)
    return LanguageModel(languages, marks, (root @ solved).astype(np.float32), bias, shares, floor)


def draw_of(key):
    """A number in [0, 1) that depends on the key only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), key), 11).cast("double") / F.lit(float(1 << 53))


def fit(documents: DataFrame, per_language=PER_LANGUAGE, landmarks=LANDMARKS, ridge=RIDGE):
    """A model from (doc_id, text, lang), or None without labelled texts.

    Only documents whose crc32 of the doc_id's digits modulo 4 is not 2 are read, and of each language about
    ``per_language`` at most, the ones with the least draws; only their bin sets reach the driver.
    """
    rows = documents.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.lit(1.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 1.1 * per_language / counts[name]))).otherwise(share)
    draw = draw_of(F.col("doc_id").cast("long"))
    chosen = rows.select("lang", "text", draw.alias("draw")).filter(F.col("draw") < share)
    sample = chosen.mapInArrow(_samples, "lang string, draw double, bins binary").toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values(["lang", "draw", "bins"]).groupby("lang").head(per_language)
    languages = sorted(sample["lang"].unique())
    labels = np.searchsorted(languages, sample["lang"].to_numpy())
    bins = np.unpackbits(np.stack([np.frombuffer(x, dtype=np.uint8) for x in sample["bins"]]), axis=1)
    return _fitted(languages, labels, bins, landmarks, ridge)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _has_letter(text):
    return text is not None and any(c.isalpha() for c in text)


_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def letters(column):
    """Whether each text holds a letter of any script."""
    out = np.zeros(len(column), dtype=bool)
    for first, last, data, offsets in A.text_chunks(column):
        count = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
        out[first:last] = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = _has_letter(column[int(i)].as_py())
    return out


def _predicted(model, margin=None):
    """lang_pred and score after the columns but the first; with a ``margin`` only for rows that a language claims."""

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            best, score = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch))
            claimed = np.ones(len(batch), dtype=bool)
            if model.value is not None:
                for first, seen in _batches(text):
                    found = model.value.scores(seen)
                    part = slice(first, first + len(seen))
                    best[part] = found.argmax(axis=1)
                    score[part] = np.clip((found.max(axis=1).astype(np.float64) + 1) / 2, 0, 1)
                    if margin is not None:
                        claimed[part] = model.value.claimed(seen, margin)
            known = letters(text) & claimed & (model.value is not None)
            names = np.array([UNDETERMINED] if model.value is None else model.value.languages, dtype=object)
            names = np.where(known, names[best], UNDETERMINED)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))],
                [*batch.schema.names[1:], "lang_pred", "score"],
            )

    return run


def predict(documents: DataFrame, model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``documents`` (doc_id, text).

    lang_pred is the learned language with the largest output and score that output mapped from [-1, 1] to [0, 1]. A text
    that is null or has no letter gets ``und`` with score 0, as does everything if there is no model. held_out tells
    whether crc32 of doc_id's digits modulo 4 is 2 (false for a null doc_id). Repeated rows are returned as often as
    they occur, further columns are ignored, an empty table gives an empty result.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(
        F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out")
    )
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return rows.mapInArrow(_predicted(held), schema)


def keep_identified(documents: DataFrame, model, margin=MARGIN) -> DataFrame:
    """``documents`` without the rows that are ``und`` or that no learned language claims; all columns stay.

    ``margin`` is how far the likeness may lie below that of the sample texts; short texts have more leeway.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    marked = [f"_c{i}" for i in range(len(names))]  # so that no column of the table clashes with the prediction's
    renamed = documents.select(F.col("text").cast("string"), "*").toDF("text", *marked)
    schema = T.StructType(renamed.schema.fields[1:]).add("lang_pred", "string").add("score", "double")
    out = renamed.mapInArrow(_predicted(held, margin), schema)
    kept = out.filter(F.col("lang_pred") != UNDETERMINED)
    return kept.select(*[F.col(m).alias(n) for m, n in zip(marked, names)])
