"""Toxicity by a classifier chain: categories are predicted one after the other, and each later linear model also gets the
probabilities of the categories before it. While training, those probabilities are out-of-fold predictions, so that a
later model never leans on how well an earlier one knows its own training rows.

Features are the distinct words of the whole text (runs of letters, A-Z lower-cased) and their beginnings, hashed; a
bounded vocabulary keeps the bins with the highest document frequency in the sample, but for those in a fifth of all
documents or more, chosen without looking at labels. Models are fitted on a
bounded sample of labelled documents, at most ``PER_CLASS`` for each combination of labels, weighted back to their true
shares. Only word bins of the sample reach the driver; all documents are scored inside tasks.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import arrays as A
from spanloom.llm.langid import draw_of
from spanloom.llm.tables import is_small

PER_CLASS = 1500
BITS = 20
BEGINNINGS = (4, 6, 8)  # bytes
VOCABULARY = 16384
COMMON = 0.2
FOLDS = 4
STEPS = 100
PENALTY = 2e-2
BROADCAST_IDS = 1_000_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Chain order: (name, condition for the label to hold), over the columns of the label table.
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def word_bins(data, offsets, kept=None):
    """(row, bin) of the distinct bins of words and beginnings of every text; ``kept`` marks the bins to look at."""
    start, end, row = A.runs(_LETTER[data], offsets)
    low, found = A.LOWER[data], []
    for size in (0, *BEGINNINGS):
        longer = end - start > size
        first, last = start[longer], start[longer] + size if size else end
        bins = A.mix(A.span_hashes(low, first, last) + np.uint64(size)) >> np.uint64(64 - BITS)
        both = (row[longer] << BITS) | bins.astype(np.int64)
        found.append(both if kept is None else both[kept[both & ((1 << BITS) - 1)]])
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def _samples(batches):
    for batch in batches:
        for first, last, data, offsets in A.text_chunks(batch.column("text")):
            row, bins = word_bins(data, offsets)
            cuts = np.searchsorted(row, np.arange(last - first + 1))
            packed = [bins[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:])]
            others = [batch.column(c).slice(first, last - first) for c in ("labels", "draw")]
            yield pa.RecordBatch.from_arrays([*others, pa.array(packed, pa.binary())], ["labels", "draw", "bins"])


class _Sparse:
    """Rows of features that are 1, as flat indices."""

    def __init__(self, rows, columns, shape):
        self.rows, self.columns, self.shape = rows, columns, shape

    def dot(self, w):
        return np.bincount(self.rows, w[self.columns], minlength=self.shape[0])

    def back(self, r):
        return np.bincount(self.columns, r[self.rows], minlength=self.shape[1])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(words, extra, target, weight):
    """(word weights, weights of the columns of ``extra``, bias): logistic regression by accelerated gradient steps."""
    weight = weight / weight.sum()
    cut = words.shape[1], words.shape[1] + extra.shape[1]

    def outputs(v):
        return words.dot(v[: cut[0]]) + extra @ v[cut[0] : cut[1]] + v[cut[1]]

    def slopes(r):
        return np.concatenate([words.back(r), extra.T @ r, [r.sum()]])

    penalty = np.full(cut[1] + 1, PENALTY)
    penalty[cut[0] :] = [PENALTY / 10] * extra.shape[1] + [0.0]
    direction = np.random.default_rng(0).normal(size=cut[1] + 1)
    for _ in range(8):  # largest curvature by power iteration
        direction = slopes(weight * outputs(direction))
        steepest = np.linalg.norm(direction)
        direction = direction / steepest
    rate = 1 / (0.3 * steepest + PENALTY)
    theta = np.zeros(cut[1] + 1)
    ahead, t = theta.copy(), 1.0
    for _ in range(STEPS):
        new = ahead - rate * (slopes(weight * (_sigmoid(outputs(ahead)) - target)) + penalty * ahead)
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / faster * (new - theta)
        theta, t = new, faster
    return theta[: cut[0]], theta[cut[0] : cut[1]], theta[cut[1]]


def _applied(model, words, extra):
    w, e, b = model
    return _sigmoid(words.dot(w) + extra @ e + b)


class Chain:
    """Names of the categories, kept bins with their place, one linear model and one threshold per category."""

    def __init__(self, names, place, models, limits):
        self.names, self.place, self.models, self.limits = names, place, models, limits
        self.kept = place >= 0

    def scores(self, data, offsets):
        """One column of probabilities per category, for a run of texts."""
        row, bins = word_bins(data, offsets, self.kept)
        words = _Sparse(row, self.place[bins], (len(offsets) - 1, int(self.place.max()) + 1))
        out = np.zeros((len(offsets) - 1, 0))
        for model in self.models:
            out = np.column_stack([out, _applied(model, words, out)])
        return out


def _best_limit(probability, target, weight):
    """The probability from which on F1 is best, halfway to the next lower one."""
    order = np.argsort(-probability, kind="stable")
    hit = np.cumsum((weight * target)[order])
    taken = np.cumsum(weight[order])
    score = 2 * hit / (taken + (weight * target).sum() + 1e-12)
    sorted_p = probability[order]
    ends = np.append(sorted_p[:-1] > sorted_p[1:], True)
    best = int(np.argmax(np.where(ends, score, -1)))
    below = sorted_p[best + 1] if best + 1 < len(sorted_p) else 0.0
    return float((sorted_p[best] + below) / 2)


def _labelled(labels, chain):
    """(id, labels): a bit per category; a document counts as one if any of its label rows says so."""
    known = labels.filter("doc_id IS NOT NULL")
    marks = [F.max(F.when(F.expr(c).isNotNull(), F.expr(c).cast("int"))).alias(n) for n, c in chain]
    rows = known.groupBy("doc_id").agg(*marks).dropna(subset=[n for n, _ in chain])
    bits = sum((F.col(n).cast("long") * (1 << i) for i, (n, _) in enumerate(chain)), F.lit(0).cast("long"))
    return rows.select(F.col("doc_id").cast("long").alias("label_id"), bits.alias("labels"))


def fit(documents: DataFrame, labels: DataFrame, chain=CHAIN, per_class=PER_CLASS):
    """A fitted chain from (doc_id, text) and a label table, or None if a category has no two classes.

    At most about ``per_class`` documents are read for each combination of labels, the ones with the least draws. Label
    rows with a null label are left out.
    """
    known = _labelled(labels, chain)
    counts = {r["labels"]: r["n"] for r in known.groupBy("labels").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for key, n in counts.items():
        share = F.when(F.col("labels") == key, F.lit(min(1.0, 1.1 * per_class / n))).otherwise(share)
    chosen = known.withColumn("draw", draw_of(F.col("label_id"))).filter(F.col("draw") < share)
    texts = documents.filter("text IS NOT NULL AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    # The sample is bounded by its classes; the check is for tables where labels repeat a document.
    chosen = F.broadcast(chosen) if is_small(chosen, BROADCAST_IDS) else chosen
    rows = texts.join(chosen, texts["doc_id"] == chosen["label_id"]).select("text", "labels", "draw")
    sample = rows.mapInArrow(_samples, "labels long, draw double, bins binary").toPandas()
    sample = sample.sort_values(["labels", "draw", "bins"]).groupby("labels").head(per_class)
    sample = sample.sort_values(["draw", "bins"]).reset_index(drop=True)
    n = len(sample)
    marks = sample["labels"].to_numpy().astype(np.int64) if n else np.zeros(0, dtype=np.int64)
    targets = np.stack([(marks >> i) & 1 for i in range(len(chain))], axis=1).astype(float)
    if n < 2 * FOLDS or (targets.min(axis=0) == targets.max(axis=0)).any():
        return None
    bins = [np.frombuffer(x, dtype="<i4") for x in sample["bins"]]
    frequency = np.bincount(np.concatenate(bins), minlength=1 << BITS)
    usual = (frequency >= 3) & (frequency <= max(3, COMMON * n))
    order = np.lexsort((np.arange(1 << BITS), -np.where(usual, frequency, 0)))[:VOCABULARY]
    order = order[usual[order]]
    if not len(order):
        return None
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[order] = np.arange(len(order))
    bins = [place[x] for x in bins]
    bins = [x[x >= 0] for x in bins]
    rows_of = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in bins])
    columns = np.concatenate(bins)
    drawn = np.bincount(marks, minlength=1 << len(chain))
    weight = np.array([counts[m] / drawn[m] for m in marks])
    fold = np.arange(n) % FOLDS

    def part(mask):
        number = np.cumsum(mask) - 1
        use = mask[rows_of]
        return _Sparse(number[rows_of[use]], columns[use], (int(mask.sum()), len(order)))

    everything = part(np.ones(n, dtype=bool))
    earlier, models, limits = np.zeros((n, 0)), [], []
    for i in range(len(chain)):
        target = targets[:, i]
        # Both classes count the same while fitting; the limit is chosen with the true shares.
        fair = weight * np.where(target == 1, 1 / weight[target == 1].sum(), 1 / weight[target == 0].sum())
        held = np.zeros(n)
        for f in range(FOLDS):
            train, test = fold != f, fold == f
            model = _logistic(part(train), earlier[train], target[train], fair[train])
            held[test] = _applied(model, part(test), earlier[test])
        models.append(_logistic(everything, earlier, target, fair))
        limits.append(_best_limit(held, target, weight))
        earlier = np.column_stack([earlier, held])
    return Chain([name for name, _ in chain], place, models, limits)


def _predicted(held, count):
    def run(batches):
        chain = held.value
        for batch in batches:
            scores = np.zeros((batch.num_rows, count))
            if chain is not None:
                for first, last, data, offsets in A.text_chunks(batch.column("text")):
                    scores[first:last] = chain.scores(data, offsets)
            limits = [2.0] * count if chain is None else chain.limits
            empty = pc.is_null(batch.column("text")).to_numpy(zero_copy_only=False)
            columns = [batch.column("doc_id")]
            for i in range(count):
                p = np.where(empty, 0.0, scores[:, i])
                columns += [pa.array(p), pa.array((p >= limits[i]) & ~empty)]
            yield pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])

    return run


def predict(documents: DataFrame, chain, names=tuple(n for n, _ in CHAIN)) -> DataFrame:
    """(doc_id, p_<category> double, <category> boolean, ...) for every row of ``documents`` (doc_id, text).

    A category holds from the probability on that was best for F1 on out-of-fold predictions. A null text gets 0 and
    false, an empty one what its lack of words gives; without a chain all is 0 and false. Repeated rows are returned as
    often as they occur, further columns are ignored, an empty table gives an empty result.
    """
    held = documents.sparkSession.sparkContext.broadcast(chain)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    columns = "".join(f", p_{n} double, {n} boolean" for n in names)
    marks = ", ".join(f"`{i}` {k}" for i, k in enumerate(["long", *["double", "boolean"] * len(names)]))
    found = rows.mapInArrow(_predicted(held, len(names)), marks)
    return found.toDF(*[c.split()[0] for c in f"doc_id long{columns}".split(", ")])
