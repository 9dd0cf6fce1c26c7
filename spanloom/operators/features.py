"""Text features: TF-IDF as a table and as vectors, and masked token rows."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import TYPE_ACCENTS, language_model_text
from spanloom.session import cut_lineage, spread

# Word pattern, n-gram range, vocabulary size; share of masked tokens, length of a row, special tokens.
WORD = "[\\p{L}\\p{N}_]{2,}"
NGRAMS = (1, 3)
MAX_FEATURES = 10_000
MASK_PERCENT = 15
MAX_TOKENS = 512
MASK, PAD = "<mask>", "<pad>"


def word_tokens(text):
    return F.regexp_extract_all(F.translate(F.lower(text), *TYPE_ACCENTS), F.lit(WORD), F.lit(0))


def ngram_terms(tokens, low=1, high=3):
    """Array of the n-grams of a token array, as blank-separated terms."""
    parts = []
    for n in range(low, high + 1):
        starts = F.sequence(F.lit(0), F.size(tokens) - n)
        parts.append(F.when(F.size(tokens) >= n, _grams(tokens, starts, n)).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def _grams(tokens, starts, n):
    """Single lookups by place; cutting slices would copy the whole array for every n-gram."""
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(n)]))


def count_ngrams(low, high, terms_at_once=1 << 16):
    """Rows (key, term, tf) of the different n-grams of token arrays (key, tokens), as blank-separated terms."""

    def rows(keys, places, terms, numbers):
        columns = [keys.take(pa.array(places, pa.int64())), pa.array(terms, pa.string()), pa.array(numbers, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["key", "term", "tf"])

    def run(batches):
        for batch in batches:
            keys, tokens = batch.column("key"), batch.column("tokens")
            places, terms, numbers = [], [], []
            for row in range(len(batch)):
                words, found = tokens[row].as_py(), Counter()
                for n in range(low, high + 1) if words else ():
                    found.update(words if n == 1 else map(" ".join, zip(*(words[i:] for i in range(n)))))
                places += [row] * len(found)
                terms += found.keys()
                numbers += found.values()
                if len(terms) >= terms_at_once:
                    yield rows(keys, places, terms, numbers)
                    places, terms, numbers = [], [], []
            yield rows(keys, places, terms, numbers)

    return run


def _total_ngrams(n, parts, rows_at_once=1024):
    """Rows (term, total, df) of the n-grams of token arrays, summed over many texts before they leave the task.

    With ``parts``, only n-grams that both begin and end with one of these are counted.
    """
    often = None if parts is None else pa.array(parts, pa.string())

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), rows_at_once):
                tokens = batch.column("tokens").slice(at, rows_at_once)
                words = tokens.flatten().dictionary_encode()
                place = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
                # Numbers of the grams at each place, and the grams they stand for, one word longer in each step.
                gram, terms = words.indices.to_numpy().astype(np.int64), words.dictionary.cast(pa.string())
                word, names, size = gram, terms, max(1, len(terms))
                for length in range(2, n + 1):
                    inside = place[length - 1 :] == place[: len(place) - length + 1]
                    if often is not None and length == n:
                        known = pc.is_in(terms, often).to_numpy(zero_copy_only=False)
                        inside = inside & known[gram[:-1]] & known[gram[1:]] if len(terms) else inside
                    pairs = np.where(inside, gram[: len(inside)] * size + word[length - 1 :], -1)
                    kept, gram = np.unique(pairs, return_inverse=True)
                    left, right = np.maximum(kept, 0) // size, np.maximum(kept, 0) % size
                    terms = pc.binary_join_element_wise(terms.take(pa.array(left)), names.take(pa.array(right)), " ")
                    terms = pc.if_else(pa.array(kept >= 0), terms, pa.scalar(None, pa.string()))
                if not len(gram):
                    continue
                total = np.bincount(gram, minlength=len(terms))
                pairs = np.unique(place[: len(gram)] * len(terms) + gram)
                seen = np.bincount(pairs % len(terms), minlength=len(terms))
                made = pa.RecordBatch.from_arrays([terms, pa.array(total, pa.int64()), pa.array(seen, pa.int64())], ["term", "total", "df"])
                yield made.filter(terms.is_valid())

    return run


def _ngrams(words, n):
    return words if n == 1 else map(" ".join, zip(*(words[i:] for i in range(n))))


MAX_PARTS = 500_000


def _most_frequent(texts: DataFrame, ngram, max_features) -> DataFrame:
    """(term, total, df) of the most frequent n-grams of token arrays, exactly.

    An n-gram is no more frequent than the n-grams one word shorter inside it. So once ``max_features`` terms are known,
    longer ones are only counted where both shorter ones are as frequent as the last of these. If too many are to send them
    to the tasks, all are counted.
    """
    texts, best, parts = cut_lineage(texts), None, None
    for n in range(ngram[0], ngram[1] + 1):
        counted = texts.mapInArrow(_total_ngrams(n, parts), "term string, total long, df long")
        found = cut_lineage(counted.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")))
        best = found if best is None else best.unionByName(found)
        best = cut_lineage(best.orderBy(F.desc("total"), "term").limit(max_features))
        bound = best.agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least")).first()
        parts = None
        if bound["n"] == max_features and n < ngram[1]:
            often = [r[0] for r in found.filter(F.col("total") >= bound["least"]).select("term").limit(MAX_PARTS + 1).collect()]
            parts = often if len(often) <= MAX_PARTS else None
    return best


def _weigh(low, high, idf):
    """Rows (key, term, tf, idf, weight) of the known n-grams of token arrays (key, tokens), weighed in the row."""

    def rows(keys, places, found):
        terms, numbers, idfs, weights = zip(*found) if found else ((), (), (), ())
        columns = [keys.take(pa.array(places, pa.int64())), pa.array(terms, pa.string()), pa.array(numbers, pa.int64())]
        columns += [pa.array(idfs, pa.float64()), pa.array(weights, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["key", "term", "tf", "idf", "weight"])

    def run(batches):
        for batch in batches:
            keys, tokens = batch.column("key"), batch.column("tokens")
            places, found = [], []
            for row in range(len(batch)):
                words = tokens[row].as_py() or []
                counts = Counter(g for n in range(low, high + 1) for g in _ngrams(words, n) if g in idf)
                norm = math.sqrt(sum((tf * idf[t]) ** 2 for t, tf in counts.items()))
                places += [row] * len(counts)
                found += [(t, tf, idf[t], tf * idf[t] / norm if norm else None) for t, tf in counts.items()]
                if len(found) >= 1 << 16:
                    yield rows(keys, places, found)
                    places, found = [], []
            yield rows(keys, places, found)

    return run


# M01
def tfidf(docs: DataFrame, key="doc_id", text="text", ngram=NGRAMS, max_features=MAX_FEATURES, plus_one=True,
          fit_on: DataFrame = None) -> DataFrame:
    """(key, term, tf, idf, weight): L2-normalized weights of the most frequent terms.

    The vocabulary has at most ``max_features`` rows, the most frequent terms, and is sent to all tasks. With it, a text is
    cut into n-grams, counted and weighed in its own row, so no text or term of a document is shuffled. Rows with the same
    key count as one document; where there are such rows, their counts meet by key. ``plus_one`` picks the smoothed form
    with one added, the other form has none. ``fit_on`` restricts what the vocabulary comes from, such as a training part.
    """
    def cut(df):
        return spread(df.select(key, text)).select(F.col(key).alias("key"), word_tokens(F.col(text)).alias("tokens"))

    def repeated(df):
        return not df.groupBy(key).count().filter("count > 1").isEmpty()

    def counted(df):
        found = cut(df)
        kind = found.schema["key"].dataType.simpleString()
        each = found.mapInArrow(count_ngrams(*ngram), f"key {kind}, term string, tf long")
        return cut_lineage(each.groupBy("key", "term").agg(F.sum("tf").alias("tf")))

    source = docs if fit_on is None else fit_on
    if repeated(source):
        totals = counted(source).groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
        best = totals.orderBy(F.desc("total"), "term").limit(max_features)
    else:
        best = _most_frequent(cut(source).select("tokens"), ngram, max_features)
    n = source.count()
    idf = F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + (1.0 if plus_one else 0.0)
    vocabulary = best.select("term", idf.alias("idf"))
    if not repeated(docs):
        found = cut(docs)
        kind = found.schema["key"].dataType.simpleString()
        # At most ``max_features`` rows.
        known = {r["term"]: r["idf"] for r in vocabulary.collect()}
        made = found.mapInArrow(_weigh(*ngram, known), f"key {kind}, term string, tf long, idf double, weight double")
        return made.withColumnRenamed("key", key)
    known = counted(docs).withColumnRenamed("key", key).join(F.broadcast(vocabulary), "term")
    raw = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(key)))
    return known.select(key, "term", "tf", "idf", (raw / norm).alias("weight"))


class Vectorizer:
    """TF-IDF vectors for Spark ML, fitted on one table and applied to others.

    The vocabulary is that of :func:`tfidf`: of equally frequent terms the first in order stay, however the table is cut.
    Applied, a text is cut and weighed in its row.
    """

    def __init__(self, text="text", ngram=NGRAMS, max_features=MAX_FEATURES, out="features"):
        self.text, self.ngram, self.out, self.max_features = text, ngram, out, max_features
        self.norm = Normalizer(inputCol="_weights", outputCol=out, p=2.0)

    def _tokens(self, df):
        return df.withColumn("_tokens", word_tokens(F.col(self.text)))

    def fit(self, df: DataFrame) -> "Vectorizer":
        texts = spread(self._tokens(df).select(F.col("_tokens").alias("tokens")))
        best = _most_frequent(texts, self.ngram, self.max_features).orderBy(F.desc("total"), "term")
        # At most ``max_features`` rows.
        known, n = best.select("term", "df").collect(), df.count()
        self.vocabulary = [r["term"] for r in known]
        self.count_model = CountVectorizerModel.from_vocabulary(self.vocabulary, "_terms", "_counts")
        idf = Vectors.dense([math.log((n + 1.0) / (r["df"] + 1.0)) for r in known])
        self.idf_model = ElementwiseProduct(scalingVec=idf, inputCol="_counts", outputCol="_weights")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        terms = self._tokens(df).withColumn("_terms", ngram_terms(F.col("_tokens"), *self.ngram))
        out = self.norm.transform(self.idf_model.transform(self.count_model.transform(terms)))
        return out.drop("_tokens", "_terms", "_weights")


# M08
def mask_tokens(df: DataFrame, key: str, fields, percent=MASK_PERCENT, max_len=MAX_TOKENS, seed=42,
                first_only=False) -> DataFrame:
    """(key, chunk, input_tokens, labels, attention_mask): some tokens masked, the originals as labels, rows padded.

    A text with more than ``max_len`` tokens gives several rows, numbered by chunk; ``first_only`` keeps the first one.
    Whether a token is masked depends on the row's key, its place and the seed, so a rerun gives the same rows. Field
    order is the order given.
    """
    text = language_model_text(*[F.col(f) for f in fields])
    found = df.select(F.col(key), F.filter(F.split(text, "\\s+"), lambda t: t != "").alias("_all"))
    last = F.greatest(F.ceil(F.size("_all") / max_len).cast("int") - 1, F.lit(0))
    chunks = F.array(F.lit(0)) if first_only else F.sequence(F.lit(0), last)
    rows = found.withColumn("chunk", F.explode(chunks))
    rows = rows.withColumn("tokens", F.slice("_all", F.col("chunk") * max_len + 1, F.lit(max_len)))

    def masked(t, i):
        place = (F.col("chunk") * max_len + i).cast("string")
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), place, F.lit(str(seed)))), 1, 8), 16, 10)
        return F.when(draw.cast("long") % 100 < percent, F.lit(MASK)).otherwise(t)

    padding = F.array_repeat(F.lit(PAD), F.lit(max_len) - F.size("tokens"))
    ones = F.array_repeat(F.lit(1), F.size("tokens"))
    zeros = F.array_repeat(F.lit(0), F.lit(max_len) - F.size("tokens"))
    return rows.select(
        key,
        "chunk",
        F.concat(F.transform("tokens", masked), padding).alias("input_tokens"),
        F.concat("tokens", padding).alias("labels"),
        F.concat(ones, zeros).alias("attention_mask"),
    )
