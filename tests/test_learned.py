"""Multi-label models against plain numpy, explanations, reports, and the plan of every registered query."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from spanloom.operators import classifying as C
from spanloom.operators import features
from spanloom.plans import ORACLES, PLANS
from spanloom.sources import conll

LABELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(4)
    x = (r.random((90, 12)) < 0.35).astype(float) * r.integers(1, 4, (90, 12))
    y = np.column_stack([x[:, 0] > 0, (x[:, 1] > 0) | (x[:, 2] > 1), np.zeros(90, dtype=bool)]).astype(int)
    noise = r.random((90, 2)) < 0.1
    y[:, :2] ^= noise
    return x, y, 60


def frame(spark, x, y, first):
    cells = [(first + i, Vectors.dense(v), *map(int, t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(cells, ["doc_id", "features", *LABELS])


def bernoulli(x, y, test):
    """Naive Bayes on binary features with one added to all counts; a class that never varies needs no model."""
    classes = np.unique(y)
    if len(classes) == 1:
        return np.full(len(test), classes[0])
    x, test, scores = x > 0, test > 0, []
    for c in classes:
        n = (y == c).sum()
        theta = (x[y == c].sum(axis=0) + 1) / (n + 2)
        scores.append(np.log((n + 1) / (len(y) + len(classes))) + test @ np.log(theta) + ~test @ np.log(1 - theta))
    return classes[np.argmax(scores, axis=0)]


def predicted(model, spark, data):
    x, y, n = data
    found = model.fit(frame(spark, x[:n], y[:n], 0)).predict(frame(spark, x[n:], y[n:], n))
    return np.array(rows(found, "doc_id", *[f"pred_{a}" for a in LABELS]))[:, 1:]


BAYES = C.ESTIMATORS["Bayes BernoulliNB"]


def test_binary_relevance(spark, data):
    x, y, n = data
    want = np.column_stack([bernoulli(x[:n], y[:n, k], x[n:]) for k in range(3)])
    assert (predicted(C.BinaryRelevance(BAYES, LABELS), spark, data) == want).all()


def test_classifier_chain(spark, data):
    x, y, n = data
    known, given, want = x[:n], x[n:], np.zeros((len(x) - n, 3), dtype=int)
    for k in range(2):  # the label that nothing has drops out
        want[:, k] = bernoulli(known, y[:n, k], given)
        known, given = np.column_stack([known, y[:n, k]]), np.column_stack([given, want[:, k]])
    assert (predicted(C.ClassifierChain(BAYES, LABELS), spark, data) == want).all()


def test_label_powerset(spark, data):
    x, y, n = data
    combos = y[:n] @ [4, 2, 1]
    found = bernoulli(x[:n], combos, x[n:])
    want = np.column_stack([found >> 2 & 1, found >> 1 & 1, found & 1])
    assert (predicted(C.LabelPowerset(BAYES, LABELS), spark, data) == want).all()


def plain_nearest(queries, base, names, k, same=False):
    score = queries @ base.T
    if same:
        np.fill_diagonal(score, -np.inf)
    return [sorted(range(len(base)), key=lambda j: (-s[j], names[j]))[:k] for s in score]


def test_nearest_neighbours_decide_by_posteriors(spark, data):
    x, y, n = data
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    k = C.NEIGHBOURS
    near = plain_nearest(unit[:n], unit[:n], range(n), k, same=True)
    counts = np.array([y[j].sum(axis=0) for j in near])
    given = np.array([y[j].sum(axis=0) for j in plain_nearest(unit[n:], unit[:n], range(n), k)])
    want = np.zeros((len(x) - n, 3), dtype=int)
    for a in range(3):
        prior = (1 + y[:n, a].sum()) / (2 + n)
        sides = []
        for value in (0, 1):
            c = [((counts[:, a] == j) & (y[:n, a] == value)).sum() for j in range(k + 1)]
            sides.append([(1 + v) / (k + 1 + sum(c)) for v in c])
        want[:, a] = [prior * sides[1][j] > (1 - prior) * sides[0][j] for j in given[:, a]]
    found = predicted(C.MultilabelKnn(LABELS), spark, (unit, y, n))
    assert (found == want).all()


def test_neighbours_come_from_all_blocks(spark, monkeypatch):
    """Also where the groups of both sides lie in several partitions."""
    monkeypatch.setattr(C, "BLOCK", 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    r = np.random.default_rng(3)
    x = (r.random((70, 10)) < 0.4) * r.random((70, 10))
    table = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["key", "features"])
    queries, base = table.filter("key < 30"), table.filter("key >= 30")
    try:
        found = rows(C.nearest(queries, base, 3), "query", "rank", "neighbour")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    score = x[:30] @ x[30:].T
    want = [(q, k, 30 + int(i)) for q in range(30) for k, i in enumerate(np.lexsort((np.arange(40), -score[q]))[:3])]
    assert found == sorted(want, key=repr)


def test_linear_models_reach_their_optimum(spark, data):
    """Logistic regression has no closed form; at its optimum the gradient of its loss vanishes."""
    x, y, n = data
    model = C.Trained(C.ESTIMATORS["LogisticR"](), frame(spark, x[:n], np.roll(y[:n], 7, axis=0), 0), "b").model
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x[:n] @ w + b)))
    gap = p - np.roll(y[:n], 7, axis=0)[:, 1]
    assert abs(gap.mean()) < 1e-3 and np.abs(x[:n].T @ gap / n).max() < 1e-3


def test_explanations_are_weight_times_coefficient(spark):
    weights = spark.createDataFrame([(1, "x", 0.5), (1, "y", 2.0), (1, "z", 1.0), (2, "x", 1.0)], "doc_id int, term string, weight double")
    coefficients = spark.createDataFrame([("x", 4.0), ("y", -3.0), ("z", 0.1)], "term string, coefficient double")
    found = C.explain(weights, coefficients, top=2)
    assert rows(found, "doc_id", "rank", "term", "contribution") == [(1, 1, "y", -6.0), (1, 2, "x", 2.0), (2, 1, "x", 4.0)]


def test_evaluation_equals_its_own_predictions(spark):
    """The report's scores, counted again from the rows of the analysis."""
    r = random.Random(6)
    words = ["agua", "luz", "gas", "falta", "hoy", "ayer", "zona", "norte"]
    docs = []
    for i in range(80):
        text = [r.choice(words) for _ in range(6)]
        docs.append((i, " ".join(text), int("agua" in text), int("luz" in text)))
    df = spark.createDataFrame(docs, "doc_id long, text string, a int, b int")
    performance, analysis = C.evaluate_models(
        df.filter("doc_id % 3 <> 0"), df.filter("doc_id % 3 = 0"), ["a", "b"], estimators=("Bayes BernoulliNB", "LogisticR")
    )
    seen = {}
    for row in analysis.collect():
        seen.setdefault(row["model_name"], []).append([row["a"], row["b"], row["pred_a"], row["pred_b"]])
    report = {row["model_name"]: row for row in performance.collect()}
    assert set(report) == set(seen) and len(report) == 7
    for name, cells in seen.items():
        m = np.array(cells)
        truth, made = m[:, :2] > 0, m[:, 2:] > 0
        assert len(m) == 27
        tp, fp, fn = (truth & made).sum(axis=0), (~truth & made).sum(axis=0), (truth & ~made).sum(axis=0)
        want = {
            "accuracy": (truth == made).all(axis=1).mean(),
            "hamming_loss": (truth != made).mean(),
            "f1_score_micro": 2 * tp.sum() / (2 * tp.sum() + fp.sum() + fn.sum()),
            "precision_macro": np.mean([t / (t + f) if t + f else 0 for t, f in zip(tp, fp)]),
            "recall_macro": np.mean([t / (t + f) if t + f else 0 for t, f in zip(tp, fn)]),
        }
        assert all(abs(report[name][k] - v) < 1e-9 for k, v in want.items()), name


def test_vectors_equal_the_table_of_weights(spark):
    docs = spark.createDataFrame([(1, "luz luz agua"), (2, "agua gas"), (3, "gas luz hoy")], "doc_id int, text string")
    vectors = features.Vectorizer().fit(docs)
    table = features.tfidf(docs, plus_one=False)
    weights = {(r["doc_id"], r["term"]): r["weight"] for r in table.collect()}
    for row in vectors.transform(docs).collect():
        for place, value in zip(row["features"].indices, row["features"].values):
            assert abs(weights[row["doc_id"], vectors.vocabulary[place]] - value) < 1e-9


def test_vocabulary_of_vectors_does_not_depend_on_partitions(spark):
    """Spark's own counter keeps any of the equally frequent terms at the end; all other terms are the same."""
    draw = random.Random(5)
    rows = [(i, " ".join(f"w{min(draw.randrange(400), draw.randrange(400))}" for _ in range(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [features.Vectorizer(max_features=300).fit(docs.repartition(n)) for n in (1, 7)]
    assert found[0].vocabulary == found[1].vocabulary
    terms = docs.select(features.ngram_terms(features.word_tokens(F.col("text"))).alias("terms"))
    counter = CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=300, minDF=1).fit(terms)
    idf = dict(zip(counter.vocabulary, IDF(inputCol="counts", outputCol="w").fit(counter.transform(terms)).idf, strict=True))
    totals = Counter(t for r in terms.collect() for t in r["terms"])
    least = min(totals[t] for t in found[0].vocabulary)
    settled = {t for t, n in totals.items() if n > least}
    assert settled < set(found[0].vocabulary) and settled < set(counter.vocabulary)
    made = dict(zip(found[0].vocabulary, found[0].idf_model.getScalingVec(), strict=True))
    assert all(abs(made[t] - idf[t]) < 1e-12 for t in settled)


# S13
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "``": '"', "''": '"', "\\/": "/"}


def plain_ner(lines, flavor):
    """Documents and entities read line by line."""
    after, before = ({"2000": "($", "2002": "("}[flavor], {"2000": ".,;%)?!", "2002": ".,)?!"}[flavor])
    sentences, current, marks = [], [], 0
    for number, line in enumerate(lines):
        parts = line.split()
        if not parts:
            if current:
                sentences.append((current, marks))
            current = []
            continue
        if flavor == "2002":
            if line.startswith("-DOCSTART-"):
                marks += 1
                continue
            if number + 2 < len(lines) and not lines[number + 1].strip() and lines[number + 2].startswith("-- O"):
                marks += 1
        token = parts[0]
        if flavor == "2000":
            token = BRACKETS.get(token, token)
        current.append((token, parts[-1]))
    if current:
        sentences.append((current, marks))
    docs, entities = {}, {}
    for number, (tokens, mark) in enumerate(sentences):
        doc = number // 10 + 1 if flavor == "2000" else mark + 1
        text, found = docs.get(doc, ""), entities.setdefault(doc, [])
        opened, quotes, last = None, 0, None
        for token, tag in tokens:
            if last is None:
                text += "\n" if text else ""
            else:
                odd = quotes % 2 == 1
                tight = last in after or token in before or (last == '"' and odd) or (token == '"' and odd)
                text += "" if tight else " "
            start = len(text)
            text += token
            kind = tag[2:]
            if tag[0] == "I" and opened == kind:
                found[-1][2] = len(text)
            elif tag[0] in "BI":
                found.append([kind, start, len(text)])
            opened = kind if tag[0] != "O" else None
            quotes += token == '"'
            last = token
        docs[doc] = text
    out = [(f"d-doc-{d}", *e, docs[d][e[1] : e[2]]) for d, found in entities.items() for e in found]
    return {f"d-doc-{d}": t + "\n" for d, t in docs.items()}, sorted(out, key=repr)


@pytest.mark.parametrize("flavor", ["2000", "2002"])
def test_column_files_equal_plain_python(spark, flavor):
    r = random.Random(3)
    tokens = ["Ana", "goes", "(", ")", ".", ",", "$", "5", "%", "!", "Rome", "x/y"]
    tokens += ["-LRB-", "-RRB-", "``", "''"] if flavor == "2000" else ['"', '"', '"']
    lines = []
    for _ in range(60):
        if flavor == "2002" and r.random() < 0.15:
            lines += ["-DOCSTART- -X- O", ""] if r.random() < 0.5 else ["-- O", ""]
        for _ in range(r.randrange(1, 9)):
            tag = r.choice(["O", "O", "B-PER", "I-PER", "I-LOC", "B-LOC"])
            lines.append(" ".join([r.choice(tokens), *(["NN"] if r.random() < 0.7 else []), tag]))
        lines += [""] * r.randrange(1, 3)
    if flavor == "2002":  # rule lines are looked at two lines ahead only
        lines = [x for x in lines if x != "-- O"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc_id string, line_no int, line string")
    docs, found = conll.read_conll_ner(df, flavor)
    texts, want = plain_ner(lines, flavor)
    assert dict(rows(docs, "doc_id", "text")) == texts
    assert rows(found, "doc_id", "type", "start", "end", "text") == want and len(want) > 60


# Learning and streaming run while a query is built; they are run whole in their own tests.
BUILT_BY_RUNNING = ("m0", "k07", "t0", "u02", "u03")


def test_every_query_has_a_plan(spark):
    """No query lost a helper it needs: each is built and analyzed on the smallest tables."""
    broken = {}
    for name, query in PLANS.items():
        if name.startswith(BUILT_BY_RUNNING):
            continue
        try:
            assert query(spark, "/root/testdata/sf0.001").columns
        except Exception as error:  # noqa: BLE001
            broken[name] = repr(error)[:200]
    assert broken == {}
    assert set(ORACLES) <= set(PLANS) and len(PLANS) > 210


def test_all_labelled_rows_are_neighbours(spark):
    """More rows than any cap there was; each query has four neighbours of its own, and each of them counts."""
    n = 2_600
    train = spark.range(4 * n).select(F.col("id").alias("doc_id"), (F.col("id") % 4).alias("place"), F.floor(F.col("id") / 4).cast("int").alias("g"))
    unit = F.udf(lambda g: Vectors.sparse(n, [g], [1.0]), VectorUDT())
    train = train.select("doc_id", unit("g").alias("features"), F.lit(1).alias("a"), (F.col("place") == 0).cast("int").alias("b"))
    model = C.MultilabelKnn(["a", "b"]).fit(train)
    asked = spark.range(n).select(F.col("id").alias("key"), unit(F.col("id").cast("int")).alias("features"))
    near = C.nearest(asked, model.base.select("key", "features"))
    assert near.filter(F.floor(F.col("neighbour") / 4) == F.col("query")).count() == 4 * n
    counted = model._counts(near, model.base)
    assert [tuple(r) for r in counted.select("n_a", "n_b").distinct().collect()] == [(4, 1)]


def test_compared_neighbours_come_from_all_rows(spark, monkeypatch):
    """The comparison of models, which the written report is made of, leaves no labelled row out either."""
    known = []

    class Watched(C.MultilabelKnn):
        def fit(self, train):
            known.append(super().fit(train).base.count())
            return self

    monkeypatch.setattr(C, "MultilabelKnn", Watched)
    rows = spark.range(10_300).select(F.col("id").alias("doc_id"), F.format_string("w%s w%s", F.col("id") % 97, F.col("id") % 89).alias("text"),
                                      (F.col("id") % 2).cast("int").alias("a"))
    performance, _ = C.evaluate_models(rows.filter("doc_id >= 200"), rows.filter("doc_id < 200"), ["a"], estimators=())
    assert known == [10_100] and [r["model_name"] for r in performance.collect()] == ["Multi kNN"]
