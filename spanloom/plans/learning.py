"""Queries for text features, subwords, classifiers, and streams over the tables."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.operators import classifying as C
from spanloom.operators import datasets as D
from spanloom.operators import features as X
from spanloom.operators import subword
from spanloom.plans.lexicon import LOG_SQL
from spanloom.plans.registry import plan
from spanloom.plans.stores import articles, sql
from spanloom.plans.texts import CLEAN_SQL
from spanloom.session import cut_lineage, ensure_checkpoint_dir, spread
from spanloom.sources.tables import is_folder

TFIDF_SQL = r"""
tk AS (SELECT doc_id, regexp_extract_all(translate(lower(text), 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ','AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
ps AS (SELECT doc_id, generate_subscripts(w,1) AS i, unnest(w) AS a FROM tk WHERE len(w)>0),
gr AS (SELECT doc_id, a, lead(a,1) OVER z AS b, lead(a,2) OVER z AS c FROM ps WINDOW z AS (PARTITION BY doc_id ORDER BY i)),
tm AS (SELECT doc_id, a AS term FROM gr UNION ALL SELECT doc_id, concat(a,' ',b) FROM gr WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, concat(a,' ',b,' ',c) FROM gr WHERE c IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tm GROUP BY doc_id, term),
vc AS (SELECT term, ln((1.0+(SELECT count(*) FROM documents))/(1.0+count(*)))+1 AS idf FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000),
rw AS (SELECT doc_id, term, tf, idf, tf*idf AS raw FROM tf JOIN vc USING (term))"""


@plan("m01_tfidf", "WITH " + TFIDF_SQL + """ SELECT doc_id, term, tf, round(raw/sqrt(sum(raw*raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM rw""")
def _(t):
    return X.tfidf(t.documents).select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


@plan("m08_mask_tokens", r"""
WITH c AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '. ') AS body FROM documents),
k AS (SELECT doc_id, list_filter(string_split_regex(body, '\s+'), lambda x: x <> '') AS ts FROM c),
e AS (SELECT doc_id, generate_subscripts(ts,1)-1 AS i, unnest(ts) AS tok FROM k WHERE len(ts)>0),
z AS (SELECT doc_id, i // 512 AS chunk, count(*) FILTER (CAST(concat('0x', substring(md5(concat(doc_id, ':', i, ':42')),1,8)) AS BIGINT) % 100 < 15) AS masked, count(*) AS real_tokens FROM e GROUP BY doc_id, i // 512)
SELECT doc_id, coalesce(chunk,0)::BIGINT AS chunk, coalesce(masked,0) AS masked, coalesce(real_tokens,0) AS real_tokens, 512::BIGINT AS size FROM documents LEFT JOIN z USING (doc_id)""")
def _(t):
    rows = X.mask_tokens(t.documents, "doc_id", ["text"])
    return rows.select(
        "doc_id",
        "chunk",
        F.size(F.filter("input_tokens", lambda x: x == X.MASK)).alias("masked"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("real_tokens"),
        F.size("input_tokens").alias("size"),
    )


VOCAB_SQL = r"""wc AS (SELECT w, count(*) AS freq FROM (SELECT unnest(string_split_regex(text, '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w)"""


def _words(t):
    texts = spread(t.documents.select("text"))
    return texts.select(F.explode(F.split("text", "\\s+")).alias("word")).filter("word <> ''")


@plan("a18_pair_counts", "WITH " + VOCAB_SQL + r""", s AS (SELECT w, freq, unnest(generate_series(1, length(w))) AS i FROM wc)
SELECT substring(w,i,1) AS "first", CASE WHEN i=length(w) THEN '</w>' ELSE substring(w,i+1,1) END AS "second", sum(freq)::BIGINT AS freq
FROM s GROUP BY 1, 2""")
def _(t):
    return subword.pair_counts(subword.word_vocabulary(_words(t)))


MERGES = 20


def merges_sql():
    """One pair of tables per merge: the best pair, and the words with it written as one symbol.

    Symbols stand between two marks, so that a pair of them is a plain substring and equal symbols merge from the left.
    """
    steps = ["""v0 AS MATERIALIZED (SELECT w, freq, concat(chr(2), array_to_string(list_append(string_split(w, ''), '</w>'), chr(3) || chr(2)),
  chr(3)) AS s FROM wc)"""]
    for i in range(MERGES):
        steps.append(f"""p{i} AS (SELECT freq, unnest(list_zip(y[1:len(y)-1], y[2:len(y)])) AS p FROM (
  SELECT freq, string_split(trim(s, chr(2) || chr(3)), chr(3) || chr(2)) AS y FROM v{i}) WHERE len(y) > 1),
b{i} AS MATERIALIZED (SELECT p[1] AS a, p[2] AS b FROM p{i} GROUP BY p ORDER BY sum(freq) DESC, a, b LIMIT 1),
v{i + 1} AS MATERIALIZED (SELECT w, freq, replace(s, concat(chr(2), a, chr(3), chr(2), b, chr(3)), concat(chr(2), a, b, chr(3))) AS s
  FROM v{i} LEFT JOIN b{i} ON true)""")
    return ",\n".join(["WITH " + VOCAB_SQL.strip(), *steps])


SYMBOLS_SQL = "replace(trim(s, chr(2) || chr(3)), chr(3) || chr(2), ' ')"


@plan("u02_learn_merges", merges_sql() + f" SELECT {SYMBOLS_SQL} AS symbols, freq FROM v{MERGES}")
def _(t):
    _, vocab = subword.learn_merges(subword.word_vocabulary(_words(t)), MERGES)
    return vocab


@plan("u03_encode", merges_sql() + f"""
SELECT w AS word, CASE WHEN length(w) = 1 THEN w ELSE {SYMBOLS_SQL} END AS symbols FROM v{MERGES}""")
def _(t):
    merges, _ = subword.learn_merges(subword.word_vocabulary(_words(t)), MERGES)
    coded = subword.encode(_words(t).distinct(), merges)
    return coded.select("word", F.concat_ws(" ", "symbols").alias("symbols"))


def _split(t):
    rows = t.documents.select("doc_id", "text").join(t.labels, "doc_id")
    parts = D.split(rows, "doc_id", 0.3)
    return parts.filter("part = 'train'").drop("part"), parts.filter("part = 'test'").drop("part")


LABELS = ["quality", "toxic"]


def _predicted(t, model):
    train, test = _split(t)
    vectors = X.Vectorizer().fit(train)
    # Read more than once by the models; texts and counts have no part in it.
    rows, asked = [cut_lineage(vectors.transform(x).select("doc_id", *LABELS, "features")) for x in (train, test)]
    made = model.fit(rows).predict(asked)
    return made.select("doc_id", *LABELS, *[f"pred_{x}" for x in LABELS])


@plan("m02_binary_relevance")
def _(t):
    return _predicted(t, C.BinaryRelevance(C.ESTIMATORS["LogisticR"], LABELS))


@plan("m03_label_powerset")
def _(t):
    return _predicted(t, C.LabelPowerset(C.ESTIMATORS["Bayes BernoulliNB"], LABELS))


@plan("m04_classifier_chain")
def _(t):
    return _predicted(t, C.ClassifierChain(C.ESTIMATORS["Bayes MultinomialNB"], LABELS))


@plan("m05_multilabel_knn")
def _(t):
    return _predicted(t, C.MultilabelKnn(LABELS))


@plan("m07_explain")
def _(t):
    train, test = _split(t)
    vectors = X.Vectorizer().fit(train)
    rows = cut_lineage(vectors.transform(train).select("quality", "features"))
    model = C.Trained(C.ESTIMATORS["LogisticR"](), rows, "quality").model
    coefficients = C.linear_coefficients(t.spark, vectors, model)
    return C.explain(X.tfidf(test, fit_on=train), coefficients)


@plan("m09_evaluate_models")
def _(t):
    train, test = _split(t)
    performance, _ = C.evaluate_models(train, test, LABELS)
    return performance


def _length_scorer(texts: pd.Series):
    """Stands for a model: longer titles score higher for the second label."""
    return [[40.0, float(len(x))] for x in texts]


@plan("u01_classify", sql("""SELECT page_id, CASE WHEN length(title) > 40 THEN 'PROBLEMA DEL SERVICIO' ELSE 'IRRELEVANTE' END AS label_relevance FROM art"""))
def _(t):
    out = C.classify(articles(t), _length_scorer, "relevance", L.RELEVANCE_LABELS, "label_relevance")
    return out.select("page_id", "label_relevance")


@plan("k07_performance_report")
def _(t):
    """The written report, read back: performance by accuracy, then the sources and the analysis next to it."""
    from spanloom.operators.metrics import order_report
    from spanloom.sources.reports import read_report, save_reports

    train, test = _split(t)
    performance, analysis = C.evaluate_models(train, test, LABELS)
    name = save_reports(performance, analysis, [f"{t.folder}/documents.parquet"], _scratch(t.spark), test.count())
    models = ["model_name", "model_class_name"]
    written = read_report(t.spark, name, performance.schema, analysis.schema)
    per_model = written[2].groupBy(*models).agg(F.count(F.lit(1)).alias("analysis_rows"))
    sources = written[1].agg(F.array_sort(F.collect_list("source")).alias("sources"))
    out = written[0].join(per_model, models, "left").crossJoin(sources)
    out = order_report(out)
    return out.select(*performance.columns, F.array_join("sources", ",").alias("sources"), "analysis_rows")


@plan("k08_sample_lines", f"SELECT concat({CLEAN_SQL}, chr(10)) AS value FROM documents ORDER BY md5(concat(CAST(doc_id AS varchar), ':42')) LIMIT 100")
def _(t):
    from spanloom.sources.reports import sample_lines

    return sample_lines(D.sample_n(t.documents.select("doc_id", "text"), "doc_id", 100), "text")


def _scratch(spark):
    """A fresh folder next to the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/flow-{uuid.uuid4().hex}"


def _stream(t, name):
    """A table as a stream: all files of a folder, or the one file of that name, which Spark streams only from its folder."""
    path = f"{t.folder}/{name}.parquet"
    reader = t.spark.readStream.schema(getattr(t, name).schema)
    if is_folder(t.spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


@plan("t01_discover_urls", "SELECT url FROM pages WHERE starts_with(url, 'https://')")
def _(t):
    from spanloom.sources.store import ParquetStore
    from spanloom.streaming.flows import discover_urls

    folder = _scratch(t.spark)
    store = ParquetStore(t.spark, f"{folder}/articles")
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    entry = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), url, F.lit("</loc></url></urlset>"))
    discover_urls(_stream(t, "pages").select(entry.alias("xml")), store, f"{folder}/progress", prefix="https://")
    return store.rows().select("url")


@plan("t03_annotation_time_stream", "WITH " + LOG_SQL + " SELECT CAST(user_id AS varchar) AS user, event_id AS line_no, round(seconds,3) AS seconds FROM sec")
def _(t):
    from spanloom.streaming.flows import annotation_time_stream, latest_spans

    folder = _scratch(t.spark)
    kind = F.col("event_type")
    log = _stream(t, "events").select(
        F.col("event_id").alias("line_no"), F.col("ts").cast("timestamp").alias("time"), F.col("user_id").cast("string").alias("user"),
        F.lit("doc").alias("document"), F.when(F.col("event_id") % 2 == 0, "START").otherwise("FINISH").alias("state"),
        F.when(kind.isin("click", "view"), "spanSelected").when(kind == "purchase", "createSpan").otherwise("getDocument").alias("action"))
    out = annotation_time_stream(log)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    told = t.spark.read.schema(out.schema).parquet(f"{folder}/out")
    return latest_spans(told).select("user", "line_no", F.round("seconds", 3).alias("seconds"))


@plan("t04_classify_stream", sql("""SELECT url, CASE WHEN last_scraped IS NOT NULL AND label_relevance IS NULL THEN CASE WHEN length(title) > 40 THEN 'PROBLEMA DEL SERVICIO' ELSE 'IRRELEVANTE' END ELSE label_relevance END AS label_relevance FROM art"""))
def _(t):
    from spanloom.sources.store import ParquetStore
    from spanloom.streaming.flows import classify_stream

    folder = _scratch(t.spark)
    store = ParquetStore(t.spark, f"{folder}/articles")
    one = type("Streamed", (), {"pages": _stream(t, "pages")})()
    rows = articles(one).drop("page_id").withColumns({"categories": F.array().cast("array<string>"), "date": F.lit(None).cast("string")})
    classify_stream(rows, store, _length_scorer, "relevance", L.RELEVANCE_LABELS, f"{folder}/progress")
    return store.rows().select("url", "label_relevance")


@plan("t02_move_stream", sql("""SELECT url, CASE WHEN last_scraped IS NOT NULL AND label_relevance IS NOT NULL THEN 'cold' ELSE 'hot' END AS tier,
 CASE WHEN last_scraped IS NOT NULL AND label_relevance IS NOT NULL THEN least(length(content),6000) ELSE length(content) END AS size FROM art"""))
def _(t):
    from spanloom.sources.store import TieredStore
    from spanloom.streaming.flows import move_stream

    folder = _scratch(t.spark)
    store = TieredStore(t.spark, f"{folder}/hot", f"{folder}/cold", content=6000)
    one = type("Streamed", (), {"pages": _stream(t, "pages")})()
    rows = articles(one).drop("page_id").withColumns({"categories": F.array().cast("array<string>"), "date": F.lit(None).cast("string")})
    move_stream(rows, store, f"{folder}/progress")
    parts = [df.select("url", F.lit(n).alias("tier"), F.length("content").alias("size")) for n, df in (("hot", store.rows()), ("cold", store.cold.read()))]
    return parts[0].unionByName(parts[1])
