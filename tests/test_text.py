import math
import uuid

from conftest import rows
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.functions import times, urls
from spanloom.operators import similarity, textual


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_sentences(spark):
    got = textual.sentences(docs(spark, " One of these days Jimmy, one of these days. Boom! Kaboom ", "   "))
    assert rows(got, "doc_id", "start", "end") == [(0, 1, 44), (0, 45, 50), (0, 51, 57), (1, 0, 3)]


def test_sentence_corrections_and_newlines(spark):
    text = "We saw Dr. Smith in May.\nThen e.g. nothing (at all. really) was left.\n\nDone."
    got = textual.sentences(docs(spark, text))
    parts = [text[s:e] for _, s, e in rows(got, "sentence_no", "start", "end")]
    assert parts == ["We saw Dr. Smith in May.", "Then e.g. nothing (at all. really) was left.", "", "Done."]
    lined = textual.sentence_newlines(docs(spark, "One here. Two there."), textual.sentences(docs(spark, "One here. Two there.")))
    assert lined.first()["text"] == "One here.\nTwo there."


def test_sentence_numbers(spark):
    d = docs(spark, "One. Two. Three.")
    points = spark.createDataFrame([(0, 1), (0, 6), (0, 12)], "doc_id int, start int")
    assert rows(textual.sentence_at(points, textual.sentences(d)), "start", "sentence") == [(1, 1), (12, 3), (6, 2)]


def test_treebank_tokens(spark):
    text = 'He said "it\'s 5% (more) of CD34(+), don\'t."'
    got = [text[s:e] for _, s, e in sorted((r["token_no"], r["start"], r["end"]) for r in textual.tokens(docs(spark, text), "treebank").collect())]
    assert "".join(got) == text.replace(" ", "")
    assert {"it", "'s", "%", "(", "more", ")", "CD34(+)", "\""} <= set(got)


def test_search_tokens(spark):
    toks = textual.search_tokens(textual.whitespace_tokens(docs(spark, "(foo-bar) ... x.")))
    got = [r["text"] for r in toks.orderBy("start").collect()]
    assert got == ["(", "foo-bar", ")", "..", ".", "x", "."]


def test_ngram_set(spark):
    got = spark.createDataFrame([("aaaa",), ("ab",)], "s string").select("s", X.ngram_set(F.col("s")).alias("g")).collect()
    assert {r["s"]: set(r["g"]) for r in got} == {"aaaa": {"aaa", "aaa2"}, "ab": {"ab\x01"}}


def test_url_key_and_times(spark):
    u = "https://example.com/a?b=ñ"
    df = spark.createDataFrame([(u,)], "url string")
    assert df.select(urls.url_key(F.col("url"))).first()[0] == str(uuid.uuid3(uuid.NAMESPACE_URL, u))
    stamps = spark.createDataFrame(
        [("2021-05-01 10:00:00.000001+0000",), ("2021-05-01 10:00:00.000001+00:00",), ("yesterday",)], "t string")
    got = [r[0] for r in stamps.select(F.unix_micros(times.parse_ts(F.col("t")))).collect()]
    assert got[0] == got[1] and got[2] is None
    back = stamps.limit(1).select(times.format_ts(times.parse_ts(F.col("t")))).first()[0]
    assert back == "2021-05-01 10:00:00.000001+0000"


def test_urls(spark):
    df = spark.createDataFrame([("http://a.com",), ("https://a.bc/c?d",), ("htp://a.com",), ("a.com",), ("http://localhost:80/x",)], "u string")
    assert [r[0] for r in df.select(urls.valid_url(F.col("u"))).collect()] == [True, True, False, False, True]
    assert [r[0] for r in df.select(urls.netloc(F.col("u"))).collect()] == ["a.com", "a.bc", "a.com", "", "localhost:80"]


WORDS = ["kitten", "sitting", "Saturday", "Sunday", "Caps", "caps", "sun day", "sit-ting", "mitten", "kit", "suntan", "x"]


def grams(s):
    s = s + "\x01" * (3 - len(s))
    out, seen = set(), {}
    for i in range(len(s) - 2):
        g = s[i : i + 3]
        seen[g] = seen.get(g, 0) + 1
        out.add(g if seen[g] == 1 else f"{g}{seen[g]}")
    return out


def test_similarity_joins_match_brute_force(spark):
    q = spark.createDataFrame([(w,) for w in WORDS], "query string")
    s = spark.createDataFrame([(w,) for w in WORDS], "value string")
    for t in (0.2, 0.5, 0.7):
        want = {(a, b) for a in WORDS for b in WORDS if len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b))) >= t}
        assert {(r[0], r[1]) for r in similarity.similar(q, s, "cosine", t).collect()} == want
        want = {(a, b) for a in WORDS for b in WORDS if len(grams(a) & grams(b)) / min(len(grams(a)), len(grams(b))) >= t}
        assert {(r[0], r[1]) for r in similarity.similar(q, s, "overlap", t).collect()} == want
        want = {(a, b) for a in WORDS for b in WORDS if len(grams(a) & grams(b)) >= t * len(grams(a))}
        assert {(r[0], r[1]) for r in similarity.superstrings(q, s, t).collect()} == want


def slow_distance(a, b):
    """Cell by cell, straight from the cost rules."""
    one = lambda c: 10 if c in " -" else 100
    swap = lambda x, y: 10 if (x != y and x.lower() == y.lower()) or (x, y) in ((" ", "-"), ("-", "_")) else 50
    if not a or not b:
        return 100 * max(len(a), len(b))
    prev = [0]
    for c in b:
        prev.append(prev[-1] + one(c))
    for x in a:
        cur = [prev[0] + one(x)]
        for j, y in enumerate(b):
            cur.append(prev[j] if x == y else min(prev[j + 1] + one(x), cur[-1] + one(y), prev[j] + swap(x, y)))
        prev = cur
    return prev[-1]


def test_weighted_distance(spark):
    pairs = [(a, b) for a in [*WORDS, ""] for b in [*WORDS, ""]]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", similarity.weighted_distance(F.col("a"), F.col("b")).alias("d"),
                    similarity.local_cost(F.col("a"), F.col("b")).alias("l")).collect()
    assert all(r["d"] == slow_distance(r["a"], r["b"]) for r in got)
    local = {(r["a"], r["b"]): r["l"] for r in got}
    assert local[("kit", "kitten")] == 3 and local[("", "caps")] == 4 and local[("caps", "")] == 400
    assert local[("Caps", "caps")] == 10
