"""Learned operators on held-out rows, searches against brute force, token files and urls against plain versions."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import langid, neighbours, token_files, toxicity, url_filter
from spanloom.llm.queries import byte_bpe_definition

from .conftest import text

SMALL = "/root/testdata/sf0.001"


def test_languages_on_held_out_rows(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    out = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out")
    assert held.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).isEmpty()
    assert held.filter("lang = lang_pred").count() >= 0.98 * held.count() > 0
    assert out.filter("score < 0 OR score > 1").isEmpty()
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, 9}
    wide = docs.withColumns({"score": F.lit("x"), "_c0": F.lit(1), "text2": F.col("text")})
    kept = langid.keep_identified(wide, model)
    assert kept.columns == wide.columns and kept.count() >= 0.99 * docs.count()
    assert {r["doc_id"] for r in langid.keep_identified(odd, model).collect()} & {1, 2, 3, 9} == set()
    assert langid.fit(nothing) is None and langid.predict(nothing, model).isEmpty()
    assert {r["lang_pred"] for r in langid.predict(docs.limit(3), None).collect()} == {"und"}


def test_texts_of_unlearned_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    letters = random.Random(1)
    foreign = [
        "我们今天去市场买了很多新鲜的蔬菜和水果，然后回家做了一顿丰盛的晚餐。", "我们今天去市场",
        "Сегодня мы пошли на рынок и купили много свежих овощей и фруктов, а потом вернулись домой.", "Сегодня мы пошли",
        "今日は市場へ行って新鮮な野菜と果物をたくさん買いました。それから家に帰りました。",
        "Dzisiaj poszliśmy na rynek i kupiliśmy dużo świeżych warzyw i owoców, a potem wróciliśmy do domu.",
        " ".join("".join(letters.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30)),
    ]
    clean = ["Re.", "The", "One", "Of of of"]
    rows = [(i, t) for i, t in enumerate(foreign + clean)]
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), langid.fit(docs)).collect()
    assert [r["text"] for r in sorted(kept)] == clean


def test_presence_equals_plain_sets():
    texts = ["Abc, abç", "", "x", "été 12 ABC"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    seen = langid.presence(data, offsets)
    for row, t in zip(seen, texts):
        alone = np.frombuffer(t.encode(), dtype=np.uint8)
        assert (row == langid.presence(alone, np.array([0, len(alone)]))[0]).all()
        folded = langid._FOLD[alone].tobytes()
        grams = {folded[i : i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1)}
        assert row.sum() <= len(grams) and (row.sum() > 0) == bool(grams)


def test_toxicity_on_held_out_rows(spark, odd, nothing):
    bad = ["vile%d" % i for i in range(8)]
    r = random.Random(1)
    data, labels = [], []
    for i in range(1200):
        words, toxic, poor = text(i, 60).split(" "), i % 6 == 0, i % 5 == 0
        words = [w.replace("w", "word").translate(str.maketrans("0123456789", "abcdefghij")) for w in words]
        if toxic:
            for b in r.sample(bad, 2):
                words[r.randrange(60)] = b.translate(str.maketrans("0123456789", "abcdefghij"))
        if poor:
            words[r.randrange(60)] = "junkish"
        data.append((i, " ".join(words)))
        if i % 2 or i % 12 == 0:
            labels.append((i, int(not poor), int(toxic)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, known)
    out = toxicity.predict(docs.withColumn("toxic", F.lit("x")), chain)
    assert out.columns == ["doc_id", "p_low_quality", "low_quality", "p_toxic", "toxic"]
    trained = {i for i, *_ in labels}
    rest = [x for x in out.collect() if x["doc_id"] not in trained]
    right = sum(x["toxic"] == (x["doc_id"] % 6 == 0) for x in rest)
    assert right >= 0.97 * len(rest) and any(x["toxic"] for x in rest)
    got = toxicity.predict(odd, chain)
    assert got.count() == odd.count() and got.filter("doc_id = 1 AND (toxic OR p_toxic > 0)").isEmpty()
    assert toxicity.predict(nothing, chain).isEmpty()
    assert toxicity.fit(docs, known.limit(0)) is None and toxicity.fit(nothing, known) is None
    assert {x["toxic"] for x in toxicity.predict(docs.limit(5), None).collect()} == {False}


def exact_neighbours(ids, vectors, k=20):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            score = [(-float((vectors[i] * vectors[j]).sum()), ids[j]) for j in range(len(ids)) if ids[j] != ids[i]]
            out[ids[i]] = [(v, -s) for s, v in sorted(score)[:k]]
    return out


def test_neighbours_small_tables_are_exact(spark):
    r = np.random.default_rng(4)
    vectors = np.round(r.normal(size=(300, 6)), 1).astype(np.float32)  # many ties
    vectors[100:160] = vectors[100]
    data = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    odd = [(1000, None, 1), (1020, [0.0] * 6, 1), (1040, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1060, [float("nan")] * 6, 1),
           (1080, [float("inf")] * 6, 1), (1100, [1.0], 1), (None, [1.0] * 6, 1)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, score int")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, least_visited=1000).collect()
    keep = [i for i in range(300) if vectors[i].any()]
    want = exact_neighbours(keep, vectors.astype(np.float64)[keep])
    found = {}
    for x in sorted(got, key=lambda x: (x["query_id"], x["rank"])):
        found.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert {q: [v for v, _ in n] for q, n in found.items()} == {q: [v for v, _ in n] for q, n in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(found[q], want[q]))
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).isEmpty()
    few = neighbours.search(df.filter("vec_id < 4"), F.col("vec_id") % 20 == 0)
    assert few.count() == 3


@pytest.mark.parametrize("rows", [25, 60, 500, 3000])
def test_neighbours_of_small_tables_come_from_the_index(spark, rows):
    """No size is searched whole for the sake of its size; what is found suffices at all of them."""
    r = np.random.default_rng(rows)
    centers = r.normal(size=(10, 16))
    vectors = centers[r.integers(0, 10, rows)] + 0.6 * r.normal(size=(rows, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors.astype(np.float32))], "vec_id long, embedding array<float>")
    query = F.col("vec_id") % 20 == 0
    assert neighbours.recall(neighbours.search(df, query), neighbours.exact_search(df, query)) >= 0.9


@pytest.mark.parametrize("copies", [2, 25])
def test_neighbours_count_repeated_rows_once(spark, copies):
    r = np.random.default_rng(6)
    vectors = r.normal(size=(100, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    repeated = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    got = {}
    for x in neighbours.search(repeated, F.col("vec_id") % 20 == 0, least_visited=1000).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    want = exact_neighbours(range(100), vectors.astype(np.float64))
    assert got == {q: [v for v, _ in found] for q, found in want.items()}


def test_neighbours_recall(spark):
    r = np.random.default_rng(12)
    centers = r.normal(size=(40, 32))
    vectors = centers[r.integers(0, 40, 12_000)] + 0.5 * r.normal(size=(12_000, 32))
    table = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors.astype(np.float32))], "vec_id long, embedding array<float>"
    )
    query = F.col("vec_id") % 400 == 0
    found = neighbours.search(table, query)
    assert neighbours.recall(found, neighbours.exact_search(table, query)) >= 0.9


ALPHABET = ["a", "B", " ", "  ", "\n", "\t", "'", "s", "t", "re", "ve", "ll", "d", "'s", "1", "23", "!", "-", "é", "²", "\xa0",
            "\u2003", "“", "_", "\r\n", "M", "中", "<|endoftext|>", "ß", "Я", "\u200b", "\x1c", "\x00"]


def test_encoder_equals_the_library():
    encoder = token_files.Encoder(byte_bpe_definition(), cached=500)
    assert encoder.by_pieces
    r = random.Random(8)
    for _ in range(150):
        texts = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(30))) for _ in range(12)]
        ids, counts = encoder.many(texts)
        for t, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            assert part.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_files_round_trip(spark, odd, odd_rows, nothing):
    from tokenizers import Tokenizer

    definition = byte_bpe_definition()
    library = Tokenizer.from_str(definition)
    data = [r[:2] for r in odd_rows] + [(100 + i, text(i, i % 50)) for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("start", F.lit("x"))
    folder = token_files.write_token_files(df, definition)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda x: x["start"])
    numbers = [-1 if x["doc_id"] is None else x["doc_id"] for x in got]
    assert numbers == sorted(numbers) and len(got) == len(data)
    start, left = 0, Counter()
    for d, t in data:
        ids = library.encode(t or "", add_special_tokens=False).ids + [token_files.END_ID]
        left[(d, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))] += 1
    for x in got:
        assert x["start"] == start
        start += x["n_tokens"]
        left[(x["doc_id"], x["n_tokens"], x["ids_crc32"])] -= 1
    assert not any(left.values())
    parts = token_files.manifest(spark, folder).collect()
    assert sum(p["tokens"] for p in parts) == start and {p["width"] for p in parts} == {2}
    folder = token_files.write_token_files(nothing, definition)
    assert token_files.read_token_files(spark, folder).isEmpty()


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for verdict, rule in url_filter.RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, *(best or (None, None))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "://x", "http://WWW.Example.COM/en/1?q=/a", "https://a.b.net/es/", "http://net/es/x",
            "http://notnet/es/x", "http://example.com", "http://example.com?x=/en/", "http://xexample.com/en/1", "x://é.Net/fr/ü#a",
            "http://user@host.org:80/path", "http://a.com//en/", "http://casinowin.org/en/1", "http://the.org/en/2"] * 2
    page = "<p>" + "the casino win house and garden " * 5 + "</p>"
    data = [(i, u, page if i % 3 else None) for i, u in enumerate(urls)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("host", F.lit(3))
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(data)
    for i, u, _ in data:
        host, path, rule, verdict = plain_verdict(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")
    split = {r["host"]: r["host_words"] for r in got.values()}
    assert split["casinowin.org"] == "casino win org"
    assert got[15]["verdict"] == "block" and got[16]["verdict"] == "allow"
    assert url_filter.judge(df.limit(0)).isEmpty()


@pytest.mark.parametrize("name", ["thecat", "abcab", "x", "catthethe"])
def test_best_split_equals_all_splits(name):
    words = {"the": 50, "cat": 20, "a": 30, "ab": 10, "cab": 7, "he": 9, "t": 4, "b": 1}

    def cost(split):
        return sum(np.log(words[w] / 1000) if w in words else np.log(1 / 1000) - 2.5 * len(w) for w in split)

    splits = []
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        places = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(name)]
        splits.append([name[a:b] for a, b in zip(places, places[1:])])
    assert abs(cost(url_filter.best_split(name, words, 1000)) - max(map(cost, splits))) < 1e-9


@pytest.mark.parametrize("longest,run", [(24, 1 << 15), (5, 7), (24, 10)])
def test_splits_of_runs_equal_the_plain_recurrence(monkeypatch, longest, run):
    """Names next to each other, and stretches of any length, don't change a split."""
    monkeypatch.setattr(url_filter, "RUN_CHARACTERS", run)
    r = random.Random(2)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(1, 5))): r.randrange(1, 500) for _ in range(25)}

    def plain(name):
        best = [(0.0, [])]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - longest), end):
                word = name[start:end]
                value = np.log(words[word] / 1000) if word in words else np.log(1 / 1000) - 2.5 * len(word)
                options.append((best[start][0] + value, -start, [*best[start][1], word]))
            top = max(options, key=lambda o: (o[0], o[1]))
            best.append((top[0], top[2]))
        return best[-1]

    names = ["".join(r.choice("abé") for _ in range(r.randrange(1, 40))) for _ in range(60)]
    keys = url_filter._word_hashes(list(words))
    order = np.argsort(keys)
    counts = np.array(list(words.values()))[order]
    batch = pa.RecordBatch.from_arrays([pa.array(names)], ["name"])
    for _, part, *run_of in url_filter._runs_of_names(batch, 100):
        for name, found in zip(part, url_filter._splits(part, *run_of, keys[order], counts, 1000, longest)):
            assert "".join(found) == name
            value = sum(np.log(words[w] / 1000) if w in words else np.log(1 / 1000) - 2.5 * len(w) for w in found)
            assert abs(value - plain(name)[0]) < 1e-9


def test_segment_alike_with_and_without_a_held_vocabulary(spark):
    pages = spark.createDataFrame([("<p>the cat sat on the mat and the dog</p>",)] * 3, "html string")
    names = spark.createDataFrame([("thecatsat",), ("dogmat",), ("x" * 50,), ("ondog" * 30,)], "name string")
    one, two = (
        sorted(map(tuple, url_filter.segment(names, pages, held=held).select("name", F.array_join("words", " ")).collect()))
        for held in (10**6, 3)
    )
    assert one == two and ("thecatsat", "the cat sat") in one


def test_a_url_of_a_megabyte_is_judged(spark):
    long = "http://host.org/" + "houseandgarden" * 70_000
    page = "<p>" + "the house and garden " * 5 + "</p>"
    rows_of = [(1, long, page), (2, "http://the.org/" + "q" * 20_000, page),
               (3, "http://" + "a." * 100_000 + "org/" + "b/" * 100_000, page)]
    df = spark.createDataFrame(rows_of, "page_id long, url string, html string")
    got = url_filter.judge(df).select("page_id", F.length("path"), F.length("host_words"), "verdict").collect()
    assert sorted(r[:2] for r in map(tuple, got)) == [(1, 980_001), (2, 20_001), (3, 200_001)]
    assert all(r["verdict"] in ("allow", "block") for r in got)
