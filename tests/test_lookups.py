"""Marked texts, gram indexes, weighted distances and dictionary searches against plain Python."""

import random
import re

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.functions.text import split_token
from spanloom.operators import mentions, norms, similarity
from spanloom.sources import dictionary


# J10
def plain_tokens(text):
    """(start, end) of search tokens: words between blanks with other characters at their ends split off."""
    out = []
    for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text):
        a, b = m.span()
        word = [c.isalnum() or c == "_" for c in m[0]]
        if not any(word):
            out += [(a, b)] if b - a == 1 else [(a, b - 1), (b - 1, b)]
            continue
        low, high = a + word.index(True), b - word[::-1].index(True)
        out += [x for x in ((a, low), (low, high), (high, b)) if x[0] < x[1]]
    return out


def plain_mentions(docs, texts):
    out = set()
    for d, text in docs:
        found = plain_tokens(text or "")
        ends = {e for _, e in found}
        for start, _ in found:
            out |= {(d, start, e, text[start:e]) for e in ends if e > start and text[start:e] in texts}
    return sorted(out)


def random_text(r, n):
    return "".join(r.choice(["ab", "a", "b", "é", " ", " ", "\n", "-", "--", ".", "(", "_", "1", "x."]) for _ in range(n))


@pytest.mark.parametrize("piece_chars,max_pieces", [(2_000_000, 8), (60, 1000), (60, 1)])
def test_mentions_equal_plain_python(spark, piece_chars, max_pieces):
    r = random.Random(3)
    docs = [(i, random_text(r, r.randrange(0, 60))) for i in range(60)] + [(98, None), (99, "")]
    texts = set()
    for _, text in docs:
        for _ in range(6 if text else 0):
            a = r.randrange(len(text))
            texts.add(text[a : a + r.randrange(1, 9)])
    texts = {t for t in texts if t and not t[0].isspace()}
    found = mentions.mentions(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame([(t,) for t in sorted(texts)], "text string"),
        piece_chars=piece_chars, max_pieces=max_pieces,
    )
    assert rows(found, "doc_id", "start", "end", "text") == sorted(plain_mentions(docs, texts), key=repr)
    nothing = mentions.mentions(found.select("doc_id", "text"), found.select("text").limit(0))
    assert nothing.count() == 0


def test_token_starts_agree_with_the_tokenizer(spark):
    r = random.Random(4)
    words = ["".join(r.choice("aé_-.(1") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", split_token(F.col("w")).alias("parts"))
    for word, parts in df.collect():
        starts = np.cumsum([0] + [len(p) for p in parts])[:-1].tolist()
        assert [i for i in range(len(word)) if mentions.starts_token(word, i)] == starts


# J12
def slow_table(a, b, edge=None):
    """Cell by cell, straight from the cost rules."""
    one = lambda c: 10 if c in " -" else 100

    def swap(x, y):
        case = x.isascii() and x.isalpha() and y.isascii() and x.swapcase() == y
        return 10 if case or (x, y) in ((" ", "-"), ("-", "_")) else 50

    row = [0]
    for c in b:
        row.append(row[-1] + (one(c) if edge is None else edge))
    for x in a:
        new = [row[0] + one(x)]
        for j, y in enumerate(b):
            new.append(row[j] if x == y else min(row[j + 1] + one(x), new[j] + one(y), row[j] + swap(x, y)))
        row = new
    return row[-1] if edge is None else min(v + edge * (len(b) - j) for j, v in enumerate(row))


@pytest.mark.parametrize("edge", [None, 1, 7])
def test_distances_equal_the_plain_recurrence(edge):
    r = random.Random(1)
    for _ in range(12):
        pairs = [
            tuple("".join(r.choice("abAB -_é") for _ in range(r.choice([0, 1, 3, 8, 20, 60]))) for _ in "ab")
            for _ in range(30)
        ]
        a, b = zip(*pairs)
        want = [slow_table(x, y, edge) for x, y in pairs]
        assert similarity._distances(a, b, edge)[0].tolist() == want
        for limit in (5, 30, 120, 500, 1200):
            assert similarity._distances(a, b, edge, limit)[0].tolist() == [min(w, limit) for w in want]


def test_a_long_name_is_a_table_of_its_own():
    lengths = np.array([10_000, 3, 4, 5, 3], dtype=np.int64)
    groups = similarity._size_groups(lengths, lengths)
    assert [0] in [g.tolist() for g in groups] and sorted(np.concatenate(groups).tolist()) == [0, 1, 2, 3, 4]


def test_distances_of_nulls(spark):
    df = spark.createDataFrame([("ab", "ab"), (None, "x"), ("x", None), ("", "abc"), ("b", "abc")], "a string, b string")
    got = df.select(similarity.weighted_distance("a", "b").alias("w"), similarity.local_cost("a", "b").alias("l")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (None, None), (None, None), (300, 3), (200, 2)]


# J11, J13, J14, J15
def grams(s):
    s = s + "\x01" * (3 - len(s))
    out, seen = set(), {}
    for i in range(len(s) - 2):
        g = s[i : i + 3]
        seen[g] = seen.get(g, 0) + 1
        out.add(g if seen[g] == 1 else f"{g}{seen[g]}")
    return out


def test_an_index_gives_what_the_strings_give(spark):
    r = random.Random(7)
    words = sorted({"".join(r.choice("abcd ") for _ in range(r.randrange(1, 12))).strip() or "a" for _ in range(150)})
    q = spark.createDataFrame([(w,) for w in words[::5]], "query string")
    s = spark.createDataFrame([(w,) for w in [*words, None]], "value string")
    index = similarity.GramIndex(s, buckets=8)
    again = similarity.GramIndex.open(spark, index.folder, buckets=8)
    columns = ("query", "value", "score")
    for t in (0.4, 0.7):
        for how in ("cosine", "overlap"):
            want = rows(similarity.similar(q, s, how, t), *columns)
            assert rows(similarity.similar(q, index, how, t), *columns) == want
            assert rows(similarity.similar(q, again, how, t), *columns) == want
        assert rows(similarity.superstrings(q, again, t), *columns) == rows(similarity.superstrings(q, s, t), *columns)
    one = again.near(spark.createDataFrame([("abc",)], "query string"))
    assert len(one.only) == 1 and one.all().select("gram").distinct().count() < again.all().select("gram").distinct().count()


def plain_search(queries, entities):
    """``entities``: {id: (names, attributes)}. Scores and order as the search documents them."""
    form = lambda s: s.lower().strip().replace("-", " ")

    def score(part, name):
        a, b = form(part), form(name)
        cost = len(b) - len(a) if a in b else 100 * len(a) if not b else slow_table(a, b, 1)
        return 1000 - cost

    def hits(part, attr, threshold):
        asked, out = grams(form(part)), []
        for e, (names, attributes) in entities.items():
            if attr is not None and not any(form(attr) in form(x) for x in attributes):
                continue
            for name in names:
                if len(asked & grams(form(name))) >= threshold * len(asked) - 1e-9:
                    out.append((e, score(part, name)))
        return out

    result = {}
    for number, query in queries:
        found = hits(query, None, 0.7)
        best = max([0, *[s for _, s in found]])
        words = query.split()
        if best == 0 and len(words) == 1:
            found += hits(query, None, 0.5)
            best = max([0, *[s for _, s in found]])
        if best < 900 and len(words) > 1:
            for i in range(1, len(words)):
                head, tail = " ".join(words[:i]), " ".join(words[i:])
                found += hits(head, tail, 0.7) + hits(tail, head, 0.7)
        best = max([0, *[s for _, s in found]])
        top = {}
        for e, s in found:
            top[e] = max(top.get(e, s), s)
        ranked = sorted(((s, e) for e, s in top.items() if s >= best - 200), reverse=True)
        result[number] = [(e, s) for s, e in ranked]
    return result


def test_norm_search_equals_plain_python(spark):
    r = random.Random(11)
    parts = ["calcitonin", "human", "receptor", "beta", "alpha-2", "salmon", "kinase", "mouse", "binding protein", "IL-6"]
    entities = {}
    for i in range(40):
        names = [" ".join(r.sample(parts, r.randrange(1, 4))).title() for _ in range(r.randrange(1, 3))]
        entities[f"P{i}"] = (names, r.sample(["Human", "Salmon", "Mouse house", "Beta-3"], r.randrange(0, 3)))
    text = [
        "\t".join([e, *[f"name:Name:{n}" for n in names], *[f"attr:Organism:{a}" for a in attributes]])
        for e, (names, attributes) in entities.items()
    ]
    lines = spark.createDataFrame(list(enumerate(text)), "line_no int, line string")
    d = dictionary.load_dictionary(lines)
    queries = [(i, " ".join(r.sample(parts, r.randrange(1, 4)))) for i in range(25)]
    queries += [(100, "calcitnon"), (101, "xyzzy"), (102, "kinse human"), (103, "KINASE  Human"), (104, "alpha 2"), (105, "il 6 salmon")]
    q = spark.createDataFrame(queries, "query_id int, query string")
    want = plain_search(queries, entities)
    index = norms.name_index(d)
    for options in ({}, {"index": index}, {"index": index}):
        got = {n: [] for n, _ in queries}
        for row in norms.norm_search(q, d, **options).orderBy("query_id", "rank").collect():
            got[row["query_id"]].append((row["entity_id"], row["score"]))
        assert got == want
    assert sum(map(bool, want.values())) > 20


def test_words_are_found_in_one_pass(spark):
    from spanloom.plans.derived import textbounds
    from spanloom.plans.lexicon import _words
    from spanloom.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    spans = {(r["type"], r["text"]) for r in textbounds(t.documents).select("type", "text").collect()}
    want = sorted({w.lower() for k, w in spans if k == "Org"}), sorted({w for k, w in spans if k == "Person"})
    for df, words in zip(_words(t), want, strict=True):
        assert sorted(r[0] for r in df.collect()) == words and words
        assert "documents.parquet" not in df._jdf.queryExecution().executedPlan().toString()
