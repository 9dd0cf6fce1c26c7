"""The learned and drawn parts of operators, computed again another way."""

import math
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import langid, sharding, url_filter

from .conftest import text


# op5
def plain_shard(key, topology, seed="tree"):
    """Draws level by level, each from the key's and the child's name."""

    def draw(name, weight):
        h = xxhash.xxh64_intdigest(f"{seed}/{name}".encode(), 42)
        if key is not None:
            h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), h)
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    def best(children):
        live = [(name, weight) for name, weight in children if weight > 0]
        return live[0][0] if len(live) == 1 else min(live, key=lambda c: draw(*c))[0]

    r = int(best([(str(i), sum(map(sum, region))) for i, region in enumerate(topology)]))
    k = int(best([(f"{r}/{i}", sum(rack)) for i, rack in enumerate(topology[r])]).split("/")[1])
    s = int(best([(f"{r}/{k}/{i}", weight) for i, weight in enumerate(topology[r][k])]).split("/")[2])
    return sum(len(rack) for region in topology[:r] for rack in region) + sum(map(len, topology[r][:k])) + s


def test_shards_follow_the_draws(spark):
    r = random.Random(1)
    keys = [None, 0, -1, 2**63 - 1, -(2**63), *[r.randrange(-(2**62), 2**62) for _ in range(300)], *range(1, 200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    uneven = (((1, 2, 0), (5,)), ((0, 0), (3, 1)), ((2,),))
    for topology in (sharding.TOPOLOGY, sharding.grown(sharding.TOPOLOGY), uneven, ((((4,)),),)):
        got = {row["k"]: row["s"] for row in df.select("k", sharding.shard_of(F.col("k"), topology).alias("s")).collect()}
        assert got == {k: plain_shard(k, topology) for k in keys}


# op9
def test_scores_are_those_of_the_kernel_and_the_ridge():
    """Kernel values from sets, features from an eigenvalue form of the landmarks' kernel, weights by least squares."""
    r = random.Random(3)
    words = {name: ["".join(r.choice(letters) for _ in range(r.randrange(2, 7))) for _ in range(40)]
             for name, letters in (("x", "abcde"), ("y", "cdefgh"), ("z", "mnoé"))}
    data = [(name, " ".join(r.choice(words[name]) for _ in range(r.randrange(3, 30)))) for name in "xyz" for _ in range(10)]
    data += [("x", " ".join(words["x"][:5]))] * 6  # uneven classes
    labels = np.array(["xyz".index(n) for n, _ in data])

    def bins(texts):
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0] + [len(t) for t in raw])
        return langid.presence(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)

    rows = bins([t for _, t in data])
    model = langid._fitted(["x", "y", "z"], labels, rows, 12, 1e-2)

    sets = [set(np.flatnonzero(row).tolist()) for row in rows]
    marks = [s for i in range(3) for s in [x for x, n in zip(sets, labels) if n == i][:4]]

    def kernel(a, b):
        return np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in b] for x in a])

    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    weight = 1 / np.bincount(labels)[labels]
    weight = np.sqrt(weight / weight.sum())[:, None]
    known = np.column_stack([kernel(sets, marks) @ root, np.ones(len(sets))])
    target = np.where(labels[:, None] == np.arange(3), 1.0, -1.0)
    penalty = np.hstack([math.sqrt(1e-2 / len(marks)) * np.eye(len(marks)), np.zeros((len(marks), 1))])
    solved = np.linalg.lstsq(np.vstack([known * weight, penalty]), np.vstack([target * weight, np.zeros((len(marks), 3))]), rcond=None)[0]

    asked = [" ".join(r.choice(words[n]) for _ in range(8)) for n in "xyzxyz"] + [text(4, 30)]
    found = model.scores(bins(asked))
    given = [set(np.flatnonzero(row).tolist()) for row in bins(asked)]
    want = np.column_stack([kernel(given, marks) @ root, np.ones(len(given))]) @ solved
    assert np.abs(found - want).max() < 1e-3
    assert [int(x) for x in found[:6].argmax(axis=1)] == [0, 1, 2, 0, 1, 2]


# op10
def test_odds_are_counted_words(spark):
    seeds = ("casino", "poker")
    body = "the casino wins house garden news house garden the poker"
    pages = [(i, u, f"<p class='the'>{body}</p>") for i, u in enumerate([
        "http://casinohouse.org/news/12", "http://casinohouse.org/news/7", "http://thegarden.org/news", "http://housenews.org/poker/the",
        "http://pokerwins.org/garden", "x", "http://garden.org/wins/3/house"])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge(df, rules=(), seeds=seeds).collect()}

    counts = Counter(w for _ in pages for w in body.split())
    total = sum(counts.values()) + url_filter.SEED_COUNT * len(seeds) + 1
    counts.update({s: url_filter.SEED_COUNT for s in seeds})

    def words(part, mark):
        names = re.findall(r"[a-z]+|[0-9]+", part)
        found = [w for n in names for w in url_filter.best_split(n, counts, total)]
        return [mark + ("#" if w.isdigit() else w) for w in found]

    parts = {}
    for i, url, _ in pages:
        host, path = (url.split("://")[1].split("/", 1) + [""])[:2] if "://" in url else ("", "")
        parts[i] = words(host, "h:"), words("/" + path, "p:")
    bad = {i: any(t[2:] in seeds for t in host) for i, (host, _) in parts.items()}
    heard = {c: Counter(t for i, p in parts.items() if bad[i] == c for side in p for t in side) for c in (True, False)}
    kinds = len({*heard[True], *heard[False]})
    n = Counter(bad.values())

    def odds(token):
        sides = [math.log((heard[c][token] + 1) / (sum(heard[c].values()) + kinds + 1)) for c in (True, False)]
        return sides[0] - sides[1]

    for i, (host, path) in parts.items():
        total_odds = math.log((n[True] + 1) / (n[False] + 1)) + sum(map(odds, host + path))
        assert abs(got[i]["p_block"] - 1 / (1 + math.exp(-total_odds))) < 1e-9, i
        assert got[i]["verdict"] == ("block" if total_odds > 0 else "allow")
    assert sum(bad.values()) == 3
