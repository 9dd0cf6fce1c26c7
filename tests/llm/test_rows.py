"""Mixing, shards, decontamination and page text against brute force and planted cases."""

import html
import time
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, main_text, mixing, sharding

from .conftest import DOCUMENTS, text


def targets_by_rounds(sizes):
    """The contract's own wording: stop at three times the size, share the excess by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, capped, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        rest = left - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / total for s in names}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        capped.update(over)


def test_mix_reaches_targets(spark):
    data = [(i, text(i, 5 + i % 37), "en", None if i % 11 == 0 else "s%d" % min(i % 40, 9 if i < 380 else 3), 0) for i in range(400)]
    df = spark.createDataFrame(data, DOCUMENTS)
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(0, 400, 2)], "doc_id long, quality int")
    got = mixing.mix_plan(df, labels).collect()
    assert sorted(got) == sorted(mixing.mix_plan(df.repartition(7), labels).collect())
    source = {d[0]: d[3] for d in data}
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in got:
        assert r["size"] == 5 + r["doc_id"] % 37 and r["taken"] <= 3 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        most[source[r["doc_id"]]] = max(most[source[r["doc_id"]]], r["size"])
    want = targets_by_rounds(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6
    copies = Counter(r["doc_id"] for r in mixing.mix(df, labels).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    epochs = defaultdict(set)
    for r in got:
        epochs[source[r["doc_id"]]].add(r["copies"])
    assert all(max(e) - min(e) <= 1 for e in epochs.values())  # whole epochs come first


def test_good_documents_are_taken_more_often(spark):
    df = spark.createDataFrame([(i, "a b c", "en", "big" if i % 2 else "small%d" % (i % 6), 0) for i in range(3000)], DOCUMENTS)
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(3000)], "doc_id long, quality int")
    got = mixing.mix_plan(df, labels).join(labels, "doc_id").filter("doc_id % 2 = 1")
    shares = dict(rows(got.groupBy("quality").agg(F.avg("copies").alias("share")), "quality", "share"))
    assert shares[1] > 1.5 * shares[0]


def test_mix_equal_rows_meet_the_target(spark):
    """One source is mostly copies of one row: as many of them are taken as the budget has room for."""
    data = [(1, "ten words " * 5, "en", "a", 1)] * 300 + [(i, "w%d " % i * 10, "en", "a", 1) for i in range(2, 102)]
    data += [(1000 + i, "v%d " % i * 10, "en", "b", 1) for i in range(317)]
    df = spark.createDataFrame(data, DOCUMENTS).repartition(5)
    for seed in ("mix", "b", "c", "d"):
        plan = mixing.mix_plan(df, seed=seed).join(df.select("doc_id", "source").distinct(), "doc_id").collect()
        taken, target = Counter(), {}
        for r in plan:
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert r["taken"] <= 3 * r["size"]
        assert all(abs(taken[s] - target[s]) <= 10 for s in target)
        copies = Counter((r["doc_id"], r["copies"]) for r in plan)
        mixed = Counter(r["doc_id"] for r in mixing.mix(df, seed=seed).select("doc_id").collect())
        assert mixed[1] == sum(n * c for (d, n), c in copies.items() if d == 1)
    assert len({n for d, n in copies if d == 1}) <= 2


def test_mix_odd_rows(spark, odd, nothing):
    wide = odd.withColumns({"slice": F.lit(1), "taken": F.lit("x")})
    plan = mixing.mix_plan(wide)
    assert plan.count() == odd.count() and plan.filter("size = 0 AND taken <> 0").isEmpty()
    assert mixing.mix(wide).columns == wide.columns
    assert mixing.mix_plan(nothing).isEmpty() and mixing.mix(nothing).isEmpty()


def test_shards(spark, odd, odd_rows, nothing):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("té "), "id").alias("text"))
    got = sharding.assign_shards(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        t = f"té {r['doc_id']}".encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 8, zlib.crc32(t))
        assert r["grown_shard"] in (r["shard"], 24)
    assert set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(100 < len(s) < 250 for s in by.values())
    assert 80 < sum(r["grown_shard"] == 24 for r in got) < 260
    odd_out = sharding.assign_shards(odd.withColumn("_rank", F.lit(1))).collect()
    assert Counter((r["doc_id"], r["size"]) for r in odd_out) == Counter((r[0], len((r[1] or "").encode()) + 8) for r in odd_rows)
    assert sharding.assign_shards(nothing).isEmpty()


def test_weights_move_rows_only_along_changed_subtrees(spark):
    before = (((1, 1), (1, 1)), ((1, 1), (1, 1)))
    after = (((1, 1), (1, 3)), ((1, 1), (1, 1)))  # shard 3 gets heavier
    key = F.col("id")
    moved = spark.range(20000).select(sharding.shard_of(key, before).alias("a"), sharding.shard_of(key, after).alias("b"))
    pairs = {(r["a"], r["b"]): r["n"] for r in moved.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    changed = {p for p in pairs if p[0] != p[1]}
    region = {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1}
    rack = {s: s // 2 for s in range(8)}
    assert changed
    for a, b in changed:
        # Into the heavier region, or inside it into the heavier rack, or inside that into the heavier shard.
        assert region[b] == 0 and (region[a] == 1 or (rack[b] == 1 and (rack[a] == 0 or b == 3)))


QUESTION = ("A train leaves the old station at 9 and travels 120 km to the harbour where Maria waits for 45 minutes before "
            "she walks another 3 miles home")
ASKED_AGAIN = ("A train leaves the old station at 7 and travels 250 km to the harbour where Ines waits for 30 minutes before "
               "she walks another 5 miles home")


def test_decontamination(spark, odd, nothing):
    bench = spark.createDataFrame([(1, QUESTION), (2, text(77, 40)), (3, QUESTION), (4, None), (5, "short one")], "item_id long, text string")
    twice = "If 4 boys buy 4 apples and 4 pears then they carry home 4 bags of fruit from the market in the village"
    chance = "If 4 boys buy 5 apples and 6 pears then they carry home 7 bags of fruit from the market in the village"
    bench = bench.union(spark.createDataFrame([(6, twice)], bench.schema))
    docs = spark.createDataFrame(
        [(1, "Before. " + QUESTION.upper().replace("MARIA", "Maria").lower() + ". After."), (2, "Intro text. " + ASKED_AGAIN + ". The end."),
         (3, text(5, 200)), (4, "x " * 30 + text(77, 40) + " y" * 30), (5, chance),
         (6, twice.replace("4", "9")), (7, text(77, 40).replace(" ", "\n,  "))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) >= {(2, 1), (4, 2), (6, 6), (7, 2)} and set(got) <= {(1, 1), (2, 1), (4, 2), (6, 6), (7, 2)}
    assert got[(4, 2)]["exact"] and not got[(2, 1)]["exact"] and not got[(6, 6)]["exact"]
    left = decontaminate.without_contaminated(docs.withColumn("window", F.lit(1)), bench)
    assert {r["doc_id"] for r in left.collect()} >= {3, 5} and left.columns == ["doc_id", "text", "window"]
    assert decontaminate.contaminated(odd, bench).isEmpty() and decontaminate.contaminated(nothing, bench).isEmpty()
    assert decontaminate.contaminated(docs, bench.limit(0)).isEmpty()
    assert decontaminate.without_contaminated(odd, bench).count() == odd.count()


CASED = ("The teacher Maria asked whether the clever Ines and the quiet Pablo would bring 12 apples to the school in Madrid "
         "before the winter began")


def test_short_questions_match_as_a_whole(spark):
    bench = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "Osmosis"), (3, "two plus two"), (4, "?!")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, text(1, 40) + " who wrote HAMLET? " + text(2, 40)), (2, "Who wrote the Hamlet"), (3, "About osmosis."),
         (4, "Two plus, two!"), (5, "2 plus 2"), (6, "")], "doc_id long, text string")
    assert rows(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "exact") == [(1, 1, True), (3, 2, True), (4, 3, True)]
    assert rows(decontaminate.contaminated(docs, bench, least_tokens=3), "doc_id", "item_id") == [(1, 1), (4, 3)]
    assert decontaminate.without_contaminated(docs, bench).count() == 6
    assert rows(decontaminate.without_contaminated(docs, bench, least_tokens=2), "doc_id") == [(2,), (3,), (5,), (6,)]
    many = [(10, " ".join(["a", "b"] + [f"word{i}" for i in range(20)]))]
    long = spark.createDataFrame([(9, many[0][1][:60])], "item_id long, text string")
    held = spark.createDataFrame(many, "doc_id long, text string")
    assert decontaminate.without_contaminated(held, long).count() == 0
    assert decontaminate.without_contaminated(held, long, least_found=50).count() == 1


def test_decontamination_finds_copies_in_any_case(spark):
    bench = spark.createDataFrame([(1, CASED)], "item_id long, text string")
    copies = [CASED.upper(), CASED.title(), CASED.lower(), CASED]
    docs = spark.createDataFrame([(i, "Some words. " + c + ". More.") for i, c in enumerate(copies)], "doc_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2, 3}
    assert all(r["n_windows"] == r["item_windows"] and r["exact"] for r in got)


def test_decontamination_finds_questions_with_other_values(spark):
    asked = [
        ("Maria buys 3 pens and pays 9 dollars today. Maria then sells 2 pens for 8 dollars each.",
         "Ines buys 5 pens and pays 7 dollars today. Ines then sells 4 pens for 6 dollars each."),
        ("Add 3 kg and 40 g to 5 kg and 60 g, then take 7 kg off.", "Add 8 kg and 10 g to 9 kg and 20 g, then take 4 kg off."),
        ("After lunch the tailor cut 25 strips of cloth for Ann and sewed 25 of them into a long scarf.",
         "After lunch the tailor cut thirty one strips of cloth for Mary Ann and sewed 31 of them into a long scarf."),
        ("The baker sold 12 loaves of bread before noon and the same 12 loaves again after the long break.",
         "THE BAKER SOLD 15 LOAVES OF BREAD BEFORE NOON AND THE SAME 15 LOAVES AGAIN AFTER THE LONG BREAK."),
        # One run of windows with changing values doesn't spoil another.
        ("When 4 boys share 4 apples among them nobody in the small village school has ever been left without a meal of 7 eggs",
         "When 5 boys share 6 apples among them nobody in the large village school has ever been left without a meal of 9 eggs"),
    ]
    bench = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "Some words here. " + d + " More.") for i, (_, d) in enumerate(asked)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(i, i) for i in range(len(asked))}
    assert not any(r["exact"] for i, r in got.items() if i[0] < 4)


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Site</a><p>Slogan, for all.</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, really many of them. Accept, please.</div>
<div id="sidebar"><p>A side story, of some length, that isn't meant. Really not.</p></div>
<main><article><h1>The  head</h1><!-- a comment --><p>First &amp; best paragraph, with <b>bold</b> words,
and <a href="/x">a link</a> in it.<p>Second one; it&#39;s unclosed. It goes on for a while, as texts do.</p>
<div class="ad-slot">Buy now! Cheap, good, fast.</div><ul><li>A point, made.</li><li>Another.</li></ul>
<form><input value="x"><label>Mail</label></form><p>Last&nbsp;words &#8220;here&#x201D;.</p>
<section id="comments"><p>I don't agree, at all, with any of this. Not one word!</p></section></article></main>
<footer>&copy; All rights, reserved. By us.</footer></body></html>"""


def test_main_text(spark):
    want = ("The head First & best paragraph, with bold words, and a link in it. Second one; it's unclosed. It goes on for a "
            "while, as texts do. A point, made. Another. Last words “here”.")
    assert main_text.main_text(PAGE) == want
    assert main_text.main_text("<p>Only one, really.") == "Only one, really."
    assert main_text.main_text("just text, no tags") == "just text, no tags"
    for broken in ("", "<", "<<<>>>", "<p", "<!--", "<script>alert(1)", "<nav>menu</nav>", "</div></p>", "<p a='x>y", None):
        assert isinstance(main_text.main_text(broken), str)
    long = "<article>" + "<p>Some words, again and again.</p>" * 20000 + "</article>"
    assert main_text.main_text(long) == " ".join(["Some words, again and again."] * 20000)
    data = [(1, "u", PAGE), (None, None, None), (2, "u", ""), (2, "u", "")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit(5))
    got = rows(main_text.extract(df), "page_id", "text", "n_chars")
    assert got == sorted([(1, want, len(want)), (None, "", 0), (2, "", 0), (2, "", 0)], key=repr)
    assert main_text.extract(df.limit(0)).isEmpty()


def test_main_text_keeps_links_headings_and_wrappers():
    long = "A long paragraph, with many words in it, goes on and on. It has sentences, too, as texts do."
    body = "<p>%s</p>" % long * 4
    # Words of links in any block, and lists of links between the paragraphs.
    for tag in ("li", "td", "dd", "h2", "blockquote", "div"):
        page = f"<body><article>{body}<{tag}>See <a href=x>the report</a> for more</{tag}>{body}</article></body>"
        assert "See the report for more" in main_text.main_text(page)
    links = "<ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul>"
    menu = "<ul><li><a href=3>Home</a></li><li><a href=4>Contact</a></li></ul>"
    got = main_text.main_text(f"<body>{menu}<div>{body}{links}{body}</div>{menu}</body>")
    assert "First source Second source" in got and "Home" not in got and "Contact" not in got
    # The title beside the body, and a short section next to a long one.
    got = main_text.main_text(f"<body>{menu}<div class=post><h1>The title</h1><div class=body>{body}</div></div></body>")
    assert got == "The title " + " ".join([long] * 4)
    short = "<div><p>%s</p></div>" % long.replace("long", "short")
    got = main_text.main_text(f"<body><div>{body * 6}</div>{short}</body>")
    assert "A short paragraph" in got and got.count("A long paragraph") == 24
    # A wrapper that holds the page's text is no sidebar, whatever its class says.
    for start, end in (("<div class='content with-sidebar'>", "</div>"), ("<form id=aspnetForm>", "</form>")):
        assert main_text.main_text(f"<body>{start}<h1>The title</h1>{body}{end}</body>") == "The title " + " ".join([long] * 4)
    comments = f"<section id=comments>{body * 6}</section>"
    assert main_text.main_text(f"<body><main>{body * 3}</main>{comments}</body>") == " ".join([long] * 12)


def test_main_text_equals_the_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in main_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        plain = inner.replace("<b>", "").replace("</b>", "")
        for tag in ("<p>", "</p>", "<h1>", "</h1>", "<br>"):
            plain = plain.replace(tag, " ")
        assert r["text"] == " ".join(html.unescape(plain).split())


@pytest.mark.parametrize("page,words", [
    ("<a '" * 250_000, None),
    ("<a '" * 250_000 + ">", None),
    ("<b>x" * 100_000, 1),
    ("<b>x" * 50_000 + "</i>" * 50_000 + "<h1>y</h1>" * 50_000, None),
    ("<p><td>" + "<b>" * 50_000 + "<h1></h1>" * 50_000, 0),
    ("<nav>x" * 10_000 + "<article>y" * 10_000, None),
    ("<!--" + "<p>some words, here.</p>" * 20_000, 0),
])
def test_broken_pages_end_within_seconds(page, words):
    begun = time.time()
    found = main_text.main_text(page)
    assert time.time() - begun < 20
    assert words is None or len(found.split()) == words
