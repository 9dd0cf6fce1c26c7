"""Single values and small tables that once came out wrong, or are too large for narrow number forms."""

from conftest import rows
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import articles as A
from spanloom.operators import selecting, textual
from spanloom.sources import conll, markup
from spanloom.sources.store import ParquetStore
from spanloom.streaming.flows import discover_urls


def test_equivalence_sets_with_large_line_numbers(spark):
    data = [("d", 1009317314560, "*", "Equiv", ["T1", "T2"]), ("d", 1009317314569, "*", "Equiv", ["T2", "T3"]),
            ("d", 2, "*", "Equiv", ["T8", "T9"])]
    equivs = spark.createDataFrame(data, "doc_id string, line_no long, ann_id string, type string, members array<string>")
    got = rows(selecting.merge_equivs(equivs), "line_no", "members")
    assert got == sorted([(1009317314560, ["T1", "T2", "T3"]), (2, ["T8", "T9"])], key=repr)


def test_sets_of_a_chunk_merge_without_rounds(spark, monkeypatch):
    import random

    draw, schema = random.Random(11), "doc_id string, line_no long, ann_id string, type string, members array<string>"

    def merged(sets):
        groups = []
        for line, members in sorted(sets):
            near = [g for g in groups if g[1] & set(members)]
            groups = [g for g in groups if g not in near] + [(min([line, *(g[0] for g in near)]), set(members).union(*(g[1] for g in near)))]
        return [(line, sorted(ms)) for line, ms in groups]

    def some(doc, step):
        return [(doc, n * step, "*", "Equiv", [f"T{draw.randint(0, 60)}" for _ in range(draw.randint(1, 3))]) for n in range(40)]

    short, long = some("a", 1) + some("b", 3) + [("b", 500, "*", "Equiv", [])], some("c", 30_000)
    calls, rounds = [], selecting.connected_components
    monkeypatch.setattr(selecting, "connected_components", lambda edges: calls.append(1) or rounds(edges))
    for data, times in ((short, 0), (short + long, 1)):
        got = rows(selecting.merge_equivs(spark.createDataFrame(data, schema)), "doc_id", "line_no", "members")
        docs = {d for d, *_ in data}
        want = [(d, *g) for d in docs for g in merged([(n, ms) for doc, n, _, _, ms in data if doc == d and ms])]
        assert got == sorted(want, key=repr) and len(calls) == times


def tokens_of(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = textual.treebank_tokens(docs).orderBy("token_no").collect()
    assert all(text[r["start"] : r["end"]] == r["text"] for r in found if "-" not in r["text"])
    return " ".join(r["text"] for r in found)


def test_neighbouring_contractions(spark):
    assert tokens_of(spark, "gonna wanna go; gimme lemme see") == "gon na wan na go ; gim me lem me see"
    assert tokens_of(spark, "Cannot cannot") == "Can not can not"
    assert tokens_of(spark, "more'n d'ye don't") == "more 'n d' ye do n't"


def test_column_flavors_keep_their_own_blanks(spark):
    lines = [(1, i, f"{w} O") for i, w in enumerate("cuesta $ 5 % hoy ; no ( si ) .".split())]
    df = spark.createDataFrame(lines, "doc_id long, line_no long, line string")
    texts = {f: conll.read_conll_ner(df, f)[0].first()["text"].strip() for f in ("2000", "2002")}
    assert texts == {"2000": "cuesta $5% hoy; no (si).", "2002": "cuesta $ 5 % hoy ; no (si)."}


def test_entities_and_nested_blocks(spark):
    one = spark.createDataFrame([("<b>Inundaci&oacute;n</b> &#8220;hoy&#x201D; &amp;lt; &nbsp;x",)], "h string")
    assert one.select(X.strip_tags(F.col("h"))).first()[0] == "Inundación “hoy” &lt;  x"
    html = ('<div><div id="bsf_rt_marker"><p>Uno</p><div><p>no</p><div>x</div></div><p>Dos</p></div><p>fuera</p></div>')
    other = '<div class="credit-photoleyends">f</div><div>a<div>b</div>c</div><div>d</div>'
    pages = spark.createDataFrame([("https://elpitazo.net/a", html), ("https://primicia.com.ve/a", other)], "url string, html string")
    got = {r["url"]: r["content"] for r in markup.extract_articles(pages).collect()}
    assert got == {"https://elpitazo.net/a": "Uno\nDos", "https://primicia.com.ve/a": "a\nb\nc"}


def test_long_numbers_sort_by_value(spark):
    names = ["a2", "a10", "a" + "9" * 25, "a1" + "0" * 25, "a007", "b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["n"] for r in df.orderBy(X.natural_key(F.col("n"))).collect()]
    assert got == ["a2", "a007", "a10", "a" + "9" * 25, "a1" + "0" * 25, "b"]


def test_patterns_are_those_of_the_engine(spark):
    docs = spark.createDataFrame([(1, "axxb xd")], "doc_id long, text string")

    def hits(pattern):
        return rows(textual.text_occurrences(docs, pattern, "regex"), "start", "text")

    assert hits("(?P<q>xx)d") == [] and hits("x[") == []
    assert hits("x*") == [(1, "xx"), (5, "x")] and hits("x+") == hits("x*")


def test_upsert_keeps_the_higher_version(spark):
    table = spark.createDataFrame([("a", 9, "old"), ("b", 1, "old")], "url string, version long, title string")
    new = spark.createDataFrame([("a", 3, "late"), ("b", 1, "again"), ("c", None, "x")], table.schema)
    assert rows(A.upsert(table, new), "url", "title") == [("a", "old"), ("b", "again"), ("c", "x")]


def test_discovery_loses_no_url_over_a_stop_and_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def arrive(name, urls):
        entries = "".join(f"<url><loc>https://e.org/{u}</loc></url>" for u in urls)
        (folder / name).write_text(f'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{entries}</urlset>')

    def run(**options):
        stream = spark.readStream.schema("value string").option("wholetext", "true").text(str(folder))
        return discover_urls(stream.withColumnRenamed("value", "xml"), store, str(tmp_path / "cp"), **options)

    store, handed = ParquetStore(spark, str(tmp_path / "s"), buckets=3), []
    arrive("one.xml", "abc")
    assert run(limit=1, on_batch=lambda b: handed.extend(r["url"] for r in b.collect())) == 1
    arrive("two.xml", "cde")
    assert run(should_stop=lambda: True) == 0
    assert handed == ["https://e.org/a"]
    assert rows(store.rows(), "url") == [(f"https://e.org/{u}",) for u in "abcde"]


def test_writers_of_one_table_lose_nothing(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "t"), buckets=2)
    empty = store.rows()

    def article(url):
        row = spark.createDataFrame([(url,)], "url string")
        return row.withColumns({f.name: F.lit(None).cast(f.dataType) for f in empty.schema.fields if f.name != "url"})

    taken = []
    claim = store.table._claim

    def late(version, manifest):
        if not taken:  # another writer comes first
            taken.append(version)
            store.table._claim = claim
            store.save(article("other"))
        return claim(version, manifest)

    store.table._claim = late
    store.save(article("mine"))
    assert rows(store.rows(), "url") == [("mine",), ("other",)]
    for i in range(4):
        store.save(article(f"u{i}"))
    assert len(store.table._versions()) == 2 and store.rows().count() == 6
