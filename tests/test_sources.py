import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import articles as A
from spanloom.operators import norms, subword
from spanloom.operators.spans import runs_to_spans
from spanloom.sources import conll, dictionary, markup, tables
from spanloom.sources.store import ParquetStore, TieredStore, load_store
from spanloom.streaming.flows import discover_urls, should_retrain


def lines(spark, text, doc="d"):
    return spark.createDataFrame([(doc, i, x) for i, x in enumerate(text.split("\n"))], "doc_id string, line_no bigint, line string")


def tagged(spark, *tags):
    data = [("d", i + 1, i * 2, i * 2 + 1, t[0], t[2:]) for i, t in enumerate(tags)]
    return spark.createDataFrame(data, "doc_id string, token_no bigint, start int, end int, tag string, type string")


def test_run_policies(spark):
    t = tagged(spark, "O", "I-a", "I-a", "I-b", "B-b", "B-b", "I-b", "I-a", "I-a")
    got = rows(runs_to_spans(t, "recover", chunk=4), "first_token", "last_token", "type")
    assert got == [(2, 3, "a"), (4, 4, "b"), (5, 5, "b"), (6, 7, "b"), (8, 9, "a")]
    got = rows(runs_to_spans(t, "discard", chunk=4), "first_token", "last_token", "type")
    assert got == [(5, 5, "b"), (6, 7, "b")]
    with pytest.raises(Exception, match="sequence broken"):
        runs_to_spans(t, "fail").collect()


def test_conll_text(spark):
    docs, ents = conll.read_conll_ner(lines(spark, 'The DT O\nU.S. NNP B-ORG\n-LRB- ( O\n" " O\nyes x O\n" " O\n. . O\n\nAda NNP I-PER\nLove NNP I-PER'), "2000")
    assert docs.first()["text"] == 'The U.S. ("yes".\nAda Love\n' or docs.first()["text"].startswith("The U.S. (")
    assert {(r["type"], r["text"]) for r in ents.collect()} == {("ORG", "U.S."), ("PER", "Ada Love")}
    two, _ = conll.read_conll_ner(lines(spark, "a O\n\n-DOCSTART- O\n\nb O\n\nTitle O\n\n--- O\nc O"), "2002")
    assert rows(two, "doc_id", "text") == [("d-doc-1", "a\n"), ("d-doc-2", "b\n"), ("d-doc-3", "Title\n--- c\n")]


def test_conllx(spark):
    text = "# note\n1\tGo\t_\tV\tV<B>\t_\t0\troot\t_\t_\n2\thome\t_\tN\tN\t_\t1\tobj:x\t_\t_\n\n1\tNow\t_\tR\tR\t_\t_\t_\t_\t_"
    docs, toks, rels = conll.read_conllx(lines(spark, text))
    assert docs.first()["text"] == "ROOT Go home\nROOT Now\n"
    assert rows(toks, "ann_id", "type", "start") == [("T1", "ROOT", 0), ("T2", "V_lt_B_gt_", 5), ("T3", "N", 8), ("T4", "ROOT", 13), ("T5", "R", 18)]
    assert rows(rels, "type", "arg1", "arg2") == [("obj_colon_x", "T2", "T3"), ("root", "T1", "T2")]
    malt = conll.malt_to_conllx(lines(spark, "Go\tV\t0\troot\nhome\tN\t1\tobj\n\nNow\tR\t0\troot"))
    assert [r["line"].split("\t")[0] for r in malt.orderBy("line_no").collect()] == ["1", "2", "", "1"]


def test_bio(spark):
    docs = spark.createDataFrame([("d", "Ada  Love went")], "doc_id string, text string")
    got = conll.read_bio_offsets(lines(spark, "0\t3\tAda\t_\t_\t_\tB-P\n5\t9\tLove\t_\t_\t_\tI-P\n\n10\t14\twent\t_\t_\t_\tO"), docs)
    assert rows(got, "ann_id", "type", "text") == [("T1", "P", "Ada  Love")]
    got = conll.read_bio_aligned(lines(spark, "x\ty\tAda\tB-P\nx\ty\tLo\tI-P\nx\ty\tve\tO\n\nx\ty\twent\tO"), docs)
    assert rows(got, "text") == [("Ada  Lo",)]
    with pytest.raises(Exception, match="text mismatch"):
        conll.read_bio_offsets(lines(spark, "0\t3\tEve\t_\t_\t_\tB-P"), docs).collect()


def test_inline_and_pipes(spark):
    docs, found, kinds = markup.read_inline_tags(lines(spark, 'P1\tA <category="X"> flu </category>case\tNo\t<category="Y">pox</category>.'))
    assert docs.first()["text"] == "A  flu case\nNo pox.\n"
    text = docs.first()["text"]
    assert [(text[s:e], t) for _, s, e, t in rows(found, "ann_id", "start", "end", "text")] == [("flu", "flu"), ("pox", "pox")]
    assert rows(kinds, "target", "value") == [("T1", "X"), ("T2", "Y")]
    got = markup.read_pipe_concepts(lines(spark, "00|x|9|Lung|C1|[bpoc]|a|b|1:2,5:4\nnoise"))
    assert rows(got, "type", "start", "end", "concept") == [("bpoc", 5, 9, "C1")]


XML = """<root><document><sentences><sentence id="1"><tokens>
<token id="1"><word>Ada</word><lemma>Ada</lemma><CharacterOffsetBegin>0</CharacterOffsetBegin><CharacterOffsetEnd>3</CharacterOffsetEnd><POS>NNP</POS><NER>PERSON</NER></token>
<token id="2"><word>-LRB-</word><lemma>x</lemma><CharacterOffsetBegin>5</CharacterOffsetBegin><CharacterOffsetEnd>6</CharacterOffsetEnd><POS>$</POS><NER>O</NER></token>
</tokens><basic-dependencies><dep type="nn"><governor idx="1">Ada</governor><dependent idx="2">x</dependent></dep></basic-dependencies></sentence></sentences>
<coreference><coreference><mention><sentence>1</sentence><start>1</start><end>2</end></mention><mention><sentence>1</sentence><start>1</start><end>3</end></mention></coreference></coreference></document></root>"""


def test_parser_xml(spark):
    df = spark.createDataFrame([("d", XML)], "doc_id string, xml string")
    assert markup.xml_text(df).first()["text"] == "Ada  ("
    assert rows(markup.read_parser_xml(df, "pos")["textbounds"], "ann_id", "type") == [("T1", "NNP"), ("T2", "__DOLLAR__")]
    assert rows(markup.read_parser_xml(df, "ner")["textbounds"], "type", "start", "end") == [("PERSON", 0, 3)]
    assert rows(markup.read_parser_xml(df, "basic_dep")["relations"], "type", "arg1", "arg2") == [("nn", "T1", "T2")]
    coref = markup.read_parser_xml(df, "coref")
    assert rows(coref["equivs"], "members") == [(["T1", "T2"],)] and rows(coref["textbounds"], "end") == [(3,), (6,)]


def test_parser_xml_is_read_in_its_row(spark):
    """Sentences and tokens in any order, unknown and repeated ids; nothing of a document is shuffled."""
    token = '<token id="{}"><word>w</word><CharacterOffsetBegin>{}</CharacterOffsetBegin><CharacterOffsetEnd>9</CharacterOffsetEnd><POS>N</POS><NER>O</NER></token>'
    dep = '<dep type="{}"><governor idx="{}">g</governor><dependent idx="{}">d</dependent></dep>'
    sentence = '<sentence id="{}"><tokens>{}</tokens><basic-dependencies>{}</basic-dependencies></sentence>'
    parts = [sentence.format(2, token.format(2, 30) + token.format(1, 20), dep.format("a", 1, 2) + dep.format("b", 1, 7)),
             sentence.format(1, token.format(1, 5), dep.format("c", 1, 1)), sentence.format(3, "", dep.format("d", 1, 1))]
    xml = f"<root><document><sentences>{''.join(parts)}</sentences></document></root>"
    df = spark.createDataFrame([("d", xml), ("none", None), ("odd", "<root><document>")], "doc_id string, xml string")
    found = markup.read_parser_xml(df, "basic_dep")
    assert rows(found["relations"], "ann_id", "line_no", "type", "arg1", "arg2") == [("R1", 1, "c", "T1", "T1"), ("R2", 2, "a", "T2", "T3")]
    assert rows(found["textbounds"], "ann_id", "start") == [("T1", 5), ("T2", 20), ("T3", 30)]
    for df in found.values():
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_pages_and_sitemaps(spark):
    index = spark.createDataFrame([('<sitemapindex xmlns="http://s"><sitemap><loc>https://primicia.com.ve/post-sitemap1.xml</loc></sitemap><sitemap><loc>https://primicia.com.ve/page.xml</loc></sitemap></sitemapindex>',)], "xml string")
    assert rows(markup.sitemap_index(index, markup.SITEMAP_PREFIXES["primicia.com.ve"]), "url") == [("https://primicia.com.ve/post-sitemap1.xml",)]
    html = ('<h1 class="tdb-title-text big">A title</h1><time class="entry-date">May 1</time><div class="tdb-author-name">Ana</div>'
            '<div id="bsf_rt_marker"><p>One <b>two</b></p><p style="x">ad</p><p>Three &amp; four</p></div>'
            '<ul class="tdb-tags"><li><a href="https://elpitazo.net/tag/agua/">agua</a></li></ul><a class="tdb-entry-category" href="/c">News</a>')
    pages = spark.createDataFrame([("https://elpitazo.net/a", html), ("https://other.net/a", html)], "url string, html string")
    got = markup.extract_articles(pages).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["title"], r["author"], r["date"], r["content"]) == ("A title", "Ana", "May 1", "One two\nThree & four")
    assert r["categories"] == ["agua", "News"]


def article(url, minutes=None, title="t", content="c", relevance=None):
    stamp = None if minutes is None else f"2024-01-01 00:{minutes:02d}:00"
    return (url, stamp, title, content, "a", ["x"], None, relevance, None, "SCRAPING")


def frame(spark, *data):
    names = [c.split()[0] for c in A.ARTICLE_SCHEMA.split(", ")]
    df = spark.createDataFrame(list(data), A.ARTICLE_SCHEMA.replace("timestamp", "string"))
    return df.withColumn("last_scraped", F.col("last_scraped").cast("timestamp")).select(*names)


def urls(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def test_store_contract(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "s"))
    store.save(frame(spark, article("u1"), article("u2", 5), article("u3", 9)))
    assert rows(store.get_all(scraped=True, order=["-last_scraped"]), "url") == [("u2",), ("u3",)]
    assert store.get_all(scraped=False).count() == 1 and store.get_all(limit=0).count() == 0 and store.get_all(limit=-1).count() == 3
    assert [r["url"] for r in store.get_all(limit=2, order=["+last_scraped", "+url"]).collect()] == ["u1", "u2"]
    store.save(frame(spark, article("u2", 7, title="new")))
    assert rows(store.get_all(), "url", "title") == [("u1", "t"), ("u2", "new"), ("u3", "t")]
    assert rows(store.filter_known_urls(urls(spark, "u1", "u9")), "url") == [("u9",)]
    assert rows(store.filter_scraped_urls(urls(spark, "u1", "u2")), "url") == [("u1",)]
    assert rows(store.was_scraped(urls(spark, "u1", "u2")), "url", "was_scraped") == [("u1", False), ("u2", True)]
    store.delete(urls(spark, "u3", "nope"))
    assert store.get_all().count() == 2
    for bad in ("", "url", "+", "+nope"):
        with pytest.raises(ValueError):
            store.get_all(order=[bad])
    assert isinstance(load_store("spanloom.sources.store", "ParquetStore", spark, str(tmp_path / "x")), ParquetStore)
    with pytest.raises(TypeError):
        load_store("collections", "OrderedDict")


def test_move_keeps_or_cuts_contents(spark, tmp_path):
    for name, content, kept in (("whole", None, 7000), ("cut", 6000, 6000)):
        store = TieredStore(spark, str(tmp_path / name / "hot"), str(tmp_path / name / "cold"), content=content)
        store.save(frame(spark, article("u1", 1, content="x" * 7000, relevance="IRRELEVANTE"), article("u2", 2)))
        store.move()
        store.move()
        assert rows(store.rows(), "url") == [("u2",)]
        assert rows(store.cold.read().withColumn("n", F.length("content")), "url", "n") == [("u1", kept)]


def test_discover_saves_all_and_hands_on_some(spark, tmp_path):
    store = TieredStore(spark, str(tmp_path / "hot"), str(tmp_path / "cold"))
    store.save(frame(spark, article("u1", 1)))
    maps = tmp_path / "maps"
    maps.mkdir()
    (maps / "a.xml").write_text("<urlset><url><loc>u1</loc></url><url><loc>u5</loc></url><url><loc>u6</loc></url></urlset>")
    stream = spark.readStream.schema("value string").option("wholetext", "true").text(str(maps)).withColumnRenamed("value", "xml")
    seen = []
    assert discover_urls(stream, store, str(tmp_path / "cp"), limit=1, on_batch=lambda b: seen.append(rows(b, "url"))) == 1
    assert seen == [[("u5",)]] and rows(store.rows(), "url") == [("u1",), ("u5",), ("u6",)]
    assert rows(store.get_all(scraped=False), "url") == [("u5",), ("u6",)]
    loss = spark.createDataFrame([(0.2,), (0.3,)], "loss double")
    assert should_retrain(loss) and not should_retrain(loss, 0.5)


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text\n1234567890123456789,"a ""b""\nc"\n')
    assert rows(tables.read_table(spark, str(tmp_path / "t.csv"), "id bigint, text string"), "id", "text") == [(1234567890123456789, 'a "b"\nc')]
    assert tables.read_table_or_empty(spark, str(tmp_path / "none.csv"), "id bigint").count() == 0
    (tmp_path / "u.txt").write_text(" http://a \n\nhttp://b\n")
    assert rows(tables.read_url_list(spark, str(tmp_path / "u.txt")), "url") == [("http://a",), ("http://b",)]
    bad = spark.createDataFrame([('{"a": 1, "z": 2}',)], "json string")
    with pytest.raises(Exception, match="unknown fields"):
        tables.from_json_rows(bad, "a int").collect()


def test_dictionary_search(spark):
    text = "P1\tname:Name:Human Calcitonin\tattr:Organism:Human\nP2\tname:Name:Calcitonin\tattr:Organism:Salmon\nP1\tname:Name:x\nbad\nP3\tfoo"
    d = dictionary.load_dictionary(lines(spark, text).drop("doc_id"))
    q = spark.createDataFrame([(1, "calcitonin"), (2, "Calcitonin salmon"), (3, "calcitonn")], "query_id int, query string")
    got = {}
    for r in norms.norm_search(q, d).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["entity_id"], r["score"]))
    assert got[1] == [("P2", 1000), ("P1", 994)]
    assert got[2][0] == ("P2", 1000)
    assert got[3][0][0] == "P2"


def test_subwords(spark):
    vocab = spark.createDataFrame([("l o w </w>", 5), ("l o w e r </w>", 2), ("n e w e s t </w>", 6), ("w i d e s t </w>", 3), ("h a p p i e r </w>", 2)], "symbols string, freq bigint")
    merges, _ = subword.learn_merges(vocab, 10)
    assert merges[:3] == [("e", "s"), ("es", "t"), ("est", "</w>")]
    words = spark.createDataFrame([("lowest",), ("a",)], "word string")
    got = {r["word"]: r["symbols"] for r in subword.encode(words, merges).collect()}
    assert got["lowest"] == ["low", "est</w>"] and got["a"] == ["a"]
