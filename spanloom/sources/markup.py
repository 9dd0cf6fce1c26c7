"""Web pages, sitemaps, parser XML, inline tags and tagger output as tables."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.offsets import linked_places
from spanloom.functions.text import drop_tags, escape_pos, ptb_unescape, unescaped
from spanloom.functions.urls import netloc, should_scrape, url_allowed
from spanloom.model import SPANS
from spanloom.operators.ranges import row_numbers
from spanloom.operators.selecting import new_ids
from spanloom.operators.spans import runs_to_spans, sentence_extents
from spanloom.operators.textual import numbered_pieces
from spanloom.session import cut_lineage

# Sitemap prefixes of the two supported sites.
SITEMAP_PREFIXES = {
    "elpitazo.net": "https://elpitazo.net/sitemap-pt-post-",
    "primicia.com.ve": "https://primicia.com.ve/post-sitemap",
}
SITE_PREFIXES = {"primicia.com.ve": "https://primicia.com.ve/"}

# Where each site keeps the fields of an article; {} is a class name. The block starts after a pattern and
# ends with the end of the element it lies in; the flag leaves out elements of the same name inside it.
CLASS_TEXT = "(?s)<[^>]*class=\"[^\"]*(?<![\\w-]){}(?![\\w-])[^\"]*\"[^>]*>\\s*(?:<[^>]*>\\s*)*([^<]+)"
ARTICLE_RULES = {
    "elpitazo.net": {
        "title": CLASS_TEXT.format("tdb-title-text"),
        "date": CLASS_TEXT.format("entry-date"),
        "author": CLASS_TEXT.format("tdb-author-name"),
        "tags": "(?s)<a[^>]*href=\"[^\"]*/tag/[^\"]*\"[^>]*>([^<]+)",
        "categories": CLASS_TEXT.format("tdb-entry-category"),
        "block": ("id=\"bsf_rt_marker\"[^>]*>", "div", True),
        "body": "(?s)(<p>.*?</p>)",
    },
    "primicia.com.ve": {
        "title": CLASS_TEXT.format("title-single"),
        "date": "(?s)id=\"namesingle\".*?<small[^>]*>([^<]+)",
        "author": CLASS_TEXT.format("author-link"),
        "tags": CLASS_TEXT.format("badge-primicia"),
        "categories": "$a",
        "block": ("(?s)credit-photoleyends.*?<div[^>]*>", "div", False),
        "body": "(?s)(?:^|>)([^<]+)",
    },
}

# Concept-tagger output lines, and the tags of the inline format.
CONCEPT_LINE = "^[0-9]+\\|"
CONCEPT_PLACE = "^(?:\\d+:\\d+,)*(\\d+):(\\d+)$"
OPEN_TAG = "<category=\"([^\"]+)\">"
ANY_TAG = "<category=\"[^\"]+\">|</category>"


# S08
def sitemap_index(df: DataFrame, prefix: str) -> DataFrame:
    """Urls of the sitemaps an index (column xml) lists, under a site's prefix."""
    locs = df.select(F.explode(F.xpath("xml", F.lit('//*[local-name()="loc"]/text()'))).alias("url"))
    return locs.select(F.trim("url").alias("url")).filter(F.startswith("url", F.lit(prefix)))


# S09
def sitemap_urls(df: DataFrame, prefix=None, white=None, black=None) -> DataFrame:
    """Page urls of a sitemap (column xml); locations of images do not count."""
    path = '//*[local-name()="url"]/*[local-name()="loc"]/text()'
    urls = df.select(F.explode(F.xpath("xml", F.lit(path))).alias("url")).select(F.trim("url").alias("url"))
    if prefix is not None:
        urls = urls.filter(should_scrape(F.col("url"), prefix))
    return urls.filter(url_allowed(F.col("url"), white, black))


# S10
def _block(start, tag, direct):
    """Column function: what follows the first match of ``start`` up to the end of the element that it opened or lies in.

    Elements named ``tag`` inside are counted, so a nested one doesn't end the block; ``direct`` leaves them out.
    """
    opening, tags = re.compile(start), re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I)

    def cut(html):
        found = opening.search(html)
        if found is None:
            return ""
        kept, depth, at = [], 0, found.end()
        for mark in tags.finditer(html, found.end()):
            if not direct or depth == 0:
                kept.append(html[at : mark.start() if direct else mark.end()])
            at = mark.end()
            depth += -1 if mark[1] else 1
            if depth < 0:
                if not direct:
                    kept[-1] = kept[-1][: len(kept[-1]) - (mark.end() - mark.start())]
                return "".join(kept)
        return "".join([*kept, html[at:] if not direct or depth == 0 else ""])

    @F.arrow_udf(T.StringType())
    def block(pages: pa.Array) -> pa.Array:
        return pa.array([None if x is None else cut(x) for x in pages.to_pylist()], pa.string())

    return block


def extract_articles(pages: DataFrame, rules=None) -> DataFrame:
    """Fields of fetched pages (url, html) by the rules of their domain; a missing text is ''.

    ``rules`` maps a domain (``*``: any other) to its patterns. The body joins the paragraphs of the article block with
    newlines; tags are dropped and character references resolved. Pages of other domains are left out.
    """
    rules = ARTICLE_RULES if rules is None else rules
    named = [d for d in rules if d != "*"]
    domain = netloc(F.col("url"))
    rule = F.when(domain.isin(named), domain) if named else F.lit(None).cast("string")
    rows = pages.withColumn("_rule", F.coalesce(rule, F.lit("*")) if "*" in rules else rule).filter("_rule IS NOT NULL")

    def by_domain(expression):
        """The expression that each domain's rule gives, on that domain's pages."""
        out = F.lit(None)
        for d, r in rules.items():
            out = F.when(F.col("_rule") == d, expression(r)).otherwise(out)
        return out

    blocks = [_block(*r["block"])(F.when(F.col("_rule") == d, F.col("html"))) for d, r in rules.items()]
    rows = rows.withColumn("_block", F.coalesce(*blocks))

    def every(source, field):
        return by_domain(lambda r: F.regexp_extract_all(source, F.lit(r[field]), F.lit(1)))

    def first(field):
        return unescaped(F.coalesce(F.get(every(F.col("html"), field), F.lit(0)), F.lit("")))

    paragraphs = F.transform(every(F.col("_block"), "body"), drop_tags)
    marks = F.concat(every(F.col("html"), "tags"), every(F.col("html"), "categories"))
    joined = unescaped(F.array_join(marks, "\x1f"))
    categories = F.when(F.size(marks) > 0, F.split(joined, "\x1f")).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "url",
        first("title").alias("title"),
        F.trim(unescaped(F.array_join(paragraphs, "\n"))).alias("content"),
        first("author").alias("author"),
        categories.alias("categories"),
        first("date").alias("date"),
        F.lit("SCRAPING").alias("source"),
    )


# S17
def read_pipe_concepts(lines: DataFrame) -> DataFrame:
    """Text-bounds from pipe-separated concept lines (doc_id, line_no, line); other lines are skipped.

    Of several positions only the last one counts.
    """
    parts = F.split("line", "\\|")
    place = F.get(parts, F.lit(8))
    rows = lines.filter(F.rlike("line", F.lit(CONCEPT_LINE)) & (F.size(parts) >= 9) & F.rlike(place, F.lit(CONCEPT_PLACE)))
    start = F.regexp_extract(place, CONCEPT_PLACE, 1).cast("int")
    size = F.regexp_extract(place, CONCEPT_PLACE, 2).cast("int")
    rows = rows.select(
        "doc_id", "line_no", F.translate(F.get(parts, F.lit(5)), "[]", "").alias("type"), start.alias("start"),
        (start + size).alias("end"), F.get(parts, F.lit(3)).alias("text"), F.get(parts, F.lit(4)).alias("concept"),
    )
    numbered = row_numbers(rows, ["doc_id"], "line_no", "_n")
    return numbered.select(
        "doc_id", F.concat(F.lit("T"), F.col("_n").cast("string")).alias("ann_id"), "line_no", "type",
        F.array(F.struct("start", "end")).cast(SPANS).alias("spans"), "start", "end", "text", "concept",
    )


# S18
def read_inline_tags(lines: DataFrame):
    """(documents, mentions, categories) from id, title and body with inline category tags.

    Blanks next to a tag move outside it. Each mention is a Disease span with its category as an attribute.
    """
    parts = F.split("line", "\t", 3)

    def clean(text):
        out = F.regexp_replace(text, "(<category[^<>]*>)( +)", "$2$1")
        return F.trim(F.regexp_replace(out, "( +)(</category>)", "$2$1"))

    body = F.translate(F.get(parts, F.lit(2)), "\t", " ")
    marked = lines.select(
        F.get(parts, F.lit(0)).alias("doc_id"),
        F.concat(clean(F.get(parts, F.lit(1))), F.lit("\n"), clean(body), F.lit("\n")).alias("marked"),
    )
    docs = marked.select("doc_id", F.regexp_replace("marked", ANY_TAG, "").alias("text"))
    pieces = marked.select(
        "doc_id",
        F.regexp_extract_all("marked", F.lit(OPEN_TAG), F.lit(1)).alias("types"),
        F.posexplode(F.split("marked", ANY_TAG)).alias("piece_no", "text"),
    )
    before = Window.partitionBy("doc_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int"))
    # Pieces alternate between outside and inside a tag.
    inside = pieces.filter("piece_no % 2 = 1").withColumns(
        {
            "n": F.floor(F.col("piece_no") / 2) + 1,
            "end": F.col("start") + F.length("text"),
            "category": F.get("types", F.floor(F.col("piece_no") / 2).cast("int")),
        }
    )
    tid = F.concat(F.lit("T"), F.col("n").cast("string"))
    mentions = inside.select(
        "doc_id", tid.alias("ann_id"), F.col("n").cast("long").alias("line_no"), F.lit("Disease").alias("type"),
        F.array(F.struct("start", "end")).cast(SPANS).alias("spans"), "start", "end", "text",
    )
    categories = inside.select(
        "doc_id", F.concat(F.lit("A"), F.col("n").cast("string")).alias("ann_id"), F.col("n").cast("long").alias("line_no"),
        F.lit("Category").alias("type"), tid.alias("target"), F.col("category").alias("value"),
    )
    return docs, mentions, categories


DEPENDENCIES = "array<struct<_type:string,governor:struct<_idx:int>,dependent:struct<_idx:int>>>"
PARSER_XML = f"""
document struct<
 sentences:struct<sentence:array<struct<_id:int,
  tokens:struct<token:array<struct<_id:int,word:string,lemma:string,CharacterOffsetBegin:int,CharacterOffsetEnd:int,
   POS:string,NER:string>>>,
  `basic-dependencies`:struct<dep:{DEPENDENCIES}>,
  `collapsed-dependencies`:struct<dep:{DEPENDENCIES}>,
  `collapsed-ccprocessed-dependencies`:struct<dep:{DEPENDENCIES}>>>>,
 coreference:struct<coreference:array<struct<mention:array<struct<sentence:int,start:int,end:int>>>>>>
"""
PARSER_LAYERS = {
    "basic_dep": "basic-dependencies",
    "collapsed_dep": "collapsed-dependencies",
    "collapsed_ccproc_dep": "collapsed-ccprocessed-dependencies",
}


def _parsed(df):
    return df.select("doc_id", F.from_xml("xml", PARSER_XML.replace("\n", "")).alias("x"))


def _in_sentences(items, fields):
    """The items of all sentences with an id as one array of structs, in the order of sentences and their first field."""
    known = F.filter("x.document.sentences.sentence", lambda s: s["_id"].isNotNull() & items(s).isNotNull())

    def each(s, k):
        def cell(x, i):
            first, *others = fields(x, i)
            return F.struct(s["_id"].alias("sentence_no"), first, k.alias("_k"), i.alias("_i"), *others)

        return F.transform(items(s), cell)

    return F.array_sort(F.flatten(F.transform(known, each)))


# S20
def xml_tokens(df: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, token_id, token_no, word, start, end, pos, ner) of parser XML (doc_id, xml).

    A document is one row of XML, so its tokens are numbered in the row.
    """
    toks = _in_sentences(lambda s: s["tokens"]["token"], lambda t, _: [
        t["_id"].alias("token_id"), t["word"].alias("word"), t["CharacterOffsetBegin"].alias("start"),
        t["CharacterOffsetEnd"].alias("end"), t["POS"].alias("pos"), t["NER"].alias("ner")])
    rows = numbered_pieces(_parsed(df), ["doc_id"], toks, "_at", "_t")
    return rows.select(
        "doc_id", "_t.sentence_no", "_t.token_id", "_t.word", "_t.start", "_t.end", escape_pos(F.col("_t.pos")).alias("pos"),
        "_t.ner", (F.col("_at") + 1).cast("long").alias("token_no"),
    )


def xml_sentence_offsets(df: DataFrame) -> DataFrame:
    return sentence_extents(xml_tokens(df))


def xml_text(df: DataFrame) -> DataFrame:
    """(doc_id, text): tokens unescaped and put at their offsets, blanks in between."""
    toks = xml_tokens(df).withColumn("word", ptb_unescape(F.col("word"), xml=True))
    items = toks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token_no", "start", "end", "word"))).alias("w"))
    prev_end = F.transform("w", lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.get("w", i - 1)["end"]))
    pieces = F.zip_with(
        "w", prev_end, lambda x, e: F.concat(F.repeat(F.lit(" "), F.greatest(x["start"] - e, F.lit(0))), x["word"])
    )
    return items.select("doc_id", F.array_join(pieces, "").alias("text"))


def _spans(start, end):
    return F.array(F.struct(start.alias("start"), end.alias("end"))).cast(SPANS)


# S19
def read_parser_xml(df: DataFrame, layer: str) -> dict:
    """Annotation tables of one layer of parser XML: pos, ner, coref or one of three kinds of dependencies."""
    toks = xml_tokens(df)
    tid = F.concat(F.lit("T"), F.col("token_no").cast("string"))
    words = toks.select(
        "doc_id", tid.alias("ann_id"), F.col("token_no").alias("line_no"), F.col("pos").alias("type"),
        _spans(F.col("start"), F.col("end")).alias("spans"), "start", "end",
    )
    if layer == "pos":
        return {"textbounds": words}
    if layer == "ner":
        tagged = toks.select(
            "doc_id", "token_no", "start", "end", F.when(F.col("ner") == "O", "O").otherwise("I").alias("tag"),
            F.col("ner").alias("type"),
        )
        runs = runs_to_spans(tagged, "io")
        return {
            "textbounds": runs.select(
                "doc_id", F.concat(F.lit("T"), F.col("entity_no").cast("string")).alias("ann_id"),
                F.col("entity_no").cast("long").alias("line_no"), "type",
                _spans(F.col("start"), F.col("end")).alias("spans"), "start", "end",
            )
        }
    if layer == "coref":
        return _coreference(df, toks)
    if layer not in PARSER_LAYERS:
        raise ValueError(f"unknown layer {layer!r}")
    # Words and dependencies of a document meet in its row; a token's place is its number less one.
    names = _in_sentences(lambda s: s["tokens"]["token"], lambda t, _: [t["_id"].alias("token_id")])
    deps = _in_sentences(lambda s: s[PARSER_LAYERS[layer]]["dep"], lambda d, i: [
        i.alias("i"), d["_type"].alias("type"), d["governor"]["_idx"].alias("g"), d["dependent"]["_idx"].alias("d")])

    # Written as lists of numbers, so that the XML is read once.
    packed = cut_lineage(_parsed(df).select("doc_id", names.alias("_t"), deps.alias("_d")))
    fields = ("_t.sentence_no", "_t.token_id", "_d.sentence_no", "_d.g", "_d.d", "_d.type")
    packed = packed.withColumn("_links", linked_places(*[F.col(f) for f in fields]))
    linked = numbered_pieces(packed, ["doc_id"], "_links", "_i", "_l").select(
        "doc_id", (F.col("_i") + 1).cast("long").alias("_n"), "_l.type",
        *[F.concat(F.lit("T"), (F.col(f"_l.{c}") + 1).cast("string")).alias(a) for c, a in (("one", "arg1"), ("other", "arg2"))],
    )
    relations = linked.select(
        "doc_id", F.concat(F.lit("R"), F.col("_n").cast("string")).alias("ann_id"), F.col("_n").alias("line_no"), "type",
        F.lit("Governor").alias("arg1_role"), "arg1", F.lit("Dependent").alias("arg2_role"), "arg2",
    )
    return {"textbounds": words, "relations": relations}


def _coreference(df, toks):
    chains = _parsed(df).select("doc_id", F.posexplode("x.document.coreference.coreference").alias("chain", "c"))
    rows = chains.select("doc_id", "chain", F.posexplode("c.mention").alias("i", "m")).select(
        "doc_id", "chain", "i", F.col("m.sentence").alias("sentence_no"), F.col("m.start").alias("first"),
        (F.col("m.end") - 1).alias("last"),
    )
    starts = toks.select("doc_id", "sentence_no", F.col("token_id").alias("first"), "start")
    ends = toks.select("doc_id", "sentence_no", F.col("token_id").alias("last"), "end")
    rows = rows.join(starts, ["doc_id", "sentence_no", "first"]).join(ends, ["doc_id", "sentence_no", "last"])
    rows = row_numbers(rows, ["doc_id"], "chain", "_n", tie=["i"]).withColumn("ann_id", F.concat(F.lit("T"), F.col("_n").cast("string")))
    mentions = rows.select(
        "doc_id", "ann_id", F.col("_n").alias("line_no"), F.lit("Mention").alias("type"),
        _spans(F.col("start"), F.col("end")).alias("spans"), "start", "end",
    )
    sets = rows.groupBy("doc_id", "chain").agg(F.array_sort(F.collect_list(F.struct("_n", "ann_id"))).alias("m"))
    equivs = sets.select(
        "doc_id", F.lit("*").alias("ann_id"), F.col("chain").cast("long").alias("line_no"),
        F.lit("Coreference").alias("type"), F.transform("m", lambda x: x["ann_id"]).alias("members"),
    )
    return {"textbounds": mentions, "equivs": equivs}


# S24
TAGGER = "map<string,struct<type:string,offsets:array<array<int>>,texts:array<string>>>"


def import_tagger(responses: DataFrame, textbounds: DataFrame) -> DataFrame:
    """New text-bounds from tagger responses (doc_id, json); a response with several spans for one item is an error."""
    items = responses.select("doc_id", F.explode(F.from_json("json", TAGGER)).alias("key", "v")).select(
        "doc_id", "key", "v.type", "v.offsets", "v.texts"
    )
    wrong = (F.size("offsets") != 1) | (F.size("texts") != 1) | F.col("type").isNull()
    bad = F.raise_error(F.concat(F.lit("tagger item needs a type and exactly one span: "), F.col("key"))).cast("string")
    rows = items.select(
        "doc_id", F.when(wrong, bad).otherwise(F.col("type")).alias("type"), "key",
        F.col("offsets")[0][0].alias("start"), F.col("offsets")[0][1].alias("end"), F.col("texts")[0].alias("text"),
    )
    numbered = new_ids(textbounds, rows, "T", ["start", "end", "key"])
    last = textbounds.groupBy("doc_id").agg(F.max("line_no").alias("_last"))
    placed = row_numbers(numbered, ["doc_id"], "start", "_n", tie=["end", "key"]).join(last, "doc_id", "left")
    return placed.select(
        "doc_id", "ann_id", (F.coalesce("_last", F.lit(0)) + F.col("_n")).alias("line_no"), "type",
        _spans(F.col("start"), F.col("end")).alias("spans"), "start", "end", "text",
    )
