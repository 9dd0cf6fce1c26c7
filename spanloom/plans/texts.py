"""Queries over document text: lines, occurrences, tokens, scalar functions."""

from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import spans, textual
from spanloom.plans.derived import over_standoff, token_rows
from spanloom.plans.registry import plan

TW = "doc_id, text"

# A cleaned post on one line without characters beyond ASCII.
CLEAN_SQL = r"""regexp_replace(replace(regexp_replace(regexp_replace(replace(translate(lower(text), 'úùüóòíìéèáà', 'uuuooiieeaa'), 'ñ', 'gn'),
  '[.\-:,?]', ' ', 'g'), 'http.+', ' ', 'g'), chr(10), ''), '[^\x00-\x7F]', '', 'g')"""


@plan(
    "s03_lines_with_offsets",
    over_standoff("SELECT doc_id, line_no, line, l_start AS start, l_start+length(line) AS \"end\" FROM lo"),
)
def _(t):
    return textual.lines_with_offsets(t.documents)


@plan(
    "w01_running_offsets",
    over_standoff(
        "SELECT doc_id, i, st AS start, st+length(w) AS \"end\", substring(text, st+1, length(w)) = w AS same "
        "FROM tof JOIN documents USING (doc_id)"
    ),
)
def _(t):
    toks = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    placed = textual.running_offsets(toks, "doc_id", "i", "w")
    same = textual.text_at(F.col("blocks"), F.col("start"), F.length("w")) == F.col("w")
    return placed.join(t.documents.select("doc_id", textual.text_blocks(F.col("text")).alias("blocks")), "doc_id").select(
        "doc_id", "i", "start", "end", same.alias("same")
    )


@plan(
    "c01_clean_post",
    r"""
SELECT doc_id, regexp_replace(regexp_replace(
  replace(translate(lower(text), 'úùüóòíìéèáà', 'uuuooiieeaa'), 'ñ', 'gn'),
  '[.\-:,?]', ' ', 'g'), 'http.+', ' ', 'g') AS cleaned FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", X.clean_post(F.col("text")).alias("cleaned"))


@plan(
    "c02_to_ascii",
    r"SELECT doc_id, regexp_replace(replace(text, chr(10), ''), '[^\x00-\x7F]', '', 'g') AS plain FROM documents",
)
def _(t):
    return t.documents.select("doc_id", X.to_ascii(F.col("text")).alias("plain"))


@plan(
    "c04_strip_tags",
    r"""
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(html, '(?s)<[^>]*>', '', 'g') || ' Inundaci&oacute;n &#8220;hoy&#8221;',
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&oacute;', 'ó'),
  '&#8220;', '“'), '&#8221;', '”').replace('&amp;', '&') AS body FROM pages""",
)
def _(t):
    return t.pages.select("page_id", X.strip_tags(
        F.concat("html", F.lit(" Inundaci&oacute;n &#8220;hoy&#8221;"))).alias("body"))


@plan(
    "c05_drop_blank_lines",
    """
SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10)) AS body
FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", X.drop_blank_lines(F.col("text")).alias("body"))


@plan(
    "c06_language_model_text",
    """
SELECT doc_id, concat(source, chr(10), array_to_string(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: trim(x)), lambda x: x <> ''), '. ')) AS body FROM documents""",
)
def _(t):
    return t.documents.select(
        "doc_id", X.language_model_text(F.col("source"), F.col("text")).alias("body")
    )


@plan(
    "c07_ellipsis",
    "SELECT doc_id, CASE WHEN length(text) > 50 THEN concat(substring(text,1,50),'...') ELSE text END AS cell "
    "FROM documents",
)
def _(t):
    return t.documents.select("doc_id", X.ellipsis(F.col("text"), 50).alias("cell"))


@plan("c08_norm_form", "SELECT p_partkey, replace(trim(lower(p_name)), '-', ' ') AS norm FROM part")
def _(t):
    return t.part.select("p_partkey", X.norm_form(F.col("p_name")).alias("norm"))


@plan(
    "c09_storage_form",
    r"""
SELECT doc_id, i, regexp_replace(regexp_replace(translate(replace(w,' ','_'),
 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ','AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy'),
 '[^\x00-\x7F]','','g'), '[^a-zA-Z0-9_-]', '_', 'g') AS stored
FROM (SELECT doc_id, generate_subscripts(string_split(text,chr(10)),1)-1 AS i, unnest(string_split(text,chr(10))) AS w
      FROM documents)""",
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "w"))
    return lines.select("doc_id", "i", X.storage_form(F.col("w")).alias("stored"))


@plan(
    "c10_map_type",
    """
SELECT page_id,
 replace(replace(replace(replace(replace(replace(replace(replace(url,'<','_lt_'),'>','_gt_'),'+','_plus_'),
  '?','_question_'),'&','_amp_'),':','_colon_'),'.','_period_'),'!','_exclamation_') AS type_name,
 replace(replace(replace(replace(replace(replace(replace(url,'''','__SINGLEQUOTE__'),'"','__DOUBLEQUOTE__'),
  '$','__DOLLAR__'),',','__COMMA__'),'.','__DOT__'),':','__COLON__'),'`','__BACKTICK__') AS pos_name
FROM pages""",
)
def _(t):
    return t.pages.select(
        "page_id", X.map_type(F.col("url")).alias("type_name"), X.escape_pos(F.col("url")).alias("pos_name")
    )


@plan(
    "c11_levenshtein",
    """
WITH n AS (SELECT DISTINCT n_name AS a FROM nation), p AS (SELECT DISTINCT p_name AS a, p_brand FROM part)
SELECT p.a AS name, p_brand AS brand, levenshtein(p.a, p_brand) AS distance FROM p""",
)
def _(t):
    pairs = t.part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")).distinct()
    return pairs.withColumn("distance", F.levenshtein("name", "brand"))


@plan(
    "c12_occurrences",
    r"""
WITH lens AS (SELECT doc_id, string_split_regex(text, '[A-Z][a-z]+ing\b') AS p,
                     regexp_extract_all(text, '[A-Z][a-z]+ing\b') AS h FROM documents),
rows_ AS (SELECT doc_id, generate_subscripts(h,1) AS k, unnest(h) AS hit, p FROM lens WHERE len(h) > 0)
SELECT doc_id, k-1 AS occ_no, hit AS text,
  CAST(sum(length(p[k]) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) - length(hit) AS BIGINT) AS start,
  CAST(sum(length(p[k]) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS "end"
FROM rows_""",
)
def _(t):
    return textual.occurrences(t.documents, "[A-Z][a-z]+ing\\b")


@plan(
    "c13_ngram_set",
    """
WITH n AS (SELECT DISTINCT p_name AS name FROM part),
g AS (SELECT name, substring(name, i, 3) AS gram, i
      FROM (SELECT name, unnest(generate_series(1, length(name)-2)) AS i FROM n WHERE length(name) >= 3)),
k AS (SELECT name, gram, row_number() OVER (PARTITION BY name, gram ORDER BY i) AS r FROM g)
SELECT name, CASE WHEN r = 1 THEN gram ELSE concat(gram, CAST(r AS varchar)) END AS gram FROM k""",
)
def _(t):
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    return names.select("name", F.explode(X.ngram_set(F.col("name"))).alias("gram"))


@plan(
    "c14_ptb_escape",
    """
SELECT page_id, replace(replace(replace(replace(replace(replace(html,'(','-LRB-'),')','-RRB-'),'[','-LSB-'),
 ']','-RSB-'),'{','-LCB-'),'}','-RCB-') AS escaped, html = html AS restored FROM pages""",
)
def _(t):
    escaped = X.ptb_escape(F.col("html"))
    return t.pages.select(
        "page_id", escaped.alias("escaped"), (X.ptb_unescape(escaped) == F.col("html")).alias("restored")
    )


WS_TOKENS = r"""
tk0 AS (SELECT doc_id, string_split_regex(text, '\S+') AS p, regexp_extract_all(text, '\S+') AS h FROM documents),
tk1 AS (SELECT doc_id, generate_subscripts(h,1) AS k, unnest(h) AS w,
         unnest(list_transform(p[:len(h)], lambda x: length(x))) AS gap FROM tk0 WHERE len(h) > 0),
tk AS (SELECT doc_id, k-1 AS token_no, w AS text,
  CAST(sum(gap + length(w)) OVER (PARTITION BY doc_id ORDER BY k) - length(w) AS BIGINT) AS st,
  CAST(sum(gap + length(w)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS en FROM tk1)"""


@plan("c15_whitespace_tokens", "WITH " + WS_TOKENS + ' SELECT doc_id, token_no, text, st AS start, en AS "end" FROM tk')
def _(t):
    return textual.tokens(t.documents, "whitespace")


@plan("c15_treebank_tokens")
def _(t):
    toks = textual.tokens(t.documents, "treebank", same="same")
    return toks.select("doc_id", "token_no", "start", "end", F.col("text").alias("token"), "same")


SEARCH_TOKENS = (
    WS_TOKENS
    + r""",
sk0 AS (SELECT doc_id, token_no, st, text AS w,
   regexp_extract(text, '^([^\p{L}\p{M}\p{N}\p{Pc}]+).', 1) AS lead0 FROM tk),
sk1 AS (SELECT *, CASE WHEN regexp_full_match(w, '[^\p{L}\p{M}\p{N}\p{Pc}]+') THEN substring(w,1,length(w)-1)
                       ELSE regexp_extract(w, '^[^\p{L}\p{M}\p{N}\p{Pc}]*') END AS pre FROM sk0),
sk2 AS (SELECT *, substring(w, length(pre)+1) AS rest FROM sk1),
sk3 AS (SELECT *, CASE WHEN regexp_full_match(rest, '[^\p{L}\p{M}\p{N}\p{Pc}]+') THEN substring(rest, 2)
                       ELSE regexp_extract(rest, '[^\p{L}\p{M}\p{N}\p{Pc}]*$') END AS post FROM sk2),
sk AS (SELECT doc_id, token_no, st AS start, pre AS text FROM sk3 WHERE pre <> ''
  UNION ALL SELECT doc_id, token_no, st+length(pre), substring(rest,1,length(rest)-length(post)) FROM sk3
  UNION ALL SELECT doc_id, token_no, st+length(w)-length(post), post FROM sk3 WHERE post <> '')"""
)


@plan("c16_search_tokens", "WITH " + SEARCH_TOKENS + ' SELECT *, start+length(text) AS "end" FROM sk')
def _(t):
    return textual.search_tokens(textual.whitespace_tokens(t.documents)).drop("part_no")


@plan(
    "c17_newline_sentences",
    r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text,chr(10)),1) AS k,
                  unnest(string_split(text,chr(10))) AS line, text FROM documents),
o AS (SELECT *, CAST(sum(length(line)+1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS BIGINT) AS off
      FROM l),
x AS (SELECT doc_id, k, line, off, regexp_extract(line, '^\s*') AS lead FROM o WHERE regexp_matches(line, '\S')),
z AS (SELECT *, max(k) OVER (PARTITION BY doc_id) AS last_k FROM x)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS sentence_no, off + length(lead) AS start,
  off + CASE WHEN k = last_k THEN length(regexp_replace(line, '\s+$', '')) ELSE length(line) END AS "end"
FROM z""",
)
def _(t):
    return textual.sentences(t.documents, "newline")


@plan("c17_regex_sentences")
def _(t):
    return textual.sentences(t.documents, "regex")


@plan("c18_sentence_newlines")
def _(t):
    return textual.sentence_newlines(t.documents, textual.sentences(t.documents, "regex")).select("doc_id", "text")


@plan(
    "c19_case_words",
    r"""
SELECT doc_id, i, CASE WHEN regexp_matches(w,'^[A-Z][a-z]{2,}') THEN concat(lower(substring(w,1,1)), substring(w,2))
  ELSE w END AS w FROM (SELECT doc_id, generate_subscripts(string_split(text,' '),1)-1 AS i,
  unnest(string_split(text,' ')) AS w FROM documents)""",
)
def _(t):
    cased = t.documents.select("doc_id", X.case_words(F.col("text")).alias("text"))
    return cased.select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))


@plan(
    "c20_id_space",
    r"""
SELECT page_id, CASE WHEN contains(url, ':') THEN
   CASE WHEN regexp_full_match(split_part(url,':',1), '[a-z]*') THEN upper(split_part(url,':',1))
        ELSE split_part(url,':',1) END
  ELSE regexp_extract(url, '^(.[A-Za-z_]+)', 1) END AS space FROM pages""",
)
def _(t):
    return t.pages.select("page_id", X.id_space(F.col("url")).alias("space"))


@plan(
    "c23_natural_order",
    r"""
SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY
  CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) % 97, c_custkey) AS place
FROM customer""",
)
def _(t):
    from pyspark.sql import Window

    short = F.concat(F.lit("C"), (F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long") % 97).cast("string"))
    order = Window.partitionBy("c_mktsegment").orderBy(X.natural_key(short), "c_custkey")
    return t.customer.select("c_custkey", F.row_number().over(order).alias("place"))


@plan(
    "c24_split_role",
    r"""
SELECT DISTINCT p_brand AS name, regexp_extract(p_brand, '^(.+?)[0-9]*$', 1) AS role,
  regexp_extract(p_brand, '([0-9]*)$', 1) AS num FROM part""",
)
def _(t):
    parts = X.split_role(F.col("p_brand"))
    return t.part.select(F.col("p_brand").alias("name"), parts["role"].alias("role"), parts["num"].alias("num")).distinct()


@plan(
    "c25_parse_experiment",
    """
SELECT DISTINCT o_orderpriority AS line,
  CASE WHEN len(string_split(o_orderpriority,'/'))=2 THEN split_part(o_orderpriority,'/',1)
       WHEN len(string_split(o_orderpriority,'-'))=2 THEN split_part(o_orderpriority,'-',1) END AS branch,
  CASE WHEN len(string_split(o_orderpriority,'/'))=2 THEN split_part(o_orderpriority,'/',2)
       WHEN len(string_split(o_orderpriority,'-'))=2 THEN split_part(o_orderpriority,'-',2) END AS experiment
FROM orders""",
)
def _(t):
    pair = X.parse_experiment(F.col("o_orderpriority"))
    return t.orders.select(
        F.col("o_orderpriority").alias("line"), pair["branch"].alias("branch"), pair["experiment"].alias("experiment")
    ).distinct()


@plan(
    "c26_span_text",
    over_standoff(
        "SELECT r.doc_id, r.ann_id, concat(x.text, ' ', y.text) AS text FROM r "
        "JOIN t x ON x.doc_id=r.doc_id AND x.ann_id=r.arg1 JOIN t y ON y.doc_id=r.doc_id AND y.ann_id=r.arg2"
    ),
)
def _(t):
    from spanloom.plans.derived import standoff

    so = standoff(t.documents)
    span = so.textbounds.select("doc_id", "ann_id", F.col("spans")[0].alias("s"))
    both = (
        so.relations.join(span.withColumnsRenamed({"ann_id": "arg1", "s": "s1"}), ["doc_id", "arg1"])
        .join(span.withColumnsRenamed({"ann_id": "arg2", "s": "s2"}), ["doc_id", "arg2"])
        .join(t.documents.select("doc_id", "text"), "doc_id")
    )
    return both.select("doc_id", "ann_id", X.span_text(F.col("text"), F.array("s1", "s2")).alias("text"))


@plan("c27_squeeze", "SELECT doc_id, regexp_replace(text, ' +', ' ', 'g') AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", X.squeeze(F.col("text")).alias("text"))


@plan(
    "f19_text_match",
    r"""
SELECT doc_id, regexp_matches(text, '(?i)\bthe\b') AS word_hit, contains(lower(text), 'tion') AS substring_hit,
  regexp_matches(text, '[A-Z][a-z]+ing\b') AS regex_hit, true AS empty_hit, false AS invalid_hit FROM documents""",
)
def _(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        X.text_match(text, "the").alias("word_hit"),
        X.text_match(text, "tion", "substring").alias("substring_hit"),
        X.text_match(text, "[A-Z][a-z]+ing\\b", "regex", match_case=True).alias("regex_hit"),
        X.text_match(text, "***").alias("empty_hit"),
        X.text_match(text, "(", "regex").alias("invalid_hit"),
    )


@plan(
    "m06_softmax",
    """
SELECT p_partkey, round(exp(a-m)/(exp(a-m)+exp(b-m)+exp(c-m)),6) AS s0, round(exp(b-m)/(exp(a-m)+exp(b-m)+exp(c-m)),6) AS s1,
  round(exp(c-m)/(exp(a-m)+exp(b-m)+exp(c-m)),6) AS s2
FROM (SELECT *, greatest(a,b,c) AS m FROM (SELECT p_partkey, p_size/10.0::DOUBLE AS a, p_retailprice/1000 AS b,
  (p_partkey % 7)::DOUBLE AS c FROM part))""",
)
def _(t):
    scores = F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 1000, (F.col("p_partkey") % 7).cast("double"))
    soft = t.part.select("p_partkey", X.softmax(scores).alias("s"))
    return soft.select("p_partkey", *[F.round(F.col("s")[i], 6).alias(f"s{i}") for i in range(3)])


@plan(
    "w02_runs_to_spans",
    over_standoff(
        """SELECT doc_id, CAST(k AS BIGINT) AS entity_no, min(type) AS type, min(st) AS start, max(en) AS "end" FROM (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
    SELECT *, CASE WHEN tag='O' THEN 0 WHEN lag(tag) OVER w IS NULL OR lag(tag) OVER w='O'
                     OR lag(type) OVER w <> type THEN 1 ELSE 0 END AS opens
    FROM tags WINDOW w AS (PARTITION BY doc_id ORDER BY i))) WHERE tag <> 'O' GROUP BY doc_id, k""",
        """tags AS (SELECT doc_id, i, st, st+length(w) AS en, CASE WHEN regexp_matches(w,'^[A-Z]') THEN 'I' ELSE 'O' END AS tag,
           CASE WHEN regexp_matches(w,'^[A-Z]') THEN CASE length(w)%2 WHEN 0 THEN 'Even' ELSE 'Odd' END ELSE '' END AS type
           FROM tof)""",
    ),
)
def _(t):
    toks = token_rows(t.documents)
    big = F.rlike("w", F.lit("^[A-Z]"))
    kind = F.when(big, F.when(F.length("w") % 2 == 0, F.lit("Even")).otherwise(F.lit("Odd"))).otherwise(F.lit(""))
    tagged = toks.select(
        "doc_id",
        F.col("i").alias("token_no"),
        F.col("st").alias("start"),
        (F.col("st") + F.length("w")).alias("end"),
        F.when(big, F.lit("I")).otherwise(F.lit("O")).alias("tag"),
        kind.alias("type"),
    )
    return spans.runs_to_spans(tagged, "recover").select("doc_id", "entity_no", "type", "start", "end")


@plan(
    "w03_chunk_sentences",
    over_standoff(
        "SELECT doc_id, line_no // 10 AS chunk_no, count(*) AS sentences, min(l_start) AS start, "
        "max(l_start+length(line)) AS \"end\" FROM lo GROUP BY doc_id, line_no // 10"
    ),
)
def _(t):
    lines = textual.lines_with_offsets(t.documents).withColumnRenamed("line_no", "sentence_no")
    return spans.chunk_sentences(lines).groupBy("doc_id", "chunk_no").agg(
        F.count(F.lit(1)).alias("sentences"), F.min("start").alias("start"), F.max("end").alias("end")
    )


@plan(
    "a19_sentence_extents",
    "WITH " + WS_TOKENS + """ SELECT doc_id, token_no // 25 AS sentence_no, min(st) AS start, max(en) AS "end"
FROM tk GROUP BY doc_id, token_no // 25""",
)
def _(t):
    toks = textual.whitespace_tokens(t.documents)
    return spans.sentence_extents(toks.withColumn("sentence_no", F.floor(F.col("token_no") / 25)))
