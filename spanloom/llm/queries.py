"""The registered queries: each applies one operator, with production parameters, to its whole table."""

import pathlib

from pyspark.sql import functions as F

from spanloom.llm import clusters, codes, decontaminate, langid, main_text, minhash, mixing, neighbours, ngram_join
from spanloom.llm import sharding, token_files, toxicity, url_filter
from spanloom.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from spanloom.llm.rounds_sql import clusters_sql, codes_sql


def byte_bpe_definition():
    """JSON text of the public byte-level tokenizer."""
    import public_tokenizers

    return pathlib.Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")


@query("op1_ngram_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5
    THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
""")
def _(t):
    return ngram_join.ngram_components(t.documents).select("doc_id", "n_shingles", "component_id")


@query("op3_mix_sources", r"""
WITH quality AS (SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS w
  FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || d.doc_id), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / coalesce(q.w, 1.0)::DOUBLE AS draw
  FROM documents d LEFT JOIN quality q USING (doc_id)),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM sized GROUP BY source),
leveled AS (
  SELECT *, source_size * 3::DOUBLE AS most,
    (sum(source_size) OVER () - coalesce(sum(source_size * 3::DOUBLE) OVER before, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM src WINDOW before AS (ORDER BY source_size * 3::DOUBLE / w, source NULLS LAST
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT min_by(level, most / w) AS level FROM leveled WHERE most > level * w),
targets AS (
  SELECT source, source_size, CASE WHEN l.most <= l.level * l.w THEN l.most ELSE f.level * l.w END AS target
  FROM leveled l, final f),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
running AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id) AS upto FROM sized)
SELECT r.doc_id, r.size, e.source_size, e.target, (r.size * (e.epochs
    + CASE WHEN e.target > e.epochs * e.source_size
           AND r.upto - r.size / 2 <= e.target - e.epochs * e.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running r JOIN epochs e ON r.source IS NOT DISTINCT FROM e.source
""")
def _(t):
    return mixing.mix_plan(t.documents, t.labels).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_hash_tree_shards")
def _(t):
    return sharding.assign_shards(t.documents)


@query("op2_template_decontamination")
def _(t):
    return decontaminate.contaminated(t.documents, t.benchmark)


@query("op7_multiprobe_neighbours")
def _(t):
    return neighbours.search(t.embeddings, F.col("vec_id") % 20 == 0)


@query("op8_token_files")
def _(t):
    folder = token_files.write_token_files(t.documents, byte_bpe_definition())
    return token_files.read_token_files(t.spark, folder)


@query("op9_language_kernel")
def _(t):
    return langid.predict(t.documents, langid.fit(t.documents))


@query("op4_tag_path_text")
def _(t):
    return main_text.extract(t.pages)


@query("op6_toxicity_chain")
def _(t):
    return toxicity.predict(t.documents, toxicity.fit(t.documents, t.labels))


@query("op10_url_words")
def _(t):
    return url_filter.judge(t.pages)


@query("op11_vector_codes", codes_sql(codes.PARTS, codes.ENTRIES, codes.ROUNDS, codes.SCALE))
def _(t):
    return codes.compress(t.embeddings)


@query(
    "op12_ptolemaic_clusters",
    clusters_sql(clusters.CENTROIDS, clusters.ROUNDS, clusters.SCALE, clusters.COMPONENTS, clusters.SEED),
)
def _(t):
    return clusters.cluster(t.embeddings)


@query("op13_minhash_duplicates", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2
    THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sized AS (SELECT * FROM s JOIN n USING (doc_id)),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
""")
def _(t):
    return minhash.near_duplicates(t.documents)
