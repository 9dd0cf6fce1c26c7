"""SQL of the operators that move centers round by round: one set of tables per round."""


def _round(number, book, mean):
    """Tables of one round: the nearest entry of every part, then the moved book. ``mean`` moves the entries."""
    nearest = f"""
near{number} AS MATERIALIZED (
  SELECT rid, part, min(d * 1024 + entry) % 1024 AS entry, min(d * 1024 + entry) // 1024 AS d FROM (
    SELECT v.rid, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x))::HUGEINT AS d
    FROM v JOIN {book} b ON v.part = b.part AND v.pos = b.pos GROUP BY ALL) GROUP BY ALL)"""
    if not mean:
        return nearest
    return nearest + f""",
book{number + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
    SELECT n.part, n.entry, v.pos, ((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM near{number} n JOIN v ON v.rid = n.rid AND v.part = n.part GROUP BY ALL) m
  ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""


def _rounds(count):
    return ",".join(_round(i, f"book{i}", i < count) for i in range(count + 1))


def codes_sql(parts, entries, rounds, scale):
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
flat AS (
  SELECT rid, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place, len(embedding) // {parts} AS width
  FROM kept),
v AS MATERIALIZED (
  SELECT rid, place // width AS part, place % width AS pos, floor({scale} * x::DOUBLE)::BIGINT AS x FROM flat),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, x FROM v WHERE rid <= {entries}),{_rounds(rounds)},
sums AS (
  SELECT rid, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM near{rounds} GROUP BY rid),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS h FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN sums USING (rid), digest
"""


def clusters_sql(count, rounds, scale, components, seed):
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, embedding) AS rid, vec_id, embedding
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {components}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
v AS MATERIALIZED (
  SELECT rid, 0 AS part, generate_subscripts(embedding, 1) AS pos, floor({scale} * unnest(embedding)::DOUBLE)::BIGINT AS x
  FROM kept),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, x FROM v WHERE rid <= {count}),{_rounds(rounds)},
digests AS (
  SELECT entry, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS h FROM book{rounds} GROUP BY entry)
SELECT vec_id, entry::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY entry))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM kept JOIN near{rounds} USING (rid) JOIN digests USING (entry)
"""
