"""Queries over annotations derived from the documents: selection, joins, counts, searches."""

from pyspark.sql import functions as F

from spanloom.operators import searching, selecting, spans, textual
from spanloom.plans.derived import (
    ENTITY_TYPES, TYPES, only_spans, over_standoff, second_textbounds, standoff, textbounds, widened,
)
from spanloom.plans.registry import plan
from spanloom.session import cut_lineage


@plan("f17_entities", over_standoff(
    "SELECT doc_id, ann_id, type FROM t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id=t.doc_id AND e.trig=t.ann_id)"))
def _(t):
    return selecting.entities(standoff(t.documents)).select("doc_id", "ann_id", "type")


@plan("f17_triggers", over_standoff(
    "SELECT doc_id, ann_id, type FROM t WHERE EXISTS (SELECT 1 FROM e WHERE e.doc_id=t.doc_id AND e.trig=t.ann_id)"))
def _(t):
    return selecting.triggers(standoff(t.documents)).select("doc_id", "ann_id", "type")


@plan("f18_type_filter", over_standoff(
    "SELECT doc_id, ann_id, type FROM t WHERE type IN ('Person','Org') AND type NOT IN ('Org')"))
def _(t):
    return selecting.type_filter(textbounds(t.documents), ["Person", "Org"], ["Org"]).select("doc_id", "ann_id", "type")


def _status_notes(t):
    notes = standoff(t.documents).notes
    states = F.when(F.col("line_no") % 3 == 0, F.lit("done")).otherwise(F.lit("open"))
    return notes.withColumns({"type": F.when(F.col("line_no") % 2 == 0, F.lit("STATUS")).otherwise(F.col("type"))}).withColumn(
        "target", F.when(F.col("type") == "STATUS", states).otherwise(F.col("target")))


STATUS_SQL = """st AS (SELECT doc_id, ann_id, CAST(substring(ann_id,2) AS BIGINT) AS num,
  CASE WHEN CAST(substring(ann_id,2) AS BIGINT)%2=0 THEN 'STATUS' ELSE type END AS type,
  CASE WHEN CAST(substring(ann_id,2) AS BIGINT)%2<>0 THEN target
       WHEN CAST(substring(ann_id,2) AS BIGINT)%3=0 THEN 'done' ELSE 'open' END AS target, note FROM n)"""


@plan("f20_doc_status", over_standoff(
    "SELECT doc_id, arg_max(target, num) AS status FROM st WHERE type='STATUS' GROUP BY doc_id", STATUS_SQL))
def _(t):
    return selecting.doc_status(_status_notes(t))


@plan("f20_set_status", over_standoff(
    """SELECT doc_id, ann_id, type, target FROM st WHERE type<>'STATUS' OR doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, concat('#', coalesce((SELECT max(num) FROM st WHERE st.doc_id=labels.doc_id),0)+1),
 'STATUS', 'closed' FROM labels""", STATUS_SQL))
def _(t):
    wanted = t.labels.select("doc_id", F.lit("closed").alias("status"))
    return selecting.set_status(_status_notes(t), wanted).select("doc_id", "ann_id", "type", "target")


J05_SQL = """asg AS (SELECT t.doc_id, t.ann_id, t.type, t.st, lo.line_no, lo.line FROM t JOIN lo ON t.doc_id=lo.doc_id
  AND t.st >= lo.l_start AND t.st < lo.l_start+length(lo.line))"""


@plan("j05_annotations_to_lines", over_standoff("SELECT doc_id, ann_id, type, line_no, line FROM asg", J05_SQL))
def _(t):
    return _line_numbers(t)


def _line_numbers(t):
    ann = textbounds(t.documents).drop("line_no")
    return spans.annotations_to_lines(ann, textual.lines_with_offsets(t.documents)).select(
        "doc_id", "ann_id", "type", "line_no", "line")


@plan("j05_lines_by_label", over_standoff(
    "SELECT doc_id, line_no, type, count(*) AS n FROM asg GROUP BY doc_id, line_no, type", J05_SQL))
def _(t):
    return _line_numbers(t).groupBy("doc_id", "line_no", "type").agg(F.count(F.lit(1)).alias("n"))


@plan("j25_boundary_match", over_standoff(
    """SELECT DISTINCT t.doc_id, line_no, ann_id, type FROM t JOIN lo ON t.doc_id=lo.doc_id
WHERE t.st=lo.l_start OR t.en=lo.l_start+length(lo.line)"""))
def _(t):
    return spans.boundary_match(textbounds(t.documents), textual.lines_with_offsets(t.documents))


COUNT_SQL = "SELECT line, " + ", ".join(f"count(*) FILTER (type='{x}') AS \"{x}\"" for x in TYPES) + " FROM asg GROUP BY line"


@plan("a02_label_counts", over_standoff(COUNT_SQL, J05_SQL))
def _(t):
    return spans.label_counts(_line_numbers(t), TYPES)


@plan("a03_label_matrix", over_standoff(
    "SELECT line, " + ", ".join(f'CAST(least(coalesce("{x}",0),1) AS BIGINT) AS "{x}"' for x in TYPES)
    + ' FROM (SELECT line, "Action","Person","Place","Org" FROM c1 UNION ALL '
    "SELECT line, 0, \"Person\",\"Place\",\"Org\" FROM c2)",
    J05_SQL, "c1 AS (" + COUNT_SQL + ")",
    """asg2 AS (SELECT t.doc_id, t.type, lo.line FROM t2 t JOIN lo ON t.doc_id=lo.doc_id
  AND t.st >= lo.l_start AND t.st < lo.l_start+length(lo.line))""",
    "c2 AS (" + COUNT_SQL.replace("asg", "asg2") + ")"))
def _(t):
    lines = textual.lines_with_offsets(t.documents)
    first = textbounds(t.documents).drop("line_no")
    second = second_textbounds(first)
    a = spans.label_counts(spans.annotations_to_lines(first, lines), TYPES)
    b = spans.label_counts(spans.annotations_to_lines(second, lines), ENTITY_TYPES)
    return spans.label_matrix([a, b], TYPES)


@plan("a04_stack_labels", over_standoff(
    "SELECT line, category FROM (" + " UNION ALL ".join(
        f"SELECT line, '{x}' AS category FROM c1 WHERE \"{x}\">=1" for x in TYPES) + ")",
    J05_SQL, "c1 AS (" + COUNT_SQL + ")"))
def _(t):
    counts = spans.label_counts(_line_numbers(t), TYPES)
    return spans.stack_labels(spans.label_matrix([counts], TYPES), TYPES)


@plan("j06_nesting", over_standoff(
    """SELECT w.doc_id, w.ann_id, w.type, w.st AS start, w.en AS "end" FROM tw w WHERE EXISTS (SELECT 1 FROM t
 WHERE t.doc_id=w.doc_id AND t.ann_id<>w.ann_id AND t.type='Person' AND t.st>=w.st AND t.en<=w.en)"""))
def _(t):
    ann = textbounds(t.documents)
    wide = widened(ann, t.documents)
    return searching.nesting(wide, ann, ["Person"]).select("doc_id", "ann_id", "type", "start", "end")


OV_SQL = """ov AS (SELECT a.doc_id, a.ann_id AS a_id, b.ann_id AS b_id, a.type AS a_type, b.type AS b_type,
  CASE WHEN a.st=b.st AND a.en=b.en THEN 'equal' WHEN b.st<=a.st AND b.en>=a.en THEN 'contained'
       WHEN a.st<=b.st AND a.en>=b.en THEN 'contains' ELSE 'crossing' END AS kind
  FROM tw a JOIN tw b ON a.doc_id=b.doc_id AND a.ann_id<>b.ann_id AND b.st<a.en AND b.en>a.st)"""


@plan("j07_overlaps", over_standoff("SELECT doc_id, a_id, b_id, kind FROM ov", OV_SQL))
def _(t):
    pairs = spans.overlaps(widened(textbounds(t.documents), t.documents))
    return pairs.select("doc_id", F.col("ann_id_a").alias("a_id"), F.col("ann_id_b").alias("b_id"), "kind")


REFS_SQL = """refs AS (
  SELECT doc_id, ann_id AS from_id, 'trigger' AS role, trig AS to_id, true AS hard FROM e
  UNION ALL SELECT x.doc_id, x.ann_id, role, arg, (SELECT count(*) FROM ea y WHERE y.doc_id=x.doc_id AND y.ann_id=x.ann_id)<=1 FROM ea x
  UNION ALL SELECT doc_id, ann_id, 'Arg1', arg1, true FROM r UNION ALL SELECT doc_id, ann_id, 'Arg2', arg2, true FROM r
  UNION ALL SELECT doc_id, '*', 'member', arg1, true FROM r UNION ALL SELECT doc_id, '*', 'member', arg2, true FROM r
  UNION ALL SELECT doc_id, ann_id, 'target', target, true FROM a UNION ALL SELECT doc_id, ann_id, 'target', target, true FROM n
  UNION ALL SELECT doc_id, ann_id, 'target', target, true FROM nm)"""


@plan("j08_resolve_references", over_standoff(
    """SELECT refs.doc_id, from_id, role, to_id, hard, t2.type AS to_type, t2.ann_id IS NOT NULL AS found
FROM refs LEFT JOIN t2 ON t2.doc_id=refs.doc_id AND t2.ann_id=refs.to_id""", REFS_SQL))
def _(t):
    so = standoff(t.documents)
    so = so.with_tables(textbounds=second_textbounds(so.textbounds))
    return selecting.resolve_references(so).select("doc_id", "from_id", "role", "to_id", "hard", "to_type", "found")


@plan("j09_same_text_diff_type", over_standoff(
    """SELECT doc_id, ann_id, type, text FROM t2 WHERE text IN (SELECT text FROM t2 GROUP BY text
HAVING count(DISTINCT type)>1)"""))
def _(t):
    mixed = selecting.same_text_diff_type(second_textbounds(textbounds(t.documents)))
    return mixed.select("doc_id", "ann_id", "type", "text")


from spanloom.plans.texts import SEARCH_TOKENS  # noqa: E402

UNMARKED_SQL = SEARCH_TOKENS + """,
mk AS (SELECT DISTINCT text FROM t2), ln AS (SELECT DISTINCT length(text) AS n FROM mk),
cand AS (SELECT k.doc_id, k.start, k.start + n AS en, substring(d.text, k.start+1, n) AS text
  FROM sk k JOIN documents d USING (doc_id), ln),
hit AS (SELECT c.* FROM cand c WHERE c.text IN (SELECT text FROM mk)
  AND EXISTS (SELECT 1 FROM sk k WHERE k.doc_id=c.doc_id AND k.start+length(k.text)=c.en)),
un AS (SELECT doc_id, start, en, text FROM hit h WHERE NOT EXISTS (SELECT 1 FROM t2 WHERE t2.doc_id=h.doc_id
  AND t2.st<=h.start AND t2.en>=h.en))"""


@plan("j10_partially_marked", over_standoff(
    """SELECT doc_id, start, en AS "end", text, tagged,
  CASE WHEN cut AND tagged = (nt>nu) THEN greatest(nt,nu)-5 ELSE 0 END AS omitted FROM (
  SELECT *, (greatest(nt,nu) > 3*least(nt,nu) AND greatest(nt,nu) > 5) AS cut,
    row_number() OVER (PARTITION BY text, tagged ORDER BY doc_id, start, en) AS rn FROM (
    SELECT *, count(*) FILTER (tagged) OVER (PARTITION BY text) AS nt,
      count(*) FILTER (NOT tagged) OVER (PARTITION BY text) AS nu FROM men))
WHERE NOT cut OR tagged <> (nt>nu) OR rn <= 5""",
    UNMARKED_SQL,
    """men AS (SELECT doc_id, start, en, text, false AS tagged FROM un
  UNION ALL SELECT doc_id, st, en, text, true FROM t2 WHERE text IN (SELECT text FROM un))"""))
def _(t):
    marked = cut_lineage(second_textbounds(textbounds(t.documents)))
    return searching.partially_marked(t.documents, marked)


@plan("w06_compress", over_standoff(
    """SELECT doc_id, ann_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text, tagged ORDER BY doc_id, st, en) AS rn FROM (
  SELECT *, count(*) FILTER (tagged) OVER (PARTITION BY text) AS nt, count(*) FILTER (NOT tagged) OVER (PARTITION BY text) AS nu
  FROM (SELECT *, st%9<>0 AS tagged FROM t)))
WHERE NOT (greatest(nt,nu)>3*least(nt,nu) AND greatest(nt,nu)>5) OR tagged<>(nt>nu) OR rn<=5"""))
def _(t):
    mentions = textbounds(t.documents).withColumn("tagged", F.col("start") % 9 != 0)
    return searching.compress(mentions).select("doc_id", "ann_id", "text")


@plan("j16_merge_split_sentences", over_standoff(
    """SELECT doc_id, min(l_start) AS start, max(l_start+length(line)) AS "end", count(*) AS parts FROM (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM (
    SELECT lo.*, CASE WHEN EXISTS (SELECT 1 FROM tw WHERE tw.doc_id=lo.doc_id AND tw.st<lo.l_start-1 AND tw.en>lo.l_start-1)
       THEN 0 ELSE 1 END AS opens FROM lo)) GROUP BY doc_id, g"""))
def _(t):
    lines = textual.lines_with_offsets(t.documents).select(
        "doc_id", F.col("line_no").alias("sentence_no"), "start", "end")
    merged = spans.merge_split_sentences(lines, widened(textbounds(t.documents), t.documents))
    return merged.select("doc_id", "start", "end", "parts")


@plan("j17_uncaptured_lines", over_standoff(
    "SELECT doc_id, line_no, line FROM lo WHERE line NOT IN (SELECT line FROM asg)", J05_SQL))
def _(t):
    from spanloom.operators.datasets import uncaptured_lines

    lines = textual.lines_with_offsets(t.documents)
    return uncaptured_lines(lines, _line_numbers(t).select("line"), "line").select("doc_id", "line_no", "line")


@plan("j19_search_entities", over_standoff(
    r"""SELECT w.doc_id, w.ann_id, w.st AS start, w.en AS "end" FROM tx w WHERE type IN ('Place','Org')
 AND regexp_matches(text, '(?i)e') AND EXISTS (SELECT 1 FROM tx x WHERE x.doc_id=w.doc_id
 AND x.ann_id<>w.ann_id AND x.type='Person' AND x.st>=w.st AND x.en<=w.en)""",
    "tx AS (SELECT * FROM tw WHERE type<>'Person' UNION ALL SELECT doc_id, ann_id, type, st, en, text FROM t WHERE type='Person')"))
def _(t):
    ann = cut_lineage(textbounds(t.documents))
    wide = widened(ann.filter("type <> 'Person'"), t.documents)
    so = only_spans(wide.unionByName(ann.filter("type = 'Person'")))
    found = searching.search_entities(so, "e", ["Place", "Org"], nested=["Person"], mode="regex")
    return searching.order_matches(found).select("doc_id", "ann_id", "start", "end")


@plan("j20_search_notes", over_standoff(
    """SELECT n.doc_id, n.ann_id, n.target, t.type AS target_type, note FROM n JOIN t ON t.doc_id=n.doc_id AND t.ann_id=n.target
WHERE t.type<>'Org' AND contains(n.note, 'TION')"""))
def _(t):
    found = searching.search_notes(standoff(t.documents), "tion", ignore=["Org"], mode="substring")
    return found.select("doc_id", "ann_id", "target", "target_type", "note")


@plan("j21_search_relations", over_standoff(
    """SELECT r.doc_id, r.ann_id, r.type FROM r JOIN t x ON x.doc_id=r.doc_id AND x.ann_id=r.arg1
  JOIN t y ON y.doc_id=r.doc_id AND y.ann_id=r.arg2 WHERE x.type='Person' AND contains(lower(y.text),'e')
UNION ALL SELECT r.doc_id, '*', 'Equiv' FROM r WHERE EXISTS (SELECT 1 FROM t x WHERE x.doc_id=r.doc_id
  AND x.ann_id IN (r.arg1, r.arg2) AND x.type='Person') AND EXISTS (SELECT 1 FROM t x WHERE x.doc_id=r.doc_id
  AND x.ann_id IN (r.arg1, r.arg2) AND contains(lower(x.text),'e'))"""))
def _(t):
    found = searching.search_relations(standoff(t.documents), arg1_type="Person", arg2="e", mode="substring")
    return found.select("doc_id", "ann_id", "type")


@plan("j22_search_events", over_standoff(
    """SELECT e.doc_id, e.ann_id, t.text AS trigger_text FROM e JOIN t ON t.doc_id=e.doc_id AND t.ann_id=e.trig
WHERE contains(lower(t.text),'e')
 AND EXISTS (SELECT 1 FROM ea JOIN t x ON x.doc_id=ea.doc_id AND x.ann_id=ea.arg WHERE ea.doc_id=e.doc_id AND ea.ann_id=e.ann_id
     AND ea.role='Theme' AND x.type='Person')
 AND EXISTS (SELECT 1 FROM ea JOIN t x ON x.doc_id=ea.doc_id AND x.ann_id=ea.arg WHERE ea.doc_id=e.doc_id AND ea.ann_id=e.ann_id
     AND contains(lower(x.text),'n'))"""))
def _(t):
    found = searching.search_events(
        standoff(t.documents), "e", [{"role": "Theme", "type": "Person"}, {"text": "n"}, {}], mode="substring")
    return found.select("doc_id", "ann_id", "trigger_text")


OCC_SQL = r"""oc0 AS (SELECT doc_id, string_split_regex(text, '[A-Z][a-z]+') AS p, regexp_extract_all(text, '[A-Z][a-z]+') AS h FROM documents),
oc1 AS (SELECT doc_id, generate_subscripts(h,1) AS k, unnest(h) AS hit,
  unnest(list_transform(p[:len(h)], lambda x: length(x))) AS gap FROM oc0 WHERE len(h)>0),
oc AS (SELECT doc_id, hit, CAST(sum(gap+length(hit)) OVER (PARTITION BY doc_id ORDER BY k) - length(hit) AS BIGINT) AS st,
  CAST(sum(gap+length(hit)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS en FROM oc1)"""


@plan("j23_search_text", over_standoff(
    """SELECT doc_id, st AS start, en AS "end", hit AS text FROM oc
WHERE EXISTS (SELECT 1 FROM tw WHERE tw.doc_id=oc.doc_id AND tw.type IN ('Person','Place') AND tw.st<=oc.st AND tw.en>=oc.en)
 AND NOT EXISTS (SELECT 1 FROM tw WHERE tw.doc_id=oc.doc_id AND tw.type='Action' AND tw.st<=oc.st AND tw.en>=oc.en)""", OCC_SQL))
def _(t):
    wide = widened(textbounds(t.documents), t.documents)
    found = searching.search_text(t.documents, wide, "[A-Z][a-z]+", ["Person", "Place"], ["Action"], "regex", True)
    return found.select("doc_id", "start", "end", "text")


@plan("j24_concordance", over_standoff(
    """SELECT t.doc_id, ann_id, substring(d.text, greatest(st-50,0)+1, st-greatest(st-50,0)) AS left_context,
  substring(d.text, st+1, en-st) AS hit, substring(d.text, en+1, 50) AS right_context
FROM t JOIN documents d USING (doc_id) WHERE type='Person'"""))
def _(t):
    found = searching.search_entities(only_spans(textbounds(t.documents)), restrict=["Person"])
    return searching.concordance(found, t.documents).select(
        "doc_id", "ann_id", "left_context", "hit", "right_context")


@plan("o05_order_matches", over_standoff(
    'SELECT doc_id, ann_id, st AS start, en AS "end" FROM t ORDER BY doc_id, st, en DESC LIMIT 500'))
def _(t):
    return searching.order_matches(textbounds(t.documents), 500).select("doc_id", "ann_id", "start", "end")


@plan("a01_type_counts", over_standoff(
    """SELECT kind, type, count(*) AS n FROM (SELECT 'T' AS kind, type FROM t UNION ALL SELECT 'E', type FROM e
UNION ALL SELECT 'A', type FROM a UNION ALL SELECT '#', type FROM n UNION ALL SELECT 'N', type FROM nm) GROUP BY kind, type"""))
def _(t):
    return selecting.type_counts(standoff(t.documents))


@plan("a05_doc_stats", over_standoff(
    """SELECT doc_id,
 (SELECT count(*) FROM t WHERE t.doc_id=d.doc_id AND type<>'Action') AS entities,
 2*(SELECT count(*) FROM r WHERE r.doc_id=d.doc_id) AS relations,
 (SELECT count(*) FROM e WHERE e.doc_id=d.doc_id) AS events, 0::BIGINT AS issues FROM documents d"""))
def _(t):
    return selecting.doc_stats(t.documents, standoff(t.documents))


@plan("a13_arg_counts", over_standoff(
    "SELECT doc_id, ann_id, type, role, count(*) AS n FROM ea GROUP BY doc_id, ann_id, type, role"))
def _(t):
    events = standoff(t.documents).events
    numbered = F.transform("args", lambda a, i: F.struct(
        F.concat(a["role"], (i + 1).cast("string")).alias("role"), a["arg"].alias("arg")))
    return selecting.arg_counts(events.withColumn("args", numbered))


@plan("a14_duplicate_triggers", over_standoff(
    """SELECT doc_id, ann_id, n, g AS "group" FROM (SELECT *, count(*) OVER w AS n, string_agg(ann_id, ',') OVER w AS g0 FROM x
  WINDOW w AS (PARTITION BY doc_id, b, type)) JOIN (SELECT doc_id, b, type, string_agg(ann_id, ',' ORDER BY ann_id) AS g
  FROM x GROUP BY doc_id, b, type) USING (doc_id, b, type) WHERE n > 1""",
    "x AS (SELECT doc_id, ann_id, type, st//100 AS b FROM t WHERE type='Action')"))
def _(t):
    ann = textbounds(t.documents)
    coarse = F.floor(F.col("start") / 100).cast("int")
    ann = ann.withColumn("spans", F.array(F.struct(coarse.alias("start"), (coarse + 1).alias("end"))))
    found = selecting.duplicate_triggers(ann, ["Action"])
    return found.select("doc_id", "ann_id", "n", F.array_join("group", ",").alias("group"))


@plan("a15_merge_equivs", over_standoff(
    """SELECT doc_id, min(num) AS line_no, string_agg(DISTINCT m, ',' ORDER BY m) AS members FROM (
  SELECT r.doc_id, r.num, root, unnest([arg1,arg2]) AS m FROM r JOIN
    (SELECT doc_id, num, min(low) AS root FROM reach GROUP BY doc_id, num) USING (doc_id, num)) GROUP BY doc_id, root""",
    """reach AS (SELECT doc_id, num, num AS low FROM r UNION SELECT b.doc_id, b.num, reach.low FROM reach
  JOIN r a ON a.doc_id=reach.doc_id AND a.num=reach.num JOIN r b ON b.doc_id=a.doc_id
  AND (b.arg1 IN (a.arg1,a.arg2) OR b.arg2 IN (a.arg1,a.arg2)))"""))
def _(t):
    merged = selecting.merge_equivs(standoff(t.documents).equivs)
    return merged.select("doc_id", "line_no", F.array_join("members", ",").alias("members"))


@plan("w04_new_ids", over_standoff(
    """SELECT lo.doc_id, line_no, concat('T', coalesce(top,0) + row_number() OVER (PARTITION BY lo.doc_id ORDER BY line_no)) AS ann_id
FROM lo LEFT JOIN (SELECT doc_id, max(CAST(substring(ann_id,2) AS BIGINT)) AS top FROM t GROUP BY doc_id) m ON m.doc_id=lo.doc_id"""))
def _(t):
    lines = textual.lines_with_offsets(t.documents).select("doc_id", "line_no")
    return selecting.new_ids(textbounds(t.documents), lines, "T", ["line_no"])


@plan("w10_number_roles", over_standoff(
    """SELECT doc_id, ann_id, role, arg, CASE WHEN k=1 THEN role ELSE concat(role, k) END AS numbered_role FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, ann_id, role ORDER BY arg) AS k FROM (
  SELECT doc_id, ann_id, 'Arg' AS role, arg FROM ea))"""))
def _(t):
    events = standoff(t.documents).events
    args = events.select("doc_id", "ann_id", F.explode("args").alias("a")).select(
        "doc_id", "ann_id", F.lit("Arg").alias("role"), F.col("a.arg").alias("arg"))
    return selecting.number_roles(args, ["arg"])
