"""Queries that verify, edit and compare the annotations derived from the documents."""

from pyspark.sql import functions as F

from spanloom.operators import diffing, editing, textual, verifying
from spanloom.plans.derived import over_standoff, second_textbounds, standoff, textbounds, widened
from spanloom.plans.registry import plan
from spanloom.session import cut_lineage
from spanloom.sources.schema import parse_schema

SCHEMA = parse_schema(
    """
[entities]
Person
Place
Org
[events]
Action Theme:Person|Place, Cause?:<ENTITY>
[relations]
near Arg1:Person, Arg2:Place|Org
Equiv Arg1:Person, Arg2:Person, <REL-TYPE>:symmetric-transitive
<OVERLAP> Arg1:Person, Arg2:Place, <OVL-TYPE>:cross|contain
<OVERLAP> Arg1:Org, Arg2:<ANY>, <OVL-TYPE>:cross
[attributes]
flag	Arg:Person|Org
"""
)


@plan("v01_check_types", over_standoff(
    "SELECT doc_id, ann_id, 'AnnotationError' AS severity, concat('Error: ', type, "
    "' is not a known textbound type (check configuration?)') AS description FROM t2 WHERE type='Other'"))
def _(t):
    so = standoff(t.documents)
    return verifying.check_types(so.with_tables(textbounds=second_textbounds(so.textbounds)), SCHEMA)


@plan("v02_check_equivs", over_standoff(
    """SELECT doc_id, unnest([arg1,arg2]) AS ann_id, concat('Equivalence relation Equiv not allowed between ', t1, ' and ', t2) AS description
FROM (SELECT r.*, least(x.type,y.type) AS lo_, greatest(x.type,y.type) AS hi_ FROM r JOIN t x ON x.doc_id=r.doc_id AND x.ann_id=r.arg1
  JOIN t y ON y.doc_id=r.doc_id AND y.ann_id=r.arg2), LATERAL (SELECT DISTINCT a.v AS t1, b.v AS t2 FROM (VALUES (lo_),(hi_)) a(v), (VALUES (lo_),(hi_)) b(v)
  WHERE a.v <= b.v AND NOT (a.v='Person' AND b.v='Person'))"""))
def _(t):
    return verifying.check_equivs(standoff(t.documents), SCHEMA).select("doc_id", "ann_id", "description")


@plan("v03_check_overlaps", over_standoff(
    """SELECT doc_id, a_id AS ann_id, CASE kind WHEN 'equal' THEN concat('Error: ',a_type,' cannot have identical span with ',b_type,' ',b_id)
  WHEN 'contained' THEN concat('Error: ',a_type,' cannot be contained in ',b_type,' (',b_id,')')
  WHEN 'contains' THEN concat('Error: ',a_type,' cannot contain ',b_type,' (',b_id,')')
  ELSE concat('Error: annotation cannot have crossing span with ', b_id) END AS description
FROM ov WHERE a_type<>'Action' AND b_type<>'Action' AND NOT (
  (kind='crossing' AND (a_type='Org' OR b_type='Org' OR (a_type='Person' AND b_type='Place') OR (a_type='Place' AND b_type='Person')))
  OR (kind='contained' AND a_type='Person' AND b_type='Place') OR (kind='contains' AND a_type='Place' AND b_type='Person'))""",
    """ov AS (SELECT a.doc_id, a.ann_id AS a_id, b.ann_id AS b_id, a.type AS a_type, b.type AS b_type,
  CASE WHEN a.st=b.st AND a.en=b.en THEN 'equal' WHEN b.st<=a.st AND b.en>=a.en THEN 'contained'
       WHEN a.st<=b.st AND a.en>=b.en THEN 'contains' ELSE 'crossing' END AS kind
  FROM tw a JOIN tw b ON a.doc_id=b.doc_id AND a.ann_id<>b.ann_id AND b.st<a.en AND b.en>a.st)"""))
def _(t):
    so = standoff(t.documents)
    wide = so.with_tables(textbounds=widened(so.textbounds, t.documents))
    return verifying.check_overlaps(wide, SCHEMA).select("doc_id", "ann_id", "description")


@plan("v04_check_triggers", over_standoff(
    """SELECT doc_id, ann_id, 'AnnotationIncomplete' AS severity, concat('Warning: trigger ', ann_id, ' is not referenced from any event') AS description
FROM t WHERE type='Action' AND st%3=0"""))
def _(t):
    so = standoff(t.documents)
    spots = so.textbounds.filter("start % 3 = 0").select("doc_id", F.col("ann_id").alias("trigger"))
    fewer = so.with_tables(events=so.events.join(spots, ["doc_id", "trigger"], "left_anti"))
    return verifying.check_triggers(fewer, SCHEMA)


@plan("v05_check_relations", over_standoff(
    """SELECT r.doc_id, r.ann_id, concat('Error: near relation Arg1:', x.type, ' Arg2:', y.type, ' not allowed') AS description
FROM r JOIN t x ON x.doc_id=r.doc_id AND x.ann_id=r.arg1 JOIN t y ON y.doc_id=r.doc_id AND y.ann_id=r.arg2
WHERE NOT (x.type='Person' AND y.type IN ('Place','Org'))"""))
def _(t):
    return verifying.check_relations(standoff(t.documents), SCHEMA).select("doc_id", "ann_id", "description")


@plan("v06_check_missing_args", over_standoff(
    """SELECT doc_id, ann_id, 'AnnotationIncomplete' AS severity, 'Incomplete: exactly one Theme argument required for event' AS description
FROM e WHERE theme IS NULL"""))
def _(t):
    return verifying.check_missing_args(standoff(t.documents), SCHEMA)


@plan("v07_check_disallowed_args", over_standoff(
    """SELECT ea.doc_id, ea.ann_id, concat('Error: Action argument Theme cannot be of type ', x.type) AS description
FROM ea JOIN t x ON x.doc_id=ea.doc_id AND x.ann_id=ea.arg WHERE role='Theme' AND x.type='Org'"""))
def _(t):
    return verifying.check_disallowed_args(standoff(t.documents), SCHEMA).select("doc_id", "ann_id", "description")


def _doubled(so):
    """Events whose arguments are all themes."""
    args = F.transform(
        "args",
        lambda a, i: F.struct(
            F.when(i == 0, F.lit("Theme")).otherwise(F.lit("Theme2")).alias("role"), a["arg"].alias("arg")
        ),
    )
    return so.with_tables(events=so.events.withColumn("args", args))


@plan("v08_check_extra_args", over_standoff(
    """SELECT doc_id, ann_id, 'Error: Action cannot take multiple Theme arguments' AS description
FROM e WHERE theme IS NOT NULL AND cause IS NOT NULL"""))
def _(t):
    return verifying.check_extra_args(_doubled(standoff(t.documents)), SCHEMA).select("doc_id", "ann_id", "description")


@plan("v09_check_attributes", over_standoff(
    """SELECT a.doc_id, a.target AS ann_id, 'Error: Place cannot take a flag attribute' AS description
FROM a JOIN t x ON x.doc_id=a.doc_id AND x.ann_id=a.target WHERE x.type='Place'"""))
def _(t):
    return verifying.check_attributes(standoff(t.documents), SCHEMA).select("doc_id", "ann_id", "description")


@plan("v10_verify", over_standoff(
    """SELECT 'check_equivs' AS "check", 'AnnotationError' AS severity, count(*) AS n
FROM (SELECT r.*, least(x.type,y.type) AS lo_, greatest(x.type,y.type) AS hi_ FROM r JOIN t x ON x.doc_id=r.doc_id AND x.ann_id=r.arg1
  JOIN t y ON y.doc_id=r.doc_id AND y.ann_id=r.arg2), LATERAL (SELECT DISTINCT a.v AS t1, b.v AS t2 FROM (VALUES (lo_),(hi_)) a(v), (VALUES (lo_),(hi_)) b(v)
  WHERE a.v <= b.v AND NOT (a.v='Person' AND b.v='Person')), (VALUES (1), (2)) both_members(k)
UNION ALL SELECT 'check_relations', 'AnnotationError', count(*)
FROM r JOIN t x ON x.doc_id=r.doc_id AND x.ann_id=r.arg1 JOIN t y ON y.doc_id=r.doc_id AND y.ann_id=r.arg2
WHERE NOT (x.type='Person' AND y.type IN ('Place','Org'))
UNION ALL SELECT 'check_missing_args', 'AnnotationIncomplete', count(*) FROM e WHERE theme IS NULL
UNION ALL SELECT 'check_disallowed_args', 'AnnotationError', count(*)
FROM ea JOIN t x ON x.doc_id=ea.doc_id AND x.ann_id=ea.arg WHERE role='Theme' AND x.type='Org'
UNION ALL SELECT 'check_attributes', 'AnnotationError', count(*)
FROM a JOIN t x ON x.doc_id=a.doc_id AND x.ann_id=a.target WHERE x.type='Place'"""))
def _(t):
    return verifying.verify(standoff(t.documents), SCHEMA).groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n"))


@plan("v11_check_spans", over_standoff(
    """SELECT t.doc_id, ann_id, substring(d.text, st+1, en-st) AS text, CASE WHEN st%11=0 THEN 'offset exceeds text length'
 WHEN st%7=0 THEN 'start > end' WHEN st%13=0 THEN 'text differs from spans' END AS problem
FROM t JOIN documents d USING (doc_id)"""))
def _(t):
    ann = textbounds(t.documents)
    start, end = F.col("start"), F.col("end")
    far = F.length("t_text").cast("int") + 1
    bad = (
        F.when(start % 11 == 0, F.struct(start.alias("start"), far.alias("end")))
        .when(start % 7 == 0, F.struct(end.alias("start"), start.alias("end")))
        .otherwise(F.struct(start.alias("start"), end.alias("end")))
    )
    broken = ann.join(t.documents.select("doc_id", F.col("text").alias("t_text")), "doc_id").withColumns(
        {
            "real": F.substr("t_text", F.col("start") + 1, F.col("end") - F.col("start")),
            "spans": F.array(bad),
            "text": F.when(start % 13 == 0, F.reverse(F.concat("text", F.lit("x"))))
            .when(start % 2 == 0, F.lit(""))
            .otherwise(F.col("text")),
        }
    ).drop("t_text")
    checked = verifying.check_spans(broken, t.documents)
    # Rows with a problem keep their stored text; report the covered text for all.
    text = F.when(F.col("problem").isNull(), F.col("text")).otherwise(F.col("real"))
    return checked.select("doc_id", "ann_id", text.alias("text"), "problem")


@plan("v12_check_structure", over_standoff(
    """SELECT doc_id, ann_id, 'undefined reference' AS problem, about FROM (
  SELECT doc_id, ann_id, trig AS about FROM e UNION ALL SELECT doc_id, ann_id, arg FROM ea
  UNION ALL SELECT doc_id, ann_id, arg1 FROM r UNION ALL SELECT doc_id, ann_id, arg2 FROM r
  UNION ALL SELECT doc_id, '*', arg1 FROM r UNION ALL SELECT doc_id, '*', arg2 FROM r
  UNION ALL SELECT doc_id, ann_id, target FROM a UNION ALL SELECT doc_id, ann_id, target FROM n
  UNION ALL SELECT doc_id, ann_id, target FROM nm) x WHERE NOT EXISTS (SELECT 1 FROM t2 WHERE t2.doc_id=x.doc_id AND t2.ann_id=x.about)
UNION ALL SELECT e.doc_id, e.ann_id, CASE WHEN t2.ann_id IS NULL THEN 'event without trigger' ELSE 'event with a non-trigger' END, e.trig
FROM e LEFT JOIN t2 ON t2.doc_id=e.doc_id AND t2.ann_id=e.trig WHERE t2.type IS NULL OR t2.type<>'Action'
UNION ALL SELECT n.doc_id, n.ann_id, 'trigger referenced by a non-event', n.target FROM n
  WHERE EXISTS (SELECT 1 FROM e WHERE e.doc_id=n.doc_id AND e.trig=n.target)"""))
def _(t):
    so = standoff(t.documents)
    return verifying.check_structure(so.with_tables(textbounds=second_textbounds(so.textbounds)))


@plan("v13_delete_annotations", over_standoff(
    """SELECT 'event' AS kind, doc_id, ann_id FROM e WHERE NOT EXISTS (SELECT 1 FROM de WHERE de.doc_id=e.doc_id AND de.ann_id=e.ann_id)
UNION ALL SELECT 'textbound', doc_id, ann_id FROM t WHERE (doc_id, ann_id) NOT IN (SELECT doc_id, ann_id FROM gone)
UNION ALL SELECT 'attribute', doc_id, ann_id FROM a WHERE (doc_id, target) NOT IN (SELECT doc_id, ann_id FROM gone)
UNION ALL SELECT 'note', doc_id, ann_id FROM n WHERE (doc_id, target) NOT IN (SELECT doc_id, ann_id FROM gone)
UNION ALL SELECT 'blocked', doc_id, ann_id FROM t WHERE st%2=0 AND (doc_id, ann_id) IN (SELECT doc_id, ann_id FROM used)""",
    "de AS (SELECT * FROM e WHERE st%3=0)",
    """used AS (SELECT doc_id, arg1 AS ann_id FROM r UNION SELECT doc_id, arg2 FROM r
  UNION SELECT doc_id, trig FROM e WHERE st%3<>0 UNION SELECT ea.doc_id, arg FROM ea WHERE (doc_id, ann_id) NOT IN (SELECT doc_id, ann_id FROM de))""",
    """gone AS (SELECT doc_id, ann_id FROM t WHERE st%2=0 AND (doc_id, ann_id) NOT IN (SELECT doc_id, ann_id FROM used)
  UNION SELECT doc_id, trig FROM de)"""))
def _(t):
    so = standoff(t.documents)
    spots = so.textbounds.select("doc_id", F.col("ann_id").alias("trigger"), "start")
    events = so.events.join(spots.filter("start % 3 = 0"), ["doc_id", "trigger"], "left_semi").select("doc_id", "ann_id")
    ids = so.textbounds.filter("start % 2 = 0").select("doc_id", "ann_id").unionByName(events)
    left, blocked = editing.delete_annotations(so, ids)
    out = blocked.select(F.lit("blocked").alias("kind"), "doc_id", "ann_id")
    for kind, df in (("event", left.events), ("textbound", left.textbounds), ("attribute", left.attributes),
                     ("note", left.notes)):
        out = out.unionByName(df.select(F.lit(kind).alias("kind"), "doc_id", "ann_id"))
    return out


@plan("v14_create_spans", over_standoff(
    """SELECT doc_id, concat('T', coalesce(top,0) + row_number() OVER (PARTITION BY doc_id ORDER BY line_no)) AS ann_id, text
FROM (SELECT doc_id, line_no, CASE WHEN line='' THEN nx WHEN nx='' THEN line ELSE concat(line,' ',nx) END AS text, top FROM (
  SELECT lo.*, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nx,
    (SELECT max(CAST(substring(ann_id,2) AS BIGINT)) FROM t WHERE t.doc_id=lo.doc_id) AS top FROM lo) WHERE line_no%2=0 AND nx IS NOT NULL)"""))
def _(t):
    from pyspark.sql import Window

    so = standoff(t.documents)
    lines = textual.lines_with_offsets(t.documents)
    following = F.lead("end").over(Window.partitionBy("doc_id").orderBy("line_no"))
    edits = lines.withColumn("stop", following).filter("line_no % 2 = 0 AND stop IS NOT NULL").select(
        "doc_id",
        F.col("line_no").cast("long").alias("edit_no"),
        F.lit("Org").alias("type"),
        F.array(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("end"))).alias("spans"),
    )
    made = editing.create_spans(so, t.documents, edits, ["Action"]).textbounds
    return made.join(so.textbounds.select("doc_id", "ann_id"), ["doc_id", "ann_id"], "left_anti").select(
        "doc_id", "ann_id", "text")


@plan("v15_apply_arc_edits", over_standoff(
    """SELECT doc_id, ann_id, CASE WHEN num%3=1 THEN arg2 ELSE arg1 END AS arg1, CASE WHEN num%3=1 THEN arg1 ELSE arg2 END AS arg2
FROM r WHERE num%3<>0
UNION ALL SELECT doc_id, concat('R', top + row_number() OVER (PARTITION BY doc_id ORDER BY num)), arg2, arg1 FROM (
  SELECT r.*, max(num) OVER (PARTITION BY doc_id) AS top FROM r) WHERE num%3=2"""))
def _(t):
    so = standoff(t.documents)
    action = F.element_at(F.array(F.lit("delete"), F.lit("reverse"), F.lit("create")), (F.col("line_no") % 3 + 1).cast("int"))
    swap = F.col("line_no") % 3 == 2
    edits = so.relations.select(
        "doc_id",
        F.col("line_no").alias("edit_no"),
        action.alias("action"),
        "type",
        F.when(swap, F.col("arg2")).otherwise(F.col("arg1")).alias("origin"),
        F.when(swap, F.col("arg1")).otherwise(F.col("arg2")).alias("target"),
        F.lit(None).cast("string").alias("old_type"),
        F.lit(None).cast("string").alias("old_target"),
    )
    return editing.apply_arc_edits(so, edits, SCHEMA).relations.select("doc_id", "ann_id", "arg1", "arg2")


@plan("v16_split_events", over_standoff(
    """SELECT doc_id, ann_id, trig AS "trigger", coalesce(theme, cause) AS arg FROM e
UNION ALL SELECT doc_id, concat('E', top + row_number() OVER (PARTITION BY doc_id ORDER BY st)), trig, cause
FROM (SELECT *, max(CAST(substring(ann_id,2) AS BIGINT)) OVER (PARTITION BY doc_id) AS top FROM e) WHERE theme IS NOT NULL AND cause IS NOT NULL"""))
def _(t):
    so = _doubled(standoff(t.documents))
    ids = so.events.filter(F.size("args") == 2).select("doc_id", "ann_id")
    out = editing.split_events(so, ids, ["Theme"]).events
    return out.select("doc_id", "ann_id", "trigger", F.get("args", F.lit(0))["arg"].alias("arg"))


@plan("v17_entities_to_events", over_standoff(
    """SELECT e.doc_id, e.ann_id, e.trig AS "trigger", coalesce(m1.eid, theme) AS theme, coalesce(m2.eid, cause) AS cause FROM e
 LEFT JOIN m m1 ON m1.doc_id=e.doc_id AND m1.tid=theme LEFT JOIN m m2 ON m2.doc_id=e.doc_id AND m2.tid=cause
UNION ALL SELECT doc_id, eid, tid, NULL, NULL FROM m""",
    """m AS (SELECT t.doc_id, t.ann_id AS tid, concat('E', coalesce(top,0)+row_number() OVER (PARTITION BY t.doc_id ORDER BY st)) AS eid
  FROM t LEFT JOIN (SELECT doc_id, count(*) AS top FROM e GROUP BY doc_id) c ON c.doc_id=t.doc_id WHERE type='Person')"""))
def _(t):
    out = editing.entities_to_events(standoff(t.documents), "Person").events

    def role(name):
        return F.get(F.filter("args", lambda a: a["role"] == name), F.lit(0))["arg"]

    return out.select("doc_id", "ann_id", "trigger", role("Theme").alias("theme"), role("Cause").alias("cause"))


@plan("v18_set_properties", over_standoff(
    """SELECT a.doc_id, a.ann_id, a.type, 'yes' AS value, a.target FROM a JOIN t ON t.doc_id=a.doc_id AND t.ann_id=a.target WHERE t.st%2=0
UNION ALL SELECT doc_id, concat('A', top + row_number() OVER (PARTITION BY doc_id ORDER BY st)), 'mark', NULL, ann_id FROM (
  SELECT t.*, (SELECT count(*) FROM a WHERE a.doc_id=t.doc_id) AS top FROM t WHERE type<>'Action' AND st%5=0) WHERE st%2=1"""))
def _(t):
    so = standoff(t.documents)
    spots = so.textbounds.select("doc_id", F.col("ann_id").alias("target"), "start")
    targets = so.attributes.select("doc_id", "target").join(spots, ["doc_id", "target"])
    even = F.col("start") % 2 == 0
    wanted = targets.select(
        "doc_id", "target", F.when(even, F.lit("flag")).otherwise(F.lit("mark")).alias("type"),
        F.when(even, F.lit("yes")).alias("value"))
    out = editing.set_properties(so, targets, attributes=wanted).attributes
    return out.select("doc_id", "ann_id", "type", "value", "target")


@plan("v19_changes", over_standoff(
    """SELECT doc_id, ann_id, CASE WHEN t2.doc_id IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM t LEFT JOIN t2 USING (doc_id, ann_id)
WHERE t2.doc_id IS NULL OR t.type<>t2.type"""))
def _(t):
    ann = textbounds(t.documents)
    return editing.changes(ann, second_textbounds(ann))


@plan("v20_render_documents", over_standoff(
    """SELECT doc_id, (SELECT count(*) FROM t WHERE t.doc_id=d.doc_id AND type<>'Action') AS entities,
 (SELECT count(*) FROM e WHERE e.doc_id=d.doc_id) AS events, (SELECT string_agg(arg1||'-'||arg2, ' ' ORDER BY num) FROM r WHERE r.doc_id=d.doc_id) AS relations,
 (SELECT count(*) FROM n WHERE n.doc_id=d.doc_id) AS comments, (SELECT count(*) FROM lo WHERE lo.doc_id=d.doc_id) AS sentences
FROM documents d"""))
def _(t):
    lines = textual.lines_with_offsets(t.documents).withColumnRenamed("line_no", "sentence_no")
    page = editing.render_documents(t.documents, standoff(t.documents), sentences=lines)
    arcs = F.transform("relations", lambda r: F.concat_ws("-", r["arg1"], r["arg2"]))
    return page.select(
        "doc_id",
        F.size("entities").alias("entities"),
        F.size("events").alias("events"),
        F.when(F.size("relations") > 0, F.array_join(arcs, " ")).alias("relations"),
        F.size("comments").alias("comments"),
        F.size("sentence_offsets").alias("sentences"),
    )


@plan("w08_renumber", over_standoff(
    """SELECT r.doc_id, r.ann_id, coalesce(x.nid, r.arg1) AS arg1, coalesce(y.nid, r.arg2) AS arg2 FROM r
LEFT JOIN m x ON x.doc_id=r.doc_id AND x.ann_id=r.arg1 LEFT JOIN m y ON y.doc_id=r.doc_id AND y.ann_id=r.arg2""",
    "m AS (SELECT doc_id, ann_id, concat('T', row_number() OVER (PARTITION BY doc_id ORDER BY st)) AS nid FROM t2)"))
def _(t):
    so = standoff(t.documents)
    fewer = so.with_tables(textbounds=second_textbounds(so.textbounds))
    return editing.renumber(fewer).relations.select("doc_id", "ann_id", "arg1", "arg2")


@plan("w09_concat_documents", over_standoff(
    """SELECT t.doc_id//4 AS doc_id, st + off AS start, en + off AS "end", text, text AS cut,
  count(*) OVER (PARTITION BY t.doc_id//4) AS total FROM t JOIN (SELECT doc_id, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id//4 ORDER BY doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS off FROM documents) o ON o.doc_id=t.doc_id"""))
def _(t):
    docs = t.documents.select("doc_id", "text", F.floor(F.col("doc_id") / 4).alias("part"), F.col("doc_id").alias("place"))
    """``cut`` is the text of each moved span as the pieces of its joined document hold it."""
    pieces, out = editing.concat_documents(docs, standoff(t.documents), "part", "place")
    ids = out.textbounds.groupBy("doc_id").agg(F.count_distinct("ann_id").alias("total"))
    cut = editing.cut_spans(out.textbounds, pieces).withColumnRenamed("text", "cut")
    return out.textbounds.join(ids, "doc_id").join(cut, ["doc_id", "start", "end"]).select(
        "doc_id", "start", "end", "text", "cut", "total")


@plan("u15_match_spans", over_standoff(
    """SELECT coalesce(t.doc_id, x.doc_id) AS doc_id, t.ann_id AS first_id, x.ann_id AS second_id FROM t
FULL JOIN t2 x ON t.doc_id=x.doc_id AND t.st=x.st AND t.en=x.en AND t.type=x.type"""))
def _(t):
    ann = textbounds(t.documents)
    return diffing.match_spans(ann, second_textbounds(ann)).select("doc_id", "first_id", "second_id")


def _written(so):
    """Written once as annotation tables would be."""
    return so.map(lambda _, df: cut_lineage(df))


def _second(so):
    """A second version: fewer and retyped spans, fewer relations and attributes, some values changed."""
    kept = second_textbounds(so.textbounds)
    ids = kept.select("doc_id", "ann_id")

    def on(df, column):
        return df.join(ids.withColumnRenamed("ann_id", column), ["doc_id", column], "left_semi").select(*df.columns)

    relations = on(on(so.relations, "arg1"), "arg2").filter("line_no % 4 <> 0")
    value = F.when(F.col("line_no") % 3 == 0, F.lit("yes")).otherwise(F.col("value"))
    return so.with_tables(
        textbounds=kept,
        relations=relations,
        events=on(so.events, "trigger"),
        attributes=on(so.attributes, "target").withColumn("value", value),
        notes=on(so.notes, "target").filter("line_no % 5 <> 0"),
        normalizations=on(so.normalizations, "target"),
    )


@plan("u15_diff_annotations")
def _(t):
    so = _written(standoff(t.documents))
    out = diffing.diff_annotations(so, _written(_second(so))).notes
    return out.filter(F.endswith("type", F.lit("Annotation"))).select("doc_id", "ann_id", "type", "target", "note")


@plan("u15_diff_relations", over_standoff(
    """SELECT r.doc_id, r.arg1, r.arg2 FROM r WHERE (doc_id, arg1) IN (SELECT doc_id, ann_id FROM t2) AND (doc_id, arg2) IN (SELECT doc_id, ann_id FROM t2)
AND num%4=0"""))
def _(t):
    so = standoff(t.documents)
    second = _second(so)
    ids = second.textbounds.select("doc_id", F.col("ann_id").alias("first_id"), F.col("ann_id").alias("second_id"))
    marks = diffing._diff_relations(so, second, ids)
    return marks.select(
        "doc_id", F.col("target").alias("arg1"), F.regexp_extract("note", "^Missing relation near to (T[0-9]+) ", 1).alias("arg2"))


@plan("u16_diff_collections", over_standoff(
    """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'first' ELSE 'second' END AS only_in FROM documents
WHERE (doc_id IN (SELECT doc_id FROM labels)) <> (doc_id IN (SELECT doc_id FROM t))"""))
def _(t):
    first = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    second = t.documents.join(textbounds(t.documents).select("doc_id"), "doc_id", "left_semi")
    so = standoff(t.documents)
    _, lone = diffing.diff_collections(so, _second(so), first, second)
    return lone
