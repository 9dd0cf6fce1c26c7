"""Annotations derived from the `documents` table, in Spark and in SQL, as input for the annotation operators.

Capitalized words become text-bounds typed by their length; neighbours become relations, events, attributes and notes.
Every table grows with the documents.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.model import ARGS, Standoff, textbound
from spanloom.operators.textual import occurrences, split_with_offsets
from spanloom.session import cut_lineage

# Types by word length modulo 4, and the word pattern.
WORD = "(?<![^ ])[A-Z][a-z]{3,}(?![^ ])"
TYPES = ["Action", "Person", "Place", "Org"]
ENTITY_TYPES = ["Person", "Place", "Org"]

def by_start():
    return Window.partitionBy("doc_id").orderBy("start")



def token_rows(docs):
    """(doc_id, i, w, st): the text split at single blanks."""
    return split_with_offsets(docs, " ", "i", "w", "st")


def word_type(word):
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.length(word) % 4 + 1).cast("int"))


def textbounds(docs):
    words = occurrences(docs, WORD)
    kind = word_type(F.col("text"))
    number = F.col("occ_no") + 1
    return words.select(
        *textbound(
            F.col("doc_id"), F.concat(F.lit("T"), number.cast("string")), number, kind, F.col("start"), F.col("end"),
            F.col("text"),
        )
    )


#: The spans that also give a relation, an event, an attribute, a note or a normalization.
KINDS = {
    "R": "type <> 'Action' AND p_type <> 'Action' AND start - p_end <= 40",
    "E": "type = 'Action'",
    "A": "type <> 'Action' AND start % 5 = 0",
    "#": "start % 7 = 0",
    "N": "type <> 'Action' AND start % 3 = 0",
}


def _numbered(nb, prefix):
    """The rows of one kind with their id and number, the span's own id becoming ``tid``."""
    number = F.col(f"no_{prefix}")
    rows = nb.filter(KINDS[prefix]).withColumnRenamed("ann_id", "tid")
    return rows.withColumns({"line_no": number, "ann_id": F.concat(F.lit(prefix), number.cast("string"))})


TEXTBOUND_COLUMNS = ["doc_id", "ann_id", "line_no", "type", "spans", "start", "end", "text"]


def standoff(docs) -> Standoff:
    # Neighbours and running numbers of all kinds in one pass over the spans, written once as annotation tables would be.
    before = by_start().rowsBetween(Window.unboundedPreceding, 0)
    near = textbounds(docs).withColumns(
        {
            "p_id": F.lag("ann_id").over(by_start()),
            "p_type": F.lag("type").over(by_start()),
            "p_end": F.lag("end").over(by_start()),
            "n_id": F.lead("ann_id").over(by_start()),
            "n_type": F.lead("type").over(by_start()),
        }
    )
    numbers = {f"no_{k}": F.sum(F.when(F.expr(c), 1).otherwise(0)).over(before) for k, c in KINDS.items()}
    nb = cut_lineage(near.withColumns(numbers))
    t = nb.select(*TEXTBOUND_COLUMNS)
    relations = _numbered(nb, "R").select(
        "doc_id",
        "ann_id",
        "line_no",
        F.lit("near").alias("type"),
        F.lit("Arg1").alias("arg1_role"),
        F.col("p_id").alias("arg1"),
        F.lit("Arg2").alias("arg2_role"),
        F.col("tid").alias("arg2"),
    )
    theme = F.when(F.col("p_type") != "Action", F.struct(F.lit("Theme").alias("role"), F.col("p_id").alias("arg")))
    cause = F.when(F.col("n_type") != "Action", F.struct(F.lit("Cause").alias("role"), F.col("n_id").alias("arg")))
    events = _numbered(nb, "E").select(
        "doc_id",
        "ann_id",
        "line_no",
        "type",
        F.col("tid").alias("trigger"),
        F.filter(F.array(theme, cause), lambda a: a.isNotNull()).alias("args"),
    )
    attributes = _numbered(nb, "A").select(
        "doc_id", "ann_id", "line_no", F.lit("flag").alias("type"), F.col("tid").alias("target"),
        F.lit(None).cast("string").alias("value"),
    )
    notes = _numbered(nb, "#").select(
        "doc_id", "ann_id", "line_no", F.lit("AnnotatorNotes").alias("type"), F.col("tid").alias("target"),
        F.upper("text").alias("note"),
    )
    equivs = relations.select(
        "doc_id", F.lit("*").alias("ann_id"), "line_no", F.lit("Equiv").alias("type"),
        F.array("arg1", "arg2").alias("members"),
    )
    normalizations = _numbered(nb, "N").select(
        "doc_id",
        "ann_id",
        "line_no",
        F.lit("Reference").alias("type"),
        F.col("tid").alias("target"),
        F.lit("LEX").alias("refdb"),
        F.lower("text").alias("refid"),
        F.col("text").alias("reftext"),
    )
    return Standoff(t, relations, events, attributes, normalizations, equivs, notes)


def only_spans(t) -> Standoff:
    """Annotations of which only the text-bounds ``t`` matter."""
    empty = {
        "relations": "type string, arg1_role string, arg1 string, arg2_role string, arg2 string",
        "events": f"type string, trigger string, args {ARGS}",
        "attributes": "type string, target string, value string",
        "normalizations": "type string, target string, refdb string, refid string, reftext string",
        "equivs": "type string, members array<string>",
        "notes": "type string, target string, note string",
    }
    key = f"doc_id {t.schema['doc_id'].dataType.simpleString()}, ann_id string, line_no bigint"
    return Standoff(t, **{k: t.sparkSession.createDataFrame([], f"{key}, {v}") for k, v in empty.items()})


def second_textbounds(t):
    """A second annotator: some spans missing, some retyped."""
    other = F.when(F.col("start") % 13 == 0, F.lit("Other")).otherwise(F.col("type"))
    return t.filter("start % 11 <> 0").withColumn("type", other)


def widened(t, docs, by=20):
    """Text-bounds stretched by some characters on both sides, so that they overlap."""
    sizes = docs.select("doc_id", F.length("text").alias("n_text"))
    start = F.greatest(F.col("start") - by, F.lit(0)).cast("int")
    end = F.least(F.col("end") + by, F.col("n_text")).cast("int")
    return (
        t.join(sizes, "doc_id")
        .withColumns({"start": start, "end": end})
        .withColumn("spans", F.array(F.struct(F.col("start"), F.col("end"))))
        .drop("n_text")
    )


SQL = r"""
tok AS (SELECT doc_id, generate_subscripts(string_split(text,' '),1)-1 AS i, unnest(string_split(text,' ')) AS w
        FROM documents),
tof AS (SELECT doc_id, i, w, CAST(coalesce(sum(length(w)+1) OVER (PARTITION BY doc_id ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS st FROM tok),
ent AS (SELECT doc_id, st, st+length(w) AS en, w,
          CASE length(w)%4 WHEN 0 THEN 'Action' WHEN 1 THEN 'Person' WHEN 2 THEN 'Place' ELSE 'Org' END AS type
        FROM tof WHERE regexp_matches(w,'^[A-Z][a-z]{3,}\z')),
t AS (SELECT doc_id, concat('T', CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) AS varchar)) AS ann_id,
          type, st, en, w AS text FROM ent),
nb AS (SELECT *, lag(ann_id)  OVER (PARTITION BY doc_id ORDER BY st) AS p_id,
                 lag(type)    OVER (PARTITION BY doc_id ORDER BY st) AS p_type,
                 lag(en)      OVER (PARTITION BY doc_id ORDER BY st) AS p_en,
                 lead(ann_id) OVER (PARTITION BY doc_id ORDER BY st) AS n_id,
                 lead(type)   OVER (PARTITION BY doc_id ORDER BY st) AS n_type FROM t),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY st) AS num,
          concat('R', CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) AS varchar)) AS ann_id,
          'near' AS type, p_id AS arg1, ann_id AS arg2
       FROM nb WHERE type<>'Action' AND p_type<>'Action' AND st-p_en<=40),
e AS (SELECT doc_id, concat('E', CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) AS varchar)) AS ann_id,
          type, ann_id AS trig, st, CASE WHEN p_type<>'Action' THEN p_id END AS theme,
          CASE WHEN n_type<>'Action' THEN n_id END AS cause FROM nb WHERE type='Action'),
ea AS (SELECT doc_id, ann_id, type, trig, 'Theme' AS role, theme AS arg FROM e WHERE theme IS NOT NULL
       UNION ALL SELECT doc_id, ann_id, type, trig, 'Cause', cause FROM e WHERE cause IS NOT NULL),
a AS (SELECT doc_id, concat('A', CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) AS varchar)) AS ann_id,
          'flag' AS type, ann_id AS target FROM t WHERE type<>'Action' AND st%5=0),
n AS (SELECT doc_id, concat('#', CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) AS varchar)) AS ann_id,
          'AnnotatorNotes' AS type, ann_id AS target, upper(text) AS note FROM t WHERE st%7=0),
nm AS (SELECT doc_id, concat('N', CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) AS varchar)) AS ann_id,
          'Reference' AS type, ann_id AS target, 'LEX' AS refdb, lower(text) AS refid, text AS reftext
       FROM t WHERE type<>'Action' AND st%3=0),
t2 AS (SELECT doc_id, ann_id, CASE WHEN st%13=0 THEN 'Other' ELSE type END AS type, st, en, text FROM t WHERE st%11<>0),
tw AS (SELECT t.doc_id, ann_id, type, greatest(st-20,0) AS st, least(en+20, length(d.text)) AS en, t.text
       FROM t JOIN documents d USING (doc_id)),
lo0 AS (SELECT doc_id, generate_subscripts(string_split(text,chr(10)),1)-1 AS line_no,
          unnest(string_split(text,chr(10))) AS line FROM documents),
lo AS (SELECT doc_id, line_no, line, CAST(coalesce(sum(length(line)+1) OVER (PARTITION BY doc_id ORDER BY line_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS l_start FROM lo0)
"""


def over_standoff(select, *more):
    """SQL over the derived tables; ``more`` are further CTEs, ``select`` the final query."""
    return "WITH RECURSIVE " + ",\n".join([SQL.strip(), *more]) + "\n" + select
