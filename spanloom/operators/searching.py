"""Searches over annotations and text, and their concordance."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import text_match
from spanloom.model import Standoff
from spanloom.operators import ranges
from spanloom.operators.mentions import mentions
from spanloom.operators.selecting import comments, entities, type_filter
from spanloom.operators.spans import contains_spans
from spanloom.session import cut_lineage
from spanloom.operators.textual import text_occurrences

ANY = "ANY"


# J06
def nesting(outer: DataFrame, all_textbounds: DataFrame, nested_types) -> DataFrame:
    """Rows of ``outer`` that contain another annotation of one of the given types."""
    inner = type_filter(all_textbounds, restrict=nested_types).select("doc_id", "ann_id", "spans", "start", "end")
    other = (F.col("inner.ann_id") != F.col("outer.ann_id")) & contains_spans(
        F.col("outer.spans"), F.col("inner.spans")
    )
    return ranges.covers(outer, inner, ["doc_id"], condition=other)


# O05
def order_matches(matches: DataFrame, cap=None) -> DataFrame:
    """By document, then start, longest first; ``cap`` limits the report."""
    ordered = matches.orderBy("doc_id", "start", F.desc("end"))
    return ordered if cap is None or cap <= 0 else ordered.limit(cap)


# J19
def search_entities(so: Standoff, text="", restrict=(), ignore=(), nested=(), mode="word", match_case=False,
                    entities_only=False) -> DataFrame:
    """Text-bounds by type, text and contained types; ``entities_only`` leaves triggers out."""
    found = type_filter(entities(so) if entities_only else so.textbounds, restrict, ignore)
    found = found.filter(text_match(F.col("text"), text, mode, match_case))
    return nesting(found, so.textbounds, nested) if nested else found


def _with_place(so: Standoff) -> DataFrame:
    """(doc_id, ann_id, type, text, start, end) of text-bounds, and of events by their trigger."""
    t = so.textbounds.select("doc_id", "ann_id", "type", "text", "start", "end")
    spots = so.textbounds.select("doc_id", F.col("ann_id").alias("trigger"), "text", "start", "end")
    e = so.events.select("doc_id", "ann_id", "type", "trigger").join(spots, ["doc_id", "trigger"])
    return t.unionByName(e.select(*t.columns))


# J20
def search_notes(so: Standoff, text="", restrict=(), ignore=(), mode="word", match_case=False) -> DataFrame:
    """Notes by their text and by the type of what they are on."""
    notes = comments(so).filter(text_match(F.col("note"), text, mode, match_case))
    targets = type_filter(
        so.typed_ids().select("doc_id", F.col("ann_id").alias("target"), F.col("type").alias("target_type")),
        restrict,
        ignore,
        column="target_type",
    )
    return notes.join(targets, ["doc_id", "target"])


# J21
def search_relations(so: Standoff, arg1=None, arg1_type=None, arg2=None, arg2_type=None, restrict=(), ignore=(),
                     mode="word", match_case=False) -> DataFrame:
    """Relations by the text and type of each argument; equivalence sets need some member for each constraint."""
    place = _with_place(so).select("doc_id", "ann_id", F.col("type").alias("t"), F.col("text").alias("x"))
    relations = type_filter(so.relations, restrict, ignore)
    constraints = [(arg1, arg1_type, "arg1"), (arg2, arg2_type, "arg2")]

    def test(text, kind):
        cond = F.lit(True)
        if text is not None:
            cond = cond & text_match(F.col("x"), text, mode, match_case)
        if kind is not None:
            cond = cond & (F.col("t") == kind)
        return cond

    for text, kind, column in constraints:
        if text is not None or kind is not None:
            fitting = place.filter(test(text, kind)).select("doc_id", F.col("ann_id").alias(column))
            relations = relations.join(fitting, ["doc_id", column], "left_semi")
    equivs = type_filter(so.equivs, restrict, ignore)
    members = equivs.select("doc_id", "line_no", F.explode("members").alias("ann_id"))
    for text, kind, _ in constraints:
        fitting = members.join(place.filter(test(text, kind)), ["doc_id", "ann_id"], "left_semi")
        equivs = equivs.join(fitting.select("doc_id", "line_no").distinct(), ["doc_id", "line_no"], "left_semi")
    columns = ["doc_id", "ann_id", "line_no", "type"]
    return relations.select(*columns).unionByName(equivs.select(*columns))


# J22
def search_events(so: Standoff, trigger_text="", constraints=(), restrict=(), ignore=(), mode="word",
                  match_case=False) -> DataFrame:
    """Events by trigger text and by (role, type, text) constraints, each met by some argument.

    One pass over the arguments: each constraint is a flag, and an event stays when every flag is set somewhere.
    """
    events = type_filter(so.events, restrict, ignore)
    spots = so.textbounds.select(
        "doc_id", F.col("ann_id").alias("trigger"), F.col("text").alias("trigger_text"), "start", "end"
    )
    events = events.join(spots, ["doc_id", "trigger"]).filter(
        text_match(F.col("trigger_text"), trigger_text, mode, match_case)
    )
    constraints = [c for c in constraints if any(c.get(k) for k in ("role", "type", "text"))]
    if not constraints:
        return events
    place = _with_place(so).select(
        "doc_id", F.col("ann_id").alias("arg"), F.col("type").alias("arg_type"), F.col("text").alias("arg_text")
    )
    args = events.select("doc_id", "ann_id", F.explode("args").alias("a")).select("doc_id", "ann_id", "a.role", "a.arg")
    flags = []
    for i, c in enumerate(constraints):
        met = F.lit(True)
        if c.get("role"):
            met = met & (F.col("role") == c["role"])
        if c.get("type"):
            met = met & (F.col("arg_type") == c["type"])
        if c.get("text"):
            met = met & text_match(F.col("arg_text"), c["text"], mode, match_case)
        flags.append(F.max(F.coalesce(met, F.lit(False))).alias(f"met{i}"))
    every = F.lit(True)
    for i in range(len(constraints)):
        every = every & F.col(f"met{i}")
    good = args.join(place, ["doc_id", "arg"]).groupBy("doc_id", "ann_id").agg(*flags).filter(every)
    return events.join(good.select("doc_id", "ann_id"), ["doc_id", "ann_id"], "left_semi")


# J23
def search_text(docs: DataFrame, textbounds: DataFrame, text, restrict=(), ignore=(), mode="word",
                match_case=False) -> DataFrame:
    """Occurrences of a text in documents, optionally inside, or not inside, annotations of some types."""
    found = text_occurrences(docs, text, mode, match_case).withColumn(
        "spans", F.array(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))
    )
    spans = textbounds.select("doc_id", "type", "spans", "start", "end")
    within = contains_spans(F.col("outer.spans"), F.col("inner.spans"))
    if ignore:
        blocked = spans if ANY in ignore else type_filter(spans, restrict=ignore)
        found = ranges.covered_by(found, blocked, ["doc_id"], condition=within, how="left_anti")
    if restrict:
        wanted = type_filter(spans, restrict=restrict)
        found = ranges.covered_by(found, wanted, ["doc_id"], condition=within, how="left_semi")
    return found.drop("spans")


# J24
def concordance(matches: DataFrame, docs: DataFrame, n=50) -> DataFrame:
    """Each match with up to ``n`` characters of text on both sides."""
    texts = docs.select("doc_id", F.col("text").alias("_text"))
    left = F.greatest(F.col("start") - n, F.lit(0)).cast("int")
    return (
        matches.join(texts, "doc_id")
        .withColumns(
            {
                "left_context": F.substr("_text", left + 1, (F.col("start") - left).cast("int")),
                "hit": F.substr("_text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")),
                "right_context": F.substr("_text", (F.col("end") + 1).cast("int"), F.lit(n)),
            }
        )
        .drop("_text")
    )


# J10
def unmarked_mentions(docs: DataFrame, textbounds: DataFrame, restrict=(), ignore=(), **bounds) -> DataFrame:
    """Token sequences equal to some marked text that no single annotation covers."""
    marked = type_filter(textbounds, restrict, ignore).filter(F.rlike("text", F.lit("^\\S"))).select("text").distinct()
    candidates = mentions(docs, marked, **bounds)
    inside = F.exists(
        "outer.spans", lambda s: (s["start"] <= F.col("inner.start")) & (s["end"] > F.col("inner.start"))
    ) & F.exists("outer.spans", lambda s: (s["start"] < F.col("inner.end")) & (s["end"] >= F.col("inner.end")))
    spans = textbounds.select("doc_id", "spans", "start", "end")
    return ranges.covered_by(candidates, spans, ["doc_id"], condition=inside, how="left_anti")


def partially_marked(docs, textbounds, restrict=(), ignore=(), ratio=3, keep=5) -> DataFrame:
    """Marked and unmarked mentions of every text that has both, the far more common side cut down (W06)."""
    unmarked = unmarked_mentions(docs, textbounds, restrict, ignore).select(
        "doc_id", "start", "end", "text", F.lit(False).alias("tagged")
    )
    # Used several times below; written once instead of tokenizing the documents each time.
    unmarked = cut_lineage(unmarked)
    tagged = type_filter(textbounds, restrict, ignore).select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        "text",
        F.lit(True).alias("tagged"),
    )
    tagged = tagged.join(unmarked.select("text").distinct(), "text", "left_semi").select(*unmarked.columns)
    return compress(unmarked.unionByName(tagged), ratio, keep)


# W06
def compress(mentions: DataFrame, ratio=3, keep=5) -> DataFrame:
    """Per text, only the first ``keep`` of a side that is more than ``ratio`` times the other; ``omitted`` tells.

    Only the cut sides go through a row number, whose limit is applied before the shuffle.
    """
    counts = mentions.groupBy("text").agg(
        F.count_if("tagged").alias("n_tagged"), F.count_if(~F.col("tagged")).alias("n_untagged")
    )
    many, few = F.greatest("n_tagged", "n_untagged"), F.least("n_tagged", "n_untagged")
    cut = counts.filter((many > ratio * few) & (many > keep)).select(
        "text", (F.col("n_tagged") > F.col("n_untagged")).alias("tagged"), (many - keep).alias("omitted")
    )
    flagged = mentions.join(cut, ["text", "tagged"], "left")
    whole = flagged.filter("omitted IS NULL").withColumn("omitted", F.lit(0).cast("long"))
    first = Window.partitionBy("text", "tagged").orderBy("doc_id", "start", "end")
    short = (
        flagged.filter("omitted IS NOT NULL")
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= keep)
        .drop("_rank")
    )
    return whole.unionByName(short)
