"""U15/U16: differences between two versions of annotations, as marks on the second version.

Every kind is a join on its natural key after the ids of the first version are mapped to the second.
"""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.model import Standoff
from spanloom.operators.editing import _append
from spanloom.operators.selecting import comments, new_ids
from spanloom.session import cut_lineage

ADDED, MISSING, CHANGED = "AddedAnnotation", "MissingAnnotation", "ChangedAnnotation"


def span_key(df):
    return df.withColumn("span_key", F.array_sort(F.array_distinct("spans")).cast("string"))


def match_spans(first: DataFrame, second: DataFrame, also=()) -> DataFrame:
    """(doc_id, type, span_key, first_id, second_id): spans of both versions by type, spans and the columns of ``also``; null
    where missing."""
    key = ["doc_id", "type", "span_key", *also]
    a = span_key(first).groupBy(*key).agg(F.min_by("ann_id", "line_no").alias("first_id"))
    b = span_key(second).select(*key, F.col("ann_id").alias("second_id"))
    return a.join(b, key, "full_outer")


def _told_apart(so):
    """Text-bounds with ``is_trigger``: whether some event refers to them as its trigger."""
    used = so.events.select("doc_id", F.col("trigger").alias("ann_id")).distinct().withColumn("_used", F.lit(True))
    told = so.textbounds.join(used, ["doc_id", "ann_id"], "left")
    return told.withColumn("is_trigger", F.coalesce("_used", F.lit(False))).drop("_used")


def _marks(df, mark, target, reason):
    return df.select("doc_id", F.col(target).alias("target"), F.lit(mark).alias("type"), reason.alias("note"))


def match_events(first: Standoff, second: Standoff, id_map: DataFrame):
    """One-to-one pairs of events with the same type and trigger, closest in arguments first.

    The score counts roles that differ, on both sides. Pairs are taken greedily by score and order of appearance: a pair
    is taken when it is the best left for both of its events, and rounds repeat until no pair is left.
    """
    def roles(so, id_name):
        trig = so.events.select("doc_id", F.col("ann_id").alias("arg"), F.col("trigger").alias("arg_trigger"))
        rows = so.events.select("doc_id", F.col("ann_id").alias(id_name), F.explode("args").alias("a")).select(
            "doc_id", id_name, "a.role", "a.arg"
        )
        rows = rows.join(trig, ["doc_id", "arg"], "left").withColumn("arg", F.coalesce("arg_trigger", "arg"))
        return rows.groupBy("doc_id", id_name, "role").agg(F.max("arg").alias("arg"))

    mapped = id_map.select("doc_id", F.col("first_id").alias("trigger"), F.col("second_id").alias("mapped"))
    a = first.events.join(mapped, ["doc_id", "trigger"]).select(
        "doc_id", "type", F.col("mapped").alias("trigger"), F.col("ann_id").alias("first_event"),
        F.col("line_no").alias("first_line"),
    )
    b = second.events.select(
        "doc_id", "type", "trigger", F.col("ann_id").alias("second_event"), F.col("line_no").alias("second_line")
    )
    pairs = cut_lineage(a.join(b, ["doc_id", "type", "trigger"]))
    arg_map = id_map.select("doc_id", F.col("first_id").alias("arg"), F.col("second_id").alias("mapped_arg"))
    first_roles = roles(first, "first_event").join(arg_map, ["doc_id", "arg"], "left").select(
        "doc_id", "first_event", "role", F.col("arg").alias("first_arg"), F.col("mapped_arg")
    )
    second_roles = roles(second, "second_event").select(
        "doc_id", "second_event", "role", F.col("arg").alias("second_arg")
    )
    pair_ids = pairs.select("doc_id", "first_event", "second_event")
    left = pair_ids.join(first_roles, ["doc_id", "first_event"])
    right = pair_ids.join(second_roles, ["doc_id", "second_event"])
    detail = left.join(right, ["doc_id", "first_event", "second_event", "role"], "full_outer").withColumn(
        "difference",
        F.when(F.col("second_arg").isNull(), "missing")
        .when(F.col("first_arg").isNull(), "added")
        .when(~F.col("mapped_arg").eqNullSafe(F.col("second_arg")), "changed"),
    )
    detail = cut_lineage(detail)
    score = detail.groupBy("doc_id", "first_event", "second_event").agg(
        F.sum(
            F.when(F.col("difference") == "changed", 2).when(F.col("difference").isNotNull(), 1).otherwise(0)
        ).alias("score")
    )
    open_pairs = cut_lineage(
        pairs.join(score, ["doc_id", "first_event", "second_event"], "left").select(
            "doc_id", "first_event", "second_event",
            F.struct(F.coalesce("score", F.lit(0)).alias("score"), "second_line", "first_line").alias("rank"),
        )
    )
    taken = open_pairs.limit(0).select("doc_id", "first_event", "second_event")
    while True:
        best_first = open_pairs.groupBy("doc_id", "first_event").agg(F.min("rank").alias("rank"))
        best_second = open_pairs.groupBy("doc_id", "second_event").agg(F.min("rank").alias("rank"))
        chosen = open_pairs.join(best_first, ["doc_id", "first_event", "rank"], "left_semi").join(
            best_second, ["doc_id", "second_event", "rank"], "left_semi"
        )
        chosen = cut_lineage(chosen.select("doc_id", "first_event", "second_event"))
        if chosen.limit(1).count() == 0:
            break
        taken = taken.unionByName(chosen)
        open_pairs = cut_lineage(
            open_pairs.join(chosen.select("doc_id", "first_event"), ["doc_id", "first_event"], "left_anti").join(
                chosen.select("doc_id", "second_event"), ["doc_id", "second_event"], "left_anti"
            )
        )
    taken = cut_lineage(taken)
    return taken, detail.filter("difference IS NOT NULL").join(
        taken, ["doc_id", "first_event", "second_event"], "left_semi"
    )


def diff_annotations(first: Standoff, second: Standoff) -> Standoff:
    """The second version plus clones of what only the first has, and a note for every difference.

    The marks of each kind are written on their own: in one plan, the driver would hold the stages of all kinds at once.
    """
    key = ["doc_id", "ann_id"]
    # Entities match entities and triggers match triggers, all in one join.
    same = cut_lineage(match_spans(_told_apart(first), _told_apart(second), ["is_trigger"]))
    marks = [_marks(same.filter("first_id IS NULL AND NOT is_trigger"), ADDED, "second_id", F.lit("Added entity"))]
    gone = same.filter("second_id IS NULL").groupBy("doc_id", F.col("first_id").alias("ann_id")).agg(
        F.max("is_trigger").alias("is_trigger")
    )
    # Rows that get ids are read twice, so they are written before that.
    lost = cut_lineage(first.textbounds.join(gone, key).withColumnRenamed("ann_id", "_old"))
    clones = cut_lineage(new_ids(second.textbounds, lost, "T", ["line_no"]))
    marks.append(_marks(clones.filter("NOT is_trigger"), MISSING, "ann_id", F.lit("Missing entity")))
    # Several equal spans of the second version map to one of the first; the earliest stands for it.
    id_map = same.filter("first_id IS NOT NULL AND second_id IS NOT NULL").groupBy("doc_id", "first_id").agg(
        F.min("second_id").alias("second_id")
    )
    id_map = id_map.unionByName(
        clones.select("doc_id", F.col("_old").alias("first_id"), F.col("ann_id").alias("second_id"))
    )
    id_map = cut_lineage(id_map)

    pairs, differences = match_events(first, second, id_map)
    texts = first.textbounds.select("doc_id", F.col("ann_id").alias("first_arg"), F.col("text").alias("_text"))
    changed = differences.join(texts, ["doc_id", "first_arg"], "left")
    marks.append(
        _marks(
            changed, CHANGED, "second_event",
            F.when(
                F.col("difference") == "added", F.format_string("Added role %s", F.col("role"))
            ).when(
                F.col("difference") == "missing",
                F.format_string('Missing role %s (%s "%s")', F.col("role"), F.col("mapped_arg"), F.col("_text")),
            ).otherwise(
                F.format_string('Changed role %s (from %s "%s")', F.col("role"), F.col("mapped_arg"), F.col("_text"))
            ),
        )
    )
    new_events = second.events.join(pairs.toDF("doc_id", "f", "ann_id"), key, "left_anti")
    marks.append(_marks(new_events, ADDED, "ann_id", F.lit("Added event")))
    lost_events = first.events.join(
        pairs.select("doc_id", F.col("first_event").alias("ann_id")), key, "left_anti"
    ).withColumnRenamed("ann_id", "_old")
    event_clones = cut_lineage(new_ids(second.events, cut_lineage(lost_events), "E", ["line_no"]))
    event_map = pairs.toDF("doc_id", "first_id", "second_id").unionByName(
        event_clones.select("doc_id", F.col("_old").alias("first_id"), F.col("ann_id").alias("second_id"))
    )
    full_map = cut_lineage(id_map.unionByName(event_map))
    from spanloom.operators.editing import _rewrite_args, _rewrite_column

    renamed = full_map.toDF("doc_id", "_old", "_new")
    plain_clones = event_clones.drop("_old")
    event_rows = cut_lineage(_rewrite_args(_rewrite_column(plain_clones, renamed, "trigger"), renamed).select(*second.events.columns))
    marks.append(_marks(event_clones, MISSING, "ann_id", F.lit("Missing event")))
    cloned = clones.select("doc_id", F.col("_old").alias("target")).unionByName(
        event_clones.select("doc_id", F.col("_old").alias("target"))
    )

    def mapped(df, columns):
        for c in columns:
            df = _rewrite_keep(df, full_map, c)
        return df

    # notes and normalizations: by mapped target and content
    marks.append(
        _diff_rows(
            mapped(comments(first), ["target"]), comments(second), ["doc_id", "target", "note"],
            F.format_string('%s: "%s"', F.col("type"), F.col("note")),
        )
    )
    marks.append(
        _diff_rows(
            mapped(first.normalizations, ["target"]), second.normalizations, ["doc_id", "target", "refdb", "refid"],
            F.format_string('normalization %s:%s "%s"', F.col("refdb"), F.col("refid"), F.col("reftext")),
        )
    )
    attributes, attribute_marks = _diff_attributes(first, second, full_map, cloned)
    marks += [attribute_marks, _diff_equivs(first, second, full_map), _diff_relations(first, second, full_map)]

    result = second.with_tables(
        textbounds=second.textbounds.unionByName(clones.select(*second.textbounds.columns)),
        events=second.events.unionByName(event_rows),
    )
    appended = cut_lineage(_append(result, "attributes", cut_lineage(attributes), "A", ["line_no"]))
    result = result.with_tables(attributes=second.attributes.unionByName(appended))
    numbered = functools.reduce(DataFrame.unionByName, map(cut_lineage, marks)).withColumn(
        "_place", F.coalesce(F.regexp_extract("target", "([0-9]+)$", 1).cast("long"), F.lit(0))
    )
    notes = _append(result, "notes", numbered, "#", ["_place", "target", "type", "note"])
    return result.with_tables(notes=second.notes.unionByName(notes))


def _rewrite_keep(df, full_map, column):
    """Maps a column of first-version ids; rows whose id has no counterpart are left out."""
    names = full_map.select("doc_id", F.col("first_id").alias(column), F.col("second_id").alias("_to"))
    return df.join(names, ["doc_id", column]).withColumn(column, F.col("_to")).drop("_to")


def _diff_rows(first, second, key, what, target="target"):
    return _one_sided(first.select(*key, what.alias("_what")), second.select(*key, what.alias("_what")), key, target)


def _one_sided(first, second, key, target):
    """Marks of what only one side has, for rows (key, _what): both sides are met once."""
    a, b = first.withColumnRenamed("_what", "_old").withColumn("_first", F.lit(1)), second.withColumnRenamed("_what", "_new").withColumn("_second", F.lit(1))
    lone = a.join(b, key, "full_outer").filter("_first IS NULL OR _second IS NULL")
    added = F.col("_first").isNull()
    return _marks(lone, CHANGED, target, F.when(added, F.concat(F.lit("Added "), "_new")).otherwise(F.concat(F.lit("Missing "), "_old")))


def _diff_attributes(first, second, full_map, cloned):
    """Clones of attributes on cloned targets, and marks for the others by (target, type) and value."""
    on_clone = _rewrite_keep(first.attributes.join(cloned, ["doc_id", "target"], "left_semi"), full_map, "target")
    rest = _rewrite_keep(first.attributes.join(cloned, ["doc_id", "target"], "left_anti"), full_map, "target")
    known = full_map.select("doc_id", F.col("second_id").alias("target")).distinct()
    a = rest.select("doc_id", "target", "type", F.struct("value").alias("old"))
    b = second.attributes.join(known, ["doc_id", "target"], "left_semi").select(
        "doc_id", "target", "type", F.struct("value").alias("new")
    )
    both = a.join(b, ["doc_id", "target", "type"], "full_outer")
    shown = F.coalesce("old.value", F.lit("True"))
    note = (
        F.when(F.col("old").isNull(), F.format_string("Added attribute %s", F.col("type")))
        .when(F.col("new").isNull(), F.format_string("Missing attribute %s (%s)", F.col("type"), shown))
        .when(
            ~F.col("old.value").eqNullSafe(F.col("new.value")),
            F.format_string("Changed attribute %s (from %s)", F.col("type"), shown),
        )
    )
    changed = both.withColumn("note", note).filter("note IS NOT NULL")
    return on_clone.drop("ann_id"), _marks(changed, CHANGED, "target", F.col("note"))


def _diff_equivs(first, second, full_map):
    """Members that joined, left or moved between sets; a set moves with the largest part of its members."""
    a = first.equivs.select("doc_id", F.col("line_no").alias("first_set"), F.explode("members").alias("member"))
    texts = first.textbounds.select("doc_id", F.col("ann_id").alias("member"), "text")
    named = a.join(texts, ["doc_id", "member"], "left")
    # Both are asked for several times.
    a = cut_lineage(_rewrite_keep(named, full_map, "member"))
    b = second.equivs.select("doc_id", F.col("line_no").alias("second_set"), F.explode("members").alias("member"))
    both = cut_lineage(a.join(b, ["doc_id", "member"], "full_outer"))
    sizes = both.filter("first_set IS NOT NULL AND second_set IS NOT NULL").groupBy(
        "doc_id", "first_set", "second_set"
    ).agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("doc_id", "first_set").agg(F.max(F.struct("n", -F.col("second_set"))).alias("m")).select(
        "doc_id", "first_set", (-F.col("m").getField("col2")).alias("main_set")
    )
    rest = a.groupBy("doc_id", "first_set").agg(
        F.array_sort(F.collect_list(F.struct("member", "text"))).alias("all")
    )
    both = both.join(main, ["doc_id", "first_set"], "left").join(rest, ["doc_id", "first_set"], "left")
    others = F.array_join(
        F.transform(
            F.filter("all", lambda x: x["member"] != F.col("member")),
            lambda x: F.concat(x["member"], F.lit(" ("), F.coalesce(x["text"], F.lit("")), F.lit(")")),
        ),
        ", ",
    )
    note = (
        F.when(F.col("first_set").isNull(), F.lit("Added to equiv"))
        .when(F.col("second_set").isNull(), F.concat(F.lit("Missing from equiv with "), others))
        .when(F.col("second_set") != F.col("main_set"), F.concat(F.lit("Changed from equiv "), others))
    )
    return _marks(both.withColumn("note", note).filter("note IS NOT NULL"), CHANGED, "member", F.col("note"))


def _diff_relations(first, second, full_map):
    texts = first.textbounds.select("doc_id", F.col("ann_id").alias("arg2"), F.col("text").alias("_text"))
    a = _rewrite_keep(first.relations.join(texts, ["doc_id", "arg2"], "left"), full_map, "arg1")
    a = _rewrite_keep(a, full_map, "arg2")
    key = ["doc_id", "arg1", "arg2", "type"]
    plain = F.format_string("relation %s to %s", F.col("type"), F.col("arg2"))
    given = second.relations.select(*key).distinct().withColumn("_what", plain)
    lost = a.select(*key, "_text").dropDuplicates(key)
    told = F.format_string('relation %s to %s "%s"', F.col("type"), F.col("arg2"), F.col("_text"))
    return _one_sided(lost.select(*key, told.alias("_what")), given, key, "arg1")


# U16
def diff_collections(first: Standoff, second: Standoff, first_docs: DataFrame, second_docs: DataFrame):
    """Differences of the documents both sides have, and the documents only one side has."""
    # Each side's documents are told apart once, in one shuffle, however many tables and outputs ask for them.
    sides = first_docs.select("doc_id", F.lit(1).alias("_side")).unionByName(second_docs.select("doc_id", F.lit(2).alias("_side")))
    sides = cut_lineage(sides.groupBy("doc_id").agg(F.min("_side").alias("_low"), F.max("_side").alias("_high")))
    both = sides.filter("_low < _high AND doc_id IS NOT NULL").select("doc_id")
    # A document without an id is none of the other side's.
    side = F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_side")
    only = F.when(F.col("_side") == 1, F.lit("first")).otherwise(F.lit("second"))
    lone = sides.filter("_low = _high OR doc_id IS NULL").select("doc_id", side).select("doc_id", only.alias("only_in"))

    def shared(_, df):
        return cut_lineage(df.join(both, "doc_id", "left_semi"))

    return diff_annotations(first.map(shared), second.map(shared)), lone
