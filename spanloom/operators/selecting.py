"""Selections, references and counts over the annotation tables."""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import role_base
from spanloom.model import Standoff
from spanloom.operators.ranges import DEFAULT_CHUNK, bucket_of, row_numbers
from spanloom.session import cut_lineage

STATUS = "STATUS"


# F17
def triggers(so: Standoff) -> DataFrame:
    """Text-bounds that some event refers to as its trigger."""
    used = so.events.select("doc_id", F.col("trigger").alias("ann_id"))
    return so.textbounds.join(used, ["doc_id", "ann_id"], "left_semi")


def entities(so: Standoff) -> DataFrame:
    """Text-bounds that are no trigger."""
    used = so.events.select("doc_id", F.col("trigger").alias("ann_id"))
    return so.textbounds.join(used, ["doc_id", "ann_id"], "left_anti")


def comments(so: Standoff) -> DataFrame:
    return so.notes.filter(F.col("type") != STATUS)


def statuses(so: Standoff) -> DataFrame:
    return so.notes.filter(F.col("type") == STATUS)


# F18
def type_filter(df: DataFrame, restrict=(), ignore=(), column="type") -> DataFrame:
    """Keep ``restrict`` types and drop ``ignore`` types; an empty list does nothing."""
    if ignore:
        df = df.filter(~F.col(column).isin(*ignore))
    if restrict:
        df = df.filter(F.col(column).isin(*restrict))
    return df


# F20 / W11
def doc_status(notes: DataFrame) -> DataFrame:
    """Latest status note of each document; the status is the note's target."""
    return (
        notes.filter(F.col("type") == STATUS)
        .groupBy("doc_id")
        .agg(F.max_by("target", "line_no").alias("status"))
    )


def set_status(notes: DataFrame, statuses_wanted: DataFrame) -> DataFrame:
    """Notes with every earlier status of the given documents replaced by the one in (doc_id, status)."""
    wanted = statuses_wanted.select("doc_id", "status")
    kept = notes.filter(F.col("type") != STATUS).unionByName(
        notes.filter(F.col("type") == STATUS).join(wanted.select("doc_id"), "doc_id", "left_anti")
    )
    tail = notes.groupBy("doc_id").agg(F.max("line_no").alias("last"))
    number = F.regexp_extract("ann_id", "^#[A-Za-z]*([0-9]+)$", 1)
    top = notes.filter(F.length(number) > 0).groupBy("doc_id").agg(F.max(number.cast("long")).alias("top"))
    fresh = wanted.join(tail, "doc_id", "left").join(top, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("#"), (F.coalesce("top", F.lit(0)) + 1).cast("string")).alias("ann_id"),
        (F.coalesce("last", F.lit(0)) + 1).alias("line_no"),
        F.lit(STATUS).alias("type"),
        F.col("status").alias("target"),
        F.lit("").alias("note"),
    )
    return kept.unionByName(fresh)


# J08
def references(so: Standoff) -> DataFrame:
    """(doc_id, from_id, from_kind, from_line, role, to_id, hard): every id another annotation names.

    An event's only argument and a member of a two-member set are hard (the annotation cannot live without them), as are
    triggers, relation arguments and the targets of attributes, normalizations and notes.
    """

    def refs(df, kind, role, to_id, hard):
        return df.select(
            "doc_id",
            F.col("ann_id").alias("from_id"),
            F.lit(kind).alias("from_kind"),
            F.col("line_no").alias("from_line"),
            role.alias("role"),
            to_id.alias("to_id"),
            hard.alias("hard"),
        )

    def exploded(df, column, fields):
        return df.select("doc_id", "ann_id", "line_no", F.size(column).alias("n"), F.explode(column).alias("x")).select(
            "doc_id", "ann_id", "line_no", "n", *fields
        )

    yes = F.lit(True)
    args = exploded(so.events, "args", ["x.role", "x.arg"])
    members = exploded(so.equivs, "members", [F.col("x").alias("member")])
    rel = so.relations.select(
        "doc_id",
        "ann_id",
        "line_no",
        F.explode(
            F.array(
                F.struct(F.col("arg1_role").alias("role"), F.col("arg1").alias("arg")),
                F.struct(F.col("arg2_role").alias("role"), F.col("arg2").alias("arg")),
            )
        ).alias("x"),
    ).select("doc_id", "ann_id", "line_no", "x.role", "x.arg")
    out = refs(so.events, "events", F.lit("trigger"), F.col("trigger"), yes)
    parts = [
        refs(args, "events", F.col("role"), F.col("arg"), F.col("n") <= 1),
        refs(rel, "relations", F.col("role"), F.col("arg"), yes),
        refs(members, "equivs", F.lit("member"), F.col("member"), F.col("n") <= 2),
        refs(so.attributes, "attributes", F.lit("target"), F.col("target"), yes),
        refs(so.normalizations, "normalizations", F.lit("target"), F.col("target"), yes),
        refs(comments(so), "notes", F.lit("target"), F.col("target"), yes),
    ]
    for part in parts:
        out = out.unionByName(part)
    return out


def resolve_references(so: Standoff) -> DataFrame:
    """References with the kind and type of what they name; ``found`` is false for an undefined id."""
    ids = so.typed_ids().select(
        "doc_id", F.col("ann_id").alias("to_id"), F.col("kind").alias("to_kind"), F.col("type").alias("to_type")
    )
    joined = references(so).join(ids, ["doc_id", "to_id"], "left")
    return joined.withColumn("found", F.col("to_kind").isNotNull())


# J09
def same_text_diff_type(textbounds: DataFrame, restrict=(), ignore=()) -> DataFrame:
    """Annotations whose text also occurs with another type.

    The texts are found by a partial aggregate, so a very common text is reduced before the shuffle.
    """
    chosen = type_filter(textbounds, restrict, ignore)
    mixed = (
        chosen.groupBy("text")
        .agg(F.min("type").alias("low"), F.max("type").alias("high"))
        .filter("low <> high")
        .select("text")
    )
    return chosen.join(mixed, "text", "left_semi")


# A01
def type_counts(so: Standoff) -> DataFrame:
    """Annotations per (id letter, type), relations left out; by letter, most frequent first."""
    kinds = {"A": so.attributes, "E": so.events, "N": so.normalizations, "T": so.textbounds, "#": so.notes}
    out = None
    for letter, df in kinds.items():
        part = df.select(F.lit(letter).alias("kind"), "type")
        out = part if out is None else out.unionByName(part)
    counts = out.groupBy("kind", "type").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("kind", F.desc("n"), "type")


# A05
def doc_stats(docs: DataFrame, so: Standoff, issues: DataFrame = None, failed: DataFrame = None) -> DataFrame:
    """Entities, relations (sets included), events and issues per document; -1 everywhere for a failed document."""
    parts = entities(so).select("doc_id", F.lit("entity").alias("what"))
    for df, what in ((so.relations, "relation"), (so.equivs, "relation"), (so.events, "event"), (issues, "issue")):
        if df is not None:
            parts = parts.unionByName(df.select("doc_id", F.lit(what).alias("what")))
    counts = parts.groupBy("doc_id").agg(
        F.count_if(F.col("what") == "entity").alias("entities"),
        F.count_if(F.col("what") == "relation").alias("relations"),
        F.count_if(F.col("what") == "event").alias("events"),
        F.count_if(F.col("what") == "issue").alias("issues"),
    )
    stats = docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0)
    if failed is not None:
        bad = failed.select("doc_id").distinct().withColumn("_bad", F.lit(True))
        stats = stats.join(bad, "doc_id", "left")
        for column in ("entities", "relations", "events", "issues"):
            value = F.when(F.col("_bad"), F.lit(-1)).otherwise(F.col(column))
            stats = stats.withColumn(column, value.cast("long"))
        stats = stats.drop("_bad")
    return stats


# A13
def arg_counts(events: DataFrame) -> DataFrame:
    """(doc_id, ann_id, type, role, n): arguments per role, trailing numbers of the role dropped."""
    args = events.select("doc_id", "ann_id", "type", F.explode("args").alias("a"))
    return args.groupBy("doc_id", "ann_id", "type", role_base(F.col("a.role")).alias("role")).agg(
        F.count(F.lit(1)).alias("n")
    )


# A14
def duplicate_triggers(textbounds: DataFrame, event_types) -> DataFrame:
    """Event-typed text-bounds that share their spans and type with another; ``group`` lists the ids."""
    chosen = textbounds.filter(F.col("type").isin(*event_types)).withColumn(
        "span_key", F.array_sort(F.array_distinct("spans")).cast("string")
    )
    groups = (
        chosen.groupBy("doc_id", "span_key", "type")
        .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("ann_id")).alias("group"))
        .filter("n > 1")
    )
    return chosen.join(groups, ["doc_id", "span_key", "type"]).select("doc_id", "ann_id", "type", "n", "group")


# A15
def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (src, dst), component being the least node reached.

    Alternates large-star and small-star rounds, which shorten paths geometrically. Each round is two partial
    aggregates and joins by node; a hub is never collected, and a reliable checkpoint cuts the history.
    """

    def fingerprint(df):
        digest = F.sum(F.pmod(F.xxhash64("src", "dst"), F.lit(1_000_003)))
        return tuple(df.agg(F.count(F.lit(1)), digest).first())

    def star(both, large):
        least = both.groupBy("src").agg(F.min("dst").alias("low"))
        least = least.select("src", F.least("src", "low").alias("low"))
        linked = both.join(least, "src")
        if large:
            out = linked.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        else:
            down = linked.filter(F.col("dst") <= F.col("src")).select(
                F.col("dst").alias("src"), F.col("low").alias("dst")
            )
            out = down.unionByName(least.select("src", F.col("low").alias("dst")))
        return out.filter(F.col("src") != F.col("dst")).distinct()

    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    current = cut_lineage(edges.filter(F.col("src") != F.col("dst")).distinct())
    seen = fingerprint(current)
    while True:
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        wide = star(both, large=True)
        both = wide.unionByName(wide.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        current = cut_lineage(star(both, large=False))
        now = fingerprint(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


MERGED = T.StructType().add("line_no", T.LongType()).add("members", T.ArrayType(T.StringType()))


@F.arrow_udf(T.ArrayType(MERGED))
def merged_sets(lines: pa.Array, members: pa.Array) -> pa.Array:
    """The sets of one row, those that share a member or a line as one, with their least line and their members in order."""
    out = []
    for numbers, sets in zip(lines.to_pylist(), members.to_pylist()):
        above = {}

        def root(x):
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        for number, names in zip(numbers, sets):
            for name in names:
                # Lines sort before members, so the least node is a line.
                low, high = sorted((root((0, number is not None, number or 0)), root((1, name is not None, name or ""))))
                above[high] = low
        found = {}
        for node in above:
            found.setdefault(root(node), []).append(node)
        out.append([{"line_no": x[2] if x[1] else None, "members": sorted(m for kind, known, m in nodes if kind and known)}
                    for x, nodes in found.items()])
    return pa.array(out, pa.list_(pa.struct([("line_no", pa.int64()), ("members", pa.list_(pa.string()))])))


def _joined_sets(sets):
    """(doc_id, line_no, members) of sets that share a member, which may lie in any number of tasks."""
    rows = sets.select("doc_id", "line_no", F.explode("members").alias("member"))
    # Sets sort before members, so the least node of a component is its earliest set.
    set_node = F.struct("doc_id", F.lit(0).alias("kind"), "line_no", F.lit("").alias("member"))
    member_node = F.struct("doc_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("line_no"), "member")
    found = connected_components(rows.select(set_node.alias("src"), member_node.alias("dst")))
    members = (
        found.filter("node.kind = 1")
        .groupBy("component")
        .agg(F.array_sort(F.collect_list("node.member")).alias("members"))
    )
    return members.select("component.doc_id", "component.line_no", "members")


def merge_equivs(equivs: DataFrame) -> DataFrame:
    """Equivalence sets that share a member become one set, with the type and place of the earliest.

    The sets of a chunk of a document are merged in one row. Only documents with several chunks need rounds, over what is
    merged by then.
    """
    sets = equivs.filter(F.size("members") > 0).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "members")
    chunk = bucket_of(F.col("line_no"), DEFAULT_CHUNK).alias("_chunk")
    packed = sets.groupBy("doc_id", chunk).agg(F.collect_list(F.struct("line_no", "members")).alias("_s"))
    merged = packed.withColumn("_m", merged_sets("_s.line_no", "_s.members"))
    parts = cut_lineage(merged.select("doc_id", "_chunk", F.explode("_m").alias("_m")).select("doc_id", "_chunk", "_m.*"))
    several = F.min("_chunk") < F.max("_chunk")
    long = parts.groupBy("doc_id").agg((several | (F.count("_chunk") < F.count(F.lit(1)))).alias("_long")).filter("_long")
    long = cut_lineage(long.select("doc_id"))
    merged = parts.select("doc_id", "line_no", "members")
    if not long.isEmpty():
        rest = _joined_sets(merged.join(long, "doc_id", "left_semi"))
        merged = merged.join(long, "doc_id", "left_anti").unionByName(rest)
    first = equivs.select("doc_id", "line_no", "ann_id", "type")
    return merged.join(first, ["doc_id", "line_no"]).select("doc_id", "ann_id", "line_no", "type", "members")


# W04
def new_ids(existing: DataFrame, rows: DataFrame, prefix: str, order, rank=None) -> DataFrame:
    """Gives ``rows`` the next ids of ``prefix`` in their document: highest number in use plus a running number.

    With ``rank`` the running number stays, in a column of that name.
    """
    number = F.regexp_extract("ann_id", "^" + prefix + "([0-9]+)$", 1)
    top = (
        existing.filter(F.rlike("ann_id", F.lit("^" + prefix + "[0-9]+$")))
        .groupBy("doc_id")
        .agg(F.max(number.cast("long")).alias("_top"))
    )
    place = rank or "_rank"
    numbered = row_numbers(rows, ["doc_id"], order[0], place, tie=order[1:])
    made = (
        numbered.join(top, "doc_id", "left")
        .withColumn("_num", F.coalesce("_top", F.lit(0)) + F.col(place))
        .withColumn("ann_id", F.concat(F.lit(prefix), F.col("_num").cast("string")))
        .drop("_top", "_num")
    )
    return made if rank else made.drop(place)


# W10
def number_roles(args: DataFrame, order) -> DataFrame:
    """Distinct role names per event: the first keeps its name, later ones get 2, 3, … appended."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "ann_id", "role").orderBy(*order))
    name = F.when(rank == 1, F.col("role")).otherwise(F.concat("role", rank.cast("string")))
    return args.withColumn("numbered_role", name)
