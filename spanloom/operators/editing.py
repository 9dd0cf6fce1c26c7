"""Batch edits of annotation tables. Each returns new tables; nothing is changed in place."""

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import role_base, split_role
from spanloom.model import ARGS, Standoff
from spanloom.operators.ranges import DEFAULT_CHUNK, bucket_of, overlapping_pairs, row_numbers, running_total
from spanloom.operators.selecting import new_ids, references
from spanloom.operators.textual import numbered_pieces, text_at, text_blocks
from spanloom.session import cut_lineage


def _next_line(so: Standoff) -> DataFrame:
    """(doc_id, last_line): the last line in use of each document."""
    lines = [df.select("doc_id", F.col("line_no").cast("long").alias("line_no")) for df in so.tables().values()]
    return functools.reduce(DataFrame.unionByName, lines).groupBy("doc_id").agg(F.max("line_no").alias("last_line"))


def _append(so: Standoff, kind: str, rows: DataFrame, prefix: str, order) -> DataFrame:
    """New rows of a kind with ids and line numbers after those in use; ``order`` starts with an integer column."""
    existing = getattr(so, kind)
    numbered = new_ids(existing, rows, prefix, order, rank="_rank")
    placed = numbered.join(_next_line(so), "doc_id", "left").withColumn(
        "line_no", F.coalesce("last_line", F.lit(0)) + F.col("_rank")
    )
    return placed.select(*existing.columns)


# V13
def delete_annotations(so: Standoff, ids: DataFrame):
    """Deletes (doc_id, ann_id) rows; returns the new tables and the ids that were blocked.

    An event or relation that stays blocks the deletion of what it names. Attributes, notes and normalizations go with
    their target, a set loses the member and goes when fewer than two are left, and a deleted event takes its trigger
    along unless something else needs it.
    """
    refs = cut_lineage(
        references(so).filter(F.col("from_kind").isin("events", "relations")).select("doc_id", "from_id", "to_id")
    )
    wanted = cut_lineage(ids.select("doc_id", "ann_id").distinct())

    def settle(pending, gone):
        """Drops from ``pending`` whatever is still named by a row that stays, until nothing more drops."""
        while True:
            going = pending.unionByName(gone) if gone is not None else pending
            stays = refs.join(going.toDF("doc_id", "from_id"), ["doc_id", "from_id"], "left_anti")
            kept = cut_lineage(
                pending.join(stays.select("doc_id", F.col("to_id").alias("ann_id")), ["doc_id", "ann_id"], "left_anti")
            )
            if kept.count() == pending.count():
                return kept
            pending = kept

    deleted = settle(wanted, None)
    blocked = wanted.join(deleted, ["doc_id", "ann_id"], "left_anti")
    orphans = so.events.join(deleted, ["doc_id", "ann_id"], "left_semi").select(
        "doc_id", F.col("trigger").alias("ann_id")
    )
    orphans = orphans.distinct().join(deleted, ["doc_id", "ann_id"], "left_anti")
    deleted = cut_lineage(deleted.unionByName(settle(cut_lineage(orphans), deleted)))

    def keep(kind, df):
        if kind == "equivs":
            lost = df.select("doc_id", "line_no", F.explode("members").alias("ann_id")).join(
                deleted, ["doc_id", "ann_id"], "left_semi"
            )
            lost = lost.groupBy("doc_id", "line_no").agg(F.collect_set("ann_id").alias("_lost"))
            left = df.join(lost, ["doc_id", "line_no"], "left")
            members = F.when(F.col("_lost").isNull(), F.col("members")).otherwise(F.array_except("members", "_lost"))
            return left.withColumn("members", members).filter(F.size("members") >= 2).select(*df.columns)
        df = df.join(deleted, ["doc_id", "ann_id"], "left_anti")
        if kind in ("attributes", "notes", "normalizations"):
            df = df.join(deleted.toDF("doc_id", "target"), ["doc_id", "target"], "left_anti")
        columns = getattr(so, kind).columns
        return df.select(*columns)

    return so.map(keep), blocked


# V14
def create_spans(so: Standoff, docs: DataFrame, edits: DataFrame, event_types) -> Standoff:
    """New annotations from (doc_id, edit_no, type, spans).

    Spans are cut at newlines. An event type reuses a trigger with the same spans and type, and gets an event.
    """
    # What is asked for is read several times; texts are met at the end, and once.
    rows = cut_lineage(edits.join(docs.select("doc_id"), "doc_id", "left_semi").withColumnRenamed("spans", "given"))
    is_event = F.col("type").isin(*event_types)
    same = (
        so.textbounds.filter(is_event)
        .groupBy("doc_id", "type", F.col("spans").alias("given"))
        .agg(F.min_by("ann_id", "line_no").alias("reused"))
    )
    rows = rows.join(same, ["doc_id", "type", "given"], "left")
    # Equal triggers asked for twice in one batch are made once, by the first edit.
    first = rows.filter(is_event & F.col("reused").isNull()).groupBy("doc_id", "type", "given").agg(
        F.min("edit_no").alias("maker")
    )
    rows = rows.join(first, ["doc_id", "type", "given"], "left").withColumn("maker", F.coalesce("maker", "edit_no"))
    fresh = rows.filter("reused IS NULL AND maker = edit_no").select("doc_id", "edit_no", "type", "given")
    numbered = new_ids(so.textbounds, fresh, "T", ["edit_no"], rank="_rank").join(_next_line(so), "doc_id", "left")
    line_no = (F.coalesce("last_line", F.lit(0)) + F.col("_rank")).alias("line_no")
    made = cut_lineage(numbered.select("doc_id", "edit_no", "ann_id", line_no, "type", "given"))
    textbounds = so.textbounds.unionByName(_cut_at_newlines(made, docs).select(*so.textbounds.columns))
    triggers = rows.filter(is_event).join(
        made.select("doc_id", F.col("edit_no").alias("maker"), F.col("ann_id").alias("made_id")), ["doc_id", "maker"], "left"
    )
    events = triggers.select(
        "doc_id", "edit_no", "type", F.coalesce("reused", "made_id").alias("trigger"), F.array().cast(ARGS).alias("args")
    )
    # The lines in use are known without the texts.
    lines = so.textbounds.select("doc_id", "line_no").unionByName(made.select("doc_id", "line_no"))
    appended = _append(so.with_tables(textbounds=lines), "events", events, "E", ["edit_no"])
    return so.with_tables(textbounds=textbounds, events=so.events.unionByName(appended))


def _cut_at_newlines(made, docs):
    """Spans (``given``) cut at the newlines of their text, and what they cover; the spans of a document meet its text as one row."""
    one = F.struct("ann_id", "line_no", "type", "given")
    packed = made.groupBy("doc_id", bucket_of(F.col("line_no"), DEFAULT_CHUNK).alias("_chunk")).agg(F.collect_list(one).alias("_m"))
    met = packed.join(docs.select("doc_id", "text"), "doc_id").withColumn("_blocks", text_blocks(F.col("text")))

    def cut(span):
        lines = F.split(text_at(F.col("_blocks"), span["start"], span["end"] - span["start"]), "\n")
        ends = F.transform(
            lines,
            lambda line, i: F.aggregate(F.slice(lines, F.lit(1), i + 1), F.lit(0), lambda acc, x: acc + F.length(x)) + i,
        )
        pieces = F.zip_with(
            lines,
            ends,
            lambda line, e: F.struct(
                (span["start"] + e - F.length(line)).alias("start"), (span["start"] + e).alias("end"), line.alias("line")
            ),
        )
        return F.filter(pieces, lambda p: p["end"] > p["start"])

    def each(m):
        fields = [m[c].alias(c) for c in ("ann_id", "line_no", "type")]
        return F.struct(*fields, F.flatten(F.transform(m["given"], cut)).alias("p"))

    rows = numbered_pieces(met, ["doc_id"], F.transform("_m", each), "_i", "_c").select("doc_id", "_c.*")
    return rows.withColumns(
        {
            "spans": F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))),
            "start": F.array_min("p.start"),
            "end": F.array_max("p.end"),
            "text": F.array_join("p.line", " "),
        }
    )


def _replace_rows(df, changed, keys):
    """``df`` with the rows of ``changed`` in place of those with the same keys."""
    return df.join(changed.select(*keys), keys, "left_anti").unionByName(changed.select(*df.columns))


# V15
def apply_arc_edits(so: Standoff, edits: DataFrame, schema) -> Standoff:
    """Applies (doc_id, edit_no, action, type, origin, target, old_type, old_target) to relations, sets and arguments.

    Actions are create, change, reverse and delete. The kind follows from the type: an equivalence type edits sets, a
    relation type edits relations, any other type is an event role. A role given to a plain entity makes an event with
    that entity as trigger.
    """
    equiv = F.col("type").isin(*schema.equiv_types)
    relation = F.col("type").isin(*schema.relation_types) & ~equiv
    edits = edits.withColumn(
        "_kind", F.when(equiv, "equiv").when(relation, "relation").otherwise("argument")
    )
    out = _edit_relations(so, edits.filter("_kind = 'relation'"), schema)
    out = _edit_equivs(out, edits.filter("_kind = 'equiv'"))
    return _edit_arguments(out, edits.filter("_kind = 'argument'"))


def _edit_relations(so, edits, schema):
    key = ["doc_id", "type", "arg1", "arg2"]
    gone = edits.filter("action = 'delete'").select(
        "doc_id", "type", F.col("origin").alias("arg1"), F.col("target").alias("arg2")
    )
    relations = so.relations.join(gone, key, "left_anti")
    turned = edits.filter("action = 'reverse'").select(
        "doc_id", "type", F.col("origin").alias("arg1"), F.col("target").alias("arg2"), F.lit(True).alias("_turn")
    ).distinct()
    changed = edits.filter("action = 'change'").select(
        "doc_id",
        F.coalesce("old_type", "type").alias("type"),
        F.col("origin").alias("arg1"),
        F.coalesce("old_target", "target").alias("arg2"),
        F.struct("edit_no", F.col("type").alias("type"), F.col("target").alias("target")).alias("_new"),
    )
    changed = changed.groupBy(*key).agg(F.max("_new").alias("_new"))
    relations = relations.join(changed, key, "left").join(turned, key, "left")
    turn = F.coalesce("_turn", F.lit(False))
    relations = relations.select(
        "doc_id",
        "ann_id",
        "line_no",
        F.coalesce("_new.type", "type").alias("type"),
        "arg1_role",
        F.when(turn, F.col("arg2")).otherwise(F.col("arg1")).alias("arg1"),
        "arg2_role",
        F.when(turn, F.col("arg1")).otherwise(F.coalesce("_new.target", "arg2")).alias("arg2"),
    )
    roles = {}
    for r in schema.relation_rules:
        roles.setdefault(r[0], (r[1], r[3]))
    role_rows = [(t, *pair) for t, pair in roles.items()]
    role_table = so.relations.sparkSession.createDataFrame(role_rows, "type string, arg1_role string, arg2_role string")
    fresh = edits.filter("action = 'create'").join(role_table, "type").select(
        "doc_id", "edit_no", "type", "arg1_role", F.col("origin").alias("arg1"), "arg2_role",
        F.col("target").alias("arg2"),
    )
    return so.with_tables(relations=relations.unionByName(_append(so, "relations", fresh, "R", ["edit_no"])))


def _edit_equivs(so, edits):
    gone = edits.filter("action = 'delete'").select("doc_id", "type", "origin", "target")
    pairs = (
        so.equivs.select("doc_id", "line_no", "type", F.explode("members").alias("origin"), "members")
        .join(gone, ["doc_id", "type", "origin"])
        .filter(F.array_contains("members", F.col("target")))
    )
    lost = pairs.groupBy("doc_id", "line_no").agg(
        F.array_union(F.collect_set("origin"), F.collect_set("target")).alias("_lost")
    )
    left = so.equivs.join(lost, ["doc_id", "line_no"], "left")
    members = F.when(F.col("_lost").isNull(), F.col("members")).otherwise(F.array_except("members", "_lost"))
    equivs = left.withColumn("members", members).filter(F.size("members") >= 2).select(*so.equivs.columns)
    fresh = edits.filter("action = 'create'").select(
        "doc_id", "edit_no", F.lit("*").alias("ann_id"), "type", F.array("origin", "target").alias("members")
    )
    placed = row_numbers(fresh, ["doc_id"], "edit_no", "_rank").join(_next_line(so), "doc_id", "left")
    placed = placed.withColumn("line_no", F.coalesce("last_line", F.lit(0)) + F.col("_rank"))
    return so.with_tables(equivs=equivs.unionByName(placed.select(*so.equivs.columns)))


def _edit_arguments(so, edits):
    event_ids = so.events.select("doc_id", F.col("ann_id").alias("origin"))
    on_events = edits.join(event_ids, ["doc_id", "origin"], "left_semi")
    removed = on_events.filter("action IN ('delete', 'change')").select(
        "doc_id",
        F.col("origin").alias("ann_id"),
        F.struct(F.coalesce("old_type", "type").alias("role"), F.coalesce("old_target", "target").alias("arg")).alias("r"),
    )
    added = on_events.filter("action IN ('create', 'change')").select(
        "doc_id",
        F.col("origin").alias("ann_id"),
        F.struct("edit_no", F.col("type").alias("role"), F.col("target").alias("arg")).alias("a"),
    )
    removed = removed.groupBy("doc_id", "ann_id").agg(F.collect_list("r").alias("_removed"))
    added = added.groupBy("doc_id", "ann_id").agg(F.array_sort(F.collect_list("a")).alias("_added"))
    touched = so.events.join(removed, ["doc_id", "ann_id"], "left").join(added, ["doc_id", "ann_id"], "left")
    kept = F.array_except("args", F.coalesce("_removed", F.array().cast(ARGS)))
    new = F.transform(
        F.coalesce("_added", F.array().cast("array<struct<edit_no:bigint,role:string,arg:string>>")),
        lambda a: F.struct(a["role"].alias("role"), a["arg"].alias("arg")),
    )
    new = F.array_except(F.array_distinct(new), kept)
    events = touched.withColumn("args", add_arguments(kept, new)).select(*so.events.columns)

    plain = edits.filter("action = 'create'").join(event_ids, ["doc_id", "origin"], "left_anti")
    spots = so.textbounds.select("doc_id", F.col("ann_id").alias("origin"), F.col("type").alias("origin_type"))
    made = plain.join(spots, ["doc_id", "origin"]).groupBy("doc_id", "origin", "origin_type").agg(
        F.min("edit_no").alias("edit_no"),
        F.array_sort(F.collect_list(F.struct("edit_no", F.col("type").alias("role"), F.col("target").alias("arg")))).alias("a"),
    )
    made_args = F.transform("a", lambda x: F.struct(x["role"].alias("role"), x["arg"].alias("arg")))
    made = made.select(
        "doc_id", "edit_no", F.col("origin_type").alias("type"), F.col("origin").alias("trigger"),
        add_arguments(F.array().cast(ARGS), made_args).alias("args"),
    )
    return so.with_tables(events=events.unionByName(_append(so, "events", made, "E", ["edit_no"])))


def add_arguments(args, new):
    """Arguments with ``new`` appended in turn, each role numbered with the next free number (Theme, Theme2, …)."""

    def place(acc, item):
        parts = split_role(item["role"])
        taken = F.transform(acc, lambda a: a["role"])
        numbers = F.sequence(F.lit(1), F.size(acc) + 1)
        names = F.transform(
            numbers, lambda n: F.when(n == 1, parts["role"]).otherwise(F.concat(parts["role"], n.cast("string")))
        )
        free = F.element_at(F.filter(names, lambda n: ~F.array_contains(taken, n)), 1)
        role = F.when(parts["num"] != "", item["role"]).otherwise(free)
        return F.concat(acc, F.array(F.struct(role.alias("role"), item["arg"].alias("arg"))))

    return F.aggregate(new, args, place)


# W10
def number_all_roles(events: DataFrame) -> DataFrame:
    return events.withColumn("args", add_arguments(F.array().cast(ARGS), F.col("args")))


def _has_role(role):
    return lambda a: a["role"] == role


# V16
def split_events(so: Standoff, ids: DataFrame, roles) -> Standoff:
    """Splits events on roles: one event per combination of the roles' arguments.

    The first combination keeps the id, the others get new ids. Arguments of other events that name the split event also
    name the new ones; attributes, notes and normalizations on it are copied. The roles must each have two or more
    arguments, and no relation may name a split event.
    """
    chosen = so.events.join(ids.select("doc_id", "ann_id"), ["doc_id", "ann_id"], "left_semi")
    args = chosen.withColumn(
        "args", F.transform("args", lambda a: F.struct(role_base(a["role"]).alias("role"), a["arg"].alias("arg")))
    )
    fixed = F.filter("args", lambda a: ~a["role"].isin(*roles))
    combos = args.withColumn("_combo", fixed).withColumn("_order", F.array().cast("array<int>"))
    for role in reversed(roles):
        having = F.filter("args", _has_role(role))
        if args.filter(F.size(having) < 2).limit(1).count():
            raise ValueError(f"cannot split on {role}: an event has fewer than two such arguments")
        combos = combos.withColumn("_choice", having)
        combos = combos.select("*", F.posexplode("_choice").alias("_pos", "_arg"))
        combos = combos.withColumns(
            {"_combo": F.concat("_combo", F.array("_arg")), "_order": F.concat("_order", F.array("_pos"))}
        ).drop("_choice", "_pos", "_arg")
    rank = F.row_number().over(Window.partitionBy("doc_id", "ann_id").orderBy("_order"))
    combos = combos.withColumn("_nth", rank).select(
        "doc_id", F.col("ann_id").alias("_from"), "line_no", "type", "trigger", F.col("_combo").alias("args"), "_nth"
    )
    combos = cut_lineage(combos)
    first = combos.filter("_nth = 1").select(
        "doc_id", F.col("_from").alias("ann_id"), "line_no", "type", "trigger", "args"
    )
    named = so.relations.select("doc_id", F.explode(F.array("arg1", "arg2")).alias("_from")).join(
        combos.select("doc_id", "_from"), ["doc_id", "_from"], "left_semi"
    )
    if named.limit(1).count():
        raise ValueError("a relation names an event to be split")
    rest = combos.filter("_nth > 1").withColumn("_place", F.col("line_no"))
    copies = cut_lineage(new_ids(so.events, rest, "E", ["_place", "_from", "_nth"]))
    last = _next_line(so)
    lined = row_numbers(copies, ["doc_id"], "_place", "_n", tie=["_from", "_nth"]).join(last, "doc_id", "left")
    lined = lined.withColumn("line_no", F.coalesce("last_line", F.lit(0)) + F.col("_n"))
    events = _replace_rows(so.events, first, ["doc_id", "ann_id"]).unionByName(lined.select(*so.events.columns))

    by_source = copies.groupBy("doc_id", "_from").agg(
        F.array_sort(F.collect_list(F.struct("_nth", "ann_id"))).alias("_new")
    )
    users = events.select("doc_id", "ann_id", F.posexplode("args").alias("_pos", "a")).select(
        "doc_id", "ann_id", "_pos", "a.role", F.col("a.arg").alias("_from")
    )
    extra = users.join(by_source, ["doc_id", "_from"]).select(
        "doc_id", "ann_id", "_pos", "role", F.explode("_new").alias("n")
    )
    extra = extra.groupBy("doc_id", "ann_id").agg(
        F.array_sort(
            F.collect_list(F.struct("_pos", F.col("n._nth").alias("k"), "role", F.col("n.ann_id").alias("arg")))
        ).alias("_extra")
    )
    more = F.transform("_extra", lambda x: F.struct(x["role"].alias("role"), x["arg"].alias("arg")))
    events = events.join(extra, ["doc_id", "ann_id"], "left").withColumn(
        "args", F.when(F.col("_extra").isNull(), F.col("args")).otherwise(F.concat("args", more))
    ).select(*so.events.columns)
    out = so.with_tables(events=events)
    pairs = copies.select("doc_id", F.col("_from").alias("target"), F.col("ann_id").alias("_to"))
    for kind, prefix in (("attributes", "A"), ("normalizations", "N"), ("notes", "#")):
        table = getattr(so, kind)
        copied = table.join(pairs, ["doc_id", "target"]).withColumn("_place", F.col("line_no"))
        copied = copied.withColumn("target", F.col("_to")).drop("ann_id", "line_no")
        grown = table.unionByName(_append(out, kind, copied, prefix, ["_place", "_to"]))
        out = out.with_tables(**{kind: grown})
    return out


# V17
def entities_to_events(so: Standoff, type_: str) -> Standoff:
    """Every text-bound of a type gets an event of that type; arguments and notes that named it name the event."""
    spots = so.textbounds.filter(F.col("type") == type_).select(
        "doc_id", F.col("ann_id").alias("trigger"), "type", F.col("line_no").alias("_place")
    )
    made = cut_lineage(_append(so, "events", spots.withColumn("args", F.array().cast(ARGS)), "E", ["_place"]))
    renamed = made.select("doc_id", F.col("trigger").alias("_old"), F.col("ann_id").alias("_new"))
    return so.with_tables(
        events=_rewrite_args(so.events, renamed).unionByName(made),
        notes=_rewrite_column(so.notes, renamed, "target"),
    )


def _rewrite_column(df, renamed, column):
    """``df`` with ids in ``column`` replaced by (doc_id, _old, _new) where there is one."""
    joined = df.join(renamed.withColumnRenamed("_old", column), ["doc_id", column], "left")
    return joined.withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def _rewrite_list(df, renamed, column, id_of, build):
    """Rewrites the ids inside an array column through an explode, a join and a regroup in the old order."""
    row = ["doc_id", "ann_id", "line_no"]
    items = df.select(*row, F.posexplode(column).alias("_pos", "_item"))
    items = items.withColumn("_old", id_of(F.col("_item"))).join(renamed, ["doc_id", "_old"], "left")
    items = items.withColumn("_item", build(F.col("_item"), F.coalesce("_new", "_old")))
    back = items.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("_pos", "_item"))).alias("_items"))
    joined = df.join(back, row, "left")
    new = F.when(F.col("_items").isNull(), F.col(column)).otherwise(F.transform("_items", lambda x: x["_item"]))
    return joined.withColumn(column, new).select(*df.columns)


def _rewrite_args(events, renamed):
    return _rewrite_list(
        events, renamed, "args", lambda a: a["arg"],
        lambda a, new: F.struct(a["role"].alias("role"), new.alias("arg")),
    )


def rewrite_references(so: Standoff, renamed: DataFrame) -> Standoff:
    """All references replaced by (doc_id, _old, _new)."""
    relations = _rewrite_column(_rewrite_column(so.relations, renamed, "arg1"), renamed, "arg2")
    events = _rewrite_args(_rewrite_column(so.events, renamed, "trigger"), renamed)
    equivs = _rewrite_list(so.equivs, renamed, "members", lambda m: m, lambda m, new: new)
    return so.with_tables(
        relations=relations,
        events=events,
        equivs=equivs,
        attributes=_rewrite_column(so.attributes, renamed, "target"),
        normalizations=_rewrite_column(so.normalizations, renamed, "target"),
        notes=_rewrite_column(so.notes, renamed, "target"),
    )


# V18
def set_properties(so: Standoff, targets, attributes=None, normalizations=None, comments=None) -> Standoff:
    """Makes the attributes, normalizations and comment of the given (doc_id, target) rows equal to what is wanted.

    ``attributes`` is (doc_id, target, type, value), ``normalizations`` (doc_id, target, refdb, refid, reftext) and
    ``comments`` (doc_id, target, note); a table left out is not touched.
    """
    targets = targets.select("doc_id", "target").distinct()
    out = so
    if attributes is not None:
        out = _set_rows(out, "attributes", "A", targets, attributes, ["type"], ["value"], {})
    if normalizations is not None:
        out = _set_rows(
            out, "normalizations", "N", targets, normalizations, ["refdb", "refid"], ["reftext"], {"type": "Reference"}
        )
    if comments is not None:
        wanted = comments.filter("note <> ''").withColumn("type", F.lit("AnnotatorNotes"))
        out = _set_rows(out, "notes", "#", targets, wanted, ["type"], ["note"], {}, "type = 'AnnotatorNotes'")
    return out


def _set_rows(so, kind, prefix, targets, wanted, keys, values, constants, scope="true"):
    table = getattr(so, kind)
    key = ["doc_id", "target", *keys]
    scoped = table.filter(scope).join(targets, ["doc_id", "target"], "left_semi")
    outside = table.filter(~F.expr(scope)).unionByName(
        table.filter(scope).join(targets, ["doc_id", "target"], "left_anti")
    )
    new = wanted.select(*key, *[F.col(v).alias(f"_new_{v}") for v in values])
    both = scoped.join(new, key)
    for v in values:
        both = both.withColumn(v, F.col(f"_new_{v}"))
    fresh = wanted.join(scoped, key, "left_anti").withColumns({k: F.lit(v) for k, v in constants.items()})
    number = F.regexp_extract("target", "([0-9]+)$", 1).cast("long")
    fresh = fresh.withColumn("_place", F.coalesce(number, F.lit(0)))
    added = _append(so, kind, fresh, prefix, ["_place", "target", *keys])
    return so.with_tables(**{kind: outside.unionByName(both.select(*table.columns)).unionByName(added)})


# V19
def changes(before: DataFrame, after: DataFrame, keys=("doc_id", "ann_id")) -> DataFrame:
    """(keys, change): added, deleted, or changed rows between two versions of a table."""
    keys = list(keys)
    data = [c for c in before.columns if c not in keys]

    def digest(df, name):
        return df.select(*keys, F.to_json(F.struct(*data), {"ignoreNullFields": "false"}).alias(name))

    both = digest(before, "_before").join(digest(after, "_after"), keys, "full_outer")
    kind = (
        F.when(F.col("_before").isNull(), "added")
        .when(F.col("_after").isNull(), "deleted")
        .when(F.col("_before") != F.col("_after"), "changed")
    )
    return both.withColumn("change", kind).filter("change IS NOT NULL").select(*keys, "change")


# W08
def renumber(so: Standoff) -> Standoff:
    """Ids renumbered from 1 per document and letter in order of appearance, every reference rewritten."""
    prefix = F.regexp_extract("ann_id", "^([A-Za-z]+|#[A-Za-z]*)", 1)
    ids = None
    for kind, df in so.tables().items():
        if kind != "equivs":
            part = df.select("doc_id", "ann_id", "line_no", prefix.alias("_prefix"))
            ids = part if ids is None else ids.unionByName(part)
    numbered = row_numbers(ids, ["doc_id", "_prefix"], "line_no", "_n")
    renamed = cut_lineage(
        numbered.select(
            "doc_id", F.col("ann_id").alias("_old"), F.concat("_prefix", F.col("_n").cast("string")).alias("_new")
        )
    )
    out = rewrite_references(so, renamed)
    return out.map(lambda kind, df: df if kind == "equivs" else _rewrite_column(df, renamed, "ann_id"))


# W09
def concat_documents(docs: DataFrame, so: Standoff, group, order) -> tuple:
    """Documents of a group laid end to end in the given order, with offsets shifted and ids kept unique.

    ``docs`` has (doc_id, text, group, order). The first document that uses an id keeps it; later ones get the next free
    number of that letter, and their references follow. Returns (pieces, annotations) keyed by the group: a group's text
    stays in pieces (doc_id, piece_no, start, text), one for each of its documents, so that no group has to fit into a
    row; :func:`join_pieces` makes one string of them, :func:`cut_spans` finds the text of spans in them.
    """
    sized = docs.select("doc_id", F.col(group).alias("_group"), F.col(order).alias("_order"),
                        F.length("text").alias("_len"))
    shift = running_total(sized, ["_group"], "_order", "_len", "_shift")
    place = cut_lineage(row_numbers(shift, ["_group"], "_order", "_doc_no").drop("_len", "_order"))
    # Lines of a document come after all lines of the documents before it.
    lines = None
    for df in so.tables().values():
        part = df.groupBy("doc_id").agg(F.max("line_no").alias("_lines"))
        lines = part if lines is None else lines.unionByName(part)
    lines = lines.groupBy("doc_id").agg((F.max("_lines") + 1).cast("long").alias("_lines"))
    place = place.join(lines, "doc_id", "left").withColumn("_lines", F.coalesce("_lines", F.lit(0)))
    place = cut_lineage(running_total(place, ["_group"], "_doc_no", "_lines", "_line_shift").drop("_lines"))
    prefix = F.regexp_extract("ann_id", "^([A-Za-z]+|#[A-Za-z]*)", 1)
    number = F.regexp_extract("ann_id", "([0-9]+)", 1).cast("long")
    ids = None
    for kind, df in so.tables().items():
        if kind != "equivs":
            part = df.select("doc_id", "ann_id", prefix.alias("_prefix"), number.alias("_num"))
            ids = part if ids is None else ids.unionByName(part)
    ids = ids.join(place, "doc_id")
    first = ids.groupBy("_group", "ann_id").agg(F.min("_doc_no").alias("_first"))
    later = ids.join(first, ["_group", "ann_id"]).filter("_doc_no > _first")
    top = ids.groupBy("_group", "_prefix").agg(F.max("_num").alias("_top"))
    fresh = row_numbers(later, ["_group", "_prefix"], "_doc_no", "_n", tie=["_num", "ann_id"])
    renamed = cut_lineage(
        fresh.join(top, ["_group", "_prefix"]).select(
            "doc_id",
            F.col("ann_id").alias("_old"),
            F.concat("_prefix", (F.col("_top") + F.col("_n")).cast("string")).alias("_new"),
        )
    )
    out = rewrite_references(so, renamed)

    def move(kind, df):
        if kind != "equivs":
            df = _rewrite_column(df, renamed, "ann_id")
        moved = df.join(place, "doc_id")
        if kind == "textbounds":
            by = F.col("_shift").cast("int")
            moved = moved.withColumns(
                {
                    "spans": F.transform(
                        "spans", lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"))
                    ),
                    "start": F.col("start") + by,
                    "end": F.col("end") + by,
                }
            )
        moved = moved.withColumn("line_no", F.col("_line_shift") + F.col("line_no"))
        return moved.withColumn("doc_id", F.col("_group")).select(*df.columns)

    at = place.select("doc_id", F.col("_group"), (F.col("_doc_no") - 1).alias("piece_no"), F.col("_shift").alias("start"))
    pieces = docs.select("doc_id", "text").join(at, "doc_id")
    return pieces.select(F.col("_group").alias("doc_id"), "piece_no", "start", "text"), out.map(move)


def join_pieces(pieces: DataFrame) -> DataFrame:
    """(doc_id, text): the pieces of each document as one string, which has to fit into a row."""
    ordered = F.array_sort(F.collect_list(F.struct("piece_no", "text")))
    return pieces.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def cut_spans(spans: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, start, end, text): what stands in the pieces of a document from ``start`` to ``end``, also across pieces.

    Spans and pieces meet by offsets alone; then each touched piece gives only the characters of the span.
    """
    wanted = spans.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    places = pieces.select("doc_id", "piece_no", "start", (F.col("start") + F.length("text")).alias("end"))
    met = overlapping_pairs(wanted.distinct(), places, ["doc_id"], suffixes=("", "_piece"))
    met = met.withColumnRenamed("piece_no_piece", "piece_no").drop("end_piece")
    low = F.greatest(F.col("start") - F.col("start_piece"), F.lit(0)).cast("int")
    high = (F.col("end") - F.col("start_piece")).cast("int")
    texts = pieces.select("doc_id", "piece_no", F.col("text").alias("_text"))
    cut = met.join(texts, ["doc_id", "piece_no"]).select(
        "doc_id", "start", "end", F.struct("piece_no", F.substr("_text", low + 1, high - low).alias("text")).alias("part")
    )
    ordered = F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"])
    return cut.groupBy("doc_id", "start", "end").agg(F.array_join(ordered, "").alias("text"))


def _picking(columns):
    return lambda x: F.struct(*[x[c].alias(c) for c in columns])


# V20
def render_documents(docs: DataFrame, so: Standoff, issues=None, tokens=None, sentences=None) -> DataFrame:
    """One row per document with its annotations, issues, token and sentence offsets as ordered arrays.

    The result is one value per document by definition; each kind is aggregated on its own before the join.
    """
    used = so.events.select("doc_id", F.col("trigger").alias("ann_id"), F.lit(True).alias("_trigger")).distinct()
    t = so.textbounds.join(used, ["doc_id", "ann_id"], "left")
    parts = {
        "entities": (t.filter("_trigger IS NULL"), ["ann_id", "type", "spans"]),
        "triggers": (t.filter("_trigger"), ["ann_id", "type", "spans"]),
        "events": (so.events, ["ann_id", "trigger", "args"]),
        "relations": (so.relations, ["ann_id", "type", "arg1_role", "arg1", "arg2_role", "arg2"]),
        "equivs": (so.equivs, ["ann_id", "type", "members"]),
        "attributes": (so.attributes, ["ann_id", "type", "target", "value"]),
        "normalizations": (so.normalizations, ["ann_id", "type", "target", "refdb", "refid", "reftext"]),
    }
    comments = so.notes.select(
        "doc_id", "line_no", F.col("target").alias("ann_id"), "type", F.col("note").alias("text")
    )
    if issues is not None:
        comments = comments.unionByName(
            issues.select(
                "doc_id", F.lit(None).cast("long").alias("line_no"), "ann_id", F.col("severity").alias("type"),
                F.col("description").alias("text"),
            )
        )
    parts["comments"] = (comments, ["ann_id", "type", "text"])
    if tokens is not None:
        parts["token_offsets"] = (tokens.withColumn("line_no", F.col("token_no").cast("long")), ["start", "end"])
    if sentences is not None:
        parts["sentence_offsets"] = (sentences.withColumn("line_no", F.col("sentence_no").cast("long")), ["start", "end"])
    out = docs.select("doc_id", "text")
    for name, (df, columns) in parts.items():
        rows = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", *columns))).alias(name))
        rows = rows.withColumn(name, F.transform(name, _picking(columns)))
        out = out.join(rows, "doc_id", "left").withColumn(
            name, F.coalesce(name, F.array().cast(rows.schema[name].dataType))
        )
    return out
