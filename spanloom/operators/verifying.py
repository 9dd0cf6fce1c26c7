"""Checks of annotations against a schema, the text, and each other.

Schema rules are a few rows known on the driver, so Spark sees their true size and broadcasts them by itself. Where a
check only depends on types, it is decided once per distinct combination of types and then joined back.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import role_base, span_text
from spanloom.model import Standoff
from spanloom.operators.selecting import arg_counts, duplicate_triggers, references
from spanloom.operators.spans import overlaps
from spanloom.sources.schema import ANY, Schema

ERROR, WARNING, INCOMPLETE = "AnnotationError", "AnnotationWarning", "AnnotationIncomplete"


def _issue(df, severity, description, ann_id="ann_id"):
    return df.select("doc_id", F.col(ann_id).alias("ann_id"), F.lit(severity).alias("severity"),
                     description.alias("description"))


def _with_any(df, columns):
    """Rows repeated with each of ``columns`` as itself and as the ANY wildcard, in m0, m1, …"""
    for i, column in enumerate(columns):
        df = df.withColumn(f"m{i}", F.explode(F.array(F.col(column), F.lit(ANY))))
    return df


def _met(df, keep, columns, rules, rule_columns, exact=()):
    """Distinct ``keep`` combinations of ``df`` that meet some rule; ``exact`` are (column, rule column) pairs."""
    combos = df.select(*keep).distinct()
    tried = _with_any(combos, columns)
    names = [f"m{i}" for i in range(len(columns))]
    renamed = rules.select(
        *[F.col(rc).alias(n) for n, rc in zip(names, rule_columns, strict=True)],
        *[F.col(rc).alias(f"x_{c}") for c, rc in exact],
    ).distinct()
    for c, _ in exact:
        tried = tried.withColumn(f"x_{c}", F.col(c))
    return tried.join(renamed, [*names, *[f"x_{c}" for c, _ in exact]], "left_semi").select(*keep).distinct()


# V01
def check_types(so: Standoff, schema: Schema) -> DataFrame:
    """Events, text-bounds and relations whose type the schema does not have."""
    kinds = [
        (so.events, schema.event_types, "event"),
        (so.textbounds, [*schema.event_types, *schema.entity_types], "textbound"),
        (so.relations, schema.relation_types, "relation"),
    ]
    out = None
    for df, known, what in kinds:
        text = F.format_string(f"Error: %s is not a known {what} type (check configuration?)", F.col("type"))
        part = _issue(df.filter(~F.col("type").isin(*known)), ERROR, text)
        out = part if out is None else out.unionByName(part)
    return out


# V02
def check_equivs(so: Standoff, schema: Schema) -> DataFrame:
    """Members of sets in which some pair of types has no equivalence relation."""
    spark = so.equivs.sparkSession
    members = so.equivs.select(
        "doc_id", "line_no", F.col("type").alias("equiv_type"), F.explode("members").alias("ann_id")
    )
    typed = members.join(so.typed_ids().select("doc_id", "ann_id", "type"), ["doc_id", "ann_id"])
    kinds = typed.groupBy("doc_id", "line_no", "equiv_type").agg(F.array_sort(F.collect_set("type")).alias("types"))
    pairs = kinds.select(
        "doc_id", "line_no", "equiv_type", "types", F.explode("types").alias("t1")
    ).select("doc_id", "line_no", "equiv_type", "t1", F.explode("types").alias("t2"))
    rules = schema.frame(spark, "relation_rules").filter("symmetric AND transitive")
    good = _met(pairs, ["t1", "t2"], ["t1", "t2"], rules, ["arg1_type", "arg2_type"])
    bad = pairs.join(good, ["t1", "t2"], "left_anti")
    low, high = F.least("t1", "t2"), F.greatest("t1", "t2")
    once = bad.groupBy("doc_id", "line_no", "equiv_type", low.alias("low"), high.alias("high")).agg(
        F.min("t1").alias("t1"), F.min_by("t2", "t1").alias("t2")
    )
    text = F.format_string(
        "Equivalence relation %s not allowed between %s and %s", F.col("equiv_type"), F.col("t1"), F.col("t2")
    )
    return _issue(members.drop("equiv_type").join(once, ["doc_id", "line_no"]), ERROR, text)


def allowed_overlaps(schema: Schema):
    """(type_a, type_b, kind) the schema lets overlap, from the side of the first of the pair."""
    out = set()
    for inner, outer, kind in schema.overlap_rules:
        every = kind == ANY
        if every or kind == "equal":
            out |= {(inner, outer, "equal"), (outer, inner, "equal")}
        if every or kind == "contain":
            out |= {(inner, outer, "contained"), (outer, inner, "contains")}
        if every:
            out |= {(outer, inner, "contained"), (inner, outer, "contains")}
        if every or kind == "cross":
            out |= {(inner, outer, "crossing"), (outer, inner, "crossing")}
    return sorted(out)


# V03
def check_overlaps(so: Standoff, schema: Schema) -> DataFrame:
    """Overlapping entities the schema does not let overlap that way; the issue is on the first of each ordered pair."""
    physical = so.textbounds.filter(F.col("type").isin(*schema.entity_types))
    allowed = so.textbounds.sparkSession.createDataFrame(
        allowed_overlaps(schema), "type_a string, type_b string, kind string"
    )
    bad = overlaps(physical).join(allowed, ["type_a", "type_b", "kind"], "left_anti")
    a, b, other = F.col("type_a"), F.col("type_b"), F.col("ann_id_b")
    text = (
        F.when(F.col("kind") == "equal", F.format_string("Error: %s cannot have identical span with %s %s", a, b, other))
        .when(F.col("kind") == "contained", F.format_string("Error: %s cannot be contained in %s (%s)", a, b, other))
        .when(F.col("kind") == "contains", F.format_string("Error: %s cannot contain %s (%s)", a, b, other))
        .otherwise(F.format_string("Error: annotation cannot have crossing span with %s", other))
    )
    return _issue(bad, ERROR, text, "ann_id_a")


# V04
def check_triggers(so: Standoff, schema: Schema) -> DataFrame:
    """Event-typed text-bounds no event uses, and groups of triggers with the same spans and type."""
    used = so.events.groupBy("doc_id", F.col("trigger").alias("ann_id")).agg(
        F.min_by("ann_id", "line_no").alias("event_id")
    )
    marked = so.textbounds.filter(F.col("type").isin(*schema.event_types))
    unused = marked.join(used, ["doc_id", "ann_id"], "left_anti")
    first = _issue(
        unused, INCOMPLETE, F.format_string("Warning: trigger %s is not referenced from any event", F.col("ann_id"))
    )
    doubles = duplicate_triggers(so.textbounds, schema.event_types).join(used, ["doc_id", "ann_id"], "left")
    doubles = doubles.withColumn("on_id", F.coalesce("event_id", "ann_id"))
    text = F.format_string(
        "Warning: triggers %s have identical span and type (harmless but unnecessary duplication)",
        F.array_join("group", ","),
    )
    return first.unionByName(_issue(doubles, WARNING, text, "on_id"))


# V05
def check_relations(so: Standoff, schema: Schema) -> DataFrame:
    """Relations whose argument types or roles fit no rule in either direction; every relation is checked."""
    rules = schema.frame(so.relations.sparkSession, "relation_rules")
    ids = so.typed_ids().select("doc_id", "ann_id", "type")
    typed = (
        so.relations.join(ids.toDF("doc_id", "arg1", "t1"), ["doc_id", "arg1"])
        .join(ids.toDF("doc_id", "arg2", "t2"), ["doc_id", "arg2"])
    )
    shape = ["type", "t1", "t2", "arg1_role", "arg2_role"]

    def fits(first, second, role1, role2):
        by_type = _met(typed, shape, [first, second], rules, ["arg1_type", "arg2_type"], [("type", "type")])
        labels = rules.select(
            "type", F.col("arg1_role").alias(role1), F.col("arg2_role").alias(role2)
        ).distinct()
        return by_type.join(labels, ["type", role1, role2], "left_semi").select(*shape)

    good = fits("t1", "t2", "arg1_role", "arg2_role").unionByName(fits("t2", "t1", "arg2_role", "arg1_role"))
    text = F.format_string(
        "Error: %s relation %s:%s %s:%s not allowed",
        F.col("type"), F.col("arg1_role"), F.col("t1"), F.col("arg2_role"), F.col("t2"),
    )
    return _issue(typed.join(good.distinct(), shape, "left_anti"), ERROR, text)


def _roles(schema, spark):
    """(type, role, min_count, max_count)"""
    return schema.frame(spark, "arg_rules").select("type", "role", "min_count", "max_count").distinct()


# V06
def check_missing_args(so: Standoff, schema: Schema) -> DataFrame:
    """Events with fewer arguments of a role than it needs."""
    needed = _roles(schema, so.events.sparkSession).filter("min_count > 0")
    wanted = so.events.select("doc_id", "ann_id", "type").join(needed, "type")
    counts = arg_counts(so.events).select("doc_id", "ann_id", "role", "n")
    short = wanted.join(counts, ["doc_id", "ann_id", "role"], "left").filter(F.coalesce("n", F.lit(0)) < F.col("min_count"))
    count = F.when(F.col("min_count") == 1, F.format_string("one %s argument ", F.col("role"))).otherwise(
        F.format_string("%d %s arguments ", F.col("min_count"), F.col("role"))
    )
    how = F.when(F.col("min_count") == F.col("max_count"), F.lit("exactly ")).otherwise(F.lit("at least "))
    return _issue(short, INCOMPLETE, F.concat(F.lit("Incomplete: "), how, count, F.lit("required for event")))


# V07
def check_disallowed_args(so: Standoff, schema: Schema) -> DataFrame:
    """Events with a role they cannot take, or an argument of a type the role cannot have."""
    spark = so.events.sparkSession
    rules = schema.frame(spark, "arg_rules").select("type", "role", "target_type")
    relations = schema.frame(spark, "relation_rules").select(
        F.col("arg1_type").alias("type"), F.col("type").alias("role"), F.col("arg2_type").alias("target_type")
    )
    rules = rules.unionByName(relations).distinct()
    args = so.events.select("doc_id", "ann_id", "type", F.explode("args").alias("a")).select(
        "doc_id", "ann_id", "type", role_base(F.col("a.role")).alias("role"), F.col("a.arg").alias("arg")
    )
    takes = _met(args, ["type", "role"], ["type"], rules, ["type"], [("role", "role")])
    wrong_role = args.select("doc_id", "ann_id", "type", "role").distinct().join(takes, ["type", "role"], "left_anti")
    first = _issue(
        wrong_role, ERROR, F.format_string("Error: %s cannot take a %s argument", F.col("type"), F.col("role"))
    )
    ids = so.typed_ids().select("doc_id", F.col("ann_id").alias("arg"), F.col("type").alias("arg_type"))
    typed = args.join(takes, ["type", "role"], "left_semi").join(ids, ["doc_id", "arg"])
    shape = ["type", "role", "arg_type"]
    good = _met(typed, shape, ["type", "arg_type"], rules, ["type", "target_type"], [("role", "role")])
    text = F.format_string(
        "Error: %s argument %s cannot be of type %s", F.col("type"), F.col("role"), F.col("arg_type")
    )
    return first.unionByName(_issue(typed.join(good, shape, "left_anti"), ERROR, text))


# V08
def check_extra_args(so: Standoff, schema: Schema) -> DataFrame:
    """Events with more arguments of a role than it allows."""
    most = _roles(schema, so.events.sparkSession).groupBy("type", "role").agg(F.max("max_count").alias("max_count"))
    many = arg_counts(so.events).filter("n > 1").join(most, ["type", "role"], "left")
    many = many.withColumn("max_count", F.coalesce("max_count", F.lit(0))).filter("max_count <= 1 OR n > max_count")
    text = F.when(
        F.col("max_count") <= 1,
        F.format_string("Error: %s cannot take multiple %s arguments", F.col("type"), F.col("role")),
    ).otherwise(
        F.format_string("Error: %s can take at most %d %s arguments", F.col("type"), F.col("max_count"), F.col("role"))
    )
    return _issue(many, ERROR, text)


# V09
def check_attributes(so: Standoff, schema: Schema) -> DataFrame:
    """Annotations with an attribute their type cannot have; the issue is on the annotation."""
    rules = schema.frame(so.attributes.sparkSession, "attribute_rules")
    ids = so.typed_ids().select("doc_id", F.col("ann_id").alias("target"), F.col("type").alias("target_type"))
    typed = so.attributes.select("doc_id", "target", F.col("type").alias("attr")).join(ids, ["doc_id", "target"])
    good = _met(typed, ["attr", "target_type"], ["target_type"], rules, ["target_type"], [("attr", "attr")])
    text = F.format_string("Error: %s cannot take a %s attribute", F.col("target_type"), F.col("attr"))
    return _issue(typed.join(good, ["attr", "target_type"], "left_anti"), ERROR, text, "target")


# V10
def verify(so: Standoff, schema: Schema) -> DataFrame:
    """All schema checks as one table of issues."""
    checks = [
        check_types, check_equivs, check_overlaps, check_triggers, check_relations, check_missing_args,
        check_disallowed_args, check_extra_args, check_attributes,
    ]
    out = None
    for check in checks:
        part = check(so, schema).withColumn("check", F.lit(check.__name__))
        out = part if out is None else out.unionByName(part)
    return out


# V11
def check_spans(textbounds: DataFrame, docs: DataFrame) -> DataFrame:
    """Text-bounds with the text they cover and ``problem``: null when the spans and the stored text hold.

    An empty stored text is filled from the document; the older form without blanks between spans is accepted and
    rewritten.
    """
    joined = textbounds.join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id")
    spans, text = F.col("spans"), F.col("_text")
    clash = F.exists(
        F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i"))),
        lambda s: F.exists(
            F.slice(spans, F.lit(1), s["i"]), lambda o: (s["end"] >= o["start"]) & (s["start"] < o["end"])
        ),
    )
    covered, older = span_text(text, spans), span_text(text, spans, sep="")
    blank = F.trim(F.coalesce(F.col("text"), F.lit(""))) == ""
    size = F.aggregate(spans, F.lit(0), lambda acc, s: acc + s["end"] - s["start"]) + F.size(spans) - 1
    problem = (
        F.when(F.exists(spans, lambda s: s["start"] > s["end"]), "start > end")
        .when(F.exists(spans, lambda s: s["start"] < 0), "start < 0")
        .when(F.exists(spans, lambda s: s["end"] > F.length(text)), "offset exceeds text length")
        .when(clash, "spans overlap")
        .when(blank & (size > 0), F.lit(None).cast("string"))
        .when(F.length("text") < F.length(older), "text shorter than spans")
        .when((F.substr("text", F.lit(1), F.length(covered)) != covered) & ~F.startswith(F.col("text"), older),
              "text differs from spans")
    )
    checked = joined.withColumn("problem", problem)
    return checked.withColumn("text", F.when(F.col("problem").isNull(), covered).otherwise(F.col("text"))).drop("_text")


# V12
def check_structure(so: Standoff) -> DataFrame:
    """Undefined references, events without a text-bound trigger of their type, triggers named by non-events."""
    ids = so.typed_ids()
    refs = references(so)
    target = ids.select("doc_id", F.col("ann_id").alias("to_id"))
    undefined = refs.join(target, ["doc_id", "to_id"], "left_anti")
    first = undefined.select("doc_id", F.col("from_id").alias("ann_id"), F.lit("undefined reference").alias("problem"),
                             F.col("to_id").alias("about"))
    spots = so.textbounds.select("doc_id", F.col("ann_id").alias("trigger"), F.col("type").alias("trigger_type"))
    known = ids.select("doc_id", F.col("ann_id").alias("trigger")).withColumn("_known", F.lit(True))
    trig = so.events.join(spots, ["doc_id", "trigger"], "left").join(known, ["doc_id", "trigger"], "left")
    problem = F.when(F.col("_known").isNull(), "event without trigger").when(
        F.col("trigger_type").isNull() | (F.col("trigger_type") != F.col("type")), "event with a non-trigger"
    )
    second = trig.select("doc_id", "ann_id", problem.alias("problem"), F.col("trigger").alias("about")).filter(
        "problem IS NOT NULL"
    )
    others = refs.filter(~F.col("from_kind").isin("events", "relations", "equivs"))
    triggers = so.events.select("doc_id", F.col("trigger").alias("to_id"))
    third = others.join(triggers, ["doc_id", "to_id"], "left_semi").select(
        "doc_id", F.col("from_id").alias("ann_id"), F.lit("trigger referenced by a non-event").alias("problem"),
        F.col("to_id").alias("about"),
    )
    return first.unionByName(second).unionByName(third)
