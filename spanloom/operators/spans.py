"""Spans against lines, runs of tags, label matrices."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ranges import (
    DEFAULT_CHUNK,
    Chunks,
    overlapping_pairs,
    points_in_intervals,
    running_total,
)


# J05
def annotations_to_lines(textbounds: DataFrame, lines: DataFrame) -> DataFrame:
    """Each annotation with the line its start falls in; annotations outside every line are dropped."""
    spans = lines.select(
        "doc_id", "line_no", "line", F.col("start").alias("line_start"), F.col("end").alias("line_end")
    )
    return points_in_intervals(textbounds, spans, ["doc_id"], "start", "line_start", "line_end")


# J25
def boundary_match(textbounds: DataFrame, lines: DataFrame) -> DataFrame:
    """Annotations that start where a line starts or end where it ends, as the union of two equi-joins."""
    a = textbounds.select("doc_id", "ann_id", "type", "start", "end")
    at_start = a.join(lines.select("doc_id", "line_no", "start"), ["doc_id", "start"])
    at_end = a.join(lines.select("doc_id", "line_no", "end"), ["doc_id", "end"])
    columns = ["doc_id", "line_no", "ann_id", "type"]
    return at_start.select(*columns).union(at_end.select(*columns)).distinct()


# A02
def label_counts(assigned: DataFrame, labels, text="line") -> DataFrame:
    """One row per distinct text, one count column per label."""
    counts = [F.count_if(F.col("type") == label).alias(label) for label in labels]
    return assigned.groupBy(text).agg(*counts)


# A03
def label_matrix(frames, labels, text="line", binary=True) -> DataFrame:
    """Label counts of several sources on top of each other; a missing label counts 0, and 1 is the most when binary."""
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    present = set(out.columns)
    columns = []
    for label in labels:
        value = F.coalesce(F.col(f"`{label}`"), F.lit(0)) if label in present else F.lit(0)
        columns.append((F.least(value, F.lit(1)) if binary else value).cast("long").alias(label))
    return out.select(text, *columns)


# A04
def stack_labels(matrix: DataFrame, labels, text="line") -> DataFrame:
    """One (text, category) row per positive label."""
    long = matrix.unpivot([text], labels, "category", "value")
    return long.filter("value = 1").select(text, "category")


# W02
def runs_to_spans(tokens: DataFrame, policy="recover", chunk=DEFAULT_CHUNK) -> DataFrame:
    """Entities from tagged tokens (doc_id, token_no, start, end, tag in B/I/O, type).

    ``recover`` opens an entity at a stray I, ``discard`` drops it and what follows it up to the next B, ``fail``
    raises, and ``io`` reads equal neighbouring types as one entity. token_no need not be dense within a document.
    """
    if policy == "discard":
        return _runs_from_begin(tokens, chunk)
    chunks = Chunks(tokens, ["doc_id"], "token_no", chunk)
    return _runs(chunks, opened(chunks.previous(chunks.df, ["tag", "type"]), policy))


def seen_runs(seen: DataFrame, policy="recover", chunk=DEFAULT_CHUNK, also=()) -> DataFrame:
    """Like :func:`runs_to_spans` for tokens that know the tag and type before them; those tagged O may be left out.

    ``also`` is what else to make of the tokens of each entity.
    """
    chunks = Chunks(opened(seen, policy), ["doc_id"], "token_no", chunk)
    return _runs(chunks, chunks.df, also)


def _runs(chunks, marked, also=()):
    counted = chunks.total(marked, "_opens", "_before")
    inside = counted.filter("tag <> 'O'").withColumn("entity_no", F.col("_before") + F.col("_opens"))
    return inside.groupBy("doc_id", "entity_no").agg(
        F.min_by("type", "token_no").alias("type"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("token_no").alias("first_token"),
        F.max("token_no").alias("last_token"),
        *also,
    )


def opened(seen: DataFrame, policy="recover") -> DataFrame:
    """Adds _opens (1 where an entity begins) to tokens with the tag and type of the token before."""
    prev_out = F.col("prev_tag").isNull() | (F.col("prev_tag") == "O")
    stray = (F.col("tag") == "I") & (prev_out | ~F.col("prev_type").eqNullSafe(F.col("type")))
    if policy == "io":
        opens = (F.col("tag") != "O") & (prev_out | ~F.col("prev_type").eqNullSafe(F.col("type")))
    elif policy == "recover":
        opens = (F.col("tag") == "B") | stray
    elif policy == "fail":
        broken = F.raise_error(F.concat(F.lit("tag sequence broken at token "), F.col("token_no").cast("string")))
        opens = F.when(stray, broken.cast("boolean")).otherwise(F.col("tag") == "B")
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return seen.withColumn("_opens", opens.cast("int"))


def _runs_from_begin(tokens, chunk):
    breaks = tokens.withColumn("_break", (F.col("tag") != "I").cast("int"))
    counted = running_total(breaks, ["doc_id"], "token_no", "_break", "_before", chunk)
    grouped = counted.withColumn("_run", F.col("_before") + F.col("_break"))
    heads = grouped.filter("_break = 1").select(
        "doc_id", "_run", F.col("tag").alias("_head"), F.col("type").alias("_head_type")
    )
    typed = grouped.join(heads, ["doc_id", "_run"]).filter("_head = 'B'")
    bad = (
        typed.filter("type <> _head_type").groupBy("doc_id", "_run").agg(F.min("token_no").alias("_first_bad"))
    )
    good = typed.join(bad, ["doc_id", "_run"], "left").filter("_first_bad IS NULL OR token_no < _first_bad")
    spans = good.groupBy("doc_id", "_run").agg(
        F.min("_head_type").alias("type"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("token_no").alias("first_token"),
        F.max("token_no").alias("last_token"),
    )
    numbered = running_total(spans.withColumn("_one", F.lit(1)), ["doc_id"], "first_token", "_one", "entity_no", chunk)
    return numbered.withColumn("entity_no", F.col("entity_no") + 1).drop("_one", "_run")


# J16
def merge_split_sentences(sentences: DataFrame, textbounds: DataFrame) -> DataFrame:
    """Sentences joined wherever an annotation reaches over the boundary between them.

    Each boundary (the end of one sentence) is marked when a span starts before it and ends after it; sentences between
    unmarked boundaries form one.
    """
    cut = sentences.select("doc_id", "sentence_no", F.col("end").alias("boundary"))
    spans = textbounds.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end")
    spans = spans.filter("end > start + 1")
    crossed = points_in_intervals(
        cut.withColumn("_inside", F.col("boundary") - 1),
        spans.withColumn("_last", F.col("end") - 1).select("doc_id", "start", "_last"),
        ["doc_id"],
        "_inside",
        "start",
        "_last",
        how="left_semi",
    ).select("doc_id", "sentence_no")
    joined = crossed.select("doc_id", (F.col("sentence_no") + 1).alias("sentence_no"), F.lit(0).alias("_opens"))
    flagged = sentences.join(joined, ["doc_id", "sentence_no"], "left").withColumn(
        "_opens", F.coalesce("_opens", F.lit(1))
    )
    counted = running_total(flagged, ["doc_id"], "sentence_no", "_opens", "_before")
    merged = counted.withColumn("merged_no", F.col("_before") + F.col("_opens") - 1)
    return merged.groupBy("doc_id", "merged_no").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts")
    )


# J07
def overlaps(textbounds: DataFrame) -> DataFrame:
    """Ordered pairs of overlapping annotations with their relation: equal, contained, contains or crossing."""
    columns = ["doc_id", "ann_id", "type", "spans", "start", "end"]
    pairs = overlapping_pairs(textbounds.select(*columns), textbounds.select(*columns), ["doc_id"])
    pairs = pairs.filter("ann_id_a <> ann_id_b")
    return pairs.withColumn("kind", span_relation(F.col("spans_a"), F.col("spans_b")))


def contains_spans(outer, inner):
    """Every span of ``inner`` lies in some span of ``outer``."""
    return F.forall(
        inner, lambda i: F.exists(outer, lambda o: (i["start"] >= o["start"]) & (i["end"] <= o["end"]))
    )


def span_relation(a, b):
    same = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return (
        F.when(same, F.lit("equal"))
        .when(contains_spans(b, a), F.lit("contained"))
        .when(contains_spans(a, b), F.lit("contains"))
        .otherwise(F.lit("crossing"))
    )


# W03
def chunk_sentences(sentences: DataFrame, size=10) -> DataFrame:
    """Adds the document number of each sentence when every ``size`` sentences form a document, and its place in it."""
    return sentences.withColumn("chunk_no", F.floor(F.col("sentence_no") / size).cast("long")).withColumn(
        "chunk_sentence", (F.col("sentence_no") % size).cast("long")
    )


# A19
def sentence_extents(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "sentence_no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
