"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source gets a target number of words: its weight's share of the total, but at most ``cap`` times its own words; what
is cut off is shared again by weight among the others. A source first gives all its documents as many whole times as the
target holds its words. The rest of the target is a weighted sample without replacement: every document draws the
exponential key -ln(u) / quality, and the documents with the least keys fill the budget.

Only the place where the budget ends is searched by sorting: words are summed per slice of the key range first, so a
source with a third of all rows is sorted in one slice out of thousands, and whole texts never move.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.tables import with_bound
from spanloom.session import cut_lineage

WEIGHTS = (1, 2, 3)
CAP = 3
SLICES = 4096
QUALITY = {1: 2.0, 0: 0.5}
BROADCAST_ROWS = 1_000_000


def unit_draw(*parts):
    """A number inside (0, 1) that depends on the text of ``parts`` only: the first 52 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _qualities(quality, values):
    """(id, weight): one row per document with a known quality label; the best of several labels counts."""
    known = quality.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").alias("quality")
    )
    weight = F.lit(1.0)
    for label, value in values.items():
        weight = F.when(F.col("quality") == label, F.lit(float(value))).otherwise(weight)
    return known.select(F.col("doc_id").cast("long").alias("_mix_id"), weight.alias("_mix_weight"))


def _drawn(documents, quality, values, seed):
    """``documents`` with _mix_place, a struct whose order is the order in which the documents of a source are taken."""
    if quality is None:
        out = documents.withColumn("_mix_weight", F.lit(1.0))
    else:
        known = with_bound(_qualities(quality, values), BROADCAST_ROWS)
        out = documents.join(known, F.col("doc_id").cast("long") == F.col("_mix_id"), "left").drop("_mix_id")
    key = -F.log(unit_draw(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    key = key / F.coalesce("_mix_weight", F.lit(1.0))
    place = F.struct(
        F.least(F.floor((1 - F.exp(-key)) * SLICES), F.lit(SLICES - 1)).cast("int").alias("slice"),
        key.alias("key"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("text"),
    )
    return out.withColumn("_mix_place", place).drop("_mix_weight")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap=CAP, share=1.0) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources in code point order, null last, weigh ``weights`` in turn. With sources sorted by cap / weight, those up to
    some place stop at their cap and all others get the same level per unit of weight; running sums find the place. One
    row per source goes through the unpartitioned windows.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    turn = ((F.row_number().over(in_order) - 1) % len(weights)).cast("int")
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    ranked = ranked.withColumn("most", F.col("source_size") * float(cap))
    before = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", left / weight_left)
    leveled = leveled.withColumn("full", F.col("most") <= F.col("level") * F.col("w"))
    open_order = F.when(~F.col("full"), F.col("most") / F.col("w"))
    level = F.min_by("level", F.when(~F.col("full"), F.struct(open_order, F.col("source").isNull(), F.col("source"))))
    leveled = leveled.withColumn("final", level.over(everything))
    return leveled.select(
        "source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("final") * F.col("w")).alias("target")
    )


def _cuts(slim, weights, cap, share):
    """One row per source: its size, target, whole epochs, and the last place of the partial epoch."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap, share)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    targets = cut_lineage(targets.withColumn("key", F.struct("source")))
    slices = slim.groupBy("source", "_mix_place.slice").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("slice")
    slices = slices.withColumn("end", F.sum("words").over(up_to))
    rest = with_bound(targets.select("key", "rest"), BROADCAST_ROWS)
    last = slices.join(rest, F.struct("source") == F.col("key")).filter("end > rest").groupBy("key").agg(
        F.min(F.struct("slice", (F.col("end") - F.col("words")).alias("before"), "rest")).alias("last")
    )
    last = last.select("key", "last.*")
    inside = slim.join(
        with_bound(last, BROADCAST_ROWS),
        (F.struct("source") == F.col("key")) & (F.col("_mix_place.slice") == F.col("slice")),
    )
    # Equal rows share a place; the last place may be taken by some of them only.
    places = inside.groupBy("key", "slice", "before", "rest", "_mix_place", "size").agg(F.count(F.lit(1)).alias("equal"))
    earlier = Window.partitionBy("key").orderBy("_mix_place").rowsBetween(Window.unboundedPreceding, -1)
    used = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("equal")).over(earlier), F.lit(0))
    first = (used + F.col("size") - F.col("size") / 2 <= F.col("rest")).cast("long")
    several = F.floor((F.col("rest") - used) / F.col("size") + 0.5)
    several = F.least(F.greatest(several, F.lit(0)), F.col("equal"))
    all_alike = (F.col("equal") == 1) | (F.col("size") == 0)
    places = places.withColumn("equal_taken", F.when(all_alike, first * F.col("equal")).otherwise(several))
    ends = places.groupBy("key", "slice").agg(
        F.max(F.when(F.col("equal_taken") > 0, F.struct(F.col("_mix_place").alias("place"), "equal_taken", "equal"))).alias("end")
    )
    cuts = targets.join(ends, "key", "left")
    return cuts.select(
        F.col("key").alias("_mix_key"), F.struct("source_size", "target", "epochs", "slice", "end").alias("_mix_cut")
    )


def _splits_equal(cut):
    """Whether a row stands at the last place of its source's budget and only some of the rows equal to it are taken."""
    there = F.col("_mix_place") == cut["end"]["place"]
    return F.coalesce(there & (cut["end"]["equal_taken"] < cut["end"]["equal"]), F.lit(False))


def _copies(cut):
    """How often the mix takes a row: the whole epochs, and once more before the end of the budget."""
    in_part = (
        cut["slice"].isNull()
        | (F.col("_mix_place.slice") < cut["slice"])
        | F.coalesce(F.col("_mix_place") <= cut["end"]["place"], F.lit(False))
    )
    more = in_part & (cut["target"] > cut["epochs"] * cut["source_size"])
    return (cut["epochs"] + more.cast("long")).cast("int")


def _with_copies(rows, cuts, key):
    """``rows`` (with _mix_place) and their _mix_cut and _mix_copies.

    Rows that are equal at the end of a budget are numbered, by the parts of a written table, and the first ones taken.
    """
    joined = rows.join(with_bound(cuts, BROADCAST_ROWS), key == F.col("_mix_key"))
    cut = F.col("_mix_cut")
    whole = joined.filter(~_splits_equal(cut)).withColumn("_mix_copies", _copies(cut))
    if cuts.filter("_mix_cut.end.equal_taken < _mix_cut.end.equal").isEmpty():
        return whole
    equal = joined.filter(_splits_equal(cut)).withColumn("_mix_number", F.monotonically_increasing_id())
    equal = cut_lineage(equal).withColumn("_mix_part", F.shiftright("_mix_number", 33))
    sizes = equal.groupBy("_mix_key", "_mix_part").agg(F.count(F.lit(1)).alias("_mix_size"))
    before = Window.partitionBy("_mix_key").orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_mix_key", "_mix_part", F.coalesce(F.sum("_mix_size").over(before), F.lit(0)).alias("_mix_base"))
    in_part = F.row_number().over(Window.partitionBy("_mix_key", "_mix_part").orderBy("_mix_number"))
    equal = equal.withColumn("_mix_number", in_part).join(bases, ["_mix_key", "_mix_part"])
    first = F.col("_mix_base") + F.col("_mix_number") <= cut["end"]["equal_taken"]
    equal = equal.withColumn("_mix_copies", (cut["epochs"] + first.cast("long")).cast("int"))
    return whole.unionByName(equal.select(*whole.columns))


def _planned(documents, quality, weights, cap, share, values, seed):
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    drawn = _drawn(rows, quality, values, seed).withColumn("size", words(F.col("text").cast("string")))
    slim = cut_lineage(drawn.select("doc_id", "source", "size", "_mix_place"))
    return slim, cut_lineage(_cuts(slim, weights, cap, share))


def mix_plan(documents, quality=None, weights=WEIGHTS, cap=CAP, share=1.0, values=QUALITY, seed="mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of ``documents`` (doc_id, source, text).

    size counts ``[^\\x20\\x09-\\x0D]+``, 0 for a null text; taken = copies * size. The partial epoch ends where the sum
    is nearest to the target, so a source misses its target by half a document at most. ``quality`` (doc_id, quality)
    gives the weights of ``values``; documents without a label weigh 1. A null source is a source of its own, the last
    one. Of rows equal in doc_id and text where the budget ends, as many are taken as fit; documents without words have
    taken 0. Draws depend on doc_id and ``seed`` only, so reruns agree. Further columns are ignored; an empty table gives an empty result.
    """
    slim, cuts = _planned(documents, quality, weights, cap, share, values, seed)
    joined = _with_copies(slim, cuts, F.struct("source"))
    cut, copies = F.col("_mix_cut"), F.col("_mix_copies")
    return joined.select(
        "doc_id", "size", cut["source_size"].alias("source_size"), cut["target"].alias("target"),
        (copies * F.col("size")).alias("taken"), copies.alias("copies"),
    )


def mix(documents, quality=None, weights=WEIGHTS, cap=CAP, share=1.0, values=QUALITY, seed="mix") -> DataFrame:
    """The rows of ``documents`` as often as :func:`mix_plan` takes them, with their own columns.

    A row's copies follow from its own draw and its source's few numbers, so no text is shuffled.
    """
    _, cuts = _planned(documents, quality, weights, cap, share, values, seed)
    drawn = _drawn(documents, quality, values, seed)
    key = F.struct(F.col("source").cast("string").alias("source"))
    joined = _with_copies(drawn, cuts, key)
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies")))
    return joined.withColumn("_mix_copy", repeated).select(*[F.col(f"`{c}`") for c in documents.columns])
