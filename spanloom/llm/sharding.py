"""Shards by a hierarchical weighted hash tree: region, rack and shard are drawn one after the other.

At each level every child of the node draws -ln(u) / weight from the row's key and its own name, and the least draw wins,
so a child is chosen in proportion to the total weight below it. A child's draw depends on nothing but the key, its name
and its weight: when weights change, rows move only into a subtree that gained or out of one that lost, and no row moves
between subtrees whose weights stay. A new shard opens a region of its own, so it takes rows only into itself.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.ranking import global_row_number
from spanloom.session import cut_lineage

#: Two regions of three racks of four equal shards.
TOPOLOGY = (((1, 1, 1, 1),) * 3,) * 2


def grown(topology, weight=1):
    """The tree with one more shard, which gets the next number."""
    return (*topology, ((weight,),))


def numbered(topology):
    """The same tree with (number, weight) as leaves: shards are numbered from 0 in tree order."""
    count, out = 0, []
    for region in topology:
        racks = []
        for rack in region:
            racks.append([(count + i, w) for i, w in enumerate(rack)])
            count += len(rack)
        out.append(racks)
    return out


def _draw(key, name, weight, seed):
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}/{name}"), key), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _chosen(key, names, weights, results, seed):
    """The result of the child with the least draw; children of weight 0 are never chosen."""
    live = [(n, w, r) for n, w, r in zip(names, weights, results) if w > 0]
    if len(live) < 2:
        return live[0][2] if live else None
    draws = [F.struct(_draw(key, n, w, seed).alias("draw"), F.lit(i).alias("child")) for i, (n, w, _) in enumerate(live)]
    child = F.array_min(F.array(*draws))["child"]
    out = live[-1][2]
    for i in range(len(live) - 2, -1, -1):
        out = F.when(child == i, live[i][2]).otherwise(out)
    return out


def shard_of(key, topology=TOPOLOGY, seed="tree"):
    """Shard number of a key column; only the draws on the way down are made."""
    regions, names, weights = [], [], []
    for r, region in enumerate(numbered(topology)):
        racks = []
        for k, rack in enumerate(region):
            leaves = [F.lit(number) for number, _ in rack]
            racks.append(_chosen(key, [f"{r}/{k}/{s}" for s in range(len(rack))], [w for _, w in rack], leaves, seed))
        totals = [sum(w for _, w in rack) for rack in region]
        live = [x for x, t in zip(racks, totals) if t > 0]
        if live:
            alive = [t for t in totals if t > 0]
            rack_names = [f"{r}/{k}" for k, t in enumerate(totals) if t > 0]
            regions.append(_chosen(key, rack_names, alive, live, seed))
            names.append(str(r))
            weights.append(sum(totals))
    return _chosen(key, names, weights, regions, seed).cast("int")


def assign_shards(documents: DataFrame, topology=TOPOLOGY, seed="tree") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``documents`` (doc_id, text).

    The law is ``key``: doc_id and the tree decide the shard. size is the UTF-8 length plus 8, text_crc32 the unsigned
    CRC-32 of the text's bytes; a null text has no bytes. slot numbers a shard's rows from 0 without gaps in the order
    of doc_id (null first), text_crc32 and size; grown_shard is the shard after one more was added. Repeated rows share
    the shard and get slots of their own, rows without doc_id share one shard. Further columns are ignored; an empty
    table gives an empty result.
    """
    key = F.col("doc_id").cast("long")
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = documents.select(
        key.alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, topology, seed).alias("shard"),
        shard_of(key, grown(topology), seed).alias("grown_shard"),
    )
    # The range shuffle below samples its input, which must not read all texts a second time.
    placed = cut_lineage(placed)
    ordered = global_row_number(placed, ["shard", "doc_id", "text_crc32", "size"], "_rank")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("_rows"))
    starts = counts.select("shard", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # One row per shard of the tree.
    out = ordered.join(F.broadcast(starts), "shard").withColumn("slot", F.col("_rank") - 1 - F.col("_start"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(documents: DataFrame, path: str, topology=TOPOLOGY, seed="tree"):
    """Write all columns of ``documents`` under ``path`` in one folder per shard; returns the path."""
    shard = shard_of(F.col("doc_id").cast("long"), topology, seed)
    documents.withColumn("_shard", shard).write.partitionBy("_shard").parquet(path)
    return path
