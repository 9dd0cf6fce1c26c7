"""Positions over a whole table, without sending the table to one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import cut_lineage


def global_row_number(df: DataFrame, order, out: str) -> DataFrame:
    """1-based position in the total order ``order`` (a list of columns that identifies a row).

    One range shuffle on the full order, so a value shared by many rows is still split by the columns after it. The
    sorted rows are checkpointed, which fixes their partitions; row counts per partition then give each one its base.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_place"), 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition of the sort, so the unpartitioned window and the broadcast stay tiny.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    in_part = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(bases), "_part")
        .withColumn(out, (F.col("_base") + in_part + 1).cast("long"))
        .drop("_part", "_base", "_place")
    )
