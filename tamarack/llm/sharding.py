"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are put in one global order, each range partition sums its bytes once, the running total of those few sums
gives every partition its first byte, and a running sum inside the partition gives every row its own. Shards are cut
at equal byte targets. Everything is a built-in DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.llm.common import durable, spread_join

ROW_OVERHEAD = 16
#: Shards may differ by the largest row, which nothing can cut, or by this part of a shard if that is more.
IMBALANCE = 0.01


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = ROW_OVERHEAD) -> DataFrame:
    """Deals rows into shards 0 to n_shards - 1, contiguous in the order (crc32 of the text, size, id).

    Returns id, size, text_crc32, shard, slot (0, 1, ... in each shard). Equal texts are neighbours in that order; a
    group of them is kept in one shard unless it is larger than both the largest row and a hundredth of a shard, which
    is how far shards may differ anyway. A very long text counts like any other. A null text has no bytes and crc32 0;
    a null id sorts first; repeated rows each get a slot; other columns, whatever their names, are not looked at; no
    rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = ["crc", "size", "id"]
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    dealt = durable(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))

    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the exchange above, whatever the data
    firsts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("first_byte"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_row"))
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.withColumn("bytes_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("rows_in", F.count("*").over(inside))
        .join(F.broadcast(firsts), "part")
        .select("id", "size", "crc", (F.col("first_byte") + F.col("bytes_in")).alias("start"), (F.col("first_row") + F.col("rows_in")).alias("row"))
    )
    placed = durable(placed)

    groups = durable(placed.groupBy("crc", "size").agg(F.min("start").alias("group_start"), F.count("*").alias("copies")).withColumn("group_bytes", F.col("copies") * F.col("size")))
    total, largest, n = placed.agg(F.sum("size"), F.max("size"), F.count("*")).first()
    total = total or 1
    whole = (F.col("group_bytes") * n_shards <= F.lit(IMBALANCE) * total) | (F.col("group_bytes") <= F.lit(largest or 0))
    # twice the middle byte, so that all stays in whole numbers
    middle = F.when(whole, F.col("group_start") * 2 + F.col("group_bytes")).otherwise(F.col("start") * 2 + F.col("size"))
    cut = spread_join(placed, groups, ["crc", "size"], "inner", "copies", n).withColumn("middle", middle)
    cut = cut.withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"cast((middle * {n_shards}L) div {2 * total}L as int)")))
    heads = cut.groupBy("shard").agg(F.min("row").alias("head"))  # n_shards rows at most
    return cut.join(F.broadcast(heads), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("head")).alias("slot"))
