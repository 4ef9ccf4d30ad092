"""Sharding by global byte prefix sums, with DataFrame operations only.

Documents get a place in one global order, their sizes are summed up to it, and the
sums are cut at equal targets. The order is by buckets (a range of the text's hash),
so its prefix sums come from one total for each bucket and running sums within each.

Equal texts stay together where the law allows it: they are next to each other in the
order, and a cut never falls into them. Two kinds of groups need more:

* a large group (over ``1 / LARGE`` of all bytes; so there are at most ``LARGE``) is put
  whole into the shard with most room, and the cuts of the rest allow for it;
* one that fits into no shard goes into the order row by row and is cut like the rest,
  for equal sizes come first.

Rows of large groups are spread over as many buckets as their bytes call for, so no
task gets more than its part of a hot group.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.runtime import staged, table

#: Bits of a bucket's number, least and most; rows a bucket is to have; the bound of the number of large groups.
BITS, MOST, ROWS, LARGE = 12, 20, 1 << 18, 4096


def bucket_bits(n: int) -> int:
    """Bits of the order's buckets for n rows. What is broadcast by bucket has at most 2 ** (MOST + 1) + LARGE rows."""
    return min(MOST, max(BITS, (n // ROWS).bit_length()))


def _pack(groups: list[tuple[int, int]], total: int, n: int) -> tuple[dict[int, int], list[int]]:
    """Shard of each large group that fits whole, and the room left in each shard."""
    room = [(-(total * (k + 1) // n - total * k // n), k) for k in range(n)]
    heapq.heapify(room)
    where = {}
    for h, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        free, k = room[0]
        if size <= -free:
            heapq.heapreplace(room, (free + size, k))
            where[h] = k
    return where, [-free for free, _ in sorted(room, key=lambda r: r[1])]


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The law is ``bytes``: shards hold nearly the same number of bytes, a document counting
    its UTF-8 bytes plus 1. Null and empty texts are both size 1 and one group. Rows with
    a null or repeated id are placed like others; slots are gapless, and equal rows may
    swap theirs. An empty table gives an empty result. Further columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = staged(spark, docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h")), "shard-sizes")
    total, n_rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bits = bucket_bits(n_rows)
    groups = [tuple(r) for r in slim.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("size") * LARGE > total)).select("h", "size").collect()]
    where, room = _pack(groups, total, n_shards)

    rows, base = ["(0L, -1, 0, 0)"], 1 << bits
    for h, size in sorted(groups):
        parts = -((-size << bits) // total)
        rows.append(f"({h}L, {where.get(h, -1)}, {base}, {parts})" if h != -(2**63) else f"(-9223372036854775807L - 1L, {where.get(h, -1)}, {base}, {parts})")
        base += parts
    large = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(h, home, base, parts) WHERE parts > 0")

    spread = F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    at = slim.join(F.broadcast(large), "h", "left").withColumn("bucket", F.coalesce(spread, F.shiftrightunsigned("h", 64 - bits).cast("int")))
    flows = F.col("home").isNull() | (F.col("home") < 0)
    totals = at.where(flows).groupBy("bucket").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))

    ordered = Window.partitionBy("bucket").orderBy("h", "id", "size", "crc")
    start = F.coalesce(F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.min("start").over(Window.partitionBy("bucket", "h"))
    cuts, so_far = [], 0
    for r in room[:-1]:
        so_far += r
        cuts.append(so_far)
    position = F.col("offset") + F.when(F.col("home").isNull(), F.col("first")).otherwise(F.col("start"))
    cut = sum((F.when(position >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    placed = (
        at.withColumn("start", start)
        .withColumn("first", first)
        .join(F.broadcast(offsets), "bucket", "left")
        .withColumn("shard", F.when(flows, cut).otherwise(F.col("home")).cast("int"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h", "id", "size", "crc")))
        .select("id", "size", "crc", "bucket", "shard", "nth")
    )
    placed = staged(spark, placed, "shard-placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    within = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("from"))
    return placed.join(F.broadcast(slots), ["shard", "bucket"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("from") + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_shard(spark, sf_dir: str) -> DataFrame:
    """The contract's query: 16 shards of all documents."""
    return shard(table(spark, sf_dir, "documents"), 16)
