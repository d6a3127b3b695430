"""Sharding by extendible hashing.

A row's key is a hash of 64 bits; where rows of one key fill more than a
shard, a hash of the row's number follows it. The directory maps prefixes of the key to
shards: it starts with none of the bits, and a bucket is split on its next bit
only while it is over the byte limit. Bytes are counted by prefixes of
``STEP`` more bits at a time, summed before they are shuffled; all buckets of
those bits are settled from the counts, and only rows of cells that are over
the limit even then are counted again, deeper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import checkpointed

LIMIT = 8 << 20
STEP = 12
#: Bits of a key, and of a row's number after it.
KEY_BITS = 64
#: Cells of a round that may be broadcast; the first round has at most ``2 ** STEP``.
BROADCAST_CELLS = 1 << 16


def key_bits(*columns: Column) -> Column:
    """64 hash bits as text, the first of the MD5 of the columns' texts."""
    known = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in columns]
    return F.lpad(F.conv(F.substring(F.md5(F.concat_ws("|", *known)), 1, 16), 16, 2), KEY_BITS, "0")


def directory(sizes: DataFrame, limit: int = LIMIT, step: int = STEP, start: int = 0) -> DataFrame:
    """``(prefix, bytes, rows)`` of the shards, from ``(bits, size)`` of every row.

    No prefix is one of another, together they hold every row, and each is as
    short as the limit allows, though of ``start`` bits at least. A shard over
    the limit holds a single row, or rows that all their bits can't tell apart.
    """
    most = start + KEY_BITS
    leaves, deep, depth = None, sizes, start
    while True:
        to = min(depth + step, most)
        cells = deep.groupBy(F.substring("bits", 1, to).alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        every = cells.select("bytes", "rows", F.explode(F.sequence(F.lit(depth), F.lit(to))).alias("depth"), "cell").groupBy(F.expr("substring(cell, 1, depth)").alias("prefix"), "depth").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        every = checkpointed(every.withColumn("fits", (F.col("bytes") <= limit) | (F.col("rows") == 1)))
        split = every.where(~F.col("fits")).select(F.col("prefix").alias("parent"), (F.col("depth") + 1).alias("depth"))
        below = every.where(F.col("depth") > depth).withColumn("parent", F.expr("substring(prefix, 1, depth - 1)")).join(split, ["parent", "depth"], "left_semi").select("prefix", "depth", "bytes", "rows", "fits")
        found = every.where(F.col("depth") == depth).select("prefix", "depth", "bytes", "rows", "fits").unionByName(below)
        settled = found.where(F.col("fits") | (F.col("depth") == most)).select("prefix", "bytes", "rows")
        leaves = settled if leaves is None else leaves.unionByName(settled)
        over = found.where(~F.col("fits") & (F.col("depth") == to)).select(F.col("prefix").alias("over"))
        if to == most or not (n := over.count()):
            return leaves
        over = F.broadcast(over) if n <= BROADCAST_CELLS else over
        deep = deep.join(over, F.substring("bits", 1, to) == F.col("over"), "left_semi")
        depth = to


def sharded(docs: DataFrame, size: Column, *key: Column, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """``docs`` with ``shard``, the hash prefix of the row's shard (empty if one shard is enough).

    ``size``: a row's bytes, null counting as none; ``key``: what is hashed,
    null or not. Rows of one key that are over the limit together are written
    to the shared folder with a number each, whose hash goes on where the key's
    ends; so repeated rows may part. Every row of ``docs`` has one shard. A
    column of ``docs`` named ``shard`` is replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    keyed = docs.select(F.struct(*kept).alias("row"), key_bits(*key).alias("bits"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    shards = checkpointed(directory(keyed.select("bits", "size"), limit, step))
    full = shards.where((F.length("prefix") == KEY_BITS) & (F.col("bytes") > limit) & (F.col("rows") > 1)).select(F.col("prefix").alias("bits"))
    if full.isEmpty():
        return _placed(keyed, shards.select("prefix"))
    rest = checkpointed(keyed.join(full, "bits", "left_semi").withColumn("number", F.monotonically_increasing_id()))
    numbered = rest.select("row", F.concat("bits", key_bits(F.col("number"))).alias("bits"), "size")
    deep = checkpointed(directory(numbered.select("bits", "size"), limit, step, KEY_BITS))
    others = shards.join(full, F.col("prefix") == F.col("bits"), "left_anti").select("prefix")
    return _placed(keyed.join(full, "bits", "left_anti"), others).unionByName(_placed(numbered, deep.select("prefix")))


def _placed(keyed: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The rows with their shards, found by the bits that all prefixes have at least."""
    n, least = prefixes.agg(F.count("*"), F.coalesce(F.min(F.length("prefix")), F.lit(0))).first()
    cell = lambda bits: F.substring(bits, 1, least)
    under = prefixes.groupBy(cell("prefix").alias("cell")).agg(F.collect_list("prefix").alias("under"))
    joined = keyed.withColumn("cell", cell("bits")).join(F.broadcast(under) if n <= BROADCAST_CELLS else under, "cell", "left")
    return joined.select("row.*", F.filter("under", lambda p: F.startswith("bits", p))[0].alias("shard"))


def written(shards: DataFrame, path: str) -> None:
    """A folder for each shard under ``path``; a shard's rows are written by one task, which its limit bounds."""
    shards.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
