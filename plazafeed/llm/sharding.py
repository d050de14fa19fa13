"""Records dealt to weighted shards by rendezvous hashing, with their places in the shards.

Every shard draws a number for a record's key, and the highest draw has the record. A draw
depends on the key and the shard alone: a further shard takes records only into itself, a
shard that goes gives its own to the others, and a heavier weight only draws more towards
that shard. Draws come from MD5, so that any engine can tell where a record lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that a shard's records are numbered in; copies of a record that one row is spread out to at a time; buckets of all shards that are broadcast (24 bytes each).
BUCKETS, COPIES, BROADCAST = 1024, 10_000, 1 << 20


def draws(keys: Sequence[str], weights: Sequence[float]) -> Column:
    """The draw of each shard for the record's keys: 60 bits of a hash, and ln(u) / weight where weights differ."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights are positive, and there is one at least")
    key = F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    bits = [F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{i}")).cast("binary")), 1, 15), 16, 10).cast("long") for i in range(len(weights))]
    if len(set(weights)) == 1:
        return F.array(*bits)
    return F.array(*(F.log((b + F.lit(0.5)) / F.lit(float(1 << 60))) / F.lit(float(w)) for b, w in zip(bits, weights)))


def assign(docs: DataFrame, weights: Sequence[float], keys: Sequence[str] = ("doc_id",), out: str = "shard") -> DataFrame:
    """``docs`` with a column ``out``, the shard from 0; of equal draws the lower shard. Null keys are a key; equal keys lie together."""
    drawn = docs.withColumn("_draws", draws(keys, weights))
    return drawn.withColumn(out, (F.array_position("_draws", F.array_max("_draws")) - 1).cast("int")).drop("_draws")


def moves(docs: DataFrame, before: Sequence[float], after: Sequence[float], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The rows of ``docs`` that change shards between two lists of weights, with ``from_shard`` and ``to_shard``."""
    both = assign(assign(docs, before, keys, "from_shard"), after, keys, "to_shard")
    return both.where(F.col("from_shard") != F.col("to_shard"))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], keys: Sequence[str] = ("doc_id",), tasks: int = 8) -> None:
    """Write ``docs`` as Parquet under ``path/shard=N``, each shard by up to ``tasks`` tasks; a shard without rows has no folder."""
    dealt = assign(docs, weights, keys).withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tasks)))
    dealt.repartition(F.col("shard"), F.col("_part")).drop("_part").write.partitionBy("shard").parquet(path)


def placed(docs: DataFrame, shards: int = 16, buckets: int = BUCKETS) -> DataFrame:
    """Each row of ``docs`` with its shard and its place there: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's bytes and one more (null: none), ``grown_shard`` the shard if
    there were one more, ``law`` is ``key``: id and number of shards decide. Slots run from 0
    without gaps: a shard's records fall into buckets by hash, bucket follows bucket, and in
    a bucket order is by id, size and checksum, so that the places depend on the rows alone.
    Equal rows are counted before the shuffle, and spread out again by many tasks; a null id
    is an id; an empty table gives no rows; other columns are ignored.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    light = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    light = light.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    drawn = light.withColumn("_draws", draws(["doc_id"], [1.0] * (shards + 1)))
    top = F.array_max(F.slice("_draws", 1, shards))
    shard = (F.array_position("_draws", top) - 1).cast("int")
    rows = drawn.withColumns({"shard": shard, "grown_shard": F.when(F.element_at("_draws", shards + 1) > top, F.lit(shards)).otherwise(shard).cast("int")})
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32")
    bucket = F.pmod(F.conv(F.substring(F.md5(named.cast("binary")), 1, 5), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    rows = rows.drop("_draws").withColumn("bucket", bucket)
    in_order = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    rows = rows.withColumn("start", F.sum("times").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("times"))
    # one row a shard and bucket, however many records there are
    filled = rows.groupBy("shard", "bucket").agg(F.sum("times").alias("held"))
    first = F.sum("held").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("held")
    begins = filled.select("shard", "bucket", first.alias("first"))
    rows = rows.join(F.broadcast(begins) if shards * buckets <= BROADCAST else begins, ["shard", "bucket"])
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {COPIES}"))))
    parts = parts.repartition("doc_id", "size", "text_crc32", "part")
    copy = F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("times"), (F.col("part") + 1) * COPIES) - 1))
    out = parts.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("first") + F.col("start"), copy.alias("copy"), "grown_shard")
    return out.toDF("doc_id", "size", "text_crc32", "law", "shard", "slot", "copy", "grown_shard").withColumn("slot", F.col("slot") + F.col("copy")).drop("copy")
