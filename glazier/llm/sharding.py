"""Operator 8, sharding: jump consistent hashing of stable keys, without a ring table.

The jump generator is Lamping and Veach's: a 64-bit linear congruential step per jump, so a key's
shard depends on the key and the shard count only, and adding shards moves rows only into the new
ones.  All of it is DataFrame expressions.  Spark's ANSI arithmetic raises on overflow, so the
64-bit product is made of 32-bit halves.

Rows of a shard are numbered without one task per shard: each shard is cut into ``SLOT_CUTS``
buckets by bits of the key's first generator step, rows are numbered inside a bucket, and the
bucket's start is a running sum over at most shards x SLOT_CUTS counts.

Defined cases: a null key counts as key 0; a null text has no bytes (size 1, CRC of the empty
string); repeated rows share the shard and get slots of their own; an empty table gives no rows;
extra columns are kept by ``assign_shards`` unless they carry the name of an output column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glazier.llm.common import read_table, text_or_empty

# The generator's multiplier, and bits for buckets inside a shard.
LCG = 2862933555777941757
SLOT_BITS = 12
SLOT_CUTS = 1 << SLOT_BITS
_LOW32 = 0xFFFFFFFF


def _lcg_step(high: Column, low: Column) -> tuple[Column, Column]:
    """(key * LCG + 1) mod 2^64 of a key given as unsigned 32-bit halves."""
    m_high, m_low = LCG >> 32, LCG & _LOW32
    m_low1, m_low0 = m_low >> 16, m_low & 0xFFFF

    def low32_product(a: Column, m: int) -> Column:
        return (a * F.lit(m & 0xFFFF) + F.shiftleft((a * F.lit(m >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)) \
            .bitwiseAND(F.lit(_LOW32))

    part0, part1 = low * F.lit(m_low0), low * F.lit(m_low1)
    sum_low = F.shiftleft(part1.bitwiseAND(F.lit(0xFFFF)), 16) + part0.bitwiseAND(F.lit(_LOW32)) + F.lit(1)
    sum_high = (F.shiftright(part1, 16) + F.shiftright(part0, 32) + F.shiftright(sum_low, 32)
                + low32_product(high, m_low) + low32_product(low, m_high))
    return sum_high.bitwiseAND(F.lit(_LOW32)), sum_low.bitwiseAND(F.lit(_LOW32))


def _halves(key: Column) -> tuple[Column, Column]:
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_LOW32))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a 64-bit key; every jump raises the candidate, so ``shards`` steps suffice."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    high, low = _halves(key)
    start = F.struct(high.alias("h"), low.alias("l"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        h, lo = _lcg_step(s["h"], s["l"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(h, 1) + 1).cast("double")))
        on = F.struct(h.alias("h"), lo.alias("l"), s["j"].alias("b"), jump.cast("long").alias("j"))
        return F.when(s["j"] < F.lit(shards), on).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def _slot_bucket(key: Column) -> Column:
    high, _ = _lcg_step(*_halves(key))
    return F.shiftright(high, 32 - SLOT_BITS)


def assign_shards(df: DataFrame, key: str, shards: int, order: list[str] = ()) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 in each shard; ``order`` settles equal keys)."""
    rows = df.drop("shard", "slot").withColumns({"shard": jump_hash(F.col(key), shards), "_cut": _slot_bucket(F.col(key))})
    counts = rows.groupBy("shard", "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * SLOT_CUTS rows.
    starts = counts.select("shard", "_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_cut").orderBy(F.col(key).asc_nulls_first(), *order)
    return (rows.withColumn("_row", F.row_number().over(inside))
            .join(F.broadcast(starts), ["shard", "_cut"])
            .withColumn("slot", F.col("_start") + F.col("_row") - F.lit(1).cast("long"))
            .drop("_cut", "_start", "_row"))


def write_shards(df: DataFrame, path: str, key: str, shards: int, order: list[str] = ()) -> str:
    """Write one folder per shard (``shard=0`` ...), rows sorted by slot inside a file."""
    (assign_shards(df, key, shards, order).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
    return path


def op8_jump_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 by doc_id, with the shard each would have among nine."""
    text = text_or_empty()
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(docs, "doc_id", 8, ["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
        jump_hash(F.col("doc_id"), 9).alias("grown_shard"))
