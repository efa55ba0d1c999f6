"""Rank, select and prefix sums over tables (vec_id, pos, bit) and (vec_id, idx, len).

Sums over a vector are two-level: blocks of BLOCK positions are summed by a plain aggregation, the blocks' sums are
summed over one row per block, and windows run inside blocks only; so one long vector still spreads over tasks.

Defined results: a null bit is a zero, a null length adds nothing; rows of a null vector are a vector of their own; rows
of a null position are left out; positions of a vector are distinct; extra columns pass through; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 65_536


def prefix_sum(df: DataFrame, key: str, order: str, value: str, out: str, inclusive: bool = True) -> DataFrame:
    """df with the sum of `value` over the rows of the key up to (or before) this one; order counts 0, 1, 2, ..."""
    block = F.floor(F.col(order) / BLOCK)
    rows = df.filter(F.col(order).isNotNull()).withColumn("block_", block)
    sums = rows.groupBy(key, "block_").agg(F.sum(value).alias("s_"))
    before = W.partitionBy(key).orderBy("block_").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col(key).alias("k_"), F.col("block_").alias("b_"), F.coalesce(F.sum("s_").over(before), F.lit(0)).alias("start_"))
    inside = W.partitionBy(key, "block_").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    rows = rows.join(starts, F.col(key).eqNullSafe(F.col("k_")) & (F.col("block_") == F.col("b_")))
    return rows.withColumn(out, (F.col(out) + F.col("start_")).cast("long")).drop("block_", "k_", "b_", "start_")


def rank1(bits: DataFrame) -> DataFrame:
    """bits with rank1: the ones before each position, and rank0."""
    out = prefix_sum(bits, "vec_id", "pos", "bit", "rank1", inclusive=False)
    return out.withColumn("rank0", (F.col("pos") - F.col("rank1")).cast("long"))


def select1(bits: DataFrame) -> DataFrame:
    """vec_id, k, pos: the position of the k-th one, from 1."""
    out = prefix_sum(bits, "vec_id", "pos", "bit", "k")
    return out.filter("bit = 1").select("vec_id", "k", "pos")


def ones_from(bits: DataFrame, k: int) -> DataFrame:
    return select1(bits).filter(F.col("k") >= k)


def words(bits: DataFrame, width: int = 32) -> DataFrame:
    """vec_id, word, value: bits packed in words, the first lowest."""
    shift = f"shiftleft(cast(bit as bigint), cast(pos % {width} as int))"
    rows = bits.filter(F.col("pos").isNotNull())
    return rows.groupBy("vec_id", F.floor(F.col("pos") / width).alias("word")).agg(F.expr(f"coalesce(bit_or({shift}), 0L)").alias("value"))


def word_read(packed: DataFrame, reads: DataFrame, width: int = 32) -> DataFrame:
    """vec_id, pos, len, value: len bits (at most `width`) from pos on."""
    low = packed.select("vec_id", F.col("word"), F.col("value").alias("v0"))
    high = packed.select("vec_id", (F.col("word") - 1).alias("word"), F.col("value").alias("v1"))
    out = reads.withColumn("word", F.floor(F.col("pos") / width)).join(low, ["vec_id", "word"], "left").join(high, ["vec_id", "word"], "left")
    value = F.expr(
        f"(shiftright(coalesce(v0, 0L), cast(pos % {width} as int)) | shiftleft(coalesce(v1, 0L) & (shiftleft(1L, cast(pos % {width} as int)) - 1), cast({width} - pos % {width} as int))) & (shiftleft(1L, cast(len as int)) - 1)"
    )
    return out.select("vec_id", "pos", "len", value.alias("value"))


def from_positions(ones: DataFrame, lengths: DataFrame) -> DataFrame:
    """vec_id, pos, bit from the positions of ones (vec_id, pos) and lengths (vec_id, n)."""
    all_ = lengths.filter("n > 0").select("vec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"))
    marked = ones.select("vec_id", "pos", F.lit(1).alias("bit")).distinct()
    return all_.join(marked, ["vec_id", "pos"], "left").withColumn("bit", F.coalesce("bit", F.lit(0)))


def byte_sums(spark, width: int) -> DataFrame:
    """byte, total: the sum of the width-bit digits of each byte."""
    digits = " + ".join(f"(shiftright(byte, {s}) & {(1 << width) - 1})" for s in range(0, 8, width))
    return spark.range(256).select(F.col("id").alias("byte")).select("byte", F.expr(digits).alias("total"))
