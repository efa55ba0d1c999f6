"""Suffix and LCP arrays by prefix doubling.

Each round sorts by the ranks of the first h symbols and of the h after them, then doubles h; the ranks of a sequence
are dense, so log2(n) rounds of a join and a window per sequence do. For many sequences, not for one of billions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def suffix_array(inputs: DataFrame, longest: int) -> DataFrame:
    """input_id, rank (from 0), pos of every suffix of inputs (input_id, symbols) of at most `longest` symbols."""
    rows = inputs.select("input_id", F.posexplode("symbols").alias("pos", "sym")).withColumn("pos", F.col("pos").cast("long"))
    order = F.dense_rank().over(W.partitionBy("input_id").orderBy("sym"))
    rows, h = rows.select("input_id", "pos", order.alias("r")), 1
    while h < longest:
        nxt = F.coalesce(F.lead("r", h).over(W.partitionBy("input_id").orderBy("pos")), F.lit(0))
        rows = rows.withColumn("s", nxt).select("input_id", "pos", F.dense_rank().over(W.partitionBy("input_id").orderBy("r", "s")).alias("r"))
        h *= 2
    return rows.select("input_id", (F.col("r") - 1).cast("long").alias("rank"), "pos")


def lcp_array(inputs: DataFrame, longest: int) -> DataFrame:
    """input_id, rank, lcp: how many symbols a suffix shares with the one before it; 0 for the first."""
    sa = suffix_array(inputs, longest).join(inputs.select("input_id", "symbols"), "input_id")
    before = F.lag("pos").over(W.partitionBy("input_id").orderBy("rank"))
    n, a, b = F.size("symbols"), F.col("pos").cast("int"), F.col("prev").cast("int")
    room = n - F.greatest(a, b)
    differ = F.filter(F.sequence(F.lit(0), room), lambda i: (i == room) | (F.get("symbols", a + i) != F.get("symbols", b + i)))
    return sa.withColumn("prev", before).select("input_id", "rank", F.when(F.col("prev").isNull(), F.lit(0)).otherwise(F.get(differ, F.lit(0))).cast("long").alias("lcp"))


def bwt(inputs: DataFrame, longest: int) -> DataFrame:
    """input_id, rank, sym: the symbol before each suffix; null before the first."""
    sa = suffix_array(inputs, longest)
    rows = inputs.select("input_id", F.posexplode("symbols").alias("p", "sym")).select("input_id", (F.col("p") + 1).cast("long").alias("pos"), "sym")
    return sa.join(rows, ["input_id", "pos"], "left").select("input_id", "rank", "sym")
