"""Mixing sources to target weights by capped water-filling.

A source's share of all words follows its weight, but stops at a number of epochs of the source; what is cut off
goes to the others by weight, until none is above. That fixed point is target = min(cap, level x weight); sorted
by cap / weight the capped sources come first, which gives the level by running sums over one row per source.

A source then takes each of its documents the whole number of times that its rate holds, and the fraction from
a seeded random order of its documents: those up to the wanted number of words once more, the one on the limit
in part (its first words). The order is cut in fixed ranges of the hash, of which only the one on the limit is
sorted, so a source may hold any share of the rows.

Defined results: null and empty texts have size 0; the null source is a source and comes last; sources without
words have target 0 and take nothing; repeated rows are documents of their own; an empty table gives an empty
result; extra columns pass through, those named as a result's column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqweave.llm.common import WORD, reliable, small

EPOCHS, WEIGHTS = 3, (1, 2, 3)
#: The hash has 60 bits; its first ten name the range.
RANGE_BITS = 10


def levelled(sources: DataFrame, epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """sources (source, source_size) with target; one row per source, so the windows see no documents."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("ratio", "source")
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", rest / open_weight)
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).select("source", "source_size", "target")


def mixed(docs: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target, copies (whole repetitions), part (words of a further one), taken."""
    new = {"size", "source_size", "target", "copies", "part", "taken"}
    rows = docs.select(*[c for c in docs.columns if c not in new], F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    rows = rows.withColumn("h_", F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long"))
    rows = rows.withColumn("b_", F.shiftright("h_", 60 - RANGE_BITS)).withColumn("s_", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    ranges = reliable(rows.groupBy("source", "s_", "b_").agg(F.sum("size").alias("n_")))
    targets = levelled(ranges.groupBy("source").agg(F.sum("n_").alias("source_size")), epochs, weights)
    targets = targets.withColumn("s_", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    before = W.partitionBy("s_").orderBy("b_").rowsBetween(W.unboundedPreceding, -1)
    plan = ranges.select("s_", "b_", "n_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_")).join(targets, "s_")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole_", F.least(F.floor(rate), F.lit(epochs)).cast("long"))
    plan = reliable(plan.withColumn("more_", F.floor(F.col("target") - F.col("whole_") * F.col("source_size")).cast("long")))
    rows = rows.join(small(plan), ["s_", "b_"])
    on_limit = (F.col("start_") < F.col("more_")) & (F.col("more_") < F.col("start_") + F.col("n_"))
    # Outside the range on the limit, a document is before the limit or beyond it with its whole range.
    even = rows.filter(~on_limit).withColumn("left_", F.when(F.col("start_") < F.col("more_"), F.col("size")).otherwise(F.lit(0)))
    inside = W.partitionBy("s_", "b_").orderBy("h_", "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).rowsBetween(W.unboundedPreceding, -1)
    cut = rows.filter(on_limit).withColumn("left_", F.col("more_") - F.col("start_") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = even.unionByName(cut)
    full = (F.col("left_") >= F.col("size")) & (F.col("size") > 0)
    both = both.withColumn("copies", F.col("whole_") + full.cast("long"))
    both = both.withColumn("part", F.when(full, F.lit(0)).otherwise(F.greatest(F.col("left_"), F.lit(0))).cast("long"))
    both = both.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
    return both.drop("h_", "b_", "s_", "n_", "start_", "whole_", "more_", "left_")


def repeated(docs: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each document as often as it is taken, a partial repetition cut after its words."""
    new = ("size", "source_size", "target", "copies", "part", "taken")
    mix = mixed(docs, epochs, weights)
    pieces = F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("copies").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    mix = mix.withColumn("piece_", F.explode(pieces))
    ends = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(ends, F.lit(1), F.greatest(F.col("piece_"), F.lit(1)).cast("int")), "")
    mix = mix.withColumn("text", F.when(F.col("piece_") > 0, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        mix = mix.withColumn("n_chars", F.when(F.col("piece_") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return mix.drop("piece_", *[c for c in new if c not in docs.columns]).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
                  ('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight FROM d GROUP BY source),
r AS (SELECT *, cap / weight AS ratio FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM r) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT max(level) FROM l WHERE level <= ratio) * weight) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
             floor(p.target - p.whole * p.source_size)::BIGINT - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
y AS (SELECT *, CASE WHEN rest >= size AND size > 0 THEN 1 ELSE 0 END AS one FROM x)
SELECT doc_id, size, source_size, target, (whole + one)::BIGINT AS copies,
       CASE WHEN one = 1 THEN 0 ELSE greatest(rest, 0) END::BIGINT AS part,
       ((whole + one) * size + CASE WHEN one = 1 THEN 0 ELSE greatest(rest, 0) END)::BIGINT AS taken
FROM y
"""
