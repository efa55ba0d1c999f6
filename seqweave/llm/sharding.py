"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

A row's key is a hash of all its columns together with its number among rows that are equal in all of them, so copies
of a document are dealt out apart from each other. Rows lie in source buckets by a hash of that key. Row p of the matrix
says how many rows bucket p sends to each shard; it is drawn from the multivariate hypergeometric law, so the shards are
exactly as full as wanted and all assignments of rows to shards are equally likely. Each bucket is permuted by a second
hash and dealt out by its row of the matrix; each shard is permuted again by a third one, in ranges, to number its slots.
All that is done on keys alone; rows meet their shard and slot in one join. Only DataFrame functions touch rows.

The numbers of buckets and ranges grow with the rows, so that each stays near PER_BUCKET; the matrix is of buckets x shards.
Equal rows are numbered in a window; those of more than HOT copies are counted and written out again from one of them, in
pieces, so no task sees all copies.

Defined results: null text has no bytes and checksum 0; null ids are ids like any other; rows that are equal in all columns
get different slots and are interchangeable; the result depends on the rows alone, not on their order or files; an empty
table gives an empty result; extra columns pass through, those named as a result's column are replaced; columns that
cannot be hashed (maps) are passed through, but do not tell copies apart.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqweave.llm.common import reliable, row_hash, small

SHARDS, SEED = 8, 20_240_501
#: Rows in a source bucket and in a range of slots, if there are at least LEAST (and at most MOST) buckets.
PER_BUCKET, LEAST, MOST = 1 << 18, 256, 1 << 16
#: Copies of one row beyond which they are written out in pieces of so many.
HOT = 10_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` balls, drawn from good + bad, are good. By inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    reach = int(12 * spread) + 40
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rise = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    fall = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weight = np.concatenate([fall[::-1], [1.0], rise])
    at = np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right")
    return mode - len(fall) + min(int(at), len(weight) - 1)


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Random counts with the given row and column sums, by the multivariate hypergeometric law."""
    rng, left, out = random.Random(seed), list(columns), []
    for n in rows:
        line, rest = [], sum(left)
        for k, room in enumerate(left):
            rest -= room
            x = hypergeometric(rng, room, rest, n)
            line.append(x)
            left[k] -= x
            n -= x
        out.append(line)
    return out


def numbered(df: DataFrame, hot: int, spread: list[str]) -> DataFrame:
    """df (n_ and others) once for each number o_ from 1 to n_; pieces of `hot` numbers are spread by so many columns first."""
    df = df.withColumn("from_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_"), F.lit(hot).cast("long"))))
    df = df.repartition(*spread, "from_") if spread else df
    return df.withColumn("o_", F.explode(F.sequence("from_", F.least(F.col("from_") + (hot - 1), "n_")))).drop("from_")


def dealt(groups: DataFrame, n: int, most: int, shards: int, seed: int) -> DataFrame:
    """k_, o_, shard, slot of every row; groups: k_ and n_, how many rows have it."""
    spark = groups.sparkSession
    buckets = min(MOST, max(LEAST, -(-n // PER_BUCKET)))
    bits = max(5, (buckets // shards).bit_length())  # of a range in a shard
    keys = numbered(groups, HOT, ["k_"] if most > HOT else []).select("k_", "o_", F.pmod(F.xxhash64("k_", "o_", F.lit(seed)), F.lit(buckets)).cast("int").alias("p_"))
    keys = reliable(keys)
    counts = dict(keys.groupBy("p_").agg(F.count("*")).toArrow().to_pandas().itertuples(index=False, name=None))  # a row per bucket
    matrix = communication_matrix([counts.get(p, 0) for p in range(buckets)], [n // shards + (s < n % shards) for s in range(shards)], seed)
    ends = json.dumps([np.cumsum(line).tolist() for line in matrix])
    ends = spark.range(1).select(F.posexplode(F.from_json(F.lit(ends), "array<array<bigint>>")).alias("p_", "ends_"))  # a row per bucket
    place = W.partitionBy("p_").orderBy(F.xxhash64("k_", "o_", F.lit(seed + 1)), "k_", "o_")
    keys = keys.withColumn("r_", F.row_number().over(place)).join(F.broadcast(ends), "p_")
    third = F.xxhash64("k_", "o_", F.lit(seed + 2))
    keys = keys.select("k_", "o_", F.expr("size(filter(ends_, e -> e < r_))").alias("shard"), third.alias("t_"), F.shiftrightunsigned(third, 64 - bits).cast("int").alias("g_"))
    keys = reliable(keys)
    filled = reliable(keys.groupBy("shard", "g_").agg(F.count("*").alias("n_")))
    before = W.partitionBy("shard").orderBy("g_").rowsBetween(W.unboundedPreceding, -1)
    starts = filled.select("shard", "g_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    inside = F.row_number().over(W.partitionBy("shard", "g_").orderBy("t_", "k_", "o_"))
    keys = keys.withColumn("r_", inside).join(F.broadcast(starts), ["shard", "g_"])  # a row per range
    return keys.select("k_", F.col("o_").alias("number_"), "shard", (F.col("start_") + F.col("r_") - 1).cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot, grown_shard; shard sizes are at most one row apart."""
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    keep = [c for c in docs.columns if c not in new]
    told = sorted(c for c in keep if not any(t in dict(docs.dtypes)[c] for t in ("map<", "variant")))
    rows = docs.select(*keep, row_hash(docs.select(*keep), seed).alias("k_"))
    groups = reliable(rows.groupBy("k_").agg(F.count("*").alias("n_")))
    n, most = groups.agg(F.coalesce(F.sum("n_"), F.lit(0)), F.coalesce(F.max("n_"), F.lit(0))).first()
    slots = dealt(groups, n, most, shards, seed)
    if most <= 1:
        rows = rows.withColumn("o_", F.lit(1).cast("long"))
    else:
        number = F.row_number().over(W.partitionBy("k_").orderBy("k_")).cast("long")
        if most <= hot:
            rows = rows.withColumn("o_", number)
        else:
            heavy = reliable(groups.filter(F.col("n_") > hot).select("k_"))
            hot_rows = rows.join(small(heavy), "k_").groupBy("k_", *keep).agg(F.count("*").alias("n_"))  # a row for each, if hashes differ
            before = F.coalesce(F.sum("n_").over(W.partitionBy("k_").orderBy(*[F.col(c) for c in told]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            hot_rows = numbered(hot_rows.withColumn("b_", before), hot, ["k_", "b_"]).withColumn("o_", F.col("o_") + F.col("b_"))
            rows = rows.join(small(heavy), "k_", "left_anti").withColumn("o_", number).select("k_", *keep, "o_").unionByName(hot_rows.select("k_", *keep, "o_"))
    out = with_size(rows.join(slots.withColumnRenamed("k_", "key_"), (F.col("k_") == F.col("key_")) & (F.col("o_") == F.col("number_"))), [*keep, "shard", "slot"])
    return out.select(*keep, "size", F.col("crc_").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_size(docs: DataFrame, keep: list[str]) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(*keep, (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc_"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sharded(docs).drop("text")
