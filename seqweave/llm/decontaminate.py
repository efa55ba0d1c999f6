"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the size class (power of two) of their shingle sets. An item's sketch is the run of
its smallest shingle hashes, as long as its class needs: an item of n shingles of which at least c n lie in a
document misses at most n - ceil(c n) of them, so n - ceil(c n) + 1 of its hashes cannot all be missed, and no
passage is lost however long the document. Documents that hold a sketch hash of an item are verified by exact
containment of shingle strings. Only DataFrame functions are used.

Defined results: items without words match nothing; items of fewer words than a shingle are one shingle of
their own width; null and empty texts hold nothing; a document given in several rows holds what any of its rows
holds; rows of null ids are searched too, reported together under a null doc_id, and each stays or goes by its own text;
repeated items are merged by id; items of null ids are left out; extra columns are ignored, and kept by clean().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import WORD, let, reliable, small, words

WIDTH, CONTAINMENT = 5, 0.8


def hashes(w, widths: list[int]):
    """The hashes of all shingles of the words w, of each width."""

    def of(k: int):
        starts = F.sequence(F.lit(0), F.size(w) - k)
        return F.when(F.size(w) >= k, F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*map(of, widths))


def shingles(w, width):
    """The distinct shingles of the words w, as strings."""
    starts = F.sequence(F.lit(1), F.size(w) - width + 1)
    return F.when(F.size(w) >= width, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, width), " ")))).otherwise(F.array().cast("array<string>"))


def item_sets(items: DataFrame, width: int) -> DataFrame:
    """item_id, width, n, s (distinct shingle strings), for items with words."""
    rows = items.filter(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    rows = rows.withColumn("width", F.least(F.lit(width), F.size("w")))
    rows = rows.withColumn("s", let(F.col("w"), lambda w: shingles(w, F.least(F.lit(width), F.size(w)))))
    return rows.select("item_id", "width", F.size("s").alias("n"), "s")


def sketches(sets: DataFrame, widths: list[int], containment: float) -> DataFrame:
    """h, item_id: each item's smallest shingle hashes, as many as its size class needs."""
    part = F.floor(F.log2("n"))
    most = F.pow(F.lit(2), part + 1) - 1  # of the class
    length = (most - F.ceil(most * containment) + 1).cast("int")
    by_width = F.lit(None).cast("array<bigint>")
    for k in widths:
        hashed = F.expr(f"transform(s, x -> xxhash64({', '.join(f'get(split(x, chr(32)), {i})' for i in range(k))}))")
        by_width = F.when(F.col("width") == k, hashed).otherwise(by_width)
    return sets.select("item_id", F.explode(F.slice(F.sort_array(by_width), F.lit(1), length)).alias("h"))


def held(docs: DataFrame, items: DataFrame, width: int, containment: float) -> DataFrame:
    """doc_id, k1, item_id, n_shingles, n_shared, containment of the rows of docs (doc_id, k1, text) and items at or above the containment.

    k1 is a hash that names rows; rows that share one are each verified by their own text.
    """
    docs = docs.select("doc_id", "k1", "text")
    sets = reliable(item_sets(items, width))
    widths, total = sets.agg(F.collect_set("width"), F.coalesce(F.sum("n"), F.lit(0))).first()  # at most `width` widths
    widths = sorted(widths) or [width]
    index = reliable(sketches(sets, widths, containment).distinct())
    found = docs.select("k1", F.explode(let(words(F.col("text")), lambda w: hashes(w, widths))).alias("h"))
    found = reliable(found.join(small(index), "h").select("k1", "item_id").distinct())
    by_row = reliable(found.groupBy("k1").agg(F.collect_set("item_id").alias("items")))
    # A document's shingles are made once, then meet each of its candidates.
    own = let(words(F.col("text")), lambda w: F.array(*[shingles(w, k) for k in widths]))
    k2 = F.crc32(F.col("text").cast("binary")).alias("k2")
    rows = docs.join(small(by_row, found.count()), "k1").select("doc_id", "k1", k2, own.alias("own"), "items")
    pairs = rows.withColumn("item_id", F.explode("items")).join(small(sets, total), "item_id")
    shared = F.size(F.array_intersect("s", F.get("own", F.array_position(F.array(*map(F.lit, widths)), F.col("width")).cast("int") - 1)))
    pairs = pairs.select("doc_id", "k1", "k2", "item_id", F.col("n").cast("long").alias("n_shingles"), shared.cast("long").alias("n_shared"))
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= containment)


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of every pair at or above the containment."""
    pairs = held(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), "text"), items, width, containment)
    return pairs.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared"), F.max("containment").alias("containment"))


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; a row of null id is named by two hashes of its text."""
    k1 = F.xxhash64("doc_id", "text")
    bad = held(docs.select("doc_id", k1.alias("k1"), "text"), items, width, containment)
    named = F.col("doc_id").isNotNull()
    own = F.when(~named, F.struct(k1, F.crc32(F.col("text").cast("binary"))))
    bad = reliable(bad.select(F.col("doc_id").alias("bad_id_"), F.when(~named, F.struct("k1", "k2")).alias("bad_key_")).distinct())
    return docs.join(small(bad), F.col("doc_id").eqNullSafe(F.col("bad_id_")) & own.eqNullSafe(F.col("bad_key_")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM benchmark),
iw AS (SELECT item_id, w, least(5, len(w)) AS width FROM i WHERE len(w) > 0),
it AS (SELECT DISTINCT item_id, width, array_to_string(w[k : k + width - 1], ' ') AS s
       FROM (SELECT item_id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM iw)),
n AS (SELECT item_id, count(*) AS n FROM it GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, width, array_to_string(w[k : k + width - 1], ' ') AS s
       FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM d, (SELECT DISTINCT width FROM iw)))
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM ds JOIN it USING (width, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) / n >= 0.8
"""
