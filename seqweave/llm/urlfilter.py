"""URL rules by a cascade of Bloom filters, exact for every key that occurs in the corpus.

A key is a host suffix followed by a path prefix. Only lengths that some rule has can name a rule, so a url has
one key at most for each pair of lengths. The first filter holds the listed keys; the second, the keys of the
corpus that the first wrongly passes; the third, those listed keys that the second passes; and so on, until a
filter passes nothing wrong. The number of the first filter that a key fails tells on which side it is, so
urls are judged without a join. A second cascade separates the listed keys that block from those that allow.
Every level hashes anew, so keys that share their bits on one level part on the next.

Filters are built by distributed aggregation of their words. One filter has at most `most_bits` bits; a list that
needs more, or two keys that share all 62 bits of their hashes, are matched by a shuffled join of the corpus's distinct
keys instead.

Defined results: null urls and urls without `://` have an empty host and path, fit no rule and are allowed, as is
every url that no rule fits; the longest host wins, then the longest path; of equal rules, block wins; repeated
rows are judged alike; an empty list allows all; extra columns pass through, those named as a result's are
replaced.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import lower_ascii, reliable

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
BITS, HASHES, MOST_BITS = 12, 6, 1 << 28
#: Levels of a cascade, and the prime field in which each level has its own linear hashes of a key's two halves.
LEVELS, PRIME = 64, (1 << 31) - 1
DEFAULT = "allow"


@dataclass
class Filter:
    bits: int
    words: np.ndarray

    def passes(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        out = np.ones(len(h1), bool)
        start, stride = mixed(h1, h2, level)
        for k in range(HASHES):
            at = (start + k * stride) % self.bits
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def mixed(h1, h2, level: int) -> tuple:
    """Start and stride of a key's bits on a level, linear hashes of its halves; of arrays or of Spark columns.

    The halves and factors are below 2**31, so sums of two products stay within 63 bits.
    """
    draw = random.Random(level)
    f = [draw.randrange(1, PRIME) for _ in range(4)]
    return (h1 * f[0] + h2 * f[1]) % PRIME, (h1 * f[2] + h2 * f[3]) % PRIME


def halves(key):
    """Two hashes of 31 bits of a key column."""
    h = F.xxhash64(key)
    return F.shiftrightunsigned(h, 33), h.bitwiseAND(F.lit((1 << 31) - 1))


def with_halves(df: DataFrame) -> DataFrame:
    return df.withColumns(dict(zip(("h1", "h2"), halves(F.col("key")))))


def parsed(url):
    """Host and path of a url column; both empty without `://`."""
    start = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys(host, path, lengths: list[tuple[int, int]]):
    """The url's keys, longest host first, as an array of strings."""
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in lengths])

    def key(x):
        fits = (F.length(host) == x.h) | F.endswith(host, F.concat(F.lit("."), F.right(host, x.h)))
        return F.when(fits & (F.length(host) >= x.h) & (F.length(path) >= x.p) & (host != ""), F.concat(F.right(host, x.h), F.left(path, x.p)))

    return F.filter(F.transform(pairs, key), lambda k: k.isNotNull())


def filter_of(df: DataFrame, n: int, level: int) -> Filter:
    """A Bloom filter of df's keys (h1, h2); its words are summed up by Spark, at most n x BITS / 64 of them."""
    bits = max(64, 1 << math.ceil(math.log2(max(1, n) * BITS)))
    start, stride = mixed(F.col("h1"), F.col("h2"), level)
    at = F.explode(F.array(*[(start + stride * k) % bits for k in range(HASHES)])).alias("at")
    words = df.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("w"))
    out, words = np.zeros(bits // 64, np.int64), words.toArrow()  # at most bits / 64 rows of two numbers
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return Filter(bits, out.view(np.uint64))


def passing(df: DataFrame, level: int, f: Filter) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(f)

    def run(batches):
        for b in batches:
            yield b[shared.value.passes(b["h1"].to_numpy(), b["h2"].to_numpy(), level)]

    return df.mapInPandas(run, df.schema)


def cascade(yes: DataFrame, no: DataFrame, most_bits: int = MOST_BITS) -> list[Filter] | None:
    """Filters that tell the keys (h1, h2) of `yes` from those of `no`; None if one would be too large, or none can."""
    out: list[Filter] = []
    own, other = yes, no
    n = own.count()
    while n:
        if n * BITS > most_bits or len(out) == LEVELS:
            return None
        f = filter_of(own, n, len(out))
        out.append(f)
        own, other = reliable(passing(other, len(out) - 1, f)), own
        n = own.count()
    return out


def member(cascade_: list[Filter], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is on the first side: the number of the first filter that it fails is odd."""
    first = np.full(len(h1), len(cascade_))
    for k in reversed(range(len(cascade_))):
        first[~cascade_[k].passes(h1, h2, k)] = k
    return first % 2 == 1


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, most_bits: int = MOST_BITS) -> DataFrame:
    """pages with host, path, rule, verdict. rules: host, path, action (allow or block)."""
    rules = rules.select("host", "path", "action").dropna()
    lengths = sorted((tuple(r) for r in rules.select(F.length("host"), F.length("path")).distinct().collect()), reverse=True)
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = parsed(F.col("url"))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    if not lengths:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    found = keys(F.col("host"), F.col("path"), lengths)
    listed = reliable(with_halves(rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max(F.col("action") == "block").alias("blocks"))))
    universe = reliable(with_halves(rows.select(F.explode(found).alias("key")).distinct()))
    n = listed.count()
    if n * BITS > most_bits:
        return joined(rows, found, listed, default)
    level = filter_of(listed, n, 0)
    false = passing(universe, 0, level).join(listed.select("key"), "key", "left_anti")
    lists = cascade(listed.select("h1", "h2"), reliable(false.select("h1", "h2")), most_bits)
    blocks = cascade(listed.filter("blocks").select("h1", "h2"), listed.filter("not blocks").select("h1", "h2"), most_bits)
    if lists is None or blocks is None:
        return joined(rows, found, listed, default)
    shared = rows.sparkSession.sparkContext.broadcast((lists, blocks))

    @F.pandas_udf("at int, blocks boolean")
    def probe(h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        lists, blocks = shared.value
        n = h1.map(len).to_numpy()
        a, b = (np.concatenate([*x, []]).astype(np.int64) for x in (h1, h2))
        hit = np.flatnonzero(member(lists, a, b))
        row = np.repeat(np.arange(len(n)), n)[hit]
        first = hit[np.unique(row, return_index=True)[1]]  # the longest key of each row
        at, block = np.full(len(n), -1, np.int32), np.zeros(len(n), bool)
        row = np.unique(row)
        at[row] = first - (np.cumsum(n) - n)[row]
        block[row] = member(blocks, a[first], b[first])
        return pd.DataFrame({"at": at, "blocks": block})

    rows = rows.withColumn("keys_", found)
    hashes = F.transform("keys_", lambda k: halves(k)[0]), F.transform("keys_", lambda k: halves(k)[1])
    rows = rows.withColumn("probe_", probe(*hashes))
    rule = F.get(F.col("keys_"), F.when(F.col("probe_.at") >= 0, F.col("probe_.at")))
    verdict = F.when(F.col("probe_.at") < 0, default).when(F.col("probe_.blocks"), "block").otherwise("allow")
    return rows.select(*keep, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def joined(rows: DataFrame, found, listed: DataFrame, default: str) -> DataFrame:
    """The same for a list beyond the filters' size: distinct keys are joined with the list, then each url's keys with them."""
    rows = rows.withColumn("id_", F.monotonically_increasing_id())
    rows = reliable(rows)
    each = rows.select("id_", F.posexplode(found).alias("at", "key")).join(listed.select("key", "blocks"), "key")
    best = each.groupBy("id_").agg(F.min(F.struct("at", "key", "blocks")).alias("best_"))
    verdict = F.when(F.col("best_").isNull(), default).when(F.col("best_.blocks"), "block").otherwise("allow")
    out = rows.join(best, "id_", "left")
    return out.select(*[c for c in rows.columns if c != "id_"], F.col("best_.key").alias("rule"), verdict.alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, action string")
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules).drop("url")


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, r.h || r.p AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h) DESC, length(r.p) DESC) AS k
      FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p))
SELECT p.page_id, host, path, f.rule, coalesce(f.action, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id AND k = 1
"""
