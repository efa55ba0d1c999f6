"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and their first four and five bytes, hashed to buckets. On a bounded sample of
labelled rows (SAMPLE rows of smallest hash; all of them if there are fewer) Spark counts each bucket by class; the buckets
that tell the classes apart are chosen, and of the sample only those come to the driver, where a factorization machine is
fitted by Adam: linear weights plus a vector per bucket, whose inner products weigh pairs of terms. Every whole text is
then scored.

Defined results: null and empty texts have no terms and get the intercept's score; ties and repeated rows are scored
alike; of several labels of an id, toxic counts, and of several texts the smallest; ids that are null are neither held out nor learned from; without
labels of both classes every score is the share of toxic labels (0 without labels); extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import discard, id_remainder, reliable

BUCKETS, SAMPLE, CHOSEN, RANK = 1 << 18, 20_000, 4096, 4
FOLDS, HELD_OUT = 5, 0
STEPS, RATE, PENALTY, SEED = 200, 0.05, 1e-4, 11
#: How much a toxic row counts against a clean one, as toxic rows are few.
TOXIC_WEIGHT = 4.0
#: Texts whose terms are held at once.
AT_ONCE = 250
#: Used buckets of documents that a step of fitting takes at once (of whole documents), as its sums take many times their memory.
FIT_AT_ONCE = 1 << 16
#: Stripped from both ends of a word.
MARKS = b".,;:!?%$#&*\"'()[]<>-_"


def terms(raw: bytes | None) -> np.ndarray:
    """The distinct buckets of a text."""
    if not raw:
        return np.zeros(0, np.int64)
    found = {w.strip(MARKS) for w in set(raw.lower().split())}
    found.discard(b"")
    found |= {b"\x01" + w[:4] for w in found} | {b"\x02" + w[:5] for w in found}
    return np.unique(np.fromiter(map(crc32, found), np.int64, len(found)) & (BUCKETS - 1))


@dataclass
class Machine:
    index: np.ndarray  # of a bucket, -1 if it is not used
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, buckets: list[np.ndarray]) -> np.ndarray:
        rows = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
        f = self.index[np.concatenate([*buckets, np.zeros(0, np.int64)])]
        return margins(rows[f >= 0], f[f >= 0], len(buckets), self.bias, self.w, self.v)[0]


def margins(rows, f, n, bias, w, v):
    total = np.stack([np.bincount(rows, v[f, k], n) for k in range(v.shape[1])], 1)
    squares = np.bincount(rows, (v**2).sum(1)[f], n)
    return bias + np.bincount(rows, w[f], n) + ((total**2).sum(1) - squares) / 2, total


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(buckets: list[np.ndarray], y: np.ndarray) -> Machine:
    """The machine of documents' buckets and labels."""
    flat = np.concatenate([*buckets, np.zeros(0, np.int64)])
    rows = np.repeat(np.arange(len(y)), [len(b) for b in buckets])
    index = chosen(np.bincount(flat, minlength=BUCKETS), np.bincount(flat, y[rows], BUCKETS), y)
    return fitted([index[b][index[b] >= 0] for b in buckets], y, index)


def chosen(seen: np.ndarray, toxic: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of each bucket among those used, -1 for others; seen and toxic: in how many documents, and toxic ones, it is."""
    index, share = np.full(BUCKETS, -1), y.mean() if len(y) else 0.0
    if 0 < share < 1:
        # How far a bucket's share of toxic rows lies from the share of all, in standard errors.
        z = (toxic - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
        z[seen < 4] = 0
        order = np.argsort(-np.abs(z), kind="stable")[:CHOSEN]
        order = order[np.abs(z[order]) >= 3]
        index[order] = np.arange(len(order))
    return index


def fitted(features: list[np.ndarray], y: np.ndarray, index: np.ndarray) -> Machine:
    """The machine of documents' used buckets, by number, and labels."""
    n, used = len(y), int(index.max()) + 1
    share = y.mean() if n else 0.0
    if not 0 < share < 1:
        return Machine(index, 40.0 if share else -40.0, np.zeros(0), np.zeros((0, RANK)))
    lens = np.fromiter(map(len, features), np.int64, n)
    ends = np.r_[0, np.cumsum(lens)]
    flat = np.concatenate(features).astype(np.int32, copy=False)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(0, ends[-1], FIT_AT_ONCE)), n])
    rng = np.random.default_rng(SEED)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(used), rng.normal(0, 0.01, (used, RANK))
    counts = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    counts /= counts.sum()
    moments = [np.zeros(2), *(np.zeros((2, *x.shape)) for x in (w, v))]
    for step in range(1, STEPS + 1):
        gb, gw, gv = 0.0, np.zeros_like(w), np.zeros_like(v)
        for lo, hi in zip(cuts, cuts[1:]):
            f, rows = flat[ends[lo] : ends[hi]], np.repeat(np.arange(hi - lo), lens[lo:hi])
            m, total = margins(rows, f, hi - lo, bias, w, v)
            g = (sigmoid(m) - y[lo:hi]) * counts[lo:hi]
            gf = g[rows]
            gb += g.sum()
            gw += np.bincount(f, gf, len(w))
            gv += np.stack([np.bincount(f, gf * total[rows, k], len(w)) for k in range(RANK)], 1)
        gv -= gw[:, None] * v
        for x, (grad, old) in enumerate(((gb, 0.0), (gw + PENALTY * w, w), (gv + 10 * PENALTY * v, v))):
            a, b = moments[x]
            a, b = 0.9 * a + 0.1 * grad, 0.999 * b + 0.001 * grad**2
            moments[x] = (a, b)
            move = RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            if x == 0:
                bias -= float(move)
            else:
                old -= move
    return Machine(index, bias, w, v)


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.float64()), pa.array([terms(x.as_py()).astype(np.int32) for x in b.column(1)], pa.list_(pa.int32()))], ["y", "f"])

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))  # at most `sample` rows
    files = 2 * docs.sparkSession.sparkContext.defaultParallelism  # else as many as a shuffle has partitions, most of them tiny
    rows = reliable(rows.select("y", F.col("text").cast("binary")).coalesce(files).mapInArrow(run, "y double, f array<int>"))
    counts = rows.select(F.explode("f").alias("b"), (F.col("y") > 0).cast("int").alias("t")).groupBy("b").agg(F.count("*").alias("seen"), F.sum("t").alias("toxic")).toArrow()  # at most BUCKETS
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    b = counts.column("b").to_numpy()
    seen[b], toxic[b] = counts.column("seen").to_numpy(), counts.column("toxic").to_numpy()
    total = rows.agg(F.count("*"), F.sum((F.col("y") > 0).cast("int"))).first()
    index = chosen(seen, toxic, np.r_[np.ones(total[1] or 0), np.zeros(total[0] - (total[1] or 0))])

    def used(batches):
        for b in batches:
            lists = [index[x.values.to_numpy()] if len(x) else np.zeros(0, np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[x >= 0].astype(np.int32) for x in lists], pa.list_(pa.int32()))], ["y", "f"])

    found = rows.mapInArrow(used, "y double, f array<int>").toArrow()
    discard(rows)
    f = found.column("f").combine_chunks()
    ends, flat = f.offsets.to_numpy(), f.values.to_numpy()
    y, lists = (found.column("y").to_numpy() > 0).astype(float), [flat[a:b] for a, b in zip(ends, ends[1:])]
    order = sorted(range(len(y)), key=lambda k: (y[k], lists[k].astype(">i4").tobytes()))  # an order of their own: by label, then by the numbers
    return fitted([lists[k] for k in order], y[order], index)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS numbers and CHOSEN vectors

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                score = sigmoid(shared.value.margins([terms(x.as_py()) for x in part.column(2)]))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns; learned on `training`, or on docs."""
    machine = learned(docs if training is None else training, labels)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("boolean")
    def toxic(text: pd.Series) -> pd.Series:
        parts = [sigmoid(shared.value.margins([terms(x) for x in text.iloc[at : at + AT_ONCE]])) for at in range(0, len(text), AT_ONCE)]
        return pd.Series(np.concatenate([*parts, np.zeros(0)]) >= 0.5)

    return docs.filter(~toxic(F.col("text").cast("binary")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
