"""Exact top-k inner products by a Voronoi join.

A bounded number of pivots cuts the vectors in cells. Each cell's summary keeps its k + 1 members nearest the pivot.
The summaries' members are real candidates, so a query's k-th best score among them is a bound that its answer can
only exceed. The queries of a cell have the pivot as centre, a radius, and a least bound; a vector x can serve them only
if centre . x + radius |x| reaches that bound. How many vectors a cell needs is counted before any is copied: cells that
need less than half of them are groups of their own; cells that need more are put together in groups of up to a chunk of
queries, so that vectors which cannot be pruned are copied once for a whole chunk. Groups and vectors are cut in chunks
and blocks of bounded size, each pair is solved on its own, and the results are merged. Vectors travel in the smallest
integer type that holds all components.

What cannot be pruned is compared in full: in many dimensions without clusters, that is all queries with all rows.

Defined results: vectors that are null, or hold a null or non-finite component, take no part, nor do null ids; shorter
vectors count as padded with zeros; rows of one query id and vector are one query; every candidate row counts, repeated
ones each, and has another id than the query; ties go to the smaller id; components beyond 64 bits, and scores, are cut
to the nearest value that 64 bits hold; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqweave.llm.common import reliable

K, SCALE, EVERY = 10, 1024, 100
PIVOTS, PER_PIVOT = 256, 4
#: Numbers in a chunk of queries and in a block of vectors, and rows in a block at least; scores held at once.
CHUNK, BLOCK, BLOCK_LEAST, AT_ONCE = 1 << 23, 1 << 23, 2048, 1 << 22
MOST = (1 << 63) - 1


def stacked(rows, dim: int) -> np.ndarray:
    """The vectors as a matrix of whole numbers, in double where products are exact."""
    out = np.zeros((len(rows), dim))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, cut to 64 bits."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    if top < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a) @ whole(b).T
    return np.minimum(np.maximum(exact, -MOST - 1), MOST).astype(np.int64)


def best(query: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k largest scores, ties to smaller ids."""
    order = np.lexsort((ids, ~scores, query))
    q = query[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def grouped(cells: list[tuple[int, int, int]], n: int, chunk: int) -> tuple[dict[int, list[int]], int]:
    """cell -> the groups of its pieces, and how many copies of vectors that takes at most.

    cells: (cell, queries, vectors needed). Those that need more than half of the n vectors share groups.
    """
    out: dict[int, list[int]] = {}
    group, room, copies = -1, 0, 0
    for wide in (False, True):
        room = 0
        for cell, size, need in cells:
            if (2 * need > n) != wide:
                continue
            parts = -(-size // chunk)
            out[cell] = []
            for _ in range(parts):
                part = -(-size // parts)
                if not wide or part > room:
                    group, room = group + 1, chunk
                    copies += n if wide else need
                room -= part
                out[cell].append(group)
    return out, copies


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, embedding; is_query: a condition on vec_id.

    report, if given, receives the numbers of vectors, queries, groups and the copies of vectors made (at most).
    """
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).filter(finite)
    rows = reliable(rows.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v")))
    spark = rows.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    queries = rows.filter(is_query).dropDuplicates(["vec_id", "v"])
    n, dim, low, high = rows.agg(F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], result)
    dim, reach = max(1, dim), max(-(low or 0), high or 0)
    kind = "smallint" if reach < 1 << 15 else "int" if reach < 1 << 31 else "bigint"
    rows, queries = (x.withColumn("v", F.col("v").cast(f"array<{kind}>")) for x in (rows, queries))
    chunk = max(256, CHUNK // dim)
    n_pivots = min(PIVOTS, -(-n_queries // PER_PIVOT))
    pivots = stacked([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).collect()], dim)  # PIVOTS vectors at most
    context = spark.sparkContext
    shared_pivots = context.broadcast(pivots)

    def nearest(x: np.ndarray):
        p = shared_pivots.value
        d = (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)
        cell = d.argmin(1)
        return cell, np.sqrt(np.maximum(0, ((x - p[cell]) ** 2).sum(1)))

    def summaries(batches):
        kept = None
        for b in batches:
            if len(b):
                cell, dist = nearest(stacked(b.v, dim))
                kept = pd.concat([kept, b.assign(cell=cell, dist=dist)]).sort_values(["cell", "dist", "vec_id"]).groupby("cell").head(k + 1)
        if kept is not None:
            yield kept[["cell", "dist", "vec_id", "v"]]

    near = rows.mapInPandas(summaries, f"cell int, dist double, vec_id long, v array<{kind}>")
    near = near.withColumn("r", F.row_number().over(W.partitionBy("cell").orderBy("dist", "vec_id", "v"))).filter(F.col("r") <= k + 1)
    members = near.select("vec_id", "v").collect()  # PIVOTS x (k + 1) vectors at most
    shared_members = context.broadcast((np.array([r.vec_id for r in members]), stacked([r.v for r in members], dim)))

    def bounded(batches):
        for b in batches:
            if len(b):
                x = stacked(b.v, dim)
                cell, dist = nearest(x)
                ids, m = shared_members.value
                scores = products(x, m)
                scores[b.vec_id.to_numpy()[:, None] == ids] = -MOST - 1
                bound = np.sort(scores, 1)[:, -k] if scores.shape[1] >= k else np.full(len(x), -MOST - 1)
                yield b.assign(cell=cell, dist=dist, bound=bound)

    queries = reliable(queries.mapInPandas(bounded, f"vec_id long, v array<{kind}>, cell int, dist double, bound long"))
    cells = queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.min("bound").alias("bound")).orderBy("cell").collect()  # PIVOTS rows at most
    shared_cells = context.broadcast([np.array([getattr(c, x) for c in cells]) for x in ("cell", "radius", "bound")])

    def needs(x: np.ndarray) -> np.ndarray:
        """Whether each cell with queries, a column, may need each vector."""
        cell, radius, bound = shared_cells.value
        most = x @ shared_pivots.value[cell].T + np.sqrt((x**2).sum(1))[:, None] * radius
        return most * (1 + 1e-9 * np.sign(most)) + 1e-6 >= bound

    def counted(batches):
        total = 0
        for b in batches:
            if len(b):
                total = total + needs(stacked(b.v, dim)).sum(0)
        if not isinstance(total, int):
            yield pd.DataFrame({"cell": shared_cells.value[0], "n": total})

    need = dict(tuple(r) for r in rows.mapInPandas(counted, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())
    groups, copies = grouped([(c.cell, c.n, need[c.cell]) for c in cells], n, chunk)
    if report is not None:
        report.update(vectors=n, queries=n_queries, groups=1 + max(g for gs in groups.values() for g in gs), copies=copies)
    of = np.zeros((len(cells), 1 + max(g for gs in groups.values() for g in gs)), bool)  # groups of each cell: chunks of queries, and cells
    for i, c in enumerate(cells):
        of[i, groups[c.cell]] = True
    shared_of = context.broadcast(of)
    pieces = spark.createDataFrame([(c, gs) for c, gs in groups.items()], "cell int, gs array<int>")
    queries = queries.join(F.broadcast(pieces), "cell")  # PIVOTS rows at most
    queries = queries.withColumn("g", F.get("gs", F.pmod(F.xxhash64("vec_id", "v"), F.size("gs")).cast("int")))
    n_blocks = -(-n // min(max(1, BLOCK // dim), max(BLOCK_LEAST, n // 64)))

    def replicated(batches):
        for b in batches:
            if len(b):
                i, g = np.nonzero(needs(stacked(b.v, dim)).astype(np.float32) @ shared_of.value.astype(np.float32))
                yield pd.DataFrame({"g": g, "vec_id": b.vec_id.to_numpy()[i], "v": b.v.to_numpy()[i], "block": b.block.to_numpy()[i]})

    data = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.lit(n_blocks)).cast("int"))
    data = data.mapInPandas(replicated, f"g int, vec_id long, v array<{kind}>, block int")
    asked = queries.select("g", "vec_id", "v", "bound").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros(0, np.int64)] * 3
        if len(q) and len(d):
            x, ids, step = stacked(d.v, dim), d.vec_id.to_numpy(), max(1, AT_ONCE // len(d))
            parts = [found]
            for at in range(0, len(q), step):
                part = q.iloc[at : at + step]
                own, s = part.vec_id.to_numpy(), products(stacked(part.v, dim), x)
                i, j = np.nonzero((s >= part.bound.to_numpy()[:, None]) & (ids != own[:, None]))
                p = best(i, s[i, j], ids[j], k)
                parts.append([own[i[p]], ids[j[p]], s[i[p], j[p]]])
            found = [np.concatenate(x) for x in zip(*parts)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    local = asked.groupBy("g", "block").cogroup(data.groupBy("g", "block")).applyInPandas(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
      FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v d ON q.vec_id <> d.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
