"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of 64 bits are grouped by the value of a few of their bits. Inside a group they lie
vertically: plane b holds bit b of 64 fingerprints in a word. A shift of the planes by s lanes pairs
every fingerprint with the one s places on; the XOR of both gives 64 planes of differing bits, which
carry-save adders count for all lanes at once, and the count of a shift is abandoned as soon as every
lane is beyond the radius. Groups larger than a tile are cut in tiles, and all pairs of tiles meet, so
no group has to fit in one task.

Defined results: null text is the empty text; no words: fingerprint zero, linked like any other;
repeated rows have one fingerprint and one component; null ids are never a component's id unless
nothing else is there; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.llm.common import BROADCAST_ROWS, discard, reliable, row_hash, small

WIDTH, RADIUS = 3, 2
#: Fingerprints in a tile.
TILE = 4096
#: Of near_duplicates(): words in a shingle, least Jaccard similarity, documents in a tile.
NEAR_WIDTH, NEAR_SIMILARITY, NEAR_TILE = 5, 0.8, 256
#: Documents whose shingles are held at once.
AT_ONCE = 500
#: Shingles in more prefixes than COMMON stand last in the order of shingles; they are sought in at most
#: COMMON_ROUNDS rounds, up to COMMON_MOST of them a round. None of these changes the result: any order of shingles is exact.
COMMON, COMMON_MOST, COMMON_ROUNDS = 4, 1_000_000, 3
#: Prefixes that hold a shingle, up to which all their pairs are counted. Does not change the result.
GROUP = 16
#: Edges whose components the driver finds; beyond it, rounds over tables do. Does not change the result.
DRIVER_EDGES = 200_000
STEP = 65_536


def tokens(raw: bytes | None) -> list[bytes]:
    return raw.lower().split() if raw else []  # of bytes, both know ASCII only


def shingle_hashes(toks: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `width` words; of the whole sequence if it is shorter."""
    joined = b" ".join(toks)
    lens = np.fromiter(map(len, toks), np.int64, len(toks))
    ends = np.cumsum(lens + 1) - 1
    first, last = (ends - lens)[: max(1, len(toks) - width + 1)].tolist(), ends[min(width, len(toks)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last)), np.uint64, len(first))


def fingerprint(raw: bytes | None, width: int = WIDTH) -> int:
    toks = tokens(raw)
    return majority(shingle_hashes(toks, width)) if toks else 0


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), STEP):
        part = h[at : at + STEP]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of differing bits of longs; unsigned, as numpy counts the bits of a signed number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


def planes(fp: np.ndarray) -> np.ndarray:
    """64 rows of words; bit i of row b is bit b of fingerprint i."""
    bits = np.unpackbits(fp.view(np.uint8), bitorder="little").reshape(len(fp), 64).T
    return lanes(np.ascontiguousarray(bits))


def lanes(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view(np.uint64)


def shifted(p: np.ndarray, s: int) -> np.ndarray:
    """The planes, each lane replaced by the one s places on; zero past the end."""
    word, bit = divmod(s, 64)
    out = np.zeros_like(p)
    keep = p.shape[1] - word
    if keep > 0:
        out[:, :keep] = p[:, word:] >> np.uint64(bit)
        if bit and keep > 1:
            out[:, : keep - 1] |= p[:, word + 1 :] << np.uint64(64 - bit)
    return out


def add(a, b, c):
    """A carry-save adder: the sum and the carry of three planes."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(diff: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The lanes of `valid` with at most `radius` (up to 15) set bits in diff, and the counters' planes.

    The counters start at 15 - radius, so that they overflow exactly beyond the radius.
    """
    start = 15 - radius
    full, none = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    ones, twos, fours, eights = (np.full_like(valid, full if start >> k & 1 else none) for k in range(4))
    over = ~valid
    words, kept = len(valid), None
    for at in range(0, 64, 8):
        d = diff[at : at + 8]
        if kept is not None:
            d = d[:, kept]
        ones, t0 = add(ones, d[0], d[1])
        ones, t1 = add(ones, d[2], d[3])
        twos, f0 = add(twos, t0, t1)
        ones, t0 = add(ones, d[4], d[5])
        ones, t1 = add(ones, d[6], d[7])
        twos, f1 = add(twos, t0, t1)
        fours, e = add(fours, f0, f1)
        over |= eights & e
        eights = eights ^ e
        alive = np.flatnonzero(~over)  # words with a lane within the radius
        if not len(alive):
            break
        if 24 <= at < 56 and 2 * len(alive) < len(over):  # abandon the other words
            kept = alive if kept is None else kept[alive]
            ones, twos, fours, eights, over = (x[alive] for x in (ones, twos, fours, eights, over))
    found = [~over, ones, twos, fours, eights]
    if kept is not None:
        full_size = np.zeros((5, words), np.uint64)
        full_size[:, kept] = found
        found = list(full_size)
    return found[0], found[1:]


def linked(fp: np.ndarray, group: np.ndarray, radius: int):
    """Yields arrays i, j, distance of the pairs of one group within the radius; group is sorted."""
    if len(fp) < 2:
        return
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(fp)])
    size = np.repeat(sizes, sizes)
    low = 1
    while low < sizes.max():
        rows = np.flatnonzero((size > low) & (size <= 2 * low))
        for at, part in pieces(rows, group, max(TILE * 16, 2 * low)):
            p, g = planes(fp[part]), group[part]
            for s in range(1, int(size[part].max())):
                same = np.zeros(len(part), np.uint8)
                same[:-s] = g[:-s] == g[s:]
                ok, counts = within(p ^ shifted(p, s), lanes(same), radius)
                if ok.any():
                    bits = lambda x: np.unpackbits(x.view(np.uint8), bitorder="little")[: len(part)]
                    i = np.flatnonzero(bits(ok))
                    dist = sum(bits(c)[i].astype(np.int64) << k for k, c in enumerate(counts)) - (15 - radius)
                    yield part[i], part[i + s], dist
        low *= 2


def pieces(rows: np.ndarray, group: np.ndarray, most: int):
    """Cuts rows, sorted by group, in parts of about `most` rows that hold whole groups."""
    at = 0
    while at < len(rows):
        end = min(len(rows), at + most)
        while end < len(rows) and group[rows[end]] == group[rows[end - 1]]:
            end += 1
        yield at, rows[at:end]
        at = end


def masks(blocks: int) -> list[int]:
    """Masks of two of the blocks of 64 bits each, as signed longs."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    out = [x | y for x, y in combinations(block, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def grouped(nodes: DataFrame, blocks: int, tile: int) -> DataFrame:
    """nodes (fp and others) once for each group they meet in: columns g (the group) and those of nodes, sorted by g in each partition."""
    all_masks = F.array(*[F.lit(m).cast("long") for m in masks(blocks)])
    rows = nodes.withColumn("m", F.explode(all_masks))
    rows = rows.withColumn("k", F.xxhash64("m", F.col("fp").bitwiseAND(F.col("m"))))
    heavy = reliable(rows.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > tile))
    n_heavy = heavy.count()
    if n_heavy:
        tiles = F.ceil(F.col("n") / tile).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit(7)), tiles)
        rows = rows.join(small(heavy, n_heavy), "k", "left").withColumn("own", own)
        others = F.expr("transform(sequence(0, cast(ceil(n / %d) as int) - 1), u -> xxhash64(k, least(u, own), greatest(u, own)))" % tile)
        rows = rows.withColumn("k", F.explode(F.when(F.col("n").isNull(), F.array("k")).otherwise(others)))
    rows = rows.select(F.col("k").alias("g"), *nodes.columns)
    return rows.repartition("g").sortWithinPartitions("g", "fp")


def by_groups(batches, most: int = 100_000):
    """Joins the record batches of a partition sorted by its first column to tables of whole groups; single rows are left out."""
    kept: list[pa.RecordBatch] = []
    rows = 0

    def cut(last: bool):
        whole = pa.Table.from_batches(kept).combine_chunks()
        g = whole.column(0).to_numpy()
        end = len(g) if last else int(np.searchsorted(g, g[-1]))
        return whole.slice(0, end), whole.slice(end)

    for b in (whole.slice(at, most) for whole in batches for at in range(0, whole.num_rows, most)):
        if b.num_rows:
            kept.append(b)
            rows += b.num_rows
            if rows >= most:
                done, rest = cut(False)
                if done.num_rows:
                    yield done
                kept = rest.to_batches()
                rows = rest.num_rows
                if not done.num_rows:  # one group, larger than a batch
                    rows = 0
    if kept:
        yield cut(True)[0]


def several(t: pa.Table) -> pa.Table:
    g = t.column(0).to_numpy()
    same = g[1:] == g[:-1]
    return t.filter(pa.array(np.r_[False, same] | np.r_[same, False]))


class Union:
    """Disjoint sets of 0..n-1, the smallest member as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        r = self.roots()
        a, b = r[i], r[j]
        while (differ := a != b).any():
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            r = self.roots()
            a, b = r[a], r[b]


def spanning_links(nodes: DataFrame, radius: int, blocks: int, tile: int = TILE) -> DataFrame:
    """Edges a > b of the ids of nodes (fp, id), enough of them to connect all that link inside a group."""

    def run(batches):
        for t in map(several, by_groups(batches)):
            g, fp, ids = (t.column(k).to_numpy() for k in range(3))
            sets = Union(len(fp))
            for i, j, _ in linked(fp.astype(np.int64), g, radius):
                sets.link(i, j)
            root = sets.roots()
            i = np.flatnonzero(root != np.arange(len(fp)))
            a, b = ids[i], ids[root[i]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return grouped(nodes.select("fp", "id"), blocks, tile).mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """What connected() gives, of edges of longs that fit the driver."""
    found = edges.toArrow()
    ids, place = np.unique(np.r_[found.column("a").to_numpy(), found.column("b").to_numpy()], return_inverse=True)
    sets = Union(len(ids))  # by rank, so the smallest member is that of the smallest id
    sets.link(place[: found.num_rows], place[found.num_rows :])
    return edges.sparkSession.createDataFrame(pa.table({"v": ids, "root": ids[sets.roots()]}))


def connected(edges: DataFrame, rounds: int = 60, most: int = DRIVER_EDGES) -> DataFrame:
    """v, root of every vertex of the edges (a, b): its component's smallest vertex.

    Up to `most` edges of longs come to the driver. Of more: alternating large-star and small-star rounds, each written to the
    shared folder, until nothing changes; the number of rounds grows with the logarithm of the longest path.
    """
    edges = reliable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def starred(e: DataFrame, n: int, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select("b", "a"))
        least = reliable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        out = both.join(small(least, 2 * n), "u")
        if large:
            out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        out = reliable(out.filter("a <> b").distinct())
        discard(e, least)
        return out

    before = mark(edges)
    if before[0] <= most and all(t == "bigint" for _, t in edges.dtypes):
        out = components(edges)
        discard(edges)
        return out
    for _ in range(rounds):
        if not before[0]:
            break
        edges = starred(starred(edges, before[0], True), before[0], False)
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def near_classes(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links of at most `radius` differing bits).

    Two of radius + 2 blocks of bits are equal in any two fingerprints within the radius, so no link is lost.
    """
    marked = reliable(fingerprints(docs, width))
    nodes = reliable(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comps = reliable(connected(spanning_links(nodes.select("fp", F.col("fp").alias("id")), radius, radius + 2, tile)))
    member = nodes.join(comps, nodes.fp == comps.v, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    member = reliable(member.join(least, "root").select(F.col("fp").alias("fp_"), "component_id"))
    return marked.join(member, marked.fp == member.fp_).select("doc_id", "fp", "component_id")


def distinct_shingles(raw: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    return np.unique(shingle_hashes(t, width)) if (t := tokens(raw)) else np.zeros(0, np.uint64)


def set_batches(batches, width: int, seed: int = 0):
    """Yields each record batch (text last) in parts, with the sets of shingles of its texts and a hash of each set."""
    for b in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
        sets = [distinct_shingles(x.as_py(), width) for x in b.column(b.num_columns - 1)]
        yield b, sets, np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes(), seed) for x in sets), np.uint64, len(sets)).view(np.int64)


def set_marks(rows: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """doc_id, key, id, t2, fp of rows (doc_id, key, text): two hashes of the set of shingles, and its fingerprint."""

    def run(batches):
        for b, sets, ids in set_batches(batches, width, seed):
            t2 = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), seed + 1) for x in sets), np.uint64, len(sets)).view(np.int64)
            fps = np.fromiter((majority(x) if len(x) else 0 for x in sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *map(pa.array, (ids, t2, fps))], ["doc_id", "key", "id", "t2", "fp"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "key", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, key long, id long, t2 long, fp long")


def shingle_sets(rows: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """id, s: the sorted distinct hashes of each text's shingles, and the hash of that set which set_marks() gives."""

    def run(batches):
        for _, sets, ids in set_batches(batches, width, seed):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["id", "s"])

    return rows.select(F.col("text").cast("binary")).mapInArrow(run, "id long, s array<long>")


def by_key(rows: DataFrame, keys: DataFrame, how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """The semi or anti join of rows with the distinct keys. Rows hold texts, so they are never shuffled: more than `most` keys take several broadcasts."""
    parts = max(1, -(-keys.count() // most))
    place = F.pmod(F.xxhash64("key"), F.lit(parts))
    cut = (rows.filter(place == k).join(F.broadcast(keys.filter(place == k)), "key", how) for k in range(parts))
    return reduce(DataFrame.union, cut)


def least_overlap(n: int, similarity: float) -> int:
    """The least number of elements that a set of n shares with any set of the given similarity."""
    return math.ceil(similarity * n - 1e-6)


def prefixes(rows: DataFrame, width: int, seed: int, similarity: float, common=None, fresh: bool = False) -> DataFrame:
    """h, n, id: of the set of n shingles of each text its first ones, as many as it takes that two sets of the given similarity share one.

    The order is by frequency (of the broadcast shingles and frequencies `common`; 0 for all others), then by hash; fresh:
    only those that are not among the first by hash alone.
    """

    def run(batches):
        known, often = common.value if common else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for _, sets, ids in set_batches(batches, width, seed):
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            h, ends = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.r_[0, np.cumsum(sizes)]
            count = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                count = np.where(known[at] == h, often[at], 0)
            hs = []
            for lo, hi in zip(ends, ends[1:]):
                n, c = int(hi - lo), count[lo:hi]
                order = np.argsort(c, kind="stable") if c.any() else np.arange(n)
                order, first = order[: (length := n - least_overlap(n, similarity) + 1)], length if fresh else 0
                hs.append(h[lo:hi][order[order >= first]])
            lens = np.fromiter(map(len, hs), np.int64, len(hs))
            columns = [np.concatenate([*hs, np.zeros(0, np.uint64)]).view(np.int64), np.repeat(sizes, lens), np.repeat(ids, lens)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "n", "id"])

    return rows.select(F.col("text").cast("binary")).mapInArrow(run, "h long, n long, id long")


def common_shingles(rows: DataFrame, width: int, seed: int, similarity: float):
    """The broadcast shingles that many prefixes hold, sorted, and their frequencies; None if there are none."""
    context, common = rows.sparkSession.sparkContext, None
    known, often = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _ in range(COMMON_ROUNDS):  # after the first round, what an order has brought in is counted, a fraction of the rows
        counts = prefixes(rows, width, seed, similarity, common, common is not None).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > COMMON)
        found = counts.orderBy(F.desc("n"), "h").limit(COMMON_MOST).toArrow()
        h, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
        new = ~np.isin(h, known)
        if not new.any():
            break
        known, often = np.r_[known, h[new]], np.r_[often, n[new]]
        order = np.argsort(known)
        known, often = known[order], often[order]
        common = context.broadcast((known, often))
    return common


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    return n - np.ceil(similarity * n - 1e-6).astype(np.int64) + 1


def prefix_pairs(rows: DataFrame, width: int, seed: int, similarity: float, most: int = GROUP) -> DataFrame:
    """h, a, b, n, need: what the prefixes of the texts' sets have in common.

    Sets of the given similarity share a shingle of their prefixes, and neither is smaller than `similarity` of the other. Of
    a shingle that up to `most` prefixes hold, all pairs a > b of suitable sizes: n is how many such shingles this row stands
    for, and unless all of a pair come to `need`, or a commoner one is shared, the sets are not alike: the one whose prefix
    ends first shares no other shingle of it, so the overlap is at most this number and the rest of the larger remainder.
    Of a commoner shingle h, no pairs: a row of every set a and its size n, b null; and pairs of neighbours in size, need 0.
    """
    heads = prefixes(rows, width, seed, similarity, common_shingles(rows, width, seed, similarity))

    def run(batches):
        for t in by_groups(batches):
            h, n, i = (t.column(k).to_numpy() for k in range(3))
            new = np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1])]
            h, n, i = h[new], n[new], i[new]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.repeat(lens := np.diff(np.r_[starts, len(h)]), lens)
            found = []
            for s in range(1, min(most, int(lens.max()))):
                x = np.flatnonzero((h[s:] == h[:-s]) & (n[:-s] >= similarity * n[s:] - 1e-6) & ((size[s:] <= most) | (s == 1)))
                y = x + s
                rest = np.maximum(n[x] - prefix_length(n[x], similarity), n[y] - prefix_length(n[y], similarity))
                need = np.ceil(similarity / (1 + similarity) * (n[x] + n[y]) - rest - 1e-6).astype(np.int64)
                found.append(np.stack([np.maximum(i[x], i[y]), np.minimum(i[x], i[y]), np.where(size[x] <= most, need, 0)]))
            if found:
                (a, b, need), counts = np.unique(np.concatenate(found, 1), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), *map(pa.array, (a, b, counts.astype(np.int64), need))], ["h", "a", "b", "n", "need"])
            if (many := size > most).any():
                none = pa.nulls(int(many.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h[many]), pa.array(i[many]), none, pa.array(n[many]), none], ["h", "a", "b", "n", "need"])

    return heads.repartition("h").sortWithinPartitions("h", "n", "id").mapInArrow(run, "h long, a long, b long, n long, need long")


def neighbours(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges a > b that connect, of the rows (h, n, id) of each h, all ids whose sizes n let them be alike; in proportion to the rows."""

    def run(batches):
        last = [np.zeros(0, np.int64)] * 3
        for b in batches:
            h, n, i = (np.r_[x, b.column(k).to_numpy()] for k, x in enumerate(last))
            last = [x[-1:] for x in (h, n, i)]
            near = (h[1:] == h[:-1]) & (n[:-1] >= similarity * n[1:] - 1e-6) & (i[1:] != i[:-1])
            a, b = i[1:][near], i[:-1][near]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return rows.select("h", "n", "id").repartition("h").sortWithinPartitions("h", "n", "id").mapInArrow(run, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray]):
    """Yields, for each set, its number of common elements with every set."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    _, term = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(term, kind="stable")
    holders, ends = owner[order], np.r_[0, np.cumsum(np.bincount(term))]
    at = np.r_[0, np.cumsum(sizes)]
    for i in range(n):
        t = term[at[i] : at[i + 1]]
        lens = ends[t + 1] - ends[t]
        place = np.repeat(ends[t] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        yield np.bincount(holders[place], minlength=n)


def stars(pairs: DataFrame, most: int) -> DataFrame:
    """k, id: places k where every pair (a, b) meets; each b is copied once for `most` of its pairs."""
    pairs = reliable(pairs)
    wide = pairs.groupBy("b").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    met = pairs.join(wide, "b").select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("parts"))).alias("k"))
    return met.select("k", F.col("a").alias("id")).union(met.select("k", "b")).distinct()


def tiled(members: DataFrame, tile: int) -> DataFrame:
    """k, id: places k where every two members (g, id, c) of a group g meet that are of different classes c.

    A group's members, sorted by class, are cut in tiles, all pairs of which meet but those of one class only.
    """
    order = Window.partitionBy("g").orderBy("c", "id")
    rows = reliable(members.withColumn("u", F.floor((F.row_number().over(order) - 1) / tile)))
    tiles = rows.groupBy("g", "u").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    other = tiles.select(F.col("g").alias("g_"), F.col("u").alias("v"), F.col("hi").alias("hi_"))
    meet = tiles.join(other, (F.col("g") == F.col("g_")) & (F.col("u") <= F.col("v")) & (F.col("lo") != F.col("hi_")))
    meet = reliable(meet.select("g", "u", "v", F.xxhash64("g", "u", "v").alias("k")))
    places = meet.select("g", "u", "k").union(meet.filter("u < v").select("g", "v", "k"))
    return rows.join(places, ["g", "u"]).select("k", "id")


def alike(places: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges a > b, enough of them to connect the ids of each place k of places (k, id) whose sets (id, s) are as similar as asked."""
    rows = sets.join(small(places), "id").select("k", "id", "s")
    rows = rows.repartition("k").sortWithinPartitions("k", "id")

    def run(batches):
        for t in by_groups(batches, AT_ONCE):
            g = t.column(0).to_numpy()
            starts = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
            for lo, hi in zip(starts, starts[1:]):
                part = t.slice(lo, hi - lo)
                ids, lists = part.column(1).to_numpy(), part.column(2).combine_chunks()
                sets = [lists[i].values.to_numpy(zero_copy_only=False) for i in range(len(lists))]
                n, links = np.array([len(x) for x in sets]), Union(len(sets))
                for i, both in enumerate(overlaps(sets)):
                    near = np.flatnonzero(both >= similarity * (n + n[i] - both))
                    links.link(np.full(len(near), i), near)
                root = links.roots()
                i = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[root[i]])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int = NEAR_WIDTH, similarity: float = NEAR_SIMILARITY, used: list | None = None) -> DataFrame:
    """doc_id, key, keeper, keeper_key: of every row, the row that stays for it, itself if it is unlike all others.

    Two documents are alike if their sets of `width`-word shingles have the given Jaccard similarity. The sets' fingerprints
    are linked as those of near_classes(), and links are verified by the sets. Fingerprints of sets of that similarity may
    be far apart, so an exact way finds the rest: pairs of sets of different classes that share enough of their prefixes. A
    group is what likeness connects; the row of the smallest doc_id stays, null last, then that of the smallest key, a hash
    of all columns. Documents without words are copies of each other. Sets are made anew from the texts wherever they are
    read, as they would take more disk than the texts. `used`, if given, receives the tables that the result reads.
    """
    rows = docs.select("doc_id", row_hash(docs).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")).alias("rep")
    for seed in count():  # until no two sets have one id
        marked = reliable(set_marks(rows, width, seed))
        nodes = reliable(marked.groupBy("id", "t2").agg(rep, F.min("fp").alias("fp")))
        if not nodes.groupBy("id").count().filter("count > 1").limit(1).count():
            break
    kept = nodes.select(F.col("rep.key").alias("key"), "id")
    copies = marked.join(kept.withColumnRenamed("key", "kept"), "id").filter("key <> kept").select("key").distinct()
    copies = reliable(copies.join(kept, "key", "left_anti"))
    once = by_key(rows, copies, "left_anti")

    def classes(edges: DataFrame) -> DataFrame:
        return reliable(connected(edges).select(F.col("v").alias("id"), F.col("root").alias("c")))

    def apart(pairs: DataFrame, c: DataFrame) -> DataFrame:
        """The pairs whose ends are of different classes."""
        ends = [c.select(F.col("id").alias(x), F.col("c").alias(f"c_{x}")) for x in "ab"]
        return pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").filter("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b")

    def verified(places: DataFrame) -> DataFrame:
        places = reliable(places)
        keys = reliable(kept.join(places.select("id").distinct(), "id").select("key").distinct())
        return reliable(alike(places, shingle_sets(by_key(rows, keys, "left_semi"), width, seed), similarity))

    prints = reliable(nodes.groupBy("fp").agg(F.min("id").alias("first")))
    equal = nodes.join(prints, "fp").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    links = spanning_links(prints.select("fp", F.col("first").alias("id")), RADIUS, RADIUS + 2).union(equal)
    edges = [verified(stars(links, NEAR_TILE))]
    known = classes(edges[0])
    found = reliable(prefix_pairs(once, width, seed, similarity))
    pairs = found.filter("b is not null").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).filter("n >= need")
    edges.append(verified(stars(apart(pairs, known), NEAR_TILE)))
    known = classes(edges[0].union(edges[1]))
    many = found.filter("b is null").select("h", "n", F.col("a").alias("id")).join(known, "id", "left").withColumn("c", F.coalesce("c", "id"))
    mixed = many.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("h")
    many = reliable(many.join(mixed, "h"))
    members = connected(neighbours(many, similarity)).select(F.col("root").alias("g"), F.col("v").alias("id"))
    edges.append(verified(tiled(members.join(many.select("id", "c").distinct(), "id"), NEAR_TILE)))
    comps = reliable(connected(reduce(DataFrame.union, edges)))
    discard(found, many)
    slim = reliable(marked.select("doc_id", "key", "id"))
    discard(marked)
    member = reliable(comps.join(nodes.select("id", "rep"), F.col("v") == F.col("id")).select("root", "v", "rep"))
    best = reliable(member.join(member.groupBy("root").agg(F.min("rep").alias("best")), "root").select(F.col("v").alias("id"), "best"))
    keepers = reliable(nodes.join(small(best), "id", "left").select("id", F.coalesce("best", "rep").alias("best")))
    if used is not None:
        used += [slim, keepers]
    out = slim.join(keepers, "id")
    return out.select("doc_id", "key", F.col("best.doc_id").alias("keeper"), F.col("best.key").alias("keeper_key"))


def deduplicated(docs: DataFrame, width: int = NEAR_WIDTH, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """The rows of docs that stay, one of each group of near-duplicates, all columns; of rows equal in all of them, one."""
    used: list = []
    found = near_duplicates(docs, width, similarity, used)
    stays = F.col("doc_id").eqNullSafe(F.col("keeper")) & (F.col("key") == F.col("keeper_key"))
    found = reliable(found.groupBy(F.col("doc_id").alias("d_"), F.col("key").alias("k_")).agg(F.min(stays).alias("stays"), F.count("*").alias("n")))
    discard(*used)
    gone = reliable(found.filter("not stays").select("d_", "k_"))
    kept = docs.withColumn("key_", row_hash(docs))
    kept = kept.join(small(gone), F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("key_") == F.col("k_")), "left_anti").drop("key_")
    return kept.dropDuplicates() if found.filter("n > 1 and stays").limit(1).count() else kept


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the class it is linked to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_classes(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
