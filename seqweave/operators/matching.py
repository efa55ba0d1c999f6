"""Longest matches of every input position in a reference.

match(pos) = (ptr, len): the longest run of the input from pos on that occurs in the reference, and the leftmost place
where it does; len 0 and no ptr if the symbol does not occur. Two plans give the same result:

* automaton: the reference is broadcast, each input is read once against its suffix automaton, in linear time and
  without a shuffle. For references of up to AUTOMATON_SYMBOLS symbols.
* seed join: k-grams of inputs and reference are joined, hits on one diagonal that follow each other are islands, an
  island is a maximal match. Matches shorter than k are not seen. For any size; sequences are cut in chunks, and the
  shuffle is spread by k-gram. A k-gram that repeats gives a hit for each pair of places, so k should be long enough for
  the reference's repeats.

A reference is one row (symbols), or, if it is long, rows (chunk, symbols) of equal length but for the last.
Defined results: null symbols match nothing; empty inputs have no positions; repeated inputs each have their rows.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AUTOMATON_SYMBOLS = 500_000
#: Symbols in a chunk of a sequence.
CHUNK = 1024
#: Symbols, or phrases, after which a Python worker hands its rows on.
AT_ONCE = 1 << 16


class Automaton:
    """All substrings of a reversed reference; for every state the last end of its strings, which is the leftmost start
    in the reference itself."""

    def __init__(self, reference: list[int]):
        self.n = len(reference)
        self.next: list[dict] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for at, c in enumerate(reversed(reference)):
            new = self._state(self.length[last] + 1, {}, at)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][c]
                if self.length[q] != self.length[p] + 1:
                    twin = self._state(self.length[p] + 1, dict(self.next[q]), -1)
                    self.link[twin], self.link[q] = self.link[q], twin
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    q = twin
                self.link[new] = q
            last = new
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            up = self.link[s]
            if up > 0 and self.end[up] < self.end[s]:
                self.end[up] = self.end[s]

    def _state(self, length: int, moves: dict, end: int) -> int:
        self.next.append(moves)
        self.link.append(-1)
        self.length.append(length)
        self.end.append(end)
        return len(self.link) - 1

    def matches(self, symbols: list[int]) -> tuple[list[int | None], list[int]]:
        """ptr and len of each position."""
        n = len(symbols)
        ptr, lens = [None] * n, [0] * n
        moves, link, longest, ends, top = self.next, self.link, self.length, self.end, self.n - 1
        state, length = 0, 0
        for pos in range(n - 1, -1, -1):
            c = symbols[pos]
            to = moves[state].get(c)
            while to is None and state:
                state = link[state]
                length = longest[state]
                to = moves[state].get(c)
            if to is not None:
                state, length = to, length + 1
                ptr[pos], lens[pos] = top - ends[to], length
        return ptr, lens


_KEPT: dict[str, Automaton] = {}


def automaton(name: str, reference) -> Automaton:
    """The automaton of the reference of this name, built once for each Python worker, which keeps the last one."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Automaton(reference())
    return _KEPT[name]


def sparse(matches: DataFrame) -> DataFrame:
    """input_id, pos, ptr, len: the rows of matches gathered in arrays, one row per input."""
    m = F.sort_array(F.collect_list(F.struct("pos", "ptr", "len")))
    return matches.groupBy("input_id").agg(m.alias("m")).select("input_id", "m.pos", "m.ptr", "m.len")


def symbols_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """input_id, symbols: a text column as code points; null ids and null texts are left out."""
    codes = F.transform(F.split(F.col(text), ""), lambda c: F.ascii(c).cast("long"))
    return df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("input_id"), F.when(F.length(text) > 0, codes).otherwise(F.array().cast("array<bigint>")).alias("symbols")
    )


def chunked(sequences: DataFrame, *keys: str, more: int = 0) -> DataFrame:
    """keys, chunk, symbols: sequences (keys, symbols) in chunks of CHUNK symbols, each with `more` of those behind it."""
    starts = F.sequence(F.lit(0), F.floor((F.size("symbols") - 1) / CHUNK).cast("int"))
    rows = sequences.filter(F.size("symbols") > 0).select(*keys, "symbols", F.explode(starts).alias("chunk"))
    return rows.select(*keys, F.col("chunk").cast("long").alias("chunk"), F.slice("symbols", F.col("chunk") * CHUNK + 1, F.lit(CHUNK + more)).alias("symbols"))


def reference_chunks(reference: DataFrame, more: int = 0) -> DataFrame:
    """chunk, symbols: a reference in chunks of CHUNK symbols, each with `more` (at most CHUNK) of those behind it."""
    if "chunk" not in reference.columns:
        return chunked(reference, more=more)
    longest = reference.agg(F.max(F.size("symbols"))).first()[0] or CHUNK
    if longest % CHUNK and reference.count() > 1:
        raise ValueError(f"chunks of a reference hold a multiple of {CHUNK} symbols")
    small = chunked(reference.withColumnRenamed("chunk", "large"), "large")
    small = small.select((F.col("large") * (longest // CHUNK) + F.col("chunk")).alias("chunk"), "symbols")
    if not more:
        return small
    behind = small.select((F.col("chunk") - 1).alias("chunk"), F.slice("symbols", 1, more).alias("next"))
    return small.join(behind, "chunk", "left").select("chunk", F.concat("symbols", F.coalesce("next", F.array().cast("array<bigint>"))).alias("symbols"))


def reference_size(reference: DataFrame) -> int:
    n, total = reference.agg(F.count("*"), F.coalesce(F.sum(F.size("symbols")), F.lit(0))).first()
    if n != 1 and "chunk" not in reference.columns:
        raise ValueError(f"a reference is one sequence, not {n}")
    return total


def reference_symbols(reference: DataFrame, most: int = AUTOMATON_SYMBOLS) -> list[int]:
    """The symbols of a reference, whose size is checked before they come to the driver."""
    n = reference_size(reference)
    if n > most:
        raise ValueError(f"a reference of {n} symbols is beyond {most}; use the seed join")
    parts = reference.orderBy("chunk") if "chunk" in reference.columns else reference
    return [x for r in parts.select("symbols").collect() for x in r[0]]


def matches_wide(inputs: DataFrame, reference: list[int]) -> DataFrame:
    """input_id, symbols, ptr, len: one row per input with arrays over its positions."""
    shared, name = inputs.sparkSession.sparkContext.broadcast(reference), uuid.uuid4().hex

    def run(batches):
        machine = automaton(name, lambda: shared.value)
        for b in batches:
            found, first, held = [], 0, 0
            for k in range(b.num_rows):
                found.append(machine.matches(b.column(1)[k].as_py() or []))
                held += len(found[-1][0])
                if held >= AT_ONCE or k + 1 == b.num_rows:
                    both = [pa.array(x, pa.list_(pa.int64())) for x in zip(*found)]
                    yield pa.RecordBatch.from_arrays([*b.slice(first, k + 1 - first).columns, *both], ["input_id", "symbols", "ptr", "len"])
                    found, first, held = [], k + 1, 0

    return inputs.select("input_id", "symbols").mapInArrow(run, "input_id long, symbols array<bigint>, ptr array<bigint>, len array<bigint>")


def matches_long(wide: DataFrame) -> DataFrame:
    """input_id, pos, ptr, len: one row per position."""
    zipped = F.posexplode(F.arrays_zip("ptr", "len"))
    return wide.select("input_id", zipped.alias("pos", "m")).select("input_id", F.col("pos").cast("long").alias("pos"), "m.ptr", "m.len")


def grams(symbols: Column, k: int) -> Column:
    """Structs (p, g) of each position and the k-gram that starts there."""
    return F.when(F.size(symbols) >= k, F.transform(F.sequence(F.lit(0), F.size(symbols) - k), lambda p: F.struct(p.cast("long").alias("p"), F.slice(symbols, p + 1, k).alias("g"))))


def maximal_matches(inputs: DataFrame, reference: DataFrame, k: int = 2) -> DataFrame:
    """input_id, start, ptr, len of every exact match of at least k symbols that cannot be extended to either side."""
    def placed(chunks: DataFrame, name: str) -> DataFrame:
        keys = [c for c in chunks.columns if c not in ("chunk", "symbols")]
        each = chunks.select(*keys, "chunk", F.inline(grams(F.col("symbols"), k)))
        return each.select(*keys, (F.col("chunk") * CHUNK + F.col("p")).alias(name), "g")

    left, right = placed(chunked(inputs, "input_id", more=k - 1), "ip"), placed(reference_chunks(reference, k - 1), "rp")
    hits = left.join(right, "g").select("input_id", "ip", (F.col("rp") - F.col("ip")).alias("d"))
    order = W.partitionBy("input_id", "d").orderBy("ip")
    islands = hits.withColumn("island", F.col("ip") - F.row_number().over(order))
    found = islands.groupBy("input_id", "d", "island").agg(F.min("ip").alias("start"), (F.max("ip") - F.min("ip") + k).alias("len"))
    return found.select("input_id", "start", (F.col("start") + F.col("d")).alias("ptr"), "len")


def matches_by_seeds(inputs: DataFrame, reference: DataFrame, k: int = 2) -> DataFrame:
    """input_id, pos, ptr, len of the positions with a match of at least k symbols."""
    found = maximal_matches(inputs, reference, k)
    each = found.select("input_id", "start", "ptr", "len", F.explode(F.sequence("start", F.col("start") + F.col("len") - k)).alias("pos"))
    each = each.select("input_id", "pos", (F.col("start") + F.col("len") - F.col("pos")).alias("l"), (F.col("ptr") + F.col("pos") - F.col("start")).alias("p"))
    return each.groupBy("input_id", "pos").agg(F.max(F.struct("l", (-F.col("p")).alias("np"))).alias("b")).select("input_id", "pos", (-F.col("b.np")).alias("ptr"), F.col("b.l").alias("len"))
