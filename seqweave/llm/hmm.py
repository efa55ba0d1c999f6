"""Hidden Markov language model: Baum-Welch counts added up over partitions, exact likelihood by the scaled forward recursion.

Counting. Each partition counts its tokens; Spark adds the counts up to a table of all words. Its HEAD most frequent
words are broadcast, the others are joined, as the table grows with the corpus; rare words cannot be skewed.

Model. The states emit one of SYMBOLS frequent words, the end of the text, or the class of all other tokens; a token
of that class has the probability (c + 1) / (C + V + 1), with C the class's count, V its distinct words, one part for
unseen words. So the probabilities of all texts sum to one (or less). Training documents are written once as symbols, and
each Baum-Welch round goes over all of them: expected transitions and emissions of a partition are rows that Spark adds up.

Start. One pass counts in how many training documents each two of the ANCHORS most frequent words meet; their groups, as many
as states, come from that matrix. A second pass gives every whole document to the group most of its anchors belong to and
adds up its words: a state starts with the words of its group's documents. Nothing is learned from samples or beginnings.

Long texts. The expected counts of a text beyond PIECE tokens are those of the whole recursion: its forward values are kept
only between segments and computed again on the way back, so memory is bounded by a segment.

Defined results: null and empty texts are the end alone; null ids are training documents; repeated rows count each
time; an empty table gives an empty result; without training documents N and V are 0, each token has base
probability 1 and the model's start is uniform; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import discard, id_remainder, reliable

FOLDS, HELD_OUT = 7, 2
HEAD, SYMBOLS, STATES, ROUNDS = 1 << 18, 1 << 14, 8, 2
#: Frequent words whose meetings give the start, symbols in a segment of a long text, and the seed of the start.
ANCHORS, PIECE, SEED = 128, 200_000, 5
#: Tokens handled at once; distinct words that a partition counts before it passes them on.
AT_ONCE, FLUSH = 250_000, 400_000
#: Weight, in tokens, of the corpus's word frequencies in a state's emissions.
SMOOTH = 200.0
END = b""


@dataclass
class Vocabulary:
    """The frequent words, by falling count, and the counts of all."""

    words: bytes  # joined by spaces
    counts: np.ndarray
    symbols: int
    end_count: int
    n: int  # tokens
    v: int  # distinct tokens
    rest_n: int  # tokens of the class of others
    rest_v: int
    ids: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"ids": {}}

    def lookup(self):
        if not self.ids and self.words:
            self.ids.update(zip(self.words.split(), range(len(self.counts))))
        return self.ids.get

    @property
    def size(self) -> int:
        """Symbols, the class of others, the end."""
        return self.symbols + 2


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # a row per symbol


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)


def token_counts(docs: DataFrame) -> DataFrame:
    """w, c: every token of the docs and its count; the end is the empty word."""

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                counts.update((x.as_py() or b"").lower().split())
                if len(counts) > FLUSH:
                    yield rows(counts)
                    counts.clear()
            counts[END] += b.num_rows
        if counts:
            yield rows(counts)

    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["w", "c"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, head: int = HEAD, symbols: int = SYMBOLS) -> tuple[Vocabulary, int]:
    """The vocabulary, and the count from which a word belongs to its head."""
    level = F.floor(F.log2("c") * 64)
    is_end = F.col("w") == F.lit(END)
    bins = counts.groupBy(level.alias("k"), is_end.alias("e")).agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.min("c").alias("least")).collect()  # a few thousand at most
    n, v = sum(r.n for r in bins), sum(r.v for r in bins)
    end_count = sum(r.n for r in bins if r.e)
    least, room = 1 << 62, head
    for r in sorted((r for r in bins if not r.e), key=lambda r: -r.k):
        if r.v > room:
            break
        least, room = r.least, room - r.v
    top = counts.filter((F.col("c") >= least) & ~is_end).toArrow()
    words, c = top.column("w").to_pylist(), top.column("c").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    c = np.array([c[i] for i in order], np.int64)
    own = min(symbols, len(order))
    kept = int(c[:own].sum())
    return Vocabulary(b" ".join(words[i] for i in order), c, own, end_count, n, v, n - end_count - kept, v - own - (end_count > 0)), least


def sequences(voc: Vocabulary, texts) -> list[np.ndarray]:
    """Each text's head word numbers; -1 for other words."""
    get = voc.lookup()
    out = []
    for x in texts:
        toks = (x.as_py() or b"").lower().split()
        out.append(np.fromiter(map(get, toks, repeat(-1)), np.int32, len(toks)))
    return out


def as_symbols(voc: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Symbols with the end appended."""
    s = np.empty(len(ids) + 1, np.int32)
    s[:-1] = np.where((ids < 0) | (ids >= voc.symbols), voc.symbols, ids)
    s[-1] = voc.symbols + 1
    return s


class Batch:
    """Sequences side by side: all first symbols, then all second ones, ..., longest sequence first."""

    def __init__(self, seqs: list[np.ndarray]):
        lens = np.array([len(s) for s in seqs])
        self.order = np.argsort(-lens, kind="stable")
        lens = lens[self.order]
        self.n = len(lens)
        active = self.n - np.searchsorted(lens[::-1], np.arange(lens[0]), side="right")  # with more than t symbols
        self.at = np.r_[0, np.cumsum(active)]
        doc = np.repeat(np.arange(self.n), lens)
        t = np.arange(len(doc)) - np.repeat(np.cumsum(lens) - lens, lens)
        place = self.at[t] + doc
        self.symbols, self.doc = np.empty(len(doc), np.int32), np.empty(len(doc), np.int64)
        self.symbols[place] = np.concatenate([seqs[i] for i in self.order])
        self.doc[place] = doc

    def forward(self, m: Model, keep: bool):
        """The scale of each symbol (its probability given those before), and the scaled forward values."""
        emit = m.emit[self.symbols]
        scale = np.empty(len(emit))
        alpha = np.empty_like(emit) if keep else None
        ones = np.ones(len(m.start))
        at = self.at.tolist()
        a = m.start * emit[: at[1]]
        for t in range(len(at) - 1):
            lo, hi = at[t], at[t + 1]
            if t:
                a = a[: hi - lo] @ m.move
                a *= emit[lo:hi]
            s = a @ ones
            a /= s[:, None]
            scale[lo:hi] = s
            if keep:
                alpha[lo:hi] = a
        return emit, scale, alpha

    def logs(self, m: Model) -> np.ndarray:
        """log10 of each sequence's probability, in the order given."""
        _, scale, _ = self.forward(m, False)
        out = np.empty(self.n)
        out[self.order] = np.bincount(self.doc, np.log10(scale), self.n)
        return out

    def expected(self, m: Model, size: int):
        """Expected starts, moves and emissions."""
        emit, scale, alpha = self.forward(m, True)
        beta = np.ones_like(emit)
        later = emit / scale[:, None]  # times beta: what comes back from the next symbol
        at, back = self.at.tolist(), np.ascontiguousarray(m.move.T)
        for t in range(len(at) - 2, 0, -1):
            lo, hi, before = at[t], at[t + 1], at[t - 1]
            later[lo:hi] *= beta[lo:hi]
            beta[before : before + hi - lo] = later[lo:hi] @ back
        gamma = alpha * beta
        t = np.repeat(np.arange(len(at) - 1), np.diff(self.at))
        nxt = np.arange(self.at[1], len(emit))
        prev = self.at[t[nxt] - 1] + self.doc[nxt]
        moves = m.move * (alpha[prev].T @ later[nxt])
        emitted = np.stack([np.bincount(self.symbols, gamma[:, k], size) for k in range(gamma.shape[1])], 1)
        return gamma[: at[1]].sum(0), moves, emitted


def expected_of_long(seq: np.ndarray, m: Model, size: int, piece: int = PIECE):
    """Expected starts, moves and emissions of one sequence of any length, in segments."""
    parts = [seq[at : at + piece] for at in range(0, len(seq), piece)]

    def forward(part, a):
        emit = m.emit[part]
        alpha, scale = np.empty_like(emit), np.empty(len(part))
        for t in range(len(part)):
            a = (m.start if a is None else a @ m.move) * emit[t]
            scale[t] = total = a.sum()
            alpha[t] = a = a / total
        return emit, alpha, scale

    before: list = [None]
    for part in parts[:-1]:
        before.append(forward(part, before[-1])[1][-1])
    moves, emitted, back = np.zeros_like(m.move), np.zeros((size, len(m.start))), np.ones(len(m.start))
    for part, a in zip(reversed(parts), reversed(before)):
        emit, alpha, scale = forward(part, a)
        later, beta = emit / scale[:, None], np.empty_like(emit)
        for t in range(len(part) - 1, -1, -1):
            beta[t] = back
            later[t] *= back
            back = m.move @ later[t]
        gamma = alpha * beta
        for k in range(gamma.shape[1]):
            emitted[:, k] += np.bincount(part, gamma[:, k], size)
        prev = alpha[:-1] if a is None else np.vstack([a, alpha[:-1]])
        moves += m.move * (prev.T @ later[len(later) - len(prev) :])
    return gamma[0], moves, emitted


def batches_of(seqs: list[np.ndarray]):
    """Index lists of sequences of like lengths, about AT_ONCE symbols each."""
    group, total = [], 0
    for i in sorted(range(len(seqs)), key=lambda i: -len(seqs[i])):
        group.append(i)
        total += len(seqs[i])
        if total >= AT_ONCE:
            yield group
            group, total = [], 0
    if group:
        yield group


def updated(voc: Vocabulary, starts, moves, emitted) -> Model:
    """The model of expected counts; a state's emissions lean on the corpus's."""
    base = np.r_[voc.counts[: voc.symbols], voc.rest_n + 1, voc.end_count + 1].astype(float)
    emitted = emitted + SMOOTH * (base / base.sum())[:, None]
    moves = moves + 1.0
    starts = starts + 1.0
    return Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emitted / emitted.sum(0))


def encoded(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """s: the symbols of every document, the end last."""
    shared = docs.sparkSession.sparkContext.broadcast(voc)

    def run(batches):
        for b in (whole.slice(at, 2500) for whole in batches for at in range(0, whole.num_rows, 2500)):
            yield pa.RecordBatch.from_arrays([pa.array([as_symbols(shared.value, s) for s in sequences(shared.value, b.column(0))], pa.list_(pa.int32()))], ["s"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "s array<int>")


def arrays(column) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def summed(rows: DataFrame, run, columns: int, size: int) -> np.ndarray:
    """The sum of all partitions' tables of `size` rows and so many columns; run(arrays of a batch, table) adds to one."""
    names = [f"x{k}" for k in range(columns)]

    def add_up(batches):
        table = np.zeros((size, columns))
        for b in (whole.slice(at, 2500) for whole in batches for at in range(0, whole.num_rows, 2500)):
            run(arrays(b.column(0)), table)
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(np.ascontiguousarray(table[used, k])) for k in range(columns))], ["k", *names])

    got = rows.mapInArrow(add_up, "k long, " + ", ".join(f"{x} double" for x in names))
    got = got.groupBy("k").agg(*[F.sum(x).alias(x) for x in names]).toArrow()  # at most `size` rows
    total = np.zeros((size, columns))
    total[got.column("k").to_numpy()] = np.stack([got.column(x).to_numpy() for x in names], 1)
    return total


def anchor_groups(meetings: np.ndarray, states: int) -> np.ndarray:
    """A group for each anchor: k-means of the leading eigenvectors of how much oftener than by chance they meet."""
    own = np.maximum(np.diag(meetings), 1)
    n = max(own.max(), 1)
    lift = np.maximum(0, np.log((meetings + 0.1) * n / np.outer(own, own)))
    lift = (lift + lift.T) / 2
    degree = np.maximum(lift.sum(1), 1e-9) ** -0.5
    _, vectors = np.linalg.eigh(degree[:, None] * lift * degree)
    x = vectors[:, -states:]
    x = x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
    x = x * np.sign(x[np.abs(x).argmax(0), np.arange(x.shape[1])])
    picked = [0]
    while len(picked) < min(states, len(x)):
        picked.append(int((x @ x[picked].T).max(1).argmin()))
    centre = x[picked]
    for _ in range(50):
        group = (x @ centre.T).argmax(1)
        centre = np.stack([x[group == k].sum(0) if (group == k).any() else centre[k] for k in range(len(centre))])
        centre = centre / np.maximum(1e-12, np.linalg.norm(centre, axis=1, keepdims=True))
    return group


def starting(rows: DataFrame, voc: Vocabulary, states: int) -> Model:
    """A model whose states are groups of like documents, from two passes over the encoded documents."""
    anchors, size = min(ANCHORS, voc.symbols), voc.size
    jitter = np.random.default_rng(SEED).random((size, states)) * 0.01
    if not anchors:
        return updated(voc, np.ones(states), np.eye(states) * 100.0, jitter)

    def meet(seqs, table):
        for at in range(0, len(seqs), 1024):
            part = seqs[at : at + 1024]
            x = np.zeros((len(part), anchors), np.float32)
            for i, s in enumerate(part):
                x[i, s[s < anchors]] = 1
            table[:, 0] += (x.T @ x).ravel()

    group = anchor_groups(summed(rows, meet, 1, anchors * anchors).reshape(anchors, anchors), states)

    def gather(seqs, table):
        for s in seqs:
            votes = np.bincount(group[s[s < anchors]], minlength=states)
            if votes.any():
                used, n = np.unique(s, return_counts=True)
                table[used, votes.argmax()] += n

    return updated(voc, np.ones(states), np.eye(states) * 100.0, jitter + summed(rows, gather, states, size))


def baum_welch(rows: DataFrame, voc: Vocabulary, model: Model, rounds: int = ROUNDS, piece: int = PIECE) -> Model:
    """`rounds` passes over all encoded documents."""
    context, size, states = rows.sparkSession.sparkContext, voc.size, len(model.start)
    for _ in range(rounds):
        shared = context.broadcast(model)

        def run(seqs, table, shared=shared):
            m = shared.value
            parts = [expected_of_long(s, m, size, piece) for s in seqs if len(s) > piece]
            short = [s for s in seqs if len(s) <= piece]
            for group in batches_of(short):
                parts.append(Batch([short[i] for i in group]).expected(m, size))
            for starts, moves, emitted in parts:
                table[:size] += emitted
                table[size : size + states] += moves
                table[-1] += starts

        total = summed(rows, run, states, size + states + 1)
        model = updated(voc, total[-1], total[size : size + states], total[:size])
        shared.unpersist()
    return model


def fitted(docs: DataFrame, head: int = HEAD, symbols: int = SYMBOLS, states: int = STATES, rounds: int = ROUNDS):
    """The counts of all tokens of docs, the count from which words are in the head, the vocabulary, and the model."""
    counts = reliable(token_counts(docs))
    voc, least = vocabulary(counts, head, symbols)
    rows = reliable(encoded(docs, voc))
    model = baum_welch(rows, voc, starting(rows, voc, states), rounds)
    discard(rows)
    return counts, least, voc, model


def scored(docs: DataFrame, counts: DataFrame, least: int, voc: Vocabulary, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((voc, model))

    def run(batches):
        voc, model = shared.value
        logs = np.log10(voc.counts + 1.0)
        row = TaskContext.get().partitionId() << 33
        end_log = math.log10(voc.end_count + 1)
        for whole in batches:
            for b in (whole.slice(at, 2500) for at in range(0, whole.num_rows, 2500)):
                texts = b.column(2)
                seqs = sequences(voc, texts)
                syms = [as_symbols(voc, s) for s in seqs]
                score = np.zeros(len(seqs))
                for group in batches_of(syms):
                    score[group] = Batch([syms[i] for i in group]).logs(model)
                base, known, other, tails = np.empty(len(seqs)), np.empty(len(seqs), np.int64), np.empty(len(seqs), np.int64), []
                for i, s in enumerate(seqs):
                    head = s[s >= 0]
                    base[i] = logs[head].sum() + end_log
                    score[i] += logs[head[head >= voc.symbols]].sum()
                    known[i] = len(head) + (voc.end_count > 0)
                    other[i] = len(s) - (head < voc.symbols).sum()
                    miss = np.flatnonzero(s < 0)
                    toks = (texts[i].as_py() or b"").lower().split() if len(miss) else []
                    tails.append([toks[j] for j in miss])
                n = np.fromiter(map(len, syms), np.int64, len(syms))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:2], pa.array(np.arange(row, row + len(n))), *map(pa.array, (n, known, other, base, score)), pa.array(tails, pa.list_(pa.binary()))],
                    ["doc_id", "held_out", "row", "n", "known", "other", "base", "score", "tail"],
                )
                row += len(n)

    rows = docs.select("doc_id", (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("binary"))
    rows = reliable(rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, row long, n long, known long, other long, base double, score double, tail array<binary>"))
    tail = rows.select("row", F.explode("tail").alias("w")).groupBy("row", "w").agg(F.count("*").alias("n"))
    rare = counts.filter((F.col("c") < least) & (F.col("w") != F.lit(END)))
    tail = tail.join(rare, "w").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_log"), F.sum("n").alias("tail_known"))
    out = rows.drop("tail").join(tail, "row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    base = F.col("base") + tail_log - F.col("n") * F.lit(math.log10(voc.n + voc.v + 1))
    score = F.col("score") + tail_log - F.col("other") * F.lit(math.log10(voc.rest_n + voc.rest_v + 1))
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(voc.n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, *fitted(training(docs)))
