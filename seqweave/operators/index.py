"""Building an index and querying it without decompressing.

An index is a phrase table, a reference (one row, or chunks), and its settings. Building runs one pass over the
inputs: match, parse and commit happen where the input lies. Queries are equi-joins: on buckets of positions for phrases,
on chunks for the reference, of which only the chunks that a copy touches meet it. A small reference is broadcast.

Defined results: empty inputs have no phrases; null ids are left out by the readers; an input given twice has its phrases
twice; ranges and positions outside an input find nothing; tables without rows give none.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqweave.operators.committing import committed, committed_differences
from seqweave.operators import matching
from seqweave.operators.matching import AT_ONCE, AUTOMATON_SYMBOLS, CHUNK, chunked, reference_chunks, reference_size, reference_symbols
from seqweave.operators.parsing import differential, parser
from seqweave.schema import PHRASES, IndexConfig, alphabet

#: Positions in a bucket of range joins, and in a chunk of decoded output.
BUCKET = CHUNK
#: Largest reference of a differential index, whose values the parse itself reads.
VALUES = 1 << 24
NAMES = [c.split()[0] for c in PHRASES.split(", ")]


def differences(x: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *x], x)]


@dataclass
class Index:
    phrases: DataFrame
    reference: DataFrame | None
    config: IndexConfig

    def with_reference(self, reference: DataFrame) -> Index:
        """The index with another source of its copies; its symbols must be of the index's alphabet."""
        validated(reference, self.config.alphabet)
        return Index(self.phrases, reference, self.config)

    @property
    def differential(self) -> bool:
        return self.config.layout == "lit_then_copy"

    def size(self) -> DataFrame:
        """input_id, n."""
        return self.phrases.groupBy("input_id").agg(F.max(F.col("start") + F.col("copy_len") + F.col("lit_len")).alias("n"))

    def walk(self) -> DataFrame:
        """Every subphrase: offset of its source, whole length, literals."""
        return self.phrases.select("input_id", "subphrase", "start", (F.col("target") - F.col("start")).alias("offset"), (F.col("copy_len") + F.col("lit_len")).alias("length"), "lit_len", "copy_len", "target")

    def pointers(self) -> DataFrame:
        return self.phrases.select("input_id", "subphrase", "phrase", (F.col("block_ptr") + F.col("diff")).alias("pointer"))

    def counts(self) -> DataFrame:
        return self.phrases.groupBy("input_id").agg(F.count("*").alias("subphrases"), F.sum(F.col("is_block").cast("long")).alias("phrases"))

    def bucketed(self) -> DataFrame:
        """The phrases once for each bucket of positions that they touch."""
        end = F.col("start") + F.col("copy_len") + F.col("lit_len")
        return self.phrases.withColumn("end", end).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((end - 1) / BUCKET))))

    def locate(self, positions: DataFrame) -> DataFrame:
        """positions (input_id, pos) with the phrase that covers them."""
        found = positions.withColumn("bucket", F.floor(F.col("pos") / BUCKET)).join(self.bucketed(), ["input_id", "bucket"])
        return found.filter((F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("end"))).drop("bucket")

    def _values(self, found: DataFrame, lo, n) -> DataFrame:
        """found (phrases) with the symbols of the span [lo, lo + n) of each, in rows: `at`, a position, and `part`, those from there on."""
        if self.reference is None:
            raise ValueError("the index has no reference; attach one by with_reference()")
        chunks = reference_chunks(self.reference).select(F.col("chunk").alias("q_"), F.col("symbols").alias("ref_"))
        if reference_size(self.reference) <= AUTOMATON_SYMBOLS:
            chunks = F.broadcast(chunks)
        elsewhere = -1 - F.pmod("start", F.lit(4096))  # no chunk; spread, so that no task gets all
        shift = F.lit(0)
        if self.differential:
            both = (F.col("lit_len") > 0) & (F.col("copy_len") > 0)
            before = F.col("target") - 1
            found = found.withColumn("q_", F.when(both & (before >= 0), F.floor(before / CHUNK)).otherwise(elsewhere)).join(chunks, "q_", "left")
            last = F.element_at("lits", F.greatest("lit_len", F.lit(1)).cast("int"))
            shift = F.when(both, last - F.coalesce(F.get("ref_", F.pmod(before, F.lit(CHUNK)).cast("int")), F.lit(0))).otherwise(F.lit(0))
            found = found.withColumn("shift_", shift).drop("q_", "ref_")
            shift = F.col("shift_")
        first_copy = F.col("lit_len") if self.differential else F.lit(0)
        first_lit = F.lit(0) if self.differential else F.col("copy_len")
        k = lo - F.col("start")
        a, b = F.greatest(k, first_copy), F.least(k + n, first_copy + F.col("copy_len"))
        ra, rb = F.col("target") + a - first_copy, F.col("target") + b - first_copy
        la, lb = F.greatest(k, first_lit), F.least(k + n, first_lit + F.col("lit_len"))

        def piece(q, at, size, position):
            return F.struct(q.cast("long").alias("q"), at.cast("int").alias("k"), size.cast("int").alias("n"), position.cast("long").alias("at"))

        def copied(q):
            r0 = F.greatest(ra, q * CHUNK)
            return piece(q, r0 - q * CHUNK, F.least(rb, (q + 1) * CHUNK) - r0, F.col("start") + first_copy + r0 - F.col("target"))

        none = F.array().cast("array<struct<q:bigint,k:int,n:int,at:bigint>>")
        copies = F.when(b > a, F.transform(F.sequence(F.floor(ra / CHUNK), F.floor((F.greatest(rb, ra + 1) - 1) / CHUNK)), copied)).otherwise(none)
        literals = F.when(lb > la, F.array(piece(elsewhere, la - first_lit, lb - la, F.col("start") + la))).otherwise(none)
        rows = found.withColumn("p_", F.explode(F.concat(copies, literals))).withColumn("q_", F.col("p_.q")).join(chunks, "q_", "left")
        cut = F.slice("ref_", F.col("p_.k") + 1, F.col("p_.n"))
        part = F.when(F.col("q_") < 0, F.slice("lits", F.col("p_.k") + 1, F.col("p_.n"))).otherwise(F.transform(cut, lambda x: x + shift) if self.differential else cut)
        return rows.withColumn("part", part).withColumn("at", F.col("p_.at")).drop("p_", "q_", "ref_", "shift_")

    def symbol_at(self, positions: DataFrame) -> DataFrame:
        """input_id, pos, sym."""
        rows = self._values(self.locate(positions), F.col("pos"), F.lit(1))
        return rows.select("input_id", "pos", F.get("part", F.lit(0)).alias("sym"))

    def extract(self, ranges: DataFrame) -> DataFrame:
        """ranges (input_id, range_id, begin, end) with symbols; ends beyond the input are clamped, empty ranges are left out."""
        asked = ranges.filter("begin < end").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("begin") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))))
        p = self.bucketed().withColumnRenamed("end", "stop")
        found = asked.join(p, ["input_id", "bucket"]).filter((F.col("start") < F.col("end")) & (F.col("stop") > F.col("begin")))
        # A pair that shares several buckets counts in the first of them.
        found = found.filter(F.col("bucket") == F.greatest(F.floor(F.col("begin") / BUCKET), F.floor(F.col("start") / BUCKET)))
        lo = F.greatest("begin", "start")
        rows = self._values(found.withColumn("lo", lo), F.col("lo"), F.least("end", "stop") - F.col("lo"))
        return rows.groupBy("input_id", "range_id").agg(in_order("at").alias("symbols"))

    def extract_fast(self, ranges: DataFrame) -> DataFrame:
        """The ranges that lie in one copy, by the reference alone; literals are not read."""
        at = ranges.filter("begin < end").withColumn("pos", F.col("begin"))
        found = self.locate(at.withColumnRenamed("end", "stop"))
        offset = F.lit(0) if not self.differential else F.col("lit_len")
        found = found.filter((F.col("begin") >= F.col("start") + offset) & (F.col("stop") <= F.col("start") + offset + F.col("copy_len")))
        rows = self._values(found, F.col("begin"), F.col("stop") - F.col("begin"))
        return rows.groupBy("input_id", "range_id").agg(in_order("at").alias("symbols"))

    def decode_chunks(self) -> DataFrame:
        """input_id, chunk, symbols: the whole inputs, BUCKET symbols to a row, however long they are."""
        lo = F.greatest("start", F.col("bucket") * BUCKET)
        rows = self._values(self.bucketed(), lo, F.least("end", (F.col("bucket") + 1) * BUCKET) - lo)
        return rows.groupBy("input_id", F.col("bucket").alias("chunk")).agg(in_order("at").alias("symbols"))

    def decode(self) -> DataFrame:
        """input_id, symbols: a row per input."""
        rows = self._values(self.phrases, F.col("start"), F.col("copy_len") + F.col("lit_len"))
        return rows.groupBy("input_id").agg(in_order("at").alias("symbols"))

    def check(self, inputs: DataFrame) -> DataFrame:
        """input_id, same, first_mismatch of every input: whether it decodes to itself, else the first position that differs.

        Chunks are compared with chunks, so inputs may be long.
        """
        a = chunked(inputs, "input_id").withColumnRenamed("symbols", "a")
        b = self.decode_chunks().withColumnRenamed("symbols", "b")
        none = F.array().cast("array<bigint>")
        wrong = F.array_position(F.zip_with(F.coalesce("a", none), F.coalesce("b", none), lambda x, y: ~x.eqNullSafe(y)), True)
        found = a.join(b, ["input_id", "chunk"], "full").withColumn("wrong", wrong)
        found = found.select("input_id", F.when(F.col("wrong") > 0, F.col("chunk") * BUCKET + F.col("wrong") - 1).alias("at"))
        empty = inputs.filter(F.size("symbols") <= 0).select("input_id", F.lit(None).cast("long").alias("at"))
        found = found.unionByName(empty).groupBy("input_id").agg(F.min("at").cast("long").alias("first_mismatch"))
        return found.select("input_id", F.col("first_mismatch").isNull().alias("same"), "first_mismatch")

    # Navigation: phrases by number, and what lies around a position.

    def phrase_id(self, positions: DataFrame) -> DataFrame:
        """input_id, pos, subphrase: the phrase of each position."""
        return self.locate(positions).select("input_id", "pos", "subphrase")

    def from_subphrase(self, k: int) -> DataFrame:
        """The phrases from the k-th on: input_id, subphrase, start, pointer, length."""
        length = F.col("copy_len") + F.col("lit_len")
        return self.phrases.filter(F.col("subphrase") >= k).select("input_id", "subphrase", "start", (F.col("block_ptr") + F.col("diff")).alias("pointer"), length.alias("length"))

    def start_subphrase(self, asked: DataFrame) -> DataFrame:
        """input_id, subphrase, start of the asked (input_id, subphrase); the number of phrases stands for the end."""
        end = F.max(F.col("start") + F.col("copy_len") + F.col("lit_len"))
        ends = self.phrases.groupBy("input_id").agg((F.max("subphrase") + 1).alias("subphrase"), end.alias("start"))
        return asked.join(self.phrases.select("input_id", "subphrase", "start").unionByName(ends), ["input_id", "subphrase"])

    def literals(self) -> DataFrame:
        """input_id, subphrase, lit_pos, sym: every literal, by its place among those of the input."""
        rows = self.phrases.select("input_id", "subphrase", "lit_offset", F.posexplode("lits").alias("k", "sym"))
        return rows.select("input_id", "subphrase", (F.col("lit_offset") + F.col("k")).alias("lit_pos"), "sym")

    def around(self, positions: DataFrame) -> DataFrame:
        """input_id, pos, subphrase, begin, end, symbols: the phrase that holds each position, expanded."""
        found = self.locate(positions).withColumnRenamed("end", "stop")
        rows = self._values(found, F.col("start"), F.col("stop") - F.col("start"))
        return rows.groupBy("input_id", "pos", "subphrase", F.col("start").alias("begin"), F.col("stop").alias("end")).agg(in_order("at").alias("symbols"))

    def advance(self, positions: DataFrame) -> DataFrame:
        """positions (input_id, pos, step) with target, the position so many steps on, and sym there; outside its phrase sym is null, as
        an iterator is of one phrase."""
        found = self.locate(positions).withColumn("target_pos", F.col("pos") + F.col("step"))
        inside = (F.col("target_pos") >= F.col("start")) & (F.col("target_pos") < F.col("end"))
        rows = self._values(found.filter(inside), F.col("target_pos"), F.lit(1))
        at = rows.select("input_id", "pos", "step", F.get("part", F.lit(0)).alias("sym"))
        return found.select("input_id", "pos", "step", F.col("target_pos").alias("target")).join(at, ["input_id", "pos", "step"], "left")

    def save(self, path: str) -> None:
        self.phrases.write.mode("overwrite").parquet(f"{path}/phrases")
        self.phrases.sparkSession.createDataFrame([self.config.flat()], "alphabet string, parser string, pointer_bits int, diff_bits int, literal_bits int, copy_cap int, layout string, options string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, reference: DataFrame | None = None, expected: str | None = None) -> Index:
        """The stored index; without a reference its structure can still be analysed."""
        config = IndexConfig.of(spark.read.parquet(f"{path}/meta").first().asDict())
        if expected and expected != config.alphabet:
            raise ValueError(f"the index holds {config.alphabet}, not {expected}")
        if reference is not None:
            validated(reference, config.alphabet)
        return cls(spark.read.parquet(f"{path}/phrases"), reference, config)


def everything(order: str):
    """A window over all rows, for tables of few rows."""
    return W.orderBy(order)


def in_order(key: str):
    """All `part` arrays of a group, joined by the order of key."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(key, "part"))), lambda x: x.part))


def validated(sequences: DataFrame, name: str) -> None:
    """An error if a symbol of sequences (symbols) lies outside the alphabet."""
    a = alphabet(name)
    low, high = (-(1 << a.bits - 1), (1 << a.bits - 1) - 1) if a.signed else (0, min((1 << 63) - 1, (1 << a.bits) - 1))
    least, most = sequences.agg(F.min(F.array_min("symbols")), F.max(F.array_max("symbols"))).first()
    if least is not None and (least < low or most > high):
        raise ValueError(f"symbols from {least} to {most} are not of the alphabet {name}")


def encode(
    inputs: DataFrame, reference: DataFrame, config: IndexConfig = IndexConfig(), matches: DataFrame | None = None, rules: tuple = (), splits: tuple = (), seed: int = 12
) -> Index:
    """The index of inputs (input_id, symbols) against the reference.

    matches: input_id, ptr, len with arrays over all positions, or rows input_id, pos, ptr, len of the positions that match,
    if they are stored already. Without them, a reference of up to AUTOMATON_SYMBOLS symbols is broadcast and matched by
    automaton; for a longer one matches come from a seed join of `seed` symbols. rules and splits: further rules of
    committing.pieces() and in_blocks(), by which phrases are cut and blocks begun.
    """
    alphabet(config.alphabet)
    options, diff = dict(config.options), config.layout == "lit_then_copy"
    if not diff:
        parser(config.parser)
    n = reference_size(reference)
    if diff and n > VALUES:
        raise ValueError(f"a differential index takes references of up to {VALUES} symbols, not {n}")
    if matches is None and n > AUTOMATON_SYMBOLS:
        apart = lambda x: x.withColumn("symbols", F.transform("symbols", lambda v, i: v - F.when(i > 0, F.get("symbols", i - 1)).otherwise(0)))
        if diff and "chunk" in reference.columns:
            raise ValueError("a differential index takes a reference of one row")
        matches = matching.matches_by_seeds(*((apart(inputs), apart(reference)) if diff else (inputs, reference)), seed)
    context, name = inputs.sparkSession.sparkContext, uuid.uuid4().hex
    given = matches is not None
    shared = context.broadcast(reference_symbols(reference, VALUES)) if diff or not given else None

    def run(batches):
        ref = shared.value if shared else None
        for b in batches:
            rows = []
            for row in each_row(b):
                own = row["symbols"] or []
                if given:
                    ptr, lens = row["ptr"] or [], row["len"] or []
                    if "pos" in row:
                        ptr, lens = filled(row["pos"] or [], ptr, lens, len(own))
                else:
                    machine = matching.automaton(name, lambda: differences(ref) if diff else ref)
                    ptr, lens = machine.matches(differences(own) if diff else own)
                if diff:
                    limit = options.get("limit", 1024)
                    events = differential(ptr, lens, own, ref, **{k: v for k, v in options.items() if k != "limit"})
                    found = committed_differences(events, own, ref, config.diff_bits, config.literal_cap, limit)
                else:
                    found = committed(parser(config.parser)(ptr, lens, **options), own, config.diff_bits, config.literal_cap, config.copy_cap, rules, splits)
                rows += [(row["input_id"], *x) for x in found]
                if len(rows) >= AT_ONCE:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    rows = inputs.select("input_id", "symbols")
    if given:
        wide = matching.sparse(matches) if "pos" in matches.columns else matches.select("input_id", "ptr", "len")
        rows = rows.join(wide, "input_id", "left")
    return Index(rows.mapInArrow(run, PHRASES), reference, config)


def each_row(batch: pa.RecordBatch):
    """The rows of a batch as dicts, one at a time, as sequences may be long."""
    return (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of the phrase table as a batch."""
    columns = list(zip(*rows)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def filled(pos: list[int], ptr: list[int], lens: list[int], n: int) -> tuple[list, list]:
    """ptr and len of all n positions from those of the positions that match."""
    all_ptr, all_len = [None] * n, [0] * n
    for i, p, size in zip(pos, ptr, lens):
        all_ptr[i], all_len[i] = p, size
    return all_ptr, all_len


SCHEMA = pa.schema([(n, pa.bool_() if n == "is_block" else pa.list_(pa.int64()) if n == "lits" else pa.int64()) for n in NAMES])


def events_of(wide: DataFrame, name: str, **options) -> DataFrame:
    """input_id, ord, kind, pos, ptr, len: the parse events of matches_wide()."""
    from seqweave.schema import EVENTS

    def run(batches):
        for b in batches:
            out = [(r["input_id"], k, *e) for r in each_row(b.select(["input_id", "ptr", "len"])) for k, e in enumerate(parser(name)(r["ptr"], r["len"], **options))]
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["input_id", "ord", "kind", "pos", "ptr", "len"])

    return wide.select("input_id", "ptr", "len").mapInArrow(run, EVENTS)


def statistics(index: Index, diff_bits: int = 4) -> DataFrame:
    """Per input: length, phrases by kind, literals, and edits that the pointer differences amount to.

    A phrase is absolute if its offset leaves the field of diff_bits around the last absolute one, which starts at zero. Of
    relative ones, a non-negative difference is as many deletions, its literals substitutions; a negative one insertions.
    Averages without relative phrases are null.
    """
    low, high = -(1 << diff_bits - 1), (1 << diff_bits - 1) - 1
    names = ("length", "literals", "absolute", "relative", "ins", "dels", "subs", "moved")

    def fold(batches):
        key, last, t = None, 0, None
        for b in batches:
            done = []
            for own, start, copy, lit, target in zip(*(b.column(k).to_pylist() for k in range(5))):
                if t is None or own != key:
                    if t:
                        done.append((key, t))
                    key, last, t = own, 0, dict.fromkeys(names, 0)
                t["length"] += copy + lit
                t["literals"] += lit
                d = target - start - last
                if low <= d <= high:
                    t["relative"] += 1
                    t["moved"] += abs(d)
                    t["subs"] += lit if d >= 0 else max(lit + d, 0)
                    t["dels" if d >= 0 else "ins"] += abs(d)
                else:
                    t["absolute"] += 1
                    last += d
            yield out(done)
        if t:
            yield out([(key, t)])

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), *(pa.array([t[c] for _, t in done], pa.int64()) for c in names)], ["input_id", *names])

    # One task sees an input's phrases in order, a batch at a time.
    streamed = index.phrases.select("input_id", "start", "copy_len", "lit_len", "target").repartition("input_id").sortWithinPartitions("input_id", "start")
    t = streamed.mapInArrow(fold, "input_id long, " + ", ".join(f"{c} long" for c in names))
    total = F.col("absolute") + F.col("relative")
    each = lambda c: F.try_divide(F.col(c), F.col("relative"))
    return t.select("input_id", "length", "absolute", "relative", total.alias("total"), "literals", F.try_divide("literals", total).alias("literals_per_phrase"), each("moved").alias("avg_difference"), each("ins").alias("avg_insertions"), each("dels").alias("avg_deletions"), each("subs").alias("avg_substitutions"))


def space(index: Index) -> DataFrame:
    """component, bits: what each part of the index costs, and the whole."""
    c = index.config
    bits = alphabet(c.alphabet).bits
    p = index.phrases.agg(F.count("*").alias("n"), F.sum(F.col("is_block").cast("long")).alias("b"), F.sum("lit_len").alias("l"))
    parts = F.array(*[F.struct(F.lit(k).alias("component"), v.cast("long").alias("bits")) for k, v in (
        ("boundaries", F.col("n") * 2), ("differences", (F.col("n") - F.col("b")) * c.diff_bits), ("literal_lengths", F.col("n") * c.literal_bits),
        ("literals", F.col("l") * bits), ("pointers", F.col("b") * c.pointer_bits),
        ("total", F.col("n") * (2 + c.diff_bits + c.literal_bits) + F.col("b") * (c.pointer_bits - c.diff_bits) + F.col("l") * bits),
    )])
    return p.select(F.inline(parts))


def size_tree(index: Index) -> DataFrame:
    """json: the components of space() as a tree."""
    parts = F.sort_array(F.collect_list(F.struct("component", "bits")))
    tree = F.struct(F.lit("index").alias("name"), F.sum(F.when(F.col("component") == "total", F.col("bits"))).alias("bits"), F.filter(parts, lambda x: x.component != "total").alias("children"))
    return space(index).agg(F.to_json(tree).alias("json"))


def size_page(index: Index) -> DataFrame:
    """html: the components of space() as a nested list."""
    parts = F.sort_array(F.collect_list(F.struct("component", "bits")))
    item = lambda x: F.concat(F.lit("<li>"), x.component, F.lit(": "), x.bits.cast("string"), F.lit(" bits</li>"))
    items = F.array_join(F.transform(F.filter(parts, lambda x: x.component != "total"), item), "")
    total = F.sum(F.when(F.col("component") == "total", F.col("bits"))).cast("string")
    return space(index).agg(F.concat(F.lit("<ul><li>index: "), total, F.lit(" bits<ul>"), items, F.lit("</ul></li></ul>")).alias("html"))
