import random

import pytest

from seqweave.functions import bits, symbols
from seqweave.operators import committing, index, matching, parsing, suffixes
from seqweave.plans import strategies
from seqweave.schema import IndexConfig, alphabet


def brute(ref, s):
    out = []
    for i in range(len(s)):
        best = (None, 0)
        for p in range(len(ref)):
            k = 0
            while i + k < len(s) and p + k < len(ref) and s[i + k] == ref[p + k]:
                k += 1
            if k > best[1]:
                best = (p, k)
        out.append(best)
    return out


def dna(rng, n):
    return [rng.choice([65, 67, 71, 84]) for _ in range(n)]


def mutated(rng, x):
    x = list(x)
    for _ in range(max(1, len(x) // 30)):
        at, kind = rng.randrange(len(x) + 1), rng.random()
        if kind < 0.3:
            x[at : at + 1] = []
        elif kind < 0.6:
            x[at:at] = dna(rng, 1)
        else:
            x[at : at + 1] = dna(rng, 1)
    return x


@pytest.mark.parametrize("seed", range(5))
def test_automaton_is_leftmost_longest(seed):
    rng = random.Random(seed)
    ref, s = dna(rng, 60), dna(rng, 50)
    ptr, lens = matching.Automaton(ref).matches(s)
    assert list(zip(ptr, lens)) == brute(ref, s)


def test_classic_golden():
    m = [(0, 0), (4, 5), (5, 4), (6, 3), (7, 2), (8, 1), (0, 7), (1, 6), (2, 5), (3, 4), (4, 3), (5, 2), (6, 1), (0, 0), (0, 0), (0, 0), (3, 1)]
    events = parsing.classic(*zip(*m))
    assert events == [("L", 0, None, 1), ("C", 1, 4, 5), ("L", 6, None, 1), ("C", 7, 1, 6), ("L", 13, None, 1), ("L", 14, None, 1), ("L", 15, None, 1), ("L", 16, None, 1)]


def test_adaptive_golden():
    m = [(p + k, n - k) for p, n in ((100, 4), (30, 6), (150, 5), (40, 3), (53, 8)) for k in range(n)]
    events = parsing.adaptive(*zip(*m), **parsing.automatic(4, 16, 2))
    assert events == [("L", 0, None, 4), ("C", 4, 30, 6), ("L", 10, None, 5), ("C", 15, 40, 3), ("C", 18, 53, 8)]


def event(kind, pos, ptr, n):
    return kind, pos, ptr, n


def test_commit_with_rules_golden():
    events = [event(*e) for e in (("C", 0, 0, 3), ("C", 3, 3, 6), ("L", 9, None, 20), ("C", 29, 5, 6), ("C", 35, 8, 6), ("C", 41, 13, 3), ("C", 44, 100, 20), ("L", 64, None, 12))]
    found = list(committing.in_blocks(committing.pieces(events, [committing.literal_cap(8), committing.copy_cap(10)]), -8, 8))
    assert [(p.start, p.target, p.copy_len, p.lit_len) for p in found if p.copy_len] == [(0, 0, 3, 0), (3, 3, 6, 8), (29, 5, 6, 0), (35, 8, 6, 0), (41, 13, 3, 0), (44, 100, 10, 0), (54, 110, 10, 8)]
    assert [p.lit_len for p in found if not p.copy_len] == [8, 4, 4]
    assert [p.start for p in found if p.block] == [0, 29, 44]


def test_phrase_store_golden():
    events = [("C", 0, 0, 30), ("L", 30, None, 20), ("C", 50, 57, 20), ("C", 70, 62, 20), ("L", 90, None, 10), ("C", 100, 90, 10), ("C", 110, 102, 10), ("C", 120, 120, 10), ("L", 130, None, 20)]
    rows = committing.committed(events, [0] * 150, 4, 255)
    assert [(r[1], r[2], r[3] + r[4], r[8] + r[9]) for r in rows] == [(0, 0, 50, 0), (0, 50, 20, 7), (0, 70, 30, -8), (1, 100, 10, -10), (1, 110, 10, -8), (2, 120, 30, 0)]
    capped = committing.committed(events, [0] * 150, 4, 15)
    assert [r[4] for r in capped] == [15, 5, 0, 10, 0, 0, 15, 5]


@pytest.mark.parametrize("name", ["classic", "threshold", "automatic", "parametric"])
def test_round_trip_and_ranges(spark, name):
    rng = random.Random(3)
    ref = dna(rng, 300)
    inputs = [(k, mutated(rng, ref)) for k in range(4)] + [(9, []), (10, [1, 2, 3])]
    df, r = spark.createDataFrame(inputs, "input_id long, symbols array<bigint>"), spark.createDataFrame([(ref,)], "symbols array<bigint>")
    i = index.encode(df, r, strategies.config(name))
    assert all(x.same for x in i.check(df).collect())
    spans = [(k, n, b, b + n % 40) for k, s in inputs[:2] for n, b in enumerate(range(0, len(s) - 40, 7))]
    got = {(x.input_id, x.range_id): x.symbols for x in i.extract(spark.createDataFrame(spans, "input_id long, range_id long, begin long, end long")).collect()}
    assert got == {(k, n): dict(inputs)[k][b:e] for k, n, b, e in spans if b < e}
    assert {x.input_id: x.n for x in i.size().collect()} == {k: len(s) for k, s in inputs if s}


@pytest.mark.parametrize("seed", range(6))
def test_differences_are_lossless(seed):
    rng = random.Random(seed)
    ref = [rng.randrange(30) for _ in range(200)]
    own = [v + 5 for v in ref[40:120]] + ref[10:60] + [rng.randrange(30) for _ in range(10)]
    if seed == 5:
        ref, own = list(range(300)), list(range(1, 301))
    machine = matching.Automaton(index.differences(ref))
    events = parsing.differential(*machine.matches(index.differences(own)), own, ref)
    rows = committing.committed_differences(events, own, ref, 4, 3, 32)
    out, length = [], {}
    for _, phrase, start, copy, lits, target, *_, values in rows:
        assert start == len(out)
        out += values
        shift = (values[-1] - (ref[target - 1] if target else 0)) if lits and copy else 0
        out += [v + shift for v in ref[target : target + copy]]
        length[phrase] = length.get(phrase, 0) + lits + copy
    assert out == own and max(length.values()) <= 32


def test_store_and_errors(spark, tmp_path):
    df, r = spark.createDataFrame([(1, [1, 2, 3, 1, 2])], "input_id long, symbols array<bigint>"), spark.createDataFrame([([1, 2, 3],)], "symbols array<bigint>")
    i = index.encode(df, r, IndexConfig(parser="classic", diff_bits=0))
    i.save(str(tmp_path))
    again = index.Index.load(spark, str(tmp_path))
    assert again.config == i.config and again.size().first().n == 5
    with pytest.raises(ValueError, match="no reference"):
        again.decode()
    with pytest.raises(ValueError, match="holds text"):
        index.Index.load(spark, str(tmp_path), r, "dna")
    with pytest.raises(ValueError, match="unknown alphabet"):
        alphabet("x")
    with pytest.raises(ValueError, match="unknown parser"):
        parsing.parser("x")


def test_bits(spark):
    ones = {2**k for k in range(12)}
    b = spark.createDataFrame([(0, p, int(p in ones)) for p in range(4096)], "vec_id long, pos long, bit int")
    assert {r.k: r.pos for r in bits.select1(b).collect()} == {k + 1: 2**k for k in range(12)}
    assert {r.pos: r.rank1 for r in bits.rank1(b).collect()} == {p: sum(o < p for o in ones) for p in range(4096)}


def test_symbols(spark):
    from pyspark.sql import functions as F

    x = spark.createDataFrame([([4, 8, 9, 15],)], "x array<bigint>")
    assert x.select(symbols.difference(F.col("x"))).first()[0] == [4, 4, 1, 6]
    v = spark.createDataFrame([([-100, 20, -10, 0, -129, -128, -127, 125, 126, 127, 128, 255, 256],)], "x array<bigint>")
    p = v.select(symbols.escape_pack(F.col("x"), -128, 127).alias("p"))
    assert p.select(symbols.escape_unpack(F.col("p"), 127)).first()[0] == v.first()[0]


def test_suffix_array(spark):
    s = [ord(c) for c in "mississippi"]
    df = spark.createDataFrame([(1, s)], "input_id long, symbols array<bigint>")
    want = sorted(range(len(s)), key=lambda i: s[i:])
    assert [r.pos for r in suffixes.suffix_array(df, 11).orderBy("rank").collect()] == want


def test_streaming_encode(spark, tmp_path):
    from seqweave.streaming.encode import encode_stream

    df, r = spark.createDataFrame([(1, [1, 2, 3, 1, 2])], "input_id long, symbols array<bigint>"), spark.createDataFrame([([1, 2, 3],)], "symbols array<bigint>")
    df.write.parquet(str(tmp_path / "in"))
    q = encode_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), r, IndexConfig(parser="classic"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    i = index.Index(spark.read.parquet(str(tmp_path / "out")), r, IndexConfig(parser="classic"))
    assert i.decode().first().symbols == [1, 2, 3, 1, 2]


def test_binary_files(spark, tmp_path):
    import numpy as np

    from seqweave.sources import files

    (tmp_path / "x.bin").write_bytes(np.array([5, -1, 7], "<i4").tobytes() + b"\x01")
    assert files.read_binary(spark, str(tmp_path / "x.bin")).first().symbols == [5, -1, 7]
    (tmp_path / "m.bin").write_bytes(np.array([3, 0, 1, 2, 3, 2**64 - 1, 0], "<u8").tobytes())
    assert [(r.ptr, r.len) for r in files.read_matches(spark, str(tmp_path / "m.bin")).orderBy("pos").collect()] == [(0, 1), (2, 3), (None, 0)]


def test_rules_and_splits():
    events = [event(*e) for e in (("C", 0, 0, 25), ("L", 25, None, 5), ("C", 30, 30, 4))]
    rows = committing.committed(events, [0] * 34, more=[lambda s, t, c, n: (min(c, 10), n)], also=[lambda pointer, p: p.lit_len > 4])
    assert [(r[2], r[3], r[4], r[7]) for r in rows] == [(0, 10, 0, True), (10, 10, 0, False), (20, 5, 5, True), (30, 4, 0, False)]


def test_large_reference(spark):
    """A reference of two million symbols, in chunks, with matches by seeds: build, extract, check."""
    from pyspark.sql import functions as F

    n = 1 << 21
    chunks = spark.range(n >> 14).select(F.col("id").alias("chunk"), F.expr("transform(sequence(0, 16383), i -> 65 + pmod(xxhash64(id * 16384 + i), 20))").alias("symbols"))
    chunks = chunks.withColumn("symbols", F.col("symbols").cast("array<bigint>"))
    ref = [x for r in chunks.orderBy("chunk").collect() for x in r.symbols]
    rng = random.Random(4)
    inputs = [(k, ref[at : at + 5000] + [7] * k + ref[at + 5003 : at + 9000]) for k, at in enumerate(rng.randrange(n - 10_000) for _ in range(6))] + [(9, [])]
    df = spark.createDataFrame(inputs, "input_id long, symbols array<bigint>")
    i = index.encode(df, chunks, strategies.config("automatic"))
    assert all(r.same for r in i.check(df).collect()) and i.phrases.count() < 60
    wrong = df.withColumn("symbols", F.transform("symbols", lambda x, k: F.when((k == 7000) & (F.col("input_id") == 2), -1).otherwise(x)))
    assert {r.input_id: r.first_mismatch for r in i.check(wrong).collect()} == {k: 7000 if k == 2 else None for k, _ in inputs}
    spans = [(k, j, b, b + 1500) for k, s in inputs[:6] for j, b in enumerate(range(0, len(s), 1200))]
    got = {(r.input_id, r.range_id): r.symbols for r in i.extract(spark.createDataFrame(spans, "input_id long, range_id long, begin long, end long")).collect()}
    assert got == {(k, j): dict(inputs)[k][b:e] for k, j, b, e in spans}


def test_validation(spark):
    r = spark.createDataFrame([([1, 2, 300],)], "symbols array<bigint>")
    df = spark.createDataFrame([(1, [1, 2, 3, 1, 2]), (2, None), (3, [])], "input_id long, symbols array<bigint>")
    i = index.encode(df, r, IndexConfig(alphabet="int8", parser="classic"))
    with pytest.raises(ValueError, match="not of the alphabet int8"):
        i.with_reference(r)
    with pytest.raises(ValueError, match="one sequence"):
        index.encode(df, r.union(r), IndexConfig(parser="classic"))
    assert {x.input_id: x.n for x in i.size().collect()} == {1: 5}
    assert i.check(df.filter("input_id <> 2")).count() == 2 and index.encode(df.limit(0), r, IndexConfig(parser="classic")).decode().count() == 0


def test_product_of_settings():
    found = strategies.combinations(parser=["classic", "threshold"], diff_bits=[2, 4])
    assert [(c.parser, c.diff_bits) for c in found] == [("classic", 2), ("classic", 4), ("threshold", 2), ("threshold", 4)]


def test_tools(spark, tmp_path, capsys):
    import numpy as np

    from seqweave import __main__ as tools

    rng = np.random.default_rng(2)
    ref = rng.integers(0, 50, 3000)
    own = np.r_[ref[100:900], 7, 7, ref[2000:2600]]
    ref.astype("<u4").tofile(tmp_path / "ref")
    own.astype("<u4").tofile(tmp_path / "in")
    p = {k: str(tmp_path / k) for k in ("ref", "in", "ix", "out", "ms")}
    assert tools.main(["build", "--input", p["in"], "--reference", p["ref"], "--output", p["ix"]]) == 0
    at = ["--index", p["ix"], "--reference", p["ref"]]
    assert tools.main(["decompress", *at, "--output", p["out"]]) == 0
    assert (np.fromfile(p["out"], "<u4") == own).all()
    assert tools.main(["check", *at, "--input", p["in"]]) == 0 and tools.main(["check", *at, "--input", p["ref"]]) == 1
    capsys.readouterr()
    tools.main(["extract", *at, "--start", "798", "--end", "804"])
    assert capsys.readouterr().out.split() == [str(x) for x in own[798:804]]
    for tool in (["stats", *at], ["parsing", *at], ["space", "--index", p["ix"]], ["space", "--index", p["ix"], "--html"], ["benchmark", *at, "--times", "20"]):
        assert tools.main(tool) == 0 and capsys.readouterr().out
    assert tools.main(["matches", "--input", p["in"], "--reference", p["ref"], "--output", p["ms"]]) == 0
    assert tools.main(["build", "--input", p["in"], "--reference", p["ref"], "--output", p["ix"] + "2", "--matches", p["ms"], "--parser", "classic"]) == 0
    assert tools.main(["check", "--index", p["ix"] + "2", "--reference", p["ref"], "--input", p["in"]]) == 0


def test_zero_tail(spark, tmp_path):
    from seqweave.sources import files

    (tmp_path / "x.bin").write_bytes(bytes([5, 0, 7, 0, 1]))
    assert files.read_binary(spark, str(tmp_path / "x.bin"), "<u2", extra=3).first().symbols == [5, 7, 0, 0, 0]
    with pytest.raises(Exception, match="within a symbol"):
        files.read_binary(spark, str(tmp_path / "x.bin"), "<u2", strict=True).collect()


def test_bits_with_nulls(spark):
    rows = [(1, 0, 1, "x"), (1, 1, None, "x"), (1, 2, 1, "x"), (None, 0, 1, "y"), (None, 1, 1, "y"), (1, None, 1, "z")]
    b = spark.createDataFrame(rows, "vec_id long, pos long, bit int, extra string")
    got = {(r.vec_id, r.pos): (r.rank1, r.rank0, r.extra) for r in bits.rank1(b).collect()}
    assert got == {(1, 0): (0, 0, "x"), (1, 1): (1, 0, "x"), (1, 2): (1, 1, "x"), (None, 0): (0, 0, "y"), (None, 1): (1, 0, "y")}
    assert {(r.vec_id, r.k, r.pos) for r in bits.select1(b).collect()} == {(1, 1, 0), (1, 2, 2), (None, 1, 0), (None, 2, 1)}
    assert {(r.vec_id, r.word, r.value) for r in bits.words(b).collect()} == {(1, 0, 5), (None, 0, 3)}
    assert bits.rank1(b.limit(0)).count() == bits.select1(b.limit(0)).count() == bits.words(b.limit(0)).count() == 0


def test_long_arrays_of_escapes_and_markers(spark):
    """Linear work: each value an exception, each letter an N."""
    n = 60_000
    rows = [(0, list(range(1000, 1000 + n)), "N" * n), (1, [], ""), (2, None, None), (3, [1, None, 900], "ANT"), (4, [7], "G")]
    df = spark.createDataFrame(rows, "k long, x array<bigint>, t string")
    got = {r.k: r for r in df.select("k", "x", "t", symbols.escape_unpack(symbols.escape_pack(symbols.F.col("x"), 0, 255), 255).alias("y"), symbols.dna_letters(symbols.dna_codes(symbols.F.col("t")), symbols.n_positions(symbols.F.col("t"))).alias("u")).collect()}
    for k in (0, 1, 2, 4):
        assert got[k].y == got[k].x and got[k].u == got[k].t
    assert got[3].y == [1, None, 900] and got[3].u == "ANT"


def test_escapes_and_markers_of_many_rows_are_filled_at_once(spark):
    """Python's calls grow with batches, not with rows."""

    def calls(n: int, made) -> int:
        spark.profile.clear()
        spark.conf.set("spark.sql.pyspark.udf.profiler", "perf")
        try:
            spark.range(0, n, 1, 1).select(made).write.format("noop").mode("overwrite").save()
            return sum(s.total_calls for s in spark._profiler_collector._perf_profile_results.values())
        finally:
            spark.conf.unset("spark.sql.pyspark.udf.profiler")
            spark.profile.clear()

    F = symbols.F
    x = F.array(F.col("id"), F.lit(900).cast("long"), F.lit(None).cast("long"))
    for made in (symbols.escape_unpack(symbols.escape_pack(x, 0, 255), 255), symbols.dna_letters(F.array(F.col("id") % 4), F.array(F.lit(0).cast("long")))):
        few, many = calls(10, made), calls(2000, made)
        assert 0 < few and many < few + 2000, (few, many)


def test_escapes_by_row(spark):
    """Each row's exceptions stay in it; nulls, the last exception of a place and values beyond the doubles' integers are kept."""
    rows = [
        (0, ([9, None, 9, 9], [(0, 2**63 - 1), (2, -(2**63)), (3, None)]), [2**63 - 1, None, -(2**63), None]), (1, None, None), (2, (None, [(0, 5)]), None),
        (3, ([], []), []), (4, ([9, 1], None), [None, 1]), (5, ([9, 1, 9], [(2, 7), (0, 3), (2, 8)]), [3, 1, 8]), (6, ([1, 2], [(0, 2**53 + 1)]), [2**53 + 1, 2]),
    ]
    kind = "k long, p struct<small array<bigint>, exceptions array<struct<idx bigint, value bigint>>>"
    df = spark.createDataFrame([r[:2] for r in rows], kind).coalesce(1)
    assert {r.k: r.y for r in df.select("k", symbols.escape_unpack(symbols.F.col("p"), 9).alias("y")).collect()} == {k: y for k, _, y in rows}
    beyond = spark.createDataFrame([(0, ([9], [(1, 5)])), (1, ([9], []))], kind).coalesce(1)
    with pytest.raises(Exception, match="outside its list"):
        beyond.select(symbols.escape_unpack(symbols.F.col("p"), 9)).collect()
