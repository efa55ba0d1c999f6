"""Command line: python -m seqweave TOOL ... builds, reads and checks indexes stored in a folder."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.symbols import render
from seqweave.operators import index as I
from seqweave.operators import matching
from seqweave.plans import strategies
from seqweave.schema import ALPHABETS
from seqweave.sources import files


def arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="python -m seqweave", description=__doc__)
    tools = top.add_subparsers(dest="tool", required=True)

    def tool(name: str, about: str, *needs: str) -> argparse.ArgumentParser:
        p = tools.add_parser(name, help=about)
        for x in needs:
            p.add_argument(f"--{x}", required=True)
        return p

    build = tool("build", "encode files against a reference", "input", "reference", "output")
    build.add_argument("--alphabet", default="lcp32", choices=sorted(ALPHABETS))
    build.add_argument("--parser", default="parametric", choices=["classic", "threshold", "automatic", "parametric", "differential"])
    build.add_argument("--look-ahead", type=int, default=30)
    build.add_argument("--explicit-len", type=int, default=15)
    build.add_argument("--delta-bits", type=int, default=8)
    build.add_argument("--explicit-bits", type=int, default=32)
    build.add_argument("--matches", help="a match file of the one input")
    out = tool("decompress", "write one input back to a file", "index", "reference", "output")
    out.add_argument("--input-id", type=int, default=0)
    part = tool("extract", "print a range of one input", "index", "reference")
    part.add_argument("--input-id", type=int, default=0)
    part.add_argument("--start", type=int, default=0)
    part.add_argument("--end", type=int, default=(1 << 62))
    tool("check", "compare an index with the files; exit status 1 if they differ", "input", "reference", "index")
    tool("stats", "print what phrases there are", "index", "reference")
    dump = tool("matches", "write the matches of a file", "input", "reference", "output")
    dump.add_argument("--alphabet", default="lcp32", choices=sorted(ALPHABETS))
    tool("parsing", "print the phrases", "index", "reference")
    space = tool("space", "print what the parts of an index cost", "index")
    space.add_argument("--html", action="store_true")
    bench = tool("benchmark", "time random extractions", "index", "reference")
    bench.add_argument("--length", type=int, default=64)
    bench.add_argument("--times", type=int, default=1000)
    return top.parse_args(argv)


def loaded(spark: SparkSession, a: argparse.Namespace) -> I.Index:
    index = I.Index.load(spark, a.index)
    return index.with_reference(files.read_reference(spark, a.reference, index.config.alphabet))


def random_ranges(index: I.Index, length: int, times: int, seed: int = 42) -> DataFrame:
    """input_id, range_id, begin, end: ranges of one length at random places of random inputs."""
    sizes = index.size().filter(F.col("n") >= length)
    n = sizes.count()
    asked = index.phrases.sparkSession.range(times).select(F.col("id").alias("range_id"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n))).alias("k_"))
    numbered = sizes.select("input_id", "n", (F.row_number().over(I.everything("input_id")) - 1).cast("long").alias("k_"))  # a row per input
    rows = asked.join(numbered, "k_")
    begin = F.pmod(F.xxhash64("range_id", F.lit(seed + 1)), F.col("n") - length + 1)
    return rows.select("input_id", "range_id", begin.alias("begin"), (begin + length).alias("end"))


def run(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.tool == "build":
        widths = {"rel_bits": a.delta_bits, "abs_bits": a.explicit_bits} if a.parser in ("automatic", "parametric") else {}
        if a.parser == "parametric":
            widths |= {"look_ahead": a.look_ahead, "explicit": a.explicit_len}
        config = strategies.config(a.parser, a.alphabet, **widths)
        inputs = files.read_inputs(spark, a.input, a.alphabet)
        found = files.read_matches(spark, a.matches).select(F.lit(0).cast("long").alias("input_id"), "pos", "ptr", "len").filter("len > 0") if a.matches else None
        I.encode(inputs, files.read_reference(spark, a.reference, a.alphabet), config, found).save(a.output)
        I.space(I.Index.load(spark, a.output)).show(truncate=False)
    elif a.tool == "decompress":
        index = loaded(spark, a)
        print(files.write_binary(index.decode_chunks().filter(F.col("input_id") == a.input_id), a.output, index.config.alphabet), "symbols")
    elif a.tool == "extract":
        index = loaded(spark, a)
        asked = index.size().filter(F.col("input_id") == a.input_id)
        asked = asked.select("input_id", F.lit(0).cast("long").alias("range_id"), F.least(F.lit(a.start), "n").alias("begin"), F.least(F.lit(a.end), "n").alias("end"))
        rows = index.extract(asked).select(render(F.col("symbols"), files.dtype_of(index.config.alphabet) is None)).collect()
        print(rows[0][0] if rows else "")
    elif a.tool == "check":
        index = loaded(spark, a)
        wrong = index.check(files.read_inputs(spark, a.input, index.config.alphabet)).filter("not same").orderBy("input_id").collect()
        for r in wrong:
            print(f"input {r.input_id} differs at {r.first_mismatch}")
        return int(bool(wrong))
    elif a.tool == "stats":
        I.statistics(loaded(spark, a)).orderBy("input_id").show(1000, truncate=False)
    elif a.tool == "matches":
        ref = files.read_reference(spark, a.reference, a.alphabet)
        inputs = files.read_inputs(spark, a.input, a.alphabet)
        print(files.write_matches(matching.matches_long(matching.matches_wide(inputs, matching.reference_symbols(ref))), a.output), "positions")
    elif a.tool == "parsing":
        for r in loaded(spark, a).walk().orderBy("input_id", "subphrase").toLocalIterator():
            print(r.offset, r.copy_len, r.lit_len)
    elif a.tool == "space":
        index = I.Index.load(spark, a.index)
        print((I.size_page if a.html else I.size_tree)(index).first()[0])
    elif a.tool == "benchmark":
        index = loaded(spark, a)
        index = I.Index(index.phrases.cache(), index.reference, index.config)
        asked = random_ranges(index, a.length, a.times).cache()
        n, began = asked.count(), time.time()
        index.extract(asked).write.format("noop").mode("overwrite").save()
        print(f"average time = {int((time.time() - began) / max(1, n) * 1e9)} ns, length = {a.length}, repetitions = {n}")
    return 0


def main(argv: list[str] | None = None) -> int:
    return run(arguments(argv), SparkSession.builder.appName("seqweave").getOrCreate())


if __name__ == "__main__":
    sys.exit(main())
