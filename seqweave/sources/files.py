"""Sequences and matches in files: flat binary arrays, text, Parquet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqweave.schema import alphabet

#: Symbols in a row of a long sequence, and the pointer of a position without a match in a match file.
CHUNK, NO_MATCH = 1 << 22, (1 << 64) - 1


def read_binary(spark: SparkSession, path: str, dtype: str = "<i4", strict: bool = False, extra: int = 0) -> DataFrame:
    """path, chunk, symbols: little-endian arrays, CHUNK symbols to a row, with `extra` zeros behind each file's end.

    A trailing part of a symbol is dropped, or an error; an empty file is one empty row.
    """
    width = np.dtype(dtype).itemsize

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if strict and len(raw) % width:
                    raise ValueError(f"{name} ends within a symbol")
                x = np.frombuffer(raw[: len(raw) // width * width], dtype).astype(np.int64)
                x = np.r_[x, np.zeros(extra, np.int64)] if extra else x
                for at in range(0, max(1, len(x)), CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at // CHUNK], pa.int64()), pa.array([x[at : at + CHUNK]], pa.list_(pa.int64()))], ["path", "chunk", "symbols"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, chunk long, symbols array<bigint>")


def dtype_of(name: str) -> str | None:
    """How symbols of an alphabet lie in a binary file; None for text."""
    a = alphabet(name)
    return None if a.name in ("dna", "text") else f"<{'i' if a.signed else 'u'}{a.bits // 8}"


def read_inputs(spark: SparkSession, path: str, name: str = "text") -> DataFrame:
    """input_id, path, symbols: files of an alphabet, one row each, numbered from 0 by the order of their paths."""
    dtype = dtype_of(name)
    if dtype is None:
        rows = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))
        rows = rows.select("path", F.when(F.length("text") > 0, F.transform(F.split("text", ""), lambda c: F.ascii(c).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("symbols"))
    else:
        parts = F.sort_array(F.collect_list(F.struct("chunk", "symbols")))
        rows = read_binary(spark, path, dtype).groupBy("path").agg(F.flatten(parts["symbols"]).alias("symbols"))
    order = rows.select("path").withColumn("input_id", (F.row_number().over(W.orderBy("path")) - 1).cast("long"))  # a row per file
    return rows.join(order, "path").select("input_id", "path", "symbols")


def read_reference(spark: SparkSession, path: str, name: str = "text") -> DataFrame:
    """A reference from one file: one row of text, or chunks of numbers."""
    dtype = dtype_of(name)
    return read_inputs(spark, path, name).select("symbols") if dtype is None else read_binary(spark, path, dtype).select("chunk", "symbols")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """line, symbols: one sequence of numbers to a line."""
    return spark.read.text(path).select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("long")).alias("symbols"))


def write_sequences(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """pos, ptr, len of a match file: a count of eight bytes, then pairs of eight-byte numbers. No match is null."""

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = int(np.frombuffer(raw, "<u8", 1)[0])
                x = np.frombuffer(raw, "<u8", 2 * n, 8).reshape(n, 2)
                ptr = pa.array([int(p) if k else None for p, k in x], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n)), ptr, pa.array(x[:, 1].astype(np.int64))], ["path", "pos", "ptr", "len"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos long, ptr long, len long")


def write_binary(chunks: DataFrame, path: str, name: str = "text") -> int:
    """Writes the symbols of one input (chunk, symbols) to a local file, a chunk at a time; returns how many there were."""
    dtype, total = dtype_of(name), 0
    with open(path, "wb") as f:
        for r in chunks.orderBy("chunk").select("symbols").toLocalIterator():
            f.write("".join(map(chr, r[0])).encode() if dtype is None else np.asarray(r[0], np.int64).astype(dtype).tobytes())
            total += len(r[0])
    return total


def write_matches(matches: DataFrame, path: str) -> int:
    """Writes one input's matches (pos, ptr, len) of all positions to a local match file, the format of read_matches()."""
    n = matches.count()
    with open(path, "wb") as f:
        f.write(np.array([n], "<u8").tobytes())
        for r in matches.orderBy("pos").select("ptr", "len").toLocalIterator():
            f.write(np.array([NO_MATCH if r.ptr is None else r.ptr, r.len], "<u8").tobytes())
    return n
