"""Symbols of sequences: differences, alphabets, and packing, as column functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def difference(x: Column) -> Column:
    """First differences of an array; the first element stays."""
    return F.transform(x, lambda v, i: v - F.when(i > 0, F.get(x, i - 1)).otherwise(F.lit(0)))


def undo_difference(x: Column) -> Column:
    """Running sums of an array, in one pass over it; nulls stay null and add nothing."""

    @F.pandas_udf("array<bigint>")
    def sums(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.cumsum(np.asarray(v, np.int64)))

    return sums(x)


def difference_rows(key: str, order: list[str], value: str) -> Column:
    """First differences over rows."""
    return F.col(value) - F.coalesce(F.lag(value).over(W.partitionBy(key).orderBy(*order)), F.lit(0))


def to_signed(v: Column, bits: int) -> Column:
    """v cut to a two's complement field of so many bits."""
    u = F.pmod(v, F.lit(1 << bits))
    return F.when(u >= 1 << (bits - 1), u - (1 << bits)).otherwise(u)


def retarget(pos: Column, pointer: Column, n: Column, bits: int) -> Column:
    """The place in a reference of n symbols that a cut pointer means at pos: the sum, or that of the other reading."""
    t = pos + pointer
    return F.when((t >= 0) & (t <= n), t).when(t < 0, t + (1 << bits)).otherwise(t - (1 << bits))


def is_relative(expected: Column, target: Column, bits: int) -> Column:
    """Whether a copy's target is near enough to the expected one for a short pointer."""
    d = target - expected
    return (d > -(1 << bits) - 1) & (d < 1 << bits)


#: Codes of the letters, fixed values; N is kept as a marker.
DNA = {"A": 0, "C": 1, "G": 3, "T": 2}


def dna_codes(text: Column) -> Column:
    """Two-bit codes of a DNA string; other letters than A C G T N raise an error, N has code 0."""
    bad = F.regexp_extract(text, "[^ACGTN]", 0)
    ok = F.when(bad != "", F.raise_error(F.concat(F.lit("not a DNA letter: "), bad))).otherwise(F.translate(text, "ACGTN", "01320"))
    return F.transform(F.filter(F.split(ok, ""), lambda c: c != ""), lambda c: c.cast("long"))


def n_positions(text: Column) -> Column:
    letters = F.split(text, "")
    return F.filter(F.transform(letters, lambda c, i: F.when(c == "N", i.cast("long"))), lambda i: i.isNotNull())


def once(value: Column, f) -> Column:
    """f(value), with value computed once and not for each element of a lambda in f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def pack(x: Column, bits: int) -> Column:
    """Words of 32 bits that hold an array's values, cut to so many bits, the first lowest."""
    return once(x, lambda x: _packed(x, bits))


def _packed(x: Column, bits: int) -> Column:
    each = 32 // bits
    count = F.ceil(F.size(x) / each).cast("int")
    word = lambda w: F.aggregate(
        F.transform(F.slice(x, w * each + 1, each), lambda v, i: F.pmod(v, F.lit(1 << bits)) * F.pow(F.lit(2), i * bits).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b
    )
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), word)).otherwise(F.array().cast("array<bigint>"))


def unpack(words: Column, bits: int, n: Column) -> Column:
    """The first n values of packed words."""
    return once(words, lambda words: _unpacked(words, bits, n))


def _unpacked(words: Column, bits: int, n: Column) -> Column:
    each = 32 // bits
    value = lambda i: F.floor(F.get(words, F.floor(i / each).cast("int")) / F.pow(F.lit(2), (i % each) * bits)).cast("long") % (1 << bits)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), value)).otherwise(F.array().cast("array<bigint>"))


def _lengths(lists: pa.Array) -> np.ndarray:
    """Elements of each list, 0 for null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _slots(lists: pa.Array, places: pa.Array, at: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slots in lists.flatten() that `at`, the positions flattened from `places`, name in the list of the same row; and which of
    `at` count: null lists have no slots."""
    n = _lengths(lists)
    row = np.repeat(np.arange(len(n)), _lengths(places))
    counted = lists.is_valid().to_numpy(zero_copy_only=False)[row]
    row, at = row[counted], at.filter(pa.array(counted))
    if at.null_count:
        raise ValueError("a position is null")
    at = at.to_numpy().astype(np.int64)
    at = np.where(at < 0, at + n[row], at)
    if ((at < 0) | (at >= n[row])).any():
        raise IndexError("a position is outside its list")
    return _offsets(n)[row] + at, counted


def dna_letters(codes: Column, marked: Column) -> Column:
    """A DNA string from codes and the positions of N; null codes are left out. Linear, which a lookup for each letter is not, and
    for all rows of a batch at once."""

    @F.arrow_udf("string")
    def joined(codes: pa.Array, marked: pa.Array) -> pa.Array:
        letters = np.frombuffer("".join(sorted(DNA, key=DNA.get)).encode() + b"\0", np.uint8)
        out = letters[codes.flatten().fill_null(len(DNA)).to_numpy().astype(np.int64)]
        out[_slots(codes, marked, marked.flatten())[0]] = ord("N")
        kept = out != 0
        ends = _offsets(kept)[_offsets(_lengths(codes))].astype(np.int32)
        text = pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(out[kept]))
        return pc.if_else(codes.is_valid(), text, None)

    return joined(codes, marked)


def escape_pack(x: Column, low: int, high: int) -> Column:
    """small: values in [low, high), others as high; exceptions: (idx, value) of the others."""
    inside = lambda v: (v >= low) & (v < high)
    small = F.transform(x, lambda v: F.when(inside(v), v).otherwise(F.lit(high).cast("long")))
    rest = F.filter(F.transform(x, lambda v, i: F.when(~inside(v), F.struct(i.cast("long").alias("idx"), v.alias("value")))), lambda e: e.isNotNull())
    return F.struct(small.alias("small"), rest.alias("exceptions"))


def escape_unpack(packed: Column, high: int) -> Column:
    """The values before escape_pack(); an escape without an exception is null. Linear, which a lookup for each escape is not, and
    for all rows of a batch at once."""

    @F.arrow_udf("array<bigint>")
    def filled(small: pa.Array, rest: pa.Array) -> pa.Array:
        own, found = small.flatten(), rest.flatten()
        slots, counted = _slots(small, rest, pc.struct_field(found, "idx"))
        value = pc.struct_field(found, "value").filter(pa.array(counted))
        none = pc.fill_null(pc.equal(own, high), True).to_numpy(zero_copy_only=False).copy()
        out = own.fill_null(0).to_numpy().astype(np.int64)
        none[slots], out[slots] = value.is_null().to_numpy(zero_copy_only=False), value.fill_null(0).to_numpy()
        ends = pa.array(_offsets(_lengths(small)).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(out, mask=none), mask=small.is_null())

    return filled(packed["small"], packed["exceptions"])


def render(symbols: Column, text: bool) -> Column:
    """Characters joined, or numbers with spaces between."""
    return F.array_join(F.transform(symbols, lambda c: F.chr(c) if text else c.cast("string")), "" if text else " ")


def unshifted_alphabet(df: DataFrame, shifted: str, least: int) -> DataFrame:
    """df with `v`: the values before shifted_alphabet(), of which the least was `least`."""
    return df.withColumn("v", F.col(shifted) + (least - 1 if least < 1 else 0))


def shifted_alphabet(df: DataFrame, value: str) -> DataFrame:
    """df with `shifted`: values moved so that the least is 1, if it is below."""
    least = df.agg(F.min(value).alias("least_"))
    return df.crossJoin(F.broadcast(least)).withColumn("shifted", F.when(F.col("least_") < 1, F.col(value) + 1 - F.col("least_")).otherwise(F.col(value))).drop("least_")  # one row
