"""Choosing how to match and parse, by name."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.operators import matching
from seqweave.operators.parsing import automatic, parametric
from seqweave.schema import IndexConfig


def matches(inputs: DataFrame, reference: DataFrame, seed: int | None = None) -> DataFrame:
    """input_id, pos, ptr, len: by automaton if the reference is small enough, else by seeds of `seed` symbols."""
    n = reference.select(F.size("symbols")).first()[0]
    if seed is None and n <= matching.AUTOMATON_SYMBOLS:
        return matching.matches_long(matching.matches_wide(inputs, matching.reference_symbols(reference)))
    return matching.matches_by_seeds(inputs, reference, seed or 12)


def config(name: str, alphabet: str = "text", **widths) -> IndexConfig:
    """Settings by the strategy's name: classic, threshold, automatic, parametric, or differential."""
    if name in ("automatic", "parametric"):
        options = (automatic if name == "automatic" else parametric)(**widths)
        return IndexConfig(alphabet=alphabet, parser="adaptive", options=tuple(options.items()))
    if name == "differential":
        return IndexConfig(alphabet="dlcp32", parser="adaptive", literal_bits=2, layout="lit_then_copy", options=tuple(widths.items()))
    if name in ("classic", "threshold"):
        return IndexConfig(alphabet=alphabet, parser=name, diff_bits=0 if name == "classic" else 4, options=tuple(widths.items()))
    raise ValueError(f"unknown strategy {name!r}; known: automatic, classic, differential, parametric, threshold")


def combinations(**choices) -> list[IndexConfig]:
    """The settings of all combinations of the given values."""
    return [IndexConfig(**dict(zip(choices, x))) for x in product(*choices.values())]
