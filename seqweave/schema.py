"""Tables, alphabets and index settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass

MATCHES = "input_id long, pos long, ptr long, len long"
EVENTS = "input_id long, ord long, kind string, pos long, ptr long, len long"
PHRASES = (
    "input_id long, subphrase long, phrase long, start long, copy_len long, lit_len long, target long, delta long, "
    "is_block boolean, block_ptr long, diff long, lit_offset long, lits array<bigint>"
)


@dataclass(frozen=True)
class Alphabet:
    """bits of a symbol, and whether values are signed."""

    name: str
    bits: int
    signed: bool = False


ALPHABETS = {a.name: a for a in (
    Alphabet("dna", 2), Alphabet("text", 32), *(Alphabet(f"int{b}", b) for b in (8, 16, 32)),
    *(Alphabet(f"lcp{b}", b) for b in (16, 32, 64)), *(Alphabet(f"dlcp{b}", b, True) for b in (16, 32, 64)),
)}


def alphabet(name: str) -> Alphabet:
    if name not in ALPHABETS:
        raise ValueError(f"unknown alphabet {name!r}; known: {', '.join(sorted(ALPHABETS))}")
    return ALPHABETS[name]


@dataclass(frozen=True)
class IndexConfig:
    """How inputs are parsed and stored. layout: copy_then_lit, or lit_then_copy for differences."""

    alphabet: str = "text"
    parser: str = "adaptive"
    pointer_bits: int = 32
    diff_bits: int = 4
    literal_bits: int = 8
    copy_cap: int | None = None
    layout: str = "copy_then_lit"
    options: tuple[tuple[str, int], ...] = ()

    @property
    def literal_cap(self) -> int:
        return (1 << self.literal_bits) - 1

    def flat(self) -> dict:
        return asdict(self) | {"options": ",".join(f"{k}={v}" for k, v in self.options)}

    @classmethod
    def of(cls, row: dict) -> IndexConfig:
        options = tuple((k, int(v)) for k, _, v in (x.partition("=") for x in row["options"].split(",") if x))
        return cls(**{**row, "options": options})
