"""From parse events to stored phrases: pairs of a copy and literals, cut to caps, gathered in blocks of one pointer."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from seqweave.operators.parsing import Event


@dataclass
class Piece:
    start: int
    copy_len: int
    lit_len: int
    target: int
    block: bool = False

    @property
    def delta(self) -> int:
        return self.target - self.start


#: A rule takes (source, target, copy_len, lit_len) and returns how much of it may be stored at once.
Rule = Callable[[int, int, int, int], tuple[int, int]]


def literal_cap(most: int) -> Rule:
    return lambda source, target, copy, lit: (copy, min(lit, most))


def copy_cap(most: int) -> Rule:
    return lambda source, target, copy, lit: (copy, lit) if copy <= most else (most, 0)


def paired(events: Iterable[Event]) -> Iterable[tuple[int, int, int, int]]:
    """(source, target, copy_len, lit_len): each copy with the literals behind it."""
    held = None
    for kind, pos, ptr, size in events:
        if kind == "C":
            if held:
                yield held
            held = (pos, ptr, size, 0)
        elif held:
            yield (*held[:3], size)
            held = None
        else:
            yield pos, pos, 0, size
    if held:
        yield held


def pieces(events: Iterable[Event], rules: Iterable[Rule]) -> Iterable[Piece]:
    """The pairs, cut to what all rules accept."""
    rules = list(rules)
    for source, target, copy, lit in paired(events):
        while copy + lit:
            allowed = [r(source, target, copy, lit) for r in rules]
            c = min((a[0] for a in allowed), default=copy)
            now = min((a[1] for a in allowed), default=lit) if c == copy else 0
            yield Piece(source, c, now, target)
            source, target, copy, lit = source + c + now, target + c, copy - c, lit - now


#: A rule that takes a block's pointer and the next piece, and says whether that starts a new block.
Split = Callable[[int, Piece], bool]


def in_blocks(found: Iterable[Piece], low: int, high: int, also: Iterable[Split] = ()) -> Iterable[Piece]:
    """Marks the pieces that start a block: the first, copies whose pointer differs from the block's by less than `low`
    or more than `high`, and those for which any rule of `also` says so."""
    pointer, also = None, list(also)
    for p in found:
        if pointer is None or p.copy_len and not low <= p.delta - pointer <= high or any(f(pointer, p) for f in also):
            p.block, pointer = True, p.delta
        yield p


def committed(
    events: Iterable[Event], symbols: list[int], diff_bits: int = 4, cap: int = 255, most_copy: int | None = None, more: Iterable[Rule] = (), also: Iterable[Split] = ()
) -> list[tuple]:
    """Rows of the phrase table, without the input's id. diff_bits 0: every change of pointer starts a block."""
    rules = [literal_cap(cap), *([copy_cap(most_copy)] if most_copy else []), *more]
    low, high = (-(1 << diff_bits - 1), (1 << diff_bits - 1) - 1) if diff_bits else (0, 0)
    out, phrase, pointer, offset = [], -1, 0, 0
    for k, p in enumerate(in_blocks(pieces(events, rules), low, high, also)):
        if p.block:
            phrase, pointer = phrase + 1, p.delta
        lit_at = p.start + p.copy_len
        diff = p.delta - pointer if p.copy_len else 0
        out.append((k, phrase, p.start, p.copy_len, p.lit_len, p.target, p.delta, p.block, pointer, diff, offset, symbols[lit_at : lit_at + p.lit_len]))
        offset += p.lit_len
    return out


def committed_differences(events: Iterable[Event], own: list[int], ref: list[int], diff_bits: int = 4, cap: int = 3, limit: int = 1024) -> list[tuple]:
    """Rows of the phrase table with literals before the copy. start is where the literals begin, target where the copy
    reads. A copy cut off from its start goes on without a literal only if its next value agrees; else with one literal."""
    low, high = -(1 << diff_bits - 1), (1 << diff_bits - 1) - 1
    out: list[tuple] = []
    state = {"phrase": -1, "pointer": None, "length": 0, "offset": 0}

    def store(start: int, lits: int, target: int, copy: int) -> None:
        delta = target - (start + lits)
        block = state["pointer"] is None or copy > 0 and not low <= delta - state["pointer"] <= high or state["length"] + lits + copy > limit
        if block:
            state.update(phrase=state["phrase"] + 1, pointer=delta, length=0)
        state["length"] += lits + copy
        diff = delta - state["pointer"] if copy else 0
        out.append((len(out), state["phrase"], start, copy, lits, target, delta, block, state["pointer"], diff, state["offset"], own[start : start + lits]))
        state["offset"] += lits

    def both(start: int, lits: int, target: int, copy: int) -> None:
        while lits > cap:
            store(start, cap, target - (lits - cap), 0)
            start, lits = start + cap, lits - cap
        while lits + copy:
            now = min(copy, limit - lits)
            store(start, lits, target, now)
            start, target, copy, lits = start + lits + now, target + now, copy - now, 0
            if copy and own[start] != ref[target]:
                target, copy, lits = target + 1, copy - 1, 1

    held = None
    for kind, pos, ptr, size in events:
        if kind == "L":
            held = (pos, size)
        else:
            both(*(held or (pos, 0)), ptr, size)
            held = None
    if held:
        both(*held, held[0] + held[1], 0)
    return out
