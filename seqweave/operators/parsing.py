"""Parsing strategies: folds over an input's matches that give copies and literals.

Events are tuples (kind, pos, ptr, len), kind C (copy) or L (literal). Runs of literals are one event, except with the
classic parser, whose literals are single symbols.
"""

from __future__ import annotations

from collections.abc import Callable

Event = tuple[str, int, int | None, int]


def classic(ptr, lens) -> list[Event]:
    """A copy wherever the match is longer than one symbol, then always one literal; the last symbol is a literal."""
    out: list[Event] = []
    n, i = len(lens), 0
    while i < n:
        if lens[i] > 1 and (size := min(lens[i], n - i - 1)) > 0:
            out.append(("C", i, ptr[i], size))
            i += size
        out.append(("L", i, None, 1))
        i += 1
    return out


def threshold(ptr, lens, reach: int = 30, least: int = 15) -> list[Event]:
    """Prefers, within `reach` positions, a match less than `reach` from where the last copy ended; else takes the first
    match of `least` symbols."""
    out: list[Event] = []
    n, i = len(lens), 0
    target = ptr[0] if n and ptr[0] is not None else 0
    while i < n:
        s = next((s for s in range(i, min(n, i + reach + 1)) if lens[s] > 0 and abs(ptr[s] - target) < reach), None)
        if s is None:
            s = next((s for s in range(i, n) if lens[s] >= least), n)
        i = emit(out, i, s, ptr, lens)
        if s < n:
            target = ptr[s] + lens[s]
    return out


def emit(out: list[Event], i: int, s: int, ptr, lens) -> int:
    """Literals up to s, then the copy at s if there is one; returns where it ends."""
    if s > i:
        out.append(("L", i, None, s - i))
    if s >= len(lens):
        return s
    out.append(("C", s, ptr[s], lens[s]))
    return s + lens[s]


def adaptive(ptr, lens, rel_bits: int = 4, look_ahead: int = 14, min_abs: int = 16, min_rel: int = 2) -> list[Event]:
    """Follows the diagonal of the last explicit copy as far as small pointer differences reach; an explicit copy is taken
    where a match is long or starts such a run."""
    out: list[Event] = []
    n = len(lens)
    high, low = 1 << rel_bits, -(1 << rel_bits) - 1

    def relative(i: int, ref: int) -> int | None:
        for s in range(i, min(n, i + look_ahead + 1)):
            if lens[s] >= min_rel and low < ptr[s] - (ref + s - i) < high:
                return s
        return None

    i, ref, s = 0, 0, None
    while i < n:
        if s is not None:
            ref += s - i + lens[s]
            i = emit(out, i, s, ptr, lens)
        else:
            s = next((s for s in range(i, n) if lens[s] > 0 and (lens[s] >= min_abs or s + lens[s] < n and relative(s + lens[s], ptr[s] + lens[s]) is not None)), n)
            i = emit(out, i, s, ptr, lens)
            if s < n:
                ref = ptr[s] + lens[s]
        s = relative(i, ref) if i < n else None
    return out


def parametric(rel_bits: int = 8, abs_bits: int = 32, sym_bits: int = 32, look_ahead: int = 30, explicit: int = 15) -> dict:
    """Options of adaptive() from bit widths, with the look-ahead and the explicit length given."""
    return {"rel_bits": rel_bits, "look_ahead": look_ahead, "min_abs": max(1, explicit), "min_rel": max(1, rel_bits // sym_bits)}


def automatic(rel_bits: int = 4, abs_bits: int = 32, sym_bits: int = 2) -> dict:
    """Options of adaptive() from the three widths: a copy has to save the bits that its pointer costs."""
    return parametric(rel_bits, abs_bits, sym_bits, (abs_bits - rel_bits) // sym_bits, abs_bits // sym_bits)


def extended(i: int, ptr, lens, own, ref) -> tuple[int, int]:
    """The copy (ptr, len) at i whose first value agrees itself: the match at i, or the next one stretched to the left."""
    best = (ptr[i], lens[i]) if lens[i] > 0 and own[i] == ref[ptr[i]] else (0, 0)
    if i + 1 < len(lens) and lens[i + 1] > 0 and ptr[i + 1] and own[i] == ref[ptr[i + 1] - 1] and lens[i + 1] >= best[1]:
        best = (ptr[i + 1] - 1, lens[i + 1] + 1)
    return best


def differential(ptr, lens, own, ref, rel_bits: int = 4, look_ahead: int = 8, min_abs: int = 4, min_rel: int = 1) -> list[Event]:
    """As adaptive(), on matches of first differences. A copy behind a copy must agree in its first value; one behind a
    literal need not."""
    out: list[Event] = []
    n = len(lens)
    high, low = 1 << rel_bits, -(1 << rel_bits) - 1
    near = lambda p, at: low < p - at < high

    def relative(i: int, at: int):
        if i >= n:
            return None
        p, size = extended(i, ptr, lens, own, ref)
        if size > min_rel and near(p, at):
            return i, p, size
        for s in range(i + 1, min(n, i + look_ahead + 2)):
            if lens[s] >= min_rel and near(ptr[s], at + s - i):
                return s, ptr[s], lens[s]
        return None

    def explicit(i: int):
        fits = lambda s, p, size: size > 0 and (size >= min_abs or relative(s + size, p + size) is not None)
        p, size = extended(i, ptr, lens, own, ref)
        if fits(i, p, size):
            return i, p, size
        return next(((s, ptr[s], lens[s]) for s in range(i + 1, n) if fits(s, ptr[s], lens[s])), None)

    i, at, found = 0, 0, None
    while i < n:
        if found:
            at += found[0] - i + found[2]
        elif found := explicit(i):
            at = found[1] + found[2]
        s, p, size = found or (n, 0, 0)
        if s > i:
            out.append(("L", i, None, s - i))
        if size:
            out.append(("C", s, p, size))
        i = s + size
        found = relative(i, at)
    return out


PARSERS: dict[str, Callable] = {"classic": classic, "threshold": threshold, "adaptive": adaptive}


def parser(name: str) -> Callable:
    if name not in PARSERS:
        raise ValueError(f"unknown parser {name!r}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[name]
