"""Ratcliff-Obershelp similarity of two texts, the same number as difflib's.

Where characters are equal is one large whole number, a bit for each pair of places, so that the longest run of a block takes a few
shifts and no loop over characters. The first place in both texts is the highest bit. Each row has a bit at least that is no place,
so a run (a diagonal, `wide` + 1 bits from one to the next) ends with its row.
"""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher

import numpy as np

#: From which length of the second text on difflib leaves out characters that fill over a hundredth of it.
RARE_FROM, RARE_SHARE = 200, 100
#: Bits of one number; texts that need more go to difflib, which holds no table of places.
MOST_BITS = 1 << 24
#: Rows of a number of units that is kept, for each width.
KEPT_ROWS = 1024

_units: dict[int, tuple[int, int]] = {}


def _unit_rows(wide: int, rows: int) -> tuple[int, int]:
    """The lowest bit of each of at least so many rows, and how many rows they are."""
    known, high = _units.get(wide, (0, 0))
    if high >= rows:
        return known, high
    made = int.from_bytes(bytes([*bytes(wide // 8 - 1), 1]) * rows, "big"), rows
    if rows <= KEPT_ROWS and wide <= RARE_FROM:
        _units[wide] = made
    return made


def _longest(cells: int, step: int, most: int) -> tuple[int, int]:
    """The end of the first of the longest runs, none over `most`, and its length: run lengths by doubling, then by halves."""
    powers, k = [cells], 1
    while 2 * k <= most and (more := cells & cells >> step * k):
        powers.append(more)
        cells, k = more, 2 * k
    most -= k
    for j in range(len(powers) - 2, -1, -1):
        if 1 << j <= most and (more := cells & powers[j] >> step * k):
            cells, k, most = more, k + (1 << j), most - (1 << j)
    return cells.bit_length() - 1, k


def _equal_places(a: str, b: str, wide: int) -> int:
    padded = b + "\0" * (wide - len(b))
    try:
        x, y = (np.frombuffer(s.encode("latin-1"), np.uint8) for s in (a, padded))
    except UnicodeEncodeError:
        x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, padded))
    equal = x[:, None] == y
    if "\0" in a:
        equal[:, len(b) :] = False
    return int.from_bytes(np.packbits(equal.ravel()).tobytes(), "big")


def _matched(a: str, b: str) -> int | None:
    """Characters in matching blocks, where every character counts."""
    wide = len(b) // 8 * 8 + 8
    if len(a) * wide > MOST_BITS:
        return None
    units, high = _unit_rows(wide, len(a))
    step, total = wide + 1, 0
    # A block: its bits, without rows after it; its rows; a length that no run in it exceeds.
    blocks = [(_equal_places(a, b, wide), len(a), len(b))]
    while blocks:
        cells, rows, most = blocks.pop()
        if most > 1 and cells & cells >> step:
            end, long = _longest(cells, step, most)
            row, bit = divmod(end, wide)
            total += long
            if row and bit:
                unit = units >> (high - row) * wide
                if after := cells & (unit << bit) - unit:
                    blocks.append((after, row, long))
            row, bit = row + long, bit + long
            if row < rows and bit < wide:
                unit = units >> (high - rows + row) * wide
                # Runs before the first longest one are shorter.
                if before := cells >> row * wide & (unit << wide) - (unit << bit):
                    blocks.append((before, rows - row, long - 1))
            continue
        while cells:  # runs of one: the first, then what comes after it
            row, bit = divmod(cells.bit_length() - 1, wide)
            total += 1
            unit = units >> (high - row) * wide
            cells &= (unit << bit) - unit
    return total


def _places(x: str, chars: list[str]) -> list[int]:
    """Where the characters are, and the places before, which keep runs apart."""
    found = set()
    for c in chars:
        at = x.find(c)
        while at >= 0:
            found.add(at)
            at = x.find(c, at + 1)
    return sorted(found | {at - 1 for at in found if at})


def _matched_by_rare(a: str, b: str) -> int | None:
    """As _matched, where blocks begin from runs of rare characters and grow over all; one without any is what its texts begin with alike."""
    most = len(b) // RARE_SHARE + 1
    rare = [c for c in set(b).intersection(a) if b.count(c) <= most]
    rows, columns = _places(a, rare), _places(b, rare)
    wide, height = len(columns) // 8 * 8 + 8, len(rows)
    if height * wide > MOST_BITS:
        return None
    masks, first = dict.fromkeys(rare, 0), 1 << wide - 1
    for k, j in enumerate(columns):
        if b[j] in masks:
            masks[b[j]] |= first >> k
    of = {c: x.to_bytes(wide // 8, "big") for c, x in masks.items()}
    none = bytes(wide // 8)
    cells = int.from_bytes(b"".join([of.get(a[i], none) for i in rows]), "big")
    units, high = _unit_rows(wide, height)
    total, blocks = 0, [(0, len(a), 0, len(b), len(b))]
    while blocks:
        alo, ahi, blo, bhi, most = blocks.pop()
        i, j, run, here = alo, blo, 0, 0
        if most:
            r0, r1, c0, c1 = bisect_left(rows, alo), bisect_left(rows, ahi), bisect_left(columns, blo), bisect_left(columns, bhi)
            unit = units >> (high - r1 + r0) * wide
            here = cells >> (height - r1) * wide & (unit << wide - c0) - (unit << wide - c1)
        if here:
            end, run = _longest(here, wide + 1, most)
            most, (row, bit) = run, divmod(end, wide)
            i, j = rows[r1 - row - run], columns[wide - bit - run]
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, run = i - 1, j - 1, run + 1
        while i + run < ahi and j + run < bhi and a[i + run] == b[j + run]:
            run += 1
        total += run
        if here and i > alo and j > blo:
            blocks.append((alo, i, blo, j, most - 1))
        if here and i + run < ahi and j + run < bhi:
            blocks.append((i + run, ahi, j + run, bhi, most))
    return total


def ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio()"""
    if not a or not b:
        return float(a == b)
    found = _matched(a, b) if len(b) < RARE_FROM else _matched_by_rare(a, b)
    return SequenceMatcher(None, a, b).ratio() if found is None else 2.0 * found / (len(a) + len(b))
