"""Content-defined segments of sequences, for finding long repeats exactly.

A window is ``length`` consecutive units (words or bytes). Every window picks one
of its grams, the one with the least hash, the left one of ties. Equal windows
pick the same gram, so windows that repeat anywhere share it. Consecutive windows
with one gram whose offset in the window lies in one class (``step`` offsets wide) form a
segment. It has a hash of the units that all windows of the class have around the
gram (``core``) and of all units that its own windows cover (``span``). Equal
(core, span) means that all windows are equal; a core that occurs once means that
none of its windows is repeated. Only where a core recurs with different spans do
single windows have to be compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Units of a gram.
GRAM = 16
#: Bits of a position inside a block; blocks have fewer units.
PLACE_BITS = 22
BLOCK_UNITS = 1 << 18
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ x >> np.uint64(30)) * MIX[0]
    x = (x ^ x >> np.uint64(27)) * MIX[1]
    return x ^ x >> np.uint64(31)


#: What each byte counts as in a hash.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


class Rolling:
    """Polynomial hashes of all runs of a block by prefix sums, modulo 2**64."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int) -> None:
        up, down = self.powers(base, len(values) + 1)
        self.down = down
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The powers of a base and of its inverse, ``n`` at least; kept for the next block."""
        if base not in cls.tables or len(cls.tables[base][0]) < n:
            made = []
            for factor in (int(BASES[base]), pow(int(BASES[base]), -1, 1 << 64)):
                column = np.full(max(n, 1 << 16), factor, np.uint64)
                column[0] = 1
                made.append(np.multiply.accumulate(column))
            cls.tables[base] = tuple(made)
        return cls.tables[base]

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the units from each start up to its end, whatever its place."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * MIX[0])

    def sliding(self, width: int) -> np.ndarray:
        """``runs`` of ``width`` units from every place."""
        n = max(len(self.sums) - width, 0)
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.uint64(width * int(MIX[0]) % 2**64))

    def ranks(self, width: int) -> np.ndarray:
        """Like ``sliding`` with less mixing: enough to pick by the high bits."""
        n = max(len(self.sums) - width, 0)
        x = self.sums[width:] - self.sums[:n]
        x *= self.down[:n]
        x ^= x >> np.uint64(32)
        x *= MIX[0]
        return x


@dataclass
class Segments:
    owner: np.ndarray  # index of the sequence
    first: np.ndarray  # first window's start in its sequence
    count: np.ndarray  # windows
    core: np.ndarray
    span: np.ndarray


def blocks(sequences: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined blocks of about BLOCK_UNITS units: values, and by piece its owner, offset in the owner and start in the block.

    A longer sequence is cut into pieces that overlap by ``length - 1`` units, so
    that each window lies in exactly one piece.
    """
    held, size = [], 0
    for i, units in enumerate(sequences):
        for at in range(0, max(len(units) - length + 1, 0), BLOCK_UNITS):
            piece = units[at : at + BLOCK_UNITS + length - 1]
            if held and size + len(piece) > BLOCK_UNITS:
                yield joined(held)
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield joined(held)


def joined(held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for _, _, p in held])
    return np.concatenate([p for _, _, p in held]), np.array([i for i, _, _ in held]), np.array([at for _, at, _ in held]), np.append(0, np.cumsum(sizes))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    done = 1
    while done * 2 <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    rest = width - done
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def segments(sequences: list[np.ndarray], length: int, step: int) -> Segments:
    """The segments of all ``sequences`` of unsigned 64-bit unit values; offset classes are ``step`` units wide."""
    return segments_by_steps(sequences, length, (step,))[0]


def segments_by_steps(sequences: list[np.ndarray], length: int, steps: tuple[int, ...]) -> list[Segments]:
    """``segments`` for several widths of the offset classes; the grams are picked once for all."""
    out: list[list[tuple[np.ndarray, ...]]] = [[] for _ in steps]
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for values, owners, offsets, edges in blocks(sequences, length):
        grams, wide = Rolling(values, 0), Rolling(values, 1)
        keys = grams.ranks(GRAM)
        keys &= ~mask
        keys |= np.arange(len(keys), dtype=np.uint64)
        least = sliding_least(keys, length - GRAM + 1)
        new = np.append(True, least[1:] != least[:-1])
        new[edges[:-1]] = True
        at = np.nonzero(new)[0]  # windows from here up to ``last`` are in one piece and pick one gram
        piece = np.searchsorted(edges, at, "right") - 1
        last = np.minimum(np.append(at[1:], len(least)), edges[piece + 1] - length + 1)
        inside = at < last  # windows across pieces are none
        at, last, piece = at[inside], last[inside], piece[inside]
        picked = (least[at] & mask).astype(np.int64)
        for step, found in zip(steps, out, strict=True):
            top = (picked - at) // step
            classes = top - (picked - last + 1) // step + 1
            run = np.repeat(np.arange(len(at)), classes)
            kind = top[run] - (np.arange(len(run)) - (np.cumsum(classes) - classes)[run])
            begin = picked[run] - kind * step
            first, end = np.maximum(at[run], begin - step + 1), np.minimum(last[run], begin + 1)
            cores = grams.runs(begin, begin + length - step + 1) + kind.astype(np.uint64)
            found.append((owners[piece[run]], first - edges[piece[run]] + offsets[piece[run]], end - first, cores, wide.runs(first, end - 1 + length)))
    empty = (*[np.empty(0, np.int64)] * 3, *[np.empty(0, np.uint64)] * 2)
    return [Segments(*map(np.concatenate, zip(*found, strict=True))) if found else Segments(*empty) for found in out]
