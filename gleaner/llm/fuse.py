"""Static binary-fuse filters: an immutable set of 64-bit keys in about 9 bits each, no false negatives, 1 in 256 false positives.

Every key has three cells in three neighbouring segments; the exclusive or of the cells is the key's fingerprint. To build, cells that
only one key still uses are peeled in rounds, all of a round at once; the rounds, last first, then set the cells.
"""

from __future__ import annotations

import math

import numpy as np

from .common import mixed

_ODD = 0x9E3779B97F4A7C15


class Fuse:
    """`segment`: cells of a segment, a power of two; `starts`: segments at which a key's three may start; `cells`: fingerprints."""

    def __init__(self, seed: int, segment: int, starts: int, cells: np.ndarray) -> None:
        self.seed, self.segment, self.starts, self.cells = seed, segment, starts, cells

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The three cells (3 x n) and the fingerprint of each key."""
        h = mixed(keys + np.uint64((self.seed + 1) * _ODD % 2**64))
        base = ((h >> np.uint64(32)) * np.uint64(self.starts) >> np.uint64(32)).astype(np.int64) * self.segment
        g, mask = mixed(h ^ np.uint64(_ODD)), np.uint64(self.segment - 1)
        at = np.stack([base + i * self.segment + ((g >> np.uint64(18 * i)) & mask).astype(np.int64) for i in range(3)])
        return at, (mixed(g) & np.uint64(255)).astype(np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the set."""
        if not len(self.cells):
            return np.zeros(len(keys), bool)
        at, print_ = self._places(keys)
        return (self.cells[at[0]] ^ self.cells[at[1]] ^ self.cells[at[2]]) == print_


def _peeled(at: np.ndarray, cells: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the cell that only it still uses); None if keys are left."""
    n = at.shape[1]
    count, who = np.bincount(at.ravel(), minlength=cells), np.zeros(cells, np.int64)
    np.bitwise_xor.at(who, at.ravel(), np.tile(np.arange(n), 3))
    rounds, left, look = [], n, np.flatnonzero(count == 1)
    while len(look):
        keys, first = np.unique(who[look], return_index=True)
        rounds.append((keys, look[first]))
        left -= len(keys)
        touched = at[:, keys].ravel()
        np.subtract.at(count, touched, 1)
        np.bitwise_xor.at(who, touched, np.tile(keys, 3))
        touched = np.unique(touched)
        look = touched[count[touched] == 1]
    return None if left else rounds


def build(keys: np.ndarray) -> Fuse:
    """The filter of `keys` (uint64, repeats allowed)."""
    keys = np.unique(keys)
    n = len(keys)
    if not n:
        return Fuse(0, 1, 1, np.zeros(0, np.uint8))
    # Sizes as published for three cells a key.
    segment = 1 << min(18, max(2, math.floor(math.log(n) / math.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    starts = max(1, math.ceil(room / segment) - 2)
    for seed in range(1000):
        made = Fuse(seed, segment, starts, np.zeros((starts + 2) * segment, np.uint8))
        at, print_ = made._places(keys)
        rounds = _peeled(at, len(made.cells))
        if rounds is not None:
            for who, cell in reversed(rounds):
                # A key's own cell is still 0; the other two are set or stay as they are.
                a, b, c = (made.cells[x] for x in at[:, who])
                made.cells[cell] = print_[who] ^ a ^ b ^ c
            return made
        if seed % 20 == 19:
            starts += 1 + starts // 20
    raise RuntimeError("no seed peels all keys")
