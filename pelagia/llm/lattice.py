"""Marginal likelihood of byte strings under a unigram piece vocabulary: the sum over all segmentations, by a forward recursion in log space."""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np

_BASE, _SIDE, _OTHER = 0x100000001B3, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
LONG = 64
#: Probabilities of strings down to exp(-DEEP) are summed as they are, which doubles hold; below, their logarithms are.
DEEP = 600.0


class Table:
    """A two-table cuckoo hash of all prefixes of the pieces, by their polynomial hashes: a piece's number, -1 for what only begins pieces."""

    def __init__(self, pieces: list[bytes]):
        known: dict[int, int] = {}
        for i, p in enumerate(pieces):
            h = 0
            for x in p:
                h = (h * _BASE + x + 1) & (2**64 - 1)
                known.setdefault(h, -1)
            known[h] = i
        self.bits = max(8, len(known).bit_length())
        while not self._filled(known):
            self.bits += 1

    def _slot(self, key: int, side: int) -> int:
        if side:
            return (1 << self.bits) + (((key ^ (key >> 32)) * _OTHER) % 2**64 >> (64 - self.bits))
        return (key * _SIDE) % 2**64 >> (64 - self.bits)

    def _filled(self, known: dict[int, int]) -> bool:
        slots = 2 << self.bits
        keys, ids = [0] * slots, [-2] * slots
        for key, at in known.items():
            side = 0
            for _ in range(500):
                slot = self._slot(key, side)
                keys[slot], key = key, keys[slot]
                ids[slot], at = at, ids[slot]
                if at == -2:
                    break
                side = 1 if slot < slots // 2 else 0
            else:
                return False
        self.keys, self.ids = np.array(keys, np.uint64), np.array(ids, np.int32)
        return True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 for a mere prefix, -2 for none."""
        shift = np.uint64(64 - self.bits)
        a = (h * np.uint64(_SIDE)) >> shift
        b = (((h ^ (h >> np.uint64(32))) * np.uint64(_OTHER)) >> shift) + np.uint64(1 << self.bits)
        return np.where(self.keys[a] == h, self.ids[a], np.where(self.keys[b] == h, self.ids[b], -2))


_tables: dict[tuple[bytes, ...], Table] = {}


def table_of(pieces: list[bytes]) -> Table:
    """The table of a vocabulary; the last one is kept, since a Python worker meets the same one in task after task."""
    key = tuple(pieces)
    if key not in _tables:
        _tables.clear()
        _tables[key] = Table(pieces)
    return _tables[key]


def shallow(n: int, logp: np.ndarray) -> bool:
    """Whether all segmentations of ``n`` bytes have a probability that a double holds."""
    return -n * float(logp.min()) < DEEP


class Lattice:
    """pieces: byte strings, all single bytes among them; logp: their natural log probabilities. Pieces are looked up for many strings at once."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp, self.table = pieces, np.asarray(logp, np.float64), table_of(pieces)
        self.longest = max(map(len, pieces))

    def weighted(self, logp: np.ndarray) -> Lattice:
        """The same pieces with other probabilities; the table is shared."""
        other = copy.copy(self)
        other.logp = np.asarray(logp, np.float64)
        return other

    def arcs(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For strings of one length, rows of ``x``: start, length, the rows that have a piece there, and the pieces. A row is followed as long as a piece
        begins with what was read."""
        x = np.ascontiguousarray(x.T).astype(np.uint64) + np.uint64(1)
        n = len(x)
        for i in range(n):
            rows, h = np.arange(x.shape[1]), np.zeros(x.shape[1], np.uint64)
            for k in range(1, min(self.longest, n - i) + 1):
                h = h * np.uint64(_BASE) + x[i + k - 1, rows]
                ids = self.table.find(h)
                alive = np.flatnonzero(ids > -2)
                if len(alive) < len(rows):
                    rows, h, ids = rows[alive], h[alive], ids[alive]
                if not len(rows):
                    break
                on = np.flatnonzero(ids >= 0)
                if len(on):
                    yield i, k, rows[on], ids[on]

    def forward(self, x: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Log marginals of the rows of ``x``. With ``counts``, the expected number of uses of each piece is added to it."""
        n = x.shape[1]
        if shallow(n, self.logp):
            return self.forward_shallow(x, counts)
        a = np.full((n + 1, len(x)), -np.inf)
        a[0] = 0
        kept = []
        for i, k, rows, ids in self.arcs(x):
            a[i + k, rows] = np.logaddexp(a[i + k, rows], a[i, rows] + self.logp[ids])
            if counts is not None:
                kept.append((i, k, rows, ids))
        if counts is not None:
            b = np.full((n + 1, len(x)), -np.inf)
            b[n] = 0
            for i, k, rows, ids in reversed(kept):
                on = self.logp[ids] + b[i + k, rows]
                counts += np.bincount(ids, np.exp(a[i, rows] + on - a[n, rows]), len(counts))
                b[i, rows] = np.logaddexp(b[i, rows], on)
        return a[n]

    def forward_shallow(self, x: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """The same without logarithms, for strings whose least probable segmentation is above exp(-DEEP)."""
        n, p = x.shape[1], np.exp(self.logp)
        a = np.zeros((n + 1, len(x)))
        a[0] = 1
        kept = []
        for i, k, rows, ids in self.arcs(x):
            step = p[ids]
            a[i + k, rows] += a[i, rows] * step
            if counts is not None:
                kept.append((i, k, rows, ids, step))
        if kept:
            b, uses = np.zeros((n + 1, len(x))), []
            b[n] = 1 / a[n]
            for i, k, rows, _, step in reversed(kept):
                on = step * b[i + k, rows]
                uses.append(a[i, rows] * on)
                b[i, rows] += on
            counts += np.bincount(np.concatenate([ids for *_, ids, _ in reversed(kept)]), np.concatenate(uses), len(counts))
        return np.log(a[n])

    def forward_long(self, word: bytes, counts: np.ndarray | None = None) -> float:
        """The same for one long string: lookups for all places at once, then the recursion place by place, in a window of places."""
        x = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(x)
        h, at = np.zeros(n, np.uint64), np.full((n, self.longest), -1, np.int32)
        for k in range(1, min(self.longest, n) + 1):
            h = h[: n - k + 1] * np.uint64(_BASE) + x[k - 1 :]
            at[: n - k + 1, k - 1] = self.table.find(h)
        a = np.full(n + 1, -np.inf)
        a[0] = 0
        for i in range(n):
            k = np.flatnonzero(at[i] >= 0)
            a[i + 1 + k] = np.logaddexp(a[i + 1 + k], a[i] + self.logp[at[i, k]])
        if counts is not None:
            b = np.full(n + 1, -np.inf)
            b[n] = 0
            for i in range(n - 1, -1, -1):
                k = np.flatnonzero(at[i] >= 0)
                on = self.logp[at[i, k]] + b[i + 1 + k]
                np.add.at(counts, at[i, k], np.exp(a[i] + on - a[n]))
                b[i] = np.logaddexp.reduce(on)
        return float(a[n])

    def log_marginals_of(self, words: list[bytes], logps: list[np.ndarray], block: int = 4096) -> np.ndarray:
        """Natural log of each word's probability under several sets of piece probabilities (rows): pieces are looked up once for all."""
        out = np.empty((len(logps), len(words)))
        by_piece = np.ascontiguousarray(np.stack(logps, axis=1))
        p_piece = np.exp(by_piece)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            n = int(lengths[same[0]]) if len(same) else 0
            if n > LONG:
                for k, p in enumerate(logps):
                    net = self.weighted(p)
                    out[k, same] = [net.forward_long(words[w]) for w in same.tolist()]
                continue
            for part in (same[i : i + block] for i in range(0, len(same), block)):
                x = np.frombuffer(b"".join([words[w] for w in part.tolist()]), np.uint8).reshape(len(part), n)
                if shallow(n, by_piece):
                    a = np.zeros((n + 1, len(x), len(logps)))
                    a[0] = 1
                    for i, k, rows, ids in self.arcs(x):
                        a[i + k, rows] += a[i, rows] * p_piece[ids]
                    out[:, part] = np.log(a[n]).T
                    continue
                a = np.full((n + 1, len(x), len(logps)), -np.inf)
                a[0] = 0
                for i, k, rows, ids in self.arcs(x):
                    a[i + k, rows] = np.logaddexp(a[i + k, rows], a[i, rows] + by_piece[ids])
                out[:, part] = a[n].T
        return out

    def log_marginals(self, words: list[bytes], counts: np.ndarray | None = None, block: int = 4096) -> np.ndarray:
        """Natural log of each word's probability, summed over all segmentations."""
        out = np.empty(len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, cuts):
            n = int(lengths[same[0]]) if len(same) else 0
            if n > LONG:
                for w in same.tolist():
                    out[w] = self.forward_long(words[w], counts)
                continue
            for part in (same[i : i + block] for i in range(0, len(same), block)):
                x = np.frombuffer(b"".join([words[w] for w in part.tolist()]), np.uint8).reshape(len(part), n)
                out[part] = self.forward(x, counts)
        return out
