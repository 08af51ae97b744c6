"""A vectorised, bounded memo from the stretches between plain spaces to their ids.

Texts are joined and hashed in numpy: a polynomial hash of every stretch comes from differences of
one running sum, and an open-addressing table of 64-bit hashes leads to the ids, which lie in one
pool. Only stretches that the table lacks go to the Python function behind it. Each entry keeps a
half of a second one, over other bases; a stretch whose first hash is in the table but whose second
differs is computed, so only an equality of all 96 bits could give a stretch the ids of another.
Stretches of over 64 bytes are never kept, they are computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_FIRST = np.uint64(0xA0761D6478BD642F)
_LONG = 64
_REFUSED = 0xFFF
#: Bytes of texts hashed at once; a longer text is a block of its own.
_BLOCK = 1 << 17


class _Powers:
    rows: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * len(_BASES)

    @classmethod
    def of(cls, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each base its powers and those of its inverse, modulo 2**64."""
        if len(cls.rows[0][0]) < n:
            size = max(n, 2 * _BLOCK)
            power = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
            cls.rows = [(power(base), power(pow(base, -1, 1 << 64))) for base in _BASES]
        return cls.rows


_LETTERS = [np.random.default_rng(seed).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 12)]


def _hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The polynomial hashes of the bytes from each start to its end, one array for each base."""
    out = []
    for letters, (up, down) in zip(_LETTERS, _Powers.of(len(b) + 1), strict=True):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[b] * down[:len(b)])])
        out.append((total[ends] - total[starts]) * up[starts] + (ends - starts).astype(np.uint64))
    return out


class WordTable:
    """compute(stretch, first) gives the ids of a stretch as bytes of dtype, or None if its text can't be split there."""

    def __init__(self, compute: Callable[[bytes, bool], bytes | None], dtype: np.dtype, limit: int = 1_400_000):
        self.compute, self.dtype, self.limit = compute, np.dtype(dtype), limit
        self.bits = (limit * 4 // 3).bit_length()
        self._clear()

    def _clear(self) -> None:
        size = 1 << self.bits
        self.keys = np.zeros(size, np.uint64)
        self.checks = np.zeros(size, np.uint32)
        #: start in the pool << 12 | number of ids; the number _REFUSED: not to be split there.
        self.place = np.zeros(size, np.int64)
        self.pool = np.zeros(1 << 16, self.dtype)
        self.entries = self.used = 0

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, found) of each hash; an unfound one has the free slot that ended its probing."""
        mask = len(self.keys) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        found = key == h
        open_ = np.flatnonzero(~found & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            found[open_[hit]] = True
            open_ = open_[~hit & (key != 0)]
        return slot, found

    def _insert(self, h: np.ndarray, check: np.ndarray, values: list[bytes | None]) -> None:
        """h: distinct hashes that the table lacks, check: their second hashes."""
        data = np.frombuffer(b"".join([v or b"" for v in values]), self.dtype)
        while self.used + len(data) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.dtype)])
        self.pool[self.used:self.used + len(data)] = data
        lengths = np.array([len(v) // self.dtype.itemsize if v is not None else -1 for v in values], np.int64)
        starts = self.used + np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        self.used += len(data)
        self.entries += len(h)
        left = np.arange(len(h))
        while len(left):
            slot, _ = self._slots(h[left])
            _, first = np.unique(slot, return_index=True)  # of those that want one slot, one gets it
            at, who = slot[first], left[first]
            self.keys[at], self.checks[at] = h[who], check[who]
            self.place[at] = starts[who] << 12 | np.where(lengths[who] < 0, _REFUSED, lengths[who])
            left = np.delete(left, first)

    def _block(self, texts: list[bytes]) -> Iterator[np.ndarray | None]:
        joined = b" ".join(texts)
        b = np.frombuffer(joined, np.uint8)
        gaps = np.flatnonzero(b == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b)]])
        sizes = ends - starts
        h, check = _hashes(b, starts, ends)
        check = (check >> np.uint64(32)).astype(np.uint32)
        doc_words = np.cumsum([0, *(t.count(b" ") + 1 for t in texts)])
        h[doc_words[:-1]] ^= _FIRST
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _MIX | np.uint64(1)
        slot, found = self._slots(h)
        #: Stretches that the table can't hold: over-long ones, and those whose first hash is that of another.
        apart = (sizes > _LONG) | (found & (self.checks[slot] != check))
        missing = np.flatnonzero(~found & ~apart)
        if len(missing):
            distinct, which = np.unique(h[missing], return_index=True)
            if self.entries + len(distinct) > self.limit:
                self._clear()
                slot, found = self._slots(h)
                apart = sizes > _LONG
                missing = np.flatnonzero(~apart)
                distinct, which = np.unique(h[missing], return_index=True)
            words = missing[which]
            is_first = np.isin(words, doc_words[:-1])
            self._insert(distinct, check[words], [self.compute(joined[a:e], f) for a, e, f in zip(starts[words].tolist(), ends[words].tolist(), is_first.tolist(), strict=True)])
            slot[missing], _ = self._slots(h[missing])
            apart[missing] = self.checks[slot[missing]] != check[missing]
        long_ones: dict[int, bytes | None] = {}
        if apart.any():
            firsts = set(doc_words[:-1].tolist())
            long_ones = {k: self.compute(joined[starts[k]:ends[k]], k in firsts) for k in np.flatnonzero(apart).tolist()}
        place = self.place[slot]
        lengths, at = place & 0xFFF, place >> 12
        if long_ones:
            lengths[list(long_ones)] = 0
        refused = lengths == _REFUSED
        lengths[refused] = 0
        stops = np.cumsum(lengths)
        ids = self.pool[np.repeat(at - stops + lengths, lengths) + np.arange(stops[-1])]
        stops = np.concatenate([[0], stops])
        bad = np.concatenate([[0], np.cumsum(refused)])
        long_at = sorted(long_ones)
        for a, e in zip(doc_words[:-1].tolist(), doc_words[1:].tolist(), strict=True):
            if bad[e] > bad[a]:
                yield None
                continue
            mine = [k for k in long_at if a <= k < e] if long_at else ()
            if not mine:
                yield ids[stops[a]:stops[e]]
                continue
            if any(long_ones[k] is None for k in mine):
                yield None
                continue
            parts, last = [], stops[a]
            for k in mine:
                parts += [ids[last:stops[k]], np.frombuffer(long_ones[k], self.dtype)]
                last = stops[k]
            yield np.concatenate([*parts, ids[last:stops[e]]])

    def ids(self, texts: Iterable[str]) -> Iterator[np.ndarray | None]:
        """The ids of each text, or None where compute refused one of its stretches."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            held.append(data)
            size += len(data) + 1
            if size >= _BLOCK:
                yield from self._block(held)
                held, size = [], 0
        if held:
            yield from self._block(held)
