"""Byte-pair merging of many pieces at once, in numpy.

All pieces' symbols lie in one array.  Each round finds every piece's
lowest-ranked, leftmost pair (a segmented minimum) and merges it, so the number
of rounds is the largest number of merges in a piece, not the number of pieces.
"""

from __future__ import annotations

import numpy as np

_NONE = np.int64(1) << 30


class Merges:
    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, letters: dict[int, str]):
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = max(16, int(len(pairs) * 8 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int64)
        todo = np.arange(len(pairs))
        key = (left << 32) | right
        slot = self._slot(key)
        while len(todo):  # open addressing: of those that want one free slot the lowest rank gets it
            free = self.keys[slot[todo]] == -1
            _, won = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][won]
            self.keys[slot[won]], self.ranks[slot[won]] = key[won], won
            done = self.keys[slot[todo]] == key[todo]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], _NONE)
        todo = np.flatnonzero((found != key) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces ``data[starts:starts+sizes]`` (none empty), in a row, and the number of ids of each."""
        n = len(starts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.cumsum(sizes) - sizes
        sym = self.inner[data[np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))]]
        last = at + sizes - 1
        sym[last] = self.final[data[starts + sizes - 1]]
        rank = np.full(len(sym), _NONE, np.int64)
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[last] = _NONE
        who, sizes = np.arange(n), sizes.copy()
        count, done = np.zeros(n, np.int64), []
        while len(who):
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), at)
            ready = (best >> 32) >= _NONE
            if ready.sum() * 4 > len(who) or ready.all():
                gone = np.repeat(ready, sizes)
                done.append((who[ready], sym[gone]))
                count[who[ready]] = sizes[ready]
                keep = ~ready
                sym, rank, who, sizes = sym[~gone], rank[~gone], who[keep], sizes[keep]
                moved = np.cumsum(sizes) - sizes
                best = best[keep] - (at[keep] - moved)
                at, ready = moved, ready[keep]
                if not len(who):
                    break
            go = ~ready
            i = best[go] & 0xFFFFFFFF
            sym[i] = self.result[best[go] >> 32]
            rank[i] = rank[i + 1]  # keeps the end mark of a piece
            alive = np.ones(len(sym), bool)
            alive[i + 1] = False
            sym, rank = sym[alive], rank[alive]
            sizes -= go
            i -= np.arange(len(i))
            at = np.cumsum(sizes) - sizes
            first = at[go]
            end = first + sizes[go] - 1
            r = i[i < end]
            rank[r] = self.rank(sym[r], sym[r + 1])
            rank[i[i == end]] = _NONE
            r = i[i > first] - 1
            rank[r] = self.rank(sym[r], sym[r + 1])
        total = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for ids, part in done:
            c = count[ids]
            out[np.repeat(total[ids] - (np.cumsum(c) - c), c) + np.arange(len(part))] = part
        return out, count
