"""Winnowed anchors: positions of a text chosen by its own content, the same in every text that holds the same passage."""

from __future__ import annotations

import numpy as np

#: Bits of a hash that give way to the position in a chunk, so that the least key also tells where it is.
POSITION_BITS = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = 0xD6E8FEB86659FD93


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = (np.full(n, b, np.uint64) for b in (_BASE, inverse))
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


class Winnower:
    """Anchors of many texts at a time, with the arrays of powers kept between calls."""

    def __init__(self, gram: int, window: int, chunk: int = 1 << 18):
        self.gram, self.window, self.chunk = gram, window, chunk
        self.up, self.down = _powers(chunk + gram + window)

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each run of ``gram`` characters."""
        n, m = len(codes), self.gram
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(codes * self.up[:n], out=sums[1:])
            h = (sums[m:] - sums[:-m]) * self.down[:n - m + 1]
            for _ in range(2):
                h ^= h >> np.uint64(32)
                h *= np.uint64(_MIX)
            h ^= h >> np.uint64(32)
        return h

    def anchors(self, codes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(position, hash)`` of the least hash of each window that starts where ``windows`` is true; leftmost among equals."""
        h = self.grams(codes)
        key = (h & ~np.uint64((1 << POSITION_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        low, span = key, 1
        while span * 2 <= self.window:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        if span < self.window:
            low = np.minimum(low[:len(low) - (self.window - span)], low[self.window - span:])
        chosen = low[windows[:len(low)]]
        if len(chosen):
            chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
        at = (chosen & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        return at, h[at]

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text number, position, hash)`` of all anchors, in order; texts shorter than one window have none."""
        need = self.gram + self.window - 1
        parts, size, out = [], 0, []
        for i, t in enumerate(texts):
            for a in range(0, max(0, len(t) - need + 1), self.chunk - need + 1):
                piece = t[a:a + self.chunk]
                if size + len(piece) > self.chunk:
                    out.append(self._flush(parts))
                    parts, size = [], 0
                parts.append((i, a, piece))
                size += len(piece)
        out.append(self._flush(parts))
        who, at, h = (np.concatenate(x) for x in zip(*out))
        if len(who):  # pieces of one text share at most the anchor on their border
            keep = np.concatenate([[True], (who[1:] != who[:-1]) | (at[1:] != at[:-1])])
            who, at, h = who[keep], at[keep], h[keep]
        return who, at, h

    def _flush(self, parts: list[tuple[int, int, str]]):
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        lengths = np.array([len(p) for _, _, p in parts])
        codes = np.frombuffer("".join(p for _, _, p in parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.cumsum(lengths)
        windows = np.ones(len(codes), bool)
        need = self.gram + self.window - 1
        for e in ends:  # no window reaches over the end of its text
            windows[e - need + 1:e] = False
        at, h = self.anchors(codes, windows)
        part = np.searchsorted(ends, at, side="right")
        starts = ends - lengths
        who, offset = np.array([i for i, _, _ in parts]), np.array([a for _, a, _ in parts])
        return who[part], at - starts[part] + offset[part], h
