"""Ids of byte spans, where equal spans are encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from entitylake.llm.common import span_hashes

REMEMBERED = 500_000


class SpanCache:
    """Flat ids of spans. Past ``REMEMBERED`` spans the less used half is forgotten, which changes no result."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype=np.uint32) -> None:
        self.encode = encode
        self.known: dict[int, int] = {}
        self.at, self.length, self.uses = (np.zeros(1 << 10, dtype=np.int64) for _ in range(3))
        self.flat, self.used = np.zeros(1 << 12, dtype=dtype), 0

    def _forget(self) -> None:
        """Keeps the more used half; uses are halved, so that spans of earlier texts go in time."""
        names, n = list(self.known), len(self.known) // 2
        kept = np.sort(np.argsort(-self.uses[: len(names)], kind="stable")[:n])
        self.known = {names[k]: slot for slot, k in enumerate(kept.tolist())}
        lengths = self.length[kept]
        reach = np.cumsum(lengths) - lengths
        self.used = int(lengths.sum())
        self.flat[: self.used] = self.flat[np.arange(self.used) + np.repeat(self.at[kept] - reach, lengths)]
        self.at[:n], self.length[:n], self.uses[:n] = reach, lengths, self.uses[kept] // 2
        self.uses[n:] = 0

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        for first in range(0, len(texts), 20_000):
            part = texts[first : first + 20_000]
            flat, lengths = self.encode(part)
            slot = len(self.known)
            self.known.update(zip(hashes[first : first + len(part)], range(slot, slot + len(part))))
            while len(self.at) < slot + len(part):
                self.at, self.length, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length, self.uses))
            while len(self.flat) < self.used + len(flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.length[slot : slot + len(part)] = lengths
            self.at[slot : slot + len(part)] = self.used + np.cumsum(lengths) - lengths
            self.flat[self.used : self.used + len(flat)] = flat
            self.used += len(flat)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans one after the other, and where those of each span begin (one entry more than spans)."""
        if not len(starts):
            return np.zeros(0, dtype=self.flat.dtype), np.zeros(1, dtype=np.int64)
        hashed = span_hashes(data, starts, ends)
        different, first, which, uses = np.unique(hashed, return_index=True, return_inverse=True, return_counts=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        hashes = different.tolist()
        new = [k for k, h in enumerate(hashes) if h not in self.known]
        raw = data.tobytes()
        texts = [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new].tolist()]
        self._learn([hashes[k] for k in new], texts)
        slots = np.fromiter(map(self.known.__getitem__, hashes), dtype=np.int64, count=len(hashes))
        self.uses[slots] += uses
        slots = slots[which]
        lengths = self.length[slots]
        reach = np.zeros(len(slots) + 1, dtype=np.int64)
        np.cumsum(lengths, out=reach[1:])
        return self.flat[np.arange(reach[-1]) + np.repeat(self.at[slots] - reach[:-1], lengths)], reach
