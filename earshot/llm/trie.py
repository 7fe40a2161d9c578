"""One shard of an n-gram trie: contexts, monotone pointers and successors in Elias-Fano levels."""

from __future__ import annotations

import numpy as np

from .eliasfano import EliasFano, encode

#: Quantised values count steps of 1/STEPS in -log10; 16 bits reach down to 1e-16.
STEPS = 4096
ABSENT = 65535


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.minimum(np.round(-STEPS * np.log10(p)), ABSENT - 1).astype("<u2")


def dequantise(q: np.ndarray) -> np.ndarray:
    return np.where(q == ABSENT, 0.0, 10.0 ** (-q.astype(np.float64) / STEPS))


def group_sorted(contexts: np.ndarray, successors: np.ndarray, universe: int) -> tuple[np.ndarray, bytes, bytes, bytes]:
    """(first row of each context, codes of contexts, pointers, successors) of pairs sorted by both."""
    first = np.flatnonzero(np.diff(contexts, prepend=contexts[:1] + np.uint64(1))) if len(contexts) else np.zeros(0, np.int64)
    rank = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, len(contexts))))
    relative = rank * np.uint64(universe) + successors
    return first, encode(contexts[first], universe), encode(np.append(first, len(contexts)), len(contexts) + 1), encode(relative, universe * max(1, len(first)))


class Trie:
    """Levels in one buffer: context ids, pointers, successors by context, probabilities, back-off weights."""

    def __init__(self, buffer: np.ndarray):
        self.universe, self.n = (int(x) for x in buffer[:16].view("<u8"))
        at = 16
        self.contexts = EliasFano(buffer[at:])
        at += self.contexts.size
        self.pointers = EliasFano(buffer[at:])
        at += self.pointers.size
        self.successors = EliasFano(buffer[at:])
        at += self.successors.size
        self.probabilities = np.frombuffer(buffer[at : at + 2 * self.n].tobytes(), "<u2") if at % 2 else buffer[at : at + 2 * self.n].view("<u2")

    @staticmethod
    def build(contexts: np.ndarray, successors: np.ndarray, probability: np.ndarray, universe: int) -> bytes:
        """Code of pairs sorted by (context, successor), ids below ``universe``, with their probabilities."""
        _, c, p, s = group_sorted(contexts, successors, universe)
        return np.array([universe, len(contexts)], dtype="<u8").tobytes() + c + p + s + quantise(probability).tobytes()

    @classmethod
    def of(cls, code: bytes) -> Trie:
        return cls(np.frombuffer(code, np.uint8))

    @classmethod
    def open(cls, path: str) -> Trie:
        """A shard in a file, memory-mapped."""
        return cls(np.memmap(path, np.uint8, "r"))

    def lookup(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Quantised probability of each pair, ABSENT where the trie lacks it."""
        out = np.full(len(contexts), ABSENT, "<u2")
        if self.n == 0 or len(contexts) == 0:
            return out
        distinct, of = np.unique(contexts, return_inverse=True)
        at = self.contexts.successor(distinct)
        there = np.flatnonzero(at < self.contexts.n)
        there = there[self.contexts[at[there]] == distinct[there]]
        ranks = np.full(len(distinct), -1, np.int64)
        ranks[there] = at[there]
        begin, end = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        begin[there], end[there] = self.pointers[at[there]].astype(np.int64), self.pointers[at[there] + 1].astype(np.int64)
        known = np.flatnonzero(ranks[of] >= 0)
        rank, first, last = (x[of[known]] for x in (ranks, begin, end))
        want = rank.astype(np.uint64) * np.uint64(self.universe) + successors[known]
        found = self.successors.successor(want, first, last)
        hit = found < last
        hit[hit] = self.successors[found[hit]] == want[hit]
        out[known[hit]] = self.probabilities[found[hit]]
        return out
