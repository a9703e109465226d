"""Encodes words through a bounded cache: each distinct word is encoded once, all others are numpy gathers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class WordCache(dict):
    """word -> slot. encode_new(words) returns the ids of each word as (flat ids, lengths).

    The cache is dropped when it has more than `most` words, so a worker's memory stays bounded whatever it reads.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 150_000):
        super().__init__()
        self.encode_new, self.most = encode_new, most
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = len(self)
        self.new.append(word)
        return slot

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has."""
        slots = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            flat, length = self.encode_new(self.new)
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(flat), self.used) + (1 << 16), np.int32)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.start = np.concatenate([self.start, self.used + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.used += len(flat)
            self.new = []
        lengths = self.length[slots]
        ids = self.flat[runs(self.start[slots], lengths)]
        if len(self) > self.most:
            self._reset()
        return ids, lengths


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... lengths[0] numbers, then those of the next."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Spelling:
    """Turns numbers into the bytes each stands for."""

    def __init__(self, parts: list[bytes]):
        self.length = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def write(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All bytes, and how many each id has."""
        lengths = self.length[ids]
        return self.flat[runs(self.start[ids], lengths)].tobytes(), lengths


def bounds(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each group ends: counts are members a group, lengths the extent of each member."""
    return np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
