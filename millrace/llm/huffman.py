"""Canonical length-limited Huffman codes over token ids: numpy coding, table-driven decoding of many blocks at once."""

from __future__ import annotations

import numpy as np

#: Tokens between two checkpoints; every run between them decodes on its own.
LANE = 256


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of at most `limit` bits that minimise the coded size (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    n = len(leaf)
    # Level by level: leaves merged with the pairs of the level below; a mark tells leaves from packages.
    marks = []
    weight, is_leaf = leaf, np.ones(n, bool)
    marks.append(is_leaf)
    for _ in range(limit - 1):
        pairs = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both, leafy = np.concatenate([leaf, pairs]), np.concatenate([np.ones(n, bool), np.zeros(len(pairs), bool)])
        by = np.argsort(both, kind="stable")
        weight, is_leaf = both[by], leafy[by]
        marks.append(is_leaf)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(marks):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: shorter first, then smaller ids first."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    for width in np.unique(lengths[order]).tolist():
        same = order[lengths[order] == width]
        code <<= width - last
        codes[same] = np.arange(code, code + len(same), dtype=np.uint64)
        code, last = code + len(same), width
    return codes


class Codebook:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.codes = canonical(self.lengths)
        self.width = int(self.lengths.max(initial=1))
        if self.width > 24:
            raise ValueError("codes are limited to 24 bits")
        self._table: np.ndarray | None = None

    def table(self) -> np.ndarray:
        """For each value of the next `width` bits: the id in the upper bits, the code's length in the lower five."""
        if self._table is None:
            used = np.flatnonzero(self.lengths)
            used = used[np.argsort(self.codes[used] << (self.width - self.lengths[used]).astype(np.uint64))]
            filled = np.repeat((used << 5) | self.lengths[used], 1 << (self.width - self.lengths[used].astype(np.int64)))
            self._table = np.zeros(1 << self.width, np.uint32)
            self._table[: len(filled)] = filled
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, most significant first, and the offset in bits of every LANE-th token."""
        size = self.lengths[ids].astype(np.int64)
        if not size.all():
            raise ValueError("an id without a code")
        ends = np.cumsum(size)
        at = ends - size
        total = int(ends[-1]) if len(ends) else 0
        words = np.zeros((total >> 5) + 2, np.uint64)
        if len(ids):
            spread = self.codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
            word = at >> 5
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[first]] += np.add.reduceat(spread >> np.uint64(32), first)
            words[word[first] + 1] += np.add.reduceat(spread & np.uint64(0xFFFFFFFF), first)
        return words.astype(">u4").tobytes()[: (total + 7) >> 3], at[::LANE]

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """The ids of blocks (bits, checkpoints, tokens); all lanes of all blocks advance together."""
        table, shift = self.table(), 32 - self.width
        base, lanes, sizes, parts = 0, [], [], []
        for bits, points, n in blocks:
            parts.append(bits)
            lanes.append(points.astype(np.int64) + 8 * base)
            sizes.append(np.minimum(LANE, n - LANE * np.arange(len(points))))
            base += len(bits)
        raw = np.frombuffer(b"".join(parts) + bytes(8), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at, left = np.concatenate([np.zeros(0, np.int64), *lanes]), np.concatenate([np.zeros(0, np.int64), *sizes])
        by = np.argsort(-left, kind="stable")
        at, left = at[by], left[by]
        out = np.zeros((LANE, len(at)), np.uint32)
        mask = np.uint32((1 << self.width) - 1)
        for step in range(LANE):
            live = int(np.searchsorted(-left, -step, "left"))
            if not live:
                break
            now = at[:live]
            # The window holds 32 bits from a byte's start: width + 7 of them are in use.
            peek = (window[now >> 3] >> (shift - (now & 7)).astype(np.uint32)) & mask
            hit = table[peek]
            out[step, :live] = hit >> 5
            at[:live] = now + (hit & 31)
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        rows, found, lane = out.T[back], [], 0
        for _, points, n in blocks:
            found.append(rows[lane : lane + len(points)].ravel()[:n])
            lane += len(points)
        return found
