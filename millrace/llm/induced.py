"""External induced sorting of the suffixes of a text, with their common prefixes.

A suffix that is larger than the one after it is an L, another is an S; an S behind an L is a seed. Two passes put all
suffixes in order once the seeds are: the first, upwards over the symbols, derives each L from the suffix that is one symbol
shorter, the second, downwards, each S. Suffixes that wait for their symbol's turn are tuples (place, common prefix) in a
priority queue. As what arrives for one symbol arrives in order, the queue is a row of first-in-first-out queues, a symbol
each; beyond `room` bytes they are on disk. The prefix that a tuple has in common with its neighbour is one more than the
least of those between the two it was derived from, so it is carried along and never compared anew.

The seeds are put in order by recursion: the same passes over unordered seeds, carrying whether neighbours are equal up to
the next seed, name the pieces between seeds; the string of names, a third of the text as a rule, is sorted in the same way,
each name in two digits so that there are few queues. Up to `base` names are sorted in memory by doubling.

All is exact up to `cap` symbols: suffixes that agree so far may stand in either order, and longer prefixes count as `cap`.
A text beyond `room` bytes is a mapped file, so a shard may be larger than memory; only the places of its seeds, some three
bytes a symbol, are held while they are found. Files are unnamed, in the folders where
Spark spills, private to a task and gone with it: another executor that takes the task over starts anew.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from math import isqrt

import numpy as np

Chunk = tuple[np.ndarray, np.ndarray]
PLACE, PREFIX = np.dtype(np.int64), np.dtype(np.int16)


def scratch_file():
    """An unnamed file where the executor spills."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high], bounds included, for each pair of bounds."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            values = np.minimum(values[: -(1 << (k - 1))], values[1 << (k - 1) :])
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(values[low[own]], values[high[own] + 1 - (1 << k)])
    return out


class Queues:
    """A first-in-first-out queue of (place, prefix) for each symbol, on disk beyond `room` bytes."""

    def __init__(self, symbols: int, room: int):
        self.rows: list[list] = [[] for _ in range(symbols)]
        self.room, self.held, self.file, self.end = room, 0, None, 0

    def put(self, symbol: int, places: np.ndarray, prefixes: np.ndarray) -> None:
        self.rows[symbol].append((places, prefixes))
        self.held += places.nbytes + prefixes.nbytes
        if self.held > self.room:
            self._spill()

    def deal(self, symbols: np.ndarray, places: np.ndarray, prefixes: np.ndarray) -> None:
        """Rows in order of their symbols; those of a symbol in their order."""
        if len(symbols):
            cut = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(symbols)], strict=True):
                self.put(int(symbols[a]), places[a:b], prefixes[a:b])

    def _spill(self) -> None:
        self.file = self.file or scratch_file()
        self.file.seek(self.end)
        for row in self.rows:
            held = [x for x in row if isinstance(x, tuple)]
            if held:
                places, prefixes = (np.concatenate(x) for x in zip(*held, strict=True))
                self.file.write(places.astype(PLACE).tobytes())
                self.file.write(prefixes.astype(PREFIX).tobytes())
                # What is on disk is in front of what is not.
                row[:] = [x for x in row if not isinstance(x, tuple)] + [[self.end, len(places)]]
                self.end += len(places) * (PLACE.itemsize + PREFIX.itemsize)
        self.held = 0

    def take(self, symbol: int) -> list:
        """What waits for a symbol; it no longer does."""
        row, self.rows[symbol] = self.rows[symbol], []
        held = [x for x in row if isinstance(x, tuple)]
        if len(held) > 1:
            row = [x for x in row if not isinstance(x, tuple)] + [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
        self.held -= sum(x[0].nbytes + x[1].nbytes for x in held)
        return row

    def chunks(self, row: list, size: int, back: bool = False) -> Iterator[Chunk]:
        """A taken row in pieces of `size` at most; back: the last piece first."""
        for x in reversed(row) if back else row:
            n = len(x[0]) if isinstance(x, tuple) else x[1]
            for at in range((n - 1) // size * size, -1, -size) if back else range(0, n, size):
                k = min(size, n - at)
                if isinstance(x, tuple):
                    yield x[0][at : at + k], x[1][at : at + k]
                else:
                    yield self._read(x[0] + at * PLACE.itemsize, k, PLACE), self._read(x[0] + n * PLACE.itemsize + at * PREFIX.itemsize, k, PREFIX)

    def _read(self, at: int, n: int, kind: np.dtype) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * kind.itemsize), kind)


class SuffixSorter:
    """Suffixes of texts of integers; the last symbol is 0 and no other is."""

    def __init__(self, cap: int, room: int = 96 << 20, base: int = 2 << 20, chunk: int = 1 << 20):
        self.cap, self.room, self.base, self.chunk = cap, room, base, chunk

    def array(self, n: int, kind) -> np.ndarray:
        """In memory, or a mapped file beyond `room`."""
        if n * np.dtype(kind).itemsize <= self.room:
            return np.empty(n, kind)
        return np.memmap(scratch_file(), kind, "w+", shape=(n,))

    def falling(self, text: np.ndarray, symbols: int) -> Iterator[Chunk]:
        """All suffixes from the largest to the least, in pieces: places, and the prefix in common with the one before."""
        seeds = self._seeds(text)
        names, kinds = self._names(text, symbols, seeds)
        order, prefix = self._order(names, kinds, self.cap // 2 + 1)
        queues = Queues(symbols, self.room)
        for places, common in self._in_symbols(text, seeds, order, prefix):
            queues.deal(text[places], places, common)
        yield from self._induced(text, symbols, queues, self.cap, 1)

    def _seeds(self, text: np.ndarray) -> np.ndarray:
        """Places of the seeds, the final 0 included."""
        found, size, behind_s = [], self.chunk, True
        for end in range(len(text) - 1, 0, -size):
            begin = max(0, end - size)
            part = text[begin : end + 1].astype(np.int64)
            step = np.sign(part[1:] - part[:-1])  # 1: an S, -1: an L, 0: as the one behind it
            step[-1] = step[-1] or (1 if behind_s else -1)
            known = np.flatnonzero(step)
            rising = step[known[np.searchsorted(known, np.arange(len(step)))]] > 0
            found.append(begin + 1 + np.flatnonzero(~rising & np.concatenate([rising[1:], [behind_s]])))
            behind_s = bool(rising[0])
        lengths = [len(x) for x in found]
        out, at = self.array(sum(lengths), PLACE), 0
        for x in reversed(found):
            out[at : at + len(x)] = x
            at += len(x)
        return out

    def _names(self, text: np.ndarray, symbols: int, seeds: np.ndarray) -> tuple[np.ndarray, int]:
        """A name for each seed's piece, up to the next seed, in the order of pieces; how many names there are."""
        queues, met, is_seed = Queues(symbols, self.room), np.zeros(symbols, bool), self.array(len(text), np.bool_)
        is_seed[:] = False
        for at in range(0, len(seeds), self.chunk):
            places = np.asarray(seeds[at : at + self.chunk])
            is_seed[places] = True
            places = places[np.argsort(text[places], kind="stable")]
            symbol = text[places]
            first = np.concatenate([[True], symbol[1:] != symbol[:-1]]) & ~met[symbol]
            met[symbol] = True
            queues.deal(symbol, places, (~first).astype(PREFIX))
        of_place = self.array(len(text), np.int32)
        breaks = last = 0
        name = -1
        for places, equal in self._induced(text, symbols, queues, 1, 0):
            broken = breaks + np.cumsum(equal == 0)
            breaks = int(broken[-1])
            own = np.flatnonzero(is_seed[places])
            if len(own):
                new = np.diff(broken[own], prepend=last) > 0
                of_place[places[own]] = name + np.cumsum(new)
                name, last = name + int(new.sum()), int(broken[own[-1]])
        out = self.array(len(seeds), np.int32)
        for at in range(0, len(seeds), self.chunk):
            out[at : at + self.chunk] = name - of_place[seeds[at : at + self.chunk]]
        return out, name + 1

    def _in_symbols(self, text, seeds, order, prefix) -> Iterator[Chunk]:
        """Seeds in order, with the prefix in common with the one before in symbols: that in names, and what follows it."""
        for at in range(0, len(order), self.chunk):
            k = np.asarray(order[at : at + self.chunk])
            before = np.asarray(order[max(0, at - 1) : at - 1 + len(k)]) if at else np.concatenate([k[:1], k[:-1]])
            a, b = np.asarray(seeds[k]), np.asarray(seeds[before])
            names = np.asarray(prefix[at : at + self.chunk]).astype(np.int64)
            common = np.minimum(np.asarray(seeds[np.minimum(k + names, len(seeds) - 1)]) - a, self.cap)
            live = np.flatnonzero((common < self.cap) & (a != b))
            while len(live):
                same = text[a[live] + common[live]] == text[b[live] + common[live]]
                live = live[same]
                common[live] += 1
                live = live[common[live] < self.cap]
            if not at:
                common[0] = 0
            yield a, common.astype(PREFIX)

    def _order(self, names: np.ndarray, kinds: int, cap: int) -> Chunk:
        """The suffixes of a string of names in order, and the prefixes, in names, in common with the one before."""
        n = len(names)
        if kinds == n:
            order = self.array(n, PLACE)
            order[names] = np.arange(n)
            return order, np.zeros(n, PREFIX)
        if n <= self.base:
            return self._doubled(np.asarray(names), cap)
        digit = isqrt(kinds) + 1
        text = self.array(2 * n + 1, np.int32)
        text[0:-1:2], text[1::2], text[-1] = names // digit + 1, names % digit + 1, 0
        order, prefix = self.array(n, PLACE), self.array(n, PREFIX)
        end, low = n, 2 * cap
        for places, common in SuffixSorter(2 * cap, self.room, self.base, self.chunk).falling(text, digit + 1):
            # Places between names drop out; what they had in common counts for those that stay.
            own = np.flatnonzero((places % 2 == 0) & (places < 2 * n))
            if len(own):
                least = least_between(common, np.concatenate([[0], own[:-1] + 1]), own)
                least[0] = min(int(least[0]), low)
                # A suffix's prefix with the larger one before it belongs to that one.
                order[end - len(own) : end] = (places[own] // 2)[::-1]
                to = np.arange(end, end - len(own), -1)
                prefix[to[to < n]] = least[to < n] // 2
                end -= len(own)
                low = int(common[own[-1] + 1 :].min(initial=2 * cap))
            else:
                low = min(low, int(common.min(initial=2 * cap)))
        prefix[0] = 0
        return order, prefix

    @staticmethod
    def _doubled(names: np.ndarray, cap: int) -> Chunk:
        ranks, rank, h = [(1, names)], names.astype(np.int64), 1
        n = len(names)
        while True:
            behind = np.zeros(n, np.int64)
            behind[: max(0, n - h)] = rank[h:] + 1
            key = rank * (n + 2) + behind
            order = np.argsort(key)
            key = key[order]
            head = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = head
            h *= 2
            ranks.append((h, rank.astype(np.int32)))
            if h >= cap or head[-1] == n - 1:
                break
        a, b = order[1:].copy(), order[:-1].copy()
        common = np.zeros(n - 1, np.int64)
        for h, rank in reversed(ranks):
            same = np.flatnonzero((np.maximum(a, b) < n) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]))
            common[same] += h
            a[same] += h
            b[same] += h
        return order, np.concatenate([[0], np.minimum(common, 2**14)]).astype(PREFIX)

    def _induced(self, text: np.ndarray, symbols: int, seeds: Queues, cap: int, step: int) -> Iterator[Chunk]:
        """From seeds by symbol, in order, all suffixes in falling order. step 0: `prefix` is whether neighbours are equal."""

        def meet(a: int, b: int) -> int:
            """The prefix of an L and an S of one symbol, which is as far as both repeat it."""
            k = 0
            while step and k < cap and text[a + k] == text[b + k]:
                k += 1
            return k

        rising, larger = Queues(symbols, self.room), Queues(symbols, self.room)
        since = np.full(symbols, -1, PREFIX)
        for c in range(symbols):
            last = -1
            while row := rising.take(c):
                for places, prefix in rising.chunks(row, self.chunk):
                    larger.put(c, places, prefix)
                    self._hand_on(text, rising, since, places, prefix, lambda b, c=c: b >= c, cap, step)
                    last = int(places[-1])
            for places, prefix in seeds.chunks(seeds.take(c), self.chunk):
                if last >= 0:
                    prefix, last = np.concatenate([np.array([meet(last, int(places[0]))], PREFIX), prefix[1:]]), -1
                self._hand_on(text, rising, since, places, prefix, lambda b, c=c: b > c, cap, step)
        falling = Queues(symbols, self.room)
        since = np.full(symbols, -1, PREFIX)
        for c in range(symbols - 1, 0, -1):
            last = -1
            while row := falling.take(c):
                for places, prefix in falling.chunks(row, self.chunk):
                    yield places, prefix
                    self._hand_on(text, falling, since, places, prefix, lambda b, c=c: b <= c, cap, step)
                    last = int(places[-1])
            carried = None
            for places, prefix in larger.chunks(larger.take(c), self.chunk, back=True):
                if carried is None:
                    carried = meet(last, int(places[-1])) if last >= 0 else 0
                turned = np.concatenate([np.array([carried], PREFIX), prefix[:0:-1]])
                carried = prefix[0]
                yield places[::-1], turned
                self._hand_on(text, falling, since, places[::-1], turned, lambda b, c=c: b < c, cap, step)
        yield np.array([len(text) - 1]), np.zeros(1, PREFIX)

    @staticmethod
    def _hand_on(text, to: Queues, since: np.ndarray, places: np.ndarray, prefix: np.ndarray, wanted, cap: int, step: int) -> None:
        """Puts the suffixes one symbol longer than these, of the symbols wanted, to their queues. since: by symbol, the
        least prefix met after the last one put; -1 before any."""
        before = text[places - 1]
        own = np.flatnonzero(wanted(before) & (places > 0))
        tail = np.minimum.accumulate(prefix[::-1])[::-1]  # the least from each place to the end
        if not len(own):
            np.minimum(since, tail[0], out=since)
            return
        symbol = before[own]
        order = np.argsort(symbol, kind="stable")
        own, symbol = own[order], symbol[order]
        first = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        start = np.where(first, 0, np.concatenate([[0], own[:-1] + 1]))
        least = least_between(prefix, start, own)
        least[first] = np.minimum(least[first], since[symbol[first]])
        np.minimum(since, tail[0], out=since)
        last = own[np.concatenate([first[1:], [True]])]
        after = np.append(tail, np.iinfo(PREFIX).max)[last + 1]
        since[symbol[first]] = after
        to.deal(symbol, places[own] - 1, np.where(least < 0, 0, np.minimum(least + step, cap)).astype(PREFIX))


def repeated_places(text: np.ndarray, symbols: int, width: int, **limits: int) -> np.ndarray:
    """Whether the `width` symbols from each place start at another place as well; see SuffixSorter for the text."""
    sorter = SuffixSorter(width, **limits)
    out = sorter.array(len(text), np.bool_)
    out[:] = False
    last = -1
    for places, prefix in sorter.falling(text, symbols):
        met = prefix >= width
        out[places[met]] = True
        ahead = np.flatnonzero(met[1:])
        out[places[ahead]] = True
        if met[0] and last >= 0:
            out[last] = True
        last = int(places[-1])
    return out
