"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Words (a run of spaces and what follows it, or a line's first word) are encoded together: flat arrays of symbols and word
numbers, each round finds every word's least pair rank by a segmented minimum, merges its leftmost occurrences at once,
compacts the arrays and lets go of words without a pair. Merging several occurrences at once is exact where the merged
piece starts no pair of the same or a better rank. Pieces that do are eager; several pieces may share a rank, as runs of blanks
do, so a round merges the occurrences up to the first whose own piece is eager, and leaves what is behind it. Ranks have their turn a range at a time; a boundary at which nothing of the range can merge, whatever its neighbours grow into, parts a
word into stretches that take their rounds at once, so a word of any length, such as a line without spaces, takes few.

Defined results: null counts as empty; an empty text is the end id alone and decodes to the empty text. Characters that
the vocabulary lacks become byte pieces. U+2581 reads as a space, as in the library. Repeated rows, ties and further
columns, whatever their names, change nothing; no rows give no rows. A very long text is one row of flat arrays, some 100
bytes a character while its new words are merged.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, utf8_rows
from .wordcache import Spelling, WordCache, bounds

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: A line's first word stands without a space; this byte, which UTF-8 has not, tells it from others.
BARE = b"\xff"
#: Longer words are merged in stretches.
STRETCHED = 64
#: The end of a run of one symbol that is merged with what follows it.
RUN_TAIL = 32


class PieceModel:
    """A SentencePiece BPE model with byte fallback, identity normalisation and a leading space."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("only BPE with byte fallback, a leading space and no normalisation is covered")
        self.pieces = [p.piece for p in proto.pieces]
        self.end_id = self.pieces.index("</s>")
        self.byte_id = np.full(256, -1, np.int32)
        normal: dict[str, int] = {}
        spelled = []
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte_id[value] = i
                spelled.append(bytes([value]))
            elif p.type == 1:
                normal[p.piece] = i
                spelled.append(p.piece.replace(SPACE, " ").encode())
            elif p.type in (2, 3):
                spelled.append(b"")
            else:
                raise ValueError(f"piece type {p.type} isn't covered")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("a piece crosses words")
        self.spelling = Spelling(spelled)
        self.numerals = Spelling([b"%d " % i for i in range(len(self.pieces))])
        # Symbols: piece ids, then characters that only longer pieces hold.
        self.symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - self.symbol.keys()):
            self.symbol[c] = len(self.pieces) + len(self.symbol) - len(normal)
        self.symbols = len(self.pieces) + len(self.symbol) - len(normal)
        scores = sorted({proto.pieces[i].score for i in normal.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank_of = {i: place[proto.pieces[i].score] for i in normal.values()}
        self.pair: dict[tuple[int, int], int] = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    self.pair[a, b] = i
        keys = np.array([a * self.symbols + b for a, b in self.pair], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.made = np.array(list(self.pair.values()), np.int32)[order]
        self.rank = np.array([self.rank_of[i] for i in self.made.tolist()], np.int32)
        self.eager = np.zeros(self.symbols, bool)
        for (a, b), i in self.pair.items():
            for part in (a, b):
                if part in self.rank_of and self.rank_of[i] <= self.rank_of[part]:
                    self.eager[part] = True
        # The best rank of any pair whose parts end in one symbol and begin with another: what can merge where they touch.
        spelled_as = {v: k for k, v in self.symbol.items()}
        reach: dict[int, int] = {}
        for (a, b), i in self.pair.items():
            one, two, rank = spelled_as[a], spelled_as[b], self.rank_of[i]
            ends = [self.symbol[one[k:]] for k in range(len(one)) if one[k:] in self.symbol]
            begins = [self.symbol[two[:k]] for k in range(1, len(two) + 1) if two[:k] in self.symbol]
            for key in (x * self.symbols + y for x in ends for y in begins):
                if reach.get(key, rank) >= rank:
                    reach[key] = rank
        keys = np.array(list(reach), np.int64)
        order = np.argsort(keys)
        self.reach_keys, self.reach = keys[order], np.array(list(reach.values()), np.int32)[order]
        #: Ranks are merged up to each of these bounds in turn.
        self.turns = [*(b for b in (100, 400, 1600, 6400) if b < len(scores)), len(scores)]
        known = sorted(c for c in self.symbol if len(c) == 1)
        self.chars = np.array([ord(c) for c in known], np.uint32)
        self.char_symbol = np.array([self.symbol[c] for c in known], np.int32)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair of symbols (NONE: no such pair) and its place in the table. Negative: no symbol."""
        key = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE), at

    def reach_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The best rank of what can ever merge across each boundary, NONE where nothing can."""
        key = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.reach_keys, key), len(self.reach_keys) - 1)
        return np.where((self.reach_keys[at] == key) & (left >= 0) & (right >= 0), self.reach[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and how many each has; words as WordCache holds them."""
        texts = [w[1:].decode() if w[:1] == BARE else w.decode() if w == b"\n" else SPACE + w.decode().replace(" ", SPACE) for w in words]
        sizes = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        # What isn't a symbol carries its code point as a negative number.
        sym = np.where(self.chars[at] == code, self.char_symbol[at], -1 - code.astype(np.int64)).astype(np.int32)
        word = np.repeat(np.arange(len(texts)), sizes)
        # Stretches pay where words are long; both ways merge the same.
        long = (sizes > STRETCHED)[word]
        parts = [self._rounds(sym[~long], word[~long], False), self._rounds(sym[long], word[long], True)]
        sym, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        return self._to_ids(sym[order], word[order], len(texts))

    def _rounds(self, sym: np.ndarray, word: np.ndarray, stretched: bool) -> tuple[np.ndarray, np.ndarray]:
        """Merges all words to the end: symbols and their words, each word's in order."""
        done_sym, done_word = [], []
        turn = 0 if stretched else len(self.turns) - 1
        while len(sym):
            same = word[1:] == word[:-1]
            rank, at = self.look_up(sym[:-1], sym[1:])
            rank = np.append(np.where(same, rank, NONE), NONE).astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            live = np.repeat(np.minimum.reduceat(rank, first) != NONE, np.diff(np.append(first, len(sym))))
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, at = sym[live], word[live], rank[live], at[live[: len(at)]]
                if not len(sym):
                    break
                same = word[1:] == word[:-1]
            # Stretches between which nothing of these ranks can merge are words of their own.
            bound, apart = self.turns[turn], ~same
            if stretched:
                rank = np.where(rank > bound, NONE, rank)
                apart |= self.reach_of(sym[:-1], sym[1:]) > bound
            stretch = np.cumsum(np.concatenate([[True], apart]))
            first = np.flatnonzero(np.diff(stretch, prepend=0))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            hit = np.flatnonzero((rank == least) & (least != NONE))
            if not len(hit):
                turn += 1  # never past the last, under which a word that is left has a pair
                continue
            made = self.made[at[hit]]
            if stretched and self._settle_runs(sym, first, hit, made, keep := np.ones(len(sym), bool)):
                sym, word = sym[keep], word[keep]
                continue
            # Of touching occurrences every second one; of a stretch those up to its first eager piece, none behind it.
            new_run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - run_start) % 2 == 0
            new_stretch = np.concatenate([[True], stretch[hit[1:]] != stretch[hit[:-1]]])
            leader = np.maximum.accumulate(np.where(new_stretch, np.arange(len(hit)), 0))
            eager = self.eager[made]
            before = np.cumsum(eager) - eager
            take &= before == before[leader]
            sym, keep = sym.copy(), np.ones(len(sym), bool)
            sym[hit[take]] = made[take]
            keep[hit[take] + 1] = False
            sym, word = sym[keep], word[keep]
        return np.concatenate([np.zeros(0, np.int32), *done_sym]), np.concatenate([np.zeros(0, np.int64), *done_word])

    def _settle_runs(self, sym: np.ndarray, first: np.ndarray, hit: np.ndarray, made: np.ndarray, keep: np.ndarray) -> bool:
        """Merges long runs of one symbol that begin a stretch with an eager hit, all but their last RUN_TAIL symbols, in place;
        whether there were any. They would take a round a symbol: each merge decides the next one."""
        starts = np.zeros(len(sym), bool)
        starts[first] = True
        lead = np.flatnonzero(starts[hit] & self.eager[made])
        ends = np.append(first, len(sym))[np.searchsorted(first, hit[lead]) + 1]
        lead, ends = lead[ends - hit[lead] > 2 * RUN_TAIL], ends[ends - hit[lead] > 2 * RUN_TAIL]
        found = False
        for at, piece, end in zip(hit[lead].tolist(), made[lead].tolist(), ends.tolist(), strict=True):
            other = np.flatnonzero(sym[at:end] != sym[at])
            n = (int(other[0]) if len(other) else end - at) - RUN_TAIL
            if n >= RUN_TAIL:
                out = self._settled(int(sym[at]), n, self.rank_of[piece])
                sym[at : at + len(out)] = out
                keep[at + len(out) : at + n] = False
                found = True
        return found

    def _settled(self, one: int, n: int, rank: int) -> list[int]:
        """n times one symbol after all merges of this rank, leftmost first, and of the better ones that they lead to. What is
        left of the last symbol taken up has no such pair, so a pass from the left finds them in order."""
        best = lambda a, b: self.rank_of[self.pair[a, b]] if (a, b) in self.pair else rank + 1
        out: list[int] = []
        while n or len(out) > 1:
            behind = best(out[-2], out[-1]) if len(out) > 1 else rank + 1
            ahead = best(out[-1], one) if out and n else rank + 1
            if min(behind, ahead) > rank:
                if not n:
                    break
                out.append(one)
                n -= 1
            elif behind <= ahead:
                out[-2:] = [self.pair[out[-2], out[-1]]]
            else:
                out[-1] = self.pair[out[-1], one]
                n -= 1
        return out

    def _to_ids(self, sym: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become the ids of their bytes."""
        lacking = np.flatnonzero((sym < 0) | (sym >= len(self.pieces)))
        if len(lacking):
            outer = {v: k for k, v in self.symbol.items() if v >= len(self.pieces)}
            spelled = [self.byte_id[list((chr(-1 - s) if s < 0 else outer[s]).encode())] for s in sym[lacking].tolist()]
            size = np.ones(len(sym), np.int64)
            size[lacking] = [len(s) for s in spelled]
            ends = np.cumsum(size)
            ids = np.repeat(sym, size)
            for at, s in zip((ends - size)[lacking].tolist(), spelled, strict=True):
                ids[at : at + len(s)] = s
            sym, word = ids, np.repeat(word, size)
        return sym, np.bincount(word, minlength=words)

    def words_of(self, text: bytes) -> list[bytes]:
        """A text's words, each without its first space."""
        if not text:
            return []
        text = text.replace(b"\xe2\x96\x81", b" ")
        if b"  " not in text and text[:1] != b" ":
            return text.replace(b"\n", b" \n \xff").split(b" ")
        out = []
        for k, line in enumerate(text.split(b"\n")):
            if k:
                out.append(b"\n")
            spaced = line if k else b" " + line
            lead = len(spaced) - len(spaced.lstrip(b" "))
            if not lead:
                bare, _, rest = spaced.partition(b" ")
                out.append(BARE + bare)
                spaced = b" " + rest if _ else b""
            out += [w[1:] for w in re.findall(rb" +[^ ]*", spaced)]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> tuple[PieceModel, WordCache]:
    model = PieceModel(path)
    return model, WordCache(model.encode_words)


def encode_texts(path: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each with its end id, and how many each text has."""
    model, cache = load(path)
    words, counts = [], []
    for text in texts:
        found = model.words_of(text)
        words += found
        counts.append(len(found))
    ids, lengths = cache.encode(words)
    ends = bounds(np.array(counts, np.int64), lengths)
    return np.insert(ids, ends, model.end_id), np.diff(ends, prepend=0) + 1


def decode_ids(path: str, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The text of each run of ids, in UTF-8; bytes that are no UTF-8 become U+FFFD."""
    model, _ = load(path)
    flat, lengths = model.spelling.write(ids)
    ends = bounds(counts, lengths).tolist()
    out = []
    for a, b in zip([0, *ends], ends, strict=False):
        part = flat[a:b]
        out.append(part[1:] if part[:1] == b" " else part)
    return [x if x.isascii() else x.decode("utf-8", "replace").encode() for x in out]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary): the ids with their end id, and the text they decode to."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = encode_texts(path, utf8_rows(part.column("text")))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(decode_ids(path, ids, counts), pa.binary())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id bigint, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what encode() gives, without moving ids to the JVM."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = encode_texts(path, utf8_rows(part.column("text")))
                flat, lengths = load(path)[0].numerals.write(ids)
                ends = bounds(counts, lengths).tolist()
                shas = [hashlib.sha256(flat[a : b - 1]).hexdigest() for a, b in zip([0, *ends], ends, strict=False)]
                back = [hashlib.sha256(x).hexdigest() for x in decode_ids(path, ids, counts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(shas), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return digests(docs, vocabulary())
