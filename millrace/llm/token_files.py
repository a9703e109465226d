"""Token-id output: canonical length-limited Huffman coding by global counts, in independent blocks.

A written set is a folder with two tables. `codebook` has one row: the code length of every id, from which the canonical
codes follow. `blocks` has a row a block: part and block number (ascending ids run through parts, then blocks), the ids
and token counts of its documents, the coded bits, and the bit offset of every 256th token, so that a block decodes by
itself and its runs decode side by side.

Defined results: null counts as empty; an empty document is the end id alone. Rows with equal ids follow each other
in the order of their token ids' bytes, so the same rows give the same files however they are dealt; null ids come first. Texts are whole: a very long one makes a block of its own, and its ids, four bytes each, are
in a task at once. Ties of counts in the code go to the smaller id. No rows make an empty set. Only the two columns named are
read, so others may have any name.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, map_arrow, scratch_path, slices, stored, utf8_rows
from .huffman import Codebook, code_lengths
from .wordcache import WordCache, bounds

BLOCK_TOKENS = 1 << 16
SPLIT = "<|endoftext|>"


class WordTokenizer:
    """A tokenizers file whose pre-tokenizer drops white space: ASCII white space parts words that encode by themselves."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split_id = self.tokenizer.token_to_id(SPLIT)
        self.size = self.tokenizer.get_vocab_size()

        self.plain_ids: dict[str, bytes] = {}

    def _plain(self, word: str) -> bytes:
        """A lower-case Latin word is one pre-token, so the library's model gets it as it is, bytes spelled as characters."""
        found = self.plain_ids.get(word)
        if found is None:
            if len(self.plain_ids) > 150_000:
                self.plain_ids.clear()
            spelled = word if word.isascii() else "".join(map(BYTE_CHAR.__getitem__, word.encode()))
            found = self.plain_ids[word] = _packed([t.id for t in self.tokenizer.model.tokenize(spelled)])
        return found

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Latin words, with or without a mark at their end, go to the library's model; all others through its pipeline."""
        parts: list[bytes] = []
        others = []
        for i, word in enumerate(words):
            text = word.decode()
            base, tail = (text[:-1], text[-1:]) if text[-1] in ".,;:!?" else (text, "")
            base = base.lower()
            if PLAIN(base):
                parts.append(self._plain(base) + self._mark(tail) if tail else self._plain(base))
            else:
                parts.append(b"")
                others.append(i)
        for i, ids in zip(others, self._piped([words[i].decode() for i in others]), strict=True):
            parts[i] = _packed(ids)
        return np.frombuffer(b"".join(parts), np.int32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4

    @lru_cache(maxsize=16)  # noqa: B019  six marks, one tokenizer a process
    def _mark(self, mark: str) -> bytes:
        return _packed(self.tokenizer.encode(mark, add_special_tokens=False).ids)

    def _piped(self, texts: list[str]) -> list[list[int]]:
        """Many words in one call, parted by a special token; words that hold that token go alone."""
        out: list[list[int]] = []
        for k in range(0, len(texts), 64):
            some = texts[k : k + 64]
            alone = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(some) if "<|" in t}
            line = SPLIT.join("" if i in alone else t for i, t in enumerate(some))
            found: list[list[int]] = [[]]
            for x in self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids:
                if x == self.split_id:
                    found.append([])
                else:
                    found[-1].append(x)
            if len(found) != len(some):
                raise AssertionError("the special token didn't part the words")
            out += [alone.get(i, ids) for i, ids in enumerate(found)]
        return out


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def _byte_chars() -> list[str]:
    """How byte-level vocabularies spell each byte: printable Latin-1 as itself, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


BYTE_CHAR = _byte_chars()
#: Lower-case Latin letters that normalisation keeps.
PLAIN = re.compile("[a-zß-öø-ÿ\u0101-\u012f\u0131-\u017f]+").fullmatch


@lru_cache(maxsize=2)
def load(path: str) -> tuple[WordTokenizer, WordCache]:
    model = WordTokenizer(path)
    return model, WordCache(model.encode_words)


def encode_texts(path: str, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each with its end id, and how many each text has."""
    _, cache = load(path)
    words, counts = [], []
    for text in texts:
        found = text.split()  # on ASCII white space alone, as these are bytes
        words += found
        counts.append(len(found))
    ids, lengths = cache.encode(words)
    ends = bounds(np.array(counts, np.int64), lengths)
    return np.insert(ids, ends, end_id), np.diff(ends, prepend=0) + 1


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids binary: little-endian 16 or 32 bits)."""

    def run(batches):
        kind = "<u2" if max(load(path)[0].size, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = encode_texts(path, utf8_rows(part.column("text")), end_id)
                raw, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                ends = (np.cumsum(counts) * width).tolist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id bigint, n_tokens bigint, ids binary")


def _as_ids(column: pa.Array, counts: np.ndarray) -> list[np.ndarray]:
    return [np.frombuffer(x, f"<u{len(x) // n}") if n else np.zeros(0, np.int64) for x, n in zip(column.to_pylist(), counts.tolist(), strict=True)]


def id_counts(coded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, summed in every task before it is summed over tasks."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                for ids in _as_ids(part.column("ids"), part.column("n_tokens").to_numpy()):
                    total += np.bincount(ids, minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    out = np.zeros(size, np.int64)
    # At most one row an id of the vocabulary.
    for row in map_arrow(coded.select("n_tokens", "ids"), run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Writes all documents in ascending id order to the folder `out`."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Cut points come from the ids alone, so that sampling doesn't encode texts.
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("bigint"), [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_part_of(cuts) if cuts else F.lit(0))
    dealt = encoded(docs, tokenizer_path, end_id, id_col, text_col).withColumn("part", part.cast("int"))
    dealt = dealt.repartition(max(1, len(cuts) + 1), "part").sortWithinPartitions("part", "doc_id", "ids")
    coded, at_coded = stored(dealt, "token-ids")
    size = max(load(tokenizer_path)[0].size, end_id + 1)
    counts = id_counts(coded, size)
    limit = max(16, int(np.ceil(np.log2(max(2, np.count_nonzero(counts))))) + 2)
    lengths = code_lengths(counts, limit)
    spark.createDataFrame([(limit, lengths.tobytes())], "code_limit int, lengths binary").coalesce(1).write.parquet(f"{out}/codebook")
    _block_rows(coded, lengths).write.parquet(f"{out}/blocks")
    forget(spark, at_coded)


def _part_of(cuts: list[int]):
    """How many cut points lie below an id, by a search in a constant array."""
    below = F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("doc_id"))
    return F.size(below)


BLOCKS = "part int, block bigint, doc_ids array<bigint>, n_tokens array<bigint>, bits binary, points binary"


def _block_rows(coded: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Blocks of whole documents; what reads `coded` need not be one task a part, as blocks carry their first row's place."""

    def run(batches):
        book = Codebook(lengths)
        for batch in batches:
            for piece in slices(batch, "ids", 4 * BLOCK_TOKENS):
                row, part = piece.column("row").to_numpy(), piece.column("part").to_numpy()
                edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                for a, b in zip(edges, edges[1:], strict=False):
                    own = piece.slice(a, b - a)
                    n = own.column("n_tokens").to_numpy()
                    bits, points = book.encode(np.concatenate(_as_ids(own.column("ids"), n)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part[a]]), pa.array([row[a]]), pa.array([own.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([bits], pa.binary()), pa.array([points.astype("<u8").tobytes()], pa.binary())],
                        ["part", "block", "doc_ids", "n_tokens", "bits", "points"],
                    )

    return map_arrow(coded.select("part", F.monotonically_increasing_id().alias("row"), "doc_id", "n_tokens", "ids"), run, BLOCKS)


def read_blocks(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{out}/blocks")


def read_codebook(spark: SparkSession, out: str) -> np.ndarray:
    return np.frombuffer(bytes(spark.read.parquet(f"{out}/codebook").first().lengths), np.uint8)


def _decoded_blocks(batch: pa.RecordBatch, book: Codebook):
    """(row of the batch, ids of each of its documents) for blocks decoded together."""
    for piece in slices(batch, "bits", 1 << 20):
        counts = [np.array(x, np.int64) for x in piece.column("n_tokens").to_pylist()]
        blocks = [(bits, np.frombuffer(points, "<u8"), int(n.sum())) for bits, points, n in zip(piece.column("bits").to_pylist(), piece.column("points").to_pylist(), counts, strict=True)]
        for k, (ids, n) in enumerate(zip(book.decode(blocks), counts, strict=True)):
            yield piece.slice(k, 1), np.split(ids, np.cumsum(n)[:-1])


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, ids array<int>) of all documents."""
    lengths = read_codebook(spark, out)

    def run(batches):
        book = Codebook(lengths)
        for batch in batches:
            for row, docs in _decoded_blocks(batch, book):
                yield pa.RecordBatch.from_arrays([pa.array(row.column("doc_ids").to_pylist()[0], pa.int64()), pa.array([d.tolist() for d in docs], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(read_blocks(spark, out), run, "doc_id bigint, ids array<int>")


def token_digests(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a written set."""
    lengths = read_codebook(spark, out)
    blocks = read_blocks(spark, out)
    sized = blocks.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # One row a part, as many parts as the writer had partitions.
    totals = sorted((r.part, r.n) for r in sized.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, at = {}, 0
    for part, n in totals:
        starts[part], at = at, at + n
    base = spark.createDataFrame(list(starts.items()), "at_part int, base bigint")
    placed = sized.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(base), F.col("part") == F.col("at_part"))
    placed = placed.select(F.col("part").alias("p"), F.col("block").alias("b"), (F.col("base") + F.col("before")).alias("base"))

    def run(batches):
        book = Codebook(lengths)
        for batch in batches:
            for row, docs in _decoded_blocks(batch, book):
                n = np.array([len(d) for d in docs], np.int64)
                crc = [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
                first = np.cumsum(n) - n
                k = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([row.column("part")[0].as_py()] * k, pa.int32()), pa.array([row.column("block")[0].as_py()] * k, pa.int64()), pa.array(row.column("doc_ids").to_pylist()[0], pa.int64()), pa.array(first), pa.array(n), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "first", "n_tokens", "ids_crc32"])

    rows = map_arrow(blocks, run, "part int, block bigint, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint")
    met = rows.join(placed, (rows["part"] == placed["p"]) & (rows["block"] == placed["b"]))
    return met.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = scratch_path(spark, "token-files")
    write_token_files(docs, vocabulary(), out)
    return token_digests(spark, out)
