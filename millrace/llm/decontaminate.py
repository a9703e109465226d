"""Benchmark decontamination by winnowing.

Both sides hash runs of 5 words and keep the least hash of every 9 consecutive runs, that is of every 13-word window. A
shared window has the same least hash on both sides, so joining documents' kept hashes with the benchmark's finds every
shared span of 13 words or more; each hit is extended to its windows, which are compared in full by a hash of 13 words.

The benchmark is met in blocks of bounded size: one block is the usual case, and then documents pass once. Larger
benchmarks take a pass a block, with the marks so far stored between passes, so what workers hold never grows.

Defined results: null and wordless documents have no words and are clean; null and wordless items match nothing. An item
of fewer than 13 words is one window of that length. Items with equal ids count once; a null id is named by the empty
string. Repeated documents give equal rows. An empty benchmark leaves all documents clean; no documents give no rows. Ties
don't arise. Columns added are named by a prefix that no column of the documents begins with, so these may have any name. A
very long text is hashed in pieces; its word hashes, eight bytes a word, are in a task at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, free_prefix, map_arrow, slices, stored, table, utf8_rows
from .hashing import mix
from .wordcache import runs

WINDOW, GRAM = 13, 5
BLOCK_BYTES = 8 << 20
#: Letters and digits in lower case and all bytes beyond ASCII stay; other bytes part words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STEP = 0xD6E8FEB86659FD93


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts in a row, and how many words each text has. A word's hash is the sum of what
    its bytes mix to with their places, so no two words are known to share one."""
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for k, group in _bounded([t.translate(FOLD) for t in texts]):
        flat = np.frombuffer(b" " + b" ".join(group) + b" ", np.uint8)
        inside = flat != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        at = np.flatnonzero(inside)
        place = at - np.repeat(start, end - start)
        ends = np.cumsum(end - start)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix((place.astype(np.uint64) << np.uint64(8)) | flat[at]))])
        hashes.append(mix(total[ends] - total[ends - (end - start)]))
        own = np.diff(np.searchsorted(start, np.cumsum([len(t) + 1 for t in group]), "right"), prepend=0)
        counts[k : k + len(group)] += own
    return np.concatenate(hashes), counts


def _bounded(texts: list[bytes], limit: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Groups of texts of about `limit` bytes with the place of the first; a longer text comes in pieces cut between words."""
    k = 0
    while k < len(texts):
        stop, held = k, 0
        while stop < len(texts) and (stop == k or held + len(texts[stop]) <= limit):
            held += len(texts[stop])
            stop += 1
        if held <= limit:
            yield k, texts[k:stop]
        else:
            text, at = texts[k], 0
            while at < len(text):
                cut = text.find(b" ", at + limit)
                cut = len(text) if cut < 0 else cut
                yield k, [text[at:cut]]
                at = cut
        k = stop


def gram_hashes(words: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """The hash of the `width` words from each place, or from the places `at`."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n if at is None else len(at), np.uint64)
    for k in range(width):
        out = out * np.uint64(STEP) + (words[k : k + n] if at is None else words[at + k])
    return mix(out)


def winnowed(words: np.ndarray) -> np.ndarray:
    """The least gram hash of the window from each place."""
    grams = gram_hashes(words, GRAM)
    span, width = WINDOW - GRAM + 1, 1
    while width * 2 <= span:
        grams, width = np.minimum(grams[:-width], grams[width:]) if len(grams) > width else grams[:0], width * 2
    over = span - width
    return np.minimum(grams[:-over], grams[over:]) if over and len(grams) > over else grams[: 0 if over else None]


def _inside(counts: np.ndarray, width: int) -> np.ndarray:
    """Places from which `width` words lie in one text."""
    ends = np.cumsum(counts)
    return runs(ends - counts, np.maximum(counts - width + 1, 0))


class Fingerprints:
    """A block of the benchmark: kept hashes, and which items each window hash belongs to."""

    def __init__(self, ids: list, texts: list[bytes]):
        words, counts = word_hashes(texts)
        self.ids = sorted({"" if i is None else str(i) for i in ids})
        place = {x: k for k, x in enumerate(self.ids)}
        item = np.array([place["" if i is None else str(i)] for i in ids], np.int64)
        at = _inside(counts, WINDOW)
        self.kept = np.unique(winnowed(words)[at])
        owner = np.repeat(item, counts)
        self.windows = {WINDOW: self._index(gram_hashes(words, WINDOW, at), owner[at])}
        starts = np.cumsum(counts) - counts
        for width in range(1, WINDOW):
            if (short := counts == width).any():
                self.windows[width] = self._index(gram_hashes(words, width, starts[short]), item[short])

    @staticmethod
    def _index(hashes: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in order; where each one's items end; the items."""
        pairs = np.unique(np.stack([hashes.astype(np.uint64), items.astype(np.uint64)], axis=1), axis=0)
        key, first = np.unique(pairs[:, 0], return_index=True)
        return key, np.concatenate([first, [len(pairs)]]), pairs[:, 1].astype(np.int64)

    def mark(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are hit; (text, item) of each occurrence of an item's window in a text, distinct."""
        delta, text_of = np.zeros(len(words) + 1, np.int64), np.repeat(np.arange(len(counts)), counts)
        met_text, met_item = [], []
        for width, (key, ends, items) in self.windows.items():
            if not len(key):
                continue
            at = _inside(counts, width)
            if width == WINDOW:
                at = at[_among(winnowed(words)[at], self.kept)]
            hashes = gram_hashes(words, width, at)
            slot = np.minimum(np.searchsorted(key, hashes), len(key) - 1)
            same = key[slot] == hashes
            at, slot = at[same], slot[same]
            delta[at] += 1  # `at` holds each place once
            np.subtract.at(delta, at + width, 1)
            seen = np.unique(np.stack([text_of[at], slot], axis=1), axis=0)
            size = ends[seen[:, 1] + 1] - ends[seen[:, 1]]
            met_text.append(np.repeat(seen[:, 0], size))
            met_item.append(items[runs(ends[seen[:, 1]], size)])
        both = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *x]) for x in (met_text, met_item)], axis=1), axis=0)
        return np.cumsum(delta)[:-1] > 0, both[:, 0], both[:, 1]


def _among(values: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which values are kept ones; neighbours are often equal, so runs are looked up once."""
    if not len(values) or not len(kept):
        return np.zeros(len(values), bool)
    first = np.concatenate([[True], values[1:] != values[:-1]])
    run = values[first]
    return (kept[np.minimum(np.searchsorted(kept, run), len(kept) - 1)] == run)[np.cumsum(first) - 1]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[Fingerprints]:
    """The benchmark's items in blocks of at most `limit` bytes of text (or one longer item); streamed, never all held."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        text = (row.t or "").encode()
        if texts and held + len(text) > limit:
            yield Fingerprints(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row.i)
        texts.append(text)
        held += len(text)
    yield Fingerprints(ids, texts)


MARKS = ["n_words bigint", "n_hit bigint", "items array<string>", "mask binary"]


def marked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, prefix: str = "__") -> DataFrame:
    """docs with n_words, n_hit and items (ids of items with occurring windows, as strings), named with the prefix."""
    spark, first, path = docs.sparkSession, True, None
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(", ".join(prefix + m for m in MARKS)).fields])
    now, pending = docs, None
    blocks = benchmark_blocks(benchmark, item_col, item_text, block_bytes)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        out = _pass(now, block, text_col, schema, prefix, not first, after is None)
        if after is not None:
            out, written = stored(out, "benchmark-marks")
            forget(spark, *filter(None, [path]))
            path = written
        now, block, first = out, after, False
    return now.drop(f"{prefix}mask")


def _pass(docs: DataFrame, block: Fingerprints, text_col: str, schema: T.StructType, prefix: str, again: bool, last: bool) -> DataFrame:
    names = [f.name for f in schema.fields]
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        own = sent.value
        for batch in batches:
            for part in slices(batch, text_col):
                words, counts = word_hashes(utf8_rows(part.column(text_col)))
                hit, texts, items = own.mark(words, counts)
                if again:
                    hit |= np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool) for m, n in zip(part.column(f"{prefix}mask").to_pylist(), counts.tolist(), strict=True))])
                ends = np.cumsum(counts)
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[ends], prepend=0)
                named = [[] for _ in range(len(counts))]
                for t, i in zip(texts.tolist(), items.tolist(), strict=True):
                    named[t].append(own.ids[i])
                if again:
                    named = [sorted({*a, *b}) for a, b in zip(named, part.column(f"{prefix}items").to_pylist(), strict=True)]
                masks = [b""] * len(counts) if last else [np.packbits(h).tobytes() for h in np.split(hit, ends[:-1])]
                base = [part.column(k) for k in range(len(names) - 4)]
                yield pa.RecordBatch.from_arrays([*base, pa.array(counts), pa.array(n_hit), pa.array(named, pa.list_(pa.string())), pa.array(masks, pa.binary())], names)

    return map_arrow(docs, run, schema)


def is_contaminated(prefix: str) -> Column:
    """A document that has hit words, a twentieth of its words or more."""
    hit, words = F.col(f"{prefix}n_hit"), F.col(f"{prefix}n_words")
    return (hit > 0) & (20 * hit >= words)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their columns."""
    prefix = free_prefix(docs.columns)
    return marked(docs, benchmark, prefix=prefix).filter(~is_contaminated(prefix)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return digested(marked(docs, table(spark, sf_dir, "benchmark")))


def digested(rows: DataFrame) -> DataFrame:
    items = F.array_sort(F.array_distinct("__items"))
    return rows.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), is_contaminated("__").alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(i) WHERE len(w) > 0),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, greatest(1, len(w) - n + 2))) t(i)),
m AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
q AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN q USING (r)
"""
