"""Removal of every byte in a string of `width` bytes that starts at two places or more, over all documents.

A suffix sort finds them, in shards, each by external induced sorting (induced.py); what shares a string must be in one shard:

1. Of the 64-byte grams in each window of `width` bytes the one with the least hash (the rightmost of equals) is the
   window's anchor. Equal windows have equal anchors at equal offsets. An anchor with the windows it was chosen for is an
   occurrence; what those windows cover is its context. There is one occurrence for about 70 bytes.
2. Occurrences whose anchor is met once share no window with any other. Of those left, equal contexts are summed, and each
   context, cut out once, goes to its anchor's shard with whether it was met several times.
3. A shard is one text of contexts. Its suffixes are sorted with their common prefixes; windows whose prefix with a neighbour
   is `width` long are repeated, and all windows of a context that was met several times. They are handed back to every
   occurrence of the context.

Exchanges before the shards are keyed by a hash of content whose equal rows are summed before it, or join two stored tables.
A passage that a third of all documents share is one context in its shard but for where it begins and ends: there each
document has its own, all in one shard, which goes to disk beyond a task's memory. Anchor and context hashes, 64 bits each,
together name a context.

Defined results: null counts as empty; texts below `width` bytes keep all. Matches never cross documents. Rows repeated
with id and text repeat each other. No rows give no rows. Only the two columns named are read, so others may have any name.
A very long text is hashed in pieces that overlap by a window; where a piece ends, an occurrence is two.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_arrow, pieces, slices, stored, utf8_rows
from .hashing import SpanHashes
from .induced import repeated_places, scratch_file
from .wordcache import runs

GRAM = 64
PLACE_BITS = 28
OCCURRENCE = "doc_id bigint, tag bigint, anchor bigint, lo int, hi int, context bigint"
#: Bytes of contexts in a shard, on average; what a task holds of one before it goes to disk; the most names that it sorts
#: without recursion. They change what is held where, not the result.
SHARD_BYTES = 4 << 20
SHARD_ROOM = 96 << 20
SHARD_BASE = 2 << 20


def occurrences(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, lo, hi, context): windows from lo to hi of a text have that anchor; places within the text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.cumsum(sizes) - sizes
    n = len(flat) - width + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    spans = SpanHashes(flat)
    grams = spans.all(GRAM)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    # The hash's upper bits, then the place from the right: the least is the rightmost of the least hashes.
    least = ((grams >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS)) | (mask - (np.arange(len(grams), dtype=np.uint64) & mask))
    reach, have = width - GRAM + 1, 1
    while have * 2 <= reach:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if over := reach - have:
        least = np.minimum(least[:-over], least[over:])
    text_of = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(n)
    whole = text_of[:n] == text_of[width - 1 :]
    offset = ((mask - (least & mask)).astype(np.int64) - place) & int(mask)
    at = place + offset
    first = np.flatnonzero(whole & np.concatenate([[True], (at[1:] != at[:-1]) | ~whole[:-1]]))
    last = np.flatnonzero(whole & np.concatenate([(at[1:] != at[:-1]) | ~whole[1:], [True]]))
    anchor = at[first]
    context = spans.of(first, last + width) + np.uint64(0x9E3779B97F4A7C15) * (anchor - first).astype(np.uint64)
    text = text_of[first]
    return text, grams[anchor].view(np.int64), first - begins[text], last - begins[text], context.view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and a hash of the text tell documents apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _occurrence_rows(keyed: DataFrame, width: int) -> DataFrame:
    names = ["doc_id", "tag", "anchor", "lo", "hi", "context"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                for shift, texts in pieces(utf8_rows(part.column("text")), width - 1):
                    text, anchor, lo, hi, context = occurrences(texts, width)
                    own = pa.array(text)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(own), part.column("tag").take(own), pa.array(anchor), pa.array(lo + shift, pa.int32()), pa.array(hi + shift, pa.int32()), pa.array(context)], names)

    return map_arrow(keyed.filter(F.octet_length("text") >= width), run, OCCURRENCE)


def _body_rows(wanted: DataFrame, width: int) -> DataFrame:
    """wanted: (text, spans array<struct<lo, hi, anchor, context, several>>). A row a span, with its bytes."""
    names = ["anchor", "context", "windows", "several", "body"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(s["anchor"], s["context"], s["hi"] - s["lo"] + 1, s["several"], x[s["lo"] : s["hi"] + width]) for x, own in zip(utf8_rows(part.column("text")), part.column("spans").to_pylist(), strict=True) for s in own]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return map_arrow(wanted, run, "anchor bigint, context bigint, windows int, several boolean, body binary")


class Shard:
    """The bodies of a task in one text: 1 behind each, 0 at the end, bytes from 2; a mapped file beyond `room` bytes."""

    def __init__(self, room: int = SHARD_ROOM, base: int = SHARD_BASE):
        self.room, self.base, self.parts, self.held, self.file, self.size = room, base, [], 0, None, 0
        self.columns: list[tuple] = []

    def add(self, batch: pa.RecordBatch) -> None:
        bodies = batch.column("body").to_pylist()
        sizes = np.array([len(x) for x in bodies], np.int64)
        ends = np.cumsum(sizes + 1)
        part = np.ones(int(ends[-1]), np.int16)
        part[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int16) + 2
        own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "context", "windows", "several"))
        self.columns.append((self.size + ends - sizes - 1, *own))
        self.size += len(part)
        if self.file is None:
            # No UTF-8 has the bytes 254 and 255.
            self.parts.append(part.astype(np.uint8) if part.max() < 256 else part)
            self.held += self.parts[-1].nbytes
            if self.held > self.room:
                self.file, before, self.parts = scratch_file(), self.parts, []
                for x in before:
                    self.file.write(x.astype(np.int16).tobytes())
        else:
            self.file.write(part.tobytes())

    def text(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate([*self.parts, np.zeros(1, np.uint8)])
        self.file.write(np.zeros(1, np.int16).tobytes())
        self.file.flush()
        return np.memmap(self.file, np.int16, "r", shape=(self.size + 1,))

    def repeats(self, width: int, limit: int = 10_000):
        """(anchor, context, ranges) of the contexts with repeated windows, ranges of windows with exclusive ends."""
        if not self.columns:
            return
        begin, anchor, context, windows, several = (np.concatenate(x) for x in zip(*self.columns, strict=True))
        windows = windows.astype(np.int64)
        again = repeated_places(self.text(), 258, width, room=self.room, base=self.base)
        for k in range(0, len(begin), limit):
            n, own = windows[k : k + limit], slice(k, k + limit)
            body = np.repeat(np.arange(len(n)), n)
            flag = again[runs(begin[own], n)] | several[own][body]
            place = np.arange(len(flag)) - np.repeat(np.cumsum(n) - n, n)
            same = np.concatenate([[False], body[1:] == body[:-1]])
            first = np.flatnonzero(flag & ~(same & np.concatenate([[False], flag[:-1]])))
            last = np.flatnonzero(flag & ~np.append(same[1:] & flag[1:], False))
            count = np.bincount(body[first], minlength=len(n))
            found = np.flatnonzero(count)
            ranges = pa.StructArray.from_arrays([pa.array(place[first], pa.int32()), pa.array(place[last] + 1, pa.int32())], ["s", "e"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[found])]), pa.int32()), ranges)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[own][found]), pa.array(context[own][found]), lists], ["anchor_", "context_", "ranges"])


def _sorted_rows(bodies: DataFrame, width: int, shard_bytes: int, room: int, base: int) -> DataFrame:
    """(anchor_, context_, ranges): each shard of bodies is sorted; shards grow in number with the bytes there are."""
    total = bodies.agg(F.sum(F.octet_length("body").cast("bigint"))).first()[0] or 0
    shards = max(int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))

    def run(batches):
        shard = Shard(room, base)
        for batch in batches:
            if batch.num_rows:
                shard.add(batch)
        yield from shard.repeats(width)

    return map_arrow(bodies.repartition(shards, "anchor"), run, "anchor_ bigint, context_ bigint, ranges array<struct<s:int,e:int>>")


def _same(a: DataFrame, b: DataFrame, *keys: str):
    out = F.lit(True)
    for k in keys:
        out = out & (a[k].eqNullSafe(b[f"{k}_"]) if k == "doc_id" else a[k] == b[f"{k}_"])
    return out


def _named(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{k}_" for k in keys})


def repeated_ranges(keyed: DataFrame, width: int, shard_bytes: int = SHARD_BYTES, room: int = SHARD_ROOM, base: int = SHARD_BASE) -> DataFrame:
    """(doc_id_, tag_, ranges array<struct<s, e>>) of documents with repeated windows; ranges may overlap."""
    spark, gone = keyed.sparkSession, []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out, path = stored(df, tag)
        gone.append(path)
        return out

    every = keep(_occurrence_rows(keyed, width), "spans-all")
    twice = keep(_named(every.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchor"), "spans-anchors")
    met = keep(every.join(twice, _same(every, twice, "anchor"), "left_semi"), "spans-met")
    forget(spark, gone[0], gone[1])
    one = F.min(F.struct("doc_id", "tag", "lo", "hi")).alias("one")
    contexts = met.groupBy("anchor", "context").agg((F.count(F.lit(1)) > 1).alias("several"), one).select("anchor", "context", "several", "one.*")
    # A document has one context for about 70 of its bytes.
    own = contexts.groupBy(F.col("doc_id").alias("doc_id_"), F.col("tag").alias("tag_")).agg(F.collect_list(F.struct("lo", "hi", "anchor", "context", "several")).alias("spans"))
    own = keep(own, "spans-contexts")
    # A document repeated with its id and text gives its spans twice, to the same effect.
    bodies = keep(_body_rows(keyed.join(own, _same(keyed, own, "doc_id", "tag")).select("text", "spans"), width), "spans-bodies")
    forget(spark, gone[3])
    again = keep(_sorted_rows(bodies, width, shard_bytes, room, base), "spans-sorted")
    forget(spark, gone[4])
    found = met.join(again, _same(met, again, "anchor", "context"))
    moved = F.transform("ranges", lambda r: F.struct((F.col("lo") + r["s"]).alias("s"), (F.col("lo") + r["e"] + (width - 1)).alias("e")))
    ranges = found.select("doc_id", "tag", moved.alias("own")).groupBy(F.col("doc_id").alias("doc_id_"), F.col("tag").alias("tag_")).agg(F.flatten(F.collect_list("own")).alias("ranges"))
    out, _ = stored(ranges, "spans-ranges")
    forget(spark, *gone)
    return out


CUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _cut_rows(joined: DataFrame, digest: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, removed, spans, kept = [], [], [], []
                for text, ranges in zip(utf8_rows(part.column("text")), part.column("ranges").to_pylist(), strict=True):
                    gone, n = [], 0
                    for s, e in sorted((r["s"], r["e"]) for r in ranges or ()):
                        if gone and s <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], e)
                        else:
                            gone.append([s, e])
                    at, left = 0, []
                    for s, e in gone:
                        left.append(text[at:s])
                        n, at = n + e - s, e
                    rest = b"".join([*left, text[at:]])
                    sizes.append(len(text))
                    removed.append(n)
                    spans.append(len(gone))
                    kept.append(hashlib.sha256(rest).digest() if digest else rest)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_arrow(joined, run, CUT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, digest: bool = False, shard_bytes: int = SHARD_BYTES, room: int = SHARD_ROOM, base: int = SHARD_BASE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept has the remaining bytes, or their sha256 with digest=True. A task holds
    about `room` bytes of its shard's text and of each queue, and sorts up to `base` names without recursion."""
    if width < 2 * GRAM:
        raise ValueError(f"width must be at least {2 * GRAM}")
    keyed = _keyed(docs, id_col, text_col)
    ranges = repeated_ranges(keyed, width, shard_bytes, room, base)
    joined = keyed.join(ranges, _same(keyed, ranges, "doc_id", "tag"), "left").select("doc_id", "text", "ranges")
    return _cut_rows(joined, digest)


def op9_repeated_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
