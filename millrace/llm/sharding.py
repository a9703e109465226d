"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts are one group that never parts. Groups are sorted by size with a range exchange; the driver
sees only how many groups there are of each size (no more sizes than the square root of twice all bytes) and packs them
size by size: each goes to the bin with the tightest remaining capacity that holds it, found in a balanced tree. What the
packing gives, runs of ranks and their bins, is applied to the sorted groups where they lie.

`shard_fixed` packs into as few bins of a given capacity as it can. `shard_even` packs into a given number of bins: groups
above an even share get a bin of their own, the others share the rest at the least capacity that best-fit-decreasing fills.

Defined results: a null text has the size 1 of an empty one and is grouped with it. Repeated rows stay in one shard and
take two slots. Slots follow doc_id, nulls first, then the text's crc32. Groups of one size are placed by their digest, so ties
are settled alike in every run. Only the two columns named are read, so others may have any name. A very long text is measured
and hashed as one value. No rows give no rows.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_arrow, stored


class CapacityTree:
    """A treap of (remaining capacity, bin): insert, and take the least pair that is not below a need."""

    def __init__(self):
        self.root, self.random = None, random.Random(0)

    def _split(self, node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._join(a[2], b)
            return a
        b[1] = self._join(a, b[1])
        return b

    def insert(self, remaining: int, bin_: int) -> None:
        a, b = self._split(self.root, (remaining, bin_))
        self.root = self._join(self._join(a, [(remaining, bin_), None, None, self.random.random()]), b)

    def take(self, need: int) -> tuple[int, int] | None:
        below, rest = self._split(self.root, (need, -1))
        if rest is None:
            self.root = below
            return None
        least, parent = rest, None
        while least[1] is not None:
            parent, least = least, least[1]
        if parent is None:
            rest = least[2]
        else:
            parent[1] = least[2]
        self.root = self._join(below, rest)
        return least[0]


def best_fit(sizes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> tuple[list[list[int]], int] | None:
    """sizes: (size, groups of that size), falling. Gives runs [groups, bin] in that order, and how many bins are used.

    With `bins` that many are open and no more are opened: None if they don't hold all.
    """
    tree, used, out = CapacityTree(), bins or 0, []
    for b in range(used):
        tree.insert(capacity, b)
    for size, many in sizes:
        while many:
            found = tree.take(size)
            if found is None:
                if bins is not None:
                    return None
                found = (max(capacity, size), used)
                used += 1
            remaining, b = found
            # The tightest bin stays the tightest while it holds another of that size.
            k = min(many, remaining // size)
            tree.insert(remaining - k * size, b)
            many -= k
            if out and out[-1][1] == b:
                out[-1][0] += k
            else:
                out.append([k, b])
    return out, used


def even_fit(sizes: list[tuple[int, int]], bins: int) -> list[list[int]]:
    """Runs [groups, bin] that fill `bins` bins as evenly as groups allow."""
    left, out, b = [list(x) for x in sizes], [], 0
    total = sum(s * n for s, n in sizes)
    while left and b < bins - 1 and left[0][0] * (bins - b) >= total:
        out.append([1, b])
        total -= left[0][0]
        left[0][1] -= 1
        if not left[0][1]:
            left.pop(0)
        b += 1
    if not left:
        return out
    rest = [(s, n) for s, n in left]
    low = max(-(-total // (bins - b)), rest[0][0])
    slack = 0
    while (found := best_fit(rest, low + slack, bins - b)) is None:
        slack = max(1, 2 * slack, low // 1_000_000)
    return out + [[k, b + x] for k, x in found[0]]


def _ranked(groups: DataFrame) -> tuple[DataFrame, str]:
    """groups (digest, weight) in falling order of weight, with `at`: partition and row, as the stored order has them."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.desc("weight"), F.asc("digest")]
    return stored(groups.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "shard-groups")


ROW_BITS = 33


def _offsets(rows: DataFrame, at: str, *keys: str) -> list:
    """Rows of each partition (and key): as many entries as partitions have keys."""
    return rows.groupBy(F.shiftrightunsigned(at, ROW_BITS).alias("p"), *keys).count().collect()


def _assigned(groups: DataFrame, pack) -> DataFrame:
    """(digest, shard); pack makes runs from (size, groups) pairs."""
    ranked, _ = _ranked(groups)
    sizes = sorted(((r.weight, r["count"]) for r in ranked.groupBy("weight").count().collect()), reverse=True)
    placed = pack(sizes)
    ends = np.cumsum([k for k, _ in placed], dtype=np.int64)
    shard = np.array([b for _, b in placed], np.int32)
    before, base = {}, 0
    for r in sorted(_offsets(ranked, "at")):
        before[r.p], base = base, base + r["count"]

    def run(batches):
        for batch in batches:
            at = batch.column("at").to_numpy()
            rank = np.array([before[p] for p in (at >> ROW_BITS).tolist()], np.int64) + (at & ((1 << ROW_BITS) - 1))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(shard[np.searchsorted(ends, rank, "right")], pa.int32())], ["of", "shard"])

    return map_arrow(ranked.select("digest", "at"), run, "of binary, shard int")


def _sharded(docs: DataFrame, pack, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows, at_rows = stored(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")), "shard-rows")
    groups, at_groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("weight")), "shard-weights")
    shards, at_shards = stored(_assigned(groups, pack), "shard-of")
    met = rows.join(shards, rows["digest"] == shards["of"]).select("doc_id", "size", "text_crc32", "shard")
    placed, at_placed = stored(met, "shard-placed")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc("shard"), F.asc_nulls_first("doc_id")]
    placed = placed.repartitionByRange(n, *order, "text_crc32").sortWithinPartitions(*order, "text_crc32")
    placed, _ = stored(placed.withColumn("at", F.monotonically_increasing_id()), "shard-order")
    forget(spark, at_rows, at_groups, at_shards, at_placed)
    base, within, past = [], {}, {}
    for r in sorted(_offsets(placed, "at", "shard"), key=lambda r: (r.p, r.shard)):
        base.append((r.p, r.shard, past.get(r.shard, 0) - within.get(r.p, 0)))
        past[r.shard] = past.get(r.shard, 0) + r["count"]
        within[r.p] = within.get(r.p, 0) + r["count"]
    # A row a partition and shard at most: rows lie in shard order, so partitions share few shards.
    shift = spark.createDataFrame(base, "p bigint, s int, shift bigint")
    met = placed.join(F.broadcast(shift), (F.shiftrightunsigned("at", ROW_BITS) == F.col("p")) & (F.col("shard") == F.col("s")))
    row = F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return met.select("doc_id", "size", "text_crc32", "shard", (row + F.col("shift")).alias("slot"))


def shard_even(docs: DataFrame, bins: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _sharded(docs, lambda sizes: even_fit(sizes, bins), id_col, text_col)


def shard_fixed(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As few shards of `capacity` bytes as best-fit-decreasing makes; a group above it has a shard of its own."""
    return _sharded(docs, lambda sizes: best_fit(sizes, capacity)[0], id_col, text_col)


def op6_sharding(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = shard_even(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
