"""Nearest vectors by inner product through a permutation index.

A vector is represented by its pivots in order of nearness. It is posted with its place in the lists of its POSTED nearest
pivots; a query goes through the lists of its own nearest pivots and sums, for each vector met, what their places have in common.
That sum orders vectors by the footrule distance of the two permutations: every vector has the same places 0 to POSTED, POSTED
standing for all pivots beyond, and |a - b| = a + b - 2 min(a, b). The best by footrule, times the vector's length where lengths differ, are ranked again by
the product itself.

Vectors are dealt into blocks of near-equal length (norm), as for vectors of one length the angle decides the product; each block has its own lists, so no list is one task's however common its pivot is. Queries go to all blocks in blocks of
their own. Of each block a query ranks SHARE of the vectors and LEAST more, and all that tie with the last of them, so copies of one
vector are found or left out together.

Pivots come from a bounded sample (SAMPLE vectors, by a hash of their ids), each the farthest from those before it, so a
large group of near copies takes up no more of them than others.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Of
rows with one id the least vector counts (repeated rows: once). Vectors shorter than the longest are zero beyond their end. Ties go
to the smaller id; no rows give no rows. Further columns, whatever their names, change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_arrow, stored

#: Pivots, and how many of a vector's nearest ones have it in their lists; two places of 127 still fit a byte.
PIVOTS, POSTED = 192, 127
#: Vectors from which pivots are chosen.
SAMPLE = 2048
#: Of a block's vectors, those that are ranked again: a share and so many more.
SHARE, LEAST = 0.2, 64
BLOCK = 4096
#: Queries that are compared with a block at once.
TOGETHER = 64
#: Rows (blocks of queries) that a Python worker is handed at once.
ROWS_AT_ONCE = "16"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector array<float or double>): one row an id, of vectors that take part."""
    kind = "float" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter("vec_id IS NOT NULL AND vector IS NOT NULL").filter(~broken & F.exists("vector", lambda x: x != 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list column, zero beyond their end: [rows, width]."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(column), width), flat.dtype)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def farthest(sample: np.ndarray, count: int) -> np.ndarray:
    """Directions of the sample, each the least like those before it; fewer if there are no more different ones."""
    rows = sample.astype(np.float64)
    rows /= np.linalg.norm(rows / np.abs(rows).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(rows).max(axis=1, keepdims=True)
    chosen, likeness = [0], rows @ rows[0]
    while len(chosen) < min(count, len(rows)):
        k = int(np.argmin(likeness))
        if likeness[k] > 1 - 1e-9:
            break
        chosen.append(k)
        likeness = np.maximum(likeness, rows @ rows[k])
    return rows[chosen]


def places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """POSTED less the place of each pivot among a vector's nearest, 0 beyond: [vectors, pivots]. What two vectors have in
    common at a pivot is the lesser."""
    order = np.argsort(-(vectors.astype(np.float64) @ pivots.T), axis=1, kind="stable")
    out = np.zeros(order.shape, np.uint8)
    posted = min(POSTED, len(pivots))
    np.put_along_axis(out, order[:, :posted], np.arange(posted, 0, -1, dtype=np.uint8)[None, :], axis=1)
    return out


def in_common(lists: np.ndarray, own: np.ndarray) -> np.ndarray:
    """lists [pivots, vectors], own [queries, pivots]: the summed places in common, [queries, vectors]."""
    total = np.zeros((len(own), lists.shape[1]), np.uint16)
    for p in range(0, len(lists) - 1, 2):
        total += np.minimum(lists[p], own[:, p, None]) + np.minimum(lists[p + 1], own[:, p + 1, None])
    if len(lists) % 2:
        total += np.minimum(lists[-1], own[:, -1, None])
    return total


def best_of_block(ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and products of its k nearest of the block, among the best by footrule."""
    common, out = in_common(lists, own).astype(np.float32), []
    # Of vectors as near by footrule the longer has the larger product; for one length this is the order by footrule.
    common = (common - common.mean(axis=1, keepdims=True)) * np.sqrt(np.einsum("ij,ij->i", vectors, vectors)).astype(np.float32)
    taken = min(len(ids), int(np.ceil(SHARE * len(ids))) + LEAST)
    least = np.partition(common, len(ids) - taken, axis=1)[:, len(ids) - taken]
    for row, (query_id, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
        found = np.flatnonzero((common[row] >= least[row]) & (ids != query_id))
        # Row by row in double precision, so that equal vectors have equal products.
        product, found = np.einsum("ij,j->i", vectors[found], query), ids[found]
        if len(found) > k:
            near = product >= np.partition(product, len(found) - k)[len(found) - k]
            product, found = product[near], found[near]
        order = np.lexsort((found, -product))[:k]
        out.append((found[order], product[order]))
    return out


def build(vectors: DataFrame, pivots: np.ndarray, width: int, rows: int) -> tuple[DataFrame, str]:
    """The index, stored: a row a block with its ids, vectors and lists. vectors: usable()."""
    kind = np.float32 if vectors.schema["vector"].dataType.elementType.typeName() == "float" else np.float64

    def block(at: int, ids: list[np.ndarray], held: list[np.ndarray]) -> pa.RecordBatch:
        v = np.concatenate(held)
        posted = np.ascontiguousarray(places(v, pivots).T)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.concatenate(ids), v, posted))], ["block", "ids", "vectors", "lists"])

    def run(batches):
        from pyspark import TaskContext

        part, cut, ids, held, n = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            own, v = batch.column("vec_id").to_numpy(), matrix(batch.column("vector"), width).astype(kind)
            start = 0
            while start < len(own):
                stop = min(len(own), start + BLOCK - n)
                ids.append(own[start:stop])
                held.append(v[start:stop])
                n += stop - start
                start = stop
                if n == BLOCK:
                    yield block((part << 32) + cut, ids, held)
                    cut, ids, held, n = cut + 1, [], [], 0
        if n:
            yield block((part << 32) + cut, ids, held)

    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dealt = vectors.withColumn("norm", norm).repartitionByRange(max(1, -(-rows // BLOCK)), "norm", "vec_id").select("vec_id", "vector")
    return stored(map_arrow(dealt, run, "block bigint, ids binary, vectors binary, lists binary"), "permutation-index")


def search(index: DataFrame, queries: DataFrame, pivots: np.ndarray, width: int, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each of queries (vec_id, vector), their own ids left out."""
    spark = index.sparkSession
    kind = np.float32 if queries.schema["vector"].dataType.elementType.typeName() == "float" else np.float64

    def grouped(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                v = matrix(part.column("vector"), width).astype(kind)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (part.column("vec_id").to_numpy(), v, places(v, pivots))], ["ids", "vectors", "lists"])

    asked, at_asked = stored(map_arrow(queries, grouped, "ids binary, vectors binary, lists binary"), "permutation-queries")
    # Every block of the index is asked by every block of queries, and stands before those that are sent to it.
    blocks = [r.block for r in index.select("block").collect()]  # a number for BLOCK vectors
    sent = asked.withColumn("block", F.explode(F.split(F.lit(",".join(map(str, blocks))), ",").cast("array<bigint>")))
    both = index.withColumn("asks", F.lit(False)).unionByName(sent.withColumn("asks", F.lit(True)))
    dealt = both.repartition(len(blocks), "block").sortWithinPartitions("block", "asks")

    def run(batches):
        held = None
        for batch in batches:
            for at, ids, vectors, lists, asks in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "vectors", "lists", "asks")), strict=True):
                own = np.frombuffer(ids, np.int64)
                v = np.frombuffer(vectors, kind).reshape(len(own), width).astype(np.float64)
                if not asks:
                    held = own, v, np.frombuffer(lists, np.uint8).reshape(len(pivots), len(own))
                    continue
                near = best_of_block(*held, own, v, np.frombuffer(lists, np.uint8).reshape(len(own), len(pivots)), k)
                ends = pa.array(np.cumsum([0, *(len(x) for x, _ in near)]), pa.int32())
                found = pa.StructArray.from_arrays([pa.array(np.concatenate([x[c] for x in near])) for c in (0, 1)], ["vec_id", "score"])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(ends, found)], ["query_id", "found"])

    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, ROWS_AT_ONCE)
    try:
        near, _ = stored(map_arrow(dealt, run, "query_id bigint, found array<struct<vec_id: bigint, score: double>>"), "permutation-near")
    finally:
        spark.conf.set(ARROW_ROWS, before)
    forget(spark, at_asked)
    return map_arrow(near.repartition("query_id").sortWithinPartitions("query_id"), lambda batches: merged(batches, k), "query_id bigint, rank int, vec_id bigint, score double")


def merged(batches, k: int):
    """The k best of each query, whose rows (query_id, found), one a block, follow each other; no more is held than a batch and
    one query's best."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)]

    def rows(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
        rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) + 1
        return [x[rank <= k] for x in (query, rank.astype(np.int32), vec, score)]

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "rank", "vec_id", "score"])

    for batch in batches:
        lists = batch.column("found")
        query = np.repeat(batch.column("query_id").to_numpy(), np.diff(lists.offsets.to_numpy()))
        found = lists.flatten()
        best = rows(*(np.concatenate([x, y]) for x, y in zip(held, (query, found.field("vec_id").to_numpy(), found.field("score").to_numpy()), strict=True)))
        last = best[0] == best[0][-1] if len(best[0]) else np.zeros(0, bool)
        held = [best[c][last] for c in (0, 2, 3)]
        yield out([x[~last] for x in best])
    yield out(rows(*held))


def op11_nearest_vectors(spark: SparkSession, embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k nearest of each vector whose id is divisible by `every`."""
    vectors, at_vectors = stored(usable(embeddings), "vectors")
    seen = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = seen.width or 0
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    pivots = farthest(matrix(sample.column("vector").combine_chunks(), width), PIVOTS)
    index, _ = build(vectors, pivots, width, seen.n)
    out = search(index, vectors.filter(F.col("vec_id") % every == 0), pivots, width, k)
    forget(spark, at_vectors)
    return out
