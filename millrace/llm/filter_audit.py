"""How five document filters act together, in every order: what each removes, what it would have removed, its Shapley value.

A document's failures are a mask of five bits. Documents are counted by part (source) and mask, which is all that any order needs:
a step removes the documents whose mask has its filter and none before it. The orders are visited by adjacent transpositions
(each differs from the one before by two neighbours), so a visit updates two steps from the mask cells and keeps the other three;
a filter's Shapley sum gains what it removes in each order. The walk takes many parts at once, 32 cells a part.

Defined results: null text counts as empty, null source as the empty string; an empty text has no words and fails A, and E where a
smaller doc_id is empty too. A row without doc_id has no smaller one and is not smaller than any. Repeated rows count each; equal
doc_ids don't make each other fail E. Of several labels of one document any that is 1 counts. Very long texts are read whole; ties
have no bearing; no rows give no rows. Further columns, whatever their names, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_arrow, stored, table

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Of 100 words so many must be distinct; of 100 characters so many may be capitals.
LEAST_DISTINCT, MOST_CAPITALS = 50, 2
MARKS = "[#$%&*|]"
COUNTED = ["documents", "good", "toxic"]
#: Parts that a walk takes at once.
PARTS = 256


def own_failures(text: Column) -> Column:
    """The bits of the filters that a text decides alone, A to D; not null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    seen = F.struct(F.size(words).cast("bigint").alias("words"), F.size(F.array_distinct(words)).cast("bigint").alias("distinct"))
    # Words are split once: the struct is an argument, not a repeated expression.
    bits = F.transform(F.array(seen), lambda s: (s["words"] < LEAST_WORDS).cast("int") + 2 * (100 * s["distinct"] < LEAST_DISTINCT * s["words"]).cast("int"))[0]
    return bits + 4 * (100 * capitals > MOST_CAPITALS * F.length(text)).cast("int") + 8 * text.rlike(MARKS).cast("int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, documents, good, toxic): documents by part and failures."""
    spark, text = docs.sparkSession, F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), own_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows, at_rows = stored(rows, "audit-rows")
    # Digests met twice, with their least document: texts met once, most of them, take no part in the join.
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select(F.col("digest").alias("of"), "least")
    least, at_least = stored(least, "audit-least")
    of = labels.select(labels["doc_id"].cast("bigint").alias("labelled"), (labels["quality"] == 1).alias("good"), (labels["toxic"] == 1).alias("toxic"))
    of = of.filter("labelled IS NOT NULL AND (good OR toxic)").groupBy("labelled").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    of, at_of = stored(of, "audit-labels")
    met = rows.join(least, rows["digest"] == least["of"], "left").join(of, rows["doc_id"] == of["labelled"], "left")
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    cells = met.groupBy("part", (F.col("mask") + 16 * again).alias("mask")).agg(F.count(F.lit(1)).alias("documents"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    cells, _ = stored(cells, "audit-cells")
    forget(spark, at_rows, at_least, at_of)
    return cells


def adjacent_orders(n: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of n things, each with the place whose thing changed places with the next one (None at first)."""
    order, way = list(range(n)), [-1] * n
    yield order[:], None
    while True:
        movable = [(order[k], k) for k in range(n) if 0 <= k + way[order[k]] < n and order[k + way[order[k]]] < order[k]]
        if not movable:
            return
        thing, k = max(movable)
        to = k + way[thing]
        order[k], order[to] = order[to], order[k]
        for larger in range(thing + 1, n):
            way[larger] = -way[larger]
        yield order[:], min(k, to)


def walk(cells: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """cells [parts, masks, COUNTED] -> the orders; [orders, steps, parts, (kept, removed, redundant, unique, good, toxic lost)];
    the Shapley sums [filters, parts]."""
    n = len(FILTERS)
    mask = np.arange(1 << n)
    failing = [(mask >> f & 1).astype(bool) for f in range(n)]

    def step(f: int, before: int) -> np.ndarray:
        """What filter f does where the filters of `before` have been: five counts a part."""
        fails, removed = failing[f], failing[f] & (mask & before == 0)
        lost = cells[:, removed].sum(axis=1)
        redundant = cells[:, fails & ~removed, 0].sum(axis=1)
        kept = cells[:, mask & (before | 1 << f) == 0, 0].sum(axis=1)
        return np.stack([kept, lost[:, 0], redundant, cells[:, 1 << f, 0], lost[:, 1], lost[:, 2]], axis=1)

    names, seen = [], []
    now, shapley = np.zeros((n, len(cells), 6), np.int64), np.zeros((n, len(cells)), np.int64)
    for order, changed in adjacent_orders(n):
        for k in range(n) if changed is None else (changed, changed + 1):
            now[k] = step(order[k], sum(1 << f for f in order[:k]))
        for k, f in enumerate(order):
            shapley[f] += now[k, :, 1]
        names.append("".join(FILTERS[f] for f in order))
        seen.append(now.copy())
    return names, np.stack(seen), shapley


RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def audit(cells: DataFrame) -> DataFrame:
    """A row a part, order and step, of masks()."""
    n = len(FILTERS)
    per_part = cells.groupBy("part").agg(*(F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(1 << n))).alias(c) for c in COUNTED))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                rows = batch.slice(at, PARTS)
                held = np.stack([rows.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, 1 << n) for c in COUNTED], axis=2).astype(np.int64)
                names, seen, shapley = walk(held)
                first = np.array([[FILTERS.index(f) for f in name] for name in names])
                for k, part in enumerate(rows.column("part").to_pylist()):
                    own = seen[:, :, k].reshape(-1, 6)
                    columns = [pa.array([part] * len(own)), pa.array(np.repeat(names, n)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(names))), *(pa.array(own[:, c]) for c in range(6)), pa.array(shapley[first.ravel(), k])]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return map_arrow(per_part, run, RESULT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_PAIRS = ", ".join(f"('{''.join(p)}', {k + 1}, '{p[k]}', {sum(1 << FILTERS.index(f) for f in p[:k])})" for p in permutations(FILTERS) for k in range(len(FILTERS)))

ORACLE = f"""WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
    least AS (SELECT text AS of, min(doc_id) AS least FROM texts GROUP BY 1),
    marked AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
    failures AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN texts.doc_id > least THEN 16 ELSE 0 END AS mask
        FROM texts LEFT JOIN least ON text = of LEFT JOIN marked USING (doc_id)),
    cells AS (SELECT part, mask, count(*) AS documents, sum(good) AS good, sum(toxic) AS toxic FROM failures GROUP BY 1, 2),
    steps(filter_order, step, filter, earlier) AS (VALUES {_PAIRS}),
    bits(filter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    counted AS (SELECT part, filter_order, step, filter,
        sum(CASE WHEN mask & (earlier | bit) = 0 THEN documents ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN documents ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN documents ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN documents ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
        FROM cells, steps JOIN bits USING (filter) GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
    FROM counted"""
