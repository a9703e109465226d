"""Exact dedup against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest before it meets the index, so
the sort-merge anti-join that finds new digests reads the index without a shuffle and sees no hot key. New digests are
appended with the batch's name; what stays is then read from the index, by a sort-merge join of its buckets. A batch that
runs again under its name finds its own digests and decides as it did before.

Defined results: null text counts as empty; empty texts are equal to each other. Of equal texts the row with the largest
id stays (null ids lose to any other); of repeated rows with that same id one stays. A text that an earlier batch brought
is dropped in favour of the id the index holds. An empty batch gives no rows. Only id and text are read, so other
columns may have any name. A very long text is hashed as one value; its lower-cased copy is all that a task holds besides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, forget, keep_named, stored, text_tag


class DigestIndex:
    """A catalog table (digest binary, keep_id bigint, batch string), bucketed and sorted by digest.

    Its number of buckets is fixed when it is made, from `buckets` or the session's shuffle partitions."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def create(self) -> None:
        """An empty table, where there is none."""
        if not self.exists():
            n = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self._write(self.spark.createDataFrame([], "digest binary, keep_id bigint, batch string"), n)

    def bucket_count(self) -> int:
        """As the catalog has it, whatever the session's settings are now."""
        told = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Num Buckets'").first()
        return int(told.data_type)

    def append(self, digests: DataFrame, batch: str) -> None:
        """Adds (digest, keep_id) rows that the index lacks; one file per bucket and call."""
        n = self.bucket_count()
        self._write(digests.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(n, "digest"), n)

    def _write(self, rows: DataFrame, buckets: int) -> None:
        rows.write.mode("append").format("parquet").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, tag, row): row tells repeated rows apart; store the result before row is used twice."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)).alias("digest"), text_tag(F.col(text_col)).alias("tag"),
    ).withColumn("row", F.monotonically_increasing_id())


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Deduplicates a batch within itself and against the index, and appends what is new.

    Returns per row: doc_id, keep_id, group_size (rows of the batch with that text), kept, digest, tag, row. `batch` names
    it, so that it can run again after a failure; without a name it can't.
    """
    batch = batch or uuid.uuid4().hex
    rows, _ = stored(digest_rows(docs, id_col, text_col), "digests")
    best = F.coalesce(F.max_by("row", "doc_id"), F.max("row"))
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("best_id"), best.alias("keep_row"), F.count(F.lit(1)).alias("group_size"))
    index.create()
    groups, path = stored(groups, "digest-groups")
    new = groups.hint("merge").join(index.read().select("digest"), "digest", "left_anti")
    index.append(new.select("digest", F.col("best_id").alias("keep_id")), batch)
    held = index.read().select("digest", "keep_id", (F.col("batch") == batch).alias("new"))
    decided, _ = stored(groups.hint("merge").join(held, "digest").select("digest", "keep_id", "keep_row", "group_size", "new"), "digest-decisions")
    forget(docs.sparkSession, path)
    # Both sides are plain scans behind an exchange, so that a hot digest's rows can be split over tasks.
    return rows.join(decided, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("new") & (F.col("row") == F.col("keep_row"))).alias("kept"), "digest", "tag", "row"
    )


def fresh_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"millrace_digests_{uuid.uuid4().hex}")


def dedup_alone(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """dedup() with an index for this run alone, which is dropped when the decisions are made."""
    index = fresh_index(docs.sparkSession)
    out = dedup(docs, index, id_col, text_col)
    index.drop()
    return out


def op3_exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = dedup_alone(docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns; without an index, against each other alone."""
    rows = dedup(docs, index, id_col, text_col, batch) if index else dedup_alone(docs, id_col, text_col)
    same = rows.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = same.groupBy("digest").agg(F.first("keep_id").alias("doc_id"), F.max("kept").alias("kept"), F.max_by("tag", "kept").alias("tag"))
    times = same.groupBy("digest", "tag").agg(F.count(F.lit(1)).alias("times")).withColumnsRenamed({"digest": "d", "tag": "t"})
    kept = kept.filter("kept").join(times, (F.col("digest") == F.col("d")) & (F.col("tag") == F.col("t"))).select("doc_id", "tag", "times")
    kept, _ = stored(kept, "digest-kept")
    return keep_named(docs, kept, id_col, text_col)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""
