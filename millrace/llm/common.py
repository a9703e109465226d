"""What the operators of this subpackage share: scratch tables, bounded text slices, ASCII folding."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_scratch: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one.

    Unset on a local master (tests): a temporary folder removed at exit. Unset on a cluster: below the warehouse,
    which is shared as well; never a machine's own temporary folder.
    """
    global _local_scratch
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _local_scratch, True)
    return _local_scratch


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/millrace/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: lineage is cut and lost executors cost no recomputation.

    What the write shuffled is deleted with it, not when the driver next happens to collect its garbage.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before) if before is not None else spark.conf.unset(SHUFFLE_CLEANUP)
    return spark.read.schema(df.schema).parquet(path), path


_shipped: set[str] = set()


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow, with this package sent to the workers where their path doesn't hold it already."""
    context, root = df.sparkSession.sparkContext, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    at_hand = root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (context.master.startswith("local[") and os.getcwd() == root)
    if not at_hand and context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        # The driver's own copy, which it serves to the workers until it ends.
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, True)
        context.addPyFile(shutil.make_archive(f"{folder}/millrace", "zip", root, "millrace"))
    return df.mapInArrow(run, schema)


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that nothing reads any more, through the file system that holds them."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most `limit` bytes of `column`, or one longer row alone: bounds what numpy holds at once."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def pieces(texts: list[bytes], overlap: int, limit: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """What slices() gave, with a shift of 0; of one text beyond `limit`, pieces with their place, each with `overlap` bytes of
    the next one, so numpy holds no more of a very long text than of a slice."""
    if len(texts) != 1 or len(texts[0]) <= limit + overlap:
        yield 0, texts
        return
    for at in range(0, max(1, len(texts[0]) - overlap), limit):
        yield at, [texts[0][at : at + limit + overlap]]


def utf8_rows(column: pa.Array) -> list[bytes]:
    """Each row's UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def free_prefix(columns: list[str]) -> str:
    """Underscores that no column's name begins with, for columns added on the way."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables below the shared folder; results that still read them must be written first."""
    forget(spark, f"{scratch_root(spark)}/millrace")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_tag(text: Column) -> Column:
    """A hash that, with the id, names a document whose id isn't unique."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keep_named(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs named by kept (doc_id, tag, times), once each; times is how many rows of docs have that name.

    Names met once, all of them as a rule, take a semi-join; only rows of repeated names are dealt out and reduced.
    """
    tag = free_prefix(docs.columns) + "tag"
    named = docs.withColumn(tag, text_tag(F.col(text_col)))

    def chosen(rows: DataFrame) -> DataFrame:
        return named.join(rows, (named[tag] == rows["tag"]) & named[id_col].cast("bigint").eqNullSafe(rows["doc_id"]), "left_semi")

    once, more = kept.filter("times = 1"), kept.filter("times > 1")
    if more.isEmpty():
        return chosen(once).drop(tag)
    return chosen(once).unionByName(chosen(more).dropDuplicates([id_col, tag])).drop(tag)
