"""The file system that holds a path, through Spark, wherever it is: folders are looked for, listed, renamed and deleted."""

from __future__ import annotations

from pyspark.sql import SparkSession


def system_of(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = system_of(spark, path)
    return system.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, sorted; nothing where there is none."""
    system, where = system_of(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def changed_ms(spark: SparkSession, path: str) -> int:
    system, where = system_of(spark, path)
    return system.getFileStatus(where).getModificationTime()


def size(spark: SparkSession, path: str) -> int:
    system, where = system_of(spark, path)
    return system.getContentSummary(where).getLength()


def rename(spark: SparkSession, source: str, target: str) -> None:
    """One step, so that readers find the whole folder or none; the target isn't there yet."""
    system, where = system_of(spark, target)
    system.mkdirs(where.getParent())
    if not system.rename(system_of(spark, source)[1], where):
        raise OSError(f"{source} could not become {target}")


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        system, where = system_of(spark, path)
        system.delete(where, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    system, where = system_of(spark, path)
    system.create(where, True).close()
