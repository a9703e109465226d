"""Tables behind numbered lists of the folders that count: readers see whole versions, old ones stay for those who read them.

A write leaves new folders and then a list that names all that count now; lists are numbered, put in place by a rename and never
overwritten, and the highest one counts. A writer that fails at any step leaves the version before it in force. Lists go, with the folders
that no other list names, when they are older than `keep_seconds`, neither of the last two, and not pinned by a reader. One
writer at a time. A list also has the number of the last batch of a stream that is in it, so a batch that runs again changes nothing."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import SparkSession

from . import files

LISTED = "folder string, batch bigint"


class Versions:
    """Numbered lists of folders below a path; what a folder holds is the table's matter."""

    def __init__(self, spark: SparkSession, path: str, keep_seconds: int = 0):
        self.spark, self.path, self.keep_seconds = spark, path.rstrip("/"), keep_seconds

    def _list(self, version: int) -> str:
        return f"{self.path}/_versions/{version:08d}"

    def _lists(self) -> list[int]:
        """The complete lists, the oldest first."""
        return sorted(int(n) for n in files.names(self.spark, f"{self.path}/_versions") if n.isdigit() and files.exists(self.spark, f"{self._list(int(n))}/_SUCCESS"))

    def exists(self) -> bool:
        return bool(self._lists())

    def version(self) -> int:
        """The version in force; 0 before the first one."""
        return max(self._lists(), default=0)

    def _listed(self, version: int) -> tuple[list[str], int]:
        """A version's folders and the last batch that is in it, -1 if none is."""
        rows = self.spark.read.schema(LISTED).parquet(self._list(version)).collect()  # as many as a table has folders
        return sorted(r.folder for r in rows if r.folder), max((r.batch for r in rows), default=-1)

    def folders(self, version: int | None = None) -> list[str]:
        lists = self._lists()
        return self._listed(version or lists[-1])[0] if lists else []

    def last_batch(self) -> int:
        now = self.version()
        return self._listed(now)[1] if now else -1

    def _commit(self, version: int, folders: Iterable[str], batch: int) -> None:
        rows = [(f, batch) for f in folders] or [(None, batch)]
        staged, at = f"{self.path}/_versions/_staged-{version:08d}", self._list(version)
        self.spark.createDataFrame(rows, LISTED).coalesce(1).write.mode("overwrite").parquet(staged)
        files.delete(self.spark, at)  # left incomplete, if at all
        files.rename(self.spark, staged, at)
        self._forget()

    def pin(self, reader: str) -> int:
        """Keeps the version in force for a reader until it lets go or pins a later one; its number."""
        now = self.version()
        files.mark(self.spark, f"{self.path}/_pins/{reader}@{now}")
        self.release(reader, now)
        return now

    def release(self, reader: str, but: int | None = None) -> None:
        files.delete(self.spark, *(f"{self.path}/_pins/{n}" for n in files.names(self.spark, f"{self.path}/_pins") if n.rpartition("@")[0] == reader and n.rpartition("@")[2] != str(but)))

    def _pinned(self) -> set[int]:
        return {int(n.rpartition("@")[2]) for n in files.names(self.spark, f"{self.path}/_pins") if "@" in n}

    def _forget(self) -> None:
        lists, pinned = self._lists(), self._pinned()
        late = (time.time() - self.keep_seconds) * 1000
        old = [v for v in lists[:-2] if v not in pinned and (not self.keep_seconds or files.changed_ms(self.spark, self._list(v)) < late)]
        if not old:
            return
        needed = {f for v in lists if v not in old for f in self._listed(v)[0]}
        for v in old:
            gone = [f for f in self._listed(v)[0] if f not in needed]
            files.delete(self.spark, *(f"{self.path}/{f}" for f in gone), self._list(v))
            for parent in {f.rpartition("/")[0] for f in gone} - {""}:
                if all(n.startswith("_S") for n in files.names(self.spark, f"{self.path}/{parent}")):
                    files.delete(self.spark, f"{self.path}/{parent}")

