"""Shared tables that several writers append to, one commit at a time.

A table is a folder of versions ``v=0000000001``, ``v=0000000002``, ... An append writes its rows to a staging folder of its own,
which no reader looks at, and then renames that folder to the next version. The rename is the only step that publishes anything, and it
fails if the version exists; so of two writers one wins, and the other checks its rows against what the winner added and
tries the version after it. The folder carries the batch's name, so a batch that is sent twice is in the table once.

The rename has to be atomic and must refuse a taken name: HDFS and local disks do, plain object stores do not.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BATCH = "_batch-"


@dataclass(frozen=True)
class Staged:
    """Rows of a batch that are written but not in the table; ``seen`` is the last version they were checked against."""

    batch: str
    folder: str
    seen: int


class SharedTable:
    """``keys`` are unique in the table; NULL counts as a value. A batch's repeated keys keep one row."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, *below: str):
        return self._hadoop.Path("/".join([self.path, *below]))

    def versions(self) -> dict[int, str]:
        """Committed versions with the names of their batches."""
        markers = self._fs.globStatus(self._path("v=*", f"{_BATCH}*"))
        places = [s.getPath() for s in markers or []]
        return {int(p.getParent().getName()[2:]): unquote(p.getName()[len(_BATCH):]) for p in places}

    def read(self, after: int = 0, until: int | None = None) -> DataFrame:
        """A snapshot: the rows of the versions that exist now, later appends do not change it."""
        chosen = [v for v in sorted(self.versions()) if v > after and (until is None or v <= until)]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/v={v:010d}" for v in chosen])

    def _missing_from(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        there = known.select(*[F.col(k).alias(f"_known_{i}") for i, k in enumerate(self.keys)])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_known_{i}")) for i, k in enumerate(self.keys)])
        return rows.join(there, same, "left_anti")

    def _write(self, rows: DataFrame, batch: str, seen: int) -> Staged:
        folder = f"{self.path}/_staging/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        self._fs.create(self._hadoop.Path(f"{folder}/{_BATCH}{quote(batch, safe='')}"), False).close()
        return Staged(batch, folder, seen)

    def stage(self, rows: DataFrame, batch: str) -> Staged:
        """Write the rows whose keys the table lacks; nothing is published."""
        seen = max(self.versions(), default=0)
        fresh = rows.select(*self.schema.names).dropDuplicates(self.keys)
        return self._write(self._missing_from(fresh, self.read(until=seen)) if seen else fresh, batch, seen)

    def commit(self, staged: Staged) -> int:
        """Publish staged rows as the next version and return it; a batch that the table has already is not added again."""
        while True:
            versions = self.versions()
            for version, batch in versions.items():
                if batch == staged.batch:
                    self._fs.delete(self._hadoop.Path(staged.folder), True)
                    return version
            last = max(versions, default=0)
            if last > staged.seen:          # others were faster: their rows are checked, not the whole table again
                rows = self.spark.read.schema(self.schema).parquet(staged.folder)
                checked = self._write(self._missing_from(rows, self.read(staged.seen, last)), staged.batch, last)
                self._fs.delete(self._hadoop.Path(staged.folder), True)
                staged = replace(checked, seen=last)
            if self._publish(staged.folder, last + 1):
                return last + 1

    def _publish(self, folder: str, version: int) -> bool:
        """Rename to a version; False if another writer took it."""
        gateway = self.spark.sparkContext._gateway
        no_options = gateway.new_array(self._hadoop.Options.Rename, 0)
        context = self._hadoop.FileContext.getFileContext(self._path().toUri(), self._conf)
        try:
            context.rename(self._hadoop.Path(folder), self._path(f"v={version:010d}"), no_options)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def append(self, rows: DataFrame, batch: str) -> int:
        return self.commit(self.stage(rows, batch))
