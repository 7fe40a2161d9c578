"""Tables in a shared folder that change batch by batch, kept as sorted runs that are merged level by level."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version long, runs array<struct<level: int, first: long, last: long, folder: string>>"


class Runs:
    """Tables each of which is what its runs add up to.

    A batch writes a run of its own keys. Once a level has ``fan`` runs they are added up into one of the next
    level, so a row is written as often as the history has levels, which is the logarithm of the number of batches,
    and a read adds up fewer than ``fan`` runs a level. Where a table has a partition column a run holds only the
    partitions that its batches touched, and a read of some of them opens only these; within, rows are in the order
    of the key. What is live is one row of the manifest, written last: readers and restarts see the version before
    until then, and a replayed batch that the manifest has can be left out. Runs that were merged are left for the
    storage's own retention.
    """

    #: Columns of each table, what identifies a row, and the column that parts it, if any.
    SCHEMAS: dict[str, str] = {}
    KEYS: dict[str, list[str]] = {}
    PARTED: dict[str, str] = {}

    def __init__(self, spark: SparkSession, path: str, fan: int = 8):
        self.spark, self.path, self.fan = spark, path, fan

    def added_up(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows of one key in one; associative, with later batches told apart by a column if that matters."""
        raise NotImplementedError

    def merged(self, runs: list) -> dict[str, DataFrame]:
        """The tables of neighbouring runs as those of one."""
        return {name: self.added_up(name, self._read(name, runs)) for name in self.SCHEMAS}

    def manifest(self) -> tuple[int, list]:
        """(version, live runs with level, first and last batch and folder, oldest first)."""
        try:
            row = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, []
        return row.version, sorted(row.runs, key=lambda r: r["first"])

    def last_batch(self) -> int:
        return max((r["last"] for r in self.manifest()[1]), default=-1)

    def _columns(self, name: str) -> list[str]:
        return [f.split(" ")[0] for f in self.SCHEMAS[name].split(", ")]

    def _read(self, name: str, runs: list) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        out = None
        for r in runs:
            part = self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{r['folder']}/{name}")
            out = part if out is None else out.unionByName(part)
        return out

    def _write(self, folder: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            parted = self.PARTED.get(name)
            by = [*([parted] if parted else []), *self.KEYS[name]]
            writer = df.repartitionByRange(*by).sortWithinPartitions(*by).select(*self._columns(name)).write.mode("overwrite")
            (writer.partitionBy(parted) if parted else writer).parquet(f"{folder}/{name}")

    def add(self, batch_id: int, tables: dict[str, DataFrame]) -> None:
        """A run of level 0, and runs of higher levels where levels are full; one new version of the manifest."""
        version, runs = self.manifest()
        folder = f"{self.path}/runs/{batch_id}-{uuid.uuid4().hex}"
        self._write(folder, tables)
        runs = [*runs, {"level": 0, "first": batch_id, "last": batch_id, "folder": folder}]
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= self.fan:
            folder = f"{self.path}/runs/{full[0]['first']}-{full[-1]['last']}-{uuid.uuid4().hex}"
            self._write(folder, self.merged(full))
            runs = [r for r in runs if r["level"] != level] + [{"level": level + 1, "first": full[0]["first"], "last": full[-1]["last"], "folder": folder}]
            runs.sort(key=lambda r: r["first"])
            level += 1
        rows = [(version + 1, [(r["level"], r["first"], r["last"], r["folder"]) for r in runs])]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def table(self, name: str, parts: DataFrame | list | None = None, of: DataFrame | None = None, runs: list | None = None) -> DataFrame:
        """The table, or some of its partitions: a list of them, or a DataFrame as small as their number; or what has
        a key among ``of``. Tables that are read together should see the same ``runs``."""
        rows = self._read(name, self.manifest()[1] if runs is None else runs)
        if of is not None:
            rows = rows.join(of, of.columns, "left_semi")
        if isinstance(parts, list):
            rows = rows.where(F.col(self.PARTED[name]).isin(parts))
        elif parts is not None:
            rows = rows.join(F.broadcast(parts), self.PARTED[name], "left_semi")
        return self.added_up(name, rows)
