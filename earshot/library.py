"""The engine's tables in one place; rollups are planned from listens unless stored ones are given.

With a ``store``, a folder that all executors share, each rollup is written there when it is first asked for
and read back from then on: by month and, within a month, in the order of users, so that the days of a period and
the listener reach the scan. A store belongs to one content of the tables, so its folder is named after a digest of
the files that they come from, and a library whose tables change has none until it is given a new one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import rollups
from .operators.numbering import cut

#: Rollups that are stored by month of their day.
DAYS = ("daily", "clock")
#: Rows of a stored rollup that one task sorts and writes.
_ROWS_SORTED = 524_288
_MANIFEST = "name string, folder string, written timestamp"


def content_digest(*tables: DataFrame) -> str:
    """Changes with any file of the tables: a sum over names, sizes and times of the files, so in any order of these."""
    files = None
    for i, table in enumerate(tables):
        own = table.select(F.lit(i).alias("table"), *(F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_modification_time")))
        files = own if files is None else files.unionByName(own)
    total = files.distinct().agg(F.sum(F.xxhash64(*files.columns).cast("decimal(20, 0)"))).first()[0]
    return f"{int(total or 0) % (1 << 64):016x}"


def write_rollup(df: DataFrame, name: str, path: str) -> None:
    """A rollup in its stored form, in a folder of its own; it is worked out once, and sorted in ranges of bounded size."""
    df = cut(df)
    ranges = df.count() // _ROWS_SORTED + 1
    if name in DAYS:
        df = df.withColumn("month", F.date_format("day", "yyyy-MM"))
        df.repartitionByRange(ranges, "month", "user_id").sortWithinPartitions("month", "user_id").write.partitionBy("month").parquet(path)
    else:
        first = [c for c in ("user_id", "entity_type", "entity_id") if c in df.columns]
        df.repartitionByRange(ranges, *first).sortWithinPartitions(*first).write.parquet(path)


def _listed(spark: SparkSession, store: str, name: str) -> str | None:
    """The folder of a rollup that the store's manifest names; the first row for it counts."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{store}/manifest").where(F.col("name") == name)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # no rollup has been written yet
    found = rows.orderBy("written", "folder").first()
    return found and found.folder


@dataclass
class Library:
    listens: DataFrame
    songs: DataFrame
    artists: DataFrame
    albums: DataFrame
    song_artists: DataFrame
    album_artists: DataFrame
    song_albums: DataFrame
    users: DataFrame
    sources: DataFrame
    blacklist: DataFrame
    now_playing: DataFrame | None = None
    aliases: DataFrame | None = None
    stored: dict[str, DataFrame] = field(default_factory=dict)
    store: str | None = None

    def _rollup(self, name: str, plan) -> DataFrame:
        if name not in self.stored:
            self.stored[name] = plan() if self.store is None else self._kept(name, plan)
        return self.stored[name]

    def _kept(self, name: str, plan) -> DataFrame:
        spark = self.listens.sparkSession
        folder = _listed(spark, self.store, name)
        if folder is None:  # readers see a rollup once it is whole, as its row is written last
            folder = f"{self.store}/{name}-{uuid.uuid4().hex}"
            write_rollup(plan(), name, folder)
            row = spark.range(1).select(F.lit(name).alias("name"), F.lit(folder).alias("folder"), F.current_timestamp().alias("written"))
            row.coalesce(1).write.mode("append").parquet(f"{self.store}/manifest")
            folder = _listed(spark, self.store, name)
        return spark.read.parquet(folder)

    def changed(self, **tables: DataFrame | None) -> Library:
        """The library with other tables; rollups of the old ones are left behind, with their store."""
        return replace(self, **tables, stored={}, store=None)

    def kept_in(self, folder: str) -> Library:
        """The library with its rollups stored under ``folder``, in a store of its own."""
        return replace(self, stored={}, store=f"{folder}/store-{uuid.uuid4().hex}")

    @property
    def eligible(self) -> DataFrame:
        return self._rollup("eligible", lambda: rollups.eligible_listens(self.listens, self.songs))

    @property
    def daily(self) -> DataFrame:
        return self._rollup("daily", lambda: rollups.daily(self.eligible))

    @property
    def clock(self) -> DataFrame:
        return self._rollup("clock", lambda: rollups.clock(self.eligible))

    @property
    def first_listens(self) -> DataFrame:
        return self._rollup("first_listens", lambda: rollups.first_listens(self.eligible, self.song_albums, self.song_artists))

    @property
    def global_stats(self) -> DataFrame:
        return self._rollup("global_stats", lambda: rollups.global_stats(self.eligible, self.song_albums, self.song_artists))
