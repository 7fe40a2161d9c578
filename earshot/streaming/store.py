"""A store of listens and rollups that takes additions and deletions batch by batch."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rollups
from ..operators.runs import Runs

LISTEN = ["user_id", "song_id", "listened_at"]


def month_of(time: str) -> Column:
    return F.date_format(time, "yyyy-MM")


class Store(Runs):
    """Listens, daily counts, hours, plays by user and song, and last times, in runs (see Runs); days lie by month.

    Of a listen the latest batch tells whether it is there. Counts add up, deletions as negative ones, and rows that
    cancel out go. An extreme (a first or last time) counts
    from the latest row that sets it anew, which a deletion of the extreme itself writes; older rows are void.
    Albums and artists come in when a table is read, by the bridges of then.
    """

    KEYS = {"listens": LISTEN, "daily": ["user_id", "song_id", "day"], "clock": ["user_id", "day", "hour"], "plays": ["user_id", "song_id"], "last": ["user_id"]}
    SCHEMAS = {
        "listens": "id long, user_id long, song_id long, listened_at timestamp_ntz, client string, duration_played_ms long, asof long, live boolean, month string",
        "daily": "user_id long, song_id long, day date, listen_count long, played_ms long, month string",
        "clock": "user_id long, day date, hour long, listen_count long, month string",
        "plays": "user_id long, song_id long, plays long, played_ms long, first_at timestamp_ntz, asof long, reset boolean",
        "last": "user_id long, last_at timestamp_ntz, asof long, reset boolean",
    }
    PARTED = {"listens": "month", "daily": "month", "clock": "month"}

    def added_up(self, name: str, rows: DataFrame) -> DataFrame:
        keys, extreme = self.KEYS[name], {"plays": ("first_at", F.array_min), "last": ("last_at", F.array_max)}.get(name)
        month = [F.first("month").alias("month")] if "month" in rows.columns else []
        if name == "listens":
            latest = F.max_by(F.struct("id", "client", "duration_played_ms", "asof", "live"), "asof").alias("r")
            return rows.groupBy(*keys).agg(latest, *month).select(*keys, "r.*", "month")
        if extreme is None:
            counts = [c for c in rows.columns if c not in (*keys, "month")]
            out = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts), *month)
            return out.where(" OR ".join(f"{c} <> 0" for c in counts))  # no count, but a time, is part of what older runs hold
        column, best = extreme
        sums = [F.sum(c).alias(c) for c in ("plays", "played_ms") if c in rows.columns]
        out = rows.groupBy(*keys).agg(*sums, F.max("asof").alias("asof"), F.max(F.when(F.col("reset"), F.col("asof"))).alias("_since"), F.collect_list(F.struct("asof", F.col(column).alias("at"))).alias("_all"))
        valid = F.filter("_all", lambda x: x["asof"] >= F.coalesce(F.col("_since"), x["asof"]))
        out = out.withColumns({column: best(F.transform(valid, lambda x: x["at"])), "reset": F.col("_since").isNotNull()}).drop("_since", "_all")
        return out if name == "last" else out.where("plays <> 0 OR played_ms <> 0 OR first_at IS NOT NULL OR reset")

    def listens(self, months: DataFrame | list[str] | None = None) -> DataFrame:
        return self.table("listens", months).where("live").drop("asof", "live", "month")

    def daily(self, months: list[str] | None = None) -> DataFrame:
        return self.table("daily", months).where("listen_count > 0").drop("month")

    def clock(self, months: list[str] | None = None) -> DataFrame:
        return self.table("clock", months).where("listen_count > 0").drop("month")

    def per_user(self, song_albums: DataFrame, song_artists: DataFrame) -> DataFrame:
        """As rollups.per_user: users and songs, given to albums and artists when they are read, by the bridges of then."""
        songs = self.table("plays").where("plays > 0").select("user_id", "song_id", "plays", "played_ms", "first_at")
        spread = rollups.attributed(songs, song_albums, song_artists)
        return spread.groupBy(*rollups.PER_USER).agg(F.sum("plays").alias("plays"), F.sum("played_ms").alias("played_ms"), F.min("first_at").alias("first_at"))

    def first_listens(self, song_albums: DataFrame, song_artists: DataFrame) -> DataFrame:
        return self.per_user(song_albums, song_artists).select(*rollups.PER_USER, "first_at")

    def global_stats(self, song_albums: DataFrame, song_artists: DataFrame) -> DataFrame:
        return rollups.totals(self.per_user(song_albums, song_artists))

    def streaks(self) -> DataFrame:
        """Runs of days in any order of arrival: a late day joins what lies on both sides, a deleted one parts it."""
        return rollups.streaks(self.clock())

    def user_state(self, today: date) -> DataFrame:
        last = self.table("last").where("last_at IS NOT NULL").select("user_id", F.col("last_at").alias("listened_at"))
        return rollups.user_state(last, self.clock(), today)
