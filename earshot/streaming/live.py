"""Rollups kept up to date from a stream of listens."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators import rollups
from ..operators.numbering import cut
from .store import LISTEN, Store, month_of

def fold_batch(store: Store, songs: DataFrame, batch: DataFrame, batch_id: int) -> None:
    """Add one micro-batch of listens, those with ``deleted`` (which may be missing) taken back.

    A listen is its user, song and time: one that the store has already is dropped, and a deletion of one that it
    lacks does nothing. Within a batch deletions come after additions. Only the months of the batch are looked at,
    unless a deletion takes away a first or last time; then the next one is sought in the listens of that user and
    song, or user. A batch that the store has already, so a replay, does nothing.
    """
    if batch_id <= store.last_batch():
        return
    gone = F.col("deleted") if "deleted" in batch.columns else F.lit(False)
    batch = batch.withColumn("_gone", F.coalesce(gone, F.lit(False)))
    columns = ["id", *LISTEN, "client", "duration_played_ms"]
    kinds = {"client": "string", "listened_at": "timestamp_ntz"}
    batch = batch.select(*(F.col(c).cast(kinds.get(c, "long")).alias(c) for c in columns), "_gone")
    adds = rollups.dedupe(batch.where("NOT _gone").select(*columns))
    deletes = batch.where("_gone").select(*LISTEN).distinct()
    keys = adds.select(*LISTEN).unionByName(deletes).distinct()
    months = keys.select(month_of("listened_at").alias("month")).distinct()
    present = store.listens(months).join(keys, LISTEN, "left_semi").select(*columns)
    new = adds.join(present.select(*LISTEN), LISTEN, "left_anti").join(deletes, LISTEN, "left_anti").select(*columns, F.lit(1).cast("long").alias("n"))
    removed = present.join(deletes, LISTEN, "left_semi").select(*columns, F.lit(-1).cast("long").alias("n"))
    signed = cut(new.unionByName(removed).withColumn("month", month_of("listened_at")))

    counting = lambda n: rollups.eligible_listens(signed.where(F.col("n") == n), songs).withColumn("n", F.lit(n).cast("long"))
    heard = cut(counting(1).unionByName(counting(-1)).withColumns({"month": month_of("listened_at"), "day": F.to_date("listened_at"), "hour": F.hour("listened_at").cast("long"), "played": F.col("n") * F.col("played_ms")}))
    plus = lambda c: F.when(F.col("n") > 0, F.col(c))
    stamps = {"asof": F.lit(batch_id).cast("long"), "reset": F.lit(False)}
    plays = heard.groupBy("user_id", "song_id").agg(F.sum("n").alias("plays"), F.sum("played").alias("played_ms"), F.min(plus("listened_at")).alias("first_at")).withColumns(stamps)
    last = signed.groupBy("user_id").agg(F.max(plus("listened_at")).alias("last_at")).withColumns(stamps)
    if not signed.where("n < 0").isEmpty():
        plays, last = _sought_again(store, songs, signed, heard, plays, last)
    store.add(
        batch_id,
        {
            "listens": signed.withColumns({"asof": stamps["asof"], "live": F.col("n") > 0}),
            "daily": heard.groupBy("user_id", "song_id", "day", "month").agg(F.sum("n").alias("listen_count"), F.sum("played").alias("played_ms")),
            "clock": heard.groupBy("user_id", "day", "hour", "month").agg(F.sum("n").alias("listen_count")),
            "plays": plays,
            "last": last,
        },
    )


def _sought_again(store: Store, songs: DataFrame, signed: DataFrame, heard: DataFrame, plays: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``plays`` and ``last`` of a batch with the extremes set anew whose own listens the batch deletes."""
    now = store.table("plays").select("user_id", "song_id", F.col("first_at").alias("_at"))
    firsts = cut(heard.where("n < 0").join(now, ["user_id", "song_id"]).where("listened_at <= _at").select("user_id", "song_id").distinct())
    now = store.table("last").select("user_id", F.col("last_at").alias("_at"))
    lasts = cut(signed.where("n < 0").join(now, "user_id").where("listened_at >= _at").select("user_id").distinct())
    columns = ["id", *LISTEN, "client", "duration_played_ms"]
    after = store.listens().select(*columns).join(signed.where("n < 0").select(*LISTEN), LISTEN, "left_anti").unionByName(signed.where("n > 0").select(*columns))
    if not firsts.isEmpty():
        left = rollups.eligible_listens(after.join(firsts, ["user_id", "song_id"], "left_semi"), songs).groupBy("user_id", "song_id").agg(F.min("listened_at").alias("_first"))
        again = firsts.join(left, ["user_id", "song_id"], "left").withColumn("_again", F.lit(True))
        plays = plays.join(again, ["user_id", "song_id"], "left").withColumns({"first_at": F.when(F.col("_again"), F.col("_first")).otherwise(F.col("first_at")), "reset": F.coalesce("_again", "reset")}).drop("_first", "_again")
    if not lasts.isEmpty():
        left = after.join(lasts, "user_id", "left_semi").groupBy("user_id").agg(F.max("listened_at").alias("_last"))
        again = lasts.join(left, "user_id", "left").withColumn("_again", F.lit(True))
        last = last.join(again, "user_id", "left").withColumns({"last_at": F.when(F.col("_again"), F.col("_last")).otherwise(F.col("last_at")), "reset": F.coalesce("_again", "reset")}).drop("_last", "_again")
    return plays, last


def start(listens: DataFrame, store: Store, songs: DataFrame, checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """Keep the store up to date with a stream (id, user_id, song_id, listened_at, client, duration_played_ms, perhaps deleted).

    ``every`` bounds the time of a batch, the source its rows: set maxOffsetsPerTrigger, maxFilesPerTrigger or
    rowsPerSecond where the stream is made.
    """
    writer = listens.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: fold_batch(store, songs, b, i))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def daily_counts(listens: DataFrame, late: str = "7 days") -> DataFrame:
    """(day, user_id, listen_count, played_ms) as a windowed stream, for eligible listens (see rollups.eligible)."""
    timed = listens.withColumn("listened_at", F.col("listened_at").cast("timestamp")).withWatermark("listened_at", late)
    return timed.groupBy(F.window("listened_at", "1 day").alias("w"), "user_id").agg(F.count("*").alias("listen_count"), F.sum("played_ms").alias("played_ms")).select(
        F.to_date("w.start").alias("day"), "user_id", "listen_count", "played_ms"
    )


def live_sessions(listens: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(user_id, start_at, end_at, listens) of sessions as they close."""
    timed = listens.withColumn("listened_at", F.col("listened_at").cast("timestamp")).withWatermark("listened_at", late)
    return timed.groupBy("user_id", F.session_window("listened_at", "5 minutes")).agg(F.min("listened_at").alias("start_at"), F.max("listened_at").alias("end_at"), F.count("*").alias("listens")).drop("session_window")


#: Users whose hashes agree in this share a state: a group of a batch costs about ten milliseconds, however few users it holds.
STREAK_BUCKETS = 1024


def _streaks(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = {user: tuple(rest) for user, *rest in zip(*state.get)} if state.exists else {}
    days = pd.concat([b[["user_id", "day"]] for b in batches]).drop_duplicates().sort_values(["user_id", "day"])
    touched = days["user_id"].unique().tolist()
    for user, number in zip(days["user_id"].tolist(), days["day"].tolist()):
        last, current, longest = held.get(user, (None, 0, 0))
        if last is not None and number <= last:  # the same day again, or a listen brought in from the past
            continue
        current = current + 1 if last is not None and number == last + 1 else 1
        held[user] = number, current, max(longest, current)
    state.update(tuple(list(c) for c in zip(*((user, *rest) for user, rest in held.items()))))
    last, current, longest = zip(*(held[user] for user in touched))
    yield pd.DataFrame({"user_id": touched, "last_day": [date.fromordinal(n) for n in last], "current_streak": current, "longest_streak": longest})


def live_streaks(heard: DataFrame) -> DataFrame:
    """(user_id, last_day, current_streak, longest_streak) after each batch: same day keeps, the next day adds, else back to one.

    Listens from before the last day change nothing; a rebuild of the user's state takes them in.
    """
    day = (F.unix_date(F.to_date("listened_at")) + date(1970, 1, 1).toordinal()).alias("day")
    days = heard.where("user_id IS NOT NULL AND listened_at IS NOT NULL").select(F.pmod(F.xxhash64("user_id"), F.lit(STREAK_BUCKETS)).alias("bucket"), "user_id", day)
    return days.groupBy("bucket").applyInPandasWithState(
        _streaks, "user_id long, last_day date, current_streak long, longest_streak long", "users array<long>, last array<long>, current array<long>, longest array<long>", "update", GroupStateTimeout.NoTimeout
    )


# ---- who plays what just now


class _Playing(StatefulProcessor):
    """A user's latest start, until the song is over: a timer in event time takes it away."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "song_id long, started_us long, ends_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = None
        for batch in rows:
            for song, started, length in zip(batch["song_id"], batch["started_us"], batch["duration_ms"]):
                if last is None or (started, song) > (last[1], last[0]):
                    last = (int(song), int(started), int(started) // 1000 + (0 if pd.isna(length) else int(length)))
        held = self.now.get() if self.now.exists() else None
        if held is not None and (held[1], held[0]) >= (last[1], last[0]):
            return
        if held is not None:
            self.handle.deleteTimer(held[2])
        if last[2] <= timerValues.getCurrentWatermarkInMs():  # over before it arrived
            self.now.clear()
        else:
            self.now.update(last)
            self.handle.registerTimer(last[2])
        yield pd.DataFrame({"user_id": [key[0]], "song_id": [last[0]], "started_us": [last[1]], "ends_ms": [last[2]], "playing": [last[2] > timerValues.getCurrentWatermarkInMs()]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.now.get()
        self.now.clear()
        yield pd.DataFrame({"user_id": [key[0]], "song_id": [held[0]], "started_us": [held[1]], "ends_ms": [held[2]], "playing": [False]})

    def close(self) -> None:
        pass


def live_now_playing(starts: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(user_id, song_id, started_us, ends_ms, playing) of each change: a start that is the user's latest, and its end.

    ``starts`` is a stream (user_id, song_id, started_at, duration_ms); a song of unknown length is over at once. The
    state holds one start of each user who plays something, and lets go of it when the watermark has passed its end.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    timed = starts.withColumn("started_at", F.col("started_at").cast("timestamp")).withWatermark("started_at", late)
    rows = timed.select("user_id", "song_id", "started_at", F.unix_micros("started_at").alias("started_us"), "duration_ms")
    return rows.groupBy("user_id").transformWithStateInPandas(_Playing(), "user_id long, song_id long, started_us long, ends_ms long, playing boolean", "Update", "EventTime")
