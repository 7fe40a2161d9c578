"""Aggregate tables over eligible listens: full rebuilds, folding in new listens, taking back deleted ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import cut

#: A listen of this length counts however long the song is.
ENOUGH_MS = 240_000


def played_ms(played: Column, duration: Column) -> Column:
    return F.coalesce(played, duration, F.lit(0)).cast("long")


def eligible(played: Column, duration: Column) -> Column:
    """Whether a listen counts: song of unknown length, at least half of it heard, or four minutes."""
    ms = played_ms(played, duration)
    return duration.isNull() | (duration <= 0) | (ms * 2 >= duration) | (ms >= ENOUGH_MS)


def eligible_listens(listens: DataFrame, songs: DataFrame) -> DataFrame:
    """Counting listens as (id, user_id, song_id, listened_at, client, played_ms); listens of unknown songs are left out."""
    lengths = songs.select(F.col("id").alias("song_id"), "duration_ms")
    played, duration = F.col("duration_played_ms"), F.col("duration_ms")
    return listens.join(lengths, "song_id").where(eligible(played, duration)).select(
        "id", "user_id", "song_id", "listened_at", "client", played_ms(played, duration).alias("played_ms")
    )


def daily(heard: DataFrame) -> DataFrame:
    """(user_id, song_id, day, listen_count, played_ms)."""
    keys = ["user_id", "song_id", F.to_date("listened_at").alias("day")]
    return heard.groupBy(*keys).agg(F.count("*").alias("listen_count"), F.sum("played_ms").alias("played_ms"))


def clock(heard: DataFrame) -> DataFrame:
    """(user_id, day, hour, listen_count), in UTC."""
    keys = ["user_id", F.to_date("listened_at").alias("day"), F.hour("listened_at").cast("long").alias("hour")]
    return heard.groupBy(*keys).agg(F.count("*").alias("listen_count"))


#: Rows of a user and an entity that one task sorts or sums up.
_ROWS_DEALT = 524_288


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by its keys in as many partitions as ``rows`` rows need, so that no task grows with the input."""
    return df.repartition(rows // _ROWS_DEALT + 1, *keys)


def attributed(songs: DataFrame, song_albums: DataFrame, song_artists: DataFrame) -> DataFrame:
    """Rows of (user_id, song_id, ...) once for the song, each of its albums and each of its artists, dealt by user.

    The rows are many times more afterwards, and a few songs may be in most of them. So a song's entities travel as a
    list in its rows, and the rows go to partitions of users, as many as the opened rows need, before the lists are
    opened: aggregates that are kept by user need no further shuffle, and none of their tasks grows with the history.
    Lists are made only of songs that occur.
    """
    once = cut(songs)
    heard = cut(once.select("song_id").distinct())
    listed = lambda bridge, c: bridge.join(heard, "song_id", "left_semi").groupBy("song_id").agg(F.collect_list(c).alias(f"_{c}"))
    found = heard.join(listed(song_albums, "album_id"), "song_id", "left").join(listed(song_artists, "artist_id"), "song_id", "left")
    entity = lambda kind, c: F.struct(F.lit(kind).alias("entity_type"), c.cast("long").alias("entity_id"))
    listed_as = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<long>")), lambda x: entity(kind, x))
    every = F.concat(F.array(entity("song", F.col("song_id"))), listed_as("album", F.col("_album_id")), listed_as("artist", F.col("_artist_id")))
    entities = cut(found.select("song_id", every.alias("_all")))
    opened = once.groupBy("song_id").count().join(entities.select("song_id", F.size("_all").alias("_n")), "song_id").agg(F.sum(F.col("count") * F.col("_n"))).first()[0]
    return dealt(once.join(entities, "song_id"), opened or 0, "user_id").select(*songs.columns, F.explode("_all").alias("_e")).select(*songs.columns, "_e.entity_type", "_e.entity_id")


PER_USER = ["user_id", "entity_type", "entity_id"]


def per_user(heard: DataFrame, song_albums: DataFrame, song_artists: DataFrame) -> DataFrame:
    """(user_id, entity_type, entity_id, plays, played_ms, first_at): what first listens and totals are summed from.

    Listens shrink to one row per user and song before they fan out to albums and artists.
    """
    sums = lambda first: [F.sum("plays").alias("plays"), F.sum("played_ms").alias("played_ms"), F.min(first).alias("first_at")]
    songs = heard.withColumn("plays", F.lit(1).cast("long")).groupBy("user_id", "song_id").agg(*sums("listened_at"))
    return attributed(songs, song_albums, song_artists).groupBy(*PER_USER).agg(*sums("first_at"))


def first_listens(heard: DataFrame, song_albums: DataFrame, song_artists: DataFrame) -> DataFrame:
    """(user_id, entity_type, entity_id, first_at)."""
    return per_user(heard, song_albums, song_artists).select(*PER_USER, "first_at")


def totals(by_user: DataFrame) -> DataFrame:
    """(entity_type, entity_id, plays, unique_listeners, played_ms, first_listened_at) of ``per_user`` rows: listeners are counted as rows."""
    return by_user.groupBy("entity_type", "entity_id").agg(
        F.sum("plays").alias("plays"), F.count("*").alias("unique_listeners"), F.sum("played_ms").alias("played_ms"), F.min("first_at").alias("first_listened_at")
    )


#: Rows of a user and an entity that are opened before what they need on disk is let go.
_ROWS_AT_ONCE = 256 * _ROWS_DEALT
_LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _listeners(once: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, unique_listeners) of entities from rows of (user_id, song_id), one for each two, and the entities of a song (song_id, codes).

    Lists of numbers travel to the users, who count once for an entity. This is far more than all else that is shuffled, so it
    is done for a part of the users after the other, and the files of a part go when its counts are written.
    """
    opened = once.groupBy("song_id").count().join(codes, "song_id").agg(F.sum(F.col("count") * F.size("codes"))).first()[0] or 0
    parts = opened // _ROWS_AT_ONCE + 1
    conf = once.sparkSession.conf
    before = conf.get(_LET_GO, None)
    counted = None
    try:
        conf.set(_LET_GO, "true")
        for k in range(parts):
            own = once.where(F.pmod(F.xxhash64(F.lit("part"), "user_id"), F.lit(parts)) == k).select("user_id", "song_id")
            heard = dealt(own.join(codes, "song_id").select("user_id", "codes"), opened // parts, "user_id").select("user_id", F.explode("codes").alias("code")).distinct()
            some = cut(heard.groupBy("code").agg(F.count("*").alias("unique_listeners")))
            counted = some if counted is None else counted.unionByName(some)
    finally:
        conf.unset(_LET_GO) if before is None else conf.set(_LET_GO, before)
    return counted.groupBy("code").agg(F.sum("unique_listeners").alias("unique_listeners"))


def global_stats(heard: DataFrame, song_albums: DataFrame, song_artists: DataFrame) -> DataFrame:
    """As ``totals`` of all listens. Plays, times and firsts are summed by song before they fan out; only listeners are told apart by user."""
    once = cut(heard.groupBy("user_id", "song_id").agg(F.count("*").alias("plays"), F.sum("played_ms").alias("played_ms"), F.min("listened_at").alias("first_listened_at")))
    sums = [F.sum("plays").alias("plays"), F.sum("played_ms").alias("played_ms"), F.min("first_listened_at").alias("first_listened_at")]
    songs = cut(once.groupBy("song_id").agg(*sums, F.count("*").alias("unique_listeners")))
    code = lambda c, kind: F.shiftleft(F.col(c).cast("long"), 1) + kind
    linked = song_albums.select("song_id", code("album_id", 0).alias("code")).unionByName(song_artists.select("song_id", code("artist_id", 1).alias("code")))
    linked = cut(linked.where("code IS NOT NULL").join(songs, "song_id", "left_semi"))
    codes = cut(linked.groupBy("song_id").agg(F.array_sort(F.collect_set("code")).alias("codes")))
    others = linked.join(songs.drop("unique_listeners"), "song_id").groupBy("code").agg(*sums).join(_listeners(once, codes), "code")
    kind = F.when(F.col("code").bitwiseAND(1) == 0, "album").otherwise("artist").alias("entity_type")
    columns = ["entity_type", "entity_id", "plays", "unique_listeners", "played_ms", "first_listened_at"]
    others = others.select(kind, F.shiftright("code", 1).alias("entity_id"), *columns[2:])
    return songs.select(F.lit("song").alias("entity_type"), F.col("song_id").cast("long").alias("entity_id"), *columns[2:]).unionByName(others)


def streaks(day_rollup: DataFrame) -> DataFrame:
    """(user_id, length, first_day, last_day) of each run of days in a row with a counting listen."""
    days = day_rollup.select("user_id", "day").distinct()
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    return (
        days.withColumn("island", F.date_sub("day", rank))
        .groupBy("user_id", "island")
        .agg(F.count("*").alias("length"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
        .drop("island")
    )


def user_state(listens: DataFrame, day_rollup: DataFrame, today: date) -> DataFrame:
    """(user_id, last_listened_at, current_streak, longest_streak); the last listen need not count.

    A streak is current if its last day is yesterday or later.
    """
    runs = streaks(day_rollup).groupBy("user_id").agg(F.max("length").alias("longest"), F.max_by("length", "last_day").alias("latest"), F.max("last_day").alias("last_day"))
    alive = F.col("last_day") >= F.date_sub(F.lit(today), 1)
    return (
        listens.groupBy("user_id").agg(F.max("listened_at").alias("last_listened_at")).join(runs, "user_id", "left")
        .select("user_id", "last_listened_at", F.when(alive, F.col("latest")).otherwise(0).alias("current_streak"), F.coalesce("longest", F.lit(0)).alias("longest_streak"))
    )


# ---- maintenance


def dedupe(new: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Listens that are first of their (user, song, time), and not already present."""
    key = ["user_id", "song_id", "listened_at"]
    found = new.groupBy(*key).agg(F.min_by(F.struct(*(c for c in new.columns if c not in key)), "id").alias("_r")).select(*key, "_r.*").select(*new.columns)
    return found if present is None else found.join(present.select(*key), key, "left_anti")


def add_up(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Additive upsert: counters are summed, times take the earlier one."""
    measures = [c for c in old.columns if c not in keys]
    earliest = ("first_at", "first_listened_at")
    return old.unionByName(delta.select(*old.columns)).groupBy(*keys).agg(*((F.min(c) if c in earliest else F.sum(c)).alias(c) for c in measures)).select(*old.columns)


def take_off(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Additive upsert of negative counts: milliseconds stay at zero or above, rows without a listen go."""
    counter = "listen_count" if "listen_count" in old.columns else "plays"
    minus = delta.select(*(F.col(c) if c in keys else (-F.col(c)).alias(c) for c in old.columns))
    sums = [F.sum(c).alias(c) for c in old.columns if c not in keys]
    out = old.unionByName(minus).groupBy(*keys).agg(*sums).where(F.col(counter) > 0)
    return out.select(*(F.greatest(F.col(c), F.lit(0)).alias(c) if c == "played_ms" else F.col(c) for c in old.columns))


class Lazily(Mapping):
    """Tables by name, each planned when it is first asked for: plans write tables, and who asks for one needs no other."""

    def __init__(self, **plans: Callable[[], DataFrame]):
        self._plans, self._made = plans, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._plans[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)


def fold(stored: Mapping[str, DataFrame], heard: DataFrame, song_albums: DataFrame, song_artists: DataFrame) -> Mapping[str, DataFrame]:
    """The rollups after more counting listens; equals a rebuild over old and new listens. The new rows are summed once."""
    keys = ["entity_type", "entity_id"]
    made = Lazily(mine=lambda: cut(per_user(heard, song_albums, song_artists)), size=lambda: made["mine"].count() + stored["first_listens"].count())
    by_user = lambda df: dealt(df, made["size"], *PER_USER)

    def first() -> DataFrame:
        every = stored["first_listens"].select(*PER_USER, "first_at").unionByName(made["mine"].select(*PER_USER, "first_at"))
        return by_user(every).groupBy(*PER_USER).agg(F.min("first_at").alias("first_at")).select(*stored["first_listens"].columns)

    def everyone() -> DataFrame:
        listeners = by_user(made["mine"].select(*PER_USER)).join(by_user(stored["first_listens"].select(*PER_USER)), PER_USER, "left_anti").groupBy(*keys).agg(F.count("*").alias("unique_listeners"))
        delta = totals(made["mine"]).drop("unique_listeners").join(listeners, keys, "left").withColumn("unique_listeners", F.coalesce("unique_listeners", F.lit(0)))
        return add_up(stored["global_stats"], delta, keys)

    return Lazily(
        daily=lambda: add_up(stored["daily"], daily(heard), ["user_id", "song_id", "day"]), clock=lambda: add_up(stored["clock"], clock(heard), ["user_id", "day", "hour"]),
        first_listens=first, global_stats=everyone,
    )


def _with_rest(removed: DataFrame, remaining: DataFrame, song_albums: DataFrame, song_artists: DataFrame) -> DataFrame:
    """(user_id, entity_type, entity_id, plays, played_ms, gone_at, still, first_at): what users lose of an entity, and how often and since when they still hear it."""
    of = lambda gone, c: F.when(F.col("_gone") if gone else ~F.col("_gone"), c)
    own = remaining.join(removed.select("user_id").distinct(), "user_id", "left_semi")
    use = lambda df, gone: df.select("user_id", "song_id", "listened_at", "played_ms", F.lit(gone).alias("_gone"))
    one = F.lit(1).cast("long")
    songs = use(removed, True).unionByName(use(own, False)).groupBy("user_id", "song_id").agg(
        F.sum(of(True, one)).alias("plays"), F.sum(of(True, F.col("played_ms"))).alias("played_ms"), F.min(of(True, F.col("listened_at"))).alias("gone_at"),
        F.sum(of(False, one)).alias("still"), F.min(of(False, F.col("listened_at"))).alias("first_at"),
    )
    sums = [F.sum(c).alias(c) for c in ("plays", "played_ms")] + [F.min("gone_at").alias("gone_at"), F.coalesce(F.sum("still"), F.lit(0)).alias("still"), F.min("first_at").alias("first_at")]
    return attributed(songs, song_albums, song_artists).groupBy(*PER_USER).agg(*sums).where("plays > 0")


def unrecord(stored: Mapping[str, DataFrame], removed: DataFrame, remaining: DataFrame, song_albums: DataFrame, song_artists: DataFrame) -> Mapping[str, DataFrame]:
    """The rollups after counting listens were deleted; ``remaining`` are the listens that are left.

    Counts go down by what was deleted. Whether a listener still has the entity, and since when, is worked out again
    from what remains of these users alone, dealt by user together with what was deleted; an entity's own first time is
    the earliest of its listeners', and is sought again only if the listen that set it was deleted. So the
    history of an entity that many hear is not read for a deletion by one of them.
    """
    keys = ["entity_type", "entity_id"]
    made = Lazily(gone=lambda: cut(_with_rest(removed, remaining, song_albums, song_artists)), size=lambda: made["gone"].count() + stored["first_listens"].count())

    def first(old: DataFrame, gone: DataFrame, size: int) -> DataFrame:
        left = dealt(old.select(*PER_USER, "first_at"), size, *PER_USER).join(dealt(gone.select(*PER_USER), size, *PER_USER), PER_USER, "left_anti")
        return left.unionByName(gone.where("still > 0").select(*PER_USER, "first_at"))

    def everyone() -> DataFrame:
        gone, old = made["gone"], stored["global_stats"]
        lost = F.count(F.when(F.col("still") == 0, 1))
        less = cut(gone.groupBy(*keys).agg(F.sum("plays").alias("_plays"), F.sum("played_ms").alias("_played_ms"), lost.alias("_unique_listeners"), F.min("gone_at").alias("_gone_at")))
        touched = old.join(less, keys).select(
            *keys, (F.col("plays") - F.col("_plays")).alias("plays"), (F.col("unique_listeners") - F.col("_unique_listeners")).alias("unique_listeners"),
            F.greatest(F.col("played_ms") - F.col("_played_ms"), F.lit(0)).alias("played_ms"), "first_listened_at", (F.col("_gone_at") <= F.col("first_listened_at")).alias("_anew"),
        )
        touched = cut(touched.where("plays > 0"))
        anew = cut(touched.where("_anew").select(*keys))
        of_these = cut(stored["first_listens"].join(anew, keys, "left_semi"))
        again = gone.join(anew, keys, "left_semi")
        since = first(of_these, again, of_these.count()).groupBy(*keys).agg(F.min("first_at").alias("_since"))
        left = touched.join(since, keys, "left").withColumn("first_listened_at", F.when(F.col("_anew"), F.col("_since")).otherwise(F.col("first_listened_at"))).drop("_anew", "_since")
        return old.join(less.select(*keys), keys, "left_anti").select(*left.columns).unionByName(left)

    return Lazily(
        daily=lambda: take_off(stored["daily"], daily(removed), ["user_id", "song_id", "day"]), clock=lambda: take_off(stored["clock"], clock(removed), ["user_id", "day", "hour"]),
        first_listens=lambda: first(stored["first_listens"], made["gone"], made["size"]), global_stats=everyone,
    )
