"""Statistics of one listener or of everyone, over stored rollups where their grain allows it."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..library import Library
from ..plans.buckets import bucket_days, bucket_table, shifted_day
from ..plans.timeframe import Timeframe, add, bucket_starts, truncate
from . import rollups

SESSION_GAP_SECONDS = 300
#: A rewind compares with this many leaders of the period before.
PRIOR_LEADERS = 1000


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def minutes(ms: Column) -> Column:
    return F.coalesce(ms, F.lit(0)).cast("double") / F.lit(60000.0).cast("double")


def of_user(df: DataFrame, user_id: int | None) -> DataFrame:
    return df if user_id is None else df.where(F.col("user_id") == user_id)


def in_days(df: DataFrame, period: Timeframe) -> DataFrame:
    first, last = period.days
    if "month" in df.columns:  # stored by month, see library
        df = df.where(F.col("month").between(f"{first:%Y-%m}", f"{last:%Y-%m}"))
    return df.where((F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(last)))


def in_time(df: DataFrame, period: Timeframe, column: str = "listened_at") -> DataFrame:
    return df.where((F.col(column) >= F.lit(period.start)) & (F.col(column) < F.lit(period.stop)))


def of_entity(df: DataFrame, lib: Library, artist_id: int | None = None, album_id: int | None = None, song_id: int | None = None) -> DataFrame:
    """Rows whose song belongs to the artist and the album given; a semi join, so nothing is counted twice."""
    if song_id is not None:
        df = df.where(F.col("song_id") == song_id)
    if artist_id is not None:
        df = df.join(lib.song_artists.where(F.col("artist_id") == artist_id).select("song_id"), "song_id", "left_semi")
    if album_id is not None:
        df = df.join(lib.song_albums.where(F.col("album_id") == album_id).select("song_id"), "song_id", "left_semi")
    return df


# ---- summary


def longest_streak(lib: Library, user_id: int, period: Timeframe) -> DataFrame:
    runs = rollups.streaks(in_days(of_user(lib.daily, user_id), period))
    return runs.agg(F.coalesce(F.max("length"), F.lit(0)).alias("longest_streak"))


def average_session(lib: Library, user_id: int, period: Timeframe) -> DataFrame:
    """Mean span of sessions in ms; a gap of more than five minutes between starts opens one. Ineligible listens count."""
    order = Window.partitionBy("user_id").orderBy("listened_at")
    own = in_time(of_user(lib.listens, user_id), period).select("user_id", "listened_at")
    micros = F.unix_micros(F.col("listened_at").cast("timestamp"))
    gap = F.col("at") - F.lag("at").over(order)
    opened = own.withColumn("at", micros).withColumn("opens", F.when(gap.isNull() | (gap > SESSION_GAP_SECONDS * 1_000_000), 1).otherwise(0))
    spans = opened.withColumn("session", F.sum("opens").over(order)).groupBy("session").agg((F.max("at") - F.min("at")).alias("span"))
    return spans.agg(F.coalesce(F.avg("span") / 1000, F.lit(0.0)).alias("avg_session_length_ms"))


def sessions(listens: DataFrame) -> DataFrame:
    """(user_id, start_at, end_at, listens) by Spark's session windows."""
    window = F.session_window("listened_at", f"{SESSION_GAP_SECONDS} seconds")
    timed = listens.withColumn("listened_at", F.col("listened_at").cast("timestamp"))
    return timed.groupBy("user_id", window).agg(F.min("listened_at").alias("start_at"), F.max("listened_at").alias("end_at"), F.count("*").alias("listens")).drop("session_window")


def summary(lib: Library, period: Timeframe, user_id: int | None = None) -> DataFrame:
    """One row; for a user also streaks of the period and the mean session."""
    scoped = in_days(of_user(lib.daily, user_id), period)
    songs = scoped.groupBy("song_id").agg(F.sum("listen_count").alias("n"), F.sum("played_ms").alias("ms"))
    base = songs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("listen_count"), F.count("*").alias("unique_tracks"), minutes(F.sum("ms")).alias("minutes_listened")
    )
    days = scoped.select("day").distinct().agg(F.count("*").alias("days_active"))
    albums = lib.song_albums.join(songs, "song_id", "left_semi").select("album_id").distinct().agg(F.count("*").alias("unique_albums"))
    artists = lib.song_artists.join(songs, "song_id", "left_semi").select("artist_id").distinct().agg(F.count("*").alias("unique_artists"))
    out = base.crossJoin(days).crossJoin(albums).crossJoin(artists)  # one row each
    out = out.withColumns(
        {
            "avg_daily_plays": ratio(F.col("listen_count"), F.col("days_active")),
            "tracks_per_artist": ratio(F.col("unique_tracks"), F.col("unique_artists")),
            "albums_per_artist": ratio(F.col("unique_albums"), F.col("unique_artists")),
        }
    )
    if user_id is None:
        return out
    return out.crossJoin(longest_streak(lib, user_id, period)).crossJoin(average_session(lib, user_id, period))


# ---- leaders


def primary(bridge: DataFrame, key: str, other: str, order: Column, names: DataFrame, id_as: str, name_as: str) -> DataFrame:
    """(key, id_as, name_as): the first linked entity of each key; ties go to the lower id."""
    named = bridge.join(names.select(F.col("id").alias(other), F.col("name").alias("_name")), other)
    first = F.min_by(F.struct(other, "_name"), F.struct(order, F.col(other)))
    return named.groupBy(key).agg(first.alias("_p")).select(key, F.col(f"_p.{other}").alias(id_as), F.col("_p._name").alias(name_as))


def _ranked(totals: DataFrame, flagged: DataFrame | None, key: str, sort_by: str, limit: int, offset: int) -> DataFrame:
    if flagged is None:
        out = totals.withColumn("blacklisted", F.lit(False))
    else:
        marked = flagged.select(key).distinct().withColumn("_b", F.lit(True))
        out = totals.join(marked, key, "left").withColumn("blacklisted", F.coalesce("_b", F.lit(False))).drop("_b")
    metric = "minutes_listened" if sort_by == "minutes" else "listen_count"
    page = out.orderBy("blacklisted", F.desc(metric), "name", key)
    return (page.offset(offset) if offset else page).limit(limit)


def _totals(scoped: DataFrame, key: str) -> DataFrame:
    return scoped.groupBy(key).agg(F.sum("listen_count").alias("listen_count"), minutes(F.sum("played_ms")).alias("minutes_listened"))


def _per_song(lib: Library, period: Timeframe, user_id: int | None) -> DataFrame:
    scoped = in_days(of_user(lib.daily, user_id), period)
    return scoped.groupBy("song_id").agg(F.sum("listen_count").alias("listen_count"), F.sum("played_ms").alias("played_ms"))


def _own_blacklist(lib: Library, user_id: int | None) -> DataFrame | None:
    return None if user_id is None else lib.blacklist.where(F.col("user_id") == user_id).select("artist_id")


def top_artists(lib: Library, period: Timeframe, user_id: int | None = None, sort_by: str = "listens", limit: int = 20, offset: int = 0) -> DataFrame:
    """Songs are summed before they fan out to artists; a listen counts once for each linked artist."""
    totals = _totals(_per_song(lib, period, user_id).join(lib.song_artists, "song_id"), "artist_id")
    named = totals.join(lib.artists.select(F.col("id").alias("artist_id"), "name"), "artist_id")
    return _ranked(named, _own_blacklist(lib, user_id), "artist_id", sort_by, limit, offset)


def top_albums(lib: Library, period: Timeframe, user_id: int | None = None, sort_by: str = "listens", limit: int = 20, offset: int = 0) -> DataFrame:
    totals = _totals(_per_song(lib, period, user_id).join(lib.song_albums, "song_id"), "album_id")
    named = totals.join(lib.albums.select(F.col("id").alias("album_id"), "name"), "album_id")
    hidden = _own_blacklist(lib, user_id)
    flagged = None if hidden is None else lib.album_artists.join(hidden, "artist_id", "left_semi")
    page = _ranked(named, flagged, "album_id", sort_by, limit, offset)
    wanted = lib.album_artists.join(page.select("album_id"), "album_id", "left_semi")
    first = primary(wanted, "album_id", "artist_id", F.col("position"), lib.artists, "artist_id", "artist_name")
    return page.join(first, "album_id", "left").withColumns({"artist_id": F.coalesce("artist_id", F.lit(0)), "artist_name": F.coalesce("artist_name", F.lit(""))})


def song_primaries(lib: Library, songs: DataFrame) -> DataFrame:
    """(song_id, artist_id, artist_name, album_id, album_name) of the songs' first artist and album; 0 and '' if none."""
    wanted = lambda bridge: bridge.join(songs.select("song_id"), "song_id", "left_semi")
    artist = primary(wanted(lib.song_artists), "song_id", "artist_id", F.col("position"), lib.artists, "artist_id", "artist_name")
    track = F.struct(F.col("track_number").isNull().alias("n"), F.col("track_number"))
    album = primary(wanted(lib.song_albums), "song_id", "album_id", track, lib.albums, "album_id", "album_name")
    blank = {"artist_id": F.lit(0), "artist_name": F.lit(""), "album_id": F.lit(0), "album_name": F.lit("")}
    joined = songs.select("song_id").join(artist, "song_id", "left").join(album, "song_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in blank.items()})


def top_tracks(
    lib: Library, period: Timeframe, user_id: int | None = None, artist_id: int | None = None, album_id: int | None = None, sort_by: str = "listens", limit: int = 20, offset: int = 0
) -> DataFrame:
    scoped = of_entity(_per_song(lib, period, user_id), lib, artist_id, album_id)
    named = _totals(scoped, "song_id").join(lib.songs.select(F.col("id").alias("song_id"), "name"), "song_id")
    hidden = _own_blacklist(lib, user_id)
    flagged = None if hidden is None else lib.song_artists.join(hidden, "artist_id", "left_semi")
    page = _ranked(named, flagged, "song_id", sort_by, limit, offset)
    return page.join(song_primaries(lib, page), "song_id")


# ---- over time


def clamp(lib: Library, period: Timeframe, user_id: int | None = None, aligned: bool = False) -> Timeframe:
    """The period cut to begin no earlier than the first listen; ``aligned`` keeps that listen's whole day."""
    first = of_user(lib.listens, user_id).agg(F.min("listened_at")).first()[0]
    if first is None or first <= period.start:
        return period
    return Timeframe(truncate(first, "day") if aligned else first, period.stop)


def _bucketed(df: DataFrame, period: Timeframe, step: str) -> DataFrame:
    """Days of a rollup that the buckets can hold; the bounds reach the scan and the months of a stored one."""
    starts = bucket_starts(period.start, period.stop, step)
    return in_days(df, Timeframe(starts[0], add(starts[-1], step) + timedelta(1))) if starts else df.where(F.lit(False))


def activity(
    lib: Library, period: Timeframe, step: str, user_id: int | None = None, artist_id: int | None = None, album_id: int | None = None, song_id: int | None = None
) -> DataFrame:
    """(bucket, listen_count, minutes_listened) with zeros, from the start of the period to its end included."""
    spark = lib.daily.sparkSession
    own = of_entity(of_user(_bucketed(lib.daily, period, step), user_id), lib, artist_id, album_id, song_id)
    per_day = own.groupBy(shifted_day(F.col("day"), period.start).alias("shifted_day")).agg(F.sum("listen_count").alias("n"), F.sum("played_ms").alias("ms"))
    per_bucket = bucket_days(spark, period.start, period.stop, step).join(per_day, "shifted_day").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("ms").alias("ms"))
    every = bucket_table(spark, period.start, period.stop, step).join(per_bucket, "bucket", "left")
    return every.select("bucket", F.coalesce("n", F.lit(0)).alias("listen_count"), minutes(F.col("ms")).alias("minutes_listened")).orderBy("bucket")


def discovery(lib: Library, period: Timeframe, step: str, user_id: int | None = None) -> DataFrame:
    """(bucket, total, discoveries, rate): all plays, and songs heard for the first time."""
    spark = lib.daily.sparkSession
    days = bucket_days(spark, period.start, period.stop, step)
    plays = of_user(_bucketed(lib.daily, period, step), user_id).groupBy(shifted_day(F.col("day"), period.start).alias("shifted_day")).agg(F.sum("listen_count").alias("n"))
    starts = bucket_starts(period.start, period.stop, step)
    within = F.col("first_at").between(F.lit(starts[0]), F.lit(add(starts[-1], step))) if starts else F.lit(False)
    firsts = of_user(lib.first_listens, user_id).where(within & (F.col("entity_type") == "song")).groupBy(shifted_day(F.col("first_at"), period.start).alias("shifted_day")).agg(F.count("*").alias("n"))
    total = days.join(plays, "shifted_day").groupBy("bucket").agg(F.sum("n").alias("total"))
    found = days.join(firsts, "shifted_day").groupBy("bucket").agg(F.sum("n").alias("discoveries"))
    every = bucket_table(spark, period.start, period.stop, step).join(total, "bucket", "left").join(found, "bucket", "left")
    out = every.select("bucket", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("discoveries", F.lit(0)).alias("discoveries"))
    return out.withColumn("rate", ratio(F.col("discoveries"), F.col("total"))).orderBy("bucket")


def interest(
    lib: Library, now: datetime, step: str, user_id: int | None = None, artist_id: int | None = None, album_id: int | None = None, song_id: int | None = None
) -> DataFrame:
    """(bucket, listen_count) in calendar units from the entity's first counting listen to now; later listens fall in the last one."""
    unit = step if step in ("week", "month") else "day"
    own = of_entity(of_user(lib.eligible, user_id), lib, artist_id, album_id, song_id)
    at = F.least(F.col("listened_at"), F.lit(now))
    counts = own.groupBy(F.date_trunc(unit, at.cast("timestamp")).cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("listen_count"))
    span = counts.agg(F.min("bucket").alias("a")).where("a IS NOT NULL")
    every = span.select(F.explode(F.sequence("a", F.lit(truncate(now, unit)), F.expr(f"INTERVAL 1 {unit}"))).alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("listen_count", F.lit(0)).alias("listen_count")).orderBy("bucket")


def clock_grid(lib: Library, period: Timeframe, tz: str = "UTC", user_id: int | None = None) -> DataFrame:
    """(day_of_week from Sunday = 0, hour, listen_count) for all 168 cells, in the zone given."""
    utc = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour").cast("int"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)
    shifted = in_days(of_user(lib.clock, user_id), period).withColumn("local", local)
    cells = shifted.groupBy((F.dayofweek("local") - 1).cast("long").alias("day_of_week"), F.hour("local").cast("long").alias("hour")).agg(F.sum("listen_count").alias("n"))
    every = lib.clock.sparkSession.range(168).select((F.col("id") / 24).cast("long").alias("day_of_week"), (F.col("id") % 24).alias("hour"))
    return every.join(cells, ["day_of_week", "hour"], "left").select("day_of_week", "hour", F.coalesce("n", F.lit(0)).alias("listen_count"))


def heat_levels(counts: DataFrame, value: str = "listen_count") -> DataFrame:
    """(level, up_to): heat-map steps at the 25, 50, 75 and 100 per cent points of the values above zero."""
    order = Window.partitionBy(F.lit(0)).orderBy(value)  # over buckets or cells of a calendar, never over listens
    ranked = counts.where(F.col(value) > 0).select(F.col(value)).withColumn("at", F.row_number().over(order) - 1)
    size = ranked.agg(F.count("*").alias("n"))
    wanted = size.select("n", F.explode(F.array(*(F.struct(F.lit(i + 1).cast("long").alias("level"), F.lit(p).alias("p")) for i, p in enumerate((0.25, 0.5, 0.75, 1.0))))).alias("l"))
    picked = wanted.select(F.col("l.level").alias("level"), F.least(F.col("n") - 1, F.floor(F.col("l.p") * F.col("n"))).alias("at"))
    return picked.join(ranked, "at").select("level", F.col(value).alias("up_to"))


# ---- others


def primary_sources(lib: Library) -> DataFrame:
    """(song_id, source_type): sources found by id before fuzzy ones, then the lowest id."""
    order = F.struct((F.col("correlation_method") != "source_id").alias("later"), F.col("id"))
    return lib.sources.where("entity_type = 'song'").groupBy(F.col("entity_id").alias("song_id")).agg(F.min_by("source_type", order).alias("source_type"))


def sources_breakdown(lib: Library, period: Timeframe, user_id: int | None = None) -> DataFrame:
    per_song = in_time(of_user(lib.eligible, user_id), period).groupBy("song_id").agg(F.count("*").alias("n"))
    named = per_song.join(primary_sources(lib), "song_id", "left").groupBy(F.coalesce("source_type", F.lit("unknown")).alias("source_type"))
    return named.agg(F.sum("n").alias("listen_count")).orderBy(F.desc("listen_count"), "source_type")


def top_day(lib: Library, user_id: int, period: Timeframe) -> DataFrame:
    days = in_days(of_user(lib.daily, user_id), period).groupBy("day").agg(F.sum("listen_count").alias("listen_count"))
    return days.orderBy(F.desc("listen_count"), "day").limit(1)


def new_entities(lib: Library, user_id: int, period: Timeframe) -> DataFrame:
    firsts = in_time(of_user(lib.first_listens, user_id), period, "first_at")
    of = lambda kind: F.count(F.when(F.col("entity_type") == kind, 1))
    return firsts.agg(of("song").alias("new_tracks"), of("album").alias("new_albums"), of("artist").alias("new_artists"))


def rewind_top(lib: Library, user_id: int, period: Timeframe, kind: str, limit: int = 5) -> DataFrame:
    """The leaders of a period with the change of their plays against the period before."""
    top, key = {"artists": (top_artists, "artist_id"), "albums": (top_albums, "album_id"), "tracks": (top_tracks, "song_id")}[kind]
    now = top(lib, period, user_id, limit=limit)
    prior = top(lib, period.before(), user_id, limit=PRIOR_LEADERS).select(key, F.col("listen_count").alias("prior_count"))
    out = now.join(prior, key, "left").withColumn("prior_count", F.coalesce("prior_count", F.lit(0)))
    return out.withColumn("delta", F.col("listen_count") - F.col("prior_count"))


def rewind(lib: Library, user_id: int, period: Timeframe, limit: int = 5) -> DataFrame:
    """One row: a period's totals, new entities, best day and longest streak, and its leaders with their change
    against the period before, as arrays of (id, name, listen_count, delta) from the first on."""
    out = summary(lib, period, user_id).drop("avg_session_length_ms", "tracks_per_artist", "albums_per_artist", "days_active").withColumnRenamed("listen_count", "plays")
    for kind, key in (("artists", "artist_id"), ("albums", "album_id"), ("tracks", "song_id")):
        top = rewind_top(lib, user_id, period, kind, limit)
        place = F.struct((-F.col("listen_count")).alias("o"), F.col("name").alias("n"), F.col(key).alias("k"))
        entry = F.struct("blacklisted", place.alias("place"), F.struct(F.col(key).alias("id"), "name", "listen_count", "delta").alias("entry"))
        leaders = top.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]).alias(f"top_{kind}"))
        out = out.crossJoin(leaders)  # one row each
    best = top_day(lib, user_id, period).agg(F.max("day").alias("top_day"))
    return out.crossJoin(new_entities(lib, user_id, period)).crossJoin(best)


def entity_summary(lib: Library, entity_type: str, entity_id: int, user_id: int | None = None) -> DataFrame:
    """Everyone's totals from the rollup; one user's from their listens."""
    if user_id is None:
        row = lib.global_stats.where((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id))
        return row.select("plays", "unique_listeners", minutes(F.col("played_ms")).alias("minutes_listened"), "first_listened_at")
    own = of_entity(of_user(lib.eligible, user_id), lib, **{f"{entity_type}_id": entity_id})
    return own.agg(F.count("*").alias("plays"), minutes(F.sum("played_ms")).alias("minutes_listened"), F.min("listened_at").alias("first_listened_at"))


def earliest_listen(lib: Library, user_id: int | None = None) -> DataFrame:
    return of_user(lib.listens, user_id).agg(F.min("listened_at").alias("first_at"))


def calendar(lib: Library, user_id: int, start: date, weeks: int) -> DataFrame:
    """(week, weekday, day, listen_count): a Monday-aligned grid of days with zeros."""
    first = start - timedelta(start.weekday())
    days = lib.daily.sparkSession.range(weeks * 7).select((F.col("id") / 7).cast("long").alias("week"), (F.col("id") % 7).alias("weekday"), F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    counts = of_user(lib.daily, user_id).groupBy("day").agg(F.sum("listen_count").alias("n"))
    return days.join(counts, "day", "left").select("week", "weekday", "day", F.coalesce("n", F.lit(0)).alias("listen_count"))
