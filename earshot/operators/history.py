"""Listen histories, who listens now, and searches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..library import Library
from ..plans.timeframe import Timeframe
from .stats import in_time, of_entity, of_user

PAGE, MAX_PAGE = 20, 100


def page(df: DataFrame, number: int = 1, per_page: int = PAGE) -> DataFrame:
    per_page = max(1, min(per_page, MAX_PAGE))
    start = (max(1, number) - 1) * per_page
    return (df.offset(start) if start else df).limit(per_page)


def history(
    lib: Library, period: Timeframe, user_id: int | None = None, song_id: int | None = None, album_id: int | None = None, artist_id: int | None = None, source_type: str | None = None
) -> DataFrame:
    """Listens of a period, all of them, that meet the filters given; see newest_first and count."""
    out = of_entity(in_time(of_user(lib.listens, user_id), period), lib, artist_id, album_id, song_id)
    if source_type is not None:
        with_source = lib.sources.where((F.col("entity_type") == "song") & (F.col("source_type") == source_type)).select(F.col("entity_id").alias("song_id"))
        out = out.join(with_source, "song_id", "left_semi")
    return out.select("id", "user_id", "song_id", "listened_at", "client")


def newest_first(listens: DataFrame) -> DataFrame:
    return listens.orderBy(F.desc("listened_at"), F.desc("id"))


def count(listens: DataFrame) -> DataFrame:
    return listens.agg(F.count("*").alias("n"))


def entity_listens(lib: Library, user_id: int | None = None, song_id: int | None = None, album_id: int | None = None, artist_id: int | None = None) -> DataFrame:
    """Counting listens of an entity with the listener's name, which private users do not show."""
    own = of_entity(of_user(lib.eligible, user_id), lib, artist_id, album_id, song_id)
    users = lib.users.select(F.col("id").alias("user_id"), "username", "public")
    named = own.join(users, "user_id")
    return named.select("id", F.when(F.col("public"), F.col("user_id")).alias("user_id"), F.when(F.col("public"), F.col("username")).alias("username"), "song_id", "listened_at")


def unexpired(now_playing: DataFrame, now: datetime) -> DataFrame:
    """Rows whose song has not ended; one of unknown length ends at once."""
    length = F.make_dt_interval(secs=F.coalesce(F.col("duration_ms"), F.lit(0)).cast("decimal(18,6)") / 1000)
    return now_playing.where(F.col("started_at") + length >= F.lit(now))


def now_playing(
    lib: Library, now: datetime, viewer_id: int | None = None, song_id: int | None = None, album_id: int | None = None, artist_id: int | None = None
) -> DataFrame:
    """What public users, and the viewer, are listening to."""
    live = of_entity(unexpired(lib.now_playing, now), lib, artist_id, album_id, song_id)
    seen = F.col("public") if viewer_id is None else F.col("public") | (F.col("user_id") == viewer_id)
    return live.join(lib.users.select(F.col("id").alias("user_id"), "username", "public"), "user_id").where(seen).select("user_id", "username", "song_id", "started_at", "duration_ms")


def latest_now_playing(present: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """One row a user, the latest; others that have ended go as well."""
    rows = present.unionByName(new)
    latest = rows.groupBy("user_id").agg(F.max_by(F.struct("song_id", "started_at", "duration_ms"), "started_at").alias("r")).select("user_id", "r.*")
    fresh = latest.join(new.select("user_id").distinct(), "user_id", "left_semi")
    return fresh.unionByName(unexpired(latest.join(new.select("user_id").distinct(), "user_id", "left_anti"), now))


def search_listens(lib: Library, user_id: int, text: str) -> DataFrame:
    """A user's listens of songs whose name, or an artist's name, contains the text; % and _ are wildcards."""
    pattern = f"%{text}%"
    by_artist = lib.song_artists.join(lib.artists.where(F.col("name").ilike(pattern)).select(F.col("id").alias("artist_id")), "artist_id", "left_semi").select("song_id")
    by_name = lib.songs.where(F.col("name").ilike(pattern)).select(F.col("id").alias("song_id"))
    hit = by_name.unionByName(by_artist).distinct()
    known = lib.songs.select(F.col("id").alias("song_id"))
    return of_user(lib.listens, user_id).join(known, "song_id", "left_semi").join(hit, "song_id", "left_semi").select("id", "song_id", "listened_at")


def search_aliases(aliases: DataFrame, entity_type: str, text: str, limit: int) -> DataFrame:
    return aliases.where((F.col("entity_type") == entity_type) & F.col("alias").ilike(f"%{text}%")).orderBy("alias", "id").limit(limit)


def search(lib: Library, text: str, limit: int = 25) -> DataFrame:
    """(kind, id, name, score): the best of each kind, artists, albums and songs by name or alias, users by name."""
    found = None
    for kind, entities in (("artist", lib.artists), ("album", lib.albums), ("song", lib.songs), ("user", lib.users.select("id", F.col("username").alias("name")))):
        aliases = None if lib.aliases is None or kind == "user" else lib.aliases.where(F.col("entity_type") == kind)
        part = search_names(entities, aliases, text, limit).select(F.lit(kind).alias("kind"), "id", "name", "score")
        found = part if found is None else found.unionByName(part)
    return found


def search_names(entities: DataFrame, aliases: DataFrame | None, text: str, limit: int = 25) -> DataFrame:
    """(id, name, score): entities that hold words of the text in name or alias, the share of words found first."""
    words = list(dict.fromkeys(text.lower().split()))
    names = entities.select("id", F.col("name").alias("said"))
    if aliases is not None:
        names = names.unionByName(aliases.select(F.col("entity_id").alias("id"), F.col("alias").alias("said")))
    found = sum((F.lower("said").contains(w).cast("int") for w in words), F.lit(0)) / F.lit(float(max(1, len(words))))
    best = names.withColumn("score", found).where("score > 0").groupBy("id").agg(F.max("score").alias("score"))
    return best.join(entities.select("id", "name"), "id").orderBy(F.desc("score"), "name", "id").limit(limit)
