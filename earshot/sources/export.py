"""Exports of a user's history, and documents for a search index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..library import Library
from ..operators.numbering import cut, numbered
from ..operators.stats import of_user


def export_listens(lib: Library, user_id: int) -> DataFrame:
    """(song_id, listened_at, client, duration_played_ms) in time order: the listens part of an export, a row each."""
    known = lib.songs.select(F.col("id").alias("song_id"))
    own = of_user(lib.listens, user_id).join(known, "song_id", "left_semi")
    return own.select("song_id", "listened_at", "client", "duration_played_ms", "id").orderBy("listened_at", "id").drop("id")


def export_entities(lib: Library, user_id: int) -> dict[str, DataFrame]:
    """songs, albums and artists that the user's listens refer to, one row each, with what they link to."""
    songs = of_user(lib.listens, user_id).select("song_id").distinct()
    in_order = lambda b, key, other, order: b.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, other))), lambda s: s[other]).alias(f"{other}s"))
    bridge_artists = lib.song_artists.join(songs, "song_id", "left_semi")
    bridge_albums = lib.song_albums.join(songs, "song_id", "left_semi").withColumn("_order", F.coalesce("track_number", F.lit(2**31)))
    links = lib.sources.where("entity_type = 'song'").groupBy(F.col("entity_id").alias("song_id")).agg(F.array_sort(F.collect_list(F.struct("id", "source_type", "extracted_id"))).alias("sources"))
    song = (
        lib.songs.select(F.col("id").alias("song_id"), "name", "duration_ms").join(songs, "song_id", "left_semi")
        .join(in_order(bridge_artists, "song_id", "artist_id", "position"), "song_id", "left")
        .join(in_order(bridge_albums, "song_id", "album_id", "_order"), "song_id", "left").join(links, "song_id", "left")
    )
    albums = lib.albums.join(bridge_albums.select(F.col("album_id").alias("id")).distinct(), "id", "left_semi")
    artists = lib.artists.join(bridge_artists.select(F.col("artist_id").alias("id")).distinct(), "id", "left_semi")
    return {"songs": song, "albums": albums, "artists": artists}


def write_export(lib: Library, user_id: int, path: str) -> None:
    """The export as JSON lines, a folder for each part; no part passes through one task or the driver."""
    export_listens(lib, user_id).write.mode("overwrite").json(f"{path}/listens")
    for name, df in export_entities(lib, user_id).items():
        df.write.mode("overwrite").json(f"{path}/{name}")


#: Listens in one document of an export.
LISTENS = 20_000


def export_document(lib: Library, user_id: int, listens: int = LISTENS) -> DataFrame:
    """Nested documents, as services exchange them: maps of artists, albums and songs, and listens in order.

    There is one for each ``listens`` listens in the order of time, so for most users one in all, and each holds the
    entities that its own listens refer to. So each can be read alone, and none grows with the history. A user without
    listens of known songs has none.
    """
    parts = export_entities(lib, user_id)
    blank = F.array().cast("array<struct<source_type:string,raw_url:string>>")
    rows = of_user(lib.listens, user_id).join(lib.songs.select(F.col("id").alias("song_id")), "song_id", "left_semi")
    rows = numbered(rows.select("id", "song_id", "listened_at", "client", "duration_played_ms"), "listened_at", "id").withColumn("part", F.floor((F.col("n") - 1) / listens))
    time = F.date_format("listened_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("listened_at")
    heard = rows.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("n", F.struct("song_id", time, "client", "duration_played_ms").alias("l")))).alias("l"))
    out = heard.select("part", F.transform("l", lambda x: x["l"]).alias("listens"))
    songs = cut(rows.select("part", "song_id").distinct().join(parts["songs"], "song_id"))
    links = F.transform("sources", lambda s: F.struct(s["source_type"].alias("source_type"), F.lit(None).cast("string").alias("raw_url"))).alias("sources")
    entries = {"songs": songs.select("part", F.col("song_id").alias("id"), F.struct("name", links, "duration_ms", "artist_ids", "album_ids").alias("entry"))}
    for kind in ("artist", "album"):
        ids = songs.select("part", F.explode(f"{kind}_ids").alias("id")).distinct()
        entries[f"{kind}s"] = ids.join(parts[f"{kind}s"].select("id", F.struct("name", blank.alias("sources")).alias("entry")), "id")
    for name, df in entries.items():
        held = df.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "entry"))).alias(name))
        out = out.join(held, "part", "left")
    maps = [F.coalesce(c, F.create_map().cast(out.schema[c].dataType)).alias(c) for c in ("artists", "albums", "songs")]
    return out.select(F.lit("earshot").alias("format"), F.lit(1).alias("version"), *maps, "listens")


def write_documents(lib: Library, user_id: int, path: str, listens: int = LISTENS) -> None:
    """The documents of an export as JSON, each in a file of its own."""
    export_document(lib, user_id, listens).write.option("maxRecordsPerFile", 1).mode("overwrite").json(path)


def search_documents(lib: Library, changed: DataFrame | None = None) -> DataFrame:
    """(kind, id, name, artists, albums, aliases) for every artist, album and song.

    With ``changed`` (kind, id), only these and what shows their names: an artist's albums and songs, an
    album's songs.
    """
    names = lambda t, key: t.select(F.col("id").alias(key), F.col("name").alias(f"{key}_name"))
    listed = lambda b, key, other, t: b.join(names(t, other), other).groupBy(key).agg(F.array_sort(F.collect_set(f"{other}_name")).alias("n"))
    empty = F.array().cast("array<string>")
    of = lambda df, key, col: df.select(F.col(key).alias("id"), F.col("n").alias(col))
    song = lib.songs.select("id", "name").join(of(listed(lib.song_artists, "song_id", "artist_id", lib.artists), "song_id", "artists"), "id", "left").join(
        of(listed(lib.song_albums, "song_id", "album_id", lib.albums), "song_id", "albums"), "id", "left"
    )
    album = lib.albums.select("id", "name").join(of(listed(lib.album_artists, "album_id", "artist_id", lib.artists), "album_id", "artists"), "id", "left")
    kinds = [("song", song), ("album", album.withColumn("albums", empty)), ("artist", lib.artists.select("id", "name").withColumns({"artists": empty, "albums": empty}))]
    docs = None
    for kind, df in kinds:
        part = df.select(F.lit(kind).alias("kind"), "id", "name", F.coalesce("artists", empty).alias("artists"), F.coalesce("albums", empty).alias("albums"))
        docs = part if docs is None else docs.unionByName(part)
    if lib.aliases is not None:
        alias = lib.aliases.groupBy(F.col("entity_type").alias("kind"), F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
        docs = docs.join(alias, ["kind", "id"], "left").withColumn("aliases", F.coalesce("aliases", empty))
    else:
        docs = docs.withColumn("aliases", empty)
    if changed is None:
        return docs
    artist = changed.where("kind = 'artist'").select(F.col("id").alias("artist_id"))
    album_ids = changed.where("kind = 'album'").select(F.col("id").alias("album_id"))
    touched = (
        changed.select("kind", "id")
        .unionByName(lib.album_artists.join(artist, "artist_id", "left_semi").select(F.lit("album").alias("kind"), F.col("album_id").alias("id")))
        .unionByName(lib.song_artists.join(artist, "artist_id", "left_semi").select(F.lit("song").alias("kind"), F.col("song_id").alias("id")))
        .unionByName(lib.song_albums.join(album_ids, "album_id", "left_semi").select(F.lit("song").alias("kind"), F.col("song_id").alias("id")))
        .distinct()
    )
    return docs.join(touched, ["kind", "id"], "left_semi")
