
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .library import Library, content_digest
from .operators.numbering import shared_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_name").alias("name"), F.when(key % 10 != 0, (30 + key % 100) * 1000).cast("long").alias("duration_ms"), (key % 13 == 0).alias("pinned")
    )


def library(spark: SparkSession, sf_dir: str) -> Library:
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    events = read(spark, sf_dir, "events")
    song = songs(spark, sf_dir)
    listens = events.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("song_id"),
        F.col("ts").alias("listened_at"),
        F.col("event_type").alias("client"),
        F.when(F.col("event_type") != "error", F.round(F.col("value") * 1000).cast("long")).alias("duration_played_ms"),
    )
    artists = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    album_id = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    albums = part.select(album_id.alias("id"), F.col("p_brand").alias("name")).distinct()
    albums = albums.withColumn("release_date", F.when(F.col("id") % 5 != 0, F.date_add(F.to_date(F.lit("2000-01-01")), F.col("id").cast("int"))))
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("song_id"), F.col("l_suppkey").alias("artist_id")).distinct()
    by_song = Window.partitionBy("song_id").orderBy("artist_id")
    song_artists = pairs.withColumn("position", (F.row_number().over(by_song) - 1).cast("long"))
    track = F.when(F.col("p_size") % 5 != 0, F.col("p_size")).cast("long")
    song_albums = part.select(F.col("p_partkey").alias("song_id"), album_id.alias("album_id"), track.alias("track_number"))
    by_album = Window.partitionBy("album_id").orderBy("artist_id")
    album_artists = (
        song_albums.join(song_artists, "song_id").select("album_id", "artist_id").distinct().withColumn("position", (F.row_number().over(by_album) - 1).cast("long"))
    )
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), (F.col("c_acctbal") > 0).alias("public"))
    source = part.select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("source_type"))
    method = F.when(F.col("id") % 2 == 0, "source_id").otherwise("fuzzy_name")
    sources = (
        source.select((F.col("entity_id") * 2 + 1).alias("id"), "entity_id", "source_type")
        .unionByName(source.where("entity_id % 3 = 0").select((F.col("entity_id") * 2).alias("id"), "entity_id", F.lit("MIRROR").alias("source_type")))
        .select("id", F.lit("song").alias("entity_type"), "entity_id", "source_type", F.concat_ws("-", "source_type", "entity_id").alias("extracted_id"), method.alias("correlation_method"))
    )
    heard = listens.join(song_artists, "song_id").select("user_id", "artist_id").distinct()
    blacklist = heard.where((F.col("user_id") * 7 + F.col("artist_id")) % 11 == 0)
    latest = listens.groupBy("user_id").agg(F.max_by(F.struct("song_id", F.col("listened_at").alias("started_at")), F.struct("listened_at", "id")).alias("l"))
    now_playing = (
        latest.select("user_id", "l.song_id", "l.started_at")
        .join(song.select(F.col("id").alias("song_id"), (F.col("duration_ms") * 600).alias("duration_ms")), "song_id")
        .select("user_id", "song_id", "started_at", "duration_ms")
    )
    take = part.where("p_partkey % 5 = 0").select((F.col("p_partkey") * 2).alias("id"), F.lit("song").alias("entity_type"), F.col("p_partkey").alias("entity_id"), F.concat("p_type", F.lit(" take "), "p_size").alias("alias"))
    aliases = take.unionByName(
        supplier.where("s_suppkey % 4 = 0").select((F.col("s_suppkey") * 2 + 1).alias("id"), F.lit("artist").alias("entity_type"), F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("The "), "s_name").alias("alias"))
    )
    return Library(listens, song, artists, albums, song_artists, album_artists, song_albums, users, sources, blacklist, now_playing, aliases)


def stored_library(spark: SparkSession, sf_dir: str) -> Library:
    """The library with its rollups stored in the shared folder, in one that belongs to this session and the files that the rollups come from."""
    content = content_digest(*(read(spark, sf_dir, t) for t in ("events", "part", "lineitem")))
    return replace(library(spark, sf_dir), store=f"{shared_folder(spark)}/rollups-{spark.sparkContext.applicationId}-{content}")


def big_listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger history: one listen for each line of an order."""
    line = read(spark, sf_dir, "lineitem")
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("song_id"),
        F.col("l_shipdate").alias("listened_at"),
        F.col("l_returnflag").alias("client"),
        (F.col("l_quantity") * 10000).cast("long").alias("duration_played_ms"),
    )
