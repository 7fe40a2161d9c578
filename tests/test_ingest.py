from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from earshot.functions import text
from earshot.library import Library
from earshot.operators import ingest
from earshot.schemas import LISTEN_INPUT

T0 = datetime(2024, 1, 1)
TRACK = "https://www.deezer.com/track/14408104"


@pytest.fixture(scope="module")
def lib(spark):
    make = spark.createDataFrame
    return Library(
        listens=make([(1, 9, 1, T0, "c", None)], "id long, user_id long, song_id long, listened_at timestamp_ntz, client string, duration_played_ms long"),
        songs=make([(1, "Red Widget", 200_000), (2, "Blue Bolt", None)], "id long, name string, duration_ms long"),
        artists=make([(1, "The Makers"), (2, "Others")], "id long, name string"),
        albums=make([(1, "First")], "id long, name string"),
        song_artists=make([(1, 1, 0), (2, 2, 0)], "song_id long, artist_id long, position long"),
        album_artists=make([(1, 1, 0)], "album_id long, artist_id long, position long"),
        song_albums=make([(1, 1, 3)], "song_id long, album_id long, track_number long"),
        users=make([(9, "u", True)], "id long, username string, public boolean"),
        sources=make([(1, "song", 2, "deezer", "14408104", "source_id")], "id long, entity_type string, entity_id long, source_type string, extracted_id string, correlation_method string"),
        blacklist=make([], "user_id long, artist_id long"),
    )


def row(n, song, artists, album=None, url=None, at=None):
    return (9, url, artists, song, album, at or T0 + timedelta(hours=n), None, None, "c", None, None, None, "test")


def test_ingest(spark, lib):
    rows = [
        row(1, "red widget", ["the makers"], "First"), row(2, "Whatever it is called", [], url=TRACK), row(3, "New Song", ["New Band", "The Makers"], "New Album"),
        row(4, "new song", ["The Makers", "New Band"], "New Album"), row(5, "", []), row(0, "Red Widget", ["The Makers"], at=T0), row(6, "Red Widget (live)", ["The Makers"]),
    ]
    out, suggested = ingest.ingest(lib, spark.createDataFrame(rows, LISTEN_INPUT))
    songs = {r.name: r.id for r in out.songs.collect()}
    assert sorted(songs.values()) == [1, 2, 3, 4] and {"Red Widget (live)", "Red Widget", "Blue Bolt"} < set(songs)
    assert {r.name for r in out.artists.collect()} == {"The Makers", "Others", "New Band"}
    assert {r.name for r in out.albums.collect()} == {"First", "New Album"}
    new = songs.get("New Song") or songs.get("new song")
    heard = {(r.listened_at - T0).seconds // 3600: r.song_id for r in out.listens.collect()}
    assert heard == {0: 1, 1: 1, 2: 2, 3: new, 4: new, 6: songs["Red Widget (live)"]}
    ids = [r.id for r in out.listens.collect()]
    assert len(set(ids)) == len(ids) == 6
    assert out.song_artists.where(F.col("song_id") == new).count() == 2 and out.song_albums.where(F.col("song_id") == new).count() == 1
    assert out.song_albums.where("song_id = 1").first().track_number == 3
    assert out.daily.count() > 0 and suggested.columns == ["entity_type", "lo_id", "hi_id", "score"]


def test_one_track_is_one_song(spark, lib):
    """Two titles of one new track are one song with one source; accepted names become aliases; a second run adds nothing."""
    url = "https://www.deezer.com/track/77"
    rows = [row(1, "First Title", ["The Makers"], url=url), row(2, "Quite Another", ["The Makers"], url=url), row(3, "red widget", ["The Makers"])]
    frame = spark.createDataFrame(rows, LISTEN_INPUT)
    out, _ = ingest.ingest(lib, frame)
    assert out.songs.count() == 3 and {r.name for r in out.songs.collect()} >= {"First Title"}
    own = out.sources.where("extracted_id = '77'").collect()
    assert [(r.entity_id, r.correlation_method) for r in own] == [(3, "fuzzy_name")]
    assert ("song", 1, "red widget") in {(r.entity_type, r.entity_id, r.alias) for r in out.aliases.collect()}
    again, _ = ingest.ingest(out, frame)
    for table in ("listens", "songs", "artists", "albums", "sources", "song_artists", "song_albums", "aliases"):
        assert getattr(again, table).count() == getattr(out, table).count(), table


def test_aliases_find_entities(spark, lib):
    from dataclasses import replace

    aliases = spark.createDataFrame([("song", 2, "Xylophone Dream")], "entity_type string, entity_id long, alias string")
    known = ingest.known_entities(replace(lib, aliases=aliases), "song")
    from earshot.operators import matching

    inputs = spark.createDataFrame([(5, "Xylophone", "xylophone", [])], "input_id long, name string, name_normalized string, artists array<string>")
    assert [r.id for r in matching.candidates(inputs, known).collect()] == [2]


def test_ingest_of_nothing(spark, lib):
    out, suggested = ingest.ingest(lib, spark.createDataFrame([], LISTEN_INPUT))
    assert out.listens.count() == 1 and suggested.count() == 0


@pytest.mark.parametrize("raw,want", [(" Ab.c ", "ab.c"), ("a", None), (".ab", None), ("a..b", None), ("ab.", None), ("a b", None), ("x" * 33, None), (None, None)])
def test_usernames(spark, raw, want):
    assert spark.range(1).select(text.username(F.lit(raw).cast("string")).alias("x")).first().x == want


def test_json_and_images(spark):
    doc = F.lit('{"a": [{"b": "x"}]}')
    images = F.array(F.struct(F.lit("s").alias("url"), F.lit(10).alias("width")), F.struct(F.lit("").alias("url"), F.lit(90).alias("width")), F.struct(F.lit("w").alias("url"), F.lit(20).alias("width")))
    r = spark.range(1).select(text.json_at(doc, "a", 0, "b").alias("x"), text.json_at(doc, "a", 1, "b").alias("y"), text.widest_image(images).alias("w")).first()
    assert tuple(r) == ("x", None, "w")
