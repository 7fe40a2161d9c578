from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from earshot import fixtures, library
from earshot.operators import catalogue, history, merging, numbering, rollups, stats
from earshot.plans.timeframe import Timeframe
from earshot.sources import export, importers

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def lib(spark, sf_dir):
    return fixtures.library(spark, sf_dir)


@pytest.mark.parametrize("played,length,want", [(0, 0, True), (100, 200, True), (99, 200, False), (240_000, 600_000, True), (239_999, 600_000, False), (None, 500, True), (5, None, True), (2**31 - 1, 2**31 - 1, True)])
def test_eligible(spark, played, length, want):
    row = spark.createDataFrame([(played, length)], "p int, d int")
    assert row.select(rollups.eligible(F.col("p"), F.col("d")).alias("x")).first().x is want


def key(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def stored(lib, heard):
    return {"daily": rollups.daily(heard), "clock": rollups.clock(heard), "first_listens": rollups.first_listens(heard, lib.song_albums, lib.song_artists), "global_stats": rollups.global_stats(heard, lib.song_albums, lib.song_artists)}


def test_fold_and_unrecord_equal_rebuilds(lib):
    every, old, new = lib.eligible, lib.eligible.where("id % 4 > 0"), lib.eligible.where("id % 4 = 0")
    want, some = stored(lib, every), stored(lib, old)
    folded = rollups.fold(some, new, lib.song_albums, lib.song_artists)
    back = rollups.unrecord(want, new, old, lib.song_albums, lib.song_artists)
    for name in want:
        assert key(folded[name]) == key(want[name]), name
        assert key(back[name]) == key(some[name]), name


def test_streaks_and_state(spark):
    days = [date(2024, 1, d) for d in (1, 2, 3, 7, 8, 20)]
    daily = spark.createDataFrame([(1, 5, d) for d in days] + [(2, 5, date(2024, 1, 30))], "user_id long, song_id long, day date")
    found = sorted((r.user_id, r.length) for r in rollups.streaks(daily).collect())
    assert found == [(1, 1), (1, 2), (1, 3), (2, 1)]
    listens = spark.createDataFrame([(1, T0), (2, T0), (3, T0)], "user_id long, listened_at timestamp_ntz")
    state = {r.user_id: (r.current_streak, r.longest_streak) for r in rollups.user_state(listens, daily, date(2024, 1, 31)).collect()}
    assert state == {1: (0, 3), 2: (1, 1), 3: (0, 0)}


def test_session_gap_is_open_at_five_minutes(spark, lib):
    at = [T0, T0 + timedelta(minutes=5), T0 + timedelta(minutes=10, microseconds=1), T0 + timedelta(hours=2)]
    listens = spark.createDataFrame([(i, 1, 1, t, None, None) for i, t in enumerate(at)], "id long, user_id long, song_id long, listened_at timestamp_ntz, client string, duration_played_ms long")
    small = fixtures.Library(listens, *(getattr(lib, n) for n in ("songs", "artists", "albums", "song_artists", "album_artists", "song_albums", "users", "sources", "blacklist")))
    got = stats.average_session(small, 1, Timeframe(T0, T0 + timedelta(1))).first()[0]
    assert got == pytest.approx(100_000.0)


def test_latest_now_playing(spark):
    schema = "user_id long, song_id long, started_at timestamp_ntz, duration_ms long"
    old = spark.createDataFrame([(1, 1, T0, 1000), (2, 2, T0, 10_000_000), (3, 3, T0, None)], schema)
    new = spark.createDataFrame([(1, 9, T0 + timedelta(minutes=1), None)], schema)
    got = {r.user_id: r.song_id for r in history.latest_now_playing(old, new, T0 + timedelta(minutes=2)).collect()}
    assert got == {1: 9, 2: 2}


def test_catalogue_changes(spark):
    t = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id long, name string, pinned boolean")
    new = spark.createDataFrame([("x",), ("c",)], "name string")
    assert {r.id: r.name for r in catalogue.append(t, new, "name").collect()} == {1: "a", 2: "b", 3: "c", 4: "x"}
    assert {r.id: r.name for r in catalogue.update(catalogue.update(t, 1, True, name=F.lit("z")), 2, True, name=F.lit("z")).collect()} == {1: "a", 2: "z"}
    bridge = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "song_id long, artist_id long, position long")
    moved = catalogue.link(bridge, spark.createDataFrame([(1, 2, 5)], bridge.schema), ["song_id", "artist_id"])
    assert sorted(map(tuple, moved.collect())) == [(1, 1, 0), (1, 2, 5)]
    assert catalogue.insert_once(bridge, spark.createDataFrame([(1, 2, 7), (2, 2, 7)], bridge.schema), ["song_id", "artist_id"]).count() == 3


def test_attached_sources_show_one_entity_twice(spark):
    schema = "id long, entity_type string, entity_id long, source_type string, raw_url string, extracted_id string"
    present = spark.createDataFrame([(1, "song", 10, "s", None, "k1")], schema)
    new = spark.createDataFrame([(None, "song", 11, "s", None, "k1"), (None, "song", 12, "s", None, "k2"), (None, "song", 13, "s", "u", None)], schema)
    after, pairs = catalogue.attach_sources(present, new)
    assert [tuple(r) for r in pairs.collect()] == [("song", 10, 11)]
    assert sorted(r.entity_id for r in after.collect()) == [10, 12, 13]


def test_cache_keys_hold_nulls(spark):
    from earshot.schemas import STATS_CACHE

    row = lambda u, d: (u, None, None, None, "summary", "{}", d, T0)
    cache = spark.createDataFrame([row(None, "old"), row(1, "one")], STATS_CACHE)
    after = catalogue.put_cached(cache, spark.createDataFrame([row(None, "new")], STATS_CACHE))
    assert catalogue.cached(after, None, None, None, None, "summary", "{}").first().data == "new"
    assert after.count() == 2 and catalogue.invalidate_cached(after, user_id=1).count() == 0 and catalogue.invalidate_cached(after, before=T0).count() == 2


def test_merge_keeps_keys_unique(lib):
    losers = lib.songs.where("id IN (5, 6)").select(F.col("id").alias("loser_id"), F.lit(4).cast("long").alias("winner_id"))
    m = merging.merge(lib, "song", losers)
    for name, keys in (("listens", ["user_id", "song_id", "listened_at"]), ("song_artists", ["song_id", "artist_id"]), ("song_albums", ["song_id", "album_id"])):
        t = getattr(m, name)
        assert t.count() == t.select(*keys).distinct().count() and t.where("song_id IN (5, 6)").count() == 0
    assert m.songs.where("id IN (5, 6)").count() == 0
    counts = lambda x: x.global_stats.where("entity_type = 'song' AND entity_id BETWEEN 4 AND 6").agg(F.sum("plays")).first()[0]
    assert counts(m) is not None and m.listens.where("song_id = 4").count() >= lib.listens.where("song_id = 4").count()


def test_heat_levels(spark):
    df = spark.createDataFrame([(v,) for v in (0, 0, 4, 1, 3, 2, 10)], "listen_count long")
    assert [(r.level, r.up_to) for r in stats.heat_levels(df).orderBy("level").collect()] == [(1, 2), (2, 3), (3, 4), (4, 10)]


def test_export_round_trip(spark, lib, tmp_path):
    user = lib.listens.first().user_id
    export.export_document(lib, user).coalesce(1).write.json(str(tmp_path / "doc"))
    back = importers.read_export(spark, str(tmp_path / "doc"))
    want = export.export_listens(lib, user).count()
    assert back.count() == want
    names = {r.name for r in lib.songs.collect()}
    assert {r.song for r in back.collect()} <= names
    export.write_documents(lib, user, str(tmp_path / "many"), listens=7)
    assert len(list((tmp_path / "many").glob("*.json"))) == -(-want // 7)
    again = importers.read_export(spark, str(tmp_path / "many"))
    assert sorted(map(str, again.collect())) == sorted(map(str, back.collect()))
    export.write_export(lib, user, str(tmp_path / "parts"))
    assert spark.read.json(str(tmp_path / "parts" / "listens")).count() == want


def test_search_documents_follow_renames(lib):
    changed = lib.artists.where("id = 3").select(F.lit("artist").alias("kind"), "id")
    got = export.search_documents(lib, changed)
    assert got.where("kind = 'song'").count() == lib.song_artists.where("artist_id = 3").select("song_id").distinct().join(lib.songs.select(F.col("id").alias("song_id")), "song_id").count()


def test_users_of_one_song_are_dealt_by_their_number(spark, monkeypatch):
    """A song that all hear fans out in partitions of users, and all rows of a user are in one of them."""
    monkeypatch.setattr(rollups, "_ROWS_DEALT", 100)
    songs = spark.range(1000).select(F.col("id").alias("user_id"), F.lit(7).cast("long").alias("song_id"))
    bridge = lambda c, n: spark.range(n).select(F.lit(7).cast("long").alias("song_id"), F.col("id").alias(c))
    out = rollups.attributed(songs, bridge("album_id", 1), bridge("artist_id", 5)).withColumn("at", F.spark_partition_id())
    sizes = [r["count"] for r in out.groupBy("at").count().collect()]
    assert sum(sizes) == 7000 and len(sizes) > 8 and max(sizes) < 1500
    assert out.select("user_id", "at").distinct().count() == 1000


def test_a_wanted_rollup_plans_no_other(lib, monkeypatch):
    """Days and hours are folded and taken back without writing what first listens and totals need."""

    def never(df):
        raise AssertionError("a table was written")

    want, new = {n: getattr(lib, n) for n in ("daily", "clock")}, lib.eligible.where("id % 4 = 0")
    monkeypatch.setattr(rollups, "cut", never)
    for name in want:
        for change in (rollups.fold(want, new, lib.song_albums, lib.song_artists), rollups.unrecord(want, new, lib.eligible, lib.song_albums, lib.song_artists)):
            assert change[name].count() > 0


def small_change(spark):
    """Stored rollups of three users, one entity each of a song, an album and an artist, and listens of which some go."""
    schema = "id long, user_id long, song_id long, listened_at timestamp_ntz, client string, played_ms long"
    at = lambda n: None if n is None else T0 + timedelta(hours=n)
    rows = [(1, 1, 7, 0), (2, 1, 7, 5), (3, 2, 7, 0), (4, 2, 8, 3), (5, 3, 8, 1), (6, 3, 8, None), (7, 3, 7, 9)]
    heard = spark.createDataFrame([(i, u, s, at(n), "c", 10) for i, u, s, n in rows], schema)
    bridge = lambda c: spark.createDataFrame([(7, 1), (8, 1), (8, 2)], f"song_id long, {c} long")
    return heard, bridge("album_id"), bridge("artist_id")


@pytest.mark.parametrize("gone", [[1, 3], [4, 5], [1, 2, 3, 4, 5, 6, 7]])
def test_first_times_that_go_are_sought_again(spark, gone):
    heard, *bridges = small_change(spark)
    want = {"first_listens": rollups.first_listens(heard, *bridges), "global_stats": rollups.global_stats(heard, *bridges)}
    left = heard.where(~F.col("id").isin(gone))
    back = rollups.unrecord(want, heard.where(F.col("id").isin(gone)), left, *bridges)
    assert key(back["first_listens"]) == key(rollups.first_listens(left, *bridges))
    assert key(back["global_stats"]) == key(rollups.global_stats(left, *bridges))


def test_changes_are_dealt_by_the_number_of_rows(spark, lib, monkeypatch):
    """First listens after a change come from tasks of bounded size, whatever the session's number of partitions."""
    new = lib.eligible.where("id % 4 = 0")
    firsts = {"first_listens": numbering.cut(lib.first_listens)}
    monkeypatch.setattr(rollups, "_ROWS_DEALT", 100)
    for out in (rollups.fold(firsts, new, lib.song_albums, lib.song_artists), rollups.unrecord(firsts, new, lib.eligible.where("id % 4 > 0"), lib.song_albums, lib.song_artists)):
        sizes = [r["count"] for r in out["first_listens"].groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) > 500 and len(sizes) > 4 and max(sizes) < 300


def test_only_songs_that_occur_are_opened(spark, lib):
    """The lists of a bridge are made for songs with listens alone, and rows are dealt by what they open to."""
    songs = spark.createDataFrame([(u, 7) for u in range(50)], "user_id long, song_id long")
    bridge = lambda c: spark.range(100_000).select((F.col("id") % 10_000).alias("song_id"), F.col("id").alias(c))
    out = rollups.attributed(songs, bridge("album_id"), bridge("artist_id"))
    assert out.count() == 50 * 21
    read = [f for f in out.inputFiles() if "table-" in f]
    assert sum(spark.read.parquet(f).count() for f in read) == 50 + 1  # users of the song, and its one list


def test_stored_rollups_are_sorted_in_ranges_of_bounded_size(spark, lib, tmp_path, monkeypatch):
    monkeypatch.setattr(library, "_ROWS_SORTED", 100)
    firsts = lib.first_listens
    library.write_rollup(firsts, "first_listens", str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert key(back) == key(firsts)
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 300
    library.write_rollup(lib.daily, "daily", str(tmp_path / "d"))
    assert key(spark.read.parquet(str(tmp_path / "d")).drop("month").select(*lib.daily.columns)) == key(lib.daily)
