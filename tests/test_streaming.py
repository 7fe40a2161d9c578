import datetime as dt
from datetime import datetime

from pyspark.sql import functions as F

from earshot import fixtures
from earshot.operators import rollups
from earshot.streaming import live


def key(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_stream_folds_to_a_rebuild(spark, sf_dir, tmp_path):
    lib = fixtures.library(spark, sf_dir)
    src = str(tmp_path / "in")
    lib.listens.withColumn("part", F.col("id") % 3).repartition("part").write.partitionBy("part").parquet(src)
    lib.listens.where("id < 20").withColumns({"id": F.col("id") + 10_000_000, "part": F.lit(0)}).write.mode("append").partitionBy("part").parquet(src)
    stream = spark.readStream.schema(lib.listens.schema).option("maxFilesPerTrigger", 1).parquet(src)
    store = live.Store(spark, str(tmp_path / "store"), fan=2)
    live.start(stream, store, lib.songs, str(tmp_path / "ck"), every=None).awaitTermination(240)
    heard = rollups.eligible_listens(rollups.dedupe(lib.listens), lib.songs)
    held = live.Store(spark, store.path)
    assert key(held.daily()) == key(rollups.daily(heard))
    assert key(held.clock()) == key(rollups.clock(heard))
    assert key(held.first_listens(lib.song_albums, lib.song_artists)) == key(rollups.first_listens(heard, lib.song_albums, lib.song_artists))
    assert key(held.global_stats(lib.song_albums, lib.song_artists)) == key(rollups.global_stats(heard, lib.song_albums, lib.song_artists))
    assert key(held.streaks()) == key(rollups.streaks(rollups.daily(heard)))


LISTENS = "id long, user_id long, song_id long, listened_at timestamp_ntz, client string, duration_played_ms long, deleted boolean"
NO_LINKS = ("song_id long, album_id long, track_number long", "song_id long, artist_id long, position long")


def test_any_order_of_additions_and_deletions(spark, tmp_path):
    """Listens come, go and come back in random batches; the store is what a rebuild of the present listens gives, at every level."""
    import random

    r = random.Random(11)
    songs = spark.createDataFrame([(1, 200_000), (2, None), (3, 600_000)], "id long, duration_ms long")
    bridges = [spark.createDataFrame([(1, 5, 1), (2, 5, 2), (3, 6, 1)], NO_LINKS[0]), spark.createDataFrame([(1, 8, 0), (2, 8, 0), (3, 9, 0)], NO_LINKS[1])]
    store, now, n = live.Store(spark, str(tmp_path / "store"), fan=2), {}, 0
    for batch in range(4):
        rows = []
        for _ in range(14):
            n += 1
            key_of = (r.choice([1, 2]), r.choice([1, 2, 3]), datetime(2024, r.choice([1, 2]), r.randint(1, 9), r.choice([3, 20])))
            rows.append((n, *key_of, "c", r.choice([None, 1000, 300_000]), r.random() < 0.1))
        rows += [(0, *k, None, None, True) for k in r.sample(sorted(now), min(len(now), 5))]  # the first ones go too
        for k in sorted(now)[:1]:
            rows.append((0, *k, None, None, True))
        live.fold_batch(store, songs, spark.createDataFrame(rows, LISTENS), batch)
        live.fold_batch(store, songs, spark.createDataFrame(rows, LISTENS), batch)  # a replay
        for row in rows:
            if not row[-1]:
                now.setdefault(row[1:4], row)
        for row in rows:
            if row[-1]:
                now.pop(row[1:4], None)
        if batch == 3:
            present = spark.createDataFrame([x[:-1] for x in now.values()], LISTENS.rsplit(",", 1)[0])
            heard = rollups.eligible_listens(present, songs)
            held = live.Store(spark, store.path)
            assert key(held.listens()) == key(present)
            assert key(held.daily()) == key(rollups.daily(heard)) and key(held.clock()) == key(rollups.clock(heard))
            assert key(held.global_stats(*bridges)) == key(rollups.global_stats(heard, *bridges))
            assert key(held.first_listens(*bridges)) == key(rollups.first_listens(heard, *bridges))
            today = datetime(2024, 2, 9).date()
            assert key(held.user_state(today)) == key(rollups.user_state(present, rollups.daily(heard), today))


def test_levels_grow_with_the_logarithm(spark, tmp_path):
    store = live.Store(spark, str(tmp_path / "store"), fan=2)
    songs = spark.createDataFrame([(1, None)], "id long, duration_ms long")
    for i in range(6):
        live.fold_batch(store, songs, spark.createDataFrame([(i, 1, 1, datetime(2024, 1, 1 + i), "c", None, False)], LISTENS), i)
    version, runs = store.manifest()
    assert version == 6 and [(r["level"], r["first"], r["last"]) for r in runs] == [(2, 0, 3), (1, 4, 5)]
    assert store.daily(["2024-01"]).count() == 6 and store.daily(["2023-12"]).count() == 0


def test_live_streaks(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "user_id long, listened_at timestamp"
    for days in ([1, 1, 2], [3, 5], [4, 6, 7, 8, 9]):
        spark.createDataFrame([(1, datetime(2024, 1, d, 10)) for d in days], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = live.live_streaks(stream).writeStream.outputMode("update").format("memory").queryName("streaks").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = sorted((r.last_day.day, r.current_streak, r.longest_streak) for r in spark.table("streaks").collect())
    assert rows[-1] == (9, 5, 5) and (5, 1, 3) in rows


def test_streaming_windows(spark, sf_dir, tmp_path):
    lib = fixtures.library(spark, sf_dir)
    src = str(tmp_path / "in")
    lib.eligible.write.parquet(src)
    stream = spark.readStream.schema(lib.eligible.schema).parquet(src)
    q = live.daily_counts(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("daily_counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("daily_counts").agg(F.sum("listen_count")).first()[0] == lib.eligible.count()
    q = live.live_sessions(stream).writeStream.outputMode("append").format("memory").queryName("live_sessions").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("live_sessions").count() > 0


def test_live_streaks_of_users_that_share_a_state(spark, tmp_path, monkeypatch):
    """A batch makes no more groups than there are buckets; each user's streak goes on from its own last day."""
    monkeypatch.setattr(live, "STREAK_BUCKETS", 2)
    day = lambda n: dt.datetime(2024, 1, n, 12)
    batches = [[(u, day(n)) for u in range(9) for n in (1, 2)], [(u, day(3 if u % 2 else 5)) for u in range(0, 9, 2)] + [(1, day(3)), (1, day(2)), (99, day(7))]]
    schema = "user_id long, listened_at timestamp_ntz"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sizes = []
    q = live.live_streaks(stream).writeStream.outputMode("update").foreachBatch(lambda b, i: sizes.append(sorted(map(tuple, b.collect())))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    assert sizes[0] == [(u, dt.date(2024, 1, 2), 2, 2) for u in range(9)]
    assert sizes[1] == sorted([(u, dt.date(2024, 1, 5), 1, 2) for u in range(0, 9, 2)] + [(1, dt.date(2024, 1, 3), 3, 3), (99, dt.date(2024, 1, 7), 1, 1)])
