"""Totals count listeners for a part of the users after the other, and carry nothing else to them."""

import random

from earshot.operators import rollups


def test_totals_are_those_of_rows_by_user(spark, monkeypatch):
    r = random.Random(7)
    heard = spark.createDataFrame([(r.choice([None, *range(40)]), r.randrange(30), f"2024-01-{r.randint(1, 28):02d}", r.choice([None, 5, 700])) for _ in range(900)], "user_id long, song_id long, listened_at string, played_ms long")
    albums = spark.createDataFrame([(s, s % 4 or None) for s in range(28)], "song_id long, album_id long")
    artists = spark.createDataFrame([(s, a) for s in range(25) for a in r.sample(range(-3, 6), s % 4)] + [(99, 1)], "song_id long, artist_id long")
    want = sorted(map(tuple, rollups.totals(rollups.per_user(heard, albums, artists)).collect()), key=str)
    written = []
    of = rollups.cut
    monkeypatch.setattr(rollups, "cut", lambda df: (written.append(df.columns), of(df))[1])
    got = {}
    for rows in (rollups._ROWS_AT_ONCE, 300):
        monkeypatch.setattr(rollups, "_ROWS_AT_ONCE", rows)
        written.clear()
        out = rollups.global_stats(heard, albums, artists)
        got[sum(c == ["code", "unique_listeners"] for c in written)] = sorted(map(tuple, out.select("entity_type", "entity_id", "plays", "unique_listeners", "played_ms", "first_listened_at").collect()), key=str)
    assert list(got) == [1, max(got)] and max(got) > 2 and all(x == want for x in got.values())
    assert spark.conf.get(rollups._LET_GO) == "false"
