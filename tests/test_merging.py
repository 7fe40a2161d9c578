"""Classes of merged entities, conflicts of sources, and reconciling until nothing changes."""

import random
from datetime import datetime

import pytest

from earshot.library import Library
from earshot.operators import merging, reconciling


def pairs(spark, rows):
    return spark.createDataFrame(rows, "a long, b long")


def plain_roots(edges):
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(3))
def test_classes_of_chains_stars_and_doubled_pairs(spark, seed):
    r = random.Random(seed)
    chain = [(i + 1, i) for i in range(40)]
    star = [(500, 500 + i) for i in range(1, 60)]
    loose = [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(70)]
    every = [*chain, *star, *loose, *chain[:5], *[(b, a) for a, b in chain[:5]], (7, 7)]
    r.shuffle(every)
    want = {x: w for x, w in plain_roots([e for e in every if e[0] != e[1]]).items() if x != w}
    got = merging.contract(pairs(spark, every)).collect()
    assert {g.loser_id: g.winner_id for g in got} == want and len(got) == len(want)


def test_pinned_entities_win_and_are_never_merged(spark):
    pinned = spark.createDataFrame([(5,), (9,), (30,), (31,)], "id long")
    edges = [(1, 2), (2, 5), (3, 9), (3, 4), (4, 5), (30, 31), (7, 8), (20, 30)]
    got = {g.loser_id: g.winner_id for g in merging.contract(pairs(spark, edges), pinned).collect()}
    assert got == {1: 5, 2: 5, 3: 5, 4: 5, 8: 7, 20: 30}  # 3 and 4 are one class between 5 and 9


def test_contract_of_nothing(spark):
    assert merging.contract(pairs(spark, [])).collect() == []
    assert merging.contract(pairs(spark, [(1, 1)]), spark.createDataFrame([], "id long")).collect() == []


T = datetime(2024, 1, 1)


def library(spark, songs, listens=(), sources=(), artists=()):
    make = spark.createDataFrame
    return Library(
        listens=make(list(listens), "id long, user_id long, song_id long, listened_at timestamp_ntz, client string, duration_played_ms long"),
        songs=make(songs, "id long, name string, duration_ms long, pinned boolean"),
        artists=make([(1, "The Makers"), (2, "Others")], "id long, name string"),
        albums=make([], "id long, name string"),
        song_artists=make(list(artists) or [(s[0], 1, 0) for s in songs], "song_id long, artist_id long, position long"),
        album_artists=make([], "album_id long, artist_id long, position long"),
        song_albums=make([], "song_id long, album_id long, track_number long"),
        users=make([], "id long, username string, public boolean"),
        sources=make(list(sources), "id long, entity_type string, entity_id long, source_type string, extracted_id string, correlation_method string"),
        blacklist=make([], "user_id long, artist_id long"),
        aliases=make([(1, "song", s[0], s[1]) for s in songs], "id long, entity_type string, entity_id long, alias string"),
    )


def test_sources_that_conflict_merge_in_chains(spark):
    songs = [(i, f"name {i}", None, False) for i in (1, 2, 3, 4)]
    listens = [(10 + i, 9, i, T, "c", None) for i in (1, 2, 3, 4)]
    sources = [(i, "song", i, "deezer", f"k{i}", "fuzzy_name") for i in (1, 2, 3)]
    claims = spark.createDataFrame([("song", 2, "deezer", "k1", "m"), ("song", 3, "deezer", "k2", "m"), ("song", 4, "deezer", "new", "m")], "entity_type string, entity_id long, source_type string, extracted_id string, correlation_method string")
    out = merging.attach(library(spark, songs, listens, sources), claims)
    assert sorted(r.id for r in out.songs.collect()) == [1, 4]
    assert sorted((r.song_id, r.id) for r in out.listens.collect()) == [(1, 11), (4, 14)]  # one user and time: the winner's own stays
    assert sorted((r.entity_id, r.extracted_id) for r in out.sources.collect()) == [(1, "k1"), (1, "k2"), (1, "k3"), (4, "new")]
    ids = [r.id for r in out.sources.collect()]
    assert len(set(ids)) == len(ids)


def test_reconciling_goes_on_until_nothing_changes(spark):
    """Lengths link in chains, a winner is judged again, a pinned song takes what reaches it, and another artist's song stays."""
    songs = [(1, "Song", 100_000, False), (2, "Song", 104_000, False), (3, "Song", 108_000, False), (4, "Song", 112_000, True), (5, "Song", 160_000, False), (6, "Song", 161_000, False), (7, "Song", 100_000, False)]
    artists = [(i, 1, 0) for i in range(1, 7)] + [(7, 2, 0)]
    listens = [(i, 9, i, datetime(2024, 1, i), "c", None) for i in range(1, 8)] + [(50, 9, 2, datetime(2024, 1, 1), "c", None)]
    out, suggested, merges = reconciling.reconcile(library(spark, songs, listens, artists=artists), "song", spark.createDataFrame([(i,) for i in range(1, 8)], "id long"))
    assert {r.loser_id: r.winner_id for r in merges.collect()} == {1: 4, 2: 4, 3: 4, 6: 5}
    assert sorted(r.id for r in out.songs.collect()) == [4, 5, 7]
    assert sorted((r.song_id, r.listened_at.day) for r in out.listens.collect()) == [(4, 1), (4, 2), (4, 3), (4, 4), (5, 5), (5, 6), (7, 7)]
    assert suggested.count() == 0 and out.daily.count() == 7
    again, _, none = reconciling.reconcile(out, "song", out.songs.select("id"))
    assert none.count() == 0 and again.songs.count() == 3


def test_entities_known_apart_are_suggested_and_mapped(spark):
    songs = [(1, "Song", None, False), (2, "Song", None, False), (3, "Song", 5000, False)]
    sources = [(1, "song", 1, "deezer", "a", "m"), (2, "song", 2, "deezer", "b", "m")]
    out, suggested, merges = reconciling.reconcile(library(spark, songs, sources=sources), "song", spark.createDataFrame([(2,), (3,)], "id long"))
    assert {r.loser_id: r.winner_id for r in merges.collect()} == {3: 1}
    assert [(r.lo_id, r.hi_id) for r in suggested.collect()] == [(1, 2)]
