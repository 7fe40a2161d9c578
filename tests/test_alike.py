"""Names and lists that are all alike to some degree cost what is near, not each with each."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from earshot.functions.text import trigram_similarity
from earshot.operators import matching, namesakes


def test_numbered_names_are_not_compared_each_with_each(spark, monkeypatch):
    """The best ten are those of all pairs, though most pairs above the lowest floor are never made."""
    made = []
    of = matching._similar
    monkeypatch.setattr(matching, "_similar", lambda q, n, floor: (found := matching.cut(of(q, n, floor)), made.append((floor, found.count())))[0])
    monkeypatch.setattr(matching, "_FEW", 100)
    monkeypatch.setattr(matching, "_MET_DEALT", 500)  # pieces that many pairs share are parted
    names = [f"supplier {i:06d}" for i in range(150)] + ["red widget", "red widgets", "blue bolt"]
    own = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    asked = spark.createDataFrame([(n,) for n in [*names[:150:10], "red widget", "bolt", "supplier", "zyxwv"]], "query string")
    got = {(r.query, r.id, r.hint) for r in matching.nearest(asked, own).collect()}
    every = {}
    for r in asked.crossJoin(own).withColumn("s", trigram_similarity(F.col("query"), F.col("name"))).where("s >= 0.3").collect():
        every.setdefault(r.query, []).append((-r.s, r.id))
    assert got == {(q, i, -s) for q, found in every.items() for s, i in sorted(found)[:10]}
    assert made[0][0] == 0.75 and sum(n for _, n in made) < sum(map(len, every.values())) / 2


def test_entities_near_a_name_are_those_that_share_an_artist(spark, monkeypatch):
    """More entities near a name than one number has bits for; an input shares many artists with each."""
    monkeypatch.setattr(matching, "_BITS", 5)
    known = spark.createDataFrame([(i, [str(a) for a in range(20) if (a + i) % 3], [f"n{i % 4}"]) for i in range(12)] + [(12, [], [])], "id long, artists array<string>, artist_names array<string>")
    near = known.select(F.lit("q").alias("query"), "id", (F.col("id") / 20).alias("hint"))
    asked = spark.createDataFrame([(1, "q", ["0", "3", "6"], []), (2, "q", ["99"], ["n2"]), (3, "q", [], []), (4, "other", ["0"], [])], "input_id long, query string, artists array<string>, artist_names array<string>")
    got = [(r.input_id, r.id, r.hint) for r in matching._by_names(asked, near, known).collect()]
    want = [(1, i) for i in range(12) if i % 3] + [(2, i) for i in range(12) if i % 4 == 2] + [(3, i) for i in range(12)] + [(n, 12) for n in (1, 2, 3)]
    assert sorted(got) == sorted((n, i, i / 20) for n, i in want)


def test_short_and_long_lists_take_the_steps_of_the_short(monkeypatch):
    steps = []
    of = namesakes._spread
    monkeypatch.setattr(namesakes, "_spread", lambda counts: (steps.append(int(np.sum(counts))), of(counts))[1])
    table = lambda lists: namesakes._Lists(pa.chunked_array([pa.array(lists, pa.list_(pa.int64()))]))
    short, long = [[k, k + 1, 10**6] for k in range(200)], [list(range(5000)), [], [7]]
    i, j = np.repeat(np.arange(200), 3), np.tile(np.arange(3), 200)
    got = table(short).shared(table(long), i, j)
    assert got.tolist() == [len(set(short[a]) & set(long[b])) for a, b in zip(i, j)]
    assert table(long).shared(table(short), j, i).tolist() == got.tolist() and max(steps) <= 5001
