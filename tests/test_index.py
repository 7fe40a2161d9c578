"""The stored search index: pieces, changes, deletions, levels, and what a search reads."""

from earshot.sources import index

DOC = "kind string, id long, name string, texts array<string>"


def found(store, text, limit=25):
    return {(r.kind, r.id): r.score for r in store.search(text, limit).collect()}


def test_changes_and_deletions(spark, tmp_path):
    store = index.SearchIndex(spark, str(tmp_path), fan=2)
    put = lambda rows: spark.createDataFrame(rows, DOC)
    store.change(0, put([("song", 1, "Red Widget", ["Red Widget", "crimson thing"]), ("song", 2, "Blue Bolt", ["Blue Bolt"]), ("artist", 1, "Redd", ["Redd", None])]))
    assert found(store, "RED") == {("song", 1): 1.0, ("artist", 1): 1.0}
    assert found(store, "red crimson") == {("song", 1): 0.5, ("artist", 1): 0.5}  # the best single name counts
    assert found(store, "b") == {("song", 2): 1.0} and found(store, "") == {} and found(store, "zzzz") == {}
    store.change(1, put([("song", 2, "Green Bolt", ["Green Bolt"])]), spark.createDataFrame([("artist", 1)], "kind string, id long"))
    store.change(1, put([("song", 9, "never", ["never"])]))  # a replay
    assert found(store, "blue") == {} and found(store, "green bolt") == {("song", 2): 1.0} and found(store, "red") == {("song", 1): 1.0}
    assert [r["level"] for r in store.manifest()[1]] == [1]
    store.change(2, put([("artist", 1, "Redd again", ["Redd again"])]))
    assert found(store, "red") == {("song", 1): 1.0, ("artist", 1): 1.0} and found(store, "red", 1) == found(store, "red")
    assert store.table("postings").where("piece = 'blu'").count() == 0  # the merge has dropped what the change replaced


def test_a_search_opens_the_buckets_of_its_pieces(spark, tmp_path):
    store = index.SearchIndex(spark, str(tmp_path))
    store.change(0, spark.createDataFrame([("song", i, f"name {i} {'abcdefghij'[i % 10] * 3}", [f"name {i} {'abcdefghij'[i % 10] * 3}"]) for i in range(200)], DOC))
    plan = store.asked(["ccc"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert len(found(store, "ccc", 100)) == 20


def test_long_and_odd_words(spark, tmp_path):
    store = index.SearchIndex(spark, str(tmp_path))
    store.change(0, spark.createDataFrame([("song", 1, "日本語の歌", ["日本語の歌"]), ("song", 2, "x" * 500, ["x" * 500]), ("song", 3, "", [""]), ("song", 4, None, [None])], DOC))
    assert found(store, "本語") == {("song", 1): 1.0} and found(store, "x" * 400) == {("song", 2): 1.0} and found(store, "%") == {}
