"""Documents of the stored index: own names and aliases, and no more are written anew than a change touches."""

from pyspark.sql import functions as F

from earshot import fixtures
from earshot.sources import index
from earshot.sources.export import search_documents


def test_documents_of_changed_entities_alone(spark, sf_dir, tmp_path, monkeypatch):
    lib = fixtures.library(spark, sf_dir)
    texts = lambda df: {(r.kind, r.id, r["name"], tuple(r.texts)) for r in df.collect()}
    every = texts(index.documents(lib))
    want = search_documents(lib).select("kind", "id", "name", F.concat(F.array("name"), "aliases").alias("texts"))
    assert {x for x in every if x[0] != "user"} == texts(want) and sum(x[0] == "user" for x in every) == lib.users.count()
    renamed = lib.changed(artists=lib.artists.withColumn("name", F.when(F.col("id") == 1, "Other").otherwise(F.col("name"))))
    changed = spark.createDataFrame([("artist", 1), ("user", 2)], "kind string, id long")
    now = texts(index.documents(renamed, changed))
    assert {x[:2] for x in now} == {("artist", 1), ("user", 2)} and texts(index.documents(renamed)) == {x for x in every if x[:2] != ("artist", 1)} | now


def test_postings_are_worked_out_once(spark, tmp_path, monkeypatch):
    """What is dealt by range is a table: its plan has no pieces to cut up and no runs to add up."""
    plans = []
    of = index.SearchIndex._write
    monkeypatch.setattr(index.SearchIndex, "_write", lambda self, folder, tables: (plans.append(tables["postings"]._jdf.queryExecution().optimizedPlan().toString()), of(self, folder, tables)))
    store = index.SearchIndex(spark, str(tmp_path), fan=2)
    for i in range(2):
        store.change(i, spark.createDataFrame([("song", i, f"name {i}", [f"name {i}"])], "kind string, id long, name string, texts array<string>"))
    assert len(plans) == 3 and not any(x in p for p in plans for x in ("Generate", "Aggregate", "Join"))
    assert {(r.kind, r.id) for r in store.search("name").collect()} == {("song", 0), ("song", 1)}
