"""A stored search index: postings of pieces of names by bucket, with changes and deletions, read only where a query asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..library import Library
from ..operators.numbering import cut
from ..operators.runs import Runs

#: Longest pieces of a name; shorter words of a query are asked by themselves.
PIECE = 3


def pieces(texts: Column) -> Column:
    """All distinct pieces of one to PIECE letters of lower-case texts."""
    cut_up = lambda t: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(PIECE)), lambda n: F.when(F.char_length(t) >= n, F.transform(F.sequence(F.lit(1), F.char_length(t) - n + 1), lambda i: F.substr(t, i, n))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: cut_up(F.lower(t)))))


def documents(lib: Library, changed: DataFrame | None = None) -> DataFrame:
    """(kind, id, name, texts) of artists, albums, songs and users: the name, and the aliases of entities.

    With ``changed`` (kind, id), these alone: a document says its own name and aliases, so that no other one changes with it.
    """
    tables = (("artist", lib.artists, "name"), ("album", lib.albums, "name"), ("song", lib.songs, "name"), ("user", lib.users, "username"))
    docs = None
    for kind, table, name in tables:
        part = table.select(F.lit(kind).alias("kind"), "id", F.col(name).alias("name"))
        docs = part if docs is None else docs.unionByName(part)
    if changed is not None:
        docs = docs.join(changed.select("kind", "id").distinct(), ["kind", "id"], "left_semi")
    if lib.aliases is None:
        return docs.withColumn("texts", F.array("name"))
    alias = lib.aliases.where("entity_type <> 'user'").groupBy(F.col("entity_type").alias("kind"), F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    empty = F.array().cast("array<string>")
    return docs.join(alias, ["kind", "id"], "left").select("kind", "id", "name", F.concat(F.array("name"), F.coalesce("aliases", empty)).alias("texts"))


class SearchIndex(Runs):
    """Documents and postings in runs (see Runs), each parted into ``buckets`` by the hash of its key.

    A changed document is written anew with the postings of its present pieces; a posting holds only for the version
    of the document that it was written with, so what the change took away needs no deletion. A search opens the
    buckets of its own pieces and no others, and asks the documents for what it found.
    """

    BUCKETS = 64
    KEYS = {"documents": ["kind", "id"], "postings": ["piece", "kind", "id"]}
    SCHEMAS = {
        "documents": "kind string, id long, name string, texts array<string>, asof long, gone boolean, bucket int",
        "postings": "piece string, kind string, id long, asof long, bucket int",
    }
    PARTED = {"documents": "bucket", "postings": "bucket"}

    def _bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.BUCKETS)).cast("int")

    def added_up(self, name: str, rows: DataFrame) -> DataFrame:
        if name == "postings":
            return rows.groupBy(*self.KEYS[name]).agg(F.max("asof").alias("asof"), F.first("bucket").alias("bucket"))
        return rows.groupBy("kind", "id").agg(F.max_by(F.struct("name", "texts", "asof", "gone", "bucket"), "asof").alias("r")).select("kind", "id", "r.*")

    def merged(self, runs: list) -> dict[str, DataFrame]:
        """As Runs.merged, without postings of versions that the same runs replace."""
        tables = super().merged(runs)
        latest = tables["documents"].select("kind", "id", F.col("asof").alias("_latest"))
        held = tables["postings"].join(latest, ["kind", "id"], "left").where("_latest IS NULL OR _latest = asof")
        return tables | {"postings": cut(held.drop("_latest"))}  # dealt by range, for which a plan is worked out twice

    def change(self, batch_id: int, put: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Write documents (kind, id, name, texts), new or changed, and take out others (kind, id). A batch that the index has does nothing."""
        if batch_id <= self.last_batch():
            return
        docs = self.spark.createDataFrame([], self.SCHEMAS["documents"])
        stamp = F.lit(batch_id).cast("long").alias("asof")
        if put is not None:
            docs = docs.unionByName(put.select("kind", "id", "name", F.filter("texts", lambda t: t.isNotNull()).alias("texts"), stamp, F.lit(False).alias("gone"), self._bucket("kind", "id").alias("bucket")))
        if gone is not None:
            docs = docs.unionByName(gone.select("kind", "id", F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("texts"), stamp, F.lit(True).alias("gone"), self._bucket("kind", "id").alias("bucket")))
        docs = cut(docs)
        posted = docs.where("NOT gone").select(F.explode(pieces(F.col("texts"))).alias("piece"), "kind", "id", "asof")
        self.add(batch_id, {"documents": docs, "postings": cut(posted.withColumn("bucket", self._bucket("piece")))})

    def asked(self, words: list[str], runs: list | None = None) -> DataFrame:
        """(kind, id, n, word): documents that hold all pieces of a word, so perhaps the word; reads the buckets of the pieces alone."""
        rows = [(i, w, w[a : a + PIECE]) for i, w in enumerate(words) for a in range(max(1, len(w) - PIECE + 1))]
        probes = self.spark.createDataFrame(sorted(set(rows)), "n int, word string, piece string").withColumn("bucket", self._bucket("piece"))
        found = probes.collect()  # the pieces of the query
        posted = self.table("postings", sorted({r.bucket for r in found}), runs=runs).where(F.col("piece").isin(sorted({r.piece for r in found})))
        needed = probes.groupBy("n").agg(F.count("*").alias("needed"))
        held = posted.join(F.broadcast(probes.select("n", "word", "piece")), "piece").groupBy("kind", "id", "asof", "n", "word").agg(F.count("*").alias("held"))
        return held.join(F.broadcast(needed), "n").where("held = needed").select("kind", "id", "asof", "n", "word")

    def search(self, text: str, limit: int = 25) -> DataFrame:
        """(kind, id, name, score): the best of each kind by the share of the text's words that the name or an alias holds."""
        words = list(dict.fromkeys(text.lower().split()))
        if not words:
            return self.spark.createDataFrame([], "kind string, id long, name string, score double")
        runs = self.manifest()[1]
        perhaps = cut(self.asked(words, runs).select("kind", "id", "asof").distinct().withColumn("bucket", self._bucket("kind", "id")))
        docs = self.table("documents", perhaps.select("bucket").distinct(), perhaps.select("kind", "id"), runs).where("NOT gone").join(perhaps, ["kind", "id", "asof", "bucket"], "left_semi")
        count = lambda t: sum((F.lower(t).contains(w).cast("int") for w in words), F.lit(0)) / F.lit(float(len(words)))
        scored = docs.select("kind", "id", "name", F.array_max(F.transform("texts", count)).alias("score")).where("score > 0")
        best = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "name", "id"))
        return scored.withColumn("at", best).where(F.col("at") <= limit).drop("at")
