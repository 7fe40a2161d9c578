"""Reconciling a catalogue with itself until nothing changes: matches merge, winners are judged again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..library import Library
from . import ingest, matching, merging
from .numbering import cut


def _mapped(pairs: DataFrame, losers: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with the ids in ``columns`` replaced by those that they were merged into."""
    for c in columns:
        pairs = pairs.join(losers.select(F.col("loser_id").alias(c), F.col("winner_id").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return pairs


def reconcile(lib: Library, entity_type: str, touched: DataFrame) -> tuple[Library, DataFrame, DataFrame]:
    """(the library with touched entities (id) merged into what they match, suggestions, merges (loser_id, winner_id)).

    A round scores the touched entities against all others, draws the pairs together to classes, merges these, and
    touches the winners, which have more artists, tracks and sources than before; there are as many rounds as change
    something, and each makes the catalogue smaller. Rounds change only the tables that a score reads. Listens and
    what else refers to the entities follow once, at the end, by the merges of all rounds in one. Suggestions name
    the entities that are left, each pair once with its highest score.
    """
    table = f"{entity_type}s"
    now, every = lib, None
    suggested = None
    while True:
        known = ingest.known_entities(now, entity_type)
        found = cut(matching.reconcile(known, touched, entity_type, now.sources))
        offered = found.where("action = 'suggest'").select("entity_type", F.col("winner_id").alias("a"), F.col("loser_id").alias("b"), "score")
        suggested = offered if suggested is None else suggested.unionByName(offered)
        own = getattr(now, table)
        held = own.where("pinned").select("id") if "pinned" in own.columns else None
        losers = cut(merging.contract(found.where("action = 'merge'").select(F.col("winner_id").alias("a"), F.col("loser_id").alias("b")), held))
        if losers.isEmpty():
            break
        every = losers if every is None else cut(_mapped(every, losers, "winner_id").unionByName(losers))
        now = merging.merge(now, entity_type, losers, merging.SCORED)
        now = now.changed(**{name: cut(getattr(now, name)) for name in merging.SCORED if getattr(now, name) is not None})
        touched = losers.select(F.col("winner_id").alias("id")).distinct()
    if every is None:
        every = losers
    out = merging.merge(now, entity_type, every, tuple(t for t in merging.TABLES if t not in merging.SCORED))
    return out, merging.suggestions(_mapped(suggested, every, "a", "b")), every
