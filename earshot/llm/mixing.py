"""Mixing sources to target weights by Poisson replication, in DataFrame functions.

Each source has a mean repetition rate, its target share of the corpus over its actual share. Each
document draws its number of copies by inverting the Poisson distribution at a point in [0, 1) that a
hash of seed and id fixes, so that a rerun or a lost executor changes nothing; copies then go to places
given by another hash. The place itself names the partition, so nothing is sampled and nothing is drawn twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_length, cut, free_name

#: Rates above this are split into equal parts with draws of their own (a sum of Poissons is Poisson).
PART = 200.0
#: Rates of all sources are broadcast up to so many bytes of names and numbers; beyond that they are joined.
BROADCAST_BYTES = 8 << 20


def uniform(seed: str, *parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of an md5; nulls count as the word null."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(rate: Column, u: Column) -> Column:
    """Smallest k with CDF(k) > u for a Poisson distribution of mean ``rate`` (at most PART)."""
    most = (rate + 12 * F.sqrt(rate) + 40).cast("int")  # beyond this the CDF is 1 in doubles
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))
    return F.aggregate(
        F.sequence(F.lit(1), most),
        start,
        lambda s, i: F.when(s["cdf"] > u, s).otherwise(
            F.struct((s["p"] * rate / i).alias("p"), (s["cdf"] + s["p"] * rate / i).alias("cdf"), i.alias("k"))
        ),
        lambda s: s["k"],
    )


def rates(docs: DataFrame, *, source_col: str, text_col: str, temperature: float, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """(source, rate) with null as a source of its own.

    A source's target share is its entry of ``weights`` (0 if missing), or else its share of the bytes
    to the power ``temperature``, scaled to one. Sources without a byte have rate ``epochs``. Where no
    source that has a byte is wanted, those that have one get rate 0. Weights and ``epochs`` must be
    finite and not negative, others raise.
    """
    if any(not 0 <= x < math.inf for x in (epochs, *(weights or {}).values())):
        raise ValueError("weights and epochs must be finite and not negative")
    sizes = docs.groupBy(F.col(source_col).alias("_source")).agg(F.sum(byte_length(text_col)).cast("double").alias("_bytes"))
    if weights is None:
        wanted = F.when(F.col("_bytes") > 0, F.pow("_bytes", F.lit(temperature))).otherwise(0.0)
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
        wanted = F.lit(0.0) if given is None else F.when(F.col("_bytes") > 0, F.coalesce(F.element_at(given, F.col("_source")), F.lit(0.0))).otherwise(0.0)
    sizes = sizes.withColumn("_wanted", wanted)
    total = sizes.agg(F.sum("_bytes").alias("_all"), F.sum("_wanted").alias("_all_wanted"))
    share = F.coalesce(F.try_divide("_wanted", "_all_wanted"), F.lit(0.0))
    rate = F.when(F.col("_bytes") > 0, F.lit(epochs) * share * F.col("_all") / F.col("_bytes")).otherwise(F.lit(epochs))
    return sizes.crossJoin(F.broadcast(total)).select("_source", rate.alias("rate"))


def replicate(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    temperature: float = 0.7,
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
    seed: str = "mix-1",
    columns: list[str] | None = None,
) -> DataFrame:
    """The columns of ``docs`` (or ``columns``) with rate, copies, copy (from 0) and place, a row per copy.

    ``place`` is a uniform double fixed by seed, id and copy; sorting by it shuffles the corpus globally.
    Rows with the same id get the same number of copies; null ids draw like the word null; null sources
    form a source. Texts may be null or empty: they count 0 bytes but are still drawn. An empty table
    gives an empty table. Existing columns named like the new ones are replaced.
    """
    kept = [c for c in (columns or docs.columns) if c not in ("rate", "copies", "copy", "place")]
    by_source = cut(rates(docs, source_col=source_col, text_col=text_col, temperature=temperature, weights=weights, epochs=epochs))
    if (by_source.agg(F.sum(byte_length("_source") + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        by_source = F.broadcast(by_source)
    rows = docs.select(*{*kept, source_col, id_col})
    key = free_name("_source", rows)
    # Documents stay where they were read; with too many sources they are joined by source, and Spark splits a hot one.
    rated = rows.drop("rate").join(by_source.withColumnRenamed("_source", key), rows[source_col].eqNullSafe(F.col(key)))
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    drawn = F.aggregate(
        F.sequence(F.lit(0), parts - 1),
        F.lit(0),
        lambda n, i: n + poisson(F.col("rate") / parts, uniform(seed, F.col(id_col), i)),
    )
    counted = rated.withColumn("copies", drawn).where("copies > 0")
    copied = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return copied.withColumn("place", uniform(seed + "-place", F.col(id_col), F.col("copy"))).select(*kept, "rate", "copies", "copy", "place")


def shuffled(copies: DataFrame, partitions: int) -> DataFrame:
    """``copies`` in the order of ``place`` over partitions of about equal size, by ranges of ``place``."""
    part = F.least(F.floor(F.col("place") * partitions), F.lit(partitions - 1)).cast("int")
    return copies.repartitionById(partitions, part).sortWithinPartitions("place")
