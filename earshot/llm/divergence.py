"""How far each source's words are from those of the other sources of its language, by joint count histograms.

Terms that two sources hold equally often add the same amount to their distance, so a pair of sources needs no
more than how many terms have which two counts. Blocks of texts are counted where they are read; the counts are
dealt by term, a task tallies the combinations of counts among the sources of its terms, and only combinations,
with their multiplicities, are added up over tasks. Cells in which one count or both are zero are not visited:
they are what the sources' own histograms and the number of terms leave. The distance is evaluated once for each
combination.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import batched, give_back
from .common import cut, in_small_batches

#: Documents of its language that a term must be in; terms named for a source; pseudo-count; units of a share.
MIN_DOCS, TOP, PRIOR, UNITS = 30, 50, 5, 1_000_000_000
#: Characters of texts read at once, terms whose counts a task holds, rows of counts tallied in a task, pairs tallied at once; they bound memory only.
BLOCK_CHARS, HELD, TALLY_ROWS, PAIRS_AT_ONCE = 2 << 20, 500_000, 100_000, 1 << 20
#: Parts in which the terms of a source are ranked before their best meet.
RANK_PARTS = 32

#: Letters A to Z become small, every other ASCII character a blank; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))

_COUNTS = "lang string, source string, term string, n long, docs long"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term and documents that hold it, by source, for as many texts as bring HELD terms to be held."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            terms = [b"", *n]  # the empty term keeps sources without any
            for a in range(0, len(terms), 16384):
                some = terms[a : a + 16384]
                same = [pa.array([v] * len(some), pa.string()) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], schema=_COUNTS_ARROW)
        seen.clear()
        give_back()

    for langs, texts, sources in batched(batches, BLOCK_CHARS):
        for lang, text, source in zip(langs, texts, sources):
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            own = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
            n.update(own)
            docs.update(set(own))
        if sum(len(n) + 1 for n, _ in seen.values()) >= HELD:
            yield from told()
    yield from told()


_JOINT = "lang string, source string, item string, a long, b long, terms long"
_JOINT_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("terms", pa.int64())])


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def _tally(table: pa.Table) -> pa.Table:
    """How many of these terms of a language each two sources (the lesser name first) hold with which two counts.

    A cell is a combination of counts above zero. What lies in such cells is taken from the cells with one zero and
    put back into that with two, as these are first filled from the sources' own histograms.
    """
    if not table.num_rows:
        return _JOINT_ARROW.empty_table()
    lang = table.column("lang")[0].as_py()
    names = sorted(set(table.column("source").to_pylist()), key=lambda s: s.encode("utf-8", "surrogatepass"))
    number = {s: i for i, s in enumerate(names)}
    source = np.array([number[s] for s in table.column("source").to_pylist()], np.int64)
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    values, count = np.unique(np.append(table.column("n").to_numpy(), 0), return_inverse=True)  # code 0 is the count 0
    order = np.lexsort((source, term))
    source, term, count = source[order], term[order], count[:-1][order].astype(np.int64)
    # A cell in one number: pair of sources, pair of codes; the codes of a part are as few as its rows.
    pairs, codes = len(names) ** 2, len(values)
    if pairs * codes**2 >= 1 << 63 and term[-1] > 0:  # too many of both: the terms in two halves
        low = pa.array(table.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) <= term[-1] // 2)
        return pa.concat_tables([_tally(table.filter(low)), _tally(table.filter(pc.invert(low)))])
    behind = np.searchsorted(term, term, side="right") - np.arange(len(term)) - 1  # row i of a term meets the rows behind it in that term
    upto = np.cumsum(behind)
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = 0
    while a < len(term):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
        left = np.repeat(np.arange(a, b), behind[a:b])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(behind[a:b]) - behind[a:b], behind[a:b])
        met, n = np.unique(((source[left] * len(names) + source[right]) * codes + count[left]) * codes + count[right], return_counts=True)
        keys, times = _summed(np.append(keys, met), np.append(times, n))
        a = b
    x = keys // codes % codes
    y = keys % codes
    one, n_one = _summed(keys - y, times)  # (a, 0)
    two, n_two = _summed(keys - x * codes, times)  # (0, b)
    none, n_none = _summed(keys // codes**2 * codes**2, times)  # (0, 0)
    keys, times = np.concatenate([keys, one, two, none]), np.concatenate([times, -n_one, -n_two, n_none])
    pair = keys // codes**2
    named = pa.array(names, pa.string())
    cells = [named.take(pa.array(pair // len(names))), named.take(pa.array(pair % len(names))), pa.array(values[keys // codes % codes]), pa.array(values[keys % codes]), pa.array(times)]
    return pa.Table.from_arrays([pa.array([lang] * len(keys), pa.string()), *cells], schema=_JOINT_ARROW)


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNITS * (count + PRIOR) / (total + PRIOR * terms)) in whole numbers: counts up to 10^20 stay exact."""
    return F.expr(f"1L + ({UNITS}BD * (cast({count} AS decimal(20, 0)) + {PRIOR}BD)) div (cast({total} AS decimal(20, 0)) + {PRIOR}BD * cast({terms} AS decimal(20, 0)))")


def _joint_histograms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, a, b, terms): how many kept terms two sources, the lesser name first, hold ``a`` and ``b`` times, zeros included."""
    parts = max(1, -(-kept.count() // TALLY_ROWS))
    dealt = kept.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part"))
    joint = dealt.groupBy("lang", "part").applyInArrow(_tally, _JOINT)
    # A source's own histogram: beside a source that holds nothing, these are the cells with one zero, and the rest has two.
    own = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    other = groups.select("lang", F.col("source").alias("item"))
    zero = F.lit(0).cast("long")
    pair = (F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"))
    lesser = F.col("source") < F.col("item")
    held = own.join(other, "lang").where("source <> item").select("lang", *pair, F.when(lesser, F.col("n")).otherwise(zero).alias("a"), F.when(lesser, zero).otherwise(F.col("n")).alias("b"), "terms")
    totals = kept.groupBy("lang", "source").agg((-F.count("*")).alias("terms"))
    gone = totals.join(other, "lang").where("source <> item").select("lang", *pair, zero.alias("a"), zero.alias("b"), "terms")
    none = groups.select("lang", "source", "terms").join(other, "lang").where("source < item").select("lang", "source", "item", zero.alias("a"), zero.alias("b"), "terms")
    every = joint.unionByName(held).unionByName(none).unionByName(gone)
    return every.groupBy("lang", "source", "item", "a", "b").agg(F.sum("terms").alias("terms"))


def source_divergence(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and by which terms from the language.

    Terms are runs of letters A-Z, made small, and of characters beyond ASCII. A language keeps the terms that at
    least ``min_docs`` of its documents hold; V is their number. A source gives a kept term with n occurrences
    the share 1 + floor(10^9 * (n + 5) / (N + 5 * V)), N being its occurrences of all kept terms; so does the
    language. Part ``pair``: the item is another source of the language, the value the sum of the differences of
    both sources' shares over all kept terms, every rank. Part ``term``: the item is a kept term that the source has
    and gives a greater share than the language does, the value the difference, the ``top`` first ranks. Ranks
    begin at 1, the greatest value first, ties by the item's UTF-8 bytes. All sums are of whole numbers.

    Null texts, languages and sources are empty ones; a source without terms has all the same its pairs, at 0 if the
    language keeps no term; repeated rows are documents each; an empty table gives no row. Other columns are not
    read. A source of any size is counted block by block, so no task holds a source, a term's documents or a
    language's terms. The result, as asked for, has a row for each two sources of a language.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (text_col, "text"), (source_col, "source"))]
    counted = in_small_batches(docs).select(*text).mapInArrow(_count, _COUNTS)
    counts = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))

    known = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    known = cut(known.select("lang", "term", "all_n"))
    kept = cut(counts.where("term <> ''").select("lang", "source", "term", "n").join(known, ["lang", "term"]))
    langs = known.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = cut(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "lang_total", "total"))))

    own = groups.select("lang", "source", "total", F.col("terms").alias("v"))
    beside = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("other"))
    cells = _joint_histograms(kept, groups).where("terms <> 0").join(own, ["lang", "source"]).join(beside, ["lang", "item"])
    apart = F.abs(_share("a", "total", "v") - _share("b", "other", "v")) * F.col("terms")
    sums = cells.select("lang", "source", "item", apart.alias("value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = own.join(beside, "lang").where("source < item").select("lang", "source", "item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    pairs = pairs.select("lang", F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))), "value")

    order = (F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    more = _share("n", "total", "terms") - _share("all_n", "lang_total", "terms")
    terms = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")
    # The best of each part of a source's terms, then the best of these.
    part = Window.partitionBy("lang", "source", "part").orderBy(*order)
    terms = terms.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    terms = terms.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    found = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return found.select("lang", "source", "part", "item", "value", "rank")
