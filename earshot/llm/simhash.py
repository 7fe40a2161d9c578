"""SimHash near-duplicate classes through a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments, a point of {0,1,2}^32.
The Manhattan distance of two such points never exceeds the Hamming distance of the fingerprints, so a
range join of the points finds every pair of fingerprints that is near, and the exact distance is then
checked on the fingerprints themselves.

The range join works on grids. The segments are dealt to three groups; where the total distance is at
most four, two of the three groups hold at most two of it together. So each pair of groups gives a grid
of 21 or 22 dimensions on which near points are at most two apart, and two points of an integer grid at
distance two or less share a cell if each is put into its own cell and those one step away. That is at
most 45 cells for a grid; a random fingerprint has about 33.

Links are not expanded inside a cell. The smallest fingerprint of a cell is its pivot and takes a link
from every member within the threshold; classes are formed from these; only cells that still hold
members of different classes are compared further, across classes. The result is the same as with all
pairs, as a link within a class adds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .blocks import give_back
from .common import cut, free_name, in_small_batches
from .components import connected_components

SEED = 42
BITS = 64
SEGMENT_BITS = 2
SEGMENTS = BITS // SEGMENT_BITS
MAX_DISTANCE = 4
#: Segments of the three groups, dealt in turn.
GROUPS = [np.arange(g, SEGMENTS, 3) for g in range(3)]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles of ``text``, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype="<u8")


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 if there is no word."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        rows = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])
        give_back()

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def grid_cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the three grids that the fingerprints (uint64) are put into: (cell, row index)."""
    pairs = (fps[:, None] >> (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(2))) & np.uint64(3)
    counts = ((pairs & np.uint64(1)) + (pairs >> np.uint64(1))).astype(np.int64)
    cells, rows = [], []
    every = np.arange(len(fps))
    for left_out in range(3):
        dims = np.concatenate([GROUPS[g] for g in range(3) if g != left_out])
        steps = 3 ** np.arange(len(dims), dtype=np.int64)
        own = (counts[:, dims] * steps).sum(1) * 3 + left_out
        cells.append(own)
        rows.append(every)
        for d, step in zip(dims, steps * 3):
            for sign, allowed in ((1, counts[:, d] < 2), (-1, counts[:, d] > 0)):
                cells.append(own[allowed] + sign * step)
                rows.append(every[allowed])
    return np.concatenate(cells), np.concatenate(rows)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        every = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(every), 4096):
            fps = every[at : at + 4096]
            cell, row = grid_cells(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fps[row])], ["cell", "fp"])


def near_links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, root): class of each distinct fingerprint that is linked to another one at all."""
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"the grids hold for distances up to {MAX_DISTANCE}")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= max_distance
    cell = Window.partitionBy("cell")
    shared = (
        distinct.select("fp")
        .mapInArrow(_cells, "cell long, fp long")
        .withColumn("pivot", F.min("fp").over(cell))
        .withColumn("last", F.max("fp").over(cell))
        .where("pivot < last")
        .select("cell", "fp", "pivot")
    )
    shared = cut(shared)
    stars = shared.where((F.col("fp") != F.col("pivot")) & near).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    first = cut(connected_components(stars))
    # Cells whose members are of one class already need no further comparison.
    labelled = (
        shared.select("cell", "fp")
        .join(first.select(F.col("node").alias("fp"), "root"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
    )
    open_cells = labelled.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
    left = cut(labelled.join(open_cells, "cell", "left_semi"))
    other = left.select("cell", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    across = cut(left.join(
        other,
        (left.cell == other.cell)
        & (left.root < other.root2)
        & (F.bit_count(left.fp.bitwiseXOR(other.fp2)) <= max_distance),
    ).select(F.col("root").alias("a"), F.col("root2").alias("b")).distinct())
    second = connected_components(across)
    merged = (
        first.unionByName(
            # fingerprints that first joined a class across classes stand for themselves
            across.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
        )
        .groupBy("node")
        .agg(F.min("root").alias("root"))
    )
    return (
        merged.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        .select(F.col("node").alias("fp"), F.coalesce("top", "root").alias("root"))
    )


def classes(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, first_id, root, component_id) for each distinct fingerprint of ``fps`` (doc_id, fp)."""
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = near_links(distinct, max_distance)
    rooted = distinct.join(linked, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    tops = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(tops, "root").select("fp", "first_id", "root", "component_id")


def near_duplicate_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    ``component_id`` is the smallest doc_id that is reachable over links of at most ``max_distance``
    differing bits. Texts without a word (null, empty, blank) have fingerprint 0 and are linked like any
    other. Rows with a null id get their class too; a class of null ids alone has a null component.
    Repeated rows give repeated results; columns other than the two named are not read.
    """
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    # One row per distinct fingerprint: small beside the documents, and a hot fingerprint is one row of it.
    return fps.join(classes(fps, max_distance).select("fp", "component_id"), "fp")


# ---- wide fingerprints, for similarities that 64 bits are too few to tell
#
# At a Jaccard similarity of 0.8 two 64-bit fingerprints differ in about ten bits, give or take three, and
# no grid over so many differences selects anything. 1024 bits put the share of differing bits at 0.15 give
# or take 0.01, half of them between strangers. Segments are single bits here, and the grids hold sampled
# coordinates of the embedding: near fingerprints meet in one of them with high probability, not always.

WIDE_WORDS = 16
#: Share of pairs right at the threshold that may meet in no grid, by the average share of differing bits.
MISSED = 0.005
#: In cells of up to so many members only those are looked at that are near another one; of larger ones all are.
SMALL_CELL = 8
#: Members of a cell whose classes are compared in one place; larger cells are parted, and every two parts meet.
WHOLE_CELL = 4096
#: Standard deviations beyond the average distance at the threshold up to which pairs are candidates: by the
#: first 64 bits, and by all.
SKETCH_DEVIATIONS, DEVIATIONS = 3.5, 2.5


def grid_shape(distinct: int, similarity: float) -> tuple[int, int]:
    """(bits, grids) for a number of fingerprints: a grid has at least as many cells, so that strangers stay about one a cell at every size."""
    bits = max(12, math.ceil(math.log2(max(distinct, 2))))
    meet = (1 - differing_share(similarity)) ** bits
    return bits, 1 if meet > 1 - MISSED else math.ceil(math.log(MISSED) / math.log1p(-meet))


def most_apart(similarity: float, bits: int, deviations: float) -> int:
    """Differing bits of ``bits`` that a pair right at the similarity passes only beyond so many standard deviations."""
    share = differing_share(similarity)
    return math.ceil(share * bits + deviations * math.sqrt(share * (1 - share) * bits))


def differing_share(similarity: float) -> float:
    """Share of bits that two fingerprints of the Jaccard similarity differ in on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """1024-bit SimHash of shingle hashes as 16 unsigned words, each hash stretched by a counter; zeros if there is none."""
    ones = np.zeros(64 * WIDE_WORDS, dtype=np.int64)
    counter = np.arange(WIDE_WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 1024):
        x = hashes[at : at + 1024, None] + counter
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def _wide(shingle: int):
    """The fingerprint over a text's distinct shingles and the halves of a 128-bit hash of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), shingle)) for x in b.column(1)]
            found = np.array([wide_fingerprint(x) for x in sets], dtype=np.uint64).reshape(-1, WIDE_WORDS).view(np.int64)
            words = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, WIDE_WORDS, dtype=np.int32)), pa.array(found.ravel()))
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in sets), "<i8").reshape(-1, 2)
            columns = [b.column(0), b.column(2), words, *(pa.array(np.ascontiguousarray(keys[:, i])) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp", "key", "more"])
        give_back()

    return run


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), shingle)).view(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])
        give_back()

    return run


def _samples(bits: int, grids: int) -> np.ndarray:
    return np.stack([np.random.default_rng(SEED + g).choice(64 * WIDE_WORDS, bits, replace=False) for g in range(grids)])


def _wide_cells(bits: int, grids: int):
    sample = _samples(bits, grids)
    power = np.int64(1) << np.arange(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            words = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDE_WORDS)
            for at in range(0, len(keys), 256):
                part = words[at : at + 256]
                ones = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
                cells = np.stack([ones[:, s] @ power for s in sample], 1) + (np.arange(grids, dtype=np.int64) << bits)
                columns = [cells.ravel(), np.repeat(keys[at : at + 256], grids), np.repeat(part[:, 0], grids)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "key", "sketch"])
        give_back()

    return run


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows that come sorted by their first column, the cell, in arrays that end with a cell; a list column becomes WIDE_WORDS columns."""
    held: list[np.ndarray] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False)[:, None] for c in b.columns]
        held.append(np.concatenate(columns, 1))
        size += b.num_rows
        if size >= 1 << 16 and held[-1][-1, 0] != held[0][0, 0]:
            rows = np.concatenate(held)
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            yield rows[:last]
            held, size = [rows[last:]], len(rows) - last
    if held:
        yield np.concatenate(held)


def _ends(*columns: np.ndarray) -> np.ndarray:
    """For each row the row after the last one of its run of equal values."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], 0)
    starts = np.flatnonzero(new)
    return np.append(starts[1:], len(new))[np.cumsum(new) - 1]


def _near_pairs(at: np.ndarray, end: np.ndarray, key: np.ndarray, sketch: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with the rows ``at`` up to ``end`` of it, where the sketches are near."""
    at, live = at.copy(), np.flatnonzero(at < end)
    while len(live):
        other = at[live]
        near = np.bitwise_count(sketch[live] ^ sketch[other]) <= most
        if near.any():
            yield key[live[near]], key[other[near]]
        at[live] += 1
        live = live[at[live] < end[live]]


def _middles(cell: np.ndarray, key: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """For each row the row of its cell that is nearest to the majority of the cell's sketches, the smallest key of equals."""
    number = np.cumsum(np.append(0, cell[1:] != cell[:-1]))
    ones = np.zeros((number[-1] + 1, 64), np.int64)
    for a in range(0, len(cell), 1 << 16):
        n = number[a : a + (1 << 16)]
        bits = np.unpackbits(np.ascontiguousarray(sketch[a : a + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        ones[n[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    common = np.packbits(2 * ones > np.bincount(number)[:, None], axis=1, bitorder="little").view("<u8").ravel()
    order = np.lexsort((key, np.bitwise_count(sketch ^ common[number]), number))
    return order[np.flatnonzero(np.append(True, number[1:] != number[:-1]))][number]


def _cell_members(most: int, most_of_middle: int):
    """(key, middle, cell): members of a small cell that are near another one, all members of a larger one, each with
    the middle one of them where that is as near as pairs at the threshold are on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(batches):
            cell, sketch = rows[:, 0], np.ascontiguousarray(rows[:, 2]).view(np.uint64)
            end = _ends(cell)
            number = np.cumsum(np.append(0, cell[1:] != cell[:-1]))
            member = np.bincount(number)[number] > SMALL_CELL
            for x, y in _near_pairs(np.where(member, end, np.arange(1, len(cell) + 1)), end, np.arange(len(cell)), sketch, most):
                member[x] = member[y] = True
            if member.any():
                c, k, s = cell[member], rows[member, 1], sketch[member]
                middle = _middles(c, k, s)
                far = (np.bitwise_count(s ^ s[middle]) > most_of_middle) | (middle == np.arange(len(k)))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(k[middle], mask=far), pa.array(c)], ["key", "middle", "cell"])
        give_back()

    return run


def _pairs_across(bits: int, grids: int, similarity: float):
    """(a, b): pairs of near fingerprints whose classes differ, each in the first grid that they meet in; rows are (box, root, key, cell, part, whole, fp), sorted."""
    most, most_wide = most_apart(similarity, 64, SKETCH_DEVIATIONS), most_apart(similarity, 64 * WIDE_WORDS, DEVIATIONS)
    chosen = np.zeros((grids, 64 * WIDE_WORDS), np.uint8)
    np.put_along_axis(chosen, _samples(bits, grids), 1, 1)
    masks = np.packbits(chosen, axis=1, bitorder="little").view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(batches):
            box, root, key, cell, part, whole = rows[:, :6].T
            fp = np.ascontiguousarray(rows[:, 6:]).view(np.uint64)
            for x, y in _near_pairs(_ends(box, root), _ends(box), np.arange(len(key)), fp[:, 0], most):
                step = max(1, (1 << 20) // masks.size)
                for at in range(0, len(x), step):
                    a, b = x[at : at + step], y[at : at + step]
                    apart = fp[a] ^ fp[b]
                    met = (np.bitwise_count(apart).sum(1) <= most_wide) & ((whole[a] > 0) | (part[a] != part[b]))
                    a, b, apart = a[met], b[met], apart[met]
                    together = ~(apart[:, None, :] & masks).any(2)
                    here = together.any(1) & (together.argmax(1) == cell[a] >> bits)
                    if here.any():
                        a, b = key[a[here]], key[b[here]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
        give_back()

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as stars to the smallest node of each class they form: no more links than nodes, and the same classes."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above.setdefault(up, up)
            x = above[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = sorted((top(a), top(b)))
            above[y] = x
    stars = [(x, top(x)) for x in list(above) if top(x) != x]
    for at in range(0, len(stars), 1 << 16):
        a, b = zip(*stars[at : at + (1 << 16)])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _components(links: DataFrame) -> DataFrame:
    found = connected_components(links.select("a", "b").mapInArrow(_forest, "a long, b long"))
    return found.select(F.col("node").alias("key"), "root")


def near_fingerprints(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose 1024-bit fingerprints leave it open that they are similar."""
    fps = distinct.select("key", "fp")
    both = pairs.join(fps.select(F.col("key").alias("a"), F.col("fp").alias("x")), "a").join(fps.select(F.col("key").alias("b"), F.col("fp").alias("y")), "b")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    return both.where(apart <= most_apart(similarity, 64 * WIDE_WORDS, DEVIATIONS)).select("a", "b")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose ``sets`` (key, shingles) have the Jaccard similarity or more."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common / (F.size("x") + F.size("y") - common) >= similarity).select("a", "b")


def similar_links(distinct: DataFrame, similarity: float, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, root): classes of keys (key, fp) that are linked at all, closed over all similar pairs that meet in a cell.

    Fingerprints only name candidates; links are decided on the shingle sets (key, shingles) that ``sets_of``
    gives for keys. Members of a cell are first tried with its middle member only, which a star of copies has at
    its centre. Links contract to classes; then all pairs of a cell whose classes still differ are compared, each in
    the first grid that it meets in, so what is left out are only pairs within a class, which add nothing.
    """
    bits, grids = grid_shape(distinct.count(), similarity)
    cells = distinct.select("key", "fp").mapInArrow(_wide_cells(bits, grids), "cell long, key long, sketch long")
    members_of = _cell_members(most_apart(similarity, 64, SKETCH_DEVIATIONS), most_apart(similarity, 64, 0.0))
    met = cut(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(members_of, "key long, middle long, cell long"))

    def checked(pairs: DataFrame) -> DataFrame:
        keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        return similar_pairs(pairs, cut(sets_of(keys)), similarity)

    tried = met.where("middle is not null").select(F.least("key", "middle").alias("a"), F.greatest("key", "middle").alias("b")).distinct()
    first = cut(_components(checked(cut(near_fingerprints(tried, distinct, similarity)))))
    # Classes and fingerprints are joined once a key, which has a cell for each grid at most, and not once a cell.
    classed = met.groupBy("key").agg(F.collect_list("cell").alias("cells")).join(first, "key", "left")
    members = classed.select("key", F.coalesce("root", "key").alias("root"), F.explode("cells").alias("cell"))
    cell = Window.partitionBy("cell")
    parts = F.ceil(F.count("*").over(cell) / WHOLE_CELL)
    still_open = members.withColumns({"lo": F.min("root").over(cell), "hi": F.max("root").over(cell), "parts": parts}).where("lo < hi")
    at = still_open.groupBy("key", "root").agg(F.collect_list(F.struct("cell", "parts")).alias("at")).join(distinct.select("key", "fp"), "key")
    dealt = at.select("key", "root", "fp", F.inline("at")).withColumn("part", F.pmod(F.xxhash64("key"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    box = F.when(F.col("parts") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")))
    boxes = dealt.select(box.alias("box"), "root", "key", "cell", "part", (F.col("part") == F.col("other")).cast("long").alias("whole"), "fp")
    compared = boxes.repartition("box").sortWithinPartitions("box", "root")
    across = cut(compared.mapInArrow(_pairs_across(bits, grids, similarity), "a long, b long"))
    if across.isEmpty():
        return first
    # A class found so far hangs together by links to its root.
    links = checked(across)
    return _components(links.unionByName(first.select(F.col("key").alias("a"), F.col("root").alias("b"))))


def _keyed(sets: DataFrame) -> DataFrame:
    """``sets`` (key, more, ...) with one key for each pair of ``key`` and ``more``: where sets that differ share a key by chance, all but the first get another."""
    twice = cut(sets.groupBy("key").agg(F.count("*").alias("n"), F.min("more").alias("least")).where("n > 1"))
    if twice.isEmpty():
        return sets.drop("more")
    renamed = F.when(F.col("least").isNull() | (F.col("more") == F.col("least")), F.col("key")).otherwise(F.xxhash64("key", "more"))
    return sets.join(twice.select("key", "least"), "key", "left").withColumn("key", renamed).drop("more", "least")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that come first, by id, of their class of similar texts; one row for each class.

    Texts are similar if the sets of their ``shingle``-word shingles have a Jaccard similarity of ``similarity``
    or more; 1024-bit SimHashes of the sets find the candidates, and about one pair in a hundred right at the
    threshold is missed. Classes are closed over links. Equal texts are always linked. Null ids come after all
    others. Texts without a word are one class. All columns are kept as they are; of rows with equal ids and
    texts the one stays whose columns come first in order, from left to right (maps are not compared).
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kind = docs.schema[id_col].dataType
    longs = [T.StructField(c, T.LongType()) for c in ("text_hash", "key", "more")]
    schema = T.StructType([T.StructField("doc_id", kind), longs[0], T.StructField("fp", T.ArrayType(T.LongType())), *longs[1:]])
    rows = in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash.alias("text_hash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    fps = rows.mapInArrow(_wide(shingle), schema)
    distinct = cut(_keyed(cut(fps.groupBy("key", "more").agg(F.any_value("fp").alias("fp"), first))))

    def sets_of(keys: DataFrame) -> DataFrame:
        texts = distinct.join(keys, "key", "left_semi").select("key", F.col("first.text_hash").alias("own_hash"), F.col("first.doc_id").alias("own_id"))
        found = rows.join(texts, (F.col("text_hash") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).dropDuplicates(["key"])
        return found.select("key", "text").mapInArrow(_shingle_sets(shingle), "key long, shingles array<long>")

    linked = similar_links(distinct, similarity, sets_of)
    hash_name, kept_hash, kept_id = (free_name(n, docs) for n in ("_text_hash", "_kept_hash", "_kept_id"))
    kept = (
        distinct.select("key", "first").join(linked, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
        .select(F.col("first.doc_id").alias(kept_id), F.col("first.text_hash").alias(kept_hash))
    )
    marked = docs.withColumn(hash_name, text_hash)
    found = marked.join(kept, (F.col(hash_name) == F.col(kept_hash)) & F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    whole, compared = F.struct(*docs.columns), [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    least = F.min(whole) if len(compared) == len(docs.columns) else F.min_by(whole, F.struct(*compared))
    return found.groupBy(hash_name, id_col).agg(least.alias("row")).select("row.*")
