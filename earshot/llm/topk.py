"""Exact top-k by inner product: columnar branch-and-bound over blocks of dimensions.

Vectors are dealt to blocks that hold one array per dimension. A block of queries meets a block of
candidates; inner products grow by a few dimensions at a time, and after each step a candidate stays
only if what it has plus the most that the remaining dimensions can add (the product of the remaining
norms) reaches the query's k-th best so far. All queries meet the first block of candidates first; the k-th
best there is the bound that they begin with in all others. The best k of each meeting are merged by a window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

DIMS_PER_STEP = 16


def quantised(vectors: DataFrame, *, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>) with floor(scale * x) per component.

    Rows take no part if the id or the vector is null, or a component is null or not finite. Shorter
    vectors count as filled up with zeros. An empty vector scores 0 against any other.
    """
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"),
    )


def _pack(keys: tuple, rows: pa.Table) -> pa.Table:
    """One row of a block: its ids and its components, dimension after dimension."""
    ids = rows.column("vec_id").to_numpy()
    v = rows.column("v").combine_chunks()
    lengths = np.diff(v.offsets.to_numpy())
    matrix = np.zeros((int(lengths.max(initial=0)), len(ids)), dtype=np.int64)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(ids)), lengths)
    matrix[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = flat
    return pa.table({"block": [keys[0].as_py()], "ids": [ids.astype("<i8").tobytes()], "m": [matrix.astype("<i8").tobytes()]}, schema=_PACKED)


_PACKED = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("m", pa.binary())])


def blocks(vectors: DataFrame, rows_per_block: int, n: int) -> DataFrame:
    count = max(1, math.ceil(n / rows_per_block))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int"))  # so the vectors of one id are spread
    return dealt.groupBy("block").applyInArrow(_pack, "block int, ids binary, m binary")


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int, floors: dict[int, int] | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (rows of ``queries``): its id, and ids and best scores of its best k ids among the columns of ``m``.

    ``floors`` has scores that k candidates elsewhere reach; what stays below may be left out. Where ids have more
    than one column, as many more columns stand for at least k ids, so bounds are taken that much further down.
    """
    dims = max(queries.shape[1], m.shape[0])
    queries = np.pad(queries, ((0, 0), (0, dims - queries.shape[1])))
    m = np.pad(m, ((0, dims - m.shape[0]), (0, 0)))
    most = dims * float(np.abs(queries).max(initial=0)) * float(np.abs(m).max(initial=0))
    if most >= 2.0**62:
        raise ValueError("scores would not fit a long")
    if most < 2.0**52:  # sums stay exact in doubles, which multiply faster
        queries, m = queries.astype(np.float64), m.astype(np.float64)
    steps = [slice(a, min(a + DIMS_PER_STEP, dims)) for a in range(0, dims, DIMS_PER_STEP)] or [slice(0, 0)]

    def remaining(squares: np.ndarray) -> list[np.ndarray]:
        tails = np.cumsum([squares[s].sum(0) for s in steps][::-1], axis=0)[::-1]
        return [*(np.sqrt(t) * (1 + 1e-9) for t in tails[1:]), np.zeros(squares.shape[1])]

    own = remaining(m.astype(np.float64) ** 2)
    theirs = remaining(queries.T.astype(np.float64) ** 2)
    begun = queries[:, steps[0]] @ m[steps[0]]
    wide = k + len(ids) - len(np.unique(ids))
    for i, q in enumerate(queries):
        alive = np.flatnonzero(ids != query_ids[i])
        score = begun[i, alive]
        floor = float((floors or {}).get(int(query_ids[i]), -np.inf))
        for j, step in enumerate(steps):
            if j:
                score = score + q[step] @ m[step][:, alive]
            if len(alive) <= wide:
                continue
            slack = theirs[j][i] * own[j][alive]
            if j + 1 < len(steps):
                if j == 0:  # exact scores of the most promising give the first floor
                    best = alive[np.argpartition(score + slack, len(alive) - wide)[-wide:]]
                    floor = max(floor, float((q @ m[:, best]).min()))
                else:
                    floor = max(floor, float(np.partition(score - slack, len(alive) - wide)[-wide]))
                stay = score + slack >= floor - 1e-6 * (1 + abs(floor))
                alive, score = alive[stay], score[stay]
        order = np.lexsort((ids[alive], -score))[:wide]
        if wide > k:
            order = order[np.sort(np.unique(ids[alive][order], return_index=True)[1])]
        order = order[:k]
        yield query_ids[i], ids[alive][order], score[order].astype(np.int64)


def top_k(
    vectors: DataFrame,
    *,
    k: int,
    query_every: int,
    scale: int = 64,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    rows_per_block: int = 8192,
    queries_per_block: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row with id % query_every = 0.

    Ties go to the smaller id. A query with fewer than k other rows gets them all. Rows that share the
    query's id count as its own. Equal rows are one; rows of one id with different vectors all take part, as
    queries and as candidates, and two ids have the best score that any of their vectors reach. Empty tables give
    no rows. Queries and candidates meet in blocks; no block grows with the data, or with the vectors of an id.
    """
    rows = cut(quantised(vectors, id_col=id_col, vec_col=vec_col, scale=scale).distinct())
    asked = rows.where(F.col("vec_id") % query_every == 0)
    n, n_asked = rows.count(), asked.count()
    candidates = blocks(rows, rows_per_block, n)
    count = max(1, math.ceil(n / rows_per_block))
    queries = blocks(asked, queries_per_block, n_asked).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                q_block, known = b.column(0)[r].as_py(), {x["query_id"]: x["floor"] for x in b.column(5)[r].as_py() or []}
                q_ids, q_m, ids, m = (np.frombuffer(b.column(c)[r].as_buffer(), "<i8") for c in range(1, 5))
                out: list[tuple] = list(search_block(q_m.reshape(-1, len(q_ids)).T, q_ids, m.reshape(-1, len(ids)), ids, k, known))
                rows = sum(len(x[1]) for x in out)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64)),
                        pa.array(np.concatenate([x[1] for x in out]).astype(np.int64)),
                        pa.array(np.concatenate([x[2] for x in out]).astype(np.int64)),
                        pa.array(np.full(rows, q_block, np.int32)),
                    ],
                    ["query_id", "vec_id", "score", "q_block"],
                )

    def met(asking: DataFrame) -> DataFrame:
        both = asking.join(candidates, "block").select("q_block", "q_ids", "q_m", "ids", "m", "floors")
        return both.mapInArrow(run, "query_id long, vec_id long, score long, q_block int")

    nothing = F.lit(None).cast("array<struct<query_id: long, floor: long>>")
    found = met(queries.withColumns({"block": F.lit(0), "floors": nothing}))
    if count > 1:
        found = cut(found)
        # No query block has more than its own queries, so neither has a row of floors.
        kth = found.groupBy("q_block", "query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("q_block", "query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
        floors = kth.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))
        others = queries.withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(count - 1))))
        found = found.unionByName(met(others.join(floors, "q_block", "left")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # one shuffle for both
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
