"""Mixture-controlled packing of tokenised documents into fixed windows.

Each source is a queue of tokens, and every window is filled by deficit round-robin: the queue that lags
most behind its target share gives the next token. Who is served by when has a closed form. Token i of a
queue with share w is due at (i + 1/2) / w; windows are consecutive cuts of all tokens in the order of
their due times. So what a queue lacks or has too much at the end of a window is carried into the next,
and any task can work out any window from the queues' totals alone, without the windows before it.

Sources beyond the largest form a tree of queues: the tokens of a queue that holds others are served from
these by the same closed form, in windows of its own, so every source keeps its share, small ones in pieces
that are not smaller than they must be, and a task needs only the totals beside the path of a source it holds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import batched, give_back
from .common import cut, in_small_batches

END_ID = 2
BLOCK_BYTES = 6 << 20
#: Sources with a queue of their own at the top; queues in each node of the tree of all others, about.
LARGEST, BRANCHES = 255, 128
#: Windows that are worked out at once; bounds memory only.
WINDOWS_AT_ONCE = 4096
#: Words kept in a worker's cache; bounds memory only.
CACHE_WORDS = 800_000
_TAIL, _ENDS = re.compile(rb"(?<=[a-z0-9])[.,;:!?|]+$"), frozenset(b".,;:!?|")


def _gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``first`` and have ``size`` entries, in a row."""
    stops = np.cumsum(size)
    return flat[np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(first - (stops - size), size)]


class WordTokenizer:
    """Token ids of words. White space always parts tokens here, so a text is its words' ids in a row;
    so is a run of ASCII punctuation at the end of a word from the letter or digit before it."""

    _open: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Known words as sorted 128-bit hashes with the place of their ids: a tenth of what a dict would take.
        self.keys = np.zeros((0, 2), "<u8")
        self.first, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    @classmethod
    def of(cls, path: str | None) -> WordTokenizer:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each)."""
        cores, tails = [], []
        for w in words:
            if b"<|" not in w:  # special tokens are only recognised as written
                w = w.lower()
            m = _TAIL.search(w) if w[-1] in _ENDS else None
            cores.append(w[: m.start()] if m else w)
            tails.append(m[0] if m else b"")
        both = pa.array(cores + tails, pa.large_binary()).dictionary_encode()
        pieces = both.dictionary.to_pylist()
        keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), "<u8").reshape(-1, 2)
        at = np.minimum(np.searchsorted(self.keys[:, 0], keys[:, 0]), max(0, len(self.keys) - 1))
        known = (self.keys[at] == keys).all(1) if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        ids, sizes = [], []
        for a in range(0, len(new), 4096):
            part = [pieces[i].decode("utf-8", "surrogatepass") for i in new[a : a + 4096]]
            for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                own = e.ids
                ids += own
                sizes.append(len(own))
        first, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        first[known], size[known] = self.first[at[known]], self.size[at[known]]
        size[new] = sizes
        first[new] = len(self.flat) + np.cumsum(size[new]) - size[new]
        flat = np.concatenate([self.flat, np.array(ids, dtype="<u4")])
        which = both.indices.to_numpy().astype(np.int64).reshape(2, -1).T.ravel()  # core and tail, word by word
        out = _gather(flat, first[which], size[which])
        room = max(0, CACHE_WORDS - len(self.keys))
        if room and len(new):
            new = new[:room]
            every = np.concatenate([self.keys, keys[new]])
            order = np.argsort(every[:, 0], kind="stable")
            self.keys, self.first, self.size = every[order], np.concatenate([self.first, first[new]])[order], np.concatenate([self.size, size[new]])[order]
            self.flat = flat[: int((first[new] + size[new]).max())]
        return out, size[which].reshape(-1, 2).sum(1)

    def texts(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each closed by ``end``; number of ids of each text)."""
        words: list[bytes] = []
        counts = []
        for t in texts:
            own = t.encode("utf-8", "surrogatepass").split()
            words += own
            counts.append(len(own) + 1)
        coded = pa.array(words, pa.large_binary()).dictionary_encode()
        flat, size = self.words(coded.dictionary.to_pylist())
        flat, size = np.append(np.array([end], "<u4"), flat), np.append(1, size)
        at = np.zeros(len(words) + len(texts), np.int64)
        inside = np.ones(len(at), bool)
        inside[np.cumsum(counts, dtype=np.int64) - 1] = False  # the end closes each text
        at[inside] = coded.indices.to_numpy() + 1
        ids = _gather(flat, (np.cumsum(size) - size)[at], size[at])
        ends = np.cumsum(size[at])[np.cumsum(counts) - 1] if counts else np.zeros(0, np.int64)
        return ids, np.diff(ends, prepend=0)


def _tokenise(path: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = WordTokenizer.of(path), zstandard.ZstdCompressor(1)
        part = TaskContext.get().partitionId()
        for seq, (ids, texts, sources) in enumerate(batched(batches, BLOCK_BYTES)):
            tokens, counts = tokenizer.texts([t or "" for t in texts], end)
            totals: dict[str | None, int] = {}
            for s, n in zip(sources, counts.tolist()):
                totals[s] = totals.get(s, 0) + n
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "block": (part << 32) + seq,
                        "doc_ids": ids,
                        "sources": sources,
                        "counts": counts,
                        "totals": [{"source": s, "n": n} for s, n in totals.items()],
                        "tokens": packer.compress(tokens.astype("<u2" if tokens.max(initial=0) < 65536 else "<u4").tobytes()),
                        "wide": bool(tokens.max(initial=0) >= 65536),
                    }
                ],
                schema=_BLOCK,
            )

    return run


_BLOCK = pa.schema(
    [
        ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
        ("totals", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))), ("tokens", pa.binary()), ("wide", pa.bool_()),
    ]
)
_BLOCK_SQL = "block long, doc_ids array<long>, sources array<string>, counts array<long>, totals array<struct<source: string, n: long>>, tokens binary, wide boolean"


def served(totals: np.ndarray, weights: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Tokens that each queue has given once ``upto`` tokens are placed: a row per value, a column per queue.

    ``totals`` are the queues' sizes, all positive. Queues that ran dry give way to the others.
    """
    drained = totals / weights
    order = np.argsort(drained, kind="stable")
    speed = np.concatenate([np.cumsum(weights[order][::-1])[::-1], [0.0]])
    steps = np.diff(drained[order], prepend=0.0)
    amounts = np.concatenate([[0.0], np.cumsum(steps * speed[:-1])])
    times = np.concatenate([[0.0], drained[order]])
    tau = np.interp(upto.astype(np.float64), amounts, times)
    n = np.minimum(totals, np.floor(tau[:, None] * weights + 0.5).astype(np.int64))
    lack = np.minimum(upto, totals.sum()) - n.sum(1)
    rows = np.arange(len(upto))
    while (more := np.flatnonzero(lack > 0)).size:
        due = np.where(n[more] < totals, (n[more] + 0.5) / weights, np.inf)
        n[rows[more], due.argmin(1)] += 1
        lack[more] -= 1
    while (less := np.flatnonzero(lack < 0)).size:
        last = np.where(n[less] > 0, (n[less] - 0.5) / weights, -np.inf)
        n[rows[less], last.shape[1] - 1 - last[:, ::-1].argmax(1)] -= 1
        lack[less] += 1
    return n


def cut_queue(at: np.ndarray, length: np.ndarray, s: int, totals: np.ndarray, weights: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of stretches of queue ``s`` (``at`` rising): (stretch, start in it, length, place among all tokens)."""
    low, high = (_window_of(totals, weights, s, int(x), window) for x in (at[0], at[-1] + length[-1] - 1))
    found = []
    for a in range(low, high + 1, WINDOWS_AT_ONCE):
        edges = served(totals, weights, np.arange(a, min(a + WINDOWS_AT_ONCE, high + 1) + 1, dtype=np.int64) * window)
        mine = edges[:, s]
        held = np.flatnonzero((at < mine[-1]) & (at + length > mine[0]))
        if not len(held):
            continue
        first, stop = np.maximum(at[held], mine[0]), np.minimum(at[held] + length[held], mine[-1])
        cuts = np.unique(np.concatenate([first, mine[mine > first[0]]]))
        d = np.searchsorted(first, cuts, side="right") - 1
        ends = np.minimum(np.append(cuts[1:], stop[-1]), stop[d])
        keep = cuts < stop[d]
        cuts, d, ends = cuts[keep], d[keep], ends[keep]
        w = np.searchsorted(mine, cuts, side="right") - 1
        before = (edges[1:] - edges[:-1])[:, :s].sum(1)
        found.append((held[d], cuts - at[held[d]], ends - cuts, (a + w) * window + before[w] + cuts - mine[w]))
    return tuple(np.concatenate(x) for x in zip(*found))


def cut_source(counts: np.ndarray, first: int, path: list[tuple[int, np.ndarray, np.ndarray]], window: int) -> tuple[np.ndarray, ...]:
    """Pieces of the documents (sizes ``counts``) that begin at ``first`` in their source: (document, start in it, length, place).

    ``path`` names the queue and the totals and weights beside it in each node, from the source's to the top.
    """
    doc, start, length = np.arange(len(counts)), np.zeros(len(counts), np.int64), counts
    at = first + np.cumsum(counts) - counts
    for s, totals, weights in path:
        part, inside, length, at = cut_queue(at, length, s, totals, weights, window)
        doc, start = doc[part], start[part] + inside
    return doc, start, length, at


def _window_of(totals: np.ndarray, weights: np.ndarray, s: int, token: int, window: int) -> int:
    low, high = 0, int(-(-totals.sum() // window))
    while high - low > 1:
        probes = np.unique(np.linspace(low, high, 17).astype(np.int64))
        given = served(totals, weights, probes * window)[:, s]
        i = int(np.searchsorted(given, token, side="right")) - 1
        low, high = int(probes[i]), int(probes[min(i + 1, len(probes) - 1)])
    return low


_PATH = "array<struct<at: int, totals: array<long>>>"


def _tree(small: DataFrame, sources: int) -> DataFrame:
    """(source, path): for each of the small sources (source, n) the nodes from its own up to below the top."""
    width = max(1, math.ceil(sources / BRANCHES))
    items = small.withColumn("key", F.col("source")).withColumn("node", F.pmod(F.xxhash64("source"), F.lit(width)))
    paths = small.select("source", F.col("source").alias("key"))
    paths = paths.withColumn("path", F.array().cast(_PATH))
    while True:
        nodes = items.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("kids"))
        steps = nodes.select("node", F.transform("kids", lambda k: k["n"]).alias("totals"), F.posexplode("kids").alias("at", "kid"))
        steps = steps.select(F.col("node").alias("up"), F.col("kid.key").alias("step"), F.struct("at", "totals").alias("part"))
        paths = paths.join(steps, F.col("key").eqNullSafe(F.col("step"))).select("source", F.col("up").alias("key"), F.concat("path", F.array("part")).alias("path"))
        if width == 1:
            return paths.select("source", "path")
        width = math.ceil(width / BRANCHES)
        items = items.groupBy(F.col("node").alias("key")).agg(F.sum("n").alias("n")).withColumn("node", F.pmod("key", F.lit(width)))


def _firsts(parts: DataFrame) -> DataFrame:
    """``parts`` (block, source, n) with the tokens of the source in earlier blocks: summed by task first, so that no task holds all blocks of a source."""
    task = parts.withColumn("task", F.shiftright("block", 32))
    sums = task.groupBy("source", "task").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("task").alias("_task"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "task").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    joined = task.withColumn("_within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("task") == F.col("_task")))
    return joined.select("block", "source", (F.col("_before") + F.col("_within")).alias("first"))


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    window: int = 4096,
    weights: dict[str, float] | None = None,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces (doc_id, source, start, length, doc_tokens, sequence_id, offset, block, row, ids) that fill the windows.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers. All windows but the
    last are full. The target share of a source is its share of all tokens, or its entry of ``weights``
    (then others keep theirs); every token is packed, so weights must be positive and finite, others raise;
    entries for sources that do not occur have no effect. Null or empty texts are the end id alone; null
    sources form a source; repeated rows are packed each; an empty table gives no piece. A document is taken
    into its queue in the order its block was read; ``block`` and ``row`` tell rows of equal ids apart. Ids are
    cast to long; one that is not a whole number raises. Other columns are not read.
    """
    if any(not 0 < w < math.inf for w in (weights or {}).values()):
        raise ValueError("weights must be positive and finite: every token is packed")
    spark = docs.sparkSession
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    blocks = cut(rows.mapInArrow(_tokenise(tokenizer_path, end_id), _BLOCK_SQL))
    parts = blocks.select("block", F.explode("totals").alias("t")).select("block", "t.source", "t.n")
    sizes = cut(parts.groupBy("source").agg(F.sum("n").alias("n")))
    everything, sources = sizes.agg(F.sum("n"), F.count("*")).first()
    named = {r.source: r.n for r in sizes.orderBy(F.desc("n"), "source").limit(LARGEST).collect()}
    named |= {r.source: r.n for r in sizes.where(F.col("source").isin(list(weights or ()))).collect()}
    queue_of = {s: i for i, s in enumerate(named)}
    totals = np.array(list(named.values()), dtype=np.int64)
    shares = np.array([(weights or {}).get(s, n / everything) for s, n in named.items()])
    places = _firsts(parts)
    if sources == len(named):
        placed = places.withColumn("path", F.lit(None).cast(_PATH))
    else:
        top = F.broadcast(spark.createDataFrame([(s,) for s in queue_of], "top string"))  # LARGEST rows and those that have a weight
        small = cut(sizes.join(top, F.col("source").eqNullSafe(F.col("top")), "left_anti"))
        totals = np.append(totals, everything - totals.sum())
        shares = np.append(shares, totals[-1] / everything)
        paths = cut(_tree(small, sources - len(named))).withColumnRenamed("source", "small")
        # The largest sources have no path; others are no hot keys.
        large = places.join(top, F.col("source").eqNullSafe(F.col("top"))).select("block", "source", "first", F.lit(None).cast(_PATH).alias("path"))
        placed = large.unionByName(places.join(paths, F.col("source").eqNullSafe(F.col("small"))).select("block", "source", "first", "path"))
    starts = placed.groupBy("block").agg(F.collect_list(F.struct("source", "first", "path")).alias("firsts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in range(batch.num_rows):
                block, ids, sources, counts, tokens, wide, firsts = (batch.column(c)[r] for c in range(7))
                counts = counts.values.to_numpy(zero_copy_only=False)
                sources = sources.values
                codes = sources.dictionary_encode(null_encoding="encode")
                code_of = {s: i for i, s in enumerate(codes.dictionary.to_pylist())}
                code = codes.indices.to_numpy(zero_copy_only=False)
                flat = np.frombuffer(unpack.decompress(tokens.as_buffer()), "<u4" if wide.as_py() else "<u2").astype("<u4")
                found = []
                for f in firsts.as_py():
                    beside = [(x["at"], np.array(x["totals"], np.int64)) for x in f["path"] or []]
                    path = [(at, n, n / n.sum()) for at, n in beside]
                    path.append((queue_of.get(f["source"], len(queue_of)), totals, shares))
                    mine = np.flatnonzero(code == code_of[f["source"]])
                    doc, *where = cut_source(counts[mine], f["first"], path, window)
                    found.append((mine[doc], *where))
                doc, start, length, place = (np.concatenate(x) for x in zip(*found))
                doc_first = np.cumsum(counts) - counts
                at = doc_first[doc] + start
                ordered = np.repeat(at - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                edges = np.append(0, np.cumsum(length)) * 4
                for a in range(0, len(doc), 4096):
                    b = min(len(doc), a + 4096)
                    blob = pa.Array.from_buffers(
                        pa.binary(), b - a, [None, pa.py_buffer((edges[a : b + 1] - edges[a]).astype("<i4")), pa.py_buffer(flat[ordered[edges[a] // 4 : edges[b] // 4]])]
                    )
                    take = pa.array(doc[a:b])
                    numbers = (x[a:b] for x in (start, length, counts[doc], place // window, place % window, np.full(len(doc), block.as_py()), doc))
                    yield pa.RecordBatch.from_arrays([ids.values.take(take), sources.take(take), *map(pa.array, numbers), blob], names)
                give_back()

    names = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "block", "row", "ids"]
    found = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, block long, row long, ids binary"
    return blocks.join(starts, "block").select("block", "doc_ids", "sources", "counts", "tokens", "wide", "firsts").mapInArrow(run, found)
