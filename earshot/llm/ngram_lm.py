"""A bigram language model in Elias-Fano tries, built from and applied to the whole corpus.

Texts are gathered into blocks. A block sends each shard of the vocabulary its distinct word hashes with
their training counts, and is told the corpus counts and dense word ids; then it sends each shard of the
trie its distinct pairs of known words, and is told their quantised probabilities. So a frequent word or
pair is one entry a block, shards hold about equal shares, and no table of the corpus is broadcast. A shard is
built from what all blocks sent, written to a file and looked up through a memory map of it.

Smoothing has a Dirichlet prior: p(w | h) = (c(h w) + K p(w)) / (c(h) + K), with the add-one unigram p(w).
The trie stores c(h w) / (c(h) + K); the rest needs counts of single words only.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batched, by_block, expand, give_back, squeeze
from .common import byte_length, cut, in_small_batches
from .eliasfano import EliasFano, encode
from .trie import Trie, dequantise, group_sorted

BLOCK_CHARS = 8 << 20
#: Contexts are spread over one more shard for each so many of their occurrences.
OCCURRENCES_PER_SHARD = 1 << 18
#: Not a word, as it holds white space: stands for the end of a text, and before its first word.
END = b"\n"


def _is_held_out(doc_id, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _blocks(shards: int, folds: int, fold: int):
    shift = 64 - (shards.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (ids, texts) in enumerate(batched(batches, BLOCK_CHARS)):
            index: dict[bytes, int] = {END: 0}
            words: list[int] = []
            counts = []
            for t in texts:
                own = (t or "").encode("utf-8", "surrogatepass").lower().split()
                words += [index.setdefault(w, len(index)) for w in own]
                words.append(0)
                counts.append(len(own) + 1)
            digest = xxhash.xxh64_intdigest
            hashes = np.array([digest(w) for w in index], dtype=np.uint64)
            order = np.argsort(hashes)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            tokens, hashes = rank[np.array(words)], hashes[order]
            held = np.array([_is_held_out(d, folds, fold) for d in ids])
            taught = np.bincount(tokens[~np.repeat(held, counts)], minlength=len(hashes))
            shard = (hashes >> np.uint64(shift)).astype(np.int64) if shards > 1 else np.zeros(len(hashes), np.int64)
            edges = np.searchsorted(shard, np.arange(shards + 1))
            vocabulary = [
                {"shard": s, "hashes": encode(hashes[a:b] - np.uint64(s << shift if shards > 1 else 0), 1 << shift), "counts": squeeze(taught[a:b])}
                for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist()))
                if b > a
            ]
            yield pa.RecordBatch.from_pylist(
                [{"block": (part << 32) + seq, "doc_ids": ids, "held": held.tolist(), "counts": counts, "tokens": squeeze(tokens), "vocabulary": vocabulary}],
                schema=_BLOCK,
            )

    return run


_BLOCK = pa.schema(
    [
        ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("counts", pa.list_(pa.int64())), ("tokens", pa.binary()),
        ("vocabulary", pa.list_(pa.struct([("shard", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))),
    ]
)
_BLOCK_SQL = "block long, doc_ids array<long>, held array<boolean>, counts array<long>, tokens binary, vocabulary array<struct<shard: int, hashes: binary, counts: binary>>"


def _count_words(shards: int):
    """A vocabulary shard: adds up the blocks' counts and answers each with ids (plus one; 0: unknown) and counts."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        hashes = [EliasFano.of(x.as_py()).decode() for x in rows.column("hashes")]
        counts = [expand(x.as_py()) for x in rows.column("counts")]
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, np.concatenate(counts))
        known = np.flatnonzero(total)
        by_count = known[np.lexsort((known, -total[known]))]
        ids = np.zeros(len(distinct), np.int64)
        ids[by_count] = np.arange(len(by_count)) * shards + shard + 1
        edges = np.cumsum([0, *map(len, hashes)])
        mine = [inverse[a:b] for a, b in zip(edges[:-1], edges[1:])]
        n, v = int(total.sum()), len(known)
        return pa.table(
            {
                "block": pa.concat_arrays([rows.column("block").combine_chunks(), pa.array([-1], pa.int64())]),
                "shard": pa.array([shard] * (len(mine) + 1), pa.int32()),
                "ids": pa.array([*(squeeze(ids[m]) for m in mine), b""], pa.binary()),
                "counts": pa.array([*(squeeze(total[m]) for m in mine), b""], pa.binary()),
                "n": pa.array([0] * len(mine) + [n], pa.int64()),
                "v": pa.array([0] * len(mine) + [v], pa.int64()),
                "top": pa.array([0] * len(mine) + [int(ids.max(initial=0))], pa.int64()),
            }
        )

    return run


class _Block:
    """A block with what the vocabulary told it: ids and counts of its words, and its distinct known pairs."""

    def __init__(self, held: np.ndarray, counts: np.ndarray, tokens: bytes, told: list[dict], shards: int):
        told = sorted(told, key=lambda x: x["shard"])
        self.ids = np.concatenate([expand(x["ids"]) for x in told]) - 1
        self.word_counts = np.concatenate([expand(x["counts"]) for x in told])
        self.counts, self.held = counts, held
        self.cur = expand(tokens)
        starts = np.cumsum(counts) - counts
        end = int(self.cur[starts[0] + counts[0] - 1])  # every text closes with the end
        self.prev = np.roll(self.cur, 1)
        self.prev[starts] = end
        known = (self.ids[self.cur] >= 0) & (self.ids[self.prev] >= 0)
        self.pair_tokens = np.flatnonzero(known)
        n = len(self.ids)
        key = self.prev[known] * n + self.cur[known]
        pairs, self.pair_of = np.unique(key, return_inverse=True)
        taught = (~np.repeat(held, counts))[known]
        self.taught = np.bincount(self.pair_of[taught], minlength=len(pairs))
        context, successor = self.ids[pairs // n], self.ids[pairs % n]
        spread = 1 + self.word_counts[pairs // n] // OCCURRENCES_PER_SHARD
        shard = (context + (successor * 0x9E3779B1 >> 7) % spread) % shards
        self.order = np.lexsort((successor, context, shard))
        self.context, self.successor, self.shard = context[self.order], successor[self.order], shard[self.order]
        self.context_counts = self.word_counts[pairs // n][self.order]


def _read_block(batch: pa.RecordBatch, r: int, shards: int) -> _Block:
    held = batch.column("held")[r].values.to_numpy(zero_copy_only=False).astype(bool)
    counts = batch.column("counts")[r].values.to_numpy(zero_copy_only=False)
    return _Block(held, counts, batch.column("tokens")[r].as_py(), batch.column("told")[r].as_py(), shards)


def _send_pairs(shards: int, universe: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                b = _read_block(batch, r, shards)
                taught = b.taught[b.order]
                edges = np.searchsorted(b.shard, np.arange(shards + 1))
                rows = []
                for s in np.flatnonzero(np.diff(edges)):
                    at = slice(edges[s], edges[s + 1])
                    first, c, p, q = group_sorted(b.context[at].astype(np.uint64), b.successor[at].astype(np.uint64), universe)
                    rows.append(
                        {
                            "shard": int(s), "block": batch.column("block")[r].as_py(), "contexts": c, "pointers": p, "successors": q,
                            "taught": squeeze(taught[at]), "context_counts": squeeze(b.context_counts[at][first]),
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=_PAIRS)
                give_back()

    return run


_PAIRS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("contexts", "pointers", "successors", "taught", "context_counts"))]
)
_PAIRS_SQL = "shard int, block long, contexts binary, pointers binary, successors binary, taught binary, context_counts binary"


def _pairs_of(row: dict, universe: int) -> tuple[np.ndarray, ...]:
    contexts = EliasFano.of(row["contexts"]).decode()
    n = np.diff(EliasFano.of(row["pointers"]).decode().astype(np.int64))
    rank = np.repeat(np.arange(len(contexts), dtype=np.uint64), n)
    successors = EliasFano.of(row["successors"]).decode() - rank * np.uint64(universe)
    return np.repeat(contexts, n), successors, expand(row["taught"]), np.repeat(expand(row["context_counts"]), n)


def build_shard(rows: list[dict], universe: int, strength: float) -> bytes:
    """The trie of one shard from the pairs that the blocks have sent."""
    contexts, successors, taught, of_context = (np.concatenate(x) for x in zip(*(_pairs_of(r, universe) for r in rows)))
    order = np.lexsort((successors, contexts))
    contexts, successors, of_context = contexts[order], successors[order], of_context[order]
    first = np.flatnonzero(np.append(True, (contexts[1:] != contexts[:-1]) | (successors[1:] != successors[:-1])))
    total = np.add.reduceat(taught[order], first)
    seen = total > 0
    first, total = first[seen], total[seen]
    return Trie.build(contexts[first], successors[first], total / (of_context[first] + strength), universe)


def _answer_pairs(universe: int, strength: float):
    def run(rows: pa.Table) -> pa.Table:
        asked = rows.to_pylist()
        with tempfile.NamedTemporaryFile() as file:  # a task's own, gone with it; a retry builds it anew
            file.write(build_shard(asked, universe, strength))
            file.flush()
            give_back()
            trie = Trie.open(file.name)
            answers = [squeeze(trie.lookup(*_pairs_of(r, universe)[:2])) for r in asked]
            del trie
        return pa.table({"block": rows.column("block"), "shard": rows.column("shard"), "q": pa.array(answers, pa.binary())})

    return run


def _score(shards: int, n: int, v: int, strength: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                b = _read_block(batch, r, shards)
                base = (b.word_counts + 1) / (n + v + 1)
                weight = strength / (b.word_counts + strength)  # left for single words after a known context
                p = base[b.cur] * np.where(b.ids[b.prev] >= 0, weight[b.prev], 1.0)
                answers = sorted(batch.column("answers")[r].as_py() or [], key=lambda x: x["shard"])
                if answers:
                    q = np.empty(len(b.order))
                    q[b.order] = dequantise(np.concatenate([expand(x["q"]) for x in answers]))
                    p[b.pair_tokens] += q[b.pair_of]
                starts = np.cumsum(b.counts) - b.counts
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[r].values,
                        pa.array(b.held),
                        pa.array(b.counts),
                        pa.array(np.add.reduceat((b.word_counts > 0)[b.cur].astype(np.int64), starts)),
                        pa.array(np.full(len(starts), n)),
                        pa.array(np.add.reduceat(np.log10(base)[b.cur], starts)),
                        pa.array(np.add.reduceat(np.log10(p), starts)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                give_back()

    return run


def lm_scores(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_fold: int = 2,
    strength: float = 100.0,
    shard_bytes: int = 12 << 20,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Learns from all rows but those of the held-out fold (crc32 of the id as text). Null and empty texts
    are the end token alone; a null id counts as the empty text for its fold; repeated rows count each
    time. With no training row both scores follow from c = N = V = 0. The model has about one shard for
    each ``shard_bytes`` of text. Words are told apart by 64-bit hashes.
    """
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(byte_length("text"))).first()[0] or 0
    shards = 1 << max(2, (size // shard_bytes).bit_length())
    blocks = cut(rows.mapInArrow(_blocks(shards, folds, held_fold), _BLOCK_SQL))
    told = cut(
        blocks.select("block", F.explode("vocabulary").alias("x"))
        .select("block", "x.*")
        .groupBy("shard")
        .applyInArrow(_count_words(shards), "block long, shard int, ids binary, counts binary, n long, v long, top long")
    )
    sums = told.where("block = -1").agg(F.sum("n"), F.sum("v"), F.max("top")).first()
    n, v, universe = int(sums[0] or 0), int(sums[1] or 0), int(sums[2] or 0) + 1
    if universe >= 1 << 36:
        raise ValueError("successor codes would not fit 64 bits; raise the number of shards' id width first")
    # Both uses of this join share one shuffle of the blocks.
    informed = blocks.drop("vocabulary").join(by_block(told.where("block >= 0"), "shard", "ids", "counts", into="told"), "block")
    answers = (
        informed.select("block", "held", "counts", "tokens", "told")
        .mapInArrow(_send_pairs(shards, universe), _PAIRS_SQL)
        .groupBy("shard")
        .applyInArrow(_answer_pairs(universe, strength), "block long, shard int, q binary")
    )
    found = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return informed.join(by_block(answers, "shard", "q", into="answers"), "block", "left").mapInArrow(_score(shards, n, v, strength), found)
