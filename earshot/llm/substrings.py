"""Removal of passages that repeat across documents: seed and extend on winnowed anchors.

Seeds: each window of consecutive words has an anchor, the leftmost smallest hash among the short word runs
inside it; equal windows have equal anchors at the same place, so documents are joined on anchors, and an
anchor that only one document has is no seed. Extending: every place of a shared anchor brings the words to
its left and right, as far as windows that it anchors reach, to the join. There the places of an anchor are
parted word by word, leftwards and rightwards, so that after i words to the left and j to the right two places
are together if and only if they agree in all these words; with i + j + anchor = window each learns whether an
earlier document agrees that far. So places are never paired, a copied context is one row a block, and words
are compared, not hashes. Overlapping windows run together into maximal repeats, at least a window long.

Texts are gathered into blocks, which ask shards of the anchor table and then bring their seeds to shards of
the extension. The places of a frequent anchor would fill one shard: they go window by window instead, each
to the shard of the whole window, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import batched, by_block, expand, give_back, squeeze
from .common import byte_length, cut, in_small_batches
from .eliasfano import EliasFano, encode

BLOCK_CHARS = 2 << 20
ANCHOR_WORDS = 5
#: Words beside an anchor at most, on either side: an answer has a bit for each.
MOST_BESIDE = 60
#: Places from which on an anchor's windows are routed one by one; both ways are exact.
HOT_PLACES = 1 << 14
#: What an anchor can be: in one document, in several, in very many places.
ALONE, SHARED, HOT = range(3)
#: A null id: later than any other, so that it is never the first to hold a passage.
NO_ID = (1 << 63) - 1


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two runs of words in a row from the runs' hashes."""
    h = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position; the array is shorter by length - 1."""
    out, done, power, size = None, 0, words, 1
    while True:
        if length & size:
            piece = power[done:] if done else power
            if out is None:
                out = piece
            else:
                n = min(len(out), len(piece))
                out = _join(out[:n], piece[:n])
            done += size
        if done == length:
            return out
        power = _join(power[: max(0, len(power) - size)], power[size:])
        size *= 2


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of the ``width`` values from each position on."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[: max(0, len(at) - step)], at[step:]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at


def anchor_words(length: int) -> int:
    return max(min(ANCHOR_WORDS, length), length - MOST_BESIDE)


@dataclass
class Seeds:
    """What a block brings to the extension, sorted by route, and the seed that answers for each window."""

    route: np.ndarray
    words: np.ndarray
    low: np.ndarray
    window: np.ndarray
    seed: np.ndarray
    left: np.ndarray


class Windows:
    """The windows of a block's texts that lie in one text each, and the places of their anchors."""

    def __init__(self, texts: list[bytes], length: int):
        index: dict[bytes, int] = {}
        words: list[int] = []
        self.words = [t.split() for t in texts]
        for own in self.words:
            words += [index.setdefault(w, len(index)) for w in own]
        self.vocabulary = list(index)
        self.ids = np.array(words, dtype=np.int32)
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in index], dtype=np.uint64)
        self.counts = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.length = length
        self.short = anchor_words(length)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.at = self.begin = self.place = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        n = len(self.ids) - length + 1
        if n <= 0:
            return
        left = np.repeat(np.cumsum(self.counts), self.counts) - np.arange(len(self.ids))
        self.at = np.flatnonzero(left[:n] >= length)
        runs = run_hashes(self.hashes[self.ids], self.short)
        places = sliding_argmin(runs, length - self.short + 1)[self.at]
        # Windows with the same place follow one another; they are one seed.
        self.begin = np.flatnonzero(np.diff(places, prepend=-1))
        self.place = places[self.begin]
        self.anchor = runs[self.place]

    def seeds(self, state: np.ndarray, ids: np.ndarray) -> Seeds:
        """Seeds at the places whose ``state`` is not ALONE; ``ids`` are the texts' document ids."""
        keep = np.flatnonzero(state != ALONE)
        place, begin = self.place[keep], self.begin[keep]
        first = self.at[begin]
        windows = np.append(self.begin, len(self.at))[keep + 1] - begin
        beside = self.length - self.short
        column = np.arange(self.length + beside)
        at = place[:, None] + (column - beside)
        inside = (at >= first[:, None]) & (at < (first + windows - 1 + self.length)[:, None])
        words = np.where(inside, self.ids[np.clip(at, 0, max(0, len(self.ids) - 1))] + 1, 0).astype(np.int32) if len(keep) else np.zeros((0, len(column)), np.int32)
        own, anchor, hot = ids[self.doc[first]], self.anchor[keep], state[keep] == HOT
        parts = [(words[~hot], own[~hot], anchor[~hot])]
        # The windows of a frequent anchor: a seed each, of the window's own words.
        lone = []
        for left in range(beside + 1 if hot.any() else 0):
            of = np.flatnonzero(hot & (place - left >= first) & (place - left < first + windows))
            lone.append((begin[of] + place[of] - left - first[of], np.full(len(of), left)))
            parts.append((np.where((column >= beside - left) & (column < beside - left + self.length), words[of], 0), own[of], anchor[of]))
        words, own, anchor = (np.concatenate(x) for x in zip(*parts))
        seed, chosen = self._distinct(words)
        cold = int((~hot).sum())
        route = anchor.copy()
        route[cold:] = _join(anchor[cold:], self._row_hashes(words[cold:]))
        order = chosen[np.argsort(route[chosen], kind="stable")]
        rank = np.empty(len(chosen), np.int64)
        rank[seed[order]] = np.arange(len(order))
        low = np.full(len(order), NO_ID, np.int64)
        np.minimum.at(low, rank[seed], own)
        many = windows[~hot]
        window = np.repeat(begin[~hot] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        lefts = np.repeat(place[~hot], many) - self.at[window]
        of_window = rank[np.append(np.repeat(seed[:cold], many), seed[cold:])]
        window, left = (np.concatenate(x) for x in zip((window, lefts), *lone))
        return Seeds(route[order], words[order], low, window, of_window, left)

    def _row_hashes(self, words: np.ndarray) -> np.ndarray:
        hashes = np.append(np.uint64(0), self.hashes)
        out = np.zeros(len(words), np.uint64)
        for c in range(words.shape[1]):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[words[:, c]]
        return out

    def _distinct(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each row among the distinct rows, a row of each number)."""
        _, chosen, number = np.unique(self._row_hashes(words), return_index=True, return_inverse=True)
        if (words != words[chosen[number]]).any():  # hashes that agree by chance
            _, chosen, number = np.unique(words, axis=0, return_index=True, return_inverse=True)
        return number.reshape(-1), chosen


def _by_first(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, smallest id of each, largest id of each, position of each hash among the distinct)."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    low = np.full(len(distinct), NO_ID, np.int64)
    high = np.full(len(distinct), -NO_ID - 1, np.int64)
    np.minimum.at(low, inverse, ids)
    np.maximum.at(high, inverse, ids)
    return distinct, low, high, inverse


def _sharded(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, slice, bytes]]:
    """Slices of sorted hashes by their top bits, with the code of the rest."""
    shift = 64 - (shards.bit_length() - 1)
    edges = np.searchsorted((hashes >> np.uint64(shift)).astype(np.int64), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        at = slice(int(edges[s]), int(edges[s + 1]))
        yield int(s), at, encode(hashes[at] - np.uint64(int(s) << shift), 1 << shift)


def _ids(ids: list) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)


def _anchors(shards: int, length: int, rest_type: pa.DataType):
    schema = pa.schema(
        [
            ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary()), ("rest", pa.list_(rest_type)),
            ("anchors", pa.list_(pa.struct([("shard", pa.int32()), ("hashes", pa.binary()), ("several", pa.binary()), ("places", pa.binary())]))),
        ]
    )

    def anchors(raw: list[bytes]) -> list[dict]:
        w = Windows(raw, length)
        distinct, low, high, inverse = _by_first(w.anchor, w.doc[w.place])
        places = np.bincount(inverse, minlength=len(distinct))
        return [
            {"shard": s, "hashes": code, "several": np.packbits(low[at] < high[at]).tobytes(), "places": squeeze(places[at])}
            for s, at, code in _sharded(distinct, shards)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (ids, texts, rest) in enumerate(batched(batches, BLOCK_CHARS)):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "block": (part << 32) + seq, "doc_ids": ids, "sizes": [len(t) for t in raw], "texts": zstandard.ZstdCompressor(3).compress(b"".join(raw)),
                        "rest": rest, "anchors": anchors(raw),
                    }
                ],
                schema=schema,
            )

    return run


def _shared_anchors(hot_places: int):
    def run(rows: pa.Table) -> pa.Table:
        """A shard of the anchor table: for each anchor asked about whether it is ALONE, SHARED or HOT."""
        hashes = [EliasFano.of(x.as_py()).decode() for x in rows.column("hashes")]
        several = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(h)) for x, h in zip(rows.column("several"), hashes)]
        places = np.concatenate([expand(x.as_py()) for x in rows.column("places")])
        distinct, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        shared = counts > 1
        np.logical_or.at(shared, inverse, np.concatenate(several).astype(bool))
        hot = np.bincount(inverse, weights=places, minlength=len(distinct)) > hot_places
        state = np.where(shared, np.where(hot, HOT, SHARED), ALONE)
        parts = np.split(state[inverse], np.cumsum([len(h) for h in hashes])[:-1])
        states = pa.array([squeeze(p) for p in parts], pa.binary())
        del hashes, several, places, distinct, inverse, counts, shared, hot, state, parts
        give_back()
        return pa.table({"block": rows.column("block"), "shard": rows.column("shard"), "told": states})

    return run


def _parted(group: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Groups parted by one more word."""
    return np.unique(group * (int(word.max(initial=0)) + 1) + word, return_inverse=True)[1]


def earlier_windows(route: np.ndarray, words: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """For each seed a bit for each number of words left of its anchor: set if a seed of an earlier document agrees in that whole window."""
    beside = words.shape[1] - length
    short = length - beside
    anchor = np.unique(route, return_inverse=True)[1]
    for c in range(beside, beside + short):
        anchor = _parted(anchor, words[:, c])
    lefts, rights = [anchor], [np.zeros(len(anchor), np.int64)]
    for i in range(beside):
        lefts.append(_parted(lefts[-1], words[:, beside - 1 - i]))
        rights.append(_parted(rights[-1] if i else anchor, words[:, beside + short + i]))
    found = np.zeros(len(words), np.int64)
    for left in range(beside + 1):
        right = beside - left
        whole = np.flatnonzero((words[:, beside - left] > 0) & (words[:, beside - left + length - 1] > 0))
        group = np.unique(lefts[left][whole] * (len(words) + 1) + rights[right][whole], return_inverse=True)[1]
        first = np.full(int(group.max(initial=-1)) + 1, NO_ID, np.int64)
        np.minimum.at(first, group, low[whole])
        found[whole] |= (first[group] < low[whole]).astype(np.int64) << left
    return found


def _extend(length: int):
    def run(rows: pa.Table) -> pa.Table:
        """A shard of the extension: ``earlier_windows`` of the seeds of all blocks."""
        index: dict[bytes, int] = {b"": 0}
        routes, words = [], []
        for route, vocabulary, places in zip(rows.column("routes"), rows.column("vocabulary"), rows.column("words")):
            routes.append(EliasFano.of(route.as_py()).decode())
            own = zstandard.ZstdDecompressor().decompress(vocabulary.as_py()).split(b" ")
            number = np.fromiter((index.setdefault(w, len(index)) for w in own), np.int64, len(own))
            words.append(number[expand(places.as_py())].astype(np.int32).reshape(len(routes[-1]), -1))
        low = np.concatenate([expand(x.as_py()) + base.as_py() for x, base in zip(rows.column("firsts"), rows.column("base"))])
        edges = np.cumsum([len(r) for r in routes])[:-1]
        found = np.split(earlier_windows(np.concatenate(routes), np.concatenate(words), low, length), edges)
        told = pa.array([squeeze(x) for x in found], pa.binary())
        del index, routes, words, low, found
        give_back()
        return pa.table({"block": rows.column("block"), "shard": rows.column("shard"), "told": told})

    return run


def _told(told: list[dict] | None) -> np.ndarray:
    """What the shards have told a block, in the order it asked."""
    parts = [expand(x["told"]) for x in sorted(told or [], key=lambda x: x["shard"])]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _seeded(batch: pa.RecordBatch, r: int, length: int) -> tuple[list[bytes], np.ndarray, Windows, Seeds]:
    """A block's texts, ids, windows and seeds."""
    flat = zstandard.ZstdDecompressor().decompress(batch.column("texts")[r].as_py())
    edges = np.cumsum([0, *batch.column("sizes")[r].as_py()]).tolist()
    texts = [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]
    w = Windows(texts, length)
    state = _told(batch.column("shared")[r].as_py())[np.unique(w.anchor, return_inverse=True)[1]]
    ids = _ids(batch.column("doc_ids")[r].as_py())
    return texts, ids, w, w.seeds(state, ids)


def _bring_seeds(shards: int, length: int):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("routes", "vocabulary", "words")), ("base", pa.int64()), ("firsts", pa.binary())])

    def brought(batch: pa.RecordBatch, r: int) -> pa.RecordBatch:
        _, _, w, seeds = _seeded(batch, r, length)
        packer = zstandard.ZstdCompressor(3)
        rows = []
        for s, at, code in _sharded(seeds.route, shards):
            # Words as places in a vocabulary of the message, whose first is the empty word outside of the windows.
            own, number = np.unique(np.append(np.int32(0), seeds.words[at].ravel()), return_inverse=True)
            base = int(seeds.low[at].min())
            rows.append(
                {
                    "shard": s, "block": batch.column("block")[r].as_py(), "routes": code,
                    "vocabulary": packer.compress(b" ".join([b"", *(w.vocabulary[i - 1] for i in own[1:].tolist())])), "words": squeeze(number[1:]),
                    "base": base, "firsts": squeeze((seeds.low[at] - base).astype(np.uint64)),
                }
            )
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                out = brought(batch, r)  # what it worked on is freed before the next block
                give_back()
                yield out

    return run


def _remove(length: int, rejoin: bool, rest_type: pa.DataType):
    names = ["doc_id", "n_words", "n_removed", "kept", "spans", "rest"]
    span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))

    def cleaned(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, list[str], list[list[dict]]]:
        texts, ids, w, seeds = _seeded(batch, r, length)
        at = w.at[seeds.window]
        elsewhere = _told(batch.column("earlier")[r].as_py())[seeds.seed] >> seeds.left & 1
        repeats = at[(elsewhere > 0) | (seeds.low[seeds.seed] < ids[w.doc[at]])]
        depth = np.zeros(len(w.doc) + 1, np.int64)
        np.add.at(depth, repeats, 1)
        np.add.at(depth, repeats + length, -1)
        gone = np.cumsum(depth[:-1]) > 0
        first = np.cumsum(w.counts) - w.counts
        removed = np.diff(np.append(0, np.cumsum(gone))[np.append(first, len(gone))])
        kept, spans = [], []
        for i, words in enumerate(w.words):
            if not removed[i]:
                kept.append((b" ".join(words) if rejoin else texts[i]).decode("utf-8", "surrogatepass"))
                spans.append([])
                continue
            mask = gone[first[i] : first[i] + w.counts[i]]
            kept.append(b" ".join([x for x, g in zip(words, mask.tolist()) if not g]).decode("utf-8", "surrogatepass"))
            edges = np.flatnonzero(np.diff(mask, prepend=False, append=False))
            spans.append([{"first": a, "words": b - a} for a, b in edges.reshape(-1, 2).tolist()])
        return w.counts, removed.astype(np.int64), kept, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                counts, removed, kept, spans = cleaned(batch, r)
                give_back()
                rest = batch.column("rest")[r].values
                for a in range(0, len(kept), 512):
                    b = a + 512
                    columns = [
                        batch.column("doc_ids")[r].values[a:b], pa.array(counts[a:b]), pa.array(removed[a:b]),
                        pa.array(kept[a:b], pa.string()), pa.array(spans[a:b], span), rest[a:b],
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 13, rejoin: bool = True, carry: list[str] | None = None, shard_bytes: int = 12 << 20
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans, rest) for each row of ``docs``.

    A word goes if a window of ``length`` words around it also starts in a document with a smaller id;
    windows are judged on the texts as given. ``spans`` are the maximal runs of removed words, and
    ``kept`` the other words joined by single blanks; with ``rejoin`` false a text that loses nothing is
    returned unchanged. ``rest`` is a struct of the columns named in ``carry``. Words are parted by ASCII
    white space. Null texts have no words and come back empty. A null id counts as larger than any other
    (as 2**63 - 1 does); rows with equal ids take nothing from each other. Ids of other types are cast to
    long, and one that is not a whole number raises. Windows are compared by their words.
    """
    carried = F.struct(*carry) if carry else F.struct(F.lit(True).alias("none"))
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), carried.alias("rest"))
    rest = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema["rest"].dataType])
    rest_type = to_arrow_type(rest)
    size = rows.agg(F.sum(byte_length("text"))).first()[0] or 0
    shards = 1 << max(2, (size // shard_bytes).bit_length())
    blocks = cut(
        rows.mapInArrow(
            _anchors(shards, length, rest_type),
            T.StructType(
                [
                    T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())),
                    T.StructField("texts", T.BinaryType()), T.StructField("rest", T.ArrayType(rest)),
                    T.StructField("anchors", T.ArrayType(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("hashes", T.BinaryType()), T.StructField("several", T.BinaryType()), T.StructField("places", T.BinaryType())]))),
                ]
            ),
        )
    )
    answer = "block long, shard int, told binary"
    shared = cut(
        blocks.select("block", F.explode("anchors").alias("a")).select("block", "a.*").groupBy("shard").applyInArrow(_shared_anchors(HOT_PLACES), answer)
    )
    # Both uses of this join share one shuffle of the blocks.
    informed = blocks.drop("anchors").join(by_block(shared, "shard", "told", into="shared"), "block", "left")
    earlier = (
        informed.select("block", "doc_ids", "sizes", "texts", "shared")
        .mapInArrow(_bring_seeds(shards, length), "shard int, block long, routes binary, vocabulary binary, words binary, base long, firsts binary")
        .groupBy("shard")
        .applyInArrow(_extend(length), answer)
    )
    spans = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("words", T.LongType())]))
    found = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_removed")] + [T.StructField("kept", T.StringType()), T.StructField("spans", spans), T.StructField("rest", rest)]
    )
    return informed.join(by_block(earlier, "shard", "told", into="earlier"), "block", "left").mapInArrow(_remove(length, rejoin, rest_type), found)
