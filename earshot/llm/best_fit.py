"""Packing documents into as few windows as they fit in: best fit where they are read, then a local search by swaps.

A block of texts is tokenised and packed by best fit where it is read; bins that are full are done. The others go,
as lengths only, into groups of about a thousand bins. In a group the emptiest bin is emptied: documents move into
gaps, or change places one for one or two for one with documents of other bins, so that these grow. Each step
raises the sum of the squared fills, so the search ends. What no step improves is done, but for a group's emptiest
bins, which meet those of other groups, level by level, until one group is left.

No group grows with the data, and no step makes a bin, so the bins of the blocks are the sequences' numbers. Tokens
stay in their blocks: only a bin and a place in it are sent back to the block for each piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batched, give_back
from .common import cut, in_small_batches
from .packing import WordTokenizer

END_ID = 1
BLOCK_BYTES = 6 << 20
#: Bins of a group; the emptiest bins of each that go on; groups whose bins then meet.
GROUP_BINS, CARRIED, FAN_IN = 1024, 32, 32
#: Documents of the bin that is emptied which exchanges look at, the longest first; they bound a step's work, not its result.
LOOKED_AT, PAIRED = 32, 12
#: Documents of other bins that are weighed at once.
AT_ONCE = 4096
#: A search ends after as many bins in a row that could not be emptied.
GIVE_UP = 24


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each length, the longest placed first, each in the fullest bin that has room."""
    bins = np.zeros(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(size + 1)]
    some = count = 0  # bit r of ``some``: a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                some ^= 1 << room
        else:
            room, at, count = size, count, count + 1
        bins[i] = at
        if room > n:
            with_room[room - n].append(at)
            some |= 1 << (room - n)
    return bins


def swap_search(lengths: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """Bins of the documents after moves and exchanges; ``bins`` numbers them from 0, and emptied ones hold nothing."""
    bins = bins.copy()
    fill = np.bincount(bins, lengths).astype(np.int64)
    least, left = -(-int(lengths.sum()) // size), int((fill > 0).sum())
    open_bins, failed = set(np.flatnonzero(fill < size).tolist()), 0
    tried: set[int] = set()
    while left > least and failed < GIVE_UP:
        donors = [b for b in open_bins if b not in tried and 0 < fill[b] < size]
        if not donors:
            break
        donor = min(donors, key=lambda b: (fill[b], b))
        moved = False
        while fill[donor] and _step(lengths, bins, fill, donor, size):
            moved = True
        if moved:
            tried.clear()  # what was in the way may be gone
        tried.add(donor)
        if fill[donor]:
            failed += 1
        else:
            left, failed = left - 1, 0
    return bins


def _step(lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, donor: int, size: int) -> bool:
    """One move or exchange that takes from the donor and raises the sum of the squared fills, if there is any."""
    own = np.flatnonzero(bins == donor)
    own = own[np.argsort(-lengths[own], kind="stable")]
    room = np.where((fill > 0) & (np.arange(len(fill)) != donor), size - fill, 0)
    for x in own:
        n = lengths[x]
        fits = np.flatnonzero((room >= n) & (fill + n > fill[donor]))
        if len(fits):
            _move(lengths, bins, fill, x, int(fits[np.argmin(room[fits])]))
            return True
    long = own[:LOOKED_AT]
    pairs = [(a, b) for i, a in enumerate(own[:PAIRED]) for b in own[i + 1 : PAIRED]]
    give = np.concatenate([lengths[long], np.array([lengths[a] + lengths[b] for a, b in pairs], np.int64)])
    every = np.flatnonzero(room[bins] > 0)
    every = every[np.argsort(-room[bins[every]], kind="stable")]  # the most room first: there an exchange can take most
    for a in range(0, len(every), AT_ONCE):
        others = every[a : a + AT_ONCE]
        gap, above = room[bins[others]], fill[bins[others]] - fill[donor]
        gain = give[:, None] - lengths[others][None, :]
        gain[(gain <= 0) | (gain > gap) | (gain + above <= 0)] = 0
        g, y = divmod(int(gain.argmax()), len(others))
        if gain[g, y]:
            taken, into = others[y], int(bins[others[y]])
            _move(lengths, bins, fill, taken, donor)
            for x in (long[g],) if g < len(long) else pairs[g - len(long)]:
                _move(lengths, bins, fill, x, into)
            return True
    return False


def _move(lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, item: int, into: int) -> None:
    fill[bins[item]] -= lengths[item]
    fill[into] += lengths[item]
    bins[item] = into


_BLOCK_SQL = "block long, doc_ids array<long>, counts array<long>, bins array<long>, tokens binary, wide boolean"
_BLOCK = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("bins", pa.list_(pa.int64())), ("tokens", pa.binary()), ("wide", pa.bool_())]
)


def pieces_of(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, number in it, length) of the pieces of documents of so many tokens: whole windows first, then the rest."""
    many = -(-counts // size)
    doc = np.repeat(np.arange(len(counts)), many)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    return doc, number, np.minimum(size, counts[doc] - number * size)


def _tokenise(path: str | None, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = WordTokenizer.of(path), zstandard.ZstdCompressor(1)
        part = TaskContext.get().partitionId()
        for seq, (ids, texts) in enumerate(batched(batches, BLOCK_BYTES)):
            tokens, counts = tokenizer.texts([t or "" for t in texts], end)
            bins = best_fit(pieces_of(counts, size)[2], size)
            wide = bool(tokens.max(initial=0) >= 65536)
            blob = packer.compress(tokens.astype("<u4" if wide else "<u2").tobytes())
            columns = [pa.array([(part << 32) + seq]), *(pa.array([x], pa.list_(pa.int64())) for x in (ids, counts, bins)), pa.array([blob]), pa.array([wide])]
            yield pa.RecordBatch.from_arrays(columns, schema=_BLOCK)
            give_back()

    return run


_LISTS = ("blocks", "pieces", "lengths", "offsets")
_BINS_SQL = "sequence_id long, blocks array<long>, pieces array<long>, lengths array<long>, offsets array<long>, more boolean"
_BINS = pa.schema([("sequence_id", pa.int64()), *((c, pa.list_(pa.int64())) for c in _LISTS), ("more", pa.bool_())])


def _bins_of(ids: np.ndarray, blocks: np.ndarray, pieces: np.ndarray, lengths: np.ndarray, bins: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bin that holds something: ``ids`` and ``more`` by bin, the rest by piece."""
    order = np.argsort(bins, kind="stable")
    held, first = np.unique(bins[order], return_index=True)
    offsets = np.append(first, len(order)).astype(np.int32)
    before = np.cumsum(lengths[order]) - lengths[order]
    places = before - np.repeat(before[first], np.diff(offsets))
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (blocks[order], pieces[order], lengths[order], places)]
    yield pa.RecordBatch.from_arrays([pa.array(ids[held]), *lists, pa.array(more[held])], schema=_BINS)


def _block_bins(size: int):
    """The bins of the blocks; ``more`` marks those that are not full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, counts, bins in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                bins = bins.values.to_numpy()
                lengths = pieces_of(counts.values.to_numpy(), size)[2]
                fill = np.bincount(bins, lengths).astype(np.int64)
                # Blocks are numbered within a task, bins within a block.
                ids = ((block >> 32) << 42) + ((block & 0xFFFFFFFF) << 20) + np.arange(len(fill))
                yield from _bins_of(ids, np.full(len(bins), block), np.arange(len(bins)), lengths, bins, fill < size)

    return run


def _search(size: int, last: bool):
    """A group's bins after the search; ``more`` marks the emptiest, which go on unless this is the last level."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("sequence_id")
        if not table.num_rows:
            return _BINS.empty_table()
        ids = table.column("sequence_id").to_numpy()
        lists = [table.column(c).combine_chunks() for c in ("blocks", "pieces", "lengths")]
        bins = np.repeat(np.arange(len(ids)), np.diff(lists[0].offsets.to_numpy()))
        blocks, pieces, lengths = (x.flatten().to_numpy() for x in lists)
        bins = swap_search(lengths, bins, size)
        fill = np.bincount(bins, lengths, len(ids)).astype(np.int64)
        more = np.zeros(len(ids), bool)
        if not last:
            open_bins = np.flatnonzero((fill > 0) & (fill < size))
            more[open_bins[np.argsort(fill[open_bins], kind="stable")[:CARRIED]]] = True
        return pa.Table.from_batches(_bins_of(ids, blocks, pieces, lengths, bins, more))

    return run


_PIECES_SQL = "doc_id long, piece int, start long, length long, doc_tokens long, sequence_id long, offset long, block long, row long, ids binary"
_PIECES_NAMES = ["doc_id", "piece", "start", "length", "doc_tokens", "sequence_id", "offset", "block", "row", "ids"]


def _emit(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in range(batch.num_rows):
                block, ids, counts, tokens, wide, placed = (batch.column(c)[r] for c in range(6))
                counts = counts.values.to_numpy()
                doc, number, length = pieces_of(counts, size)
                flat = np.frombuffer(unpack.decompress(tokens.as_buffer()), "<u4" if wide.as_py() else "<u2").astype("<u4")
                where = [placed.values.field(c).to_numpy() for c in range(3)]
                order = np.argsort(where[0])
                sequence, offset = where[1][order], where[2][order]
                edges = np.append(0, np.cumsum(length)) * 4
                for a in range(0, len(doc), 4096):
                    b = min(len(doc), a + 4096)
                    blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((edges[a : b + 1] - edges[a]).astype("<i4")), pa.py_buffer(flat[edges[a] // 4 : edges[b] // 4])])
                    d = doc[a:b]
                    numbers = (number[a:b].astype(np.int32), number[a:b] * size, length[a:b], counts[d], sequence[a:b], offset[a:b], np.full(b - a, block.as_py()), d)
                    yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(d)), *map(pa.array, numbers), blob], _PIECES_NAMES)
                give_back()

    return run


def pack_best_fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces (doc_id, piece, start, length, doc_tokens, sequence_id, offset, block, row, ids) in as few windows as the search finds.

    A document is its text's token ids and ``end_id``. Only documents longer than ``window`` are cut, into pieces of
    that length and a shorter rest. ``ids`` holds a piece's ids as little-endian unsigned 32-bit integers; sequences
    are numbered with gaps, places within them without. Null or empty texts are the end id alone; repeated rows are
    packed each, ``block`` and ``row`` tell them apart; an empty table gives no piece. Ids are cast to long; one that
    is not a whole number raises. Other columns are not read. A text is tokenised as a whole, however long, so a
    block is as large as its largest text.
    """
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = cut(rows.mapInArrow(_tokenise(tokenizer_path, end_id, window), _BLOCK_SQL))
    bins = cut(blocks.select("block", "counts", "bins").mapInArrow(_block_bins(window), _BINS_SQL))
    done, going = [bins.where("NOT more")], bins.where("more")
    groups = -(-going.count() // GROUP_BINS)
    while groups:
        searched = going.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).applyInArrow(_search(window, groups == 1), _BINS_SQL)
        searched = cut(searched)
        done.append(searched.where("NOT more"))
        going, groups = searched.where("more"), -(-groups // FAN_IN) if groups > 1 else 0
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    items = every.select("sequence_id", F.inline(F.arrays_zip("blocks", "pieces", "offsets")))
    placed = items.groupBy(F.col("blocks").alias("block")).agg(F.collect_list(F.struct("pieces", "sequence_id", "offsets")).alias("placed"))
    return blocks.join(placed, "block").select("block", "doc_ids", "counts", "tokens", "wide", "placed").mapInArrow(_emit(window), _PIECES_SQL)
