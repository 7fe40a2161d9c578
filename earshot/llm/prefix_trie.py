"""The prefix trie of conversations that branch off others, merged family by family before it is merged as a whole.

A family is a base conversation and those that were branched off it. Its turns are brought together by the base's
id and read in order, so that a task needs the base's opening turns, the present conversation's place and the
family's nodes, and no texts beside these. Only the family's nodes, each once with its members counted, are
shuffled for the merge over all families.

The rest needs no walk over the merged trie. A node belongs to its smallest member, and so to one family; what is
summed over a subtree is put at the nodes by the families that they belong to, summed up within each family's own
trie, and added up over the families that a node occurs in.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_small_batches

FAMILY, OPENING = 20, 4
#: Families whose end lists are joined in one row before a node's digest is made.
LISTS = 256
#: Nodes with more children than this, and than one part in CROWDED_SHARE of all nodes, are joined by broadcast: there are at most CROWDED_SHARE.
CROWDED, CROWDED_SHARE = 1000, 10_000
#: Rows of a batch that a task hands back.
ROWS_OUT = 4096

_NODES = "base long, key binary, parent binary, depth long, first long, members long, words long, ends string"
_NODES_ARROW = pa.schema(
    [
        ("base", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()),
        ("first", pa.int64()), ("members", pa.int64()), ("words", pa.int64()), ("ends", pa.string()),
    ]
)


class _Family:
    """Nodes of one family: key to [parent, depth, smallest member, members, words of the last text, conversations that end here]."""

    def __init__(self, base: int, opening: int):
        self.base, self.opening = base, opening
        self.nodes: dict[bytes, list] = {}
        self.first_turns: list[tuple[bytes, bytes]] = []
        self.conv: int | None = None

    def turn(self, conv: int, role: bytes, text: bytes) -> None:
        """The next turn: the base's come first, then conversation by conversation."""
        if conv != self.conv:
            self.end()
            self.conv, self.key, self.depth, self.seen = conv, b"", 0, 0
            self._enter(b"", None, 0)
            self.shared = 0 if conv == self.base else zlib.crc32(str(conv).encode()) % self.opening
            for turn in self.first_turns[: self.shared]:
                self._step(*turn)
        if conv == self.base and len(self.first_turns) < self.opening - 1:
            self.first_turns.append((role, text))
        self.seen += 1
        if self.seen > self.shared:
            self._step(role, text)

    def _step(self, role: bytes, text: bytes) -> None:
        parent = self.key
        self.key = hashlib.sha256(parent + len(role).to_bytes(8, "little") + role + text).digest()
        self.depth += 1
        self._enter(self.key, parent, len(text.split()))

    def _enter(self, key: bytes, parent: bytes | None, words: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            self.nodes[key] = [parent, self.depth, self.conv, 1, words, []]
        else:
            node[2] = min(node[2], self.conv)
            node[3] += 1

    def end(self) -> None:
        if self.conv is not None:
            self.nodes[self.key][5].append(self.conv)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _tries(opening: int):
    def told(family: _Family) -> Iterator[tuple]:
        family.end()
        for key, (parent, depth, first, members, words, ends) in family.nodes.items():
            yield family.base, key, parent, depth, first, members, words, ",".join(map(str, sorted(ends))) or None

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        family = None
        for base, conv, role, text in _rows(batches):
            if family is None or base != family.base:
                if family is not None:
                    yield from told(family)
                family = _Family(base, opening)
            family.turn(conv, role, text)
        if family is not None:
            yield from told(family)

    return lambda batches: _in_batches(nodes(batches), _NODES_ARROW)


_SUMS = "key binary, leaves long, saved long"
_SUMS_ARROW = pa.schema([("key", pa.binary()), ("leaves", pa.int64()), ("saved", pa.int64())])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over subtrees of a family's trie, whose nodes come deepest first; what waits is owed to the level above alone."""

    def sums() -> Iterator[tuple]:
        present, owed = None, {}
        for base, key, parent, leaf, saved in _rows(batches):
            if base != present:
                present, owed = base, {}
            leaves, tokens = owed.pop(key, (0, 0))
            leaves, tokens = leaves + leaf, tokens + saved
            yield key, leaves, tokens
            a, b = owed.get(parent, (0, 0))
            owed[parent] = (a + leaves, b + tokens)

    return _in_batches(sums(), _SUMS_ARROW)


_DIGESTS = "key binary, digest string"
_DIGESTS_ARROW = pa.schema([("key", pa.binary()), ("digest", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's lists, which come in order and are never held together."""

    def found() -> Iterator[tuple]:
        present, state = None, None
        for key, ends in _rows(batches):
            if key == present:
                state.update(b"," + ends.encode())
                continue
            if state is not None:
                yield present, state.hexdigest()
            present, state = key, hashlib.sha256(ends.encode())
        if state is not None:
            yield present, state.hexdigest()

    return _in_batches(found(), _DIGESTS_ARROW)


def prefix_trie(
    conversations: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    family: int = FAMILY,
    opening: int = OPENING,
) -> DataFrame:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key, parent_key) of the trie of rebuilt conversations.

    Conversation c takes its first h turns from its base c - c % ``family``, all if that has fewer and none if it is
    absent, and its own turns behind its first h; h is the unsigned crc32 of c in decimals, modulo ``opening``. A node
    is a distinct sequence of first turns (role, text); its members are the conversations that start with it, and
    (conv_id, depth) names it: the smallest member and its length. The root is the empty sequence. ``saved_tokens``
    is what a cache of prefixes saves in the subtree: for each node its members but one, times the words of its last
    text. ``ends_sha256`` digests the decimal ids of the conversations that end here.

    Turns are ordered by turn, null first, then by role and text, so repeated rows are turns of their own; null roles
    and texts are empty; rows without an id, which have no base, take no part; an empty table has no node, not even a
    root. Ids are cast to long, and one that is not a whole number raises. Other columns are not read.

    A conversation is not split over tasks, and a task holds its family's nodes (keys and counts, not texts). No node
    is a hot key, however many families share it: counts are summed before they are shuffled, a node's values go back
    to the one family that it belongs to, end lists are joined by ranges of ids first, and parents of very many
    children, of which there are at most CROWDED_SHARE, are broadcast.
    """
    conv = F.col(conv_col).cast("long")
    turns = in_small_batches(conversations).select(
        (conv - conv % family).alias("base"),
        conv.alias("conv"),
        F.col(turn_col).alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(n) for c, n in ((role_col, "role"), (text_col, "text"))),
    )
    ordered = turns.where("conv IS NOT NULL").repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.asc_nulls_first("turn"), "role", "text")
    nodes = cut(ordered.select("base", "conv", "role", "text").mapInArrow(_tries(opening), _NODES))

    same = (F.first(c).alias(c) for c in ("parent", "depth", "words"))  # equal wherever the node occurs
    merged = nodes.groupBy("key").agg(*same, F.min("first").alias("first"), F.sum("members").alias("n_convs"))
    children = nodes.where("parent IS NOT NULL").select("key", "parent").distinct().groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    merged = cut(merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    own = merged.select("key", "first", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    placed = nodes.select("base", "key", "parent", "depth", "first").join(own, ["key", "first"], "left")
    placed = placed.select("base", "depth", "key", "parent", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("leaf", "saved")))
    upward = placed.repartition("base").sortWithinPartitions("base", F.desc("depth")).select("base", "key", "parent", "leaf", "saved")
    sums = upward.mapInArrow(_subtrees, _SUMS).groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    lists = nodes.where("ends IS NOT NULL").groupBy("key", F.floor(F.col("base") / (family * LISTS)).alias("range")).agg(F.array_sort(F.collect_list(F.struct("base", "ends"))).alias("lists"))
    lists = lists.select("key", "range", F.array_join(F.col("lists.ends"), ",").alias("ends"))
    digests = lists.repartition("key").sortWithinPartitions("key", "range").select("key", "ends").mapInArrow(_digests, _DIGESTS)

    many = max(CROWDED, merged.count() // CROWDED_SHARE)
    parents = merged.select(F.col("key").alias("parent"), F.col("first").alias("parent_conv_id"), "n_children")
    crowded = F.broadcast(parents.where(F.col("n_children") > many).drop("n_children"))
    others = parents.where(F.col("n_children").between(1, many)).drop("n_children")
    below = merged.join(crowded, "parent").select(*merged.columns, "parent_conv_id")
    rest = merged.join(crowded.select("parent"), "parent", "left_anti").join(others, "parent", "left").select(*merged.columns, "parent_conv_id")
    return (
        below.unionByName(rest).join(sums, "key").join(digests, "key", "left")
        .select(
            F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "key", F.col("parent").alias("parent_key"),
        )
    )
