"""Jump consistent hashing: stable keys to shards without a ring table, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, free_name, shuffle_width

#: Fixed value: multiplier of the published jump hash's linear congruential generator (increment 1).
MULTIPLIER = 2862933555777941757
MASK = (1 << 32) - 1
#: Jumps at most; the mean is ln(shards) + 1, so even 2**31 shards stay far below. Never silently cut.
MAX_JUMPS = 512


def _next(hi: str, lo: str) -> str:
    """SQL for (hi, lo) of ``MULTIPLIER * key + 1`` modulo 2**64 from 32-bit halves.

    The halves are multiplied in 16-bit parts, as ANSI arithmetic refuses to wrap around.
    """
    a_hi, a_lo = MULTIPLIER >> 32, MULTIPLIER & MASK
    x, y = f"(shiftright({lo}, 16) * {a_lo}L)", f"(({lo} & 65535L) * {a_lo}L)"
    low = f"({y} + shiftleft({x} & 65535L, 16) + 1L)"
    own = f"(({hi} & 65535L) * {a_lo}L + shiftleft((shiftright({hi}, 16) * {a_lo}L) & 65535L, 16))"
    high = f"((shiftright({x}, 16) + shiftright({low}, 32) + {own} + {lo} * {a_hi}L) & {MASK}L)"
    return f"named_struct('hi', {high}, 'lo', {low} & {MASK}L"


def _target(s: str) -> str:
    """SQL for the shard that the state ``s`` would jump to next."""
    return f"cast(floor(({s}.b + 1L) * (2147483648D / (shiftright({s}.hi, 1) + 1L))) as long)"


def jump_sql(key: str, shards: int) -> str:
    """SQL for struct (shard, grown): the shard of ``key`` (struct hi, lo) among ``shards`` and one more."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    first = f"transform(array({key}), h -> {_next('h.hi', 'h.lo')}, 'b', 0L))[0]"
    step = f"if({_target('s')} >= {shards}L, s, {_next('s.hi', 's.lo')}, 'b', {_target('s')}))"
    found = (
        f"if({_target('s')} < {shards}L, raise_error('jump hash did not settle'), named_struct('shard', "
        f"cast(s.b as int), 'grown', cast(if({_target('s')} = {shards}L, {shards}L, s.b) as int)))"
    )
    return f"aggregate(sequence(1, {min(shards, MAX_JUMPS)}), {first}, (s, i) -> {step}, s -> {found})"


def shard(docs: DataFrame, shards: int, *, id_col: str = "doc_id", into: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """``docs`` with its shard, and the shard it would have with one shard more.

    An integer id is the key itself; any other type is hashed first. Rows with a null id go where key 0
    goes. Equal ids always share a shard. Adding a shard moves rows only into the new one. Columns of ``docs``
    that are named ``into`` or ``grown`` are replaced; all others are kept.
    """
    kind = docs.schema[id_col].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    key = F.col(id_col).cast("long") if whole else F.xxhash64(id_col)
    key = F.coalesce(F.when(F.col(id_col).isNotNull(), key), F.lit(0).cast("long"))
    halves = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK)).alias("lo"))
    key_name, jump = free_name("_key", docs), free_name("_jump", docs)
    out = docs.withColumn(key_name, halves).withColumn(jump, F.expr(jump_sql(key_name, shards)))
    return out.withColumns({into: F.col(jump)["shard"], grown: F.col(jump)["grown"]}).drop(key_name, jump)


def with_slots(sharded: DataFrame, *, order: list[str], shard_col: str = "shard", into: str = "slot") -> DataFrame:
    """Gapless positions from 0 within each shard in the order of ``order``, without a whole shard in one task.

    The rows are dealt by range of ``order``; rows are numbered inside each piece of a shard that a range
    holds, and the sizes of the pieces, a small table, are summed up to each piece's first position.
    Rows equal in all of ``order`` are numbered in any order; nulls come first. A column named ``into`` is
    replaced (it may still be one to order by); all others are kept.
    """
    part, first, at = (free_name(n, sharded) for n in ("_range", "_first", "_at"))
    ranged = cut(sharded.repartitionByRange(shuffle_width(sharded.sparkSession), *order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(shard_col, part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard_col).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(shard_col, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    within = Window.partitionBy(shard_col, part).orderBy(*order)
    numbered = ranged.withColumn(at, F.row_number().over(within) - 1)
    placed = numbered.join(firsts, [shard_col, part]).withColumn(into, (F.col(first) + F.col(at)).cast("long")).drop(part, first, at)
    return placed.select(*dict.fromkeys([*sharded.columns, into]))
