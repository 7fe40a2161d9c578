"""JSON arrays of any size: one file is read by as many tasks as it has splits, and imported in steps that can be taken up again.

Spark's text reader cuts a file at every closing brace, in parallel, whatever is around it. Whether a cut lies in a
string, and how deep, is known only from what stands before, so it is worked out in two passes. The first tells for
each split, for either case at its start, how the split changes the state and how many elements open in it; a file's
splits are then walked through, a row each. The second pass starts every split in its state and gives out elements
with their numbers; only an element that lies across splits is put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING_REST = re.compile(r"(?:[^\"\\]|\\.)*", re.DOTALL)
_TOKEN = re.compile(r"\"(?:[^\"\\]|\\.)*(\"?)|[{}\[\]]", re.DOTALL)


def _brackets(text: str, inside: bool) -> Iterator[tuple[int, str]]:
    """(place, bracket) outside of strings, and at the end (length, '"') if a string is still open."""
    at = 0
    if inside:
        at = _STRING_REST.match(text).end()
        if at == len(text):
            yield at, '"'
            return
        at += 1
    for m in _TOKEN.finditer(text, at):
        c = m[0][0]
        if c != '"':
            yield m.start(), c
        elif not m[1]:
            yield len(text), '"'


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, start, text, ...) of the pieces, each with the brace that it was cut at."""
    for b in batches:
        for value, file, start, *rest in zip(*(c.to_pylist() for c in b.columns)):
            yield (file, start, value + "}", *rest)


_SUMMARY = "file string, start long, inside boolean, ends_inside boolean, deeper long, depths array<long>, opened array<long>"
_SUMMARY_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("ends_inside", pa.bool_()), ("deeper", pa.int64()), ("depths", pa.list_(pa.int64())), ("opened", pa.list_(pa.int64()))])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, states = None, {}

    def told() -> pa.RecordBatch:
        rows = [{"file": split[0], "start": split[1], "inside": k, "ends_inside": s[0], "deeper": s[1], "depths": list(s[2]), "opened": list(s[2].values())} for k, s in states.items()]
        return pa.RecordBatch.from_pylist(rows, schema=_SUMMARY_ARROW)

    for file, start, text in _splits(batches):
        if (file, start) != split:
            if split:
                yield told()
            split, states = (file, start), {k: [k, 0, {}] for k in (False, True)}
        for s in states.values():
            inside, depth, opened = s
            s[0] = False
            for _, c in _brackets(text, inside):
                if c == '"':
                    s[0] = True
                elif c in "{[":
                    if c == "{":
                        opened[depth] = opened.get(depth, 0) + 1
                    depth += 1
                else:
                    depth -= 1
            s[1] = depth
    if split:
        yield told()


_STARTS = "file string, start long, inside boolean, depth long, element long"
_STARTS_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()), ("element", pa.int64())])


def _starts(table: pa.Table) -> pa.Table:
    """The state in which each split of a file begins, and the number of the first element that opens in it."""
    by = {(r["start"], r["inside"]): r for r in table.to_pylist()}
    out, inside, depth, element = [], False, 0, 0
    for start in sorted({s for s, _ in by}):
        r = by[start, inside]
        out.append({"file": r["file"], "start": start, "inside": inside, "depth": depth, "element": element})
        element += dict(zip(r["depths"], r["opened"])).get(1 - depth, 0)
        inside, depth = r["ends_inside"], depth + r["deeper"]
    return pa.Table.from_pylist(out, schema=_STARTS_ARROW)


_PIECES = "file string, element long, start long, whole boolean, text string"
_PIECES_ARROW = pa.schema([("file", pa.string()), ("element", pa.int64()), ("start", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements, and the pieces of those that begin in an earlier split or go on in the next."""
    split, rows, held = None, [], []

    def cut_off() -> None:
        if held and depth > 1:
            rows.append((*split_key, element, split[1], False, "".join(held)))

    for file, start, text, begins_inside, begins_depth, begins_element in _splits(batches):
        if begins_depth is None:
            raise ValueError(f"{file} was cut at {start} in one pass only")
        if (file, start) != split:
            if split:
                cut_off()
            split, split_key = (file, start), (file,)
            inside, depth, element, held = begins_inside, begins_depth, begins_element - 1, []
            whole = False  # what is read first belongs to an element of an earlier split
        at, was_inside, inside = 0, inside, False
        for place, c in _brackets(text, was_inside):
            if c == '"':
                inside = True
            elif c in "{[":
                if c == "{" and depth == 1:
                    element, held, at, whole = element + 1, [], place, True
                depth += 1
            else:
                depth -= 1
                if c == "}" and depth == 1:
                    rows.append((file, element, start, whole, "".join(held) + text[at : place + 1]))
                    held, at = [], place + 1
        if depth > 1:
            held.append(text[at:])
        if len(rows) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES_ARROW)], schema=_PIECES_ARROW)
            rows.clear()
    if split:
        cut_off()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES_ARROW)], schema=_PIECES_ARROW)


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element, text): the objects in the top-level arrays of JSON files, numbered from 0 in each file.

    Other values in the arrays, and files that hold no array, give nothing; the elements are objects. A file is cut by
    spark.sql.files.maxPartitionBytes; the table of states has a row for each split and is broadcast.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    starts = pieces.mapInArrow(_summaries, _SUMMARY).groupBy("file").applyInArrow(_starts, _STARTS)
    begun = starts.select(F.col("file").alias("_file"), F.col("start").alias("_start"), "inside", "depth", F.col("element").alias("first"))
    # A broadcast join leaves the pieces in the order of the file.
    states = pieces.join(F.broadcast(begun), (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")), "left").select("value", "file", "start", "inside", "depth", "first")
    found = states.mapInArrow(_elements, _PIECES)
    across = found.where("NOT whole").groupBy("file", "element").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))
    return found.where("whole").select("file", "element", "text").unionByName(across)


def read_objects(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The elements of JSON arrays as columns, null where an object lacks a field or cannot be read."""
    return array_elements(spark, path).select(F.from_json("text", schema).alias("r")).select("r.*")


# ---- imports in steps

_PROGRESS = "step long, rows long"


def _told(spark: SparkSession, folder: str) -> dict[int, int]:
    try:
        return {r.step: r.rows for r in spark.read.schema(_PROGRESS).parquet(f"{folder}/progress").collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}


def _tell(spark: SparkSession, folder: str, step: int, rows: int) -> None:
    spark.createDataFrame([(step, rows)], _PROGRESS).coalesce(1).write.mode("append").parquet(f"{folder}/progress")


def import_in_steps(elements: DataFrame, folder: str, per_step: int, take: Callable[[DataFrame, int], None]) -> int:
    """Hand ``elements`` (file, element, ...) to ``take`` step by step, ``per_step`` of each file at a time; the number of steps taken.

    The elements are kept in ``folder`` by step, so a step reads its own and nothing else. A step is done once its row
    of progress is written, after ``take`` has returned. Called again with the same folder, after a failure or a stop,
    it goes on with the first step that is not done; that one may have been taken in part, so ``take`` must bear
    seeing rows again, as an ingest does.
    """
    spark = elements.sparkSession
    done = _told(spark, folder)
    staged = f"{folder}/staged"
    if -1 not in done:
        elements.withColumn("step", F.floor(F.col("element") / per_step)).write.mode("overwrite").partitionBy("step").parquet(staged)
        steps = elements.sparkSession.read.parquet(staged).agg(F.max("step")).first()[0] if not elements.isEmpty() else None
        _tell(spark, folder, -1, 0 if steps is None else steps + 1)
        done = _told(spark, folder)
    taken = 0
    for step in range(done[-1]):
        if step not in done:
            rows = spark.read.parquet(staged).where(F.col("step") == step).drop("step")
            take(rows, step)
            _tell(spark, folder, step, rows.count())
            taken += 1
    return taken
