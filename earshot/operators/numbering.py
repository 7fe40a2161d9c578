"""Gapless numbers over a whole table without gathering it in one task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session may leave it unset, as tests do."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "earshot-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a table in the shared folder.

    A checkpoint carries the estimated size of its plan along, and the estimate of a join is a product: over a few
    dozen of them it has millions of digits, and plans take minutes. A table is as large as its files, which also
    tells the joins that read it which side is small.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, into: str = "n") -> DataFrame:
    """``df`` with numbers from 1 in the order given; equal rows are numbered in any order.

    Rows are dealt by range and numbered within a range; the ranges' sizes, a row each, are summed up to
    where a range begins. The dealt rows go to the checkpoint folder, so that both uses see the same ranges.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(width, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_at", at).join(F.broadcast(starts), "_range").withColumn(into, (F.col("_start") + F.col("_at")).cast("long")).drop("_range", "_at", "_start")
