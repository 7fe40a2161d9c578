"""Time buckets as small tables that equi-join to days; their size is the length of the calendar, not of the data."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .timeframe import add, bucket_starts


def bucket_table(spark: SparkSession, start: datetime, stop: datetime, step: str) -> DataFrame:
    """(bucket)."""
    return spark.createDataFrame([(b,) for b in bucket_starts(start, stop, step)], "bucket timestamp_ntz")


def bucket_days(spark: SparkSession, start: datetime, stop: datetime, step: str) -> DataFrame:
    """(shifted_day, bucket): each day, as days are cut at the buckets' time of day, with its bucket."""
    rows = []
    for b in bucket_starts(start, stop, step):
        d, end = b.date(), add(b, step).date()
        while d < end:
            rows.append((d, b))
            d += timedelta(1)
    return spark.createDataFrame(rows, "shifted_day date, bucket timestamp_ntz")


def shifted_day(time: Column, start: datetime) -> Column:
    """The day that ``time`` falls on if days begin at the time of day of ``start``."""
    offset = start - start.replace(hour=0, minute=0, second=0, microsecond=0)
    return F.to_date(time.cast("timestamp_ntz") - F.lit(offset))
