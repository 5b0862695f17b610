"""Rows within intervals, by bucketed equi-joins: a row meets the intervals that touch its bucket, not all of its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(rows: DataFrame, intervals: DataFrame, key: str, time: str, bucket: float, inside: Column, start: str, end: str, how: str = "inner") -> DataFrame:
    """``rows`` (key, time, ...) with the ``intervals`` (__k, start, end, ...) of their key for which ``inside`` holds.

    Each interval goes to the buckets of width ``bucket`` that it touches, so the buckets should be about as wide as an interval is long. An
    interval without an end meets all rows of its key from its start on: there should be few of these. Rows without a time, and intervals without a
    start or with the end before it, meet nothing. With ``how`` left, rows that meet nothing stay, and intervals without an end are left out.
    """
    numbers = F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))
    closed = intervals.where(F.col(end) >= F.col(start)).withColumn("__b", F.explode(numbers))
    dealt = rows.withColumn("__at", F.floor(F.col(time) / bucket))
    met = dealt.join(closed.hint("merge"), (F.col(key) == F.col("__k")) & (F.col("__at") == F.col("__b")) & inside, how).drop("__b", "__at")
    if how != "inner":
        return met
    endless = intervals.where(F.col(end).isNull())
    return met.unionByName(rows.join(endless.hint("merge"), (F.col(key) == F.col("__k")) & inside))
