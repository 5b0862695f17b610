"""Evaluation and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wilson(rows: DataFrame, keys: list[str], success: str, z: float = 1.96) -> DataFrame:
    """Success rate with its Wilson interval."""
    n, p = F.col("n"), F.col("rate")
    mid, half, base = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    out = rows.groupBy(*keys).agg(F.count(success).alias("n"), F.sum(F.col(success).cast("int")).alias("k")).withColumn("rate", F.when(n > 0, F.col("k") / n).otherwise(0.0))
    return out.withColumn("low", F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / base)).otherwise(0.0)).withColumn("high", F.when(n > 0, F.least(F.lit(1.0), (mid + half) / base)).otherwise(0.0))


def failure_summary(rows: DataFrame, keys: list[str], success: str, phase: str, order: str) -> DataFrame:
    """Success rate, number of failures and the most frequent failure phase, ties to the one seen first. See ``failures_by_phase`` and ``recovery``."""
    rate = rows.groupBy(*keys).agg(F.avg(F.col(success).cast("int")).alias("success_rate"), F.count_if(~F.col(success)).alias("n_failed"))
    failed = rows.where(~F.col(success)).groupBy(*keys, phase).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = failed.groupBy(*keys).agg(F.min_by(phase, F.struct((-F.col("n")).alias("n"), "first")).alias("top_failure"))
    return rate.join(top, keys, "left")


def failures_by_phase(rows: DataFrame, keys: list[str], success: str, phase: str) -> DataFrame:
    """Failures of each phase."""
    return rows.where(~F.col(success)).groupBy(*keys, phase).agg(F.count("*").alias("n"))


def recovery(rows: DataFrame, keys: list[str], recovered: str) -> DataFrame:
    """Corrupted runs and the share that recovered; 0 where there are none."""
    return rows.groupBy(*keys).agg(F.count(recovered).alias("n_corrupted"), F.coalesce(F.avg(F.col(recovered).cast("int")), F.lit(0.0)).alias("recovery_rate"))


def matched(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Rows with ``match``; null where there is no label (null or -1)."""
    return rows.withColumn("match", F.when(F.col(label) >= 0, F.col(label) == F.col(predicted)))


def agreement(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """The confusion matrix with each cell's share of its label. The list of transitions is ``control.phase_changes``."""
    n = rows.groupBy(label, predicted).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def progress(points: DataFrame, key: str, goal: int) -> DataFrame:
    """(key, step, t): steps a second between the last two points, percent and hours left."""
    w = Window.partitionBy(key).orderBy(F.desc("step"))
    last = points.withColumn("__k", F.row_number().over(w)).withColumn("prev_step", F.lead("step").over(w)).withColumn("prev_t", F.lead("t").over(w)).where("__k = 1")
    rate = (F.col("step") - F.col("prev_step")) / (F.col("t") - F.col("prev_t"))
    return last.withColumn("rate", F.when(F.col("t") > F.col("prev_t"), rate)).select(key, "step", "rate", (100.0 * F.col("step") / goal).alias("percent"), ((goal - F.col("step")) / F.col("rate") / 3600).alias("hours_left"))


# What a log's errors are known by, and the line that ends a traceback's block.
TRACEBACK = "Traceback (most recent call last):"
ERROR_WORDS = "(?i)(error|exception|traceback|killed|oom|cuda)"
SEPARATOR = "=" * 65


def log_errors(lines: DataFrame, key: str = "path", most_matches: int = 40, most_lines: int = 200) -> DataFrame:
    """lines (key, pos, line) of each log that tell of its failure: from the last traceback (anywhere in its line) up to the next separator, else the last lines with an error word, else its tail."""
    w = Window.partitionBy(key).orderBy(F.desc("pos"))
    whole = Window.partitionBy(key)
    block_start = F.max(F.when(F.col("line").contains(TRACEBACK), F.col("pos"))).over(whole)
    marked = lines.withColumn("tb", block_start).withColumn("is_error", F.col("line").rlike(ERROR_WORDS))
    stop = F.min(F.when((F.col("pos") > F.col("tb")) & F.col("line").startswith(SEPARATOR), F.col("pos"))).over(whole)
    marked = marked.withColumn("stop", stop).withColumn("any_error", F.max("is_error").over(whole))
    in_block = (F.col("pos") >= F.col("tb")) & (F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
    errors = F.col("is_error") & (F.sum(F.col("is_error").cast("int")).over(w) <= most_matches)
    chosen = F.when(F.col("tb").isNotNull(), in_block).when(F.col("any_error"), errors).otherwise(F.row_number().over(w) <= most_lines)
    return marked.withColumn("chosen", chosen).where("chosen").select(key, "pos", "line")


def catalogue(datasets: DataFrame, labelled: DataFrame) -> DataFrame:
    """Episodes and labelled episodes of each dataset."""
    a = datasets.groupBy("dataset").agg(F.count("*").alias("episodes"))
    b = labelled.groupBy(F.col("dataset").alias("d")).agg(F.countDistinct("episode").alias("labelled"))
    return a.join(b, F.col("dataset") == F.col("d"), "left").select("dataset", "episodes", F.coalesce("labelled", F.lit(0)).alias("labelled"))
