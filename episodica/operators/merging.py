"""Merging datasets: shifted keys, one task registry, remapped files, merged statistics.

Where an earlier dataset comes first, ``order`` names the column that says which is earlier: by default the dataset's name, else the place that the user gives it (see ``in_order``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import scanned


def in_order(rows: DataFrame, datasets: list[str], place: str = "nth") -> DataFrame:
    """Rows of the ``datasets``, with the place of each in the given list; others go. A list is short: it is one literal of the plan."""
    at = F.array_position(F.array(*map(F.lit, datasets)), F.col("dataset"))
    return rows.withColumn(place, at - 1).where(F.col(place) >= 0)


def offsets(sizes: DataFrame, order: str = "dataset") -> DataFrame:
    """(dataset, n_episodes, n_frames) -> with the offsets that earlier datasets leave; one row a dataset, so one task suffices."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("dataset", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(o) for c, o in (("n_episodes", "episode_offset"), ("n_frames", "frame_offset"))])


def chunk_counts(sizes: DataFrame, per_chunk: int = 1000) -> DataFrame:
    """(dataset, n_episodes, ...) with ``n_chunks``, how many chunks of at most ``per_chunk`` episodes that makes; one at least."""
    return sizes.withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.col("n_episodes") / per_chunk)).cast("long"))


def output_indices(episodes: DataFrame, kept: str = "kept") -> DataFrame:
    """episodes (dataset, episode, kept) with ``output_index``, their number among the kept ones from 0; null for the others."""
    w = Window.partitionBy("dataset").orderBy("episode")
    return episodes.withColumn("output_index", F.when(F.col(kept), F.sum(F.col(kept).cast("long")).over(w) - 1))


def united(frames: DataFrame, shift: DataFrame) -> DataFrame:
    """H1: frames (dataset, episode_index, index, ...) with keys shifted by their dataset's offsets."""
    return _shifted(frames, shift, {"episode_index": "episode_offset", "index": "frame_offset"})


def united_episodes(episodes: DataFrame, shift: DataFrame) -> DataFrame:
    """H1: episode rows (dataset, episode_index, dataset_from_index, dataset_to_index, ...) with their keys shifted."""
    return _shifted(episodes, shift, {"episode_index": "episode_offset", "dataset_from_index": "frame_offset", "dataset_to_index": "frame_offset"})


def _shifted(rows: DataFrame, shift: DataFrame, by: dict[str, str]) -> DataFrame:
    """``shift`` has one row a dataset and goes to all tasks: a shuffle by dataset would put a dataset's rows into one."""
    s = F.broadcast(shift.select(F.col("dataset").alias("d"), "episode_offset", "frame_offset"))
    return rows.join(s, F.col("dataset") == F.col("d")).withColumns({c: F.col(c) + F.col(o) for c, o in by.items()}).drop("d", "episode_offset", "frame_offset")


def task_registry(tasks: DataFrame, order: str = "dataset") -> DataFrame:
    """H2: (dataset, task_index, task) -> (task, global_index) in the order first seen."""
    first = tasks.groupBy("task").agg(F.min(F.struct(order, "task_index")).alias("first"))
    return first.select("task", (F.row_number().over(Window.orderBy("first", "task")) - 1).alias("global_index"))


def synthetic_tasks(used: DataFrame, tasks: DataFrame, order: str = "dataset") -> DataFrame:
    """H3: names for task indices (dataset, task_index) that no task has, or that are null. Names of datasets stand for themselves, so they are unique."""
    known = tasks.select(F.col("dataset").alias("d"), F.col("task_index").alias("t"))
    missing = used.select(*dict.fromkeys(["dataset", order]), "task_index").distinct().join(known.hint("merge"), (F.col("dataset") == F.col("d")) & (F.col("task_index") == F.col("t")), "left_anti")
    return missing.withColumn("task", F.concat(F.lit("unknown task ("), F.col("dataset").cast("string"), F.lit(":"), F.coalesce(F.col("task_index").cast("string"), F.lit("null")), F.lit(")")))


def full_registry(registry: DataFrame, synthetic: DataFrame, order: str = "dataset") -> DataFrame:
    """H3: the registry (task, global_index) with the synthetic tasks after it, by dataset and index, nulls last; tasks are few, one row a task."""
    new = synthetic.join(registry.select("task").hint("merge"), "task", "left_anti").groupBy("task").agg(F.min(F.struct(order, F.col("task_index").isNull().alias("none"), "task_index")).alias("first"))
    n = registry.agg(F.count("*").alias("n"))
    placed = new.select("task", (F.row_number().over(Window.orderBy("first")) - 1).alias("k")).crossJoin(F.broadcast(n))  # one row
    return registry.select("task", F.col("global_index").cast("long").alias("global_index")).unionByName(placed.select("task", (F.col("k") + F.col("n")).alias("global_index")))


def remapped_tasks(frames: DataFrame, tasks: DataFrame, registry: DataFrame) -> DataFrame:
    """Frames with the global task index in place of the local one; one without a task is an error. ``tasks`` may hold synthetic ones, also for null indices."""
    local = tasks.join(registry.hint("merge"), "task").select(F.col("dataset").alias("d"), F.col("task_index").alias("t"), "global_index")
    out = frames.join(local.hint("merge"), (F.col("dataset") == F.col("d")) & F.col("task_index").eqNullSafe(F.col("t")), "left")
    return out.withColumn("task_index", F.coalesce("global_index", F.raise_error(F.lit("unknown task index")).cast("int"))).drop("d", "t", "global_index")


def remapped_files(files: DataFrame, order: str = "dataset", key: str | None = None) -> DataFrame:
    """Files (dataset, file_index) with gaps -> with ``global_file``, contiguous over datasets in order, for each video key of its own if ``key`` names one.

    A file's number among those of its dataset comes from a scan by blocks, and what earlier datasets have before it from a table of one row a dataset and key. An index that a dataset has twice is an error.
    """
    keys = [key] if key else []
    mine = scanned(files, [*keys, "dataset"], ["file_index"], 10_000, before={"__before": F.col("file_index")}, place="rank")
    twice = F.raise_error(F.format_string("duplicate file index %s", F.col("file_index").cast("string"))).cast(dict(files.dtypes)["file_index"])
    mine = mine.withColumn("file_index", F.when(F.col("__before") == F.col("file_index"), twice).otherwise(F.col("file_index"))).drop("__before")
    counts = files.groupBy(*keys, *dict.fromkeys(["dataset", order])).agg(F.count("*").alias("n"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(k).alias("__k") for k in keys], F.col("dataset").alias("__d"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__base"))
    on = F.col("dataset").eqNullSafe(F.col("__d"))
    on = on & F.col(key).eqNullSafe(F.col("__k")) if key else on
    out = mine.join(base.hint("merge"), on).withColumn("global_file", F.col("rank") + F.col("__base"))
    return out.drop("__d", "__k", "__base", "rank")


def remapped_file_columns(episodes: DataFrame, files: DataFrame, column: str | dict[str, str] = "file_index", key: str | None = None) -> DataFrame:
    """Episode rows with the global file index of ``remapped_files`` in place of the local one. ``column``: its name, or with ``key`` that of each video key.

    A file that isn't there is an error, as is a null; but a dataset that has no file of a key at all keeps its indices.
    """
    out = episodes
    for video, name in column.items() if isinstance(column, dict) else [(None, column)]:
        of = files if video is None else files.where(F.col(key) == video)
        m = of.select(F.col("dataset").alias("__d"), F.col("file_index").alias("__f"), "global_file")
        some = of.select(F.col("dataset").alias("__s")).distinct()
        met = out.join(m.hint("merge"), (F.col("dataset") == F.col("__d")) & (F.col(name) == F.col("__f")), "left").join(some.hint("merge"), F.col("dataset") == F.col("__s"), "left")
        missing = F.raise_error(F.format_string(f"{name} of %s names a file that isn't there: %s", F.col("dataset").cast("string"), F.col(name).cast("string"))).cast("long")
        out = met.withColumn(name, F.when(F.col("__s").isNull(), F.col(name)).otherwise(F.coalesce("global_file", missing)).cast("long")).drop("__d", "__f", "__s", "global_file")
    return out


def copy_manifest(files: DataFrame, key: str = "video_key") -> DataFrame:
    """Remapped files (dataset, video_key, path, global_file) -> (path, target): which file goes where in the merged dataset. The copying itself is not done here."""
    return files.select("path", F.format_string("videos/%s/chunk-000/file-%03d.mp4", F.col(key), F.col("global_file")).alias("target"))


def shape_mismatches(required: DataFrame, present: DataFrame, keys: list[str], shape: str = "shape") -> DataFrame:
    """(keys, wanted, found) of items that are there in another shape."""
    r = required.select(*keys, F.col(shape).alias("wanted"))
    return r.join(present.select(*keys, F.col(shape).alias("found")).hint("merge"), keys).where(~F.col("wanted").eqNullSafe(F.col("found")))


def missing_items(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Required items that aren't there."""
    return required.join(present.hint("merge"), keys, "left_anti")


def merged_stats(stats: DataFrame, order: str = "dataset", mode: str = "weighted") -> DataFrame:
    """(dataset, frames, feature, stat, pos, value) -> (feature, stat, pos, value) of all datasets: min and max by element, count summed, mean, std and quantiles (q...) weighted by frames, any other stat the first dataset's.

    ``pos`` is a place in a list, or an array of the places in nested lists (see ``sessions.stats``); with a column ``json``, what is no number keeps the text of the first dataset.
    Frames are those of a dataset. A weighted value is the sum of values times frames over the frames of all datasets, also of those that lack the feature. With
    ``mode`` *pooled*, mean and std are those of the concatenated frames of the datasets that have both: pairs of (frames, mean, sum of squares) are combined.
    """
    if mode not in ("weighted", "pooled"):
        raise ValueError(f"mode is weighted or pooled, not {mode}")
    total = stats.groupBy("dataset").agg(F.max("frames").alias("frames")).agg(F.sum("frames").alias("__all"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    value = (
        F.when(F.col("stat") == "min", F.min("value")).when(F.col("stat") == "max", F.max("value")).when(F.col("stat") == "count", F.sum("value"))
        .when(F.col("stat").isin("mean", "std") | F.col("stat").rlike("^q"), F.sum(F.col("value") * F.col("frames")) / F.first("__all")).otherwise(first("value"))
    )
    texts = [first("json").alias("json")] if "json" in stats.columns else []
    out = stats.crossJoin(F.broadcast(total)).groupBy("feature", "stat", "pos").agg(value.alias("value"), *texts)  # one row
    if mode == "weighted":
        return out
    pooled = pooled_stats(stats).withColumnRenamed("value", "__pooled").select(*[F.col(c).alias(f"__{c}") for c in ("feature", "stat", "pos")], "__pooled")
    on = (F.col("feature") == F.col("__feature")) & (F.col("stat") == F.col("__stat")) & (F.col("pos") == F.col("__pos"))
    return out.join(pooled.hint("merge"), on, "left").withColumn("value", F.coalesce("__pooled", "value")).drop("__feature", "__stat", "__pos", "__pooled")


def pooled_stats(stats: DataFrame) -> DataFrame:
    """(feature, stat, pos, value) for mean and std (of the population) of the concatenated frames of all datasets that have both."""
    both = stats.where("stat in ('mean', 'std')").groupBy("feature", "pos", "dataset").agg(
        F.max("frames").cast("double").alias("n"), F.max(F.when(F.col("stat") == "mean", F.col("value"))).alias("mean"), F.max(F.when(F.col("stat") == "std", F.col("value"))).alias("std")
    ).where("n > 0 and mean is not null and std is not null")
    part = F.struct("n", "mean", (F.col("std") * F.col("std") * F.col("n")).alias("m2"))

    def combined(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"))

    # one entry a dataset
    parts = both.groupBy("feature", "pos").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    one = parts.withColumn("x", F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0], combined))
    pair = lambda stat, v: F.struct(F.lit(stat).alias("stat"), v.alias("value"))
    return one.select("feature", "pos", F.explode(F.array(pair("mean", F.col("x.mean")), pair("std", F.sqrt(F.col("x.m2") / F.col("x.n"))))).alias("y")).select("feature", "y.stat", "pos", "y.value")


def totals(sizes: DataFrame) -> DataFrame:
    """Totals of all datasets, and the range that the split covers; tasks, if there is ``n_tasks``, are those of the merged registry: see ``full_registry``."""
    out = sizes.agg(F.sum("n_episodes").alias("total_episodes"), F.sum("n_frames").alias("total_frames"), *([F.max("n_tasks").alias("total_tasks")] if "n_tasks" in sizes.columns else []))
    return out.withColumn("train", F.concat(F.lit("0:"), F.col("total_episodes").cast("string")))


def incompatibilities(infos: DataFrame, checked: list[str], order: str = "dataset") -> DataFrame:
    """(dataset, field, first_value, value) where a dataset's info differs from the first one's."""
    long = infos.select("dataset", F.col(order).alias("__order"), F.explode(F.create_map(*[x for c in checked for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", "value"))
    first = long.groupBy(F.col("field").alias("f")).agg(F.min_by(F.struct("value"), "__order")["value"].alias("first_value"))
    return long.join(first.hint("merge"), F.col("field") == F.col("f")).where(~F.col("value").eqNullSafe(F.col("first_value"))).select("dataset", "field", "first_value", "value")


def readiness(facts: DataFrame, version: str = "v3.0") -> DataFrame:
    """(dataset, rule, severity) of each failed rule; what a dataset lacks counts as 0 or false.

    Facts, as ``sessions.dataset_facts`` gives them: has_info, info_readable, version, n_episodes, n_frames, n_tasks, has_tasks, n_data_files, n_videos, has_stats. Without an info
    document (rule info), or with one that can't be read (info_json), no other rule is tried. All rules are errors but stats, a warning.
    """
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) <= 0
    known = ~no("has_info") & ~no("info_readable")
    rules = [
        ("info", "error", no("has_info")), ("info_json", "error", ~no("has_info") & no("info_readable")), ("version", "error", known & ~F.coalesce(F.col("version") == version, F.lit(False))),
        ("episodes", "error", known & none("n_episodes")), ("frames", "error", known & none("n_frames")), ("tasks", "error", known & none("n_tasks")), ("tasks_file", "error", known & no("has_tasks")),
        ("data", "error", known & none("n_data_files")), ("videos", "error", known & none("n_videos")), ("stats", "warning", known & no("has_stats")),
    ]
    found = F.filter(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), c.alias("failed")) for r, s, c in rules]), lambda x: x["failed"])
    return facts.select("dataset", F.explode(found).alias("x")).select("dataset", "x.rule", "x.severity")
