"""Whole jobs over session folders: clean, convert, merge. Each reads many sessions at once and writes tables, partitioned by dataset; a job that is run again writes the same."""

from __future__ import annotations

from dataclasses import dataclass, fields as fields_of

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fields
from ..operators import alignment, asof, episodes, labels, merging, quantiles, reports, signals
from ..operators.scans import scanned
from ..operators.stored import stored
from ..sources import sessions
from ..streaming import control

#: Quantiles in the statistics of a converted dataset.
QUANTILES = {"q01": 0.01, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q99": 0.99}


@dataclass
class Sessions:
    """Tables of sessions by dataset: telemetry, frames and texts have ``ts``, the time that counts, and ``ord``."""

    telemetry: DataFrame
    events: DataFrame
    frames: DataFrame
    texts: DataFrame
    annotations: DataFrame
    trims: DataFrame
    subtasks: DataFrame


SIDECARS = {"annotations": "dataset string, episode long, task string", "trims": "dataset string, episode long, trim_start_s double, trim_end_s double", "subtasks": "dataset string, episode long, subtasks array<struct<phase:string,start_s:double,end_s:double>>"}


def of_folders(spark: SparkSession, path: str) -> Sessions:
    """The session folders below ``path``, by their sources; sidecars may be missing."""
    timed = lambda rows: rows.withColumn("ts", fields.first_timestamp(*map(F.col, fields.TIMESTAMP_FIELDS)))

    def sidecar(name: str) -> DataFrame:
        try:
            return sessions.sidecar(spark, path, name).select(*[c.split()[0] for c in SIDECARS[name].split(", ")])
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], SIDECARS[name])

    events = sessions.episode_events(spark, path)
    named = episodes.normalised_events(events.withColumn("ts", F.col("robot_timestamp_ns")), F.col("raw_name")).select("dataset", "ts", "ord", "name")
    texts = timed(sessions.texts(spark, path)).select("dataset", "ts", "ord", F.col("value").alias("text"))
    return Sessions(timed(sessions.telemetry(spark, path)), named, timed(sessions.camera_frames(spark, path)), texts, *map(sidecar, SIDECARS))


def saved(spark: SparkSession, path: str) -> Sessions:
    """What ``clean`` wrote."""
    return Sessions(*[spark.read.parquet(f"{path}/{f.name}") for f in fields_of(Sessions)])


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("dataset").parquet(path)


def clean(source: Sessions, out: str, least_s: float = 2.0, tolerance: int = alignment.CAMERA_TOLERANCE, max_episodes: int | None = None, prompts: list[str] | None = None) -> dict[str, int]:
    """Episodes cut to the rows between their first and last motion, and of these to those that all cameras cover; those that last less than ``least_s`` go.

    Writes the rows that stay, events of the episodes anew, frames and texts as they are, and, with ``prompts``, an annotation for each kept episode, in turn. Returns how many episodes there
    were of each reason (E14), counted while the rows are written.
    """
    e, a = F.col("robot_state"), F.col("executed_action")
    rows = episodes.limited(episodes.episode_rows(source.telemetry, source.events), max_episodes)
    rows = signals.moving(rows, fields.l2_norm(a["cartesian_delta_translation"]), fields.l2_norm(a["cartesian_delta_rotation"]), e["q"], e["gripper_width"])
    rows = stored(rows)
    covered = asof.covered_by_all(rows, source.frames, tolerance)
    covered = covered.select(F.col("dataset").alias("__d"), F.col("ts").alias("__t"), F.col("ord").alias("__o"), "covered")
    rows = rows.join(covered.hint("merge"), (F.col("dataset") == F.col("__d")) & (F.col("ts") == F.col("__t")) & (F.col("ord") == F.col("__o"))).drop("__d", "__t", "__o")
    kept, seen = signals.cleaned_and_counted(rows, "moving", "covered", least_s)
    _write(kept.drop("moving", "covered", "row").withColumnRenamed("episode", "raw_episode"), f"{out}/telemetry")
    rows = kept.sparkSession.read.parquet(f"{out}/telemetry").withColumnRenamed("raw_episode", "episode")
    ends = stored(signals.cleaned_events(rows))
    place = Window.partitionBy("dataset").orderBy("episode", F.desc("event"))  # episode_start before episode_end
    events = ends.withColumn("ord", F.row_number().over(place) - 1).select("dataset", F.col("robot_timestamp_ns").alias("ts"), "ord", F.when(F.col("event") == "episode_start", "start").otherwise("end").alias("name"))
    _write(events, f"{out}/events")
    _write(source.frames, f"{out}/frames")
    _write(source.texts, f"{out}/texts")
    numbered = ends.where("event = 'episode_start'").select("dataset", (F.row_number().over(Window.partitionBy("dataset").orderBy("episode")) - 1).cast("long").alias("episode"))
    spark = kept.sparkSession
    notes = labels.cyclic_prompts(numbered, prompts) if prompts else spark.createDataFrame([], SIDECARS["annotations"])
    for name, table in (("annotations", notes), ("trims", spark.createDataFrame([], SIDECARS["trims"])), ("subtasks", spark.createDataFrame([], SIDECARS["subtasks"]))):
        table.write.mode("overwrite").parquet(f"{out}/{name}")
    return seen.get


def convert(source: Sessions, out: str, tolerance: int = alignment.CAMERA_TOLERANCE, keep_blank: bool = False, blank_steps: int = 1000, primary: str | None = None, strict: bool = True) -> DataFrame:
    """Training frames of sessions: frames, episodes, tasks, subtasks, info and stats of each dataset, written below ``out``; returns the report, one row an episode.

    Episodes are trimmed by hand (C5) and cut into steps (C4, at least two rows); each step has state, action, a frame of each camera of its dataset (A10) and the sentence of its subtask or
    else its episode's task (B11, D10, D13). Blank episodes (C3) don't go into the frames. Pixels stay where they are.
    """
    rows = episodes.episode_rows(source.telemetry, source.events)
    first = source.frames.groupBy("dataset").agg(F.min("camera").alias("__top")) if primary is None else source.frames.select("dataset").distinct().withColumn("__top", F.lit(primary))
    top = first.withColumnRenamed("dataset", "__pd")
    main = source.frames.join(top.hint("merge"), (F.col("dataset") == F.col("__pd")) & (F.col("camera") == F.col("__top"))).drop("__pd", "__top")
    main = stored(alignment.video_seconds(main))
    state = F.col("robot_state")
    steps = episodes.steps(alignment.trimmed_by_hand(rows, source.trims, main))
    steps = steps.select(
        "dataset", "episode", "ts", "ord", "step", fields.state_vector(state["q"], state["gripper_width"]).alias("state"),
        fields.action_vector(F.col("backfilled_q_cmd"), state["q_cmd"], F.col("executed_action.gripper_command")).alias("action"),
    )
    steps = stored(alignment.with_all_frames(stored(steps), source.frames, tolerance, strict))
    keys = ["dataset", "episode"]
    # tasks: a camera's place is that of its name among the names of its dataset
    seen = steps.select(*keys, "ord", F.posexplode(F.map_values("frames")).alias("n", "f")).select(*keys, F.col("n").cast("long").alias("n"), "ord", F.col("f.frame_ts").alias("ts"))
    tasks = stored(alignment.tasks_of_frames(steps.select(*keys).distinct(), seen, source.texts, source.annotations))
    active = (F.max(F.abs(F.element_at("action", -1))) >= 0.1) | ((F.max(F.element_at("state", -1)) - F.min(F.element_at("state", -1))) >= 0.002)
    quality = steps.groupBy(*keys).agg(F.count("*").alias("step_count"), ((F.max("ts") - F.min("ts")) / 1e9).alias("duration_s"), active.alias("active"), F.min("ts").alias("start_ts"))
    quality = quality.join(tasks.hint("merge"), keys).withColumn("suppressed", ~F.col("active") & (F.col("step_count") <= blank_steps) & F.lit(not keep_blank))
    # kept episodes are numbered anew, and their frames stand one after another
    kept = scanned(quality.where("not suppressed"), ["dataset"], ["episode"], 1e5, running={"dataset_to_index": F.col("step_count")}, place="episode_index")
    kept = stored(kept.withColumn("dataset_from_index", F.col("dataset_to_index") - F.col("step_count")))
    phases = stored(alignment.subtask_times(source.subtasks, main))
    whole = _step_tasks(steps, phases, kept)
    fps = alignment.camera_rates(main).groupBy("dataset").agg(F.max("fps").alias("fps"))
    tops = first.select(F.col("dataset").alias("__td"), "__top")
    whole = stored(
        whole.join(tops.hint("merge"), F.col("dataset") == F.col("__td")).join(fps.hint("merge"), "dataset").select(
            "dataset", "episode_index", F.col("step").cast("long").alias("frame_index"), (F.col("dataset_from_index") + F.col("step")).alias("index"), (F.col("step") / F.col("fps")).alias("timestamp"), "task", "subtask",
            F.col("state").cast("array<float>").alias("observation.state"), F.col("action").cast("array<float>").alias("action"),
            F.transform_keys("frames", lambda c, f: fields.camera_feature(c, F.col("__top"))).alias("frames"),
        )
    )
    # a dataset's tasks are few, numbered in the order first seen
    registry = whole.groupBy("dataset", "task").agg(F.min("index").alias("first")).withColumn("task_index", (F.row_number().over(Window.partitionBy("dataset").orderBy("first")) - 1).cast("long")).drop("first")
    registry = stored(registry)
    _write(whole.join(registry.hint("merge"), ["dataset", "task"]).drop("task"), f"{out}/frames")
    _write(kept.select("dataset", "episode_index", "task", F.col("step_count").alias("length"), "dataset_from_index", "dataset_to_index"), f"{out}/episodes")
    _write(registry, f"{out}/tasks")
    begun = quality.where("not suppressed").select("dataset", "episode", "output_index", F.col("start_ts").alias("__begun"))
    clip = F.struct("pos", "phase", *[fields.relative_seconds(F.col(c), F.col("__begun")).alias(n) for c, n in (("start_ts", "start_s"), ("end_ts", "end_s"))])
    listed = phases.join(begun.hint("merge"), keys).groupBy("dataset", F.col("output_index").alias("episode_index")).agg(F.array_sort(F.collect_list(clip)).alias("c"))
    _write(listed.select("dataset", "episode_index", F.transform("c", lambda c: F.struct(*[c[n].alias(n) for n in ("phase", "start_s", "end_s")])).alias("phases")), f"{out}/subtasks")
    counts = kept.groupBy("dataset").agg(F.count("*").alias("total_episodes"), F.sum("step_count").alias("total_frames")).join(registry.groupBy("dataset").agg(F.count("*").alias("total_tasks")).hint("merge"), "dataset").join(fps.hint("merge"), "dataset")
    shapes = whole.groupBy("dataset").agg(F.max(F.size("`observation.state`")).alias("state_size"), F.max(F.size("action")).alias("action_size"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("frames"))))).alias("cameras"))
    _write(counts.join(shapes.hint("merge"), "dataset").withColumn("codebase_version", F.lit("v3.0")), f"{out}/info")
    _write(_statistics(whole), f"{out}/stats")
    w = Window.partitionBy("dataset")
    report = quality.withColumn("detected_episodes", F.count("*").over(w)).withColumn("suppressed_episodes", F.count_if("suppressed").over(w))
    return report.withColumn("kept_episodes", F.col("detected_episodes") - F.col("suppressed_episodes")).drop("start_ts")


def _step_tasks(steps: DataFrame, phases: DataFrame, kept: DataFrame, bucket: float = 5e9) -> DataFrame:
    """Steps of kept episodes with their place, ``subtask`` (null where an episode has none) and ``task``. ``bucket``: about the length of a phase in ns."""
    key = F.struct("dataset", "episode")
    found = labels.nearest_phase(
        steps.join(phases.select("dataset", "episode").distinct().hint("merge"), ["dataset", "episode"], "left_semi").select(key.alias("k"), "ts", "ord"),
        phases.select(key.alias("k"), "pos", "phase", F.col("start_ts").alias("start_t"), F.col("end_ts").alias("end_t")), "k", bucket,
    )
    found = found.select(F.col("k.dataset").alias("__d"), F.col("k.episode").alias("__e"), F.col("ts").alias("__t"), F.col("ord").alias("__o"), F.col("phase").alias("subtask"))
    on = (F.col("dataset") == F.col("__d")) & (F.col("episode") == F.col("__e")) & (F.col("ts") == F.col("__t")) & (F.col("ord") == F.col("__o"))
    rows = steps.join(found.hint("merge"), on, "left").drop("__d", "__e", "__t", "__o")
    rows = rows.join(kept.select("dataset", "episode", "episode_index", "dataset_from_index", F.col("task").alias("__task")).hint("merge"), ["dataset", "episode"])
    return rows.withColumn("task", fields.step_task(F.col("subtask"), F.col("__task"))).drop("__task")


def _statistics(frames: DataFrame) -> DataFrame:
    """(dataset, frames, feature, stat, pos, value) of each component of states and actions, with exact quantiles."""
    long = [frames.select("dataset", F.lit(f).alias("feature"), F.posexplode(F.col(f"`{f}`").cast("array<double>")).alias("pos", "x")) for f in ("observation.state", "action")]
    values, keys = long[0].unionByName(long[1]), ["dataset", "feature", "pos"]
    by = {"mean": F.avg("x"), "std": F.stddev_pop("x"), "min": F.min("x"), "max": F.max("x"), "count": F.count("x").cast("double")}
    plain = values.groupBy(*keys).agg(*[c.alias(n) for n, c in by.items()])
    both = plain.join(quantiles.exact_quantiles(values, keys, "x", QUANTILES).hint("merge"), keys)
    sizes = frames.groupBy("dataset").agg(F.count("*").alias("frames"))
    stat = F.explode(F.create_map(*[x for n in (*by, *QUANTILES) for x in (F.lit(n), F.col(n))]))
    return both.join(sizes.hint("merge"), "dataset").select("dataset", "frames", "feature", "pos", stat.alias("stat", "value"))


def machine_against_labels(rows: DataFrame, segments: DataFrame, rules: control.PhaseRules, bucket: float) -> DataFrame:
    """(key, ts, ord, from_phase, phase, label, match): the machine's phases over the rows (key, ts, ord, signals), beside the label of the segment (key, pos, phase, start_t, end_t) that holds each, -1 and a
    null match where none does. ``bucket``: about the length of a segment. ``reports.agreement`` counts them, and ``control.phase_changes`` lists the transitions.
    """
    found = labels.half_open_phase(rows.select("key", "ts", "ord"), segments, "key", bucket).select(F.col("key").alias("__k"), F.col("ts").alias("__t"), F.col("ord").alias("__o"), F.col("phase").alias("label"))
    on = F.col("key").eqNullSafe(F.col("__k")) & (F.col("ts") == F.col("__t")) & (F.col("ord") == F.col("__o"))
    return reports.matched(control.phases_batch(rows, rules).join(found.hint("merge"), on).drop("__k", "__t", "__o"), "label", "phase")


def merge(spark: SparkSession, converted: str, names: list[str], out: str, mode: str = "weighted") -> dict[str, int]:
    """The datasets ``names`` of what ``convert`` wrote, in the given order, as one: frames and episodes with shifted keys, one task registry (tasks of unknown indices get names), info and a stats document.

    Datasets that differ in rate, shapes, cameras or version are an error, as are names that aren't there. Returns the totals. ``mode``: of the statistics, see ``merging.merged_stats``.
    """
    part = lambda name: merging.in_order(spark.read.parquet(f"{converted}/{name}"), names)
    infos = part("info")
    there = {r.dataset for r in infos.select("dataset").distinct().collect()}  # a name or two of a given list
    if missing := [n for n in names if n not in there]:
        raise ValueError(f"not converted: {', '.join(missing)}")
    apart = merging.incompatibilities(infos, ["codebase_version", "fps", "state_size", "action_size", "cameras"], "nth").limit(10).collect()
    if apart:
        raise ValueError("; ".join(f"{r.dataset}: {r.field} is {r.value}, not {r.first_value}" for r in apart))
    sizes = infos.select("dataset", "nth", F.col("total_episodes").alias("n_episodes"), F.col("total_frames").alias("n_frames"))
    shift = stored(merging.offsets(sizes.select("dataset", "nth", "n_episodes", "n_frames"), "nth"))
    frames, tasks = part("frames"), part("tasks")
    unknown = stored(merging.synthetic_tasks(frames.select("dataset", "nth", "task_index"), tasks, "nth"))
    registry = stored(merging.full_registry(merging.task_registry(tasks, "nth"), unknown, "nth"))
    known = tasks.select("dataset", "task_index", "task").unionByName(unknown.select("dataset", "task_index", "task"))
    _write(merging.remapped_tasks(merging.united(frames, shift), known, registry).drop("nth"), f"{out}/frames")
    _write(merging.united_episodes(part("episodes"), shift).drop("nth"), f"{out}/episodes")
    registry.select(F.col("global_index").alias("task_index"), "task").write.mode("overwrite").parquet(f"{out}/tasks")
    merged = merging.merged_stats(part("stats"), "nth", mode)
    sessions.write_stats(merged, f"{out}/stats", overwrite=True)
    totals = merging.totals(sizes).crossJoin(F.broadcast(registry.agg(F.count("*").alias("total_tasks"))))  # one row each
    first = infos.where("nth = 0").select("codebase_version", "fps", "state_size", "action_size", "cameras")
    totals.crossJoin(F.broadcast(first)).write.mode("overwrite").json(f"{out}/info")
    found = spark.read.json(f"{out}/info").first()
    return {n: found[n] for n in ("total_episodes", "total_frames", "total_tasks")}
