"""Aligned training frames: steps with a frame of each camera, a task and a subtask; manual trims; episode overviews.

Camera frames are (dataset, camera, ord, ts, rgb_video, rgb_video_frame), steps (dataset, episode, ts, ord, ...). Pixels stay where they are; only references are carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof
from .intervals import joined
from .signals import dominant, rates
from .stored import stored

# How far a camera frame may be from a step, and a text from a frame, in ns.
CAMERA_TOLERANCE, TEXT_TOLERANCE = 150_000_000, 2_000_000_000


def camera_rates(frames: DataFrame, block: float = 3.6e12) -> DataFrame:
    """E4 by camera: (dataset, camera, fps), see ``signals.rates``."""
    return rates(frames, ["dataset", "camera"], block)


def video_seconds(frames: DataFrame) -> DataFrame:
    """Frames with ``fps`` of their camera and ``video_s``, their place in the video in s."""
    return frames.join(camera_rates(frames).hint("merge"), ["dataset", "camera"]).withColumn("video_s", F.col("rgb_video_frame") / F.col("fps"))


def frame_references(keys: DataFrame, frames: DataFrame, name: str, tolerance: int = CAMERA_TOLERANCE) -> DataFrame:
    """Distinct keys (dataset, ts, ord) -> (__d, __t, __o, name: struct (rgb_video, rgb_video_frame, frame_ts) of the nearest frame, null beyond the tolerance)."""
    met = asof.nearest(keys, frames.select("dataset", "ts", "ord"), tolerance)
    reference = frames.select(F.col("dataset").alias("__fd"), F.col("ord").alias("__fo"), F.struct("rgb_video", "rgb_video_frame", F.col("ts").alias("frame_ts")).alias(name))
    return met.join(reference.hint("merge"), (F.col("dataset") == F.col("__fd")) & (F.col("right_ord") == F.col("__fo")), "left").select(F.col("dataset").alias("__d"), F.col("ts").alias("__t"), F.col("ord").alias("__o"), name)


def with_frames(steps: DataFrame, cameras: dict[str, DataFrame], tolerance: int = CAMERA_TOLERANCE, on_unmatched: str = "error") -> DataFrame:
    """A10: steps with a column for each camera: struct (rgb_video, rgb_video_frame, frame_ts) of its nearest frame.

    ``on_unmatched``: a step without a frame of a camera within the tolerance is an error, goes (drop) or has null (null). All cameras are matched to the steps as they
    are given, so the plan grows with the number of cameras only.
    """
    if on_unmatched not in ("error", "drop", "null"):
        raise ValueError(f"on_unmatched is error, drop or null, not {on_unmatched}")
    keys, out = steps.select("dataset", "ts", "ord").distinct(), steps
    for name, frames in cameras.items():
        found = frame_references(keys, frames, name, tolerance)
        out = out.join(found.hint("merge"), (F.col("dataset") == F.col("__d")) & (F.col("ts") == F.col("__t")) & (F.col("ord") == F.col("__o")), "left").drop("__d", "__t", "__o")
        if on_unmatched == "drop":
            out = out.where(F.col(name).isNotNull())
        elif on_unmatched == "error":
            missing = F.raise_error(F.concat(F.lit(f"no frame of {name} within the tolerance of "), F.col("ts").cast("string")))
            out = out.withColumn(name, F.coalesce(F.col(name), missing.cast(out.schema[name].dataType)))
    return out


def episode_tasks(steps: DataFrame, cameras: list[str], texts: DataFrame, annotations: DataFrame, tolerance: int = TEXT_TOLERANCE) -> DataFrame:
    """(dataset, episode, output_index, task): the annotation (dataset, episode, task) of an episode, else the text nearest to most of its frames, else episode_ and its number.

    Texts are (dataset, ts, ord, text); ties of the count go to the text seen first, camera by camera.
    """
    seen = [steps.select("dataset", "episode", F.lit(k).cast("long").alias("n"), "ord", F.col(c)["frame_ts"].alias("ts")).where("ts is not null") for k, c in enumerate(cameras)]
    return tasks_of_frames(steps.select("dataset", "episode").distinct(), reduce(DataFrame.unionByName, seen), texts, annotations, tolerance)


def tasks_of_frames(episodes: DataFrame, frames: DataFrame, texts: DataFrame, annotations: DataFrame, tolerance: int = TEXT_TOLERANCE) -> DataFrame:
    """As ``episode_tasks``, from the frames (dataset, episode, n: the camera's place, ord: the step's, ts: the frame's time) that steps were matched with."""
    met = asof.nearest(frames.select("dataset", "ts", "ord").distinct(), texts.select("dataset", "ts", "ord"), tolerance)
    said = texts.select(F.col("dataset").alias("__d"), F.col("ord").alias("__o"), F.nullif(F.trim("text"), F.lit("")).alias("text"))
    found = met.join(said.hint("merge"), (F.col("dataset") == F.col("__d")) & (F.col("right_ord") == F.col("__o"))).select("dataset", "ts", "ord", "text")
    main = dominant(frames.join(found.hint("merge"), ["dataset", "ts", "ord"]).withColumn("ts", F.col("n")), "text").select("dataset", "episode", F.col("task").alias("__said"))
    w = Window.partitionBy("dataset").orderBy("episode")
    all_ = episodes.withColumn("output_index", F.row_number().over(w) - 1)
    noted = annotations.select("dataset", "episode", F.col("task").alias("__noted"))
    out = all_.join(main.hint("merge"), ["dataset", "episode"], "left").join(noted.hint("merge"), ["dataset", "episode"], "left")
    return out.select("dataset", "episode", "output_index", F.coalesce("__noted", "__said", F.format_string("episode_%06d", "output_index")).alias("task"))


def with_all_frames(steps: DataFrame, frames: DataFrame, tolerance: int = CAMERA_TOLERANCE, strict: bool = True) -> DataFrame:
    """A10: steps with ``frames``, a map from each camera of their dataset to its nearest frame (rgb_video, rgb_video_frame, frame_ts); cameras may differ from dataset to dataset.

    A step without a frame of a camera within the tolerance is an error, or goes if not ``strict``.
    """
    keys = steps.select("dataset", "ts", "ord").distinct()
    met = asof.nearest_of_cameras(keys, frames, tolerance)
    reference = frames.select(F.col("dataset").alias("__d"), F.col("camera").alias("__c"), F.col("ord").alias("__o"), F.struct("rgb_video", "rgb_video_frame", F.col("ts").alias("frame_ts")).alias("frame"))
    met = met.join(reference.hint("merge"), (F.col("dataset") == F.col("__d")) & (F.col("camera") == F.col("__c")) & (F.col("right_ord") == F.col("__o")), "left")
    if strict:
        missing = F.raise_error(F.format_string("no frame of %s within the tolerance of %d in %s", F.coalesce("camera", F.lit("any camera")), "ts", F.col("dataset").cast("string")))
        met = met.withColumn("frame", F.coalesce("frame", missing.cast(met.schema["frame"].dataType)))
    maps = met.groupBy(F.col("dataset").alias("__kd"), F.col("ts").alias("__kt"), F.col("ord").alias("__ko")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("camera", "frame")))).alias("frames"), F.bool_and(F.col("frame").isNotNull()).alias("__all")).where("__all")
    return steps.join(maps.hint("merge"), (F.col("dataset") == F.col("__kd")) & (F.col("ts") == F.col("__kt")) & (F.col("ord") == F.col("__ko"))).drop("__kd", "__kt", "__ko", "__all")


def subtask_times(subtasks: DataFrame, frames: DataFrame) -> DataFrame:
    """Subtasks (dataset, episode, subtasks: array of phase, start_s, end_s) -> (dataset, episode, pos, phase, start_ts, end_ts) by the frames of the primary camera (dataset, ord, ts, video_s); datasets without frames have none."""
    one = subtasks.select("dataset", "episode", F.posexplode("subtasks").alias("pos", "s"))
    ends = one.select("dataset", "episode", "pos", "s.phase", F.explode(F.map_from_arrays(F.array(F.lit("start"), F.lit("end")), F.array("s.start_s", "s.end_s"))).alias("side", "ts"))
    left = ends.select("dataset", "ts", F.struct("episode", "pos", "phase", "side").alias("ord"))
    right = frames.select("dataset", F.col("video_s").alias("ts"), "ord", F.col("ts").alias("frame_ts"))
    found = asof.nearest_any(left, right, payload="frame_ts", block=600.0).select("dataset", "ord.*", "frame_ts")
    out = found.groupBy("dataset", "episode", "pos", "phase").agg(*[F.max(F.when(F.col("side") == s, F.col("frame_ts"))).alias(f"{s}_ts") for s in ("start", "end")])
    return out.where("start_ts is not null and end_ts is not null")


def aligned_frames(steps: DataFrame, cameras: dict[str, DataFrame], texts: DataFrame, annotations: DataFrame, tolerance: int = CAMERA_TOLERANCE, text_tolerance: int = TEXT_TOLERANCE, on_unmatched: str = "error") -> DataFrame:
    """A10: steps with their episode's task and output index and ``frames``, a map from camera to the reference of its frame. Both indices are kept.

    Steps and matched steps are needed several times, so they are stored (see ``stored``).
    """
    out = stored(with_frames(stored(steps), cameras, tolerance, on_unmatched))
    tasks = episode_tasks(out, list(cameras), texts, annotations, text_tolerance)
    pairs = F.map_from_arrays(F.array(*map(F.lit, cameras)), F.array(*map(F.col, cameras)))
    return out.withColumn("frames", pairs).drop(*cameras).join(tasks.hint("merge"), ["dataset", "episode"])


def trim_times(trims: DataFrame, frames: DataFrame) -> DataFrame:
    """Trims (dataset, episode, trim_start_s, trim_end_s) -> (dataset, episode, from_ts, to_ts): the times of the primary camera's frames (dataset, ord, ts, video_s) nearest to them.

    Ties go to the later frame. Trims that end no later than they start, and those of datasets without frames, are left out.
    """
    ok = trims.where("trim_end_s > trim_start_s")
    ends = ok.select("dataset", "episode", F.explode(F.map_from_arrays(F.array(F.lit("from"), F.lit("to")), F.array("trim_start_s", "trim_end_s"))).alias("side", "ts"))
    left = ends.withColumn("ord", F.struct("episode", "side"))
    right = frames.select("dataset", F.col("video_s").alias("ts"), "ord", F.col("ts").alias("frame_ts"))
    found = asof.nearest_any(left, right, payload="frame_ts", block=600.0)
    out = found.groupBy("dataset", F.col("ord")["episode"].alias("episode")).agg(*[F.max(F.when(F.col("ord")["side"] == s, F.col("frame_ts"))).alias(f"{s}_ts") for s in ("from", "to")])
    return out.where("from_ts is not null and to_ts is not null")


def trimmed_by_hand(rows: DataFrame, trims: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows (dataset, episode, ts, ...) within their episode's trim; all rows where there is none, it is invalid, or nothing would be left."""
    t = trim_times(trims, frames).select(F.col("dataset").alias("__d"), F.col("episode").alias("__e"), "from_ts", "to_ts")
    met = rows.join(t.hint("merge"), (F.col("dataset") == F.col("__d")) & (F.col("episode") == F.col("__e")), "left")
    met = met.withColumn("__in", F.coalesce(F.col("ts").between(F.col("from_ts"), F.col("to_ts")), F.lit(False)))
    any_ = F.max("__in").over(Window.partitionBy("dataset", "episode"))
    return met.withColumn("__any", any_).where("__in or not __any").drop("__d", "__e", "from_ts", "to_ts", "__in", "__any")


def checked_trims(requests: DataFrame, bounds: DataFrame) -> DataFrame:
    """Requests (dataset, episode, trim_start_s, trim_end_s) with ``reason`` why they can't be saved, null for those that can, and times to 4 digits.

    ``bounds``: (dataset, episode, start_s, end_s) of the primary camera. Reasons: missing, no_episode, order, bounds.
    """
    b = bounds.select(F.col("dataset").alias("__d"), F.col("episode").alias("__e"), "start_s", "end_s")
    out = requests.join(b.hint("merge"), (F.col("dataset") == F.col("__d")) & (F.col("episode") == F.col("__e")), "left")
    a, z = F.col("trim_start_s"), F.col("trim_end_s")
    reason = F.when(a.isNull() | z.isNull(), "missing").when(F.col("start_s").isNull(), "no_episode").when(z <= a, "order").when((a < F.col("start_s")) | (z > F.col("end_s")), "bounds")
    return out.withColumn("reason", reason).withColumn("trim_start_s", F.bround(a, 4)).withColumn("trim_end_s", F.bround(z, 4)).drop("__d", "__e", "start_s", "end_s")


def camera_bounds(episodes: DataFrame, frames: DataFrame) -> DataFrame:
    """H6: episodes (dataset, episode, first_ts, last_ts) -> (dataset, episode, camera, start_s, end_s, fps): where they stand in each camera's video, 0.1 s long at least.

    A time is that of the first frame at or after it, or of the last frame. ``frames`` has video_s and fps (B8).
    """
    ends = episodes.select("dataset", "episode", F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("z")), F.array("first_ts", "last_ts"))).alias("side", "ts"))
    cameras = frames.groupBy("dataset", "camera").agg(F.first("fps").alias("fps"))
    left = ends.join(cameras.hint("merge"), "dataset").select(F.struct("dataset", "camera").alias("dataset"), "ts", F.struct("episode", "side").alias("ord"))
    right = frames.select(F.struct("dataset", "camera").alias("dataset"), "ts", "ord", "video_s")
    found = asof.forward(left, right, payload="video_s")
    key = [F.col("dataset")["dataset"].alias("dataset"), F.col("ord")["episode"].alias("episode"), F.col("dataset")["camera"].alias("camera")]
    by = found.groupBy(*key).agg(*[F.max(F.when(F.col("ord")["side"] == s, F.col("video_s"))).alias(s) for s in "az"])
    end = F.when(F.col("z") <= F.col("a"), F.col("a") + 0.1).otherwise(F.col("z"))
    return by.join(cameras.hint("merge"), ["dataset", "camera"]).select("dataset", "episode", "camera", F.bround("a", 4).alias("start_s"), F.bround(end, 4).alias("end_s"), "fps")


def episode_overview(episodes: DataFrame, frames: DataFrame, annotations: DataFrame, trims: DataFrame, subtasks: DataFrame) -> DataFrame:
    """H6: one row an episode: cameras (map to start_s, end_s, fps), task, trim_start_s, trim_end_s, subtasks; sidecars have one row an episode at most."""
    bounds = camera_bounds(episodes, frames).groupBy("dataset", "episode").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("camera", F.struct("start_s", "end_s", "fps"))))).alias("cameras"))
    out = episodes.join(bounds.hint("merge"), ["dataset", "episode"], "left")
    for side, columns in ((annotations, ["task"]), (trims, ["trim_start_s", "trim_end_s"]), (subtasks, ["subtasks"])):
        out = out.join(side.select("dataset", "episode", *columns).hint("merge"), ["dataset", "episode"], "left")
    return out


def clip_manifest(episodes: DataFrame, frames: DataFrame, bucket_s: float = 60.0) -> DataFrame:
    """Episodes (dataset, episode, start_ts, end_ts) and frames (dataset, camera, ts, ord, rgb_video_frame) -> (dataset, episode, camera, first_frame, last_frame); episodes without a frame have no row."""
    e = episodes.select(F.col("dataset").alias("__k"), "episode", "start_ts", "end_ts").where("end_ts is not null")
    inside = F.col("ts").between(F.col("start_ts"), F.col("end_ts"))
    met = joined(frames, e, "dataset", "ts", bucket_s * 1e9, inside, "start_ts", "end_ts")
    place: Column = F.struct("ts", "ord")
    return met.groupBy("dataset", "episode", "camera").agg(F.min_by("rgb_video_frame", place).alias("first_frame"), F.max_by("rgb_video_frame", place).alias("last_frame"))


def prompt_vocabulary(words: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """A row of word lists (array columns) -> prompts of one word of each, in a fixed arbitrary order; the first ``n`` of them, an error if there are fewer. Word lists are short."""
    out = words
    for c in words.columns:
        out = out.withColumn(c, F.explode(F.array_distinct(c)))
    prompts = out.select(F.concat(F.concat_ws(" ", *words.columns), F.lit(".")).alias("prompt")).distinct()
    w = Window.orderBy(F.xxhash64("prompt", F.lit(seed)), "prompt")
    placed = prompts.withColumn("place", F.row_number().over(w) - 1)
    if n is None:
        return placed
    total = F.count("*").over(Window.partitionBy())
    enough = F.when(total >= n, F.col("place")).otherwise(F.raise_error(F.lit(f"fewer than {n} prompts")).cast("int"))
    return placed.withColumn("place", enough).where(F.col("place") < n)
