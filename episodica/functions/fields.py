"""Row-level fields of session logs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Names under which logs keep a row's time and a text, first wins.
TIMESTAMP_FIELDS = ("host_timestamp_ns", "timestamp_ns", "robot_timestamp_ns", "receive_host_time_ns", "created_unix_time_ns")
TEXT_FIELDS = ("text", "instruction", "task", "transcript", "utterance", "caption")
# Names of the phases by id.
PHASES = ("free_motion", "fine_align", "contact_establish", "constrained_motion", "verify_release")
UNKNOWN_PHASE = 5


def first_timestamp(*columns: Column) -> Column:
    """B1: the first non-null time in ns; an error when there is none."""
    return F.coalesce(*columns, F.raise_error(F.lit("no timestamp field"))).cast("long")


def first_text(*columns: Column) -> Column:
    """B2: the first text that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def state_vector(q: Column, width: Column) -> Column:
    """Joint positions and the gripper width (0 when missing); an error without joint positions."""
    known = F.when(F.size(q) > 0, q).otherwise(F.raise_error(F.lit("no joint positions")).cast("array<double>"))
    return F.concat(known, F.array(F.coalesce(width, F.lit(0.0)).cast("double")))


def action_vector(backfilled: Column, q_cmd: Column, command: Column) -> Column:
    """Commanded joints (backfilled ones first) and the gripper command (0 when missing)."""
    return F.concat(F.coalesce(backfilled, q_cmd), F.array(F.coalesce(command, F.lit(0.0)).cast("double")))


def dimension_names(vector: Column, prefix: str, last: str) -> Column:
    """Names of a vector's dimensions; the last one is the gripper's. Null for a null or empty vector."""
    joints = F.transform(F.slice(vector, 1, F.size(vector) - 1), lambda x, i: F.concat(F.lit(prefix + "_"), i.cast("string")))
    return F.when(F.size(vector) > 0, F.concat(joints, F.array(F.lit(last))))


def checked_names(vector: Column, names: Column) -> Column:
    """The names; an error when there aren't as many as dimensions."""
    return F.when(F.size(vector) == F.size(names), names).otherwise(F.raise_error(F.lit("names don't fit the vector")).cast("array<string>"))


def l2_norm(vector: Column) -> Column:
    """Euclidean norm; a missing component counts as 0."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)) * F.coalesce(x, F.lit(0.0))))


def camera_feature(camera: Column, top: Column) -> Column:
    """Feature name of a camera; the top one has a name of its own."""
    return F.concat(F.lit("observation.images."), F.when(camera == top, F.lit("top")).otherwise(camera))


def relative_seconds(ts: Column, start: Column) -> Column:
    """Seconds since the episode's start, not below 0, to 4 digits with half to even."""
    return F.bround(F.greatest(F.lit(0.0), (ts - start) / 1e9), 4)


def phase_name(phase: Column) -> Column:
    """Name of a phase; null for one that has none."""
    return F.when(phase >= 0, F.try_element_at(F.array(*map(F.lit, PHASES)), phase.cast("int") + 1))


def subtask_label(task: Column, phase: Column) -> Column:
    """B10."""
    return F.concat_ws(".", task, phase_name(phase))


def gripper_closed(width: Column, limit: float = 0.035) -> Column:
    """1 when narrower than ``limit``."""
    return (width < limit).cast("int")


def state_closed(state: Column, limit: float = 0.5) -> Column:
    """1 when the gripper's state (0 open, 1 closed) is above ``limit``."""
    return (state > limit).cast("int")


# Sentences of the subtasks that the labelling page knows.
SUBTASK_SENTENCES = {
    "approach_can": "Move the gripper to the soup can",
    "grasp_can": "Close the gripper around the soup can",
    "lift_can": "Lift the soup can off the table",
    "move_to_tray": "Carry the soup can to the green tray",
    "release_can": "Place the soup can into the tray",
    "retract_arm": "Move the arm away from the tray",
}


def step_task(subtask: Column, task: Column, sentences: dict[str, str] = SUBTASK_SENTENCES) -> Column:
    """The sentence of a step's subtask, or the episode's task where there is none."""
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    return F.coalesce(F.try_element_at(known, subtask), task)


# Fixed value: a step in the name of a checkpoint's folder.
CHECKPOINT_STEP = r"([0-9]{3,})"


def checkpoint_step(folder: Column) -> Column:
    """The first run of three digits or more in a folder's name; null without one."""
    return F.nullif(F.regexp_extract(folder, CHECKPOINT_STEP, 1), F.lit("")).cast("long")


def json_body(raw: Column) -> Column:
    """What stands between the first { and the last } once code fences are gone; null when there is none."""
    bare = F.regexp_replace(raw, r"```[a-zA-Z]*", "")
    start, end = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    return F.when((start > 0) & (F.instr(bare, "}") > 0) & (end > start), F.substring(bare, start, end - start + 1))


ANNOTATION = "episode_id string, task string, segments array<struct<phase_id:int,phase_name:string,start_t:double,end_t:double,confidence:double,evidence:string>>, overall_confidence double, notes string"


def with_parsed(rows: DataFrame, raw: str, duration: Column, tolerance: float = 0.05) -> DataFrame:
    """Rows with ``annotation`` and ``error`` of the model's answer in column ``raw``; of the errors the first in the order no_json, json, schema, segments, duration, null if it is valid.

    no_json: no object in it; json: the object can't be read; schema: a field is missing, has another type or is out of its range; segments: one breaks
    a rule of its own (F15); duration: they don't cover the episode without gaps (F16). The answer is parsed once.
    """
    out = rows.withColumn("__body", json_body(F.col(raw)))
    out = out.withColumn("__a", F.from_json("__body", ANNOTATION)).withColumn("__readable", F.try_parse_json("__body").isNotNull())
    a, s = F.col("__a"), F.col("__a")["segments"]
    schema = a["episode_id"].isNotNull() & a["task"].isin("pick_place", "msd_plug") & (F.size(s) > 0) & a["overall_confidence"].between(0, 1)
    own = F.forall(s, lambda x: F.coalesce(x["phase_id"].between(0, 4) & (x["phase_name"] == phase_name(x["phase_id"])) & (x["start_t"] < x["end_t"]) & x["confidence"].between(0, 1) & x["evidence"].isNotNull(), F.lit(False)))
    apart = F.exists(F.zip_with(F.slice(s, 2, F.size(s)), F.slice(s, 1, F.size(s) - 1), lambda x, y: (F.abs(x["start_t"] - y["end_t"]) > tolerance) | (x["start_t"] < y["start_t"])), lambda x: x)
    covers = (F.abs(F.element_at(s, 1)["start_t"]) <= tolerance) & (F.abs(F.element_at(s, -1)["end_t"] - duration) <= tolerance) & ~apart
    error = (
        F.when(F.col("__body").isNull(), "no_json").when(~F.col("__readable"), "json").when(~F.coalesce(schema, F.lit(False)), "schema")
        .when(~own, "segments").when(~covers, "duration")
    )
    out = out.withColumn("error", error)
    return out.withColumn("annotation", F.when(F.col("error").isNull(), F.col("__a"))).drop("__body", "__a", "__readable")


def prompt_text(task: Column, duration: Column) -> Column:
    """The user's part of an annotation prompt in short form."""
    return F.format_string("Task: %s. Duration: %.2f s.", task, duration)


def system_message(descriptions: dict[str, dict[int, str]], cues: dict[int, str], answer_form: str) -> Column:
    """The system's part of an annotation prompt: each phase with what it looks like in each task and by which cue it is known, then the form of the answer."""
    parts = ["You annotate videos of robot manipulation.", ""]
    for phase, name in enumerate(PHASES):
        parts += [f"Phase {phase}: {name}", *[f"- {task}: {of[phase]}" for task, of in descriptions.items() if phase in of], *([f"- cue: {cues[phase]}"] if phase in cues else []), ""]
    return F.lit("\n".join([*parts, answer_form]))


def user_message(task: Column, episode: Column, duration: Column) -> Column:
    """The user's part of an annotation prompt."""
    return F.format_string("Task: %s\nEpisode ID: %s\nEpisode duration: %.2f seconds\n\nAnnotate each phase segment of the video and answer with the JSON object alone.", task, episode.cast("string"), duration)


# Fixed value: the form of a log line with a step and a loss.
LOG_LINE = r"step:([0-9]+)([KkMm]?)\s+.*?loss:([0-9]*\.?[0-9]+)"


def log_step(line: Column) -> Column:
    """Step of a training-log line that also has a loss, K and M meaning thousands and millions."""
    number, unit = F.nullif(F.regexp_extract(line, LOG_LINE, 1), F.lit("")).cast("long"), F.upper(F.regexp_extract(line, LOG_LINE, 2))
    return number * F.when(unit == "K", 1000).when(unit == "M", 1_000_000).otherwise(1)


def log_loss(line: Column) -> Column:
    """Loss of a training-log line that also has a step."""
    return F.nullif(F.regexp_extract(line, LOG_LINE, 3), F.lit("")).cast("double")


def dropped_phase(phase: Column, key: Column, share: float = 0.15, seed: int = 0) -> Column:
    """The phase, or unknown for a keyed share of the samples; reruns agree."""
    return F.when(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(share * 10_000), F.lit(UNKNOWN_PHASE)).otherwise(phase)


def phase_or_unknown(rows: DataFrame, phase: str = "phase") -> DataFrame:
    """Rows with the phase column; a table without one gets the unknown phase in every row."""
    return rows if phase in rows.columns else rows.withColumn(phase, F.lit(UNKNOWN_PHASE))


# Fixed value: the task of samples that have none.
FALLBACK_TASK = "Picking up a soup can and placing it on a cardboard surface"


def filled_task(task: Column, fallback: str = FALLBACK_TASK) -> Column:
    """The task, or the fallback where it is null."""
    return F.coalesce(task, F.lit(fallback))


def filled_tasks(rows: DataFrame, task: str = "task", fallback: str = FALLBACK_TASK) -> tuple[DataFrame, Observation]:
    """Rows with the fallback in place of missing tasks, and an observation of ``n_rows`` and ``n_filled``, which Spark counts while the rows are computed."""
    seen = Observation("filled tasks")
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(task).isNull()).alias("n_filled"))
    return counted.withColumn(task, filled_task(F.col(task), fallback)), seen


def unsafe_reason(action: Column, phase: Column, force_z: Column, low: tuple = (-1.3, -1.3, -0.55), high: tuple = (1.3, 1.3, 1.7), velocity: float = 2.0, force: float = 30.0, grip: float = 0.7) -> Column:
    """The first safety rule that an action breaks, null for a safe one. Rules: null, NaN, Inf, workspace, velocity, force, gripper.

    Workspace takes the first three components of actions that have three, velocity the first six of those that have six, gripper the last one of
    those that have seven. ``low`` and ``high`` are the workspace's bounds with a buffer of 0.5 m. A null component counts as null, a null force as none.
    """
    outside = F.lit(False)
    for k, (a, b) in enumerate(zip(low, high)):
        x = F.try_element_at(action, F.lit(k + 1))
        outside = outside | (x < a) | (x > b)
    outside = outside & (F.size(action) >= 3)
    fast = F.exists(F.slice(action, 1, 6), lambda x: F.abs(x) > velocity) & (F.size(action) >= 6)
    return (
        F.when(action.isNull() | F.exists(action, lambda x: x.isNull()), "null").when(F.exists(action, F.isnan), "nan")
        .when(F.exists(action, lambda x: F.abs(x) == float("inf")), "inf").when(outside, "workspace").when(fast, "velocity")
        .when(F.abs(force_z) > force, "force").when((phase == PHASES[0]) & (F.size(action) >= 7) & (F.try_element_at(action, F.lit(-1)) > grip), "gripper")
    )
