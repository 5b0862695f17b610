"""Keyed operators on control streams. A machine's step runs in a batch as a fold over sorted rows and on a stream with its state kept by Spark.

On a stream, rows of a key that are older than its last one come too late for its state: they come out with ``late`` set and nothing else, for the rejects.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.fields import unsafe_reason
from ..operators.folds import folded
from ..operators.labels import LEGAL_NEXT

# Fixed values: (phase from, signal, phase to), tested in this order within one step; phase 4 is the last.
TRANSITIONS = ((0, "align", 1), (1, "contact", 2), (2, "mate", 3), (3, "seated", 4), (4, "retract", 4))
SIGNALS = tuple(s for _, s, _ in TRANSITIONS)
# Limits of the signals, and hysteresis and timeout of the machine, by task.
LIMITS = {
    "default": {"contact_force_threshold": 3.0, "align_xy_threshold": 0.005, "hover_z": 0.05, "mate_force_band": (0.5, 3.0), "seated_force_band": (3.0, 8.0), "insertion_z_target": 0.012, "hysteresis_steps": 3, "fine_align_timeout_s": 5.0, "control_rate_hz": 100.0},
    "msd_plug": {"contact_force_threshold": 1.5, "align_xy_threshold": 0.001, "hover_z": 0.03, "mate_force_band": (0.5, 3.0), "seated_force_band": (3.0, 8.0), "insertion_z_target": 0.012, "hysteresis_steps": 3, "fine_align_timeout_s": 8.0, "control_rate_hz": 100.0},
    "pick_place": {"contact_force_threshold": 3.0, "align_xy_threshold": 0.005, "hover_z": 0.05, "mate_force_band": (0.5, 10.0), "seated_force_band": (3.0, 12.0), "insertion_z_target": 0.0, "hysteresis_steps": 3, "fine_align_timeout_s": 5.0, "control_rate_hz": 100.0},
}


@dataclass(frozen=True)
class PhaseRules:
    """A transition is made after ``hysteresis`` hits in a row; phase 1 goes back to 0 once it has lasted over ``timeout_steps``. Users pass transitions of their own."""

    hysteresis: int = 3
    timeout_steps: int = 500
    transitions: tuple[tuple[int, str, int], ...] = TRANSITIONS

    @property
    def inputs(self) -> list[str]:
        return list(dict.fromkeys(s for _, s, _ in self.transitions))

    schema = "from_phase int, phase int"

    def start(self) -> list[float]:
        """Phase, steps so far, the step at which phase 1 was first evaluated (-1: not yet), and a count a transition."""
        return [0.0, 0.0, -1.0] + [0.0] * len(self.transitions)

    def step(self, s: list[float], row: tuple) -> tuple:
        before, hits = int(s[0]), dict(zip(self.inputs, row))
        s[1] += 1
        if before == 1:
            s[2] = s[1] if s[2] < 0 else s[2]
            if s[1] - s[2] > self.timeout_steps:  # nothing else is evaluated, counts stay
                s[0], s[2] = 0.0, -1.0
                return before, 0
        else:
            s[2] = -1.0
        for k, (source, signal, target) in enumerate(self.transitions):
            if s[0] != source or target == source:
                continue
            s[3 + k] = s[3 + k] + 1 if hits[signal] else 0.0
            if s[3 + k] >= self.hysteresis:
                s[3 + k] = 0.0
                if target in LEGAL_NEXT.get(source, ()):
                    s[0] = float(target)
        return before, int(s[0])


@dataclass(frozen=True)
class LowPass:
    """Second-order low-pass from a state of zeros; the value itself where the cutoff isn't positive. A null value gives null and leaves the state alone."""

    column: str
    cutoff: float
    rate: float
    schema = "filtered double"

    @property
    def inputs(self) -> list[str]:
        return [self.column]

    def start(self) -> list[float]:
        return [0.0] * 4

    def step(self, s: list[float], row: tuple) -> tuple:
        x = row[0]
        if x is None or self.cutoff <= 0:
            return (x,)
        b0, b1, b2, a1, a2 = butterworth(self.cutoff, self.rate)
        y = b0 * x + b1 * s[0] + b2 * s[1] - a1 * s[2] - a2 * s[3]
        s[0], s[1], s[2], s[3] = x, s[0], y, s[2]
        return (y,)


class _Machine:
    """A rule as a machine for ``folded``."""

    def __init__(self, rule):
        self.rule, self.state = rule, rule.start()

    def step(self, row: tuple) -> list[tuple]:
        return [(*row[:2], *self.rule.step(self.state, row[2:]))]

    def end(self) -> list[tuple]:
        return []


def in_batch(rows: DataFrame, rule) -> DataFrame:
    """(key, ts, ord, inputs of the rule) -> (key, ts, ord, what the rule gives), in order of ts and ord within each key."""
    return folded(rows.select("key", "ts", "ord", *rule.inputs), ["key"], ["ts", "ord"], lambda: _Machine(rule), f"key {dict(rows.dtypes)['key']}, ts long, ord long, {rule.schema}")


def _renewed(handle: StatefulProcessorHandle, last_ms: int, idle_ms: int) -> None:
    """One timer a key: ``idle_ms`` after its last row."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(last_ms + idle_ms)


class RuleProcessor(StatefulProcessor):
    """Keeps a rule's state and the last time and place of each key; with ``idle_ms`` until the watermark is that far beyond the key's last row (its ``seen_ms``)."""

    def __init__(self, rule, idle_ms: int | None = None):
        self.rule, self.idle_ms, self.names = rule, idle_ms, [c.split()[0] for c in rule.schema.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("machine", "state array<double>, ts long, ord long, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.saved.get() if self.saved.exists() else None
        state, last, ms = (list(old[0]), (old[1], old[2]), old[3]) if old else (self.rule.start(), (-(2**63), -(2**63)), 0)
        pdf = pd.concat(rows).sort_values(["ts", "ord"])
        out = []
        for ts, ord_, *given in pdf[["ts", "ord", *self.rule.inputs]].itertuples(index=False):
            late = (ts, ord_) < last
            found = (None,) * len(self.names) if late else self.rule.step(state, tuple(None if isinstance(x, float) and x != x else x for x in given))
            last = max(last, (ts, ord_))
            out.append((key[0], ts, ord_, *found, late))
        if self.idle_ms is not None and len(pdf):
            ms = max(ms, int(pdf["seen_ms"].max()))
            _renewed(self.handle, ms, self.idle_ms)
        if out:
            self.saved.update((state, int(last[0]), int(last[1]), ms))
        frame = pd.DataFrame(out, columns=["key", "ts", "ord", *self.names, "late"])
        yield frame.astype({c: "Int32" for c in self.names if f"{c} int" in self.rule.schema})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.saved.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def on_stream(rows: DataFrame, rule, time: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """As ``in_batch`` on a stream, with ``late``; needs the RocksDB state store.

    With ``time``, a timestamp column that has a watermark, and ``idle_ms``, a key's state goes once the watermark is so far beyond its last row; should the key come again, it starts anew. The
    watermark serves for nothing else, but Spark drops rows that are older than it.
    """
    schema = f"key {dict(rows.dtypes)['key']}, ts long, ord long, {rule.schema}, late boolean"
    if (time is None) != (idle_ms is None):
        raise ValueError("time and idle_ms go together")
    timed = [] if time is None else [F.col(time), F.unix_millis(time).alias("seen_ms")]
    mode = "None" if time is None else "EventTime"
    return rows.select("key", "ts", "ord", *rule.inputs, *timed).groupBy("key").transformWithStateInPandas(RuleProcessor(rule, idle_ms), outputStructType=schema, outputMode="Append", timeMode=mode)


class TraceProcessor(StatefulProcessor):
    """Collects the steps of a run, and gives its trace out once, when the run has ended: ``idle_ms`` after its last step by the watermark."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps, self.last = handle.getListState("steps", "step long, phase int"), handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms = self.last.get()[0] if self.last.exists() else 0
        for pdf in rows:
            self.steps.appendList([(int(a), int(b)) for a, b in zip(pdf["step"], pdf["phase"])])
            ms = max(ms, int(pdf["seen_ms"].max()))
        self.last.update((ms,))
        _renewed(self.handle, ms, self.idle_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        steps = sorted(tuple(x) for x in self.steps.get())
        self.steps.clear()
        self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "trace": [",".join(str(p) for _, p in steps)]})

    def close(self) -> None:
        pass


def phase_traces_stream(steps: DataFrame, time: str, idle_ms: int) -> DataFrame:
    """J6 on a stream: (key, step, phase, time: with a watermark) -> (key, trace), one row a run when it ends, that is when no step came for ``idle_ms``; its steps leave the state then."""
    schema = f"key {dict(steps.dtypes)['key']}, trace string"
    rows = steps.select("key", F.col("step").cast("long").alias("step"), F.col("phase").cast("int").alias("phase"), F.col(time), F.unix_millis(time).alias("seen_ms"))
    return rows.groupBy("key").transformWithStateInPandas(TraceProcessor(idle_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def signals(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Predicates as columns, so that a machine sees booleans only; null is false."""
    return rows.withColumns({name: F.coalesce(test, F.lit(False)) for name, test in tests.items()})


def phase_tests(pose: Column, velocity: Column, gripper: Column, force_z: Column, target: Column, task: str = "default", **limits) -> dict[str, Column]:
    """The predicates of the phase machine over arrays ``pose`` and ``target`` (x, y, z, ...; a null target is never met) and ``velocity``."""
    c = LIMITS[task] | limits
    at = lambda v, k: F.try_element_at(v, F.lit(k))
    apart = F.sqrt(F.pow(at(pose, 1) - at(target, 1), 2) + F.pow(at(pose, 2) - at(target, 2), 2))
    speed = F.sqrt(F.pow(at(velocity, 1), 2) + F.pow(at(velocity, 2), 2) + F.pow(at(velocity, 3), 2))
    force, closed = F.abs(force_z), gripper > 0.5
    return {
        "align": (apart < c["align_xy_threshold"]) & (at(pose, 3) < c["hover_z"]),
        "contact": (force > c["contact_force_threshold"]) | closed,
        "mate": closed & force.between(*c["mate_force_band"]),
        "seated": (at(pose, 3) <= at(target, 3) + c["insertion_z_target"]) & force.between(*c["seated_force_band"]),
        "retract": (gripper < 0.5) & (speed > 0.01),
    }


def rules_of(task: str = "default", **limits) -> PhaseRules:
    """The phase machine with a task's hysteresis and timeout."""
    c = LIMITS[task] | limits
    return PhaseRules(int(c["hysteresis_steps"]), int(c["fine_align_timeout_s"] * c["control_rate_hz"]))


def phases_batch(rows: DataFrame, rules: PhaseRules = PhaseRules()) -> DataFrame:
    """J1, batch: (key, ts, ord, signals) -> (key, ts, ord, from_phase, phase). One key's rows are one robot's run."""
    return in_batch(rows, rules)


def phases_stream(rows: DataFrame, rules: PhaseRules = PhaseRules(), time: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """J1 on a stream: the same, with ``late``; for ``time`` and ``idle_ms`` see ``on_stream``."""
    return on_stream(rows, rules, time, idle_ms)


def phase_changes(phases: DataFrame) -> DataFrame:
    """J5, batches and streams: rows at which the phase differs from the one before (0 at first)."""
    return phases.where(F.col("from_phase") != F.col("phase"))


def checked_actions(rows: DataFrame, **limits) -> DataFrame:
    """Rows (action, phase, force_z) with ``reason``; works on batches and streams alike."""
    return rows.withColumn("reason", unsafe_reason(F.col("action"), F.col("phase"), F.col("force_z"), **limits))


def split_writer(passes: str, good_path: str, rejects_path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows for which ``passes`` holds go to one folder, all others (also where it is null) to the rejects; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        ok = F.coalesce(F.expr(passes), F.lit(False))
        for rows, path in ((batch.where(ok), good_path), (batch.where(~ok), rejects_path)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return write


@cache
def butterworth(cutoff: float, rate: float) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of a second-order low-pass by the bilinear transform."""
    k = math.tan(math.pi * cutoff / rate)
    norm = 1 / (1 + math.sqrt(2) * k + k * k)
    return k * k * norm, 2 * k * k * norm, k * k * norm, 2 * (k * k - 1) * norm, (1 - math.sqrt(2) * k + k * k) * norm


def low_passed(rows: DataFrame, column: str, cutoff: float, rate: float) -> DataFrame:
    """J4, batch: (key, ts, ord, column) -> (key, ts, ord, filtered). ``on_stream(rows, LowPass(...))`` is the same on a stream."""
    return in_batch(rows.withColumn(column, F.col(column).cast("double")), LowPass(column, cutoff, rate))


def phase_trace(steps: DataFrame) -> DataFrame:
    """(key, step, phase) -> the ordered phases of each run as text. A run's trace is one row, so it must fit into one. On a stream ``phase_traces_stream`` gives each out once and forgets it."""
    listed = F.array_sort(F.collect_list(F.struct("step", "phase")))
    return steps.groupBy("key").agg(F.concat_ws(",", F.transform(listed, lambda x: x["phase"].cast("string"))).alias("trace"))
