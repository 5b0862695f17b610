"""Episodes: cutting a telemetry log by start and end events.

Telemetry is (dataset, ord, ts, ...), events are (dataset, ord, ts, name with values start and end). Order is by (ts, ord). An episode is a stretch of telemetry rows,
told by their numbers: where an event falls between rows, it is its nearest rows that count, not its time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof
from .intervals import joined
from .scans import scanned
from .stored import stored

STARTS = ("episode_start",)
ENDS = ("episode_end", "episode_stop", "episode_finish", "episode_finished")


def normalised_events(raw: DataFrame, name: Column, starts=STARTS, ends=ENDS) -> DataFrame:
    """A2: known events with a time, their names trimmed and lower-cased to start or end."""
    clean = F.lower(F.trim(name))
    kind = F.when(clean.isin(*starts), "start").when(clean.isin(*ends), "end")
    return raw.withColumn("name", kind).where("name is not null and ts is not null")


HOUR = 3.6e12


def numbered_rows(telemetry: DataFrame, block: float = HOUR) -> DataFrame:
    """Telemetry with ``row``, the number of each row in its dataset from 0. ``block``: see ``scanned``, an hour in ns."""
    return scanned(telemetry, ["dataset"], ["ts", "ord"], block, place="row")


def boundaries(rows: DataFrame, events: DataFrame, block: float = HOUR) -> DataFrame:
    """(dataset, episode, start_row, end_row, mode): episodes as half-open stretches of the ``rows`` of ``numbered_rows``, numbered from 0 in each dataset.

    A dataset with starts and ends is *paired*: each start, from the first row at or after it, goes with the event that follows. A start ends it before the first row at or after
    that start; an end ends it with the row nearest to it, the later one of two as near; the last start without an end goes up to the last row's time. Ends that no
    start goes before count for nothing, and episodes without rows are left out before they are numbered. A dataset with events of one kind only is *split* at the first
    row at or after each event; rows before the first one are an episode too. Any other dataset, also one whose pairs all are empty, is *whole*: one episode. Events of datasets without rows count for nothing.
    What events and datasets come to (a few rows each) is stored, see ``stored``.
    """
    sizes = rows.groupBy("dataset").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    kinds = events.groupBy(F.col("dataset").alias("__d")).agg(F.max((F.col("name") == "start").cast("int")).alias("starts"), F.max((F.col("name") == "end").cast("int")).alias("ends"))
    modes = sizes.join(kinds.hint("merge"), F.col("dataset") == F.col("__d"), "left").drop("__d")
    modes = modes.withColumn("mode", F.when((F.col("starts") == 1) & (F.col("ends") == 1), "paired").when(F.col("starts").isNotNull(), "split").otherwise("whole")).drop("starts", "ends")
    modes = stored(modes)
    walked = scanned(events.select("dataset", "ts", "ord", "name"), ["dataset"], ["ts", "ord"], block, after={"next_name": F.col("name"), "next_ts": F.col("ts")})
    known = walked.join(modes.select(F.col("dataset").alias("__d"), "n", "last_ts", "mode").hint("merge"), F.col("dataset") == F.col("__d")).drop("__d")
    # where each start, end and split point stands among the rows
    starts = known.where("mode = 'paired' and name = 'start'").withColumn("end_ts", F.coalesce("next_ts", "last_ts")).withColumn("nearest", F.coalesce(F.col("next_name") == "end", F.lit(True)))
    point = lambda side, ts: F.struct(F.lit(side).alias("side"), F.col(ts).alias("at"))
    asked = starts.select("dataset", "n", "mode", "nearest", F.struct("ts", "ord").alias("event"), F.explode(F.array(point("start", "ts"), point("end", "end_ts"))).alias("p"))
    asked = asked.unionByName(known.where("mode = 'split'").select("dataset", "n", "mode", F.lit(False).alias("nearest"), F.struct("ts", "ord").alias("event"), point("start", "ts").alias("p")))
    left = asked.select("dataset", F.col("p")["at"].alias("ts"), F.struct("n", "mode", "nearest", "event", F.col("p")["side"].alias("side")).alias("ord"))
    met = asof.around(left, rows, "row", block)
    first = F.coalesce("after_row", "n")
    close = F.when(F.col("after_row").isNull(), F.col("n")).when(F.col("before_row").isNull(), F.lit(1)).when(F.col("after_ts") - F.col("ts") <= F.col("ts") - F.col("before_ts"), F.col("after_row") + 1).otherwise(F.col("after_row"))
    placed = met.select("dataset", "ts", "ord.*", "after_row", "after_ts", "before_row", "before_ts")
    placed = placed.withColumn("row", F.when(F.col("nearest") & (F.col("side") == "end"), close).otherwise(first)).select("dataset", "n", "mode", "event", "side", "row")
    placed = stored(placed)
    pairs = placed.where("mode = 'paired'").groupBy("dataset", "event").agg(F.max(F.when(F.col("side") == "start", F.col("row"))).alias("start_row"), F.max(F.when(F.col("side") == "end", F.col("row"))).alias("end_row"))
    pairs = pairs.where("end_row > start_row").select("dataset", F.col("event.ts").alias("ts"), F.col("event.ord").alias("ord"), "start_row", "end_row")
    paired = scanned(pairs, ["dataset"], ["ts", "ord"], block, place="episode").select("dataset", "episode", "start_row", "end_row", F.lit("paired").alias("mode"))
    ends = modes.where("mode = 'split'").select("dataset", F.explode(F.array(F.lit(0).cast("long"), "n")).alias("start_row"))
    points = placed.where("mode = 'split'").select("dataset", F.col("row").alias("start_row")).unionByName(ends).distinct()
    split = scanned(points, ["dataset"], ["start_row"], 1e5, after={"end_row": F.col("start_row")}, place="episode").where("end_row is not null")
    split = split.select("dataset", "episode", "start_row", "end_row", F.lit("split").alias("mode"))
    kept = pairs.select(F.col("dataset").alias("__d")).distinct()
    whole = modes.where("mode = 'whole'").unionByName(modes.where("mode = 'paired'").join(kept.hint("merge"), F.col("dataset") == F.col("__d"), "left_anti"))
    whole = whole.select("dataset", F.lit(0).cast("long").alias("episode"), F.lit(0).cast("long").alias("start_row"), F.col("n").alias("end_row"), F.lit("whole").alias("mode"))
    return paired.unionByName(split).unionByName(whole)


def rows_of_boundaries(rows: DataFrame, bounds: DataFrame, bucket: int = 10_000) -> DataFrame:
    """The ``rows`` of ``numbered_rows`` with the episodes of ``boundaries`` that they lie in; a row may lie in two. ``bucket``: about how many rows an episode has."""
    e = bounds.select(F.col("dataset").alias("__k"), "episode", "start_row", (F.col("end_row") - 1).alias("__last"))
    inside = F.col("row").between(F.col("start_row"), F.col("__last"))
    return joined(rows, e, "dataset", "row", bucket, inside, "start_row", "__last").drop("__k", "start_row", "__last")


def episode_rows(telemetry: DataFrame, events: DataFrame, block: float = HOUR, bucket: int = 10_000) -> DataFrame:
    """Telemetry rows with their number and the episodes that they lie in, whichever way the dataset's events cut it. The numbered rows are stored (see ``stored``), as they are needed several times."""
    rows = stored(numbered_rows(telemetry, block))
    return rows_of_boundaries(rows, stored(boundaries(rows, events, block)), bucket)


def paired_intervals(events: DataFrame, block: float = HOUR) -> DataFrame:
    """(dataset, start_ts, end_ts, implicit): every start with the time of the next event, whether or not there are rows between. A next start is an implicit end; none at all leaves it open."""
    nxt = scanned(events.select("dataset", "ts", "ord", "name"), ["dataset"], ["ts", "ord"], block, after={"next_name": F.col("name"), "next_ts": F.col("ts")})
    return nxt.where("name = 'start'").select("dataset", F.col("ts").alias("start_ts"), F.col("next_ts").alias("end_ts"), (F.col("next_name") == "start").alias("implicit"))


def numbered(intervals: DataFrame) -> DataFrame:
    """Intervals numbered from 0 in each dataset, by start."""
    return intervals.withColumn("episode", F.row_number().over(Window.partitionBy("dataset").orderBy("start_ts", F.col("end_ts").asc_nulls_last())) - 1)


def rows_between(telemetry: DataFrame, intervals: DataFrame, bucket_s: float = 60.0) -> DataFrame:
    """Telemetry rows with the intervals (dataset, episode, start_ts, end_ts, and ``implicit`` if the end itself may not belong to it) that hold their time; of those that overlap a row meets each.

    A row meets the intervals that touch its bucket of ``bucket_s`` seconds, which should be about as long as an interval; only those that nothing ends meet all later rows.
    """
    implicit = F.col("implicit") if "implicit" in intervals.columns else F.lit(False)
    e = intervals.select(F.col("dataset").alias("__k"), "episode", "start_ts", "end_ts", implicit.alias("implicit"))
    inside = (F.col("ts") >= F.col("start_ts")) & (F.col("end_ts").isNull() | F.when(F.col("implicit"), F.col("ts") < F.col("end_ts")).otherwise(F.col("ts") <= F.col("end_ts")))
    return joined(telemetry, e, "dataset", "ts", bucket_s * 1e9, inside, "start_ts", "end_ts").drop("__k")


def annotator_intervals(events: DataFrame, least_s: float = 1.0, host: str = "ts", block: float = 1e5) -> DataFrame:
    """D3: in file order, a start directly followed by an end, at least ``least_s`` apart by the host's time; numbered from 0: (dataset, episode, start_ts, end_ts, start_host_ts, end_host_ts, duration_s).

    ``host``: the column with the host's time. Only the plain names of a start and an end count here, so other ends are to be left out before. ``block``: events by ord. The rows of an episode are those of ``rows_between``.
    """
    e = events.select("dataset", "ord", "name", "ts", F.col(host).alias("host"))
    nxt = scanned(e, ["dataset"], ["ord"], block, after={"next_name": F.col("name"), "end_ts": F.col("ts"), "end_host_ts": F.col("host")})
    pairs = nxt.where("name = 'start' and next_name = 'end'").withColumn("duration_s", (F.col("end_host_ts") - F.col("host")) / 1e9).where(F.col("duration_s") >= least_s)
    return scanned(pairs, ["dataset"], ["ord"], block, place="episode").select("dataset", "episode", F.col("ts").alias("start_ts"), "end_ts", F.col("host").alias("start_host_ts"), "end_host_ts", "duration_s")


def quality(rows: DataFrame, command: str = "value", width: str = "value", active_command: float = 0.1, active_span: float = 0.002, blank_steps: int = 1000) -> DataFrame:
    """Steps, duration, largest command, width span, activity, the blank flag and its reason of each (dataset, episode)."""
    out = rows.groupBy("dataset", "episode").agg(
        (F.count("*") - 1).alias("steps"), ((F.max("ts") - F.min("ts")) / 1e9).alias("duration_s"),
        F.max(F.abs(F.col(command))).alias("max_command"), (F.max(width) - F.min(width)).alias("span"),
    )
    active = (F.coalesce("max_command", F.lit(0.0)) >= active_command) | (F.coalesce("span", F.lit(0.0)) >= active_span)
    out = out.withColumn("active", active).withColumn("blank", ~F.col("active") & (F.col("steps") <= blank_steps))
    reason = F.format_string("no gripper activity: command %.4f below %.4f, width span %.4f below %.4f, %d steps of at most %d", F.coalesce("max_command", F.lit(0.0)), F.lit(active_command), F.coalesce("span", F.lit(0.0)), F.lit(active_span), "steps", F.lit(blank_steps))
    return out.withColumn("blank_reason", F.when(F.col("blank"), reason))


def episode_report(rows: DataFrame, **thresholds) -> DataFrame:
    """One row an episode with its quality and ``suppressed``, the totals of its dataset (detected, kept, suppressed) and the thresholds beside it."""
    w = Window.partitionBy("dataset")
    out = quality(rows, **thresholds).withColumn("suppressed", F.col("blank"))
    out = out.withColumn("detected_episodes", F.count("*").over(w)).withColumn("suppressed_episodes", F.count_if(F.col("suppressed")).over(w))
    named = {"active_command": 0.1, "active_span": 0.002, "blank_steps": 1000} | {k: v for k, v in thresholds.items() if k not in ("command", "width")}
    return out.withColumn("kept_episodes", F.col("detected_episodes") - F.col("suppressed_episodes")).withColumn("thresholds", F.create_map(*[F.lit(x) for k, v in named.items() for x in (k, float(v))]))


def steps(rows: DataFrame) -> DataFrame:
    """Every row but the last of an episode is a step, numbered from 0."""
    w = Window.partitionBy("dataset", "episode").orderBy("ts", "ord")
    return rows.withColumn("next_ts", F.lead("ts").over(w)).withColumn("step", F.row_number().over(w) - 1).where("next_ts is not null")


def long_enough(rows: DataFrame, least_s: float = 2.0) -> DataFrame:
    """Rows of episodes that last at least ``least_s`` seconds."""
    ok = rows.groupBy(F.col("dataset").alias("d"), F.col("episode").alias("e")).agg(((F.max("ts") - F.min("ts")) / 1e9).alias("s")).where(F.col("s") >= least_s)
    return rows.join(ok.drop("s").hint("merge"), (F.col("dataset") == F.col("d")) & (F.col("episode") == F.col("e")), "left_semi")


def limited(rows: DataFrame, max_episodes: int | None = None, max_steps: int | None = None) -> DataFrame:
    """The first episodes, and the first rows of each."""
    out = rows if max_episodes is None else rows.where(F.col("episode") < max_episodes)
    if max_steps is None:
        return out
    w = Window.partitionBy("dataset", "episode").orderBy("ts", "ord")
    return out.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= max_steps).drop("__k")


def without_episodes(sidecar: DataFrame, deleted: DataFrame, block: float = 1e5) -> DataFrame:
    """H5: rows of deleted (dataset, episode) go and later episodes move down by the number of deleted ones before them.

    Deletions and rows are scanned together in order of their episodes, ``block`` episodes a block: the deletions so far are a running sum, so no list of them stands on a row. Each sidecar
    of a dataset (annotations, trims, subtasks) is shifted by the same deletions. A row without an episode stays as it is.
    """
    gone = deleted.where("episode is not null").select("dataset", "episode").distinct()
    rows = sidecar.select("dataset", "episode", F.struct(*sidecar.columns).alias("__r"), F.lit(1).alias("__o"))
    both = rows.unionByName(gone.select(F.col("dataset").cast(sidecar.schema["dataset"].dataType).alias("dataset"), F.col("episode").cast(sidecar.schema["episode"].dataType).alias("episode"), F.lit(None).cast(rows.schema["__r"].dataType).alias("__r"), F.lit(0).alias("__o")))
    is_gone = F.col("__o") == 0
    met = scanned(both, ["dataset"], ["episode", "__o"], block, running={"__before": is_gone.cast("int")}, last={"__last": F.when(is_gone, F.col("episode"))})
    kept = met.where((F.col("__o") == 1) & (F.col("__last").isNull() | F.col("episode").isNull() | (F.col("__last") != F.col("episode"))))
    shifted = F.col("__r")["episode"] - F.when(F.col("episode").isNull(), 0).otherwise(F.col("__before"))
    return kept.select(*[shifted.cast(sidecar.schema[c].dataType).alias(c) if c == "episode" else F.col("__r")[c].alias(c) for c in sidecar.columns])


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """A5: the newest row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def upserted(existing: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """H4: annotations (dataset, episode, task, annotated_at) with those of ``new`` (dataset, episode, task) put in their place, stamped with ``at``; of several new ones of an episode the last by task."""
    newest = new.groupBy("dataset", "episode").agg(F.max("task").alias("task")).withColumn("annotated_at", at)
    kept = existing.join(newest.select(F.col("dataset").alias("__d"), F.col("episode").alias("__e")).hint("merge"), (F.col("dataset") == F.col("__d")) & (F.col("episode") == F.col("__e")), "left_anti")
    return kept.select("dataset", "episode", "task", "annotated_at").unionByName(newest)
