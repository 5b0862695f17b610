"""Signals of an episode: motion, trims, keyframes, smoothing, thresholds. Rows are (dataset, episode, ts or t, ord, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .folds import folded
from .quantiles import exact_quantiles
from .scans import scanned

EPISODE = ("dataset", "episode")


def by_time(time: str = "ts") -> Window:
    return Window.partitionBy(*EPISODE).orderBy(time, "ord")


def moving(rows: DataFrame, translation: Column, rotation: Column, q: Column, width: Column, limits: tuple = (5e-6, 5e-5, 5e-4, 2e-4)) -> DataFrame:
    """Rows with ``moving``: the commanded translation or rotation, the largest joint step or the gripper step exceeds its limit.

    The joint test is off in episodes whose joint vectors differ in length; the first row has no steps.
    """
    w = by_time()
    all_rows = Window.partitionBy(*EPISODE)
    step = F.array_max(F.zip_with("__q", F.lag("__q").over(w), lambda a, b: F.abs(a - b)))
    same = F.min(F.size("__q")).over(all_rows) == F.max(F.size("__q")).over(all_rows)
    out = rows.withColumn("__q", q).withColumn("__w", width)
    tests = [translation > limits[0], rotation > limits[1], F.when(same, step > limits[2]), F.abs(F.col("__w") - F.lag("__w").over(w)) > limits[3]]
    flag = F.lit(False)
    for t in tests:
        flag = flag | F.coalesce(t, F.lit(False))
    return out.withColumn("moving", flag).drop("__q", "__w")


def trimmed(rows: DataFrame, flag: str) -> DataFrame:
    """Rows from the first to the last flagged one; episodes without a flagged row go."""
    all_rows = Window.partitionBy(*EPISODE)
    place = F.struct("ts", "ord")
    out = rows.withColumn("__a", F.min(F.when(F.col(flag), place)).over(all_rows)).withColumn("__z", F.max(F.when(F.col(flag), place)).over(all_rows))
    return out.where((place >= F.col("__a")) & (place <= F.col("__z"))).drop("__a", "__z")


def trim_counts(rows: DataFrame, flag: str) -> DataFrame:
    """(dataset, episode, n_leading, n_trailing): how many rows stand before the first and after the last flagged one; all lead where none is flagged."""
    place = F.struct("ts", "ord")
    w = Window.partitionBy(*EPISODE)
    out = rows.withColumn("__a", F.min(F.when(F.col(flag), place)).over(w)).withColumn("__z", F.max(F.when(F.col(flag), place)).over(w))
    return out.groupBy(*EPISODE).agg(F.count_if(F.col("__a").isNull() | (place < F.col("__a"))).alias("n_leading"), F.count_if(place > F.col("__z")).alias("n_trailing"))


def judged(rows: DataFrame, moving_col: str, covered_col: str, least_s: float = 2.0) -> DataFrame:
    """Rows with ``reason`` (why cleaning skips their episode: static, no_coverage, too_short, or kept) and ``__in``, whether cleaning keeps the row.

    Windows of one partitioning follow each other, so rows are computed and shuffled once.
    """
    w, place = Window.partitionBy(*EPISODE), F.struct("ts", "ord")
    out = rows.withColumn("__a", F.min(F.when(F.col(moving_col), place)).over(w)).withColumn("__z", F.max(F.when(F.col(moving_col), place)).over(w))
    seen = F.col(covered_col) & (place >= F.col("__a")) & (place <= F.col("__z"))
    out = out.withColumn("__c", F.min(F.when(seen, place)).over(w)).withColumn("__y", F.max(F.when(seen, place)).over(w))
    lasts = (F.col("__y")["ts"] - F.col("__c")["ts"]) / 1e9
    reason = F.when(F.col("__a").isNull(), "static").when(F.col("__c").isNull(), "no_coverage").when(lasts < least_s, "too_short").otherwise("kept")
    out = out.withColumn("reason", reason)
    return out.withColumn("__in", (F.col("reason") == "kept") & (place >= F.col("__c")) & (place <= F.col("__y"))).drop("__a", "__z", "__c", "__y")


def skip_reasons(rows: DataFrame, moving_col: str, covered_col: str, least_s: float = 2.0) -> DataFrame:
    """For each episode why cleaning skips it: static, no_coverage, too_short, or kept."""
    return judged(rows, moving_col, covered_col, least_s).groupBy(*EPISODE).agg(F.first("reason").alias("reason"))


def cleaned(rows: DataFrame, moving_col: str, covered_col: str, least_s: float = 2.0) -> DataFrame:
    """H8: rows that cleaning keeps."""
    return judged(rows, moving_col, covered_col, least_s).where("__in").drop("__in", "reason")


#: Why cleaning skips an episode, or not.
REASONS = ("static", "no_coverage", "too_short", "kept")


def cleaned_and_counted(rows: DataFrame, moving_col: str, covered_col: str, least_s: float = 2.0) -> tuple[DataFrame, Observation]:
    """H8 with E14: rows that cleaning keeps, and an observation of how many episodes there are of each reason, which Spark counts while the kept rows are written."""
    seen = Observation("cleaning")
    first = F.row_number().over(Window.partitionBy(*EPISODE).orderBy("ts", "ord")) == 1
    marked = judged(rows, moving_col, covered_col, least_s).withColumn("__first", first)
    counted = marked.observe(seen, *[F.count_if(F.col("__first") & (F.col("reason") == r)).alias(r) for r in REASONS])
    return counted.where("__in").drop("__in", "reason", "__first"), seen


def cleaned_events(kept: DataFrame) -> DataFrame:
    """H8: the events that cleaning writes anew: (dataset, episode, event, robot_timestamp_ns), a start and an end at the first and last kept row of each episode."""
    ends = kept.groupBy(*EPISODE).agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    event = F.explode(F.array(F.struct(F.lit("episode_start").alias("event"), F.col("a").alias("robot_timestamp_ns")), F.struct(F.lit("episode_end").alias("event"), F.col("z").alias("robot_timestamp_ns"))))
    return ends.select(*EPISODE, event.alias("e")).select(*EPISODE, "e.*")


#: How much of each time column a block of a long episode holds: an hour.
BLOCKS = {"ts": 3.6e12, "t": 3600.0}


def transitions(rows: DataFrame, state: str, time: str = "ts", block: float | None = None) -> DataFrame:
    """rows at which ``state`` differs from the row before, with from_state. Here and below, ``block``: see ``scanned``; however long an episode is, a task holds a block of it."""
    return scanned(rows, [*EPISODE], [time, "ord"], block or BLOCKS[time], before={"from_state": F.col(state)}).where(F.col("from_state") != F.col(state))


def spikes(rows: DataFrame, force: Column, limit: float = 5.0, time: str = "ts", block: float | None = None) -> DataFrame:
    """rows whose force differs from the row before by more than ``limit``."""
    out = scanned(rows.withColumn("__f", force), [*EPISODE], [time, "ord"], block or BLOCKS[time], before={"__p": F.col("__f")})
    return out.withColumn("jump", F.abs(F.col("__f") - F.col("__p"))).where(F.col("jump") > limit).drop("__f", "__p")


def zero_crossings(rows: DataFrame, axes: list[str], time: str = "ts", block: float | None = None) -> DataFrame:
    """rows where the velocity of the episode's dominant axis changes sign; ties of dominance go to the first axis."""
    sums = F.array(*[F.sum(F.abs(F.col(a))) for a in axes])
    main = rows.groupBy(F.col("dataset").alias("__d"), F.col("episode").alias("__e")).agg(sums.alias("__sums")).select("__d", "__e", F.array_position("__sums", F.array_max("__sums")).cast("int").alias("__axis"))
    met = rows.join(main.hint("merge"), F.col("dataset").eqNullSafe(F.col("__d")) & F.col("episode").eqNullSafe(F.col("__e"))).drop("__d", "__e")
    met = met.withColumn("__v", F.element_at(F.array(*map(F.col, axes)), F.col("__axis")))
    out = scanned(met, [*EPISODE], [time, "ord"], block or BLOCKS[time], before={"__p": F.col("__v")})
    return out.where(F.col("__p") * F.col("__v") < 0).withColumn("axis", F.col("__axis") - 1).drop("__axis", "__v", "__p")


class _Uniform:
    """Takes the first time and then the first at least ``every`` after the last taken one."""

    def __init__(self, every: float):
        self.every, self.last = every, None

    def step(self, row: tuple) -> list[tuple]:
        if self.last is None or row[0] >= self.last + self.every:
            self.last = row[0]
            return [row]
        return []

    def end(self) -> list[tuple]:
        return []


def uniform_keyframes(rows: DataFrame, every_s: float = 0.5, time: str = "t") -> DataFrame:
    """(dataset, episode, t): greedily the first frame, then always the first at least ``every_s`` after the last taken one. Rows without a time don't count."""
    times = rows.where(F.col(time).isNotNull()).select(*EPISODE, F.col(time).cast("double").alias("t"))
    kinds = dict(times.dtypes)
    return folded(times, [*EPISODE], ["t"], lambda: _Uniform(every_s), f"dataset {kinds['dataset']}, episode {kinds['episode']}, t double")


# Kinds of keyframes in the order in which they stand at equal times.
KINDS = ("uniform", "gripper", "contact", "velocity")


class _Apart:
    """Drops frames closer than ``apart`` to the last kept one, but an event replaces a kept uniform frame; the last one is held back, as it may be replaced."""

    def __init__(self, apart: float):
        self.apart, self.kept = apart, None

    def step(self, row: tuple) -> list[tuple]:
        t, _, kind = row
        if self.kept is None or t - self.kept[0] >= self.apart:
            out, self.kept = self.end(), (t, kind)
            return out
        if kind != "uniform" and self.kept[1] == "uniform":
            self.kept = (t, kind)
        return []

    def end(self) -> list[tuple]:
        return [] if self.kept is None else [self.kept]


def deduplicated_keyframes(frames: DataFrame, apart_s: float = 0.05) -> DataFrame:
    """(dataset, episode, t, kind): frames closer than ``apart_s`` to the last kept one go, but an event replaces a kept uniform frame.

    Kinds at equal times stand in the order uniform, gripper, contact, velocity. Frames without a time don't count.
    """
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    items = frames.where("t is not null").select(*EPISODE, F.col("t").cast("double").alias("t"), order.alias("o"), "kind")
    kinds = dict(items.dtypes)
    return folded(items, [*EPISODE], ["t", "o"], lambda: _Apart(apart_s), f"dataset {kinds['dataset']}, episode {kinds['episode']}, t double, kind string")


def sampled(rows: DataFrame, sampler, schema: str) -> DataFrame:
    """A user's own function from one episode's rows (a pandas frame in order of ts, ord) to rows of ``schema``; it holds one episode at a time."""
    return rows.groupBy(*EPISODE).applyInPandas(lambda pdf: sampler(pdf.sort_values(["ts", "ord"], ignore_index=True)), schema)


def capped_keyframes(frames: DataFrame, most: int = 60) -> DataFrame:
    """at most ``most`` frames of an episode: events first, then uniform frames, the earliest ones."""
    w = Window.partitionBy(*EPISODE).orderBy(F.col("kind") == "uniform", "t", "kind")
    return frames.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def smoothed(rows: DataFrame, column: str, width: int = 15, time: str = "ts") -> DataFrame:
    """F8: mean over ``width`` rows around each, missing neighbours counting as 0; episodes of at most ``width`` rows stay as they are."""
    half = width // 2
    mean = F.sum(column).over(by_time(time).rowsBetween(-half, half)) / width
    return rows.withColumn("smooth", F.when(F.count("*").over(Window.partitionBy(*EPISODE)) <= width, F.col(column)).otherwise(mean))


def velocity(rows: DataFrame, column: str, time: str = "t") -> DataFrame:
    """central difference (one-sided at the ends) over the step in time since the row before, at least 1e-6."""
    w = by_time(time)
    x, up, down = F.col(column), F.lead(column).over(w), F.lag(column).over(w)
    diff = F.when(up.isNull() & down.isNull(), 0.0).when(down.isNull(), up - x).when(up.isNull(), x - down).otherwise((up - down) / 2)
    return rows.withColumn("v", diff / F.greatest(F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(0.0)), F.lit(1e-6)))


def thresholds(rows: DataFrame, speed: str, z: str, time: str = "t", block: float | None = None) -> DataFrame:
    """speed and height thresholds and the rate in Hz of each episode, by exact quantiles; rate and thresholds are null where an episode has no values of their kind."""
    steps = scanned(rows, [*EPISODE], [time, "ord"], block or BLOCKS[time], before={"__p": F.col(time)}).withColumn("__dt", F.col(time) - F.col("__p"))
    out = rows.select(*EPISODE).distinct()
    for column, values, share in (("speed_limit", rows.withColumn("__s", F.col(speed)), 0.2), ("z_limit", rows.withColumn("__s", F.col(z)), 0.3), ("hz", steps.withColumn("__s", F.col("__dt")), 0.5)):
        of = exact_quantiles(values, [*EPISODE], "__s", {"__q": share}).select(F.col("dataset").alias("__d"), F.col("episode").alias("__e"), F.col("__q").alias(column))
        out = out.join(of.hint("merge"), F.col("dataset").eqNullSafe(F.col("__d")) & F.col("episode").eqNullSafe(F.col("__e")), "left").drop("__d", "__e")
    return out.select(*EPISODE, (F.col("speed_limit") + 0.005).alias("speed_limit"), "z_limit", (1 / F.col("hz")).alias("hz"))


def first_cycle(changes: DataFrame, apart_s: float = 0.1) -> DataFrame:
    """changes (dataset, episode, t, closed): the earliest close that has an open more than ``apart_s`` after it, and the earliest such open.

    A close has such an open if the last open is one; so minima and maxima suffice and no pairs are made.
    """
    w = Window.partitionBy(*EPISODE)
    last = changes.withColumn("__last", F.max(F.when(F.col("closed") == 0, F.col("t"))).over(w))
    first = last.withColumn("__close", F.min(F.when((F.col("closed") == 1) & (F.col("__last") > F.col("t") + apart_s), F.col("t"))).over(w))
    opened = F.min(F.when((F.col("closed") == 0) & (F.col("t") > F.col("__close") + apart_s), F.col("t")))
    return first.groupBy(*EPISODE).agg(F.min("__close").alias("t_close"), opened.alias("t_open")).where("t_close is not null")


def rates(frames: DataFrame, keys: list[str], block: float = 3.6e12) -> DataFrame:
    """(keys, fps): frames a second from the exact median of the positive steps in ns, half to even, at least 1; 30 when there is none."""
    steps = scanned(frames.select(*keys, "ts", "ord"), keys, ["ts", "ord"], block, before={"__p": F.col("ts")}).withColumn("__dt", F.col("ts") - F.col("__p"))
    mid = exact_quantiles(steps.where("__dt > 0"), keys, "__dt", {"m": 0.5}).select(*[F.col(k).alias(f"__m{i}") for i, k in enumerate(keys)], "m")
    same = [F.col(k).eqNullSafe(F.col(f"__m{i}")) for i, k in enumerate(keys)]
    on = same[0] if len(same) == 1 else same[0] & same[1]
    out = frames.select(*keys).distinct().join(mid.hint("merge"), on, "left")
    return out.select(*keys, F.coalesce(F.greatest(F.lit(1), F.bround(1e9 / F.col("m"))), F.lit(30)).cast("long").alias("fps"))


def frame_rate(frames: DataFrame, block: float = 3.6e12) -> DataFrame:
    """(dataset, fps), see ``rates``."""
    return rates(frames, ["dataset"], block)


def dimension_spread(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """E5: population standard deviation of each dimension."""
    return rows.select(key, F.posexplode(vector).alias("dim", "x")).groupBy(key, "dim").agg(F.stddev_pop("x").alias("std"))


def flat_dimensions(spread: DataFrame, least: float) -> DataFrame:
    """E5: dimensions of ``dimension_spread`` that hardly vary: at most 1e-6 for a state, 1e-12 for an action."""
    return spread.where(F.col("std") <= least)


def dominant(rows: DataFrame, text: str) -> DataFrame:
    """The most frequent text of each episode; ties go to the one seen first."""
    counted = rows.where(F.col(text).isNotNull()).groupBy(*EPISODE, text).agg(F.count("*").alias("n"), F.min(F.struct("ts", "ord")).alias("first"))
    best = F.min_by(F.col(text), F.struct((-F.col("n")).alias("n"), "first"))
    return counted.groupBy(*EPISODE).agg(best.alias("task"), F.max("n").alias("n"))
