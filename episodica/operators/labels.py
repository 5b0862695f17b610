"""Phase segments: looking them up, densifying, validating and writing them back. Segments are (key.., pos, phase, start_t, end_t, confidence)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import phase_name, user_message
from . import asof
from .intervals import joined

# Phases that may follow each phase, and those that each task's annotation should have.
LEGAL_NEXT = {0: (0, 1), 1: (0, 1, 2), 2: (2, 3), 3: (3, 4), 4: (4,)}
EXPECTED = {"pick_place": (0, 1, 2, 3, 4), "msd_plug": (0, 1, 2, 3, 4)}


def nearest_phase(rows: DataFrame, phases: DataFrame, key: str, bucket: float) -> DataFrame:
    """For each row (key, ts, ord) the first phase (by pos) whose closed interval holds it, else the one with the nearest edge.

    ``bucket``: about the length of a phase. Only rows that no phase holds look for the nearest edges, the last one before and the first one after; they do so by blocks of about
    a hundred phases (``asof.around``), so rows and phases of a key are never paired, and no task holds a whole key. Edges and what looks for them are dealt to a given number of
    partitions (spark.sql.shuffle.partitions): they compress so well that few large tasks would hold them otherwise.
    """
    p = phases.select(F.col(key).alias("__k"), "pos", "phase", "start_t", "end_t")
    inside = (F.col("ts") >= F.col("start_t")) & (F.col("ts") <= F.col("end_t"))
    # of plain values, so that hashing does: a least struct would have all rows sorted once more on either side of the shuffle
    least = [F.min("pos").alias("pos"), F.min_by("phase", "pos").alias("phase")]
    first = joined(rows.select(key, "ts", "ord"), p, key, "ts", bucket, inside, "start_t", "end_t", "left").groupBy(key, "ts", "ord").agg(*least)
    ends = phases.select(F.col(key).alias("dataset"), F.explode(F.array("start_t", "end_t")).alias("ts"), "pos", "phase").where("ts is not null")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edge = ends.repartition(parts, "dataset", "ts").groupBy("dataset", "ts").agg(*least)
    left = first.where("pos is null").select(F.col(key).alias("dataset"), "ts", "ord")
    met = asof.around(left, edge.select("dataset", "ts", F.struct("pos", "phase").alias("e"), F.lit(0).cast("long").alias("ord")), "e", 100.0 * bucket, parts)
    choice = lambda s: F.when(F.col(f"{s}_e").isNotNull(), F.struct(F.abs(F.col("ts") - F.col(f"{s}_ts")).alias("d"), F.col(f"{s}_e")["pos"].alias("pos"), F.col(f"{s}_e")["phase"].alias("phase")))
    near = met.select(F.col("dataset").alias(key), "ts", "ord", F.least(choice("before"), choice("after"))["phase"].alias("phase"))
    return first.where("pos is not null").select(key, "ts", "ord", "phase").unionByName(near)


def half_open_phase(rows: DataFrame, segments: DataFrame, key: str, bucket: float) -> DataFrame:
    """The phase with start_t <= ts < end_t, or -1; ``bucket``: about the length of a segment."""
    s = segments.select(F.col(key).alias("__k"), "phase", "start_t", "end_t", "pos")
    hit = (F.col("ts") >= F.col("start_t")) & (F.col("ts") < F.col("end_t"))
    return joined(rows, s, key, "ts", bucket, hit, "start_t", "end_t", "left").groupBy(key, "ts", "ord").agg(F.coalesce(F.min_by("phase", "pos"), F.lit(-1)).alias("phase"))


def densified(segments: DataFrame, episodes: DataFrame, key: str, fps: float) -> DataFrame:
    """(key, frame_idx, phase) for n_frames of each episode: the last segment begun at frame/fps, before the first one the first.

    Each segment is exploded to the frames from its first one up to that of the next segment, so nothing is looked up frame by frame.
    """
    w = Window.partitionBy(key).orderBy("start_t", "pos")
    guess = F.ceil(F.col("start_t") * fps).cast("long")
    # the first frame whose time reaches the start, whatever the product was rounded to
    first = guess + F.when((guess - 1) / fps >= F.col("start_t"), -1).when(guess / fps < F.col("start_t"), 1).otherwise(0)
    s = segments.select(key, "pos", "phase", "start_t").withColumn("__f", first)
    s = s.withColumn("__a", F.when(F.row_number().over(w) == 1, 0).otherwise(F.greatest("__f", F.lit(0)))).withColumn("__z", F.lead("__f").over(w))
    s = s.join(episodes.select(F.col(key).alias("__k"), "n_frames").hint("merge"), F.col(key) == F.col("__k"))
    end = F.least(F.coalesce("__z", "n_frames"), "n_frames") - 1
    return s.where(end >= F.col("__a")).select(key, F.explode(F.sequence(F.col("__a").cast("long"), end.cast("long"))).alias("frame_idx"), "phase")


def written_back(frames: DataFrame, labels: DataFrame, key: str, columns: tuple[str, ...] = ("phase",)) -> DataFrame:
    """Columns of labels (key, frame_idx, phase, ...) put on frames (key, frame_idx): too many labels are cut off, of too few the last one repeats."""
    n = labels.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    at = frames.join(n.hint("merge"), F.col(key) == F.col("__k"), "left").withColumn("__at", F.least(F.col("frame_idx"), F.col("__n") - 1)).drop("__k")
    l = labels.select(F.col(key).alias("__lk"), F.col("frame_idx").alias("__li"), *columns)
    return at.join(l.hint("merge"), (F.col(key) == F.col("__lk")) & (F.col("__at") == F.col("__li")), "left").drop("__lk", "__li", "__at", "__n")


def registered_columns(infos: DataFrame, columns: tuple[str, ...] = ("phase", "subtask")) -> DataFrame:
    """H7: info rows (dataset, extra_columns: array) with the written columns added, each once."""
    return infos.withColumn("extra_columns", F.array_distinct(F.concat(F.coalesce("extra_columns", F.array().cast("array<string>")), F.array(*map(F.lit, columns)))))


def _issue(rows: DataFrame, key: str, severity: str, rule: str, message: Column) -> DataFrame:
    """What a rule gives: key, severity, rule, message. Users' own rules are functions that give the same."""
    return rows.select(F.col(key), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), message.alias("message"))


def schema_issues(segments: DataFrame, key: str) -> DataFrame:
    """a phase out of range, a start not before the end, a confidence out of [0, 1], or, where there are such columns, a phase_name that isn't the phase's own."""
    bad = ~F.col("phase").between(0, 4) | (F.col("start_t") >= F.col("end_t")) | ~F.col("confidence").between(0, 1)
    if "phase_name" in segments.columns:
        bad = bad | ~(F.col("phase_name") == phase_name(F.col("phase")))
    return _issue(segments.where(F.coalesce(bad, F.lit(True))), key, "error", "schema", F.format_string("segment %s breaks a rule of its fields", F.col("pos").cast("string")))


def annotation_issues(annotations: DataFrame, segments: DataFrame, key: str, tasks: tuple[str, ...] = ("pick_place", "msd_plug")) -> DataFrame:
    """annotations (key, task, overall_confidence) of an unknown task, with a confidence out of [0, 1], or without segments."""
    n = segments.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    rows = annotations.join(n.hint("merge"), F.col(key) == F.col("__k"), "left")
    problem = F.when(~F.coalesce(F.col("task").isin(*tasks), F.lit(False)), "unknown task").when(~F.coalesce(F.col("overall_confidence").between(0, 1), F.lit(False)), "confidence out of range").when(F.col("__n").isNull(), "no segments")
    return _issue(rows.where(problem.isNotNull()), key, "error", "schema", problem)


def contiguity_issues(segments: DataFrame, durations: DataFrame, key: str, gap: float = 0.05) -> DataFrame:
    """F16: the first broken rule of each key: the first start at 0, the last end at the duration, then pair by pair neighbours within ``gap`` and starts in order."""
    w = Window.partitionBy(key).orderBy("pos")
    d = durations.select(F.col(key).alias("__k"), F.col("duration").alias("__duration"))
    s = segments.join(d.hint("merge"), F.col(key) == F.col("__k"))
    s = s.withColumn("__at", F.row_number().over(w)).withColumn("__end", F.lag("end_t").over(w)).withColumn("__start", F.lag("start_t").over(w)).withColumn("__next", F.lead("start_t").over(w))
    ranked = lambda test, order, rule: F.when(test, F.struct(F.lit(order).alias("o"), F.col("__at").alias("at"), F.lit(rule).alias("rule")))
    found = F.coalesce(
        ranked((F.col("__at") == 1) & (F.abs("start_t") > gap), 0, "start"),
        ranked(F.col("__next").isNull() & (F.abs(F.col("end_t") - F.col("__duration")) > gap), 1, "end"),
        ranked(F.abs(F.col("start_t") - F.col("__end")) > gap, 2, "gap"),
        ranked(F.col("start_t") < F.col("__start"), 2, "order"),
    )
    # of the last segment both its end and its start may be wrong; its end comes first in any case
    first = s.withColumn("__x", found).where("__x is not null").groupBy(key).agg(F.min("__x").alias("__x"))
    return first.select(key, F.lit("error").alias("severity"), F.concat(F.lit("contiguity_"), "__x.rule").alias("rule"), F.format_string("%s at segment %d", "__x.rule", F.col("__x.at") - 1).alias("message"))


def transition_issues(segments: DataFrame, key: str) -> DataFrame:
    """neighbours whose phases may not follow one another."""
    legal = F.lit(False)
    prev = F.col("__prev")
    for a, nexts in LEGAL_NEXT.items():
        legal = legal | ((prev == a) & F.col("phase").isin(*nexts))
    rows = segments.withColumn("__prev", F.lag("phase").over(Window.partitionBy(key).orderBy("pos"))).where(prev.isNotNull() & ~legal)
    return _issue(rows, key, "error", "transition_legality", F.format_string("phase %d can't follow phase %d at %.3f s", F.col("phase").cast("int"), prev.cast("int"), F.col("start_t").cast("double")))


def short_issues(segments: DataFrame, key: str, least: float = 0.1, sure: float = 0.95) -> DataFrame:
    """short segments of little confidence."""
    rows = segments.where((F.col("end_t") - F.col("start_t") < least) & (F.col("confidence") < sure))
    return _issue(rows, key, "warning", "duration_sanity", F.format_string("%.3f s to %.3f s with a confidence of %.2f", *[F.col(c).cast("double") for c in ("start_t", "end_t", "confidence")]))


def contact_issues(segments: DataFrame, frames: DataFrame, key: str, force: float = 3.0, apart: float = 0.2, contact: int = 2) -> DataFrame:
    """the first contact segment (by pos) starts more than ``apart`` from the first frame (key, t, force, closed) with force, or else the first closing."""
    w = Window.partitionBy(key).orderBy("t")
    onset = frames.withColumn("closing", (F.col("closed") == 1) & (F.lag("closed").over(w) == 0)).groupBy(F.col(key).alias("__k")).agg(F.coalesce(F.min(F.when(F.col("force") > force, F.col("t"))), F.min(F.when(F.col("closing"), F.col("t")))).alias("onset"))
    first = segments.where(F.col("phase") == contact).groupBy(key).agg(F.min_by("start_t", "pos").alias("s"))
    rows = first.join(onset.hint("merge"), F.col(key) == F.col("__k")).where(F.abs(F.col("s") - F.col("onset")) > apart)
    return _issue(rows, key, "warning", "fsm_crosscheck", F.format_string("contact at %.3f s, by force or gripper at %.3f s", F.col("s").cast("double"), F.col("onset").cast("double")))


def coverage_issues(segments: DataFrame, key: str, expected: tuple[int, ...] = (0, 1, 2, 3, 4), task: str | None = None) -> DataFrame:
    """keys that lack one of the expected phases; with a ``task`` column those of the key's task, and none of an unknown task."""
    wanted = F.array(*map(F.lit, expected))
    if task:
        by_task = F.create_map(*[x for t, p in EXPECTED.items() for x in (F.lit(t), F.array(*map(F.lit, p)))])
        wanted = F.coalesce(F.try_element_at(by_task, F.min(task)), F.array().cast("array<int>"))
    rows = segments.groupBy(key).agg(F.array_sort(F.array_except(wanted, F.collect_set(F.col("phase").cast("int")))).alias("m")).where(F.size("m") > 0)
    return _issue(rows, key, "warning", "coverage", F.concat(F.lit("missing phases: "), F.concat_ws(", ", F.transform("m", phase_name))))


def verdicts(keys: DataFrame, issues: list[DataFrame], key: str) -> DataFrame:
    """for each key the number of issues, whether none is an error, and the list of issues, errors first."""
    all_ = reduce(DataFrame.unionByName, issues)
    n = all_.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("n_issues"), F.count_if(F.col("severity") == "error").alias("n_errors"), F.array_sort(F.collect_list(F.struct("severity", "rule", "message"))).alias("issues"))
    out = keys.select(key).distinct().join(n.hint("merge"), F.col(key) == F.col("__k"), "left")
    return out.select(key, F.coalesce("n_issues", F.lit(0)).alias("n_issues"), (F.coalesce("n_errors", F.lit(0)) == 0).alias("passed"), F.coalesce("issues", F.array().cast("array<struct<severity:string,rule:string,message:string>>")).alias("issues"))


def cyclic_prompts(episodes: DataFrame, prompts: list[str], key: str = "episode") -> DataFrame:
    """Episodes with ``task``, the prompts in turn by their number. The list is short: it is one literal of the plan."""
    return episodes.withColumn("task", F.element_at(F.array(*map(F.lit, prompts)), (F.pmod(F.col(key), F.lit(len(prompts))) + 1).cast("int")))


def gold_examples(gold: DataFrame, most: int = 3) -> DataFrame:
    """Gold rows (task, ord, episode_id, duration_s, annotation: its JSON) -> (task, turns: array of user and assistant texts), the first ``most`` of each task by ord."""
    w = Window.partitionBy("task").orderBy("ord")
    first = gold.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    turn = F.struct("__k", user_message(F.col("task"), F.col("episode_id"), F.col("duration_s")).alias("user"), F.col("annotation").alias("assistant"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["user"].alias("user"), x["assistant"].alias("assistant")))
    return first.groupBy("task").agg(turns.alias("turns"))


def annotation_summary(annotations: DataFrame, segments: DataFrame, key: str, method: str = "method", passed: str = "passed") -> DataFrame:
    """(item, name, n): the number of episodes, of those that passed, of each method, and of the segments of each phase."""
    row = lambda item, name, n: F.struct(F.lit(item).alias("item"), name.cast("string").alias("name"), n.cast("long").alias("n"))
    totals = annotations.agg(F.count("*").alias("a"), F.count_if(F.col(passed)).alias("p")).select(F.explode(F.array(row("episodes", F.lit("all"), F.col("a")), row("episodes", F.lit("passed"), F.col("p")))).alias("x"))
    methods = annotations.groupBy(method).agg(F.count("*").alias("c")).select(row("method", F.col(method), F.col("c")).alias("x"))
    phases = segments.groupBy("phase").agg(F.count("*").alias("c")).select(row("phase", F.coalesce(phase_name(F.when(F.col("phase").between(0, 4), F.col("phase"))), F.lit("unknown")), F.col("c")).alias("x"))
    out = totals.unionByName(methods).unionByName(phases).select("x.*")
    return out.groupBy("item", "name").agg(F.sum("n").alias("n"))


def phase_shares(labels: DataFrame) -> DataFrame:
    """How often each phase occurs, and its share."""
    n = labels.groupBy("phase").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def jittered(frames: DataFrame, offset: Column, key: str = "index") -> DataFrame:
    """The phase of the row ``offset`` places away, places clamped to the table: a self join on the place, no global window."""
    bounds = frames.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    at = frames.crossJoin(F.broadcast(bounds)).withColumn("at", F.greatest("lo", F.least("hi", F.col(key) + offset))).drop("phase", "lo", "hi")
    return at.join(frames.select(F.col(key).alias("other"), "phase"), F.col("at") == F.col("other")).drop("other", "at")


def rebased(clips: DataFrame, start: str = "ep_start", end: str = "ep_end") -> DataFrame:
    """Clip times that start later than the episode's end + 1 s are absolute; they move so that the earliest meets the episode's start."""
    first = F.array_min(F.transform("clips", lambda c: c["start_s"]))
    shift = F.when(first > F.col(end) + 1, first - F.col(start)).otherwise(0.0)
    return clips.withColumn("clips", F.transform("clips", lambda c: F.struct(c["phase"].alias("phase"), (c["start_s"] - shift).alias("start_s"), (c["end_s"] - shift).alias("end_s"))))


def default_layout(episodes: DataFrame, names: tuple[str, ...], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """The episode cut into equal parts, one a phase, times to 4 digits."""
    part = (F.col(end) - F.col(start)) / len(names)
    rows = episodes.select("*", F.posexplode(F.array(*map(F.lit, names))).alias("pos", "phase"))
    return rows.withColumn("part_start", F.bround(F.col(start) + F.col("pos") * part, 4)).withColumn("part_end", F.bround(F.col(start) + (F.col("pos") + 1) * part, 4))
