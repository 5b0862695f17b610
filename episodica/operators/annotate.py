"""Phase segments of pick-and-place episodes from robot signals alone: gripper changes, speed, height and gripper command."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import phase_name
from .signals import EPISODE, first_cycle, smoothed, transitions

# Widths in s and factors of the rules.
LEAST_SEGMENT, SYNTHETIC_ALIGN, CONTACT_BACK, SMOOTHING = 0.15, 0.5, 0.3, 15


def backward_scans(rows: DataFrame) -> DataFrame:
    """rows (dataset, episode, ts, ord, t in s, speed, z, command, closed) -> one row an episode: t_start, t_end, t_close, t_open, align_start, contact_start.

    ``align_start``: looking back from the first closing, over 2 s or 40 % of the time up to it, the frame after the last one that is fast or high; null if there is none or
    it is less than 0.2 s before the closing. ``contact_start``: looking back over 1.5 s, the frame after the last one whose smoothed command is below 0.3;
    null if there is none. Episodes without a closing and an opening after it have nulls.
    """
    w = Window.partitionBy(*EPISODE).orderBy("ts", "ord")
    s = smoothed(rows, "speed", SMOOTHING).withColumnRenamed("smooth", "__speed")
    s = smoothed(s, "command", SMOOTHING).withColumnRenamed("smooth", "__command")
    s = s.withColumn("__i", F.row_number().over(w) - 1).withColumn("__next", F.coalesce(F.lead("t").over(w), F.col("t"))).withColumn("__dt", F.col("t") - F.lag("t").over(w))
    scalars = s.groupBy(*EPISODE).agg(
        F.min("t").alias("t_start"), F.max("t").alias("t_end"), (F.percentile("__speed", 0.2) + 0.005).alias("__fast"), F.percentile("z", 0.3).alias("__high"),
        F.greatest(F.lit(1.0), 1 / F.coalesce(F.median("__dt"), F.lit(1 / 30))).alias("__hz"),
    )
    one = scalars.join(first_cycle(transitions(rows, "closed")).hint("merge"), list(EPISODE), "left")
    r = s.join(one.hint("merge"), list(EPISODE))
    at = F.count_if(F.col("t") < F.col("t_close")).over(Window.partitionBy(*EPISODE))
    r = r.withColumn("__close", at)

    def last(test, seconds):
        low = F.greatest(F.lit(0), F.col("__close") - F.floor(seconds * F.col("__hz")))
        return F.max(F.when(test & (F.col("__i") > low) & (F.col("__i") < F.col("__close")), F.struct("__i", "__next")))

    away = (F.col("__speed") > F.col("__fast") * 2.5) | (F.col("z") > F.col("__high") * 1.5)
    keep = ["t_start", "t_end", "t_close", "t_open"]
    found = r.groupBy(*EPISODE).agg(*[F.first(c).alias(c) for c in keep], last(away, F.least(F.lit(2.0), F.col("t_close") * 0.4))["__next"].alias("a"), last(F.col("__command") < 0.3, F.lit(1.5))["__next"].alias("contact_start"))
    return found.select(*EPISODE, *keep, F.when(F.col("t_close") - F.col("a") >= 0.2, F.col("a")).alias("align_start"), "contact_start")


def phase_segments(scans: DataFrame) -> DataFrame:
    """scans of ``backward_scans`` -> segments (dataset, episode, pos, phase, phase_name, start_t, end_t, confidence), times to 4 digits.

    Boundaries are put into order with 0.15 s between them; without a visible alignment 0.5 s before the contact stand for it; contact and constrained motion
    are left out where there is no room; boundaries within 0.075 s merge. An episode without a cycle is one segment of free motion at 0.5.
    """
    c, gap = F.col, LEAST_SEGMENT
    s = scans.withColumn("contact", F.greatest(F.coalesce("align_start", "t_start") + 0.1, F.least(F.coalesce("contact_start", c("t_close") - CONTACT_BACK), c("t_close") - 0.1)))
    s = s.withColumn("constrained", F.greatest(c("t_close") + gap, c("contact") + gap))
    s = s.withColumn("align", F.coalesce("align_start", F.greatest(c("t_start") + gap, c("contact") - SYNTHETIC_ALIGN)))
    s = s.withColumn("align", F.greatest(F.least(c("align"), c("contact") - gap), c("t_start") + gap))
    s = s.withColumn("contact", F.greatest(c("contact"), c("align") + gap))
    s = s.withColumn("constrained", F.greatest(c("constrained"), c("contact") + gap))
    has_contact, has_room = c("t_open") - c("contact") >= gap, c("t_open") - c("contact") >= gap + gap
    edge = lambda t, phase, test=F.lit(True): F.when(test, F.struct(t.cast("double").alias("t"), F.lit(phase).alias("phase")))
    edges = F.array(edge(c("t_start"), 0), edge(c("align"), 1), edge(c("contact"), 2, has_contact), edge(c("constrained"), 3, has_room & (c("t_open") - c("constrained") >= gap)), edge(c("t_open"), 4))
    edges = F.when(c("t_close").isNull(), F.array(edge(c("t_start"), 0))).otherwise(F.array_sort(F.array_compact(edges)))
    # at most five boundaries: each is kept if it is far enough from the last kept one
    kept = F.aggregate(
        "edges", F.slice("edges", 1, 1),
        lambda k, x: F.when(x["t"] > F.element_at(k, -1)["t"] + gap / 2, F.concat(k, F.array(x))).otherwise(k),
    )
    s = s.withColumn("edges", edges).withColumn("kept", kept)
    end = F.coalesce(F.try_element_at("kept", c("pos") + 2)["t"], c("t_end"))
    rows = s.select(*EPISODE, "t_close", "t_end", "kept", F.posexplode("kept").alias("pos", "x")).select(*EPISODE, "t_close", "pos", "x.phase", c("x")["t"].alias("start_t"), end.alias("end_t")).where("end_t > start_t")
    confidence = F.when(c("t_close").isNull(), 0.5).when(c("phase").isin(2, 3), 0.9).otherwise(0.75)
    return rows.select(*EPISODE, "pos", "phase", phase_name(c("phase")).alias("phase_name"), F.bround("start_t", 4).alias("start_t"), F.bround("end_t", 4).alias("end_t"), confidence.alias("confidence"))
