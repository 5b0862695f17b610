"""As-of joins by bucketed equi-joins: no global sort, no nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, tolerance: int, tie: str = "earlier") -> DataFrame:
    """For each left row (dataset, ts, ord) the nearest right row (dataset, ts, ord) within ``tolerance``: right_ord and delta, or nulls.

    Ties of distance go to the earlier or the later time, and among equal times to the last one before and the first one after.
    Right rows go to three time buckets of the tolerance's width, so each left row meets its neighbours only.
    """
    width = max(int(tolerance), 1)
    bucket = F.floor(F.col("ts") / width)
    r = right.select(F.col("dataset").alias("rd"), F.col("ts").alias("rts"), F.col("ord").alias("right_ord"), F.explode(F.array(*[(bucket + k) for k in (-1, 0, 1)])).alias("rb"))
    near = F.abs(F.col("rts") - F.col("ts")) <= tolerance
    joined = left.withColumn("b", bucket).join(r.hint("merge"), (F.col("dataset") == F.col("rd")) & (F.col("b") == F.col("rb")) & near, "left")
    before = F.col("rts") < F.col("ts")
    side = F.when(F.col("rts") == F.col("ts"), 0).otherwise(before.cast("int") if tie == "later" else (~before).cast("int"))
    rank = F.struct(F.abs(F.col("rts") - F.col("ts")).alias("d"), side.alias("s"), F.when(before, -F.col("right_ord")).otherwise(F.col("right_ord")).alias("o"))
    best = joined.groupBy("dataset", "ts", "ord").agg(F.min(F.when(F.col("rts").isNotNull(), F.struct(rank.alias("rank"), "right_ord", (F.col("rts") - F.col("ts")).alias("delta")))).alias("m"))
    return best.select("dataset", "ts", "ord", F.col("m.right_ord").alias("right_ord"), F.col("m.delta").alias("delta"))


def _timeline(left: DataFrame, right: DataFrame, payload: str | None) -> DataFrame:
    """Both sides in one table: ``__r`` is the right row (its ts and payload), null in left rows. Left rows stand before right ones of their time."""
    r = F.struct(F.col("ts").alias("ts"), F.col(payload or "ts").alias("p"))
    found = right.select("dataset", "ts", r.alias("__r"), F.struct(F.lit(True).alias("right"), F.col("ord").cast("long").alias("o")).alias("__o"))
    asked = left.select("dataset", "ts", "ord", F.lit(None).cast(found.schema["__r"].dataType).alias("__r"), F.struct(F.lit(False).alias("right"), F.lit(0).cast("long").alias("o")).alias("__o"))
    return asked.unionByName(found.withColumn("ord", F.lit(None).cast(left.schema["ord"].dataType)))


def _neighbours(left: DataFrame, right: DataFrame, payload: str | None, block: float, parts: int | None = None) -> DataFrame:
    """Left rows with the nearest right row at or after them (__a) and at or before them (__b).

    A window spans one block of time of a dataset, not its whole timeline; what blocks before and after hold comes from a table of one row a block.
    With ``parts`` blocks are dealt to so many partitions, which Spark doesn't join to fewer.
    """
    both = _timeline(left, right, payload).withColumn("__n", F.floor(F.col("ts") / block))
    both = both.repartition(parts, "dataset", "__n") if parts else both
    place = F.when(F.col("__r").isNotNull(), F.struct("ts", "__o"))
    blocks = both.groupBy("dataset", "__n").agg(F.min_by("__r", place).alias("lo"), F.max_by("__r", place).alias("hi"))
    order = Window.partitionBy("dataset").orderBy("__n")
    # what follows is looked for in falling order: frames that grow are computed step by step, frames that shrink anew for each row
    back = Window.partitionBy("dataset").orderBy(F.desc("__n")).rowsBetween(Window.unboundedPreceding, -1)
    before, after = F.last("hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.last("lo", True).over(back)
    blocks = blocks.select(F.col("dataset").alias("__bd"), F.col("__n").alias("__bn"), before.alias("__before"), after.alias("__after"))
    w, grows = Window.partitionBy("dataset", "__n"), (Window.unboundedPreceding, 0)
    near = both.withColumn("__a", F.last("__r", True).over(w.orderBy(F.desc("ts"), F.desc("__o")).rowsBetween(*grows))).withColumn("__b", F.last("__r", True).over(w.orderBy("ts", "__o").rowsBetween(*grows)))
    near = near.where("__r is null").join(blocks.hint("merge"), F.col("dataset").eqNullSafe(F.col("__bd")) & F.col("__n").eqNullSafe(F.col("__bn")))
    return near.withColumn("__a", F.coalesce("__a", "__after")).withColumn("__b", F.coalesce("__b", "__before"))


def _out(chosen: DataFrame, payload: str | None) -> DataFrame:
    return chosen.select("dataset", "ts", "ord", (F.col("__x")["p"].alias(payload) if payload else F.col("__x")["ts"].alias("right_ts")))


def forward(left: DataFrame, right: DataFrame, payload: str | None = None, block: float = 3.6e12) -> DataFrame:
    """The first right row at or after each left row, or the dataset's last one: right_ts, or its ``payload``; null where there is no right row. ``block``: see ``_neighbours``, an hour in ns."""
    near = _neighbours(left, right, payload, block)
    return _out(near.withColumn("__x", F.coalesce("__a", "__b")), payload)  # nothing after it: what is before it is the last


def nearest_any(left: DataFrame, right: DataFrame, tie: str = "later", payload: str | None = None, block: float = 3.6e12) -> DataFrame:
    """The nearest right row without a tolerance: right_ts, or its ``payload``. Of right rows at one time the first one after and the last one before count. ``block``: see ``_neighbours``."""
    near = _neighbours(left, right, payload, block)
    up, down = F.col("__a")["ts"] - F.col("ts"), F.col("ts") - F.col("__b")["ts"]
    takes_after = F.col("__b").isNull() | (up < down) | ((up == down) & F.lit(tie == "later"))
    return _out(near.withColumn("__x", F.when(F.col("__a").isNotNull() & takes_after, F.col("__a")).otherwise(F.col("__b"))), payload)


def around(left: DataFrame, right: DataFrame, payload: str, block: float = 3.6e12, parts: int | None = None) -> DataFrame:
    """Left rows (dataset, ts, ord) with the nearest right rows at or after and at or before them: after_ts, before_ts, and their ``payload`` as after_ and before_; nulls where there is none. ``block``, ``parts``: see ``_neighbours``."""
    near = _neighbours(left, right, payload, block, parts)
    return near.select("dataset", "ts", "ord", *[F.col(c)[f].alias(n) for s, c in (("after", "__a"), ("before", "__b")) for f, n in (("ts", f"{s}_ts"), ("p", f"{s}_{payload}"))])


def covered(left: DataFrame, cameras: list[DataFrame], tolerance: int) -> DataFrame:
    """Left rows with ``covered``, whether every camera has a frame within the tolerance."""
    out = left.select("dataset", "ts", "ord").withColumn("covered", F.lit(True))
    for camera in cameras:
        m = nearest(left.select("dataset", "ts", "ord"), camera, tolerance).select(F.col("dataset").alias("d"), F.col("ord").alias("o"), F.col("right_ord").isNotNull().alias("has"))
        out = out.join(m.hint("merge"), (F.col("dataset") == F.col("d")) & (F.col("ord") == F.col("o"))).withColumn("covered", F.col("covered") & F.col("has")).drop("d", "o", "has")
    return out


def covered_by_all(left: DataFrame, frames: DataFrame, tolerance: int) -> DataFrame:
    """Distinct left rows (dataset, ts, ord) with ``covered``: whether each camera of their own dataset (frames: dataset, camera, ts, ord) has a frame within the tolerance. Without a camera nothing is covered."""
    keys = left.select("dataset", "ts", "ord").distinct()
    met = nearest_of_cameras(keys, frames, tolerance)
    return met.groupBy("dataset", "ts", "ord").agg(F.bool_and(F.col("right_ord").isNotNull()).alias("covered"))


def nearest_of_cameras(keys: DataFrame, frames: DataFrame, tolerance: int) -> DataFrame:
    """Keys (dataset, ts, ord) with each camera of their dataset and its nearest frame: (dataset, ts, ord, camera, right_ord), right_ord null beyond the tolerance; camera null where a dataset has none."""
    cameras = frames.select(F.col("dataset").alias("__d"), "camera").distinct()
    asked = keys.join(cameras.hint("merge"), F.col("dataset") == F.col("__d"), "left").select(F.struct("dataset", "camera").alias("dataset"), "ts", "ord")
    met = nearest(asked, frames.select(F.struct("dataset", "camera").alias("dataset"), "ts", "ord"), tolerance)
    return met.select(F.col("dataset")["dataset"].alias("dataset"), "ts", "ord", F.col("dataset")["camera"].alias("camera"), "right_ord")
