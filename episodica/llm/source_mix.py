"""Mixing sources to target weights by cube-method balanced sampling.

A document's rate is its source's target over its source's size, at most 3. The whole part of the rate is taken for sure; the
fraction is an inclusion probability. The flight phase moves these probabilities through the null space of the constraints
(expected number of documents and expected words of the source stay as they are) until at most two of each block are left; what the
blocks leave over meets again in fewer blocks, until one small landing problem a source remains.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, row_key, written

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source and no document gives more than this many times its size.
MOST = 3.0
#: About as many rows meet in one block of a flight.
BLOCK = 512
#: Units of a source that the landing problem settles.
LANDING = 48
WORD = r"[^\x20\x09-\x0D]+"
NEAR = 1e-9


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, size) -> source, source_size, target; one row a source.

    Targets share the total by weight and stop at ``most`` times the size, the excess going to the others by weight: target =
    min(most * size, level * weight), with the level at which the targets add up to the total.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("k", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") - 1) % len(weights) + 1))
        .withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    )
    # sources stop in the order of the level that fills them; the level is that of the first source that it doesn't fill
    in_order = Window.orderBy("full_at", "k")
    stopped_before = F.coalesce(F.sum("source_size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    # from the last to the first, as a frame that shrinks would be summed anew for each source
    weight_left = F.sum("weight").over(Window.orderBy(F.desc("full_at"), F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("source_size").over(Window.partitionBy())
    levels = ranked.withColumn("level", (total - stopped_before) / weight_left).withColumn("place", F.row_number().over(in_order))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    return levels.select("source", "source_size", F.least(most * F.col("source_size"), F.coalesce(level * F.col("weight"), F.lit(math.inf))).alias("target"))


class Unit:
    """A fractional unit in flight; ``row`` is what the caller gets back."""

    __slots__ = ("p", "n", "w", "key", "row")

    def __init__(self, p: float, n: float, w: float, key: bytes, row: tuple):
        self.p, self.n, self.w, self.key, self.row = p, n, w, key, row


def _draw(*units: Unit) -> float:
    return xxhash.xxh64_intdigest(b"".join(u.key for u in units)) / 2.0**64


def move(units: list[Unit]) -> None:
    """Move three probabilities along the direction that keeps the expected documents and words, until one is 0 or 1."""
    a, b, c = units
    u = (b.n * c.w - c.n * b.w, c.n * a.w - a.n * c.w, a.n * b.w - b.n * a.w)
    if not any(u):
        u = (b.n, -a.n, 0.0)  # equal proportions: two of them suffice
    scale = max(map(abs, u))
    u = [d / scale for d in u]
    up = min((1 - x.p) / d if d > 0 else x.p / -d for x, d in zip(units, u) if abs(d) > NEAR)
    down = min(x.p / d if d > 0 else (1 - x.p) / -d for x, d in zip(units, u) if abs(d) > NEAR)
    step = up if _draw(*units) * (up + down) < down else -down
    for x, d in zip(units, u):
        p = x.p + step * d
        x.p = 0.0 if p < NEAR else 1.0 if p > 1 - NEAR else p


def land(units: list[Unit]) -> None:
    """The small landing problem: from the largest unit to the smallest, settle each so that the words so far stay nearest to those expected; a draw decides ties."""
    rest = 0.0
    for x in sorted(units, key=lambda x: (-x.w, x.key)):
        zero, one = abs(rest + x.p * x.w), abs(rest + (x.p - 1) * x.w)
        settled = 0.0 if zero < one else 1.0 if one < zero else float(_draw(x) < x.p)
        rest += (x.p - settled) * x.w
        x.p = settled


def fly(rows: Iterator[tuple], last: bool) -> Iterator[tuple]:
    """(group, p, n, w, key, row), sorted by group and falling w -> (row, p); all but two of a group are settled.

    With ``last``, the LANDING smallest units stay out of the flight and are landed together with those two. However many rows a
    group has, no more units than these are held.
    """
    group, held, waiting = None, [], deque()

    def add(x: Unit) -> Iterator[tuple]:
        held.append(x)
        if len(held) == 3:
            move(held)
            for y in [y for y in held if y.p in (0.0, 1.0)]:
                held.remove(y)
                yield y.row, y.p

    def leave() -> Iterator[tuple]:
        if last:
            held.extend(waiting)
            waiting.clear()
            land(held)
        yield from ((x.row, x.p) for x in held)
        held.clear()

    for g, p, n, w, key, row in rows:
        if g != group:
            yield from leave()
            group = g
        waiting.append(Unit(p, n, w, key, row))
        if len(waiting) > LANDING * last:
            yield from add(waiting.popleft())
    yield from leave()


def settle(units: DataFrame) -> DataFrame:
    """Settles the column ``p`` (0 to 1) of ``units`` (with source, n, w, and h, an arbitrary but fixed long) to 0 or 1."""
    whole, open_, done = units.schema, cut(units), []
    blocks = max(1, math.ceil(open_.count() / BLOCK))
    names = units.columns

    def flight(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for batch in batches:
                    for row in zip(*(c.to_pylist() for c in batch.columns)):
                        at = dict(zip(names, row))
                        yield (row[-1], at["source"]), at["p"], at["n"], float(at["w"]), at["h"].to_bytes(8, "little", signed=True), row[:-1]

            at_p, out = names.index("p"), []
            for row, p in fly(rows(), last):
                out.append((*row[:at_p], p, *row[at_p + 1 :]))
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            arrow = to_arrow_schema(whole)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        return run

    while True:
        block = F.pmod(F.xxhash64("h", F.lit(blocks)), F.lit(blocks)).alias("__block")
        # the last flight is dealt by source: of each a few units a block are left, but there may be very many sources
        parts = max(1, min(math.ceil((blocks if blocks > 1 else open_.count() / BLOCK) / 4), 2000))
        dealt = open_.select("*", block).repartition(parts, "__block", "source").sortWithinPartitions("__block", "source", F.desc("w"), "h")  # large units meet large ones, small ones are left over
        flown = cut(dealt.mapInArrow(flight(blocks == 1), whole))
        done.append(flown.where(~((F.col("p") > 0) & (F.col("p") < 1))))
        if blocks == 1:
            break
        open_, blocks = flown.where((F.col("p") > 0) & (F.col("p") < 1)), blocks // 16 or 1
    return reduce(DataFrame.unionByName, done)


def plan_mix(frame: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """How often each unit is taken: ``frame`` (id columns, source, size, n: rows that the unit stands for) plus source_size, target, copies.

    Deterministic: draws are keyed by the units themselves. Units that are alike in all columns are interchangeable.
    """
    frame = cut(frame)
    targets = written(source_targets(frame.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    ids = [c for c in frame.columns if c not in ("source", "size", "n")]
    rated = (
        frame.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        .withColumn("__rate", rate).withColumn("copies", F.floor(F.col("__rate") + NEAR))
        .withColumn("p", F.greatest(F.col("__rate") - F.col("copies"), F.lit(0.0))).drop("__rate")
        .withColumn("w", F.col("size") * F.col("n")).withColumn("h", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in [*ids, "source", "size"]]))
    )
    open_ = F.col("p") > NEAR
    sure = rated.where(~open_).withColumn("p", F.lit(0.0))
    return sure.unionByName(settle(rated.where(open_))).withColumn("copies", (F.col("copies") + F.col("p")).cast("long")).drop("p", "w", "h")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words that the mix takes of each document: id, size, source_size, target, taken, copies.

    A null or empty text has size 0 and gives 0 words; a null source is a source of its own, the last one; each of several equal
    rows is drawn on its own, and rows of one size and source are told apart by a hash alone, so ties fall the same way in every run; a text of any length
    is one unit with its whole size, which the flight balances like any other; an empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    frame = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.lit(1).alias("n"))
    return plan_mix(frame, weights, most).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken (a document taken 0 times goes).

    Rows with the same id, source and text are one unit, so all of them are taken equally often.
    """
    key = row_key(id_col, source_col, text_col)
    keyed = docs.select(F.struct("*").alias("r"), key.alias("k"))
    frame = docs.select(F.col(id_col).alias("id"), key.alias("k"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    frame = frame.groupBy("id", "k", "source", "size").agg(F.count("*").alias("n"))
    taken = plan_mix(frame, weights, most).where("copies > 0").select(F.col("k").alias("taken_k"), "copies")
    joined = keyed.join(taken.hint("merge"), F.col("k") == F.col("taken_k"))
    return joined.select("r", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("r.*")
