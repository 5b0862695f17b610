"""Scans of long timelines: values of the rows before and after, running sums and places, without a window over a whole key.

A window spans one block of time of a key. What other blocks hold comes from a table of one row a block: their edge rows, sums, counts and last known values, carried over
by windows over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scanned(
    rows: DataFrame, keys: list[str], order: list[str], block: float, *, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None,
    running: dict[str, Column] | None = None, last: dict[str, Column] | None = None, coming: dict[str, Column] | None = None, place: str | None = None,
) -> DataFrame:
    """``rows`` with new columns, in order of ``order`` within ``keys``; the first order column is a number, and a block holds ``block`` of it.

    ``before`` and ``after``: the value of the row before and after (null at the ends); ``running``: the sum up to this row (nulls count as 0); ``last`` and ``coming``: the
    last known value up to this row and the first one from it on; ``place``: the row's number from 0. ``order`` should tell all rows of a key apart; rows that it
    doesn't tell apart stand in any order. Rows whose first order column is null come first, as one block. An empty table stays empty. ``rows`` is computed twice.
    """
    before, after, running, last, coming = (x or {} for x in (before, after, running, last, coming))
    given = rows.columns
    dealt = rows.withColumn("__n", F.floor(F.col(order[0]) / block))
    values = {f"__v{k}": c for k, c in enumerate([*before.values(), *after.values(), *running.values(), *last.values(), *coming.values()])}
    named = dict(zip([*(("b", n) for n in before), *(("a", n) for n in after), *(("r", n) for n in running), *(("l", n) for n in last), *(("c", n) for n in coming)], values))
    dealt = dealt.withColumns(values)
    at = F.struct(*order)
    known = lambda v: F.when(F.col(v).isNotNull(), at)
    # a struct around a value keeps a null value apart from no row
    held = {"b": lambda v: F.max_by(F.struct(v), at), "a": lambda v: F.min_by(F.struct(v), at), "r": lambda v: F.sum(v), "l": lambda v: F.max_by(v, known(v)), "c": lambda v: F.min_by(v, known(v))}
    edges = dealt.groupBy(*keys, "__n").agg(F.count("*").alias("__count"), *[held[kind](v).alias(f"__e{v}") for (kind, _), v in named.items()])
    up = Window.partitionBy(*keys).orderBy(F.col("__n").asc_nulls_first())
    down = Window.partitionBy(*keys).orderBy(F.col("__n").desc_nulls_last())
    # frames grow, the following ones in falling order: a frame that shrinks would be computed anew for each row
    earlier, later = up.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.unboundedPreceding, -1)
    carry = {"b": lambda c: F.lag(c).over(up), "a": lambda c: F.lead(c).over(up), "r": lambda c: F.sum(c).over(earlier), "l": lambda c: F.last(c, True).over(earlier), "c": lambda c: F.last(c, True).over(later)}
    carried = edges.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__n").alias("__kn"), F.coalesce(F.sum("__count").over(earlier), F.lit(0)).alias("__first"),
        *[carry[kind](f"__e{v}").alias(f"__c{v}") for (kind, _), v in named.items()],
    )
    on = F.col("__n").eqNullSafe(F.col("__kn"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    by = [F.col(order[0]).asc_nulls_first(), *order[1:]]
    w = Window.partitionBy(*keys, "__n").orderBy(*by)
    back = Window.partitionBy(*keys, "__n").orderBy(F.col(order[0]).desc_nulls_last(), *[F.desc(o) for o in order[1:]])
    grows = (Window.unboundedPreceding, 0)
    inner = {
        "b": lambda v: F.lag(F.struct(v)).over(w), "a": lambda v: F.lead(F.struct(v)).over(w), "r": lambda v: F.sum(v).over(w.rowsBetween(*grows)),
        "l": lambda v: F.last(v, True).over(w.rowsBetween(*grows)), "c": lambda v: F.last(v, True).over(back.rowsBetween(*grows)),
    }
    out = dealt
    for (kind, _), v in named.items():
        out = out.withColumn(f"__i{v}", inner[kind](v))
    if place:
        out = out.withColumn("__at", F.row_number().over(w))
    out = out.join(carried.hint("merge"), on)
    both = {
        "b": lambda v: F.coalesce(f"__i{v}", f"__c{v}")[v], "a": lambda v: F.coalesce(f"__i{v}", f"__c{v}")[v], "r": lambda v: F.coalesce(f"__i{v}", F.lit(0)) + F.coalesce(f"__c{v}", F.lit(0)),
        "l": lambda v: F.coalesce(f"__i{v}", f"__c{v}"), "c": lambda v: F.coalesce(f"__i{v}", f"__c{v}"),
    }
    new = [both[kind](v).alias(name) for (kind, name), v in named.items()]
    if place:
        new.append((F.col("__first") + F.col("__at") - 1).alias(place))
    taken = {name for _, name in named} | {place}
    return out.select(*[F.col(c) for c in given if c not in taken], *new)
