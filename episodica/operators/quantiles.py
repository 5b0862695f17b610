"""Exact quantiles of any number of values a key: ranges that hold the wanted ranks are narrowed until few values, or one, are left in each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: Parts into which a range is cut in each round; an approximate sketch says where.
PARTS = 32


def _matched(left: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(left)])


def _named(rows: DataFrame, keys: list[str], prefix: str, *more) -> DataFrame:
    return rows.select(*[F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)], *more)


def exact_quantiles(values: DataFrame, keys: list[str], value: str, shares: dict[str, float], held: int = 100_000) -> DataFrame:
    """(keys, a column a share): of each key the value that a share of its values lies below, with linear interpolation between neighbours, as ``percentile`` has it.

    ``percentile`` keeps a key's distinct values in one buffer; here a key with over ``held`` values has its ranks looked for in rounds. Each cuts the ranges that still hold a wanted rank
    at approximate quantiles, values that equal a cut apart, counts the parts exactly and goes on with those that hold a rank; it ends where a range has at most ``held`` values, or one distinct. So a task
    holds at most ``held`` values of a key. Nulls don't count; keys without values have no row. The values of large keys are stored once a round, fewer each time.
    """
    x = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    plain = lambda rows: rows.groupBy(*keys).agg(*[F.percentile("__x", p).alias(name) for name, p in shares.items()])
    sizes = stored(x.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")))
    large = sizes.where((F.col("__n") > held) & (F.col("__lo") < F.col("__hi")))
    if large.isEmpty():
        return plain(x)
    big = _named(large, keys, "__b").hint("merge")
    small = plain(x.join(big, _matched(keys, "__b"), "left_anti"))
    rest = stored(x.join(big, _matched(keys, "__b"), "left_semi").withColumn("__g", F.lit(0).cast("long")))
    place = lambda p: (F.col("__n") - 1) * p
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("side"), f(place(p)).cast("long").alias("rank")) for n, p in shares.items() for s, f in (("low", F.floor), ("high", F.ceil))])
    asks = large.select(*keys, F.lit(0).cast("long").alias("__g"), F.explode(wanted).alias("w")).select(*keys, "__g", "w.*")
    group, found = [*keys, "__g"], []
    while True:
        cuts = F.percentile_approx("__x", F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)]), F.lit(1000))
        about = stored(rest.groupBy(*group).agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), cuts.alias("__cuts")))
        met = asks.join(_named(about, group, "__a", "__n", "__lo", "__hi", "__cuts").hint("merge"), _matched(group, "__a"))
        met = stored(met.select(*group, "name", "side", "rank", "__n", "__lo", "__hi", "__cuts"))
        found.append(met.where("__lo = __hi").select(*keys, "name", "side", F.col("__lo").alias("v")))
        few = met.where(F.col("__lo") < F.col("__hi")).where(F.col("__n") <= held)
        lists = rest.join(_named(few.select(*group).distinct(), group, "__f").hint("merge"), _matched(group, "__f"), "left_semi").groupBy(*group).agg(F.array_sort(F.collect_list("__x")).alias("xs"))
        found.append(few.join(_named(lists, group, "__l", "xs").hint("merge"), _matched(group, "__l")).select(*keys, "name", "side", F.element_at("xs", F.col("rank").cast("int") + 1).alias("v")))
        open_ = met.where(F.col("__lo") < F.col("__hi")).where(F.col("__n") > held)
        if open_.isEmpty():
            break
        ranges = _named(open_.select(*group, "__cuts").dropDuplicates(group), group, "__r", "__cuts")
        # a value that equals a cut is in a part of its own, so that frequent values can't hold up the rounds
        part = F.size(F.filter("__cuts", lambda c: c < F.col("__x"))) + F.size(F.filter("__cuts", lambda c: c <= F.col("__x")))
        parted = rest.join(ranges.hint("merge"), _matched(group, "__r")).select(*group, "__x", part.alias("__part"))
        counts = parted.groupBy(*group, "__part").agg(F.count("*").alias("__c"))
        before = F.coalesce(F.sum("__c").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = stored(counts.withColumn("__below", before))
        holds = _named(counts, group, "__h", "__part", "__c", "__below")
        deeper = (F.col("__g") * (2 * PARTS) + F.col("__part")).alias("__g")
        asks = stored(
            open_.join(holds.hint("merge"), _matched(group, "__h")).where((F.col("rank") >= F.col("__below")) & (F.col("rank") < F.col("__below") + F.col("__c")))
            .select(*keys, deeper, "name", "side", (F.col("rank") - F.col("__below")).alias("rank"))
        )
        kept = _named(asks.select(*group).distinct(), group, "__d").hint("merge")
        rest = stored(parted.select(*keys, deeper, "__x").join(kept, _matched(group, "__d"), "left_semi"))
    ranks = reduce(DataFrame.unionByName, found)
    at = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("v"))).alias(f"__{side}_{name}")
    ends = ranks.groupBy(*keys).agg(*[at(n, s) for n in shares for s in ("low", "high")])
    whole = ends.join(_named(large, keys, "__z", "__n").hint("merge"), _matched(keys, "__z"))

    def between(name: str, p: float) -> Column:
        low, high, pos = F.col(f"__low_{name}"), F.col(f"__high_{name}"), place(p)
        return F.when(low == high, low).otherwise((F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high).alias(name)

    return small.unionByName(whole.select(*keys, *[between(n, p) for n, p in shares.items()]))
