"""Exact quantiles against percentile, numbered lines of files that Spark cuts, and time blocks of one long episode."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.operators import labels, signals
from episodica.operators.quantiles import exact_quantiles
from episodica.sources import sessions

SHARES = {"low": 0.0, "fifth": 0.2, "third": 1 / 3, "half": 0.5, "last": 0.999, "high": 1.0}


@pytest.mark.parametrize("held", [3, 40, 100_000])
def test_quantiles_equal_percentile(spark, held):
    draw = random.Random(held)
    kinds = [lambda: draw.gauss(0, 1), lambda: float(draw.randrange(3)), lambda: 7.0, lambda: 10.0 ** draw.uniform(-200, 200), lambda: 5.0 if draw.random() < 0.9 else draw.random() * 5, lambda: None]
    rows = [(k if k else None, kinds[k]()) for k in range(6) for _ in range(draw.choice([1, 2, 30, 700]) if k else 900)]
    df = spark.createDataFrame(rows, "k int, x double")
    want = df.where("x is not null").groupBy("k").agg(*[F.percentile("x", p).alias(n) for n, p in SHARES.items()])
    got = exact_quantiles(df, ["k"], "x", SHARES, held)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert exact_quantiles(df.limit(0), ["k"], "x", SHARES, held).count() == 0


def test_lines_are_numbered_whichever_way_files_are_cut(spark, tmp_path):
    draw = random.Random(1)
    for name, n in (("a", 400), ("b", 3), ("c", 0)):
        (tmp_path / name).mkdir()
        lines = [f'{{"timestamp_ns": {k + 1}, "robot_state": {{"q": [{"1.5, " * draw.randrange(9)}2]}}}}' if k % 7 else draw.choice(["", "  \t"]) for k in range(n)]
        (tmp_path / name / "robot.jsonl").write_text("\n".join(lines) + "\n")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (200, 997, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 10)
            rows = sessions.telemetry(spark, str(tmp_path)).select("dataset", "ord", "timestamp_ns").collect()
            assert sorted((r.dataset, r.ord) for r in rows) == sorted((d, k + 1) for d, n in (("a", 400), ("b", 3)) for k in range(n) if k % 7)
            assert all(r.ord == r.timestamp_ns for r in rows)
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_a_bad_line_is_named(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "robot.jsonl").write_text('{"timestamp_ns": 1}\n\n{"timestamp_ns": \n')
    with pytest.raises(Exception, match=r"bad JSON on line 3 of .*s/robot.jsonl"):
        sessions.telemetry(spark, str(tmp_path)).collect()
    rows = sessions.read_lines(spark, str(tmp_path / "*" / "robot.jsonl"), sessions.TELEMETRY, strict=False)
    assert [(r.ord, r.timestamp_ns, r._corrupt_record) for r in rows.orderBy("ord").collect()] == [(1, 1, None), (3, None, '{"timestamp_ns": ')]


@pytest.mark.parametrize("block", [2.0, 1e6])
def test_signals_of_one_long_episode(spark, block):
    draw = random.Random(5)
    rows = [("d" if draw.random() < 0.9 else "e", 0, draw.randrange(40), k, draw.choice("ab"), draw.gauss(0, 5), draw.gauss(0, 1)) for k in range(200)]
    df = spark.createDataFrame(rows, "dataset string, episode int, ts long, ord long, s string, f double, v double")
    w = Window.partitionBy("dataset", "episode").orderBy("ts", "ord")
    ids = lambda d: sorted(r.ord for r in d.collect())
    assert ids(signals.transitions(df, "s", block=block)) == ids(df.withColumn("p", F.lag("s").over(w)).where("p != s"))
    assert ids(signals.spikes(df, F.col("f"), 5.0, block=block)) == ids(df.withColumn("p", F.lag("f").over(w)).where("abs(f - p) > 5"))
    assert ids(signals.zero_crossings(df, ["f", "v"], block=block)) == ids(df.withColumn("p", F.lag("f").over(w)).where("f * p < 0"))
    steps = df.withColumn("dt", F.col("ts") - F.lag("ts").over(w)).where("dt > 0").groupBy("dataset").agg(F.median("dt").alias("m"))
    want = {r.dataset: max(1, round(1e9 / r.m)) for r in steps.collect()}
    assert {r.dataset: r.fps for r in signals.frame_rate(df, block).collect()} == want


def test_nearest_phase_across_blocks(spark):
    draw = random.Random(9)
    phases = [("k", p, p % 5, (a := draw.uniform(0, 500)), a + draw.uniform(0, 3)) for p in range(60)]
    rows = [("k", draw.uniform(-50, 550), i) for i in range(300)]

    def want(t):
        inside = [(p, ph) for _, p, ph, a, z in phases if a <= t <= z]
        return min(inside)[1] if inside else min((min(abs(t - a), abs(t - z)), p, ph) for _, p, ph, a, z in phases)[2]

    got = labels.nearest_phase(spark.createDataFrame(rows, "k string, ts double, ord int"), spark.createDataFrame(phases, "k string, pos int, phase int, start_t double, end_t double"), "k", 0.5)
    assert {r.ord: r.phase for r in got.collect()} == {i: want(t) for _, t, i in rows}


def test_edges_of_phases_keep_their_partitions(spark):
    """Edges and the rows that look for them aren't joined to few large tasks, and rows that a phase holds don't look for edges."""
    phases = spark.range(20_000).selectExpr("id % 2000 AS k", "id AS pos", "id % 5 AS phase", "10.0D * floor(id / 2000) AS start_t", "10.0D * floor(id / 2000) + 5 AS end_t")
    rows = spark.range(20_000).selectExpr("id % 2000 AS k", "floor(id / 2000) * 10 + if(id % 4 = 0, 7.0D, 2.0D) AS ts", "id AS ord")
    got = labels.nearest_phase(rows, phases, "k", 10.0)
    assert got.count() == 20_000 and got.where("phase != ord % 5").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "SortAggregate(key=[k" not in plan
