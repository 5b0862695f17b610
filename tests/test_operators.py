"""Operators on hand-made episodes, and folds against plain Python."""

import random

from pyspark.sql import functions as F

from episodica.functions import fields
from episodica.operators import alignment, annotate, asof, episodes, labels, merging, signals
from episodica.sources import sessions
from episodica.streaming import control


def test_model_output_without_or_with_json(spark):
    rows = spark.createDataFrame([("```json\n{\"a\": {\"b\": 1}}\n```",), ("none",), ("} {",), (None,)], "raw string")
    assert [r[0] for r in rows.select(fields.json_body(F.col("raw"))).collect()] == ['{"a": {"b": 1}}', None, None, None]


def test_safety_rules_in_order(spark):
    nan, inf, free, contact = float("nan"), float("inf"), "free_motion", "contact_establish"
    cases = [
        ([0.0] * 7, free, 0.0, None), ([nan] + [0.0] * 6, free, 0.0, "nan"), ([0, 0, 0, inf, 0, 0, 0], free, 0.0, "inf"), ([0, 0, 0, 5.0, 0, 0, 0], free, 0.0, "velocity"),
        ([1.4, 0, 0, 5.0, 0, 0, 0], free, 0.0, "workspace"), ([1.3, -1.3, 1.7, 0, 0, 0, 0], free, 0.0, None), ([0, 0, -0.6, 0, 0, 0, 0], free, 0.0, "workspace"), ([0.0] * 6 + [0.9], free, 0.0, "gripper"),
        ([0.0] * 7 + [0.9], free, 0.0, "gripper"), ([0.0] * 6 + [0.9], contact, 0.0, None), ([0.0] * 7, free, 31.0, "force"), ([0.0] * 7, free, None, None), (None, free, 0.0, "null"),
        ([9.0, 9.0], free, 0.0, None), ([0, 0, 0, 9.0, 0], free, 0.0, None), ([0, 0, 0, 0, 0, 9.0], free, 0.0, "velocity"), ([0.0] * 5 + [0.9], free, 0.0, None), ([], free, 0.0, None),
    ]
    rows = spark.createDataFrame([([float(x) for x in a] if a is not None else None, p, f, w) for a, p, f, w in cases], "action array<double>, phase string, force_z double, want string")
    assert [r.reason for r in control.checked_actions(rows).collect()] == [w for *_, w in cases]


def test_nearest_ties_and_tolerance(spark):
    left = spark.createDataFrame([("d", 100, 1), ("d", 200, 2), ("d", 1000, 3)], "dataset string, ts long, ord long")
    right = spark.createDataFrame([("d", 90, 10), ("d", 110, 11), ("d", 200, 12), ("d", 200, 13)], "dataset string, ts long, ord long")
    early = {r.ord: r.right_ord for r in asof.nearest(left, right, 10).collect()}
    assert early == {1: 10, 2: 12, 3: None}
    assert {r.ord: r.right_ord for r in asof.nearest(left, right, 10, tie="later").collect()}[1] == 11
    assert {r.ord: r.right_ord for r in asof.nearest(left, right, 9).collect()}[1] is None


def test_split_before_every_event(spark):
    rows = spark.createDataFrame([("d", t, t) for t in range(0, 60, 10)], "dataset string, ts long, ord long")
    events = spark.createDataFrame([("d", 15, 1, "end"), ("d", 17, 2, "end"), ("d", 40, 3, "end")], "dataset string, ts long, ord long, name string")
    assert [r.episode for r in episodes.episode_rows(rows, events).orderBy("ts").collect()] == [0, 0, 1, 1, 2, 2]


def keyframes(times, every):
    out = []
    for t in sorted(times):
        if not out or t >= out[-1] + every:
            out.append(t)
    return out


def test_uniform_keyframes_equal_a_loop(spark):
    rng = random.Random(3)
    data = [("d", e, round(rng.uniform(0, 10), 3)) for e in range(5) for _ in range(60)]
    got = signals.uniform_keyframes(spark.createDataFrame(data, "dataset string, episode int, t double")).collect()
    for e in range(5):
        assert sorted(r.t for r in got if r.episode == e) == keyframes([t for _, x, t in data if x == e], 0.5)


def test_keyframe_deduplication_equals_a_loop(spark):
    rng, kinds = random.Random(4), ["uniform", "gripper", "contact", "velocity"]
    data = [("d", e, round(rng.uniform(0, 2), 3), rng.choice(kinds)) for e in range(4) for _ in range(50)]
    got = signals.deduplicated_keyframes(spark.createDataFrame(data, "dataset string, episode int, t double, kind string")).collect()
    for e in range(4):
        kept = []
        for t, o in sorted((t, kinds.index(k)) for _, x, t, k in data if x == e):
            if not kept or t - kept[-1][0] >= 0.05:
                kept.append((t, o))
            elif o and not kept[-1][1]:
                kept[-1] = (t, o)
        assert sorted((r.t, kinds.index(r.kind)) for r in got if r.episode == e) == kept


def test_low_pass_equals_a_loop(spark):
    x = [float((7 * i) % 5) for i in range(40)]
    rows = spark.createDataFrame([("k", i, i, v) for i, v in enumerate(x)], "key string, ts long, ord long, x double")
    b0, b1, b2, a1, a2 = control.butterworth(2.0, 30.0)
    y = []
    for i, v in enumerate(x):
        at = lambda s, k: s[i - k] if i >= k else 0.0
        y.append(b0 * v + b1 * at(x, 1) + b2 * at(x, 2) - a1 * at(y, 1) - a2 * at(y, 2))
    got = [r.filtered for r in control.low_passed(rows, "x", 2.0, 30.0).orderBy("ts").collect()]
    assert max(abs(a - b) for a, b in zip(got, y)) < 1e-12
    assert [r.filtered for r in control.low_passed(rows, "x", 0.0, 30.0).orderBy("ts").collect()] == x


def machine(rules, signals):
    state = rules.start()
    return [rules.step(state, s)[1] for s in signals]


ALIGN, CONTACT, MATE, SEATED, RETRACT = (tuple(k == n for k in range(5)) for n in range(5))
NOTHING = (False,) * 5


def test_phase_machine():
    rules = control.PhaseRules(hysteresis=1)
    # the last phase is never left
    assert machine(rules, [ALIGN, CONTACT, MATE, SEATED, NOTHING, RETRACT, RETRACT, ALIGN]) == [1, 2, 3, 4, 4, 4, 4, 4]
    # contact, mate and seated lead nowhere before their turn, and nothing leads back
    assert machine(rules, [CONTACT, MATE, SEATED, ALIGN, MATE, CONTACT, ALIGN, RETRACT]) == [0, 0, 0, 1, 1, 2, 2, 2]
    assert machine(control.PhaseRules(hysteresis=3), [ALIGN] * 3) == [0, 0, 1]
    assert machine(control.PhaseRules(hysteresis=3), [ALIGN, ALIGN, NOTHING, ALIGN, ALIGN, ALIGN]) == [0, 0, 0, 0, 0, 1]
    assert machine(rules, [(True, True, True, False, False)]) == [3]  # several phases within one step
    # the clock starts at the first step that is evaluated in phase 1, and has to be exceeded
    assert machine(control.PhaseRules(hysteresis=1, timeout_steps=2), [ALIGN] + [NOTHING] * 5) == [1, 1, 1, 1, 0, 0]
    # counts survive a timeout
    assert machine(control.PhaseRules(hysteresis=2, timeout_steps=1), [ALIGN, ALIGN, NOTHING, CONTACT, NOTHING, ALIGN, (True, True, False, False, False)]) == [0, 1, 1, 1, 0, 0, 2]
    own = control.PhaseRules(1, 10, ((0, "go", 1), (1, "jump", 3)))
    assert own.inputs == ["go", "jump"] and machine(own, [(True, False), (False, True)]) == [1, 1]  # an illegal step is refused


def test_phase_signals(spark):
    rows = spark.createDataFrame(
        [([0.0, 0.004, 0.04], [0.0, 0.0, 0.0], 0.0, 0.0, [0.0, 0.0, 0.0]), ([0.0, 0.0, 0.06], [0.0, 0.0, 0.02], 1.0, 2.0, [0.0, 0.0, 0.0]), ([0.0, 0.0, 0.012], [0.0, 0.0, 0.0], 0.6, -5.0, [0.0, 0.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0], 0.4, 3.5, None)],
        "pose array<double>, v array<double>, g double, f double, target array<double>",
    )
    tests = control.phase_tests(F.col("pose"), F.col("v"), F.col("g"), F.col("f"), F.col("target"))
    got = [tuple(r[c] for c in control.SIGNALS) for r in control.signals(rows, tests).collect()]
    assert got == [(True, False, False, False, False), (False, True, True, False, False), (True, True, False, True, False), (False, True, False, False, True)]
    assert control.rules_of("msd_plug").timeout_steps == 800 and control.rules_of().hysteresis == 3


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    data = [(k, t, t, *(rng.random() < 0.4 for _ in range(5))) for k in ("a", "b", "c") for t in range(60)]
    rows = spark.createDataFrame(data, "key string, ts long, ord long, " + ", ".join(f"{s} boolean" for s in control.SIGNALS))
    for part in range(3):
        rows.where(F.col("ts").between(20 * part, 20 * part + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    rules = control.PhaseRules(2, 7)

    def run(frame, name):
        query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    want = {(r.key, r.ts): (r.from_phase, r.phase) for r in control.phases_batch(rows, rules).collect()}
    got = run(control.phases_stream(stream, rules), "phases")
    assert {(r.key, r.ts): (r.from_phase, r.phase) for r in got} == want and not any(r.late for r in got)
    changes = run(control.phase_changes(control.phases_stream(stream, rules)), "changes")
    assert {(r.key, r.ts, r.phase) for r in changes} == {(*k, p) for k, (f, p) in want.items() if f != p}
    smooth = rows.withColumn("x", (F.col("ts") % 7).cast("double")).select("key", "ts", "ord", "x")
    smooth.write.parquet(str(tmp_path / "x"))
    read = spark.readStream.schema(smooth.schema).parquet(str(tmp_path / "x"))
    filtered = {(r.key, r.ts): r.filtered for r in run(control.on_stream(read, control.LowPass("x", 2.0, 30.0)), "smooth")}
    assert filtered == {(r.key, r.ts): r.filtered for r in control.low_passed(smooth, "x", 2.0, 30.0).collect()}


def test_late_rows_and_unsafe_actions_go_to_the_rejects(spark, tmp_path):
    schema = "key string, ts long, ord long, " + ", ".join(f"{s} boolean" for s in control.SIGNALS)
    row = lambda ts: ("a", ts, ts, True, False, False, False, False)
    for times in ((1, 2, 5), (3, 6)):  # 3 comes too late
        spark.createDataFrame([row(t) for t in times], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write = control.split_writer("not late", str(tmp_path / "good"), str(tmp_path / "late"))
    control.phases_stream(stream, control.PhaseRules(4)).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.ts for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [3]
    assert {r.ts: r.phase for r in spark.read.parquet(str(tmp_path / "good")).collect()} == {1: 0, 2: 0, 5: 0, 6: 1}
    actions = spark.createDataFrame([(k, [0.0] * 6 + [k / 10], "free_motion", 0.0) for k in range(10)], "id int, action array<double>, phase string, force_z double")
    actions.write.parquet(str(tmp_path / "actions"))
    read = spark.readStream.schema(actions.schema).parquet(str(tmp_path / "actions"))
    write = control.split_writer("reason is null", str(tmp_path / "safe"), str(tmp_path / "unsafe"))
    control.checked_actions(read).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.id, r.reason) for r in spark.read.parquet(str(tmp_path / "unsafe")).collect()} == {(8, "gripper"), (9, "gripper")}
    assert spark.read.parquet(str(tmp_path / "safe")).count() == 8
    steps = spark.createDataFrame([("a", k, k // 2) for k in range(6)], "key string, step long, phase int")
    steps.write.parquet(str(tmp_path / "steps"))
    trace = control.phase_trace(spark.readStream.schema(steps.schema).parquet(str(tmp_path / "steps")))
    trace.writeStream.format("memory").queryName("trace").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert [r.trace for r in spark.table("trace").collect()] == ["0,0,1,1,2,2"]


def test_validation_cases(spark):
    good = [(0, 0.0, 1.0), (1, 1.0, 2.0), (2, 2.0, 2.5), (3, 2.5, 4.0), (4, 4.0, 5.0)]
    cases = {
        "good": good, "jump": [(0, 0.0, 2.0), (2, 2.0, 5.0)], "gap": [(0, 0.0, 1.0), (1, 1.5, 5.0)], "end": [(0, 0.0, 4.8)], "start": [(0, 0.1, 1.0), (1, 1.5, 4.0)], "end_first": [(0, 0.0, 1.0), (1, 1.5, 4.0)],
        "back": [(0, 0.0, 1.0), (1, 1.0, 2.0), (2, 2.0, 3.0), (0, 3.0, 5.0)], "mate_back": [(0, 0.0, 1.0), (1, 1.0, 2.0), (2, 2.0, 3.0), (3, 3.0, 4.0), (2, 4.0, 5.0)], "release_back": [(4, 0.0, 2.0), (0, 2.0, 5.0)],
        "realign": [(0, 0.0, 1.0), (1, 1.0, 2.0), (0, 2.0, 3.0), (1, 3.0, 5.0)], "order": [(0, 0.0, 1.0), (1, 1.0, 0.98), (1, 0.97, 5.0)],
    }
    seg = spark.createDataFrame([(k, i, p, s, e, 0.9) for k, v in cases.items() for i, (p, s, e) in enumerate(v)], "k string, pos int, phase int, start_t double, end_t double, confidence double")
    durations = spark.createDataFrame([(k, 5.0) for k in cases], "k string, duration double")
    issues = [labels.contiguity_issues(seg, durations, "k"), labels.transition_issues(seg, "k"), labels.coverage_issues(seg, "k")]
    verdicts = {r.k: r for r in labels.verdicts(seg, issues, "k").collect()}
    assert {k for k, r in verdicts.items() if r.passed} == {"good", "realign"}
    assert {r.k: r.rule for r in issues[0].collect()} == {"gap": "contiguity_gap", "end": "contiguity_end", "start": "contiguity_start", "end_first": "contiguity_end", "order": "contiguity_order"}
    assert {r.k for r in issues[1].collect()} == {"jump", "back", "mate_back", "release_back"}
    assert [(i.severity, i.rule) for i in verdicts["jump"].issues] == [("error", "transition_legality"), ("warning", "coverage")] and "can't follow" in verdicts["jump"].issues[0].message
    own = seg.where("end_t - start_t > 3").select("k", F.lit("error").alias("severity"), F.lit("long").alias("rule"), F.lit("too long").alias("message"))
    assert {r.k for r in labels.verdicts(seg, [own], "k").where("not passed").collect()} == {"end", "gap", "order"}
    tasks = seg.where("k in ('good', 'end')").withColumn("task", F.when(F.col("k") == "end", "other").otherwise("pick_place"))
    assert labels.coverage_issues(tasks, "k", task="task").count() == 0


def test_statistics_keep_min_and_max(spark):
    stats = spark.createDataFrame([("a", 1, "f", "mean", 0, 1.0), ("b", 3, "f", "mean", 0, 5.0), ("a", 1, "f", "min", 0, 1.0), ("b", 3, "f", "min", 0, 0.5)], "dataset string, frames long, feature string, stat string, pos int, value double")
    assert {r.stat: r.value for r in merging.merged_stats(stats).collect()} == {"mean": 4.0, "min": 0.5}


def test_sources_round_trip(spark, tmp_path):
    for name in ("s1", "s2"):
        (tmp_path / name / "cameras" / "top").mkdir(parents=True)
        (tmp_path / name / "robot.jsonl").write_text('{"timestamp_ns": 5, "robot_state": {"q": [1.0], "gripper_width": 0.1}}\n\n{"host_timestamp_ns": 7}\n')
        (tmp_path / name / "episode_events.jsonl").write_text('{"event": " Episode_Start ", "robot_timestamp_ns": 5}\n{"episode_event": "other", "robot_timestamp_ns": 6}\n')
        (tmp_path / name / "cameras" / "top" / "frames.jsonl").write_text('{"frame_index": 3, "timestamp_ns": 5}\n')
    t = sessions.telemetry(spark, str(tmp_path))
    ts = fields.first_timestamp(*[F.col(c) for c in fields.TIMESTAMP_FIELDS])
    assert [(r.dataset, r.ts) for r in t.select("dataset", ts.alias("ts")).orderBy("dataset", "ts").collect()] == [("s1", 5), ("s1", 7), ("s2", 5), ("s2", 7)]
    e = sessions.episode_events(spark, str(tmp_path)).withColumn("ts", F.col("robot_timestamp_ns"))
    assert [r.name for r in episodes.normalised_events(e, F.col("raw_name")).collect()] == ["start", "start"]
    assert {(r.dataset, r.camera, r.rgb_video, r.rgb_video_frame) for r in sessions.camera_frames(spark, str(tmp_path)).collect()} == {("s1", "top", "rgb.mp4", 3), ("s2", "top", "rgb.mp4", 3)}
    rows = spark.range(5).withColumn("dataset", F.lit("x"))
    sessions.write_table(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert [sessions.write_missing(rows, spark, str(tmp_path / "labels"), ["id"]) for _ in range(2)] == [5, 0]
    (tmp_path / "run.log").write_text("a\nb")
    assert [r.line for r in sessions.log_lines(spark, str(tmp_path / "run.log")).orderBy("pos").collect()] == ["a", "b"]
    assert sessions.inventory(spark, str(tmp_path / "s1")).count() == 3


def test_rows_of_episodes_share_an_end(spark):
    rows = spark.createDataFrame([("d", t, t) for t in range(0, 100, 10)] + [("e", 5, 5)], "dataset string, ts long, ord long")
    eps = spark.createDataFrame([("d", 0, 10, 30, False), ("d", 1, 30, 30, False), ("d", 2, 30, 50, True), ("d", 3, 70, None, None), ("e", 0, 6, None, None)], "dataset string, episode int, start_ts long, end_ts long, implicit boolean")
    want = {(0, 10), (0, 20), (0, 30), (1, 30), (2, 30), (2, 40), (3, 70), (3, 80), (3, 90)}
    for bucket in (7e-9, 1e-6):
        assert {(r.episode, r.ts) for r in episodes.rows_between(rows, eps, bucket).collect()} == want


def test_interval_lookups_equal_loops(spark):
    rng = random.Random(6)
    segs = [("k", p, p % 5, a, a + rng.choice([0.0, 0.5, 3.0])) for p, a in enumerate(sorted(round(rng.uniform(0, 30), 1) for _ in range(25)))]
    rows = [("k", round(rng.uniform(-3, 35), 1), n) for n in range(200)] + [("other", 1.0, 999)]
    s, r = spark.createDataFrame(segs, "k string, pos int, phase int, start_t double, end_t double"), spark.createDataFrame(rows, "k string, ts double, ord long")

    def near(t):
        return min(segs, key=lambda x: (not x[3] <= t <= x[4], 0 if x[3] <= t <= x[4] else min(abs(t - x[3]), abs(t - x[4])), x[1]))[2]

    for bucket in (0.7, 100.0):
        got = {x.ord: x.phase for x in labels.nearest_phase(r, s, "k", bucket).collect()}
        assert got == {o: near(t) if k == "k" else None for k, t, o in rows}
        half = {x.ord: x.phase for x in labels.half_open_phase(r, s, "k", bucket).collect()}
        assert half == {o: next((x[2] for x in segs if k == "k" and x[3] <= t < x[4]), -1) for k, t, o in rows}
    dense = {x.frame_idx: x.phase for x in labels.densified(s, spark.createDataFrame([("k", 400)], "k string, n_frames int"), "k", 10.0).collect()}
    begun = lambda f: [x for x in segs if x[3] <= f / 10.0]
    assert dense == {f: max(begun(f), key=lambda x: (x[3], x[1]))[2] if begun(f) else segs[0][2] for f in range(400)}


def test_first_cycle_equals_a_loop(spark):
    rng = random.Random(7)
    data = [("d", e, round(rng.uniform(0, 2), 2), rng.randrange(2)) for e in range(40) for _ in range(rng.randrange(1, 9))]
    got = {r.episode: (r.t_close, r.t_open) for r in signals.first_cycle(spark.createDataFrame(data, "dataset string, episode int, t double, closed int")).collect()}
    want = {}
    for e in range(40):
        pairs = [(a, b) for _, x, a, c in data if x == e and c for _, y, b, d in data if y == e and not d and b > a + 0.1]
        if pairs:
            want[e] = min(pairs)
    assert got == want


def plain_segments(t, speed, z, command, closed):
    """The rules for one episode, step by step."""
    n = len(t)
    box = lambda v: [sum(v[max(0, i - 7) : i + 8]) / 15 for i in range(n)] if n > 15 else v

    def quantile(v, q):
        v = sorted(v)
        at = q * (len(v) - 1)
        low = int(at)
        return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)

    changes = [(t[i], closed[i]) for i in range(1, n) if closed[i] != closed[i - 1]]
    cycle = min(((a, b) for a, c in changes if c for b, d in changes if not d and b > a + 0.1), default=None)
    if cycle is None:
        return [(0, round(t[0], 4), round(t[-1], 4), 0.5)]
    a, b = cycle
    smooth, wish = box(speed), box(command)
    fast, high = quantile(smooth, 0.2) + 0.005, quantile(z, 0.3)
    hz = max(1.0, 1 / quantile([y - x for x, y in zip(t, t[1:])], 0.5))
    close = sum(x < a for x in t)
    align, contact = None, a - 0.3
    for i in range(close - 1, max(0, close - int(min(2.0, a * 0.4) * hz)), -1):
        if smooth[i] > fast * 2.5 or z[i] > high * 1.5:
            align = t[min(i + 1, n - 1)] if a - t[min(i + 1, n - 1)] >= 0.2 else None
            break
    for i in range(close - 1, max(0, close - int(1.5 * hz)), -1):
        if wish[i] < 0.3:
            contact = t[min(i + 1, n - 1)]
            break
    contact = max((t[0] if align is None else align) + 0.1, min(contact, a - 0.1))
    motion = max(a, contact) + 0.15
    if align is None:
        align = max(t[0] + 0.15, contact - 0.5)
    align = max(min(align, contact - 0.15), t[0] + 0.15)
    contact = max(contact, align + 0.15)
    motion = max(motion, contact + 0.15)
    edges = [(t[0], 0), (align, 1)] + [(contact, 2)] * (b - contact >= 0.15) + [(motion, 3)] * (b - contact >= 0.3 and b - motion >= 0.15) + [(b, 4)]
    kept = []
    for x, p in sorted(edges):
        if not kept or x > kept[-1][0] + 0.075:
            kept.append((x, p))
    ends = [x for x, _ in kept[1:]] + [t[-1]]
    return [(p, round(x, 4), round(y, 4), 0.9 if p in (2, 3) else 0.75) for (x, p), y in zip(kept, ends) if y > x]


def test_phase_segments_equal_a_loop(spark):
    rng, rows, want = random.Random(8), [], {}
    for e in range(40):
        n, t, closed = rng.choice([1, 2, 12, 40, 150]), 0.0, 0
        columns = [[], [], [], [], []]
        for i in range(n):
            closed = closed if rng.random() < 0.97 else 1 - closed
            values = (t, abs(rng.gauss(0.1, 0.1)), rng.uniform(0, 0.3), rng.random(), closed)
            for c, v in zip(columns, values):
                c.append(v)
            rows.append(("d", e, int(t * 1e9), i, *values))
            t += rng.choice([0.02, 0.05, 0.033])
        want[e] = plain_segments(*columns)
    df = spark.createDataFrame(rows, "dataset string, episode int, ts long, ord long, t double, speed double, z double, command double, closed int")
    got = {}
    for r in annotate.phase_segments(annotate.backward_scans(df)).orderBy("episode", "pos").collect():
        assert r.phase_name == fields.PHASES[r.phase]
        got.setdefault(r.episode, []).append((r.phase, r.start_t, r.end_t, r.confidence))
    assert {e: [x[:2] for x in v] for e, v in want.items() if v != [(0, 0.0, 0.0, 0.5)]} == {e: [x[:2] for x in v] for e, v in got.items()}
    assert all(abs(x[2] - y[2]) < 1e-3 and x[3] == y[3] for e in got for x, y in zip(got[e], want[e]))


def test_frames_that_are_missing(spark):
    import pytest

    steps = spark.createDataFrame([("d", 0, t, t) for t in (100, 200, 900)], "dataset string, episode int, ts long, ord long")
    frames = spark.createDataFrame([("d", 110, 1, "v.mp4", 7), ("d", 190, 2, "v.mp4", 8)], "dataset string, ts long, ord long, rgb_video string, rgb_video_frame long")
    assert [r.top.rgb_video_frame for r in alignment.with_frames(steps, {"top": frames}, 10, "drop").orderBy("ts").collect()] == [7, 8]
    assert [r.top for r in alignment.with_frames(steps, {"top": frames}, 10, "null").orderBy("ts").collect()][2] is None
    with pytest.raises(Exception, match="no frame of top"):
        alignment.with_frames(steps, {"top": frames}, 10).collect()


def test_trim_requests(spark):
    bounds = spark.createDataFrame([("d", 0, 1.0, 5.0)], "dataset string, episode int, start_s double, end_s double")
    asked = [(0, 1.0, 5.0, None), (0, 1.23456, 2.0, None), (0, 0.9, 2.0, "bounds"), (0, 2.0, 5.1, "bounds"), (0, 2.0, 2.0, "order"), (1, 1.0, 2.0, "no_episode"), (0, None, 2.0, "missing")]
    rows = spark.createDataFrame([("d", *x) for x in asked], "dataset string, episode int, trim_start_s double, trim_end_s double, want string")
    out = alignment.checked_trims(rows, bounds).collect()
    assert all(r.reason == r.want for r in out) and 1.2346 in {r.trim_start_s for r in out}


def test_fields_of_short_vectors(spark):
    import pytest

    rows = spark.createDataFrame([([1.0],), ([],), (None,), ([1.0, 2.0, 3.0],)], "q array<double>")
    assert [r[0] for r in rows.select(fields.dimension_names(F.col("q"), "q", "g")).collect()] == [["g"], None, None, ["q_0", "q_1", "g"]]
    with pytest.raises(Exception, match="no joint positions"):
        rows.select(fields.state_vector(F.col("q"), F.lit(0.1))).collect()
    with pytest.raises(Exception, match="don't fit"):
        rows.where("q is not null").select(fields.checked_names(F.col("q"), F.array(F.lit("a")))).collect()
    dropped = spark.range(20_000).select(fields.dropped_phase(F.lit(1), F.col("id")).alias("p")).where("p = 5").count()
    assert abs(dropped / 20_000 - 0.15) < 0.01


def test_system_message(spark):
    text = spark.range(1).select(fields.system_message({"pick_place": {0: "moves", 2: "touches"}}, {2: "force"}, "Answer in JSON.")).first()[0]
    assert "Phase 2: contact_establish\n- pick_place: touches\n- cue: force\n" in text and text.endswith("Answer in JSON.") and "Phase 4: verify_release" in text


def test_own_sampler(spark):
    rows = spark.createDataFrame([("d", e, t, t) for e in range(3) for t in (3, 1, 2)], "dataset string, episode int, ts long, ord long")
    got = signals.sampled(rows, lambda pdf: pdf.iloc[[0]][["dataset", "episode", "ts"]], "dataset string, episode int, ts long").collect()
    assert sorted((r.episode, r.ts) for r in got) == [(0, 1), (1, 1), (2, 1)]


def test_merging_errors_and_other_stats(spark):
    import pytest

    files = spark.createDataFrame([("a", 1), ("a", 1)], "dataset string, file_index long")
    with pytest.raises(Exception, match="duplicate file index"):
        merging.remapped_files(files).collect()
    with pytest.raises(Exception, match="file that isn't there"):
        merging.remapped_file_columns(spark.createDataFrame([("a", 3)], "dataset string, file_index long"), merging.remapped_files(files.distinct())).collect()
    stats = spark.createDataFrame([("b", 3, "f", "shape", 0, 5.0), ("a", 1, "f", "shape", 0, 1.0), ("a", 1, "f", "q90", 0, 1.0), ("b", 3, "f", "q90", 0, 5.0)], "dataset string, frames long, feature string, stat string, pos int, value double")
    assert {r.stat: r.value for r in merging.merged_stats(stats).collect()} == {"shape": 1.0, "q90": 4.0}
    assert labels.registered_columns(spark.createDataFrame([("a", ["phase"]), ("b", None)], "dataset string, extra_columns array<string>")).orderBy("dataset").collect()[0].extra_columns == ["phase", "subtask"]


def test_sidecars_texts_and_documents_round_trip(spark, tmp_path):
    import json

    for name in ("s1", "s2", "s3"):
        (tmp_path / name / "text").mkdir(parents=True)
        (tmp_path / name / "meta").mkdir()
        (tmp_path / name / "data" / "chunk-000").mkdir(parents=True)
        (tmp_path / name / "meta" / "info.json").write_text('{\n "codebase_version": "v3.0", "fps": 30\n}')
        (tmp_path / name / "meta" / "stats.json").write_text('{"action": {"mean": [1.0, 2.0], "min": [0.5, 0.25]}}')
        spark.createDataFrame([(k, k) for k in range(3)], "index long, episode_index long").coalesce(1).toPandas().to_parquet(tmp_path / name / "data" / "chunk-000" / "f.parquet")
    (tmp_path / "s1" / "text.jsonl").write_text('{"text": " ", "task": "a", "timestamp_ns": 5}\n')
    (tmp_path / "s1" / "language.jsonl").write_text('{"text": "b"}\n')
    (tmp_path / "s2" / "language.jsonl").write_text('{"instruction": "c"}\n')
    (tmp_path / "s3" / "text" / "text.jsonl").write_text('{"caption": "d"}\n')
    assert {(r.dataset, r.value) for r in sessions.texts(spark, str(tmp_path)).collect()} == {("s1", "a"), ("s2", "c"), ("s3", "d")}
    assert sessions.texts(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "s1" / "annotations.jsonl").write_text('{"episode_index": 0, "task": "x"}\n{"task": "y"}\n{"episode_index": 0, "task": "z"}\n{"episode_index": 1}\n')
    (tmp_path / "s1" / "trims.jsonl").write_text('{"episode_index": 2, "trim_end_s": 4.5}\n')
    (tmp_path / "s1" / "subtasks.jsonl").write_text('{"episode_index": 0, "subtasks": [{"phase": "a", "start_s": 0.0, "end_s": 1.0}]}\n{"episode_index": 1, "subtasks": "none"}\n')
    assert [(r.episode, r.task) for r in sessions.sidecar(spark, str(tmp_path), "annotations").collect()] == [(0, "z")]
    assert [(r.episode, r.trim_start_s, r.trim_end_s) for r in sessions.sidecar(spark, str(tmp_path), "trims").collect()] == [(2, 0.0, 4.5)]
    assert [(r.episode, len(r.subtasks)) for r in sessions.sidecar(spark, str(tmp_path), "subtasks").collect()] == [(0, 1)]
    assert {(r.dataset, r.fps) for r in sessions.info(spark, str(tmp_path)).collect()} == {("s1", 30), ("s2", 30), ("s3", 30)}
    read = sessions.stats(spark, str(tmp_path))
    assert read.count() == 12 and read.where("stat = 'min' and pos = array(1) and value = 0.25").count() == 3
    sessions.write_stats(merging.merged_stats(read.withColumn("frames", F.lit(2))), str(tmp_path / "merged"))
    assert json.loads(spark.read.text(str(tmp_path / "merged")).first()[0]) == {"action": {"mean": [1.0, 2.0], "min": [0.5, 0.25]}}
    sessions.write_info(sessions.info(spark, str(tmp_path)), str(tmp_path / "infos"))
    assert spark.read.json(str(tmp_path / "infos")).count() == 3
    assert sessions.converted_frames(spark, str(tmp_path)).groupBy("dataset").count().count() == 3
    rows = spark.createDataFrame([("s1", "e", "pick_place", 0.9, "n", "rule", 4.5, 100, True, 1)], "dataset string, episode_id string, task string, overall_confidence double, notes string, method string, duration_s double, n_robot_frames long, validation_passed boolean, validation_warnings long")
    sessions.write_annotations(rows, str(tmp_path / "ann"))
    back = sessions.annotations(spark, str(tmp_path / "ann")).first()
    assert (back.episode_id, back.dataset, back._meta.method, back._meta.n_robot_frames) == ("e", "s1", "rule", 100)
    good = sessions.quarantine(spark.range(10), F.when(F.col("id") % 3 == 0, "third"), str(tmp_path / "rejects"))
    assert good.count() == 6 and spark.read.json(str(tmp_path / "rejects")).count() == 4
    (tmp_path / "s1" / "robot.jsonl").write_text("".join(f'{{"timestamp_ns": {k}}}\n' for k in range(500)))
    order = sessions.telemetry(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.timestamp_ns for r in order] == [*range(500)]
    sessions.write_lines(spark.range(3).withColumn("dataset", F.lit("x")), str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 3
