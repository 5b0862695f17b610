"""Clean, convert and merge from session folders to written tables, twice with the same result."""

import json

import pytest
from pyspark.sql import functions as F

from episodica.operators import episodes, signals
from episodica.plans import jobs

S = 1_000_000_000


def session(folder, cameras, episodes_, texts=(), annotations=(), subtasks=(), trims=()):
    """Telemetry every 0.1 s of 20 s; the arm moves in each episode (start, end, first and last moving second)."""
    folder.mkdir(parents=True)
    rows, events, moved = [], [], 0
    for k in range(200):
        t = k / 10
        moving = any(a <= t <= z for _, _, a, z in episodes_)
        moved += moving
        rows.append({
            "timestamp_ns": k * S // 10, "robot_state": {"q": [0.01 * moved, 1.0], "q_cmd": [float(k), 2.0], "gripper_width": 0.01},
            "executed_action": {"cartesian_delta_translation": [0.001 if moving else 0.0, 0, 0], "cartesian_delta_rotation": [0.0, 0.0, 0.0], "gripper_command": 1.0},
        })
    for a, z, *_ in episodes_:
        events += [{"event": "Episode_Start ", "robot_timestamp_ns": int(a * S)}, {"episode_event": "episode_stop", "robot_timestamp_ns": int(z * S)}]
    lines = lambda xs: "".join(json.dumps(x) + "\n" for x in xs)
    (folder / "robot.jsonl").write_text(lines(rows))
    (folder / "episode_events.jsonl").write_text(lines(events))
    for camera, (first, last) in cameras.items():
        (folder / "cameras" / camera).mkdir(parents=True)
        (folder / "cameras" / camera / "frames.jsonl").write_text(lines({"frame_index": i, "timestamp_ns": int(first * S) + i * S // 10, "width": 2, "height": 2} for i in range(int((last - first) * 10) + 1)))
    for name, xs in (("text", texts), ("annotations", annotations), ("subtasks", subtasks), ("trims", trims)):
        if xs:
            (folder / f"{name}.jsonl").write_text(lines(xs))


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    # of a's episodes one moves for 4 s and cameras cover it, one doesn't move, one moves too briefly, one is beyond the wrist's frames
    session(
        root / "a", {"top": (0, 19.9), "wrist": (0, 12)}, [(0, 5, 1, 4.95), (5.5, 8, 30, 31), (8.2, 11, 9, 9.5), (13, 18, 13.5, 17)],
        texts=[{"text": "pick it", "timestamp_ns": 2 * S}], subtasks=[{"episode_index": 0, "subtasks": [{"phase": "approach_can", "start_s": 1.0, "end_s": 2.0}, {"phase": "other", "start_s": 2.5, "end_s": 5.0}]}],
    )
    session(root / "b", {"top": (0, 19.9), "wrist": (0, 19.9)}, [(1, 4, 1, 4), (6, 16, 6, 16)], annotations=[{"episode_index": 1, "task": "place it"}], trims=[{"episode_index": 1, "trim_start_s": 7.0, "trim_end_s": 9.0}])
    return str(root)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_clean(spark, folders, tmp_path):
    source, out = jobs.of_folders(spark, folders), str(tmp_path / "clean")
    counts = jobs.clean(source, out, prompts=["one", "two"])
    assert counts == {"static": 1, "no_coverage": 1, "too_short": 1, "kept": 3}
    ends = spark.read.parquet(f"{out}/events").where("dataset = 'a'").orderBy("ord").collect()
    assert [(r.ts, r.name) for r in ends] == [(1 * S, "start"), (4_900_000_000, "end")]
    assert spark.read.parquet(f"{out}/telemetry").groupBy("dataset").count().orderBy("dataset").collect() == [("a", 40), ("b", 31 + 101)]
    assert sorted(map(tuple, spark.read.parquet(f"{out}/annotations").select("dataset", "episode", "task").collect())) == [("a", 0, "one"), ("b", 0, "one"), ("b", 1, "two")]
    before = {n: rows(spark.read.parquet(f"{out}/{n}")) for n in ("telemetry", "events", "frames", "annotations")}
    assert jobs.clean(source, out, prompts=["one", "two"]) == counts
    assert {n: rows(spark.read.parquet(f"{out}/{n}")) for n in before} == before
    # what was cleaned has episodes of its own, and is converted as a session
    report = jobs.convert(jobs.saved(spark, out), str(tmp_path / "from-clean"))
    assert sorted((r.dataset, r.episode, r.step_count) for r in report.collect()) == [("a", 0, 39), ("b", 0, 30), ("b", 1, 100)]
    assert jobs.clean(source, str(tmp_path / "first"), max_episodes=1)["kept"] == 2


def test_convert_and_merge(spark, folders, tmp_path):
    source, out = jobs.of_folders(spark, folders), str(tmp_path / "converted")
    with pytest.raises(Exception, match="no frame of wrist within the tolerance"):
        jobs.convert(source, out).collect()
    report = {(r.dataset, r.episode): r for r in jobs.convert(source, out, strict=False).collect()}
    assert {k: (r.step_count, r.suppressed) for k, r in report.items()} == {("a", 0): (50, False), ("a", 1): (25, False), ("a", 2): (28, False), ("b", 0): (30, False), ("b", 1): (20, False)}
    assert report["a", 0].task == "pick it" and report["b", 1].task == "place it" and report["b", 0].task == "episode_000000"
    frames = spark.read.parquet(f"{out}/frames")
    one = frames.where("dataset = 'a' and episode_index = 0").orderBy("frame_index").collect()
    assert [r["index"] for r in one] == list(range(50)) and one[3].timestamp == pytest.approx(0.3)
    assert [round(x, 4) for x in one[12]["observation.state"]] == [0.03, 1.0, 0.01] and list(one[12].action) == [12.0, 2.0, 1.0]
    assert set(one[0].frames) == {"observation.images.top", "observation.images.wrist"} and one[12].frames["observation.images.wrist"].rgb_video_frame == 12
    assert {r.frame_index: r.subtask for r in one}[15] == "approach_can" and {r.frame_index: r.subtask for r in one}[24] == "other" and one[0].subtask == "approach_can"
    tasks = {(r.dataset, r.task_index): r.task for r in spark.read.parquet(f"{out}/tasks").collect()}
    assert tasks["a", one[15].task_index] == "Move the gripper to the soup can" and tasks["a", one[30].task_index] == "pick it"
    starts = {(r.dataset, r.episode_index): (r.dataset_from_index, r.dataset_to_index) for r in spark.read.parquet(f"{out}/episodes").collect()}
    assert starts["a", 1] == (50, 75) and starts["b", 1] == (30, 50)
    subtasks = spark.read.parquet(f"{out}/subtasks").collect()
    assert [(r.dataset, r.episode_index, [tuple(p) for p in r.phases]) for r in subtasks] == [("a", 0, [("approach_can", 1.0, 2.0), ("other", 2.5, 5.0)])]
    stats = spark.read.parquet(f"{out}/stats").where("dataset = 'b' and feature = 'action' and pos = 0")
    want = frames.where("dataset = 'b'").select(F.col("action")[0].cast("double").alias("x")).agg(F.avg("x"), F.percentile("x", 0.9), F.stddev_pop("x")).first()
    got = {r.stat: r.value for r in stats.collect()}
    assert (got["mean"], got["q90"], got["std"], got["count"]) == pytest.approx((*want, 50))

    merged = str(tmp_path / "merged")
    names = [("b", "a"), ("a",)]
    totals = [jobs.merge(spark, out, list(n), merged, "pooled") for n in (names[1], names[0], names[0])]
    assert totals[1] == totals[2] == {"total_episodes": 5, "total_frames": 153, "total_tasks": 6} and totals[0]["total_frames"] == 103
    both = spark.read.parquet(f"{merged}/frames")
    assert sorted(r["index"] for r in both.collect()) == list(range(153))
    assert both.where("dataset = 'a'").agg(F.min("index"), F.min("episode_index")).first() == (50, 2)
    names = {r.task_index: r.task for r in spark.read.parquet(f"{merged}/tasks").collect()}
    assert names[0] == "episode_000000" and both.where("index = 65").first().task_index == [k for k, t in names.items() if t.startswith("Move")][0]
    document = json.loads(spark.read.text(f"{merged}/stats").first()[0])
    every = both.select(F.col("action")[0].cast("double").alias("x")).agg(F.stddev_pop("x")).first()[0]
    assert document["action"]["std"][0] == pytest.approx(every) and document["action"]["count"][0] == 153
    with pytest.raises(ValueError, match="not converted: c"):
        jobs.merge(spark, out, ["a", "c"], merged)


def test_skip_counts_are_seen_in_one_pass(spark):
    data = [("d", e, t * S, t, e != 1, e != 2) for e in range(4) for t in range(1 if e == 3 else 5)]
    df = spark.createDataFrame(data, "dataset string, episode int, ts long, ord long, moving boolean, has boolean")
    kept, seen = signals.cleaned_and_counted(df, "moving", "has")
    assert {r.episode for r in kept.collect()} == {0} and seen.get == {"static": 1, "no_coverage": 1, "too_short": 1, "kept": 1}
    assert {r.episode: r.reason for r in signals.skip_reasons(df, "moving", "has").collect()} == {0: "kept", 1: "static", 2: "no_coverage", 3: "too_short"}


@pytest.mark.parametrize("block", [2.0, 1e5])
def test_deleted_episodes_shift_all_sidecars(spark, block):
    gone = spark.createDataFrame([("a", e) for e in (0, 3, 4, 9, 9)] + [("b", 1), ("c", 0)], "dataset string, episode long")
    rows = [("a", e, f"t{e}{k}") for e in range(12) for k in range(2)] + [("b", 0, "x"), ("b", 1, "y"), ("b", 2, "z"), ("d", 5, "w"), ("a", None, "none")]
    for kind in ("long", "int"):
        side = spark.createDataFrame(rows, f"dataset string, episode {kind}, task string")
        out = episodes.without_episodes(side, gone, block)
        lost = {("a", 0), ("a", 3), ("a", 4), ("a", 9), ("b", 1), ("c", 0)}
        want = [(d, e if e is None else e - sum(x < e for y, x in lost if y == d), t) for d, e, t in rows if (d, e) not in lost]
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr) and out.dtypes == side.dtypes
