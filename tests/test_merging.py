"""Merging of datasets and their documents: nested statistics, video files, readiness, error lines."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import fields
from episodica.operators import merging, reports
from episodica.sources import sessions


def documents(tmp_path, stats):
    for name, value in stats.items():
        (tmp_path / name / "meta").mkdir(parents=True)
        (tmp_path / name / "meta" / "stats.json").write_text(value if isinstance(value, str) else json.dumps(value))
    return str(tmp_path)


def merged_document(spark, stats, frames, tmp_path, **options):
    sizes = F.create_map(*[F.lit(x) for pair in frames.items() for x in pair])
    sessions.write_stats(merging.merged_stats(stats.withColumn("frames", sizes[F.col("dataset")]), **options), str(tmp_path / "merged"))
    return json.loads(spark.read.text(str(tmp_path / "merged")).first()[0])


def test_nested_statistics_round_trip(spark, tmp_path):
    image = {"mean": [[[0.25]], [[0.5]], [[0.125]]], "std": [[[0.5]], [[1.0]], [[2.0]]], "min": [[[0]], [[0]], [[0]]], "count": [7]}
    one = {"observation.images.top": image, "action": {"mean": [1.0, -2.5], "q50": [1e-7, 3.0], "note": "of \"a\"", "empty": [], "ragged": [[1], [2, 3]], "none": None}, "fps": 30, "plain": [1, 2]}
    stats = sessions.stats(spark, documents(tmp_path, {"a": one, "b": "{broken", "c": "[1]"}))
    assert merged_document(spark, stats, {"a": 5}, tmp_path) == one
    assert sorted(map(tuple, sessions.unreadable_stats(spark, str(tmp_path)).collect())) == [("b", "stats.json is no JSON"), ("c", "stats.json is no object")]


def test_statistics_of_two_datasets(spark, tmp_path):
    a = {"x": {"mean": [[1.0]], "min": [[3.0]], "max": [[3.0]], "count": [2], "q01": [[4.0]], "other": "a"}, "only": {"mean": [8.0]}, "fps": 30}
    b = {"x": {"mean": [[5.0]], "min": [[2.0]], "max": [[9.0]], "count": [6], "q01": [[0.0]], "other": "b"}, "fps": 25}
    stats = sessions.stats(spark, documents(tmp_path, {"a": a, "b": b}))
    want = {"x": {"mean": [[4.0]], "min": [[2.0]], "max": [[9.0]], "count": [8], "q01": [[1.0]], "other": "b"}, "only": {"mean": [2.0]}, "fps": 25}
    got = merged_document(spark, merging.in_order(stats, ["b", "a"]), {"a": 1, "b": 3}, tmp_path, order="nth")
    assert got == want


def test_pooled_statistics_are_those_of_all_frames(spark):
    draw = np.random.default_rng(1)
    parts = {d: draw.normal(1e6 * k, 3.0, 50 * (k + 1)) for k, d in enumerate("abc")}
    rows = [(d, len(x), "f", stat, 0, float(v)) for d, x in parts.items() for stat, v in (("mean", x.mean()), ("std", x.std()), ("min", x.min()))]
    stats = spark.createDataFrame(rows + [("d", 0, "f", "mean", 0, 7.0), ("d", 0, "f", "std", 0, 7.0)], "dataset string, frames long, feature string, stat string, pos int, value double")
    got = {r.stat: r.value for r in merging.merged_stats(stats, mode="pooled").collect()}
    every = np.concatenate([*parts.values()])
    assert got["mean"] == pytest.approx(every.mean(), rel=1e-12) and got["std"] == pytest.approx(every.std(), rel=1e-9) and got["min"] == every.min()
    with pytest.raises(ValueError):
        merging.merged_stats(stats, mode="other")


def test_video_files_by_key_in_the_given_order(spark):
    rows = [("a", "top", 0, "a/t0"), ("a", "top", 7, "a/t7"), ("a", "wrist", 0, "a/w0"), ("b", "top", 3, "b/t3"), ("b", "wrist", 1, "b/w1"), ("b", "wrist", 2, "b/w2")]
    files = merging.in_order(spark.createDataFrame(rows, "dataset string, video_key string, file_index long, path string"), ["b", "a"])
    mapped = merging.remapped_files(files, "nth", "video_key")
    assert {(r.dataset, r.video_key, r.file_index): r.global_file for r in mapped.collect()} == {
        ("b", "top", 3): 0, ("a", "top", 0): 1, ("a", "top", 7): 2, ("b", "wrist", 1): 0, ("b", "wrist", 2): 1, ("a", "wrist", 0): 2
    }
    assert ("a/t7", "videos/top/chunk-000/file-002.mp4") in {tuple(r) for r in merging.copy_manifest(mapped).collect()}
    names = {"top": "videos/top/file_index", "wrist": "videos/wrist/file_index"}
    episodes = spark.createDataFrame([("a", 0, 7, 0), ("b", 0, 3, 2), ("c", 0, 5, 6)], f"dataset string, episode_index long, `{names['top']}` long, `{names['wrist']}` long")
    got = {r.dataset: (r[names["top"]], r[names["wrist"]]) for r in merging.remapped_file_columns(episodes, mapped, names, "video_key").collect()}
    assert got == {"a": (2, 2), "b": (0, 1), "c": (5, 6)}  # a dataset without files keeps its indices
    with pytest.raises(Exception, match="file that isn't there: 1"):
        merging.remapped_file_columns(episodes.withColumn(names["top"], F.lit(1)), mapped, names, "video_key").collect()
    with pytest.raises(Exception, match="duplicate file index 7"):
        merging.remapped_files(files.unionByName(files.where("file_index = 7")), "nth", "video_key").collect()


def test_registry_and_offsets_in_the_given_order(spark):
    tasks = merging.in_order(spark.createDataFrame([("a", 0, "x"), ("b", 0, "y"), ("b", 1, "x"), ("c", 0, "z")], "dataset string, task_index long, task string"), ["b", "a"])
    registry = merging.task_registry(tasks, "nth")
    assert {r.task: r.global_index for r in registry.collect()} == {"y": 0, "x": 1}
    used = merging.in_order(spark.createDataFrame([("a", 5), ("a", None), ("b", 9), ("b", 0)], "dataset string, task_index long"), ["b", "a"])
    full = merging.full_registry(registry, merging.synthetic_tasks(used, tasks, "nth"), "nth")
    assert {r.task: r.global_index for r in full.collect()} == {"y": 0, "x": 1, "unknown task (b:9)": 2, "unknown task (a:5)": 3, "unknown task (a:null)": 4}
    sizes = merging.in_order(spark.createDataFrame([("a", 2, 20), ("b", 3, 30)], "dataset string, n_episodes long, n_frames long"), ["b", "a"])
    assert {tuple(r) for r in merging.offsets(sizes, "nth").collect()} == {("b", 0, 0), ("a", 3, 30)}
    infos = merging.in_order(spark.createDataFrame([("a", 30), ("b", None), ("c", 25)], "dataset string, fps int"), ["b", "a"])
    assert [tuple(r) for r in merging.incompatibilities(infos, ["fps"], "nth").collect()] == [("a", "fps", None, "30")]


def test_readiness_of_folders(spark, tmp_path):
    def dataset(name, info='{"codebase_version": "v3.0", "total_episodes": 25, "total_frames": 10000, "total_tasks": 5}', without=()):
        for file in ("meta/tasks.parquet", "meta/stats.json", "data/chunk-000/f.parquet", "videos/observation.images.top/chunk-000/file-000.mp4"):
            if file.split("/")[0] not in without and file not in without:
                (tmp_path / name / file).parent.mkdir(parents=True, exist_ok=True)
                (tmp_path / name / file).write_text("x")
        if info is not None:
            (tmp_path / name / "meta").mkdir(parents=True, exist_ok=True)
            (tmp_path / name / "meta" / "info.json").write_text(info)

    dataset("ready")
    dataset("bare", without=("videos", "data", "meta/stats.json", "meta/tasks.parquet"))
    dataset("raw", info=None)
    dataset("broken", info="{")
    dataset("empty", info='{"codebase_version": "v2.1"}')
    got = {}
    for r in merging.readiness(sessions.dataset_facts(spark, str(tmp_path))).collect():
        got.setdefault(r.dataset, set()).add((r.rule, r.severity))
    error = lambda *rules: {(r, "error") for r in rules}
    assert got == {
        "bare": error("videos", "data", "tasks_file") | {("stats", "warning")}, "raw": error("info"), "broken": error("info_json"), "empty": error("version", "episodes", "frames", "tasks")
    }


def test_error_lines_of_logs(spark):
    rule = "=" * 65
    logs = {
        "block": (["x error", "[rank0]: Traceback (most recent call last):", "old", rule, " [rank1]: Traceback (most recent call last):", "-----", "=" * 64, "E", rule, "after"], [4, 5, 6, 7]),
        "open": (["Traceback (most recent call last):", "E"], [0, 1]),
        "words": (["Killed", "step failed", "out of OOM", "cuda", "fine", "an Exception"], [0, 2, 3, 5]),
        "tail": (["a", "failed", "c"], [0, 1, 2]),
    }
    lines = spark.createDataFrame([(k, i, x) for k, (ls, _) in logs.items() for i, x in enumerate(ls)], "path string, pos int, line string")
    got = {k: [] for k in logs}
    for r in reports.log_errors(lines).orderBy("pos").collect():
        got[r.path].append(r.pos)
    assert got == {k: want for k, (_, want) in logs.items()}
    few = reports.log_errors(lines, most_matches=2, most_lines=1)
    assert {(r.path, r.pos) for r in few.where("path in ('words', 'tail')").collect()} == {("words", 3), ("words", 5), ("tail", 2)}


def test_filled_tasks_are_counted(spark):
    rows = spark.createDataFrame([("a",), (None,), (None,), ("",)], "task string")
    filled, seen = fields.filled_tasks(rows)
    assert sorted(r.task for r in filled.collect()) == sorted(["a", "", fields.FALLBACK_TASK, fields.FALLBACK_TASK])
    assert seen.get == {"n_rows": 4, "n_filled": 2}


def test_no_task_holds_the_rows_of_a_dataset(spark):
    """The offsets go to the rows, so rows of one dataset stay in as many parts as they came in."""
    shift = spark.createDataFrame([("a", 0, 0), ("b", 7, 4000)], "dataset string, episode_offset long, frame_offset long")
    frames = spark.range(4400, numPartitions=8).selectExpr("if(id < 4000, 'a', 'b') AS dataset", "id % 7 AS episode_index", "id AS index")
    episodes = frames.selectExpr("dataset", "episode_index", "index AS dataset_from_index", "index + 1 AS dataset_to_index")
    for out in (merging.united(frames, shift), merging.united_episodes(episodes, shift)):
        assert max(map(len, out.rdd.glom().collect())) == 550
    got = {(r.dataset, r["index"]): r.episode_index for r in merging.united(frames, shift).collect()}
    assert got == {("a" if k < 4000 else "b", k if k < 4000 else k + 4000): k % 7 if k < 4000 else k % 7 + 7 for k in range(4400)}
