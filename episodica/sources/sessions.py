"""Sources and sinks of session folders and converted datasets; every row gets its dataset from the path."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import ANNOTATION, TEXT_FIELDS, first_text
from ..operators.episodes import latest
from ..operators.stored import stored

TIMES = "host_timestamp_ns long, timestamp_ns long, robot_timestamp_ns long, receive_host_time_ns long, created_unix_time_ns long"
TELEMETRY = TIMES + ", robot_state struct<q:array<double>,dq:array<double>,q_cmd:array<double>,tcp_position_xyz:array<double>,tcp_orientation_xyzw:array<double>,gripper_width:double,gripper_state:string>, executed_action struct<cartesian_delta_translation:array<double>,cartesian_delta_rotation:array<double>,gripper_command:double>, backfilled_q_cmd array<double>"
EVENTS = TIMES + ", event string, episode_event string, teleop_state string"
CAMERA = TIMES + ", camera string, frame_index long, rgb_video string, rgb_video_frame long, width int, height int"
TEXT = TIMES + ", text string, instruction string, task string, transcript string, utterance string, caption string"
ANNOTATIONS = "episode_index long, task string, annotated_at string"
TRIMS = "episode_index long, trim_start_s double, trim_end_s double"
SUBTASKS = "episode_index long, subtasks array<struct<phase:string,start_s:double,end_s:double>>"


def dataset_of(depth: int = 1) -> Column:
    """Name of the folder ``depth`` levels above the file."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - depth)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): lines of text files with their number from 1, whichever way Spark cuts and packs the files.

    Spark reads a block of a file in one task and in order. So a line's number within its block comes from its place among the block's rows, and the lines of earlier blocks are
    counted: a window spans a block of a file (at most spark.sql.files.maxPartitionBytes), never a file.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("__id"))
    blocks = raw.groupBy("path", "start").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("path").alias("__p"), F.col("start").alias("__s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    own = F.row_number().over(Window.partitionBy("path", "start").orderBy("__id"))
    placed = raw.withColumn("__own", own).join(blocks.hint("merge"), (F.col("path") == F.col("__p")) & (F.col("start") == F.col("__s")))
    return placed.select("path", (F.col("__first") + F.col("__own")).alias("line"), "value")


def read_lines(spark: SparkSession, path: str, schema: str, depth: int = 1, strict: bool = True) -> DataFrame:
    """JSON lines of many sessions in one read, with ``dataset`` and ``ord``, the number of the line in its file. Blank lines don't count but are numbered.

    A bad line is an error that names file and line, or with ``strict`` off a row with _corrupt_record. A line is bad if it is no JSON object, or if a value has
    another type than the schema.
    """
    lines = numbered_lines(spark, path).where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    at = F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.withColumn("j", at)
    bad = F.col("j._corrupt_record")
    if strict:
        message = F.format_string("bad JSON on line %d of %s", "line", "path")
        rows = rows.withColumn("line", F.when(bad.isNotNull() | F.col("j").isNull(), F.raise_error(message).cast("long")).otherwise(F.col("line")))
    names = [f.name for f in rows.schema["j"].dataType.fields if f.name != "_corrupt_record" or not strict]
    folder = F.element_at(F.split("path", "/"), -1 - depth)
    return rows.select(*[F.col("j")[n].alias(n) for n in names], folder.alias("dataset"), F.col("line").alias("ord"), F.col("path").alias("__path"))


def without_path(rows: DataFrame) -> DataFrame:
    return rows.drop("__path")


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    return without_path(read_lines(spark, f"{path}/*/robot.jsonl", TELEMETRY))


def episode_events(spark: SparkSession, path: str) -> DataFrame:
    raw = without_path(read_lines(spark, f"{path}/*/episode_events.jsonl", EVENTS))
    return raw.withColumn("raw_name", F.coalesce(F.nullif(F.trim("event"), F.lit("")), F.col("episode_event")))


def camera_frames(spark: SparkSession, path: str) -> DataFrame:
    """A3: frames of all cameras, with defaults; cameras without frames have no rows, and a folder in which no camera has any is an error."""
    raw = read_lines(spark, f"{path}/*/cameras/*/frames.jsonl", CAMERA, depth=3)
    if raw.isEmpty():
        raise ValueError(f"no camera frames below {path}")
    folder = F.element_at(F.split("__path", "/"), -2)
    raw = raw.withColumn("folder", folder)
    return without_path(raw).withColumn("camera", F.coalesce("camera", "folder")).withColumn("rgb_video", F.coalesce("rgb_video", F.lit("rgb.mp4"))).withColumn("rgb_video_frame", F.coalesce("rgb_video_frame", "frame_index"))


def first_source(candidates: list[DataFrame]) -> DataFrame:
    """A4: of several alternatives each dataset's first one that has rows."""
    ranked = [df.withColumn("__rank", F.lit(k)) for k, df in enumerate(candidates)]
    all_ = reduce(DataFrame.unionByName, ranked)
    best = all_.groupBy(F.col("dataset").alias("d")).agg(F.min("__rank").alias("r"))
    return all_.join(best.hint("merge"), (F.col("dataset") == F.col("d")) & (F.col("__rank") == F.col("r"))).drop("d", "r", "__rank")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """A4: text records of each dataset from the first of text.jsonl, language.jsonl and text/text.jsonl that has rows, with ``value`` (B2); none if no session has any."""
    found = []
    for pattern, depth in (("*/text.jsonl", 1), ("*/language.jsonl", 1), ("*/text/text.jsonl", 2)):
        try:
            found.append(without_path(read_lines(spark, f"{path}/{pattern}", TEXT, depth)))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    if not found:
        return spark.createDataFrame([], TEXT + ", dataset string, ord long, value string")
    return first_source(found).withColumn("value", first_text(*[F.col(c) for c in TEXT_FIELDS]))


def sidecar(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A5: annotations, trims or subtasks: (dataset, episode, ...), the last row of each episode; rows without an episode, and subtasks that are no list, don't count."""
    schema, needs = {"annotations": (ANNOTATIONS, "task is not null"), "trims": (TRIMS, "true"), "subtasks": (SUBTASKS, "subtasks is not null")}[name]
    rows = without_path(read_lines(spark, f"{path}/*/{name}.jsonl", schema, strict=False)).where("episode_index is not null").where(needs)
    rows = latest(rows.drop("_corrupt_record"), ["dataset", "episode_index"], [F.desc("ord")]).withColumnRenamed("episode_index", "episode").drop("ord")
    return rows.fillna(0.0, ["trim_start_s", "trim_end_s"]) if name == "trims" else rows


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, a folder a dataset."""
    rows.write.partitionBy("dataset").json(path)


def converted_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of converted datasets; order is that of ``index``, not of files."""
    return spark.read.parquet(f"{path}/*/data/*/*.parquet").withColumn("dataset", dataset_of(3))


def write_table(rows: DataFrame, path: str, keys: tuple[str, ...] = ("dataset",)) -> None:
    """Parquet, a folder a key."""
    rows.write.partitionBy(*keys).parquet(path)


def write_missing(rows: DataFrame, spark: SparkSession, path: str, keys: list[str]) -> int:
    """Append rows whose keys aren't written yet; returns how many."""
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
    except Exception as error:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = None
    new = (rows if done is None else rows.join(done, keys, "left_anti")).cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def info(spark: SparkSession, path: str) -> DataFrame:
    """The info document of each dataset."""
    return _documents(spark, f"{path}/*/meta/info.json", 2)


def _documents(spark: SparkSession, path: str, depth: int, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path).withColumn("dataset", dataset_of(depth))


def _variants(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, v): whole JSON documents below a dataset's meta folder, null where one can't be read."""
    whole = spark.read.option("wholetext", True).text(path).withColumn("dataset", dataset_of(2))
    return whole.select("dataset", F.try_parse_json("value").alias("v"))


def _entries(rows: DataFrame, keep: list, name: str) -> DataFrame:
    """One row an entry of the variant ``v``: what is kept, the entry's key or place, and its value as ``v``."""
    named = rows.select(*[F.col(c).alias(f"__{c}") for c in keep], "v")  # apart from the names that exploding gives
    met = named.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return met.select(*[F.col(f"__{c}").alias(c) for c in keep], F.coalesce(F.col("key"), F.col("pos").cast("string")).alias(name), F.col("value").alias("v"))


def _is(kind: str) -> Column:
    return F.coalesce(F.schema_of_variant("v").startswith(kind), F.lit(False))


def flattened(rows: DataFrame) -> DataFrame:
    """Rows with a variant ``v`` -> one row a leaf of its nested lists: ``pos`` (array of the places that lead there, empty for what is no list), ``value`` (a number, or null) and ``json`` (the leaf as text).

    Each round opens one level of the lists that are left, as deep as they go. An empty list is a leaf, as is an object.
    """
    keep = [c for c in rows.columns if c != "v"]
    rest, out = stored(rows.withColumn("pos", F.array().cast("array<int>"))), []
    while True:
        is_list = _is("ARRAY") & (F.to_json("v") != "[]")
        out.append(rest.where(~is_list | F.col("v").isNull()))
        lists = rest.where(is_list)
        if lists.isEmpty():
            break
        deeper = _entries(lists, [*keep, "pos"], "__at")
        rest = stored(deeper.select(*keep, F.concat("pos", F.array(F.col("__at").cast("int"))).alias("pos"), "v"))
    leaves = reduce(DataFrame.unionByName, out)
    number = F.when(_is("BIGINT") | _is("DECIMAL") | _is("DOUBLE") | _is("FLOAT"), F.try_variant_get("v", "$", "double"))
    return leaves.select(*keep, "pos", number.alias("value"), F.coalesce(F.to_json("v"), F.lit("null")).alias("json"))


def stats(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, feature, stat, pos, value, json) of the stats documents, one row a number, however deep its lists are (``pos``, see ``flattened``).

    A feature that is no object has a null ``stat``. Documents that can't be read have no rows here: see ``unreadable_stats``.
    """
    features = _entries(_variants(spark, f"{path}/*/meta/stats.json").where(_is("OBJECT")), ["dataset"], "feature")
    plain = features.where(~_is("OBJECT")).select("dataset", "feature", F.lit(None).cast("string").alias("stat"), "v")
    return flattened(_entries(features.where(_is("OBJECT")), ["dataset", "feature"], "stat").unionByName(plain))


def unreadable_stats(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, reason) of the stats documents that can't be read, for the rejects."""
    bad = _variants(spark, f"{path}/*/meta/stats.json").where(~_is("OBJECT"))
    return bad.select("dataset", F.when(F.col("v").isNull(), "stats.json is no JSON").otherwise("stats.json is no object").alias("reason"))


def dataset_facts(spark: SparkSession, path: str) -> DataFrame:
    """A15 with A9: what ``merging.readiness`` asks of each dataset folder, from the names of its files and its info document; no other file is opened."""
    found = inventory(spark, path).withColumn("file", F.element_at(F.split("path", F.lit(path.rstrip("/").rsplit("/", 1)[-1] + "/"), 2), 2))
    parts = F.split("file", "/")
    found = found.select(parts[0].alias("dataset"), F.concat_ws("/", F.slice(parts, 2, F.size(parts))).alias("file")).where("file != ''")
    has = lambda name: F.max((F.col("file") == name)).alias(f"has_{name.split('/')[-1].split('.')[0]}")
    counts = found.groupBy("dataset").agg(
        has("meta/info.json"), has("meta/tasks.parquet"), has("meta/stats.json"), F.count_if(F.col("file").like("data/%.parquet")).alias("n_data_files"), F.count_if(F.col("file").like("videos/%.mp4")).alias("n_videos")
    )
    try:
        infos = _variants(spark, f"{path}/*/meta/info.json")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        infos = spark.createDataFrame([], "dataset string, v variant")
    at = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    infos = infos.select(F.col("dataset").alias("__d"), F.col("v").isNotNull().alias("info_readable"), at("codebase_version", "string").alias("version"), *[at(f"total_{n}", "long").alias(f"n_{n}") for n in ("episodes", "frames", "tasks")])
    return counts.join(infos.hint("merge"), F.col("dataset") == F.col("__d"), "left").drop("__d")


def write_info(infos: DataFrame, path: str) -> None:
    """One info document a dataset, in a folder of its own."""
    infos.repartition("dataset").write.partitionBy("dataset").json(path)


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def nested(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, json) leaves, as ``flattened`` gives them -> (keys, json): the lists built up again, level by level, from the deepest."""
    rest = stored(rows.select(*keys, "pos", "json"))
    for depth in range(rest.agg(F.max(F.size("pos"))).first()[0] or 0, 0, -1):
        entries = F.array_sort(F.collect_list(F.struct(F.element_at("pos", -1).alias("at"), "json")))
        lists = rest.where(F.size("pos") == depth).groupBy(*keys, F.slice("pos", 1, depth - 1).alias("pos")).agg(F.concat(F.lit("["), F.concat_ws(",", F.transform(entries, lambda x: x["json"])), F.lit("]")).alias("json"))
        rest = stored(rest.where(F.size("pos") < depth).unionByName(lists.select(*keys, "pos", "json")))
    return rest.select(*keys, "json")


def write_stats(merged: DataFrame, path: str, overwrite: bool = False) -> None:
    """Merged stats (feature, stat, pos, value[, json]) as one document of lists, nested as they were; it has a number a dimension, so it is small. A value that is no finite number is null."""
    value = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value").cast("string"))
    json = F.coalesce(value, F.when(F.col("value").isNull(), F.col("json")), F.lit("null")) if "json" in merged.columns else F.coalesce(value, F.lit("null"))
    pos = F.col("pos") if merged.schema["pos"].dataType.typeName() == "array" else F.array(F.col("pos").cast("int"))
    lists = nested(merged.select("feature", "stat", pos.alias("pos"), json.alias("json")), ["feature", "stat"])
    entry = lambda name: F.concat(_quoted(F.col(name)), F.lit(":"), F.col("json"))
    whole = lambda c: F.concat(F.lit("{"), F.concat_ws(",", F.array_sort(F.collect_list(c))), F.lit("}"))
    features = lists.where("stat is not null").groupBy("feature").agg(whole(entry("stat")).alias("json")).unionByName(lists.where("stat is null").select("feature", "json"))
    features.agg(whole(entry("feature")).alias("value")).write.mode("overwrite" if overwrite else "error").text(path)


META = "method string, duration_s double, n_robot_frames long, validation_passed boolean, validation_warnings long"


def write_annotations(annotations: DataFrame, path: str) -> None:
    """Annotations (dataset, the fields of an annotation, method, duration_s, n_robot_frames, validation_passed, validation_warnings) as JSON, the last five under _meta."""
    names = [c.split()[0] for c in META.split(", ")]
    annotations.withColumn("_meta", F.struct(*names)).drop(*names).write.partitionBy("dataset").json(path)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_annotations`` wrote."""
    return spark.read.schema(f"{ANNOTATION}, _meta struct<{META.replace(' ', ':').replace(',:', ',')}>, dataset string").json(path)


def quarantine(rows: DataFrame, reason: Column, path: str) -> DataFrame:
    """Append rows with a reason to the rejects; returns the others. The rows are written once and read back (see ``stored``), so a lost executor makes no row a reject twice. On streams: ``control.split_writer``."""
    marked = stored(rows.withColumn("reason", reason))
    marked.where("reason is not null").write.mode("append").json(path)
    return marked.where("reason is null").drop("reason")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line) of whole logs."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and time of files; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
