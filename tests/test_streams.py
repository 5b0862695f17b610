"""State of streams goes when the watermark has passed: idle keys start anew, traces come out once."""

import datetime as dt

import pytest

from episodica.streaming import control


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def batches(spark, folder, schema, parts):
    """One file a micro-batch, in order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        import time

        time.sleep(1.1)  # files are taken in order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("at", "10 seconds")


def finished(stream, name, folder):
    stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder)).trigger(availableNow=True).start().awaitTermination(180)
    return stream.sparkSession.table(name).collect()


def test_an_idle_key_starts_anew(spark, tmp_path):
    schema = "key string, ts long, ord long, at timestamp, " + ", ".join(f"{s} boolean" for s in control.SIGNALS)
    row = lambda key, t, *signals: (key, t, t, at(t), *[s in signals for s in control.SIGNALS])
    parts = [[row("a", 0, "align"), row("b", 0, "align")], [row("a", 5, "contact"), row("b", 90)], [row("b", 100)], [row("b", 101, "contact"), row("a", 120, "contact")]]
    stream = batches(spark, tmp_path / "in", schema, parts)
    rules = control.PhaseRules(1)
    got = {(r.key, r.ts): r.phase for r in finished(control.phases_stream(stream, rules, "at", 30_000), "evicted", tmp_path / "c")}
    # a was last seen at 5 and the watermark went to 90, so it is at phase 0 again; b was seen all the time, its first row 90 s before
    assert got["a", 0] == 1 and got["a", 5] == 2 and got["a", 120] == 0
    assert got["b", 0] == 1 and got["b", 100] == got["b", 90]
    with pytest.raises(ValueError):
        control.on_stream(stream, rules, "at")


def test_traces_come_out_once_when_a_run_ends(spark, tmp_path):
    schema = "key string, step long, phase int, at timestamp"
    parts = [[("a", 1, 0, at(0)), ("b", 0, 0, at(0))], [("a", 0, 3, at(1)), ("a", 2, 1, at(2))], [("b", 1, 1, at(100))], [("b", 2, 2, at(101))], [("a", 0, 4, at(110)), ("c", 0, 0, at(300))], [("c", 1, 0, at(301))]]
    stream = batches(spark, tmp_path / "in", schema, parts)
    got = [(r.key, r.trace) for r in finished(control.phase_traces_stream(stream, "at", 20_000), "traces", tmp_path / "c")]
    # b's second step came before the watermark had passed its first one by 20 s, so its run went on; c's hasn't ended
    assert sorted(got) == [("a", "3,0,1"), ("a", "4"), ("b", "0,1,2")]
