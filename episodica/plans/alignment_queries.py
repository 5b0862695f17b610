"""Aligned frames, trims, overviews, segments by rule and the smaller items over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fields
from ..operators import alignment, annotate, episodes, labels, merging, reports, signals
from ..operators.scans import scanned
from ..operators.stored import stored
from ..streaming import control
from .binding import EPISODE_ROWS, EV, PAIRS, SEGMENTS, Tables, query

HOUR = 3_600_000_000_000

# camera frames: clicks and errors of a user, numbered in each
_FRAMES = "fr AS (SELECT dataset, ord, ts, kind, row_number() OVER (PARTITION BY dataset, kind ORDER BY ts, ord) - 1 AS fno FROM ev WHERE kind IN ('click', 'error'))"
_VIEWS = EPISODE_ROWS + ", v AS (SELECT * FROM er WHERE kind = 'view'), " + _FRAMES


def _frames(t: Tables):
    w = Window.partitionBy("dataset", "kind").orderBy("ts", "ord")
    return t.kind("click", "error").withColumn("rgb_video_frame", F.row_number().over(w) - 1).withColumn("camera", F.col("kind")).withColumn("rgb_video", F.lit("rgb.mp4"))


def _views(t: Tables):
    return t.episode_rows.where("kind = 'view'")


_SIDE = "CASE WHEN {r}.ts > {l}.ts THEN 1 ELSE 0 END, CASE WHEN {r}.ts < {l}.ts THEN -{r}.ord ELSE {r}.ord END"
_ALIGNED = f"""{_VIEWS}, st AS (SELECT * FROM (SELECT *, lead(ts) OVER (PARTITION BY dataset, episode ORDER BY ts, ord) AS nts FROM v) WHERE nts IS NOT NULL),
n AS (SELECT st.dataset, st.episode, st.ord, f.kind, f.fno, f.ts AS fts, row_number() OVER (PARTITION BY st.dataset, st.episode, st.ord, f.kind ORDER BY abs(f.ts - st.ts), {_SIDE.format(l='st', r='f')}) AS k
 FROM st JOIN fr f ON f.dataset = st.dataset AND abs(f.ts - st.ts) <= {12 * HOUR}),
a AS (SELECT dataset, episode, ord, max(fno) FILTER (kind = 'click') AS top, max(fno) FILTER (kind = 'error') AS wrist, max(fts) FILTER (kind = 'click') AS top_ts, max(fts) FILTER (kind = 'error') AS wrist_ts FROM n WHERE k = 1 GROUP BY 1, 2, 3 HAVING count(*) = 2),
tx AS (SELECT dataset, ord, ts, 'said ' || CAST(ord % 3 AS VARCHAR) AS text FROM ev WHERE kind = 'purchase'), seen AS (SELECT dataset, episode, 0 AS n, ord, top_ts AS ts FROM a UNION ALL SELECT dataset, episode, 1, ord, wrist_ts FROM a),
sm AS (SELECT s.*, t.text, row_number() OVER (PARTITION BY s.dataset, s.episode, s.n, s.ord ORDER BY abs(t.ts - s.ts), {_SIDE.format(l='s', r='t')}) AS k FROM seen s JOIN tx t ON t.dataset = s.dataset AND abs(t.ts - s.ts) <= {24 * HOUR}),
dc AS (SELECT dataset, episode, text, count(*) AS c, min((n, ord)) AS f FROM sm WHERE k = 1 GROUP BY 1, 2, 3), dom AS (SELECT dataset, episode, text FROM dc QUALIFY row_number() OVER (PARTITION BY dataset, episode ORDER BY c DESC, f) = 1),
ix AS (SELECT dataset, episode, row_number() OVER (PARTITION BY dataset ORDER BY episode) - 1 AS oi FROM (SELECT DISTINCT dataset, episode FROM a)),
tasks AS (SELECT dataset, episode, oi AS output_index, coalesce(CASE WHEN episode % 4 = 0 THEN 'noted' END, text, 'episode_' || lpad(CAST(oi AS VARCHAR), 6, '0')) AS task FROM ix LEFT JOIN dom USING (dataset, episode))"""


def _aligned(t: Tables):
    steps = episodes.steps(_views(t))
    frames = _frames(t)
    said = t.kind("purchase").withColumn("text", F.concat(F.lit("said "), (F.col("ord") % 3).cast("string")))
    noted = steps.select("dataset", "episode").distinct().where("episode % 4 = 0").withColumn("task", F.lit("noted"))
    cameras = {"top": frames.where("camera = 'click'"), "wrist": frames.where("camera = 'error'")}
    return alignment.aligned_frames(steps, cameras, said, noted, 12 * HOUR, 24 * HOUR, "drop")


@query("dataset:l episode:l ord:l output_index:l task:s top:l wrist:l", f"WITH {_ALIGNED} SELECT a.dataset, a.episode, ord, output_index, task, top, wrist FROM a JOIN tasks USING (dataset, episode)")
def a10_aligned_frames(t: Tables):
    at = lambda c: F.col("frames")[c]["rgb_video_frame"].alias(c)
    return _aligned(t).select("dataset", "episode", "ord", "output_index", "task", at("top"), at("wrist"))


@query("dataset:l episode:l output_index:l task:s", f"WITH {_ALIGNED} SELECT * FROM tasks")
def d13_episode_tasks(t: Tables):
    return _aligned(t).select("dataset", "episode", "output_index", "task").distinct()


@query("dataset:l camera:s ord:l video_s:d", f"""WITH {EV}, {_FRAMES}, d AS (SELECT *, ts // 1000000 - lag(ts // 1000000) OVER (PARTITION BY dataset, kind ORDER BY ts, ord) AS dt FROM fr),
f AS (SELECT dataset, kind, coalesce(greatest(1, round_even(1e9 / median(dt) FILTER (dt > 0), 0)), 30) AS fps FROM d GROUP BY 1, 2) SELECT dataset, kind AS camera, ord, fno / fps AS video_s FROM fr JOIN f USING (dataset, kind)""")
def b8_video_seconds(t: Tables):
    return alignment.video_seconds(_frames(t).withColumn("ts", F.floor(F.col("ts") / 1_000_000)))


# hours between frames make one frame a second
_TRIMS = "tr AS (SELECT *, a + (episode % 3) * 4 AS z FROM (SELECT DISTINCT dataset, episode, ((episode * 7 + dataset) % 20) * 0.5 AS a FROM v))"


def _trims(views):
    a = (F.col("episode") * 7 + F.col("dataset")) % 20 * 0.5
    return views.select("dataset", "episode").distinct().withColumn("trim_start_s", a).withColumn("trim_end_s", a + F.col("episode") % 3 * 4)


def _primary(t: Tables):
    """Stored, as what uses it does so several times."""
    return stored(alignment.video_seconds(stored(_frames(t).where("camera = 'click'"))))


@query("dataset:l episode:l ord:l", f"""WITH {_VIEWS}, {_TRIMS}, res AS (SELECT t.dataset, t.episode, min_by(f.ts, (abs(f.fno - a), -f.fno)) AS fa, min_by(f.ts, (abs(f.fno - z), -f.fno)) AS fz FROM tr t JOIN fr f ON f.dataset = t.dataset AND f.kind = 'click' WHERE z > a GROUP BY 1, 2),
m AS (SELECT v.*, coalesce(v.ts BETWEEN fa AND fz, false) AS i FROM v LEFT JOIN res USING (dataset, episode)) SELECT * FROM (SELECT *, bool_or(i) OVER (PARTITION BY dataset, episode) AS hit FROM m) WHERE i OR NOT hit""")
def c5_manual_trims(t: Tables):
    views = stored(_views(t))
    return alignment.trimmed_by_hand(views, _trims(views), _primary(t))


_BOUNDS = """ep AS (SELECT dataset, episode, min(ts) AS f, max(ts) AS l FROM v GROUP BY 1, 2), b0 AS (SELECT e.dataset, e.episode, kind AS camera, coalesce(min(fno) FILTER (fr.ts >= f), max(fno)) AS s, coalesce(min(fno) FILTER (fr.ts >= l), max(fno)) AS z FROM ep e JOIN fr ON fr.dataset = e.dataset GROUP BY 1, 2, 3),
b AS (SELECT dataset, episode, camera, CAST(s AS DOUBLE) AS start_s, CASE WHEN z <= s THEN s + 0.1 ELSE CAST(z AS DOUBLE) END AS end_s FROM b0)"""


def _ends(views):
    return views.groupBy("dataset", "episode").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("dataset:l episode:l reason:s", f"WITH {_VIEWS}, {_TRIMS}, {_BOUNDS} SELECT tr.dataset, tr.episode, CASE WHEN start_s IS NULL THEN 'no_episode' WHEN tr.z <= a THEN 'order' WHEN a < start_s OR tr.z > end_s THEN 'bounds' END AS reason FROM tr LEFT JOIN b ON b.dataset = tr.dataset AND b.episode = tr.episode AND camera = 'click'")
def c6_trim_requests(t: Tables):
    views = stored(_views(t))
    return alignment.checked_trims(_trims(views), alignment.camera_bounds(_ends(views), _primary(t)))


@query("dataset:l episode:l n_cameras:l click_start:d click_end:d error_start:d task:s trim_end_s:d n_subtasks:l", f"""WITH {_VIEWS}, {_TRIMS}, {_BOUNDS}, c AS (SELECT dataset, episode, count(*) AS n, max(start_s) FILTER (camera = 'click') AS cs, max(end_s) FILTER (camera = 'click') AS ce, max(start_s) FILTER (camera = 'error') AS es FROM b GROUP BY 1, 2)
SELECT dataset, episode, n AS n_cameras, cs AS click_start, ce AS click_end, es AS error_start, CASE WHEN episode % 2 = 0 THEN 'even' END AS task, CASE WHEN episode % 3 = 1 THEN tr.z END AS trim_end_s, CASE WHEN episode = 0 THEN 2 END AS n_subtasks FROM ep JOIN tr USING (dataset, episode) LEFT JOIN c USING (dataset, episode)""")
def h6_episode_overview(t: Tables):
    views = stored(_views(t))
    ends = _ends(views)
    keys = ends.select("dataset", "episode")
    sub = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s")) for p in "ab"])
    out = alignment.episode_overview(ends, alignment.video_seconds(_frames(t)), keys.where("episode % 2 = 0").withColumn("task", F.lit("even")), _trims(views).where("episode % 3 = 1"), keys.where("episode = 0").withColumn("subtasks", sub))
    at = lambda camera, c: F.try_element_at("cameras", F.lit(camera))[c]
    return out.select("*", F.when(F.col("cameras").isNotNull(), F.size("cameras")).alias("n_cameras"), at("click", "start_s").alias("click_start"), at("click", "end_s").alias("click_end"), at("error", "start_s").alias("error_start"), F.when(F.col("subtasks").isNotNull(), F.size("subtasks")).alias("n_subtasks"))


@query("dataset:l episode:l camera:s first_frame:l last_frame:l", f"WITH {PAIRS}, {_FRAMES} SELECT e.dataset, e.episode, kind AS camera, min_by(fno, (fr.ts, fr.ord)) AS first_frame, max_by(fno, (fr.ts, fr.ord)) AS last_frame FROM eps e JOIN fr ON fr.dataset = e.dataset AND fr.ts BETWEEN start_ts AND end_ts GROUP BY 1, 2, 3")
def b22_clip_manifest(t: Tables):
    return alignment.clip_manifest(episodes.numbered(episodes.paired_intervals(t.marks)), _frames(t), 86_400.0)


# a user's whole log as one episode of some seconds, with signals made from its rows
_ROBOT = EV + """, rb AS (SELECT dataset, ts, ord, (ts - min(ts) OVER (PARTITION BY dataset)) / 7.2e14 AS t, value / 50 AS speed, ord % 17 / 10.0 AS z, ord % 7 / 10.0 AS command, CASE WHEN kind IN ('purchase', 'error') THEN 1 ELSE 0 END AS closed FROM ev)"""
_SCANS = _ROBOT + """, sm AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(lead(t) OVER w, t) AS nt, t - lag(t) OVER w AS dt, lag(closed) OVER w AS pc,
 CASE WHEN count(*) OVER (PARTITION BY dataset) <= 15 THEN speed ELSE sum(speed) OVER (PARTITION BY dataset ORDER BY ts, ord ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15 END AS ss,
 CASE WHEN count(*) OVER (PARTITION BY dataset) <= 15 THEN command ELSE sum(command) OVER (PARTITION BY dataset ORDER BY ts, ord ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15 END AS cs FROM rb WINDOW w AS (PARTITION BY dataset ORDER BY ts, ord)),
sc AS (SELECT dataset, min(t) AS t_start, max(t) AS t_end, quantile_cont(ss, 0.2) + 0.005 AS fast, quantile_cont(z, 0.3) AS high, greatest(1, 1 / coalesce(median(dt), 1 / 30.0)) AS hz FROM sm GROUP BY 1),
cy AS (SELECT a.dataset, a.t AS t_close, b.t AS t_open FROM sm a JOIN sm b ON a.dataset = b.dataset WHERE a.pc = 0 AND a.closed = 1 AND b.pc = 1 AND b.closed = 0 AND b.t > a.t + 0.1 QUALIFY row_number() OVER (PARTITION BY a.dataset ORDER BY a.t, b.t) = 1),
one AS (SELECT sc.*, t_close, t_open, (SELECT count(*) FROM sm WHERE sm.dataset = sc.dataset AND sm.t < cy.t_close) AS ic FROM sc LEFT JOIN cy USING (dataset)),
bk AS (SELECT o.dataset, max((i, nt)) FILTER ((ss > fast * 2.5 OR z > high * 1.5) AND i > greatest(0, ic - floor(least(2.0, t_close * 0.4) * hz)) AND i < ic) AS al, max((i, nt)) FILTER (cs < 0.3 AND i > greatest(0, ic - floor(1.5 * hz)) AND i < ic) AS co FROM one o JOIN sm ON sm.dataset = o.dataset GROUP BY 1),
scans AS (SELECT dataset, t_start, t_end, t_close, t_open, CASE WHEN t_close - al[2] >= 0.2 THEN al[2] END AS align_start, co[2] AS contact_start FROM one JOIN bk USING (dataset))"""


def _scans(t: Tables):
    start = F.min("ts").over(Window.partitionBy("dataset"))
    rows = t.one_episode.withColumn("t", (F.col("ts") - start) / 7.2e14).withColumn("speed", F.col("value") / 50).withColumn("z", F.col("ord") % 17 / 10.0)
    return annotate.backward_scans(rows.withColumn("command", F.col("ord") % 7 / 10.0).withColumn("closed", F.col("kind").isin("purchase", "error").cast("int")))


@query("dataset:l t_start:d t_end:d t_close:d t_open:d align_start:d contact_start:d", f"WITH {_SCANS} SELECT * FROM scans")
def f12_backward_scans(t: Tables):
    return _scans(t)


@query("dataset:l pos:l phase:l phase_name:s start_t:d end_t:d confidence:d", f"""WITH RECURSIVE {_SCANS},
g1 AS (SELECT *, greatest(coalesce(align_start, t_start) + 0.1, least(coalesce(contact_start, t_close - 0.3), t_close - 0.1)) AS c1 FROM scans),
g2 AS (SELECT *, greatest(t_close + 0.15, c1 + 0.15) AS m1, greatest(least(coalesce(align_start, greatest(t_start + 0.15, c1 - 0.5)), c1 - 0.15), t_start + 0.15) AS al FROM g1),
g3 AS (SELECT *, greatest(c1, al + 0.15) AS c2 FROM g2), g4 AS (SELECT *, greatest(m1, c2 + 0.15) AS m2 FROM g3),
ed AS (SELECT dataset, t_start AS t, 0 AS ph FROM g4 UNION ALL SELECT dataset, al, 1 FROM g4 WHERE t_close IS NOT NULL UNION ALL SELECT dataset, c2, 2 FROM g4 WHERE t_open - c2 >= 0.15
 UNION ALL SELECT dataset, m2, 3 FROM g4 WHERE t_open - c2 >= 0.15::DOUBLE + 0.15::DOUBLE AND t_open - m2 >= 0.15 UNION ALL SELECT dataset, t_open, 4 FROM g4 WHERE t_close IS NOT NULL),
eo AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY t, ph) AS k FROM ed),
rr AS (SELECT dataset, k, t, ph, t AS last, true AS keep FROM eo WHERE k = 1 UNION ALL SELECT e.dataset, e.k, e.t, e.ph, CASE WHEN e.t > rr.last + 0.075 THEN e.t ELSE rr.last END, e.t > rr.last + 0.075 FROM rr JOIN eo e ON e.dataset = rr.dataset AND e.k = rr.k + 1),
kp AS (SELECT dataset, t, ph, row_number() OVER w - 1 AS pos, lead(t) OVER w AS nt FROM rr WHERE keep WINDOW w AS (PARTITION BY dataset ORDER BY k))
SELECT dataset, pos, ph AS phase, (['free_motion', 'fine_align', 'contact_establish', 'constrained_motion', 'verify_release'])[ph + 1] AS phase_name, round_even(t, 4) AS start_t, round_even(coalesce(nt, t_end), 4) AS end_t,
 CASE WHEN t_close IS NULL THEN 0.5 WHEN ph IN (2, 3) THEN 0.9 ELSE 0.75 END AS confidence FROM kp JOIN g4 USING (dataset) WHERE coalesce(nt, t_end) > t""")
def f13_phase_segments(t: Tables):
    return annotate.phase_segments(_scans(t))


@query("dataset:l episode:l event:s robot_timestamp_ns:l", f"WITH {EPISODE_ROWS}, g AS (SELECT dataset, episode, min(ts) AS a, max(ts) AS z FROM er GROUP BY 1, 2 HAVING (z - a) / 1e9 >= 2) SELECT dataset, episode, 'episode_start' AS event, a AS robot_timestamp_ns FROM g UNION ALL SELECT dataset, episode, 'episode_end', z FROM g")
def h8_cleaned_events(t: Tables):
    return signals.cleaned_events(episodes.long_enough(t.episode_rows, 2.0))


@query("dataset:l episode:l n_leading:l n_trailing:l", f"""WITH {EPISODE_ROWS}, m AS (SELECT *, min(CASE WHEN kind = 'click' THEN (ts, ord) END) OVER p AS a, max(CASE WHEN kind = 'click' THEN (ts, ord) END) OVER p AS z FROM er WINDOW p AS (PARTITION BY dataset, episode))
SELECT dataset, episode, count(*) FILTER (a IS NULL OR (ts, ord) < a) AS n_leading, count(*) FILTER (a IS NOT NULL AND (ts, ord) > z) AS n_trailing FROM m GROUP BY 1, 2""")
def e1_trim_counts(t: Tables):
    return signals.trim_counts(t.episode_rows.withColumn("has", F.col("kind") == "click"), "has")


@query("dataset:l episode:l steps:l suppressed:b detected_episodes:l kept_episodes:l suppressed_episodes:l", f"""WITH {EPISODE_ROWS}, q AS (SELECT dataset, episode, count(*) - 1 AS steps, NOT (coalesce(max(abs(value)), 0) >= 20 OR coalesce(max(value) - min(value), 0) >= 30) AND count(*) - 1 <= 1000 AS suppressed FROM er GROUP BY 1, 2)
SELECT *, count(*) OVER w AS detected_episodes, count(*) FILTER (NOT suppressed) OVER w AS kept_episodes, count(*) FILTER (suppressed) OVER w AS suppressed_episodes FROM q WINDOW w AS (PARTITION BY dataset)""")
def e6_episode_rows(t: Tables):
    return episodes.episode_report(t.episode_rows, active_command=20.0, active_span=30.0)


@query("item:s name:s n:l", f"""WITH {SEGMENTS}, m AS (SELECT k, min(confidence) > 0.1 AS ok, CASE WHEN k % 3 = 0 THEN 'model' ELSE 'rule' END AS method FROM seg GROUP BY 1)
SELECT 'episodes' AS item, 'all' AS name, count(*) AS n FROM m UNION ALL SELECT 'episodes', 'passed', count(*) FILTER (ok) FROM m UNION ALL SELECT 'method', method, count(*) FROM m GROUP BY 2
UNION ALL SELECT 'phase', coalesce((['free_motion', 'fine_align', 'contact_establish', 'constrained_motion', 'verify_release'])[phase + 1], 'unknown'), count(*) FROM seg GROUP BY 2""")
def e8_annotation_summary(t: Tables):
    s = t.segments
    m = s.groupBy("k").agg((F.min("confidence") > 0.1).alias("passed")).withColumn("method", F.when(F.col("k") % 3 == 0, "model").otherwise("rule"))
    return labels.annotation_summary(m, s, "k")


@query("dataset:l episode:l task:s annotated_at:s", f"""WITH {PAIRS}, old AS (SELECT dataset, episode, 'old' AS task, 'then' AS annotated_at FROM eps), nw AS (SELECT dataset, episode, max('new ' || CAST(ord % 3 AS VARCHAR)) AS task FROM (SELECT p.dataset, p.episode, e.ord FROM eps p JOIN ev e ON e.dataset = p.dataset AND e.ts = p.start_ts) WHERE episode % 3 <> 1 GROUP BY 1, 2)
SELECT o.dataset, o.episode, coalesce(n.task, o.task) AS task, CASE WHEN n.task IS NULL THEN 'then' ELSE 'now' END AS annotated_at FROM old o LEFT JOIN nw n USING (dataset, episode)""")
def h4_upserted_annotations(t: Tables):
    e = episodes.numbered(episodes.paired_intervals(t.marks))
    marks = t.marks.select(F.col("dataset").alias("d"), F.col("ts").alias("s"), F.col("ord").alias("o"))
    new = e.where("episode % 3 <> 1").join(marks.hint("merge"), (F.col("dataset") == F.col("d")) & (F.col("start_ts") == F.col("s"))).select("dataset", "episode", F.concat(F.lit("new "), (F.col("o") % 3).cast("string")).alias("task"))
    return episodes.upserted(e.select("dataset", "episode", F.lit("old").alias("task"), F.lit("then").alias("annotated_at")), new, F.lit("now"))


@query("k:l frame_idx:l phase:l subtask:s", f"WITH {SEGMENTS}, n AS (SELECT k, count(*) AS n FROM seg GROUP BY 1), f AS (SELECT k, unnest(range(n + 2)) AS frame_idx FROM n) SELECT f.k, frame_idx, phase, 'task.' || CAST(phase AS VARCHAR) AS subtask FROM f JOIN n USING (k) JOIN seg ON seg.k = f.k AND seg.pos = least(frame_idx, n - 1)")
def h7_phase_columns(t: Tables):
    frames = t.segments.groupBy("k").agg((F.count("*") + 2).alias("n")).select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame_idx"))
    found = t.segments.select("k", F.col("pos").alias("frame_idx"), "phase", F.concat(F.lit("task."), F.col("phase").cast("string")).alias("subtask"))
    return labels.written_back(frames, found, "k", ("phase", "subtask"))


@query("o_orderkey:l task:s", "SELECT o_orderkey, coalesce(CASE o_orderkey % 8 WHEN 0 THEN 'Move the gripper to the soup can' WHEN 1 THEN 'Place the soup can into the tray' END, o_orderpriority) AS task FROM orders")
def b11_step_tasks(t: Tables):
    subtask = F.when(F.col("o_orderkey") % 8 == 0, "approach_can").when(F.col("o_orderkey") % 8 == 1, "release_can").when(F.col("o_orderkey") % 8 == 2, "other")
    return t.orders.select("o_orderkey", fields.step_task(subtask, F.col("o_orderpriority")).alias("task"))


@query("o_orderkey:l closed:l", "SELECT o_orderkey, CASE WHEN (o_orderkey % 10) / 10.0 > 0.5 THEN 1 ELSE 0 END AS closed FROM orders")
def b12_state_closed(t: Tables):
    return t.orders.select("o_orderkey", fields.state_closed(F.col("o_orderkey") % 10 / 10.0).alias("closed"))


_ANSWER = "CASE o_orderkey % 6 WHEN 0 THEN 'no_json' WHEN 1 THEN 'json' WHEN 2 THEN 'schema' WHEN 3 THEN 'segments' WHEN 4 THEN 'duration' END"


@query("o_orderkey:l error:s n:l", f"SELECT o_orderkey, {_ANSWER} AS error, CASE WHEN o_orderkey % 6 = 5 THEN 2 END AS n FROM orders")
def b13_parsed_output(t: Tables):
    kind = F.col("o_orderkey") % 6
    name = F.when(kind == 3, "fine_align").otherwise("free_motion")
    segment = lambda p, n, a, z: F.format_string('{"phase_id": %d, "phase_name": "%s", "start_t": %s, "end_t": %s, "confidence": 0.5, "evidence": "x"}', F.lit(p), n, F.lit(str(a)), z)
    end = F.when(kind == 4, "9.0").otherwise("4.0")
    body = F.format_string('```json\n{"episode_id": "%d", "task": "%s", "segments": [%s, %s], "overall_confidence": 0.9%s\n```', "o_orderkey", F.when(kind == 2, "other").otherwise("pick_place"), segment(0, name, 0.0, F.lit("1.5")), segment(1, F.lit("fine_align"), 1.5, end), F.when(kind == 1, ",,}").otherwise("}"))
    out = fields.with_parsed(t.orders.select("o_orderkey", F.when(kind == 0, F.lit("no answer")).otherwise(body).alias("raw")), "raw", F.lit(4.0))
    return out.select("o_orderkey", "error", F.when(F.col("annotation").isNotNull(), F.size("annotation.segments")).alias("n"))


@query("task:s n:l users:s answers:s", """WITH g AS (SELECT o_orderpriority AS task, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders)
SELECT task, count(*) AS n, string_agg(printf('Task: %s' || chr(10) || 'Episode ID: %s' || chr(10) || 'Episode duration: %.2f seconds' || chr(10) || chr(10) || 'Annotate each phase segment of the video and answer with the JSON object alone.', task, CAST(o_orderkey AS VARCHAR), o_totalprice), '|' ORDER BY k) AS users,
 string_agg('{"k": ' || CAST(o_orderkey AS VARCHAR) || '}', '|' ORDER BY k) AS answers FROM g WHERE k <= 3 GROUP BY 1""")
def b14_gold_examples(t: Tables):
    gold = t.orders.select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("episode_id"), F.col("o_totalprice").alias("duration_s"), F.format_string('{"k": %d}', "o_orderkey").alias("annotation"))
    text = lambda c: F.concat_ws("|", F.transform("turns", lambda x: x[c]))
    return labels.gold_examples(gold).select("task", F.size("turns").alias("n"), text("user").alias("users"), text("assistant").alias("answers"))


@query("prompt:s", "SELECT a || ' ' || b || ' ' || c || '.' AS prompt FROM (SELECT DISTINCT o_orderpriority AS a FROM orders), (SELECT DISTINCT n_name AS b FROM nation), (SELECT DISTINCT r_name AS c FROM region)")
def b15_prompt_vocabulary(t: Tables):
    words = lambda df, c, name: df.select(F.col(c).alias("w")).distinct().agg(F.array_sort(F.collect_list("w")).alias(name)).withColumn("one", F.lit(1))
    one = words(t.orders, "o_orderpriority", "a").join(words(t.nation, "n_name", "b"), "one").join(words(t.region, "r_name", "c"), "one").drop("one")
    return alignment.prompt_vocabulary(one)


@query("step:l n:l", "WITH s AS (SELECT CASE WHEN o_orderkey >= 100 THEN o_orderkey END AS step FROM orders) SELECT step, count(*) AS n FROM s GROUP BY 1")
def b18_checkpoint_steps(t: Tables):
    return t.orders.select(fields.checkpoint_step(F.concat(F.lit("step-"), F.col("o_orderkey").cast("string"))).alias("step")).groupBy("step").agg(F.count("*").alias("n"))


@query("event_id:l phase:l", "SELECT event_id, 5 AS phase FROM events")
def b20_unknown_phase(t: Tables):
    return fields.phase_or_unknown(t.events.select("event_id"))


@query("dataset:s episode_index:l dataset_from_index:l dataset_to_index:l", """WITH e AS (SELECT o_orderpriority AS dataset, o_orderkey, row_number() OVER w - 1 AS i, sum(o_custkey) OVER w AS z, o_custkey AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)),
s AS (SELECT dataset, count(*) AS ne, sum(n) AS nf FROM e GROUP BY 1), o AS (SELECT dataset, coalesce(sum(ne) OVER w, 0) AS eo, coalesce(sum(nf) OVER w, 0) AS fo FROM s WINDOW w AS (ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT e.dataset, i + eo AS episode_index, z - n + fo AS dataset_from_index, z + fo AS dataset_to_index FROM e JOIN o USING (dataset)""")
def h1_united_episodes(t: Tables):
    o = t.orders.select(F.col("o_orderpriority").alias("dataset"), "o_orderkey", F.col("o_custkey").alias("n"))
    e = scanned(o, ["dataset"], ["o_orderkey"], 10_000, running={"dataset_to_index": F.col("n")}, place="episode_index")
    sizes = o.groupBy("dataset").agg(F.count("*").alias("n_episodes"), F.sum("n").alias("n_frames"))
    return merging.united_episodes(e.withColumn("dataset_from_index", F.col("dataset_to_index") - F.col("n")), merging.offsets(sizes))


@query("p_partkey:l task:s global_index:l", """WITH tasks AS (SELECT p_brand AS dataset, p_type AS task, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS ti FROM (SELECT DISTINCT p_brand, p_type FROM part)), reg AS (SELECT task, row_number() OVER (ORDER BY f, task) - 1 AS g FROM (SELECT task, min((dataset, ti)) AS f FROM tasks GROUP BY 1)),
u AS (SELECT p_partkey, p_brand AS dataset, CASE WHEN p_size = 1 THEN NULL ELSE p_size * 3 END AS ti FROM part), m AS (SELECT DISTINCT dataset, ti FROM u WHERE NOT exists(SELECT 1 FROM tasks t WHERE t.dataset = u.dataset AND t.ti = u.ti)),
sy AS (SELECT dataset, ti, 'unknown task (' || dataset || ':' || coalesce(CAST(ti AS VARCHAR), 'null') || ')' AS task, (SELECT count(*) FROM reg) + row_number() OVER (ORDER BY dataset, ti NULLS LAST) - 1 AS g FROM m)
SELECT p_partkey, coalesce(sy.task, t.task) AS task, coalesce(sy.g, reg.g) AS global_index FROM u LEFT JOIN tasks t ON t.dataset = u.dataset AND t.ti = u.ti LEFT JOIN reg ON reg.task = t.task LEFT JOIN sy ON sy.dataset = u.dataset AND sy.ti IS NOT DISTINCT FROM u.ti""")
def h3_full_registry(t: Tables):
    w = Window.partitionBy("dataset").orderBy("task")
    tasks = t.part.select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("task")).distinct().withColumn("task_index", F.row_number().over(w) - 1)
    used = t.part.select("p_partkey", F.col("p_brand").alias("dataset"), F.when(F.col("p_size") != 1, F.col("p_size") * 3).alias("task_index"))
    new = merging.synthetic_tasks(used, tasks)
    registry = merging.full_registry(merging.task_registry(tasks), new)
    known = tasks.select("dataset", "task_index", "task").unionByName(new.select("dataset", "task_index", "task"))
    out = merging.remapped_tasks(used, known, registry).withColumnRenamed("task_index", "global_index")
    return out.join(registry.withColumnRenamed("global_index", "g").hint("merge"), F.col("global_index") == F.col("g"))


@query("p_partkey:l", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)")
def d17_missing_parts(t: Tables):
    present = t.lineitem.where("l_returnflag = 'R' and l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    return merging.missing_items(t.part.select("p_partkey"), present, ["p_partkey"])


@query("feature:s wanted:l found:l", "WITH p AS (SELECT p_brand AS feature, min(p_size) AS wanted, max(p_size) % 49 AS found FROM part GROUP BY 1) SELECT * FROM p WHERE wanted <> found")
def d17_shape_mismatches(t: Tables):
    p = t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.min("p_size").alias("a"), (F.max("p_size") % 49).alias("z"))
    return merging.shape_mismatches(p.select("feature", F.col("a").alias("shape")), p.select("feature", F.col("z").alias("shape")), ["feature"])


@query("o_orderkey:l file:l", "WITH f AS (SELECT o_custkey % 5 AS d, o_custkey AS i, row_number() OVER (ORDER BY o_custkey % 5, o_custkey) - 1 AS g FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, g AS file FROM orders JOIN f ON i = o_custkey")
def d16_episode_files(t: Tables):
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 5).alias("dataset"), F.col("o_custkey").alias("file_index"))
    return merging.remapped_file_columns(rows, merging.remapped_files(rows.select("dataset", "file_index").distinct())).withColumnRenamed("file_index", "file")


@query("dataset:l episode:l output_index:l n_chunks:l", f"WITH {PAIRS}, n AS (SELECT dataset, greatest(1, CAST(ceil(count(*) / 4) AS BIGINT)) AS n_chunks FROM eps GROUP BY 1) SELECT e.dataset, episode, CASE WHEN episode % 3 <> 1 THEN count(*) FILTER (episode % 3 <> 1) OVER (PARTITION BY e.dataset ORDER BY episode) - 1 END AS output_index, n_chunks FROM eps e JOIN n ON n.dataset = e.dataset")
def f14_output_indices(t: Tables):
    e = episodes.numbered(episodes.paired_intervals(t.marks)).withColumn("kept", F.col("episode") % 3 != 1)
    n = merging.chunk_counts(e.groupBy("dataset").agg(F.count("*").alias("n_episodes")), 4)
    return merging.output_indices(e).join(n.hint("merge"), "dataset")


@query("k:l message:s", f"WITH {SEGMENTS}, n AS (SELECT k FROM seg WHERE phase <> 5 GROUP BY 1), a AS (SELECT c_custkey AS k, CASE c_nationkey % 3 WHEN 0 THEN 'pick_place' WHEN 1 THEN 'msd_plug' ELSE 'other' END AS task, c_nationkey / 20.0 AS oc FROM customer) SELECT a.k, CASE WHEN task = 'other' THEN 'unknown task' WHEN NOT oc BETWEEN 0 AND 1 THEN 'confidence out of range' WHEN n.k IS NULL THEN 'no segments' END AS message FROM a LEFT JOIN n USING (k) WHERE message IS NOT NULL")
def f15_annotation_issues(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_nationkey") % 3 == 0, "pick_place").when(F.col("c_nationkey") % 3 == 1, "msd_plug").otherwise("other").alias("task"), (F.col("c_nationkey") / 20.0).alias("overall_confidence"))
    return labels.annotation_issues(a, t.segments.where("phase <> 5"), "k")


_RATED = "rated AS (SELECT lang, source, quality = 1 AS ok, CASE WHEN toxic = 1 THEN quality = 1 END AS back FROM documents JOIN labels USING (doc_id))"


@query("lang:s source:s n:l", f"WITH {_RATED} SELECT lang, source, count(*) AS n FROM rated WHERE NOT ok GROUP BY 1, 2")
def e13_failures_by_phase(t: Tables):
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels.hint("merge"), "doc_id").withColumn("ok", F.col("quality") == 1)
    return reports.failures_by_phase(rows, ["lang"], "ok", "source")


@query("lang:s n_corrupted:l recovery_rate:d", f"WITH {_RATED} SELECT lang, count(back) AS n_corrupted, coalesce(avg(CASE WHEN back THEN 1.0 WHEN NOT back THEN 0.0 END), 0) AS recovery_rate FROM rated GROUP BY 1")
def e13_recovery(t: Tables):
    rows = t.documents.select("doc_id", "lang").join(t.labels.hint("merge"), "doc_id").withColumn("back", F.when(F.col("toxic") == 1, F.col("quality") == 1))
    return reports.recovery(rows, ["lang"], "back")


@query("doc_id:l match:b", "SELECT doc_id, CASE WHEN quality - toxic >= 0 THEN quality - toxic = quality END AS match FROM labels")
def e17_matches(t: Tables):
    return reports.matched(t.labels.withColumn("label", F.col("quality") - F.col("toxic")), "label", "quality")


_E = "CAST(embedding[{}] AS DOUBLE)"


@query("vec_id:l align:b contact:b mate:b seated:b retract:b", f"""WITH o AS (SELECT vec_id, label, {', '.join(f'{_E.format(k)} AS e{k}' for k in range(1, 12))} FROM embeddings), s AS (SELECT *, abs(e8 * 20) AS f, e7 * 5 AS g, label <> 0 AS has FROM o)
SELECT vec_id, has AND sqrt((e1 - e9) * (e1 - e9) + (e2 - e10) * (e2 - e10)) < 0.2 AND e3 < 0.03 AS align, f > 1.5 OR g > 0.5 AS contact, g > 0.5 AND f BETWEEN 0.5 AND 3 AS mate, has AND e3 <= e11 + 0.012 AND f BETWEEN 3 AND 8 AS seated, g < 0.5 AND sqrt(e4 * e4 + e5 * e5 + e6 * e6) > 0.01 AS retract FROM s""")
def j2_phase_signals(t: Tables):
    e = F.col("embedding").cast("array<double>")
    target = F.when(F.col("label") != 0, F.slice(e, 9, 3))
    tests = control.phase_tests(F.slice(e, 1, 3), F.slice(e, 4, 3), F.element_at(e, 7) * 5, F.element_at(e, 8) * 20, target, "msd_plug", align_xy_threshold=0.2)
    return control.signals(t.embeddings, tests)
