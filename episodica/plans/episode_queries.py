"""Episodes, as-of joins and signals over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..operators import asof, episodes, signals
from ..operators.stored import stored
from .binding import BOUNDS, EPISODE_ROWS, EV, MARKS, PAIRS, Tables, query

HOUR = 3_600_000_000_000


@query("dataset:l ord:l name:s", f"WITH {MARKS} SELECT dataset, ord, name FROM marks")
def a2_episode_events(t: Tables):
    return t.marks


@query("dataset:l kind:s ord:l value:d", f"WITH {EV} SELECT dataset, kind, ord, value FROM ev QUALIFY row_number() OVER (PARTITION BY dataset, kind ORDER BY ts DESC, ord DESC) = 1")
def a5_latest_sidecar(t: Tables):
    return episodes.latest(t.ev, ["dataset", "kind"], [F.desc("ts"), F.desc("ord")])


@query("dataset:l episode:l start_row:l end_row:l mode:s", f"WITH {BOUNDS} SELECT * FROM bd")
def d1_episode_boundaries(t: Tables):
    """Paired, split and whole datasets side by side, as each user's marks have it."""
    rows = stored(episodes.numbered_rows(t.kind("view", "click", "error"), 8.64e13))
    return episodes.boundaries(rows, t.marks, 8.64e13)


@query("dataset:l ord:l episode:l", f"""WITH {EV}, f AS (SELECT * FROM ev WHERE kind IN ('view', 'click')), s AS (SELECT DISTINCT p.dataset, (SELECT min((f.ts, f.ord)) FROM f WHERE f.dataset = p.dataset AND f.ts >= p.ts) AS point FROM ev p WHERE p.kind = 'signup')
SELECT f.dataset, f.ord, (SELECT count(*) FROM s WHERE s.dataset = f.dataset AND s.point <= (f.ts, f.ord) AND s.point > (SELECT min((g.ts, g.ord)) FROM f g WHERE g.dataset = f.dataset)) AS episode FROM f""")
def d2_split_episodes(t: Tables):
    return episodes.episode_rows(t.kind("view", "click"), t.kind("signup").withColumn("name", F.lit("start")), 8.64e13, 10)


# the host's clock is late by some seconds of its own
_ANNOTATED = MARKS + """, hm AS (SELECT *, ts + (ord % 5) * 60000000000 AS host FROM marks), an AS (SELECT *, lead(name) OVER w AS nn, lead(ts) OVER w AS nts, lead(host) OVER w AS nhost FROM hm WINDOW w AS (PARTITION BY dataset ORDER BY ord)),
ap AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY ord) - 1 AS episode, ts AS start_ts, nts AS end_ts, host AS start_host_ts, (nhost - host) / 1e9 AS duration_s FROM an WHERE name = 'start' AND nn = 'end' AND (nhost - host) / 1e9 >= 3600)"""


def _annotated(t: Tables):
    return episodes.annotator_intervals(t.marks.withColumn("host", F.col("ts") + F.col("ord") % 5 * 60_000_000_000), 3600.0, "host")


@query("dataset:l episode:l start_ts:l end_ts:l start_host_ts:l duration_s:d", f"WITH {_ANNOTATED} SELECT * FROM ap")
def d3_annotator_pairs(t: Tables):
    return _annotated(t)


@query("dataset:l episode:l ord:l", f"WITH {_ANNOTATED} SELECT ap.dataset, episode, ev.ord FROM ap JOIN ev ON ev.dataset = ap.dataset AND ev.ts BETWEEN start_ts AND end_ts")
def d3_annotator_rows(t: Tables):
    return episodes.rows_between(t.ev, _annotated(t), 86_400.0)


@query("dataset:l episode:l ord:l", f"WITH {EPISODE_ROWS} SELECT * FROM er")
def d4_rows_of_episodes(t: Tables):
    return t.episode_rows


@query("dataset:l episode:l steps:l duration_s:d max_command:d span:d active:b blank:b", f"""WITH {EPISODE_ROWS}, q AS (SELECT dataset, episode, count(*) - 1 AS steps, (max(ts) - min(ts)) / 1e9 AS duration_s, max(abs(value)) AS max_command, max(value) - min(value) AS span FROM er GROUP BY 1, 2),
a AS (SELECT *, coalesce(max_command, 0) >= 0.1 OR coalesce(span, 0) >= 0.002 AS active FROM q) SELECT *, NOT active AND steps <= 1000 AS blank FROM a""")
def e2_episode_quality(t: Tables):
    return episodes.quality(t.episode_rows)


@query("n_episodes:l n_active:l n_blank:l n_short:l seconds:d", f"""WITH {EPISODE_ROWS}, q AS (SELECT dataset, episode, count(*) AS n, (max(ts) - min(ts)) / 1e9 AS s, max(abs(value)) >= 0.1 OR max(value) - min(value) >= 0.002 AS active FROM er GROUP BY 1, 2)
SELECT count(*) AS n_episodes, count(*) FILTER (active) AS n_active, count(*) FILTER (NOT active) AS n_blank, count(*) FILTER (s < 3600) AS n_short, round(sum(s), 3) AS seconds FROM q""")
def e6_episode_report(t: Tables):
    q = episodes.quality(t.episode_rows)
    return q.agg(F.count("*").alias("n_episodes"), F.count_if("active").alias("n_active"), F.count_if(~F.col("active")).alias("n_blank"), F.count_if(F.col("duration_s") < 3600).alias("n_short"), F.round(F.sum("duration_s"), 3).alias("seconds"))


@query("dataset:l episode:l ord:l step:l next_ts:l", f"WITH {EPISODE_ROWS}, s AS (SELECT *, lead(ts) OVER w AS next_ts, row_number() OVER w - 1 AS step FROM er WINDOW w AS (PARTITION BY dataset, episode ORDER BY ts, ord)) SELECT * FROM s WHERE next_ts IS NOT NULL")
def c4_steps(t: Tables):
    return episodes.steps(t.episode_rows)


@query("dataset:l episode:l ord:l", f"WITH {EPISODE_ROWS} SELECT * FROM er WHERE (dataset, episode) IN (SELECT (dataset, episode) FROM er GROUP BY dataset, episode HAVING (max(ts) - min(ts)) / 1e9 >= 7200)")
def c2_long_enough(t: Tables):
    return episodes.long_enough(t.episode_rows, 7200)


@query("dataset:l episode:l ord:l", f"WITH {EPISODE_ROWS} SELECT * FROM er WHERE episode < 3 QUALIFY row_number() OVER (PARTITION BY dataset, episode ORDER BY ts, ord) <= 5")
def c8_limits(t: Tables):
    return episodes.limited(t.episode_rows, 3, 5)


@query("dataset:l episode:l start_ts:l", f"""WITH {PAIRS}, gone AS (SELECT dataset, episode FROM eps WHERE episode % 3 = 1)
SELECT dataset, episode - (SELECT count(*) FROM gone g WHERE g.dataset = e.dataset AND g.episode < e.episode) AS episode, start_ts FROM eps e WHERE (dataset, episode) NOT IN (SELECT (dataset, episode) FROM gone)""")
def h5_drop_episodes(t: Tables):
    e = episodes.numbered(episodes.paired_intervals(t.marks))
    return episodes.without_episodes(e, e.where("episode % 3 = 1"))


@query("dataset:l episode:l task:s n:l", f"""WITH {EPISODE_ROWS}, c AS (SELECT dataset, episode, kind, count(*) AS n, min((ts, ord)) AS f FROM er GROUP BY 1, 2, 3)
SELECT dataset, episode, kind AS task, n FROM c QUALIFY row_number() OVER (PARTITION BY dataset, episode ORDER BY n DESC, f) = 1""")
def e3_dominant_text(t: Tables):
    return signals.dominant(t.episode_rows, "kind")


_NEAREST = """WITH {ev}, l AS (SELECT * FROM ev WHERE kind = 'view'), r AS (SELECT * FROM ev WHERE kind = '{right}'),
m AS (SELECT l.dataset, l.ts, l.ord, r.ord AS right_ord, r.ts - l.ts AS delta, row_number() OVER (PARTITION BY l.dataset, l.ts, l.ord
 ORDER BY abs(r.ts - l.ts), CASE WHEN r.ts = l.ts THEN 0 WHEN r.ts < l.ts THEN {before} ELSE {after} END, CASE WHEN r.ts < l.ts THEN -r.ord ELSE r.ord END) AS k
 FROM l LEFT JOIN r ON r.dataset = l.dataset AND abs(r.ts - l.ts) <= {tol}) SELECT * FROM m WHERE k = 1"""


@query("dataset:l ord:l right_ord:l delta:l", _NEAREST.format(ev=EV, right="click", before=0, after=1, tol=6 * HOUR))
def d5_nearest_frame(t: Tables):
    return asof.nearest(t.kind("view"), t.kind("click"), 6 * HOUR)


@query("dataset:l ord:l right_ord:l delta:l", _NEAREST.format(ev=EV, right="error", before=0, after=1, tol=24 * HOUR))
def d7_nearest_text(t: Tables):
    return asof.nearest(t.kind("view"), t.kind("error"), 24 * HOUR)


@query("dataset:l ord:l right_ts:l", f"""WITH {EV}, l AS (SELECT * FROM ev WHERE kind = 'view'), r AS (SELECT * FROM ev WHERE kind = 'click')
SELECT l.dataset, l.ord, r.ts AS right_ts FROM l LEFT JOIN r ON l.dataset = r.dataset QUALIFY row_number() OVER (PARTITION BY l.dataset, l.ord ORDER BY abs(r.ts - l.ts), r.ts DESC) = 1""")
def d6_nearest_second(t: Tables):
    return asof.nearest_any(t.kind("view"), t.kind("click"), block=24.0 * HOUR)


@query("dataset:l ord:l right_ts:l", f"""WITH {EV}, l AS (SELECT * FROM ev WHERE kind = 'view'), r AS (SELECT * FROM ev WHERE kind = 'click')
SELECT dataset, ord, coalesce((SELECT min(r.ts) FROM r WHERE r.dataset = l.dataset AND r.ts >= l.ts), (SELECT max(r.ts) FROM r WHERE r.dataset = l.dataset)) AS right_ts FROM l""")
def d8_forward_asof(t: Tables):
    return asof.forward(t.kind("view"), t.kind("click"), block=24.0 * HOUR)


_COVERED = "exists(SELECT 1 FROM ev r WHERE r.dataset = l.dataset AND r.kind = '{k}' AND abs(r.ts - l.ts) <= {tol})"


@query("dataset:l ord:l covered:b", f"WITH {EV} SELECT dataset, ord, {_COVERED.format(k='click', tol=12 * HOUR)} AND {_COVERED.format(k='error', tol=12 * HOUR)} AS covered FROM ev l WHERE kind = 'view'")
def d9_camera_coverage(t: Tables):
    return asof.covered(t.kind("view"), [t.kind("click"), t.kind("error")], 12 * HOUR)


def _moving(t: Tables):
    zero = F.lit(0.0)
    return signals.moving(t.episode_rows, zero, zero, F.array("value"), zero, (1, 1, 60.0, 1))


_MOVING = EPISODE_ROWS + ", mv AS (SELECT *, coalesce(abs(value - lag(value) OVER w) > 60, false) AS moving FROM er WINDOW w AS (PARTITION BY dataset, episode ORDER BY ts, ord))"
_TRIM = ", {out} AS (SELECT * FROM (SELECT *, min(CASE WHEN {flag} THEN (ts, ord) END) OVER p AS a, max(CASE WHEN {flag} THEN (ts, ord) END) OVER p AS z FROM {of} WINDOW p AS (PARTITION BY dataset, episode)) WHERE (ts, ord) BETWEEN a AND z)"
_CLEAN = _MOVING + _TRIM.format(out="m1", flag="moving", of="mv") + _TRIM.format(out="m2", flag="kind = 'click'", of="(SELECT * EXCLUDE (a, z) FROM m1)")


@query("dataset:l episode:l ord:l moving:b", f"WITH {_MOVING} SELECT * FROM mv")
def c1_motion_mask(t: Tables):
    return _moving(t)


@query("dataset:l episode:l ord:l", f"WITH {_CLEAN} SELECT * FROM m1")
def e1_motion_trim(t: Tables):
    return signals.trimmed(_moving(t), "moving")


@query("dataset:l episode:l reason:s", f"""WITH {_CLEAN}, d AS (SELECT dataset, episode, (max(ts) - min(ts)) / 1e9 AS s FROM m2 GROUP BY 1, 2)
SELECT dataset, episode, CASE WHEN (dataset, episode) NOT IN (SELECT (dataset, episode) FROM m1) THEN 'static' WHEN s IS NULL THEN 'no_coverage' WHEN s < 2 THEN 'too_short' ELSE 'kept' END AS reason
FROM (SELECT DISTINCT dataset, episode FROM er) LEFT JOIN d USING (dataset, episode)""")
def e14_skip_reasons(t: Tables):
    return signals.skip_reasons(_moving(t).withColumn("has", F.col("kind") == "click"), "moving", "has")


@query("dataset:l episode:l ord:l", f"WITH {_CLEAN} SELECT dataset, episode, ord FROM m2 QUALIFY (max(ts) OVER (PARTITION BY dataset, episode) - min(ts) OVER (PARTITION BY dataset, episode)) / 1e9 >= 2")
def h8_cleaned_rows(t: Tables):
    return signals.cleaned(_moving(t).withColumn("has", F.col("kind") == "click"), "moving", "has")


@query("dataset:l ord:l kind:s from_state:s", f"WITH {EV} SELECT * FROM (SELECT *, lag(kind) OVER (PARTITION BY dataset ORDER BY ts, ord) AS from_state FROM ev) WHERE from_state <> kind")
def f2_transitions(t: Tables):
    return signals.transitions(t.one_episode, "kind")


@query("dataset:l ord:l jump:d", f"WITH {EV} SELECT * FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY dataset ORDER BY ts, ord)) AS jump FROM ev) WHERE jump > 50")
def f3_spikes(t: Tables):
    return signals.spikes(t.one_episode, F.col("value"), 50.0)


@query("dataset:l ord:l axis:l", f"""WITH {EV}, s AS (SELECT dataset, ts, ord, value - 40 AS a, 55 - value AS b FROM ev), x AS (SELECT *, CASE WHEN sum(abs(a)) OVER (PARTITION BY dataset) >= sum(abs(b)) OVER (PARTITION BY dataset) THEN 0 ELSE 1 END AS axis FROM s),
v AS (SELECT *, CASE axis WHEN 0 THEN a ELSE b END AS v FROM x) SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY dataset ORDER BY ts, ord) AS p FROM v) WHERE p * v < 0""")
def f4_zero_crossings(t: Tables):
    return signals.zero_crossings(t.one_episode.withColumn("a", F.col("value") - 40).withColumn("b", 55 - F.col("value")), ["a", "b"])


@query("dataset:l t:d", f"""WITH RECURSIVE {EV}, p AS (SELECT DISTINCT dataset, ts / 3.6e12 AS t FROM ev), nx AS (SELECT a.dataset, a.t, min(b.t) AS n FROM p a LEFT JOIN p b ON a.dataset = b.dataset AND b.t >= a.t + 12 GROUP BY 1, 2),
r AS (SELECT dataset, min(t) AS t FROM p GROUP BY 1 UNION ALL SELECT r.dataset, nx.n FROM r JOIN nx ON nx.dataset = r.dataset AND nx.t = r.t WHERE nx.n IS NOT NULL) SELECT * FROM r""")
def f5_uniform_keyframes(t: Tables):
    return signals.uniform_keyframes(t.one_episode, 12.0)


@query("dataset:l t:d kind:s", f"""WITH RECURSIVE {EV}, p AS (SELECT DISTINCT dataset, ts / 3.6e12 AS t FROM ev), nx AS (SELECT a.dataset, a.t, min(b.t) AS n FROM p a LEFT JOIN p b ON a.dataset = b.dataset AND b.t >= a.t + 12 GROUP BY 1, 2),
r AS (SELECT dataset, min(t) AS t FROM p GROUP BY 1 UNION ALL SELECT r.dataset, nx.n FROM r JOIN nx ON nx.dataset = r.dataset AND nx.t = r.t WHERE nx.n IS NOT NULL),
it AS (SELECT dataset, t, 'uniform' AS kind, 1 AS o FROM r UNION ALL SELECT dataset, ts / 3.6e12, 'gripper', 2 FROM (SELECT *, lag(kind) OVER (PARTITION BY dataset ORDER BY ts, ord) AS f FROM ev) WHERE f <> kind),
io AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY t, o) AS k FROM it),
s AS (SELECT dataset, k, t AS kt, kind AS kk, 1 AS g FROM io WHERE k = 1 UNION ALL SELECT i.dataset, i.k, CASE WHEN i.t - s.kt >= 2 OR (i.kind <> 'uniform' AND s.kk = 'uniform') THEN i.t ELSE s.kt END,
 CASE WHEN i.t - s.kt >= 2 OR (i.kind <> 'uniform' AND s.kk = 'uniform') THEN i.kind ELSE s.kk END, CASE WHEN i.t - s.kt >= 2 THEN g + 1 ELSE g END FROM s JOIN io i ON i.dataset = s.dataset AND i.k = s.k + 1)
SELECT dataset, kt AS t, kk AS kind FROM s QUALIFY row_number() OVER (PARTITION BY dataset, g ORDER BY k DESC) = 1""")
def f6_deduplicated_keyframes(t: Tables):
    uniform = signals.uniform_keyframes(t.one_episode, 12.0).withColumn("kind", F.lit("uniform"))
    events = signals.transitions(t.one_episode, "kind").select("dataset", "episode", "t", F.lit("gripper").alias("kind"))
    return signals.deduplicated_keyframes(uniform.unionByName(events), 2.0)


@query("dataset:l ord:l kind:s", f"WITH {EV} SELECT dataset, ord, kind FROM (SELECT *, CASE kind WHEN 'view' THEN 'uniform' ELSE kind END AS kk FROM ev) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY kk = 'uniform', ts, kk) <= 60")
def f7_capped_keyframes(t: Tables):
    rows = t.one_episode.withColumn("k0", F.col("kind")).withColumn("kind", F.when(F.col("kind") == "view", "uniform").otherwise(F.col("kind")))
    return signals.capped_keyframes(rows).withColumn("kind", F.col("k0"))


@query("dataset:l ord:l smooth:d", f"WITH {EV} SELECT dataset, ord, CASE WHEN count(*) OVER (PARTITION BY dataset) <= 15 THEN value ELSE sum(value) OVER (PARTITION BY dataset ORDER BY ts, ord ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15 END AS smooth FROM ev")
def f8_smoothing(t: Tables):
    return signals.smoothed(t.one_episode, "value")


@query("dataset:l ord:l v:d", f"""WITH {EV}, n AS (SELECT *, lead(value) OVER w AS u, lag(value) OVER w AS d, greatest(coalesce(ts / 3.6e12 - lag(ts / 3.6e12) OVER w, 0), 1e-6) AS dt FROM ev WINDOW w AS (PARTITION BY dataset ORDER BY ts, ord))
SELECT dataset, ord, CASE WHEN dt < 0.01 THEN NULL ELSE round(CASE WHEN u IS NULL AND d IS NULL THEN 0 WHEN d IS NULL THEN u - value WHEN u IS NULL THEN value - d ELSE (u - d) / 2 END / dt, 3) END AS v FROM n""")
def f9_velocity(t: Tables):
    out = signals.velocity(t.one_episode.withColumn("t", F.col("ts") / 3.6e12), "value")
    w = signals.by_time("t")
    dt = F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0.0))
    return out.withColumn("dt", dt).withColumn("v", F.when(F.col("dt") >= 0.01, F.round("v", 3)))


@query("dataset:l speed_limit:d z_limit:d hz:d", f"""WITH {EV}, n AS (SELECT *, ts / 3.6e12 - lag(ts / 3.6e12) OVER (PARTITION BY dataset ORDER BY ts, ord) AS dt FROM ev)
SELECT dataset, quantile_cont(value, 0.2) + 0.005 AS speed_limit, quantile_cont(value, 0.3) AS z_limit, 1 / median(dt) AS hz FROM n GROUP BY 1""")
def f10_thresholds(t: Tables):
    return signals.thresholds(t.one_episode, "value", "value")


@query("dataset:l t_close:d t_open:d", f"""WITH {EV}, c AS (SELECT dataset, ts / 3.6e12 AS a FROM ev WHERE kind = 'signup'), o AS (SELECT dataset, ts / 3.6e12 AS b FROM ev WHERE kind = 'purchase')
SELECT dataset, a AS t_close, b AS t_open FROM c JOIN o USING (dataset) WHERE b > a + 1 QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY a, b) = 1""")
def f11_first_cycle(t: Tables):
    return signals.first_cycle(t.one_episode.where("kind in ('signup', 'purchase')").withColumn("closed", (F.col("kind") == "signup").cast("int")), 1.0)


@query("dataset:l fps:l", f"""WITH {EV}, d AS (SELECT dataset, ts - lag(ts) OVER (PARTITION BY dataset ORDER BY ts, ord) AS dt FROM (SELECT dataset, ord, ts // 1000000 AS ts FROM ev))
SELECT dataset, coalesce(greatest(1, round_even(1e9 / median(dt) FILTER (dt > 0), 0)), 30) AS fps FROM d GROUP BY 1""")
def e4_frame_rate(t: Tables):
    return signals.frame_rate(t.ev.withColumn("ts", F.floor(F.col("ts") / 1_000_000)))


@query("dataset:l ord:l seconds:d", f"WITH {EPISODE_ROWS}, m AS (SELECT dataset, ord, ts - min(ts) OVER (PARTITION BY dataset, episode) AS d FROM er) SELECT dataset, ord, round_even(d / 1e9, 4) AS seconds FROM m")
def b9_relative_seconds(t: Tables):
    from pyspark.sql import Window

    start = F.min("ts").over(Window.partitionBy("dataset", "episode"))
    return t.episode_rows.withColumn("seconds", fields.relative_seconds(F.col("ts"), start))
