"""Fields, labels, merging, reports and control over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..operators import episodes, labels, merging, reports
from ..operators import signals as sig
from ..streaming import control
from . import jobs
from .binding import EV, SEGMENTS, SHIPMENTS, Tables, query


@query("event_id:l ts_ns:l", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) * 1000 END, CASE WHEN event_id % 2 = 0 THEN event_id END, epoch_us(ts)) AS ts_ns FROM events")
def b1_timestamps(t: Tables):
    us, i = F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")
    return t.events.select("event_id", fields.first_timestamp(F.when(i % 3 == 0, us * 1000), F.when(i % 2 == 0, i), us).alias("ts_ns"))


@query("conv_id:l turn:l value:s", "SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN turn % 2 = 0 THEN '  ' ELSE role END), ''), nullif(trim(text), '')) AS value FROM conversations")
def b2_text_values(t: Tables):
    return t.conversations.select("conv_id", "turn", fields.first_text(F.when(F.col("turn") % 2 == 0, F.lit("  ")).otherwise(F.col("role")), F.col("text")).alias("value"))


@query("vec_id:l n:l last:d norm:d names:s", "SELECT vec_id, len(embedding) + 1 AS n, coalesce(CASE WHEN label % 2 = 0 THEN label END, 0) AS last, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm, concat_ws(',', array_to_string(list_transform(range(len(embedding)), lambda i: 'q_' || CAST(i AS VARCHAR)), ','), 'gripper_width') AS names FROM embeddings")
def b3_state_vectors(t: Tables):
    v = F.col("embedding").cast("array<double>")
    state = fields.state_vector(v, F.when(F.col("label") % 2 == 0, F.col("label").cast("double")))
    return t.embeddings.select("vec_id", F.size(state).alias("n"), F.element_at(state, -1).alias("last"), fields.l2_norm(v).alias("norm"), F.concat_ws(",", fields.dimension_names(state, "q", "gripper_width")).alias("names"))


@query("vec_id:l n:l first:d", "SELECT vec_id, CASE WHEN label = 0 THEN 3 ELSE len(embedding) + 1 END AS n, CASE WHEN label = 0 THEN 0.5 ELSE embedding[1] END AS first FROM embeddings")
def b4_action_vectors(t: Tables):
    action = fields.action_vector(F.when(F.col("label") == 0, F.array(F.lit(0.5), F.lit(0.25))), F.col("embedding").cast("array<double>"), F.lit(None).cast("double"))
    return t.embeddings.select("vec_id", F.size(action).alias("n"), F.element_at(action, 1).alias("first"))


@query("user_id:l event_id:l feature:s", "SELECT user_id, event_id, 'observation.images.' || CASE WHEN event_type = min(event_type) OVER (PARTITION BY user_id) THEN 'top' ELSE event_type END AS feature FROM events")
def b7_camera_features(t: Tables):
    from pyspark.sql import Window

    return t.events.select("user_id", "event_id", fields.camera_feature(F.col("event_type"), F.min("event_type").over(Window.partitionBy("user_id"))).alias("feature"))


@query("o_orderkey:l label:s closed:l", "SELECT o_orderkey, concat_ws('.', o_orderpriority, (['free_motion', 'fine_align', 'contact_establish', 'constrained_motion', 'verify_release'])[o_orderkey % 5 + 1]) AS label, CASE WHEN o_totalprice / 1e6 < 0.035 THEN 1 ELSE 0 END AS closed FROM orders")
def b10_subtask_labels(t: Tables):
    return t.orders.select("o_orderkey", fields.subtask_label(F.col("o_orderpriority"), F.col("o_orderkey") % 5).alias("label"), fields.gripper_closed(F.col("o_totalprice") / 1e6).alias("closed"))


@query("event_id:l body:s", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS body FROM events")
def b13_model_output(t: Tables):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("no json here")).otherwise(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone.")))
    return t.events.select("event_id", fields.json_body(raw).alias("body"))


@query("o_orderkey:l prompt:s", "SELECT o_orderkey, printf('Task: %s. Duration: %.2f s.', o_orderpriority, o_totalprice) AS prompt FROM orders")
def b14_prompts(t: Tables):
    return t.orders.select("o_orderkey", fields.prompt_text(F.col("o_orderpriority"), F.col("o_totalprice")).alias("prompt"))


@query("o_orderkey:l prompt:s", "WITH p AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_type FROM part)) SELECT o_orderkey, p_type AS prompt FROM orders JOIN p ON p.i = o_orderkey % p.n")
def b16_cyclic_prompts(t: Tables):
    from pyspark.sql import Window

    p = t.part.select("p_type").distinct().select(F.col("p_type").alias("prompt"), (F.row_number().over(Window.orderBy("p_type")) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    return t.orders.crossJoin(F.broadcast(p.select("n").limit(1))).withColumn("i", F.pmod("o_orderkey", "n")).drop("n").join(p.drop("n"), "i").select("o_orderkey", "prompt")


@query("o_orderkey:l step:l loss:d", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 1000 ELSE o_custkey END AS step, round(o_totalprice, 2) AS loss FROM orders")
def b17_training_log(t: Tables):
    line = F.concat(F.lit("INFO step:"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "K").otherwise(""), F.lit(" smpl:1 loss:"), F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string"), F.lit(" grdn:2"))
    return t.orders.select("o_orderkey", fields.log_step(line).alias("step"), fields.log_loss(line).alias("loss"))


@query("n:l unknown:l", None)
def b19_phase_dropout(t: Tables):
    return t.orders.select(fields.dropped_phase(F.col("o_orderkey") % 5, F.col("o_orderkey")).alias("p")).agg(F.count("*").alias("n"), F.count_if(F.col("p") == 5).alias("unknown"))


@query("n:l near:b kept:l", "SELECT count(*) AS n, true AS near, count(*) AS kept FROM orders")
def b19_dropout_share(t: Tables):
    """All samples stay, those that aren't dropped keep their phase, and the share is within five standard deviations of 15 %."""
    rows = t.orders.select((F.col("o_orderkey") % 5).alias("was"), fields.dropped_phase(F.col("o_orderkey") % 5, F.col("o_orderkey")).alias("p"))
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col("p") == fields.UNKNOWN_PHASE).alias("u"), F.count_if(F.col("p").isin(fields.UNKNOWN_PHASE) | (F.col("p") == F.col("was"))).alias("kept"))
    return out.withColumn("near", F.abs(F.col("u") - 0.15 * F.col("n")) <= 5 * F.sqrt(0.15 * 0.85 * F.col("n")))


@query("source:s n:l n_filled:l", """SELECT source, count(*) AS n, count(*) FILTER (task = 'Picking up a soup can and placing it on a cardboard surface') AS n_filled FROM (SELECT source, coalesce(lang, 'Picking up a soup can and placing it on a cardboard surface') AS task FROM documents) GROUP BY 1""")
def b23_filled_tasks(t: Tables):
    """Documents' languages as tasks; those without one get the fallback."""
    rows, _ = fields.filled_tasks(t.documents.select("source", F.col("lang").alias("task")))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("task") == fields.FALLBACK_TASK).alias("n_filled"))


@query("index:l phase:l", """WITH f AS (SELECT event_id AS index, event_id % 5 AS phase, event_id % 7 - 3 AS o FROM events), b AS (SELECT min(index) AS lo, max(index) AS hi FROM f)
SELECT f.index, g.phase FROM f, b, f g WHERE g.index = greatest(b.lo, least(b.hi, f.index + f.o))""")
def b21_phase_jitter(t: Tables):
    f = t.events.select(F.col("event_id").alias("index"), (F.col("event_id") % 5).alias("phase"))
    return labels.jittered(f, F.col("index") % 7 - 3)


@query("k:l n:l first_start:d", """SELECT o_custkey AS k, count(*) AS n, min(o_totalprice) - CASE WHEN min(o_totalprice) > 3000 + 1 THEN min(o_totalprice) - 100 ELSE 0 END AS first_start FROM orders GROUP BY 1""")
def b24_rebased_subtasks(t: Tables):
    clip = F.struct(F.col("o_orderstatus").alias("phase"), F.col("o_totalprice").alias("start_s"), (F.col("o_totalprice") + 1).alias("end_s"))
    rows = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(clip).alias("clips")).withColumn("ep_start", F.lit(100.0)).withColumn("ep_end", F.lit(3000.0))
    return labels.rebased(rows).select("k", F.size("clips").alias("n"), F.array_min(F.transform("clips", lambda c: c["start_s"])).alias("first_start"))


@query("o_orderkey:l pos:l part_start:d part_end:d", "SELECT o_orderkey, pos, round_even(10 + pos * (o_custkey / 4.0), 4) AS part_start, round_even(10 + (pos + 1) * (o_custkey / 4.0), 4) AS part_end FROM orders, range(4) r(pos)")
def b25_default_layout(t: Tables):
    rows = t.orders.select("o_orderkey", F.lit(10.0).alias("start_s"), (10.0 + F.col("o_custkey")).alias("end_s"))
    return labels.default_layout(rows, ("a", "b", "c", "d"))


@query("vec_id:l reason:s", """SELECT vec_id, CASE WHEN embedding[1] NOT BETWEEN -0.3 AND 0.3 OR embedding[2] NOT BETWEEN -0.3 AND 0.3 OR embedding[3] NOT BETWEEN -0.1 AND 0.4 THEN 'workspace' WHEN list_bool_or([abs(x) > 0.25 FOR x IN embedding[1:6]]) THEN 'velocity' WHEN abs(embedding[8] * 200) > 30 THEN 'force' WHEN label = 0 AND embedding[len(embedding)] > 0.1 THEN 'gripper' END AS reason FROM embeddings""")
def c7_safety_envelope(t: Tables):
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("action"), F.when(F.col("label") == 0, "free_motion").otherwise("contact_establish").alias("phase"), (F.element_at("embedding", 8).cast("double") * 200).alias("force_z"))
    return control.checked_actions(rows, low=(-0.3, -0.3, -0.1), high=(0.3, 0.3, 0.4), velocity=0.25, grip=0.1)


@query("label:l dim:l std:d", "SELECT label, CAST(i AS BIGINT) AS dim, stddev_pop(CAST(embedding[i + 1] AS DOUBLE)) AS std FROM embeddings, range(64) r(i) GROUP BY 1, 2")
def e5_dimension_spread(t: Tables):
    return sig.dimension_spread(t.embeddings.withColumn("v", F.col("embedding").cast("array<double>")), "v", "label")


@query("k:l ord:l phase:l", f"""WITH {SEGMENTS}, {SHIPMENTS} SELECT k, ord, phase FROM (SELECT DISTINCT * FROM ship) JOIN seg USING (k)
QUALIFY row_number() OVER (PARTITION BY k, ts, ord ORDER BY CASE WHEN ts BETWEEN start_t AND end_t THEN 0 ELSE 1 END, CASE WHEN ts BETWEEN start_t AND end_t THEN 0 ELSE least(abs(ts - start_t), abs(ts - end_t)) END, pos) = 1""")
def d10_subtask_lookup(t: Tables):
    return labels.nearest_phase(t.shipments, t.segments, "k", 200.0)


@query("k:l ord:l phase:l", f"WITH {SEGMENTS}, {SHIPMENTS} SELECT ship.k, ord, coalesce(min_by(phase, pos), -1) AS phase FROM ship LEFT JOIN seg ON ship.k = seg.k AND ts >= start_t AND ts < end_t GROUP BY ship.k, ts, ord")
def d11_half_open_lookup(t: Tables):
    return labels.half_open_phase(t.shipments, t.segments, "k", 200.0)


_DENSE = SEGMENTS + """, e AS (SELECT k, min(start_t) AS s0, count(*) * 20 AS n FROM seg GROUP BY 1), f AS (SELECT k, s0, unnest(range(n)) AS frame_idx FROM e),
dense AS (SELECT f.k, f.frame_idx, coalesce(max_by(phase, (start_t, pos)) FILTER (start_t - s0 <= frame_idx / 0.1), min_by(phase, (start_t, pos))) AS phase FROM f JOIN seg ON f.k = seg.k GROUP BY 1, 2)"""


def _dense(t: Tables):
    from pyspark.sql import Window

    seg = t.segments.withColumn("start_t", F.col("start_t") - F.min("start_t").over(Window.partitionBy("k")))
    return labels.densified(seg, seg.groupBy("k").agg((F.count("*") * 20).alias("n_frames")), "k", 0.1)


@query("k:l frame_idx:l phase:l", f"WITH {_DENSE} SELECT * FROM dense")
def d12_dense_labels(t: Tables):
    return _dense(t)


@query("k:l frame_idx:l phase:l", f"WITH {SEGMENTS}, n AS (SELECT k, count(*) AS n FROM seg GROUP BY 1), f AS (SELECT k, unnest(range(n + k % 3 - 1)) AS frame_idx FROM n) SELECT f.k, frame_idx, phase FROM f JOIN n USING (k) JOIN seg ON seg.k = f.k AND seg.pos = least(frame_idx, n - 1)")
def d14_label_write_back(t: Tables):
    n = t.segments.groupBy("k").agg(F.count("*").alias("n")).withColumn("m", F.col("n") + F.col("k") % 3 - 1).where("m > 0")
    frames = n.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("frame_idx"))
    return labels.written_back(frames, t.segments.select("k", F.col("pos").alias("frame_idx"), "phase"), "k")


@query("phase:l n:l share:d", f"WITH {_DENSE} SELECT phase, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM dense GROUP BY 1")
def e7_phase_frequency(t: Tables):
    return labels.phase_shares(_dense(t))


_LEGAL = "(prev, phase) NOT IN ((0,0),(0,1),(1,0),(1,1),(1,2),(2,2),(2,3),(3,3),(3,4),(4,4))"
_CONTIGUITY = """cont AS (SELECT k, 'error' AS severity, 'contiguity_' || min_by(r, (CASE r WHEN 'start' THEN 0 WHEN 'end' THEN 1 ELSE 2 END, pos)) AS rule FROM (SELECT *, CASE WHEN pe IS NULL AND abs(start_t) > 0.05 THEN 'start' WHEN nx IS NULL AND abs(end_t - duration) > 0.05 THEN 'end' WHEN abs(start_t - pe) > 0.05 THEN 'gap' WHEN start_t < ps THEN 'order' END AS r
 FROM (SELECT *, lag(end_t) OVER w AS pe, lag(start_t) OVER w AS ps, lead(start_t) OVER w AS nx FROM rel WINDOW w AS (PARTITION BY k ORDER BY pos))) WHERE r IS NOT NULL GROUP BY k)"""
_RELATIVE = SEGMENTS + ", rel AS (SELECT k, pos, phase, start_t - s0 AS start_t, end_t - s0 - CASE WHEN phase = 5 THEN 1 ELSE 0 END AS end_t, confidence, max(end_t) OVER (PARTITION BY k) - s0 AS duration FROM (SELECT *, min(start_t) OVER (PARTITION BY k) AS s0 FROM seg))"


def _relative(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("k")
    s0 = F.min("start_t").over(w)
    return t.segments.withColumn("duration", F.max("end_t").over(w) - s0).withColumn("s0", s0).withColumn("start_t", F.col("start_t") - F.col("s0")).withColumn("end_t", F.col("end_t") - F.col("s0") - (F.col("phase") == 5).cast("int"))


@query("k:l severity:s rule:s", f"WITH {_RELATIVE}, {_CONTIGUITY} SELECT * FROM cont")
def f16_contiguity(t: Tables):
    r = _relative(t)
    return labels.contiguity_issues(r, r.select("k", "duration").distinct(), "k")


@query("k:l n:l", f"WITH {SEGMENTS}, p AS (SELECT *, lag(phase) OVER (PARTITION BY k ORDER BY pos) AS prev FROM seg) SELECT k, count(*) AS n FROM p WHERE prev IS NOT NULL AND {_LEGAL} GROUP BY 1")
def f17_transition_legality(t: Tables):
    return labels.transition_issues(t.segments, "k").groupBy("k").agg(F.count("*").alias("n"))


@query("k:l n:l", f"WITH {SEGMENTS} SELECT k, count(*) AS n FROM seg WHERE end_t - start_t < 10 AND confidence < 0.95 GROUP BY 1")
def f18_short_segments(t: Tables):
    return labels.short_issues(t.segments, "k", 10.0).groupBy("k").agg(F.count("*").alias("n"))


@query("k:l severity:s rule:s", f"""WITH {_RELATIVE}, fr AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 50.0 AS t, o_totalprice / 1e5 AS force FROM orders), on_ AS (SELECT k, min(t) FILTER (force > 3) AS onset FROM fr GROUP BY 1), f AS (SELECT k, min_by(start_t, pos) AS s FROM rel WHERE phase = 2 GROUP BY 1)
SELECT k, 'warning' AS severity, 'fsm_crosscheck' AS rule FROM f JOIN on_ USING (k) WHERE abs(s - onset) > 0.2""")
def f19_contact_check(t: Tables):
    from pyspark.sql import Window

    fr = t.orders.select(F.col("o_custkey").alias("k"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) * 50.0).alias("t"), (F.col("o_totalprice") / 1e5).alias("force"), F.lit(1).alias("closed"))
    return labels.contact_issues(_relative(t), fr, "k")


@query("k:l rule:s", f"WITH {SEGMENTS} SELECT k, 'coverage' AS rule FROM seg GROUP BY k HAVING count(DISTINCT phase) FILTER (phase < 5) < 5")
def f20_phase_coverage(t: Tables):
    return labels.coverage_issues(t.segments, "k")


@query("k:l n_issues:l passed:b", f"""WITH {_RELATIVE}, {_CONTIGUITY}, p AS (SELECT *, lag(phase) OVER (PARTITION BY k ORDER BY pos) AS prev FROM rel),
i AS (SELECT k, severity FROM cont UNION ALL SELECT k, 'error' FROM p WHERE prev IS NOT NULL AND {_LEGAL} UNION ALL SELECT k, 'error' FROM rel WHERE NOT (phase BETWEEN 0 AND 4) OR start_t >= end_t
 UNION ALL SELECT k, 'warning' FROM rel WHERE end_t - start_t < 0.1 AND confidence < 0.95 UNION ALL SELECT k, 'warning' FROM rel GROUP BY k HAVING count(DISTINCT phase) FILTER (phase < 5) < 5)
SELECT k, count(severity) AS n_issues, count(*) FILTER (severity = 'error') = 0 AS passed FROM (SELECT DISTINCT k FROM rel) LEFT JOIN i USING (k) GROUP BY k""")
def f21_validation_verdict(t: Tables):
    r = _relative(t)
    found = [labels.schema_issues(r, "k"), labels.contiguity_issues(r, r.select("k", "duration").distinct(), "k"), labels.transition_issues(r, "k"), labels.short_issues(r, "k"), labels.coverage_issues(r, "k")]
    return labels.verdicts(r, found, "k")


# merging: each return flag is a source dataset, an order its episode, a line its frame, a part's type its task
_SOURCES = """src AS (SELECT l_returnflag AS dataset, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey) - 1 AS episode_index, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS index, l_orderkey * 10 + l_linenumber AS id, l_partkey FROM lineitem),
sizes AS (SELECT dataset, max(episode_index) + 1 AS n_episodes, count(*) AS n_frames FROM src GROUP BY 1), offs AS (SELECT dataset, coalesce(sum(n_episodes) OVER w, 0) AS eo, coalesce(sum(n_frames) OVER w, 0) AS fo FROM sizes WINDOW w AS (ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _parts(t: Tables):
    """Lines with the part of their dataset that they lie in: a thousand order keys."""
    lines = t.lineitem.select(F.col("l_returnflag").alias("dataset"), "l_orderkey", "l_linenumber", "l_partkey")
    return lines.withColumn("part", F.floor(F.col("l_orderkey") / 1000))


def _part_sizes(t: Tables):
    """(dataset, part, e, f): its orders and lines."""
    return _parts(t).groupBy("dataset", "part", "l_orderkey").agg(F.count("*").alias("n")).groupBy("dataset", "part").agg(F.count("*").alias("e"), F.sum("n").alias("f"))


def _source(t: Tables):
    """Orders of a return flag with places that earlier orders leave; lines are placed within their part, so no window spans a dataset's frames."""
    from pyspark.sql import Window

    before = Window.partitionBy("dataset").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = _part_sizes(t).select(F.col("dataset").alias("bd"), F.col("part").alias("bp"), F.coalesce(F.sum("e").over(before), F.lit(0)).alias("e0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0"))
    inner = Window.partitionBy("dataset", "part")
    placed = _parts(t).withColumn("f", F.row_number().over(inner.orderBy("l_orderkey", "l_linenumber")) - 1).withColumn("e", F.dense_rank().over(inner.orderBy("l_orderkey")) - 1)
    placed = placed.join(base.hint("merge"), (F.col("dataset") == F.col("bd")) & (F.col("part") == F.col("bp")))
    return placed.select("dataset", (F.col("e") + F.col("e0")).alias("episode_index"), (F.col("f") + F.col("f0")).alias("index"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey")


def _sizes(t: Tables):
    return _part_sizes(t).groupBy("dataset").agg(F.sum("e").alias("n_episodes"), F.sum("f").alias("n_frames"))


@query("dataset:s id:l episode_index:l index:l", f"WITH {_SOURCES} SELECT dataset, id, episode_index + eo AS episode_index, index + fo AS index FROM src JOIN offs USING (dataset)")
def h1_dataset_union(t: Tables):
    return merging.united(_source(t), merging.offsets(_sizes(t)))


_TASKS = "tasks AS (SELECT p_brand AS dataset, p_type AS task, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS task_index FROM (SELECT DISTINCT p_brand, p_type FROM part)), reg AS (SELECT task, row_number() OVER (ORDER BY f, task) - 1 AS global_index FROM (SELECT task, min((dataset, task_index)) AS f FROM tasks GROUP BY 1))"


def _tasks(t: Tables):
    from pyspark.sql import Window

    return t.part.select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("task")).distinct().withColumn("task_index", F.row_number().over(Window.partitionBy("dataset").orderBy("task")) - 1)


@query("task:s global_index:l", f"WITH {_TASKS} SELECT * FROM reg")
def h2_task_registry(t: Tables):
    return merging.task_registry(_tasks(t))


@query("dataset:s task_index:l task:s", f"""WITH {_TASKS}, u AS (SELECT DISTINCT p_brand AS dataset, CASE WHEN p_size = 1 THEN NULL ELSE p_size * 3 END AS task_index FROM part)
SELECT *, 'unknown task (' || dataset || ':' || coalesce(CAST(task_index AS VARCHAR), 'null') || ')' AS task FROM u WHERE NOT exists(SELECT 1 FROM tasks t WHERE t.dataset = u.dataset AND t.task_index = u.task_index)""")
def h3_synthetic_tasks(t: Tables):
    used = t.part.select(F.col("p_brand").alias("dataset"), F.when(F.col("p_size") != 1, F.col("p_size") * 3).alias("task_index"))
    return merging.synthetic_tasks(used, _tasks(t))


@query("p_partkey:l task_index:l", f"WITH {_TASKS} SELECT p_partkey, global_index AS task_index FROM part JOIN reg ON p_type = task")
def d15_task_remap(t: Tables):
    tasks = _tasks(t)
    local = tasks.select(F.col("dataset").alias("b"), F.col("task").alias("ty"), "task_index")
    frames = t.part.join(local, (F.col("p_brand") == F.col("b")) & (F.col("p_type") == F.col("ty"))).select(F.col("p_brand").alias("dataset"), "p_partkey", "task_index")
    return merging.remapped_tasks(frames, tasks, merging.task_registry(tasks))


_VIDEOS = "f AS (SELECT s_nationkey AS dataset, CASE WHEN s_suppkey % 3 = 0 THEN 'top' ELSE 'wrist' END AS video_key, s_suppkey AS file_index, 25 - s_nationkey AS nth FROM supplier), g AS (SELECT *, row_number() OVER (PARTITION BY video_key ORDER BY nth, file_index) - 1 AS global_file FROM f)"


def _videos(t: Tables):
    """Suppliers as video files of two cameras, their nations as datasets, the last one first."""
    return t.supplier.select(F.col("s_nationkey").alias("dataset"), F.when(F.col("s_suppkey") % 3 == 0, "top").otherwise("wrist").alias("video_key"), F.col("s_suppkey").alias("file_index"), (25 - F.col("s_nationkey")).alias("nth"))


@query("dataset:l video_key:s file_index:l global_file:l", f"WITH {_VIDEOS} SELECT * FROM g")
def d16_file_remap(t: Tables):
    return merging.remapped_files(_videos(t), "nth", "video_key")


@query("path:s target:s", f"WITH {_VIDEOS} SELECT CAST(file_index AS VARCHAR) AS path, printf('videos/%s/chunk-000/file-%03d.mp4', video_key, global_file) AS target FROM g")
def d16_copy_manifest(t: Tables):
    return merging.copy_manifest(merging.remapped_files(_videos(t), "nth", "video_key").withColumn("path", F.col("file_index").cast("string")))


@query("c_custkey:l", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def d17_missing_items(t: Tables):
    return merging.missing_items(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


# each label's vectors are a dataset of so many frames; of the features the second one is there in some datasets only
_STATS = """e AS (SELECT label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), fr AS (SELECT label, count(*) AS frames FROM embeddings GROUP BY 1),
s AS (SELECT label, pos, frames, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q25, count(*) AS n FROM e JOIN fr USING (label) GROUP BY 1, 2, 3),
l AS (SELECT label, frames, f.feature, pos, unnest(['mean', 'std', 'min', 'max', 'q25', 'count', 'dim']) AS stat, unnest([mean, std, lo, hi, q25, CAST(n AS DOUBLE), CAST(label AS DOUBLE)]) AS value FROM s, (SELECT unnest(['state', 'some']) AS feature) f WHERE f.feature = 'state' OR label % 2 = 0)"""
_MERGED = _STATS + """, m AS (SELECT feature, stat, pos, CASE WHEN stat = 'min' THEN min(value) WHEN stat = 'max' THEN max(value) WHEN stat = 'count' THEN sum(value) WHEN stat = 'dim' THEN min(value) ELSE sum(value * frames) / (SELECT sum(frames) FROM fr) END AS value FROM l GROUP BY feature, stat, pos)"""


def _stats(t: Tables):
    e = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    frames = t.embeddings.groupBy(F.col("label").alias("dataset")).agg(F.count("*").alias("frames"))
    by = {"mean": F.avg("x"), "std": F.stddev_pop("x"), "min": F.min("x"), "max": F.max("x"), "q25": F.percentile("x", 0.25), "count": F.count("*").cast("double"), "dim": F.first("label").cast("double")}
    s = e.groupBy(F.col("label").alias("dataset"), "pos").agg(*[c.alias(n) for n, c in by.items()]).join(frames.hint("merge"), "dataset")
    long = s.select("dataset", "frames", "pos", F.explode(F.create_map(*[x for n in by for x in (F.lit(n), F.col(n))])).alias("stat", "value"))
    return long.withColumn("feature", F.explode(F.when(F.col("dataset") % 2 == 0, F.array(F.lit("state"), F.lit("some"))).otherwise(F.array(F.lit("state")))))


@query("feature:s stat:s pos:l value:d", f"WITH {_MERGED} SELECT * FROM m")
def e9_merged_stats(t: Tables):
    """Every dimension, with all kinds of statistics."""
    return merging.merged_stats(_stats(t))


@query("feature:s stat:s pos:l value:d", f"""WITH {_MERGED}, p AS (SELECT f.feature, pos, avg(x) AS mean, stddev_pop(x) AS std FROM e, (SELECT unnest(['state', 'some']) AS feature) f WHERE f.feature = 'state' OR label % 2 = 0 GROUP BY 1, 2)
SELECT m.feature, stat, m.pos, CASE stat WHEN 'mean' THEN mean WHEN 'std' THEN std ELSE value END AS value FROM m JOIN p USING (feature, pos)""")
def e9_pooled_stats(t: Tables):
    """Mean and std are those of all vectors together."""
    return merging.merged_stats(_stats(t), mode="pooled")


@query("stat:s pos:l value:d", """WITH e AS (SELECT label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT label, pos, avg(x) AS mean, min(x) AS lo, max(x) AS hi, count(*) AS n FROM e GROUP BY 1, 2)
SELECT 'mean' AS stat, pos, sum(mean * n) / sum(n) AS value FROM s GROUP BY 2 UNION ALL SELECT 'min', pos, min(lo) FROM s GROUP BY 2 UNION ALL SELECT 'max', pos, max(hi) FROM s GROUP BY 2 UNION ALL SELECT 'count', pos, sum(n) FROM s GROUP BY 2""")
def e9_whole_merged_stats(t: Tables):
    """The feature that all datasets have; its SQL takes the dimensions by another way."""
    return merging.merged_stats(_stats(t).where("feature = 'state' and stat in ('mean', 'min', 'max', 'count')"))


@query("total_episodes:l total_frames:l train:s", f"WITH {_SOURCES} SELECT sum(n_episodes) AS total_episodes, sum(n_frames) AS total_frames, '0:' || CAST(CAST(sum(n_episodes) AS BIGINT) AS VARCHAR) AS train FROM sizes")
def e10_dataset_totals(t: Tables):
    return merging.totals(t.lineitem.groupBy(F.col("l_returnflag").alias("dataset")).agg(F.countDistinct("l_orderkey").alias("n_episodes"), F.count("*").alias("n_frames")))


@query("dataset:l episodes:l labelled:l", "SELECT o_custkey AS dataset, count(*) AS episodes, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS labelled FROM orders GROUP BY 1")
def e11_catalogue(t: Tables):
    o = t.orders.select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("episode"), "o_orderstatus")
    return reports.catalogue(o, o.where("o_orderstatus = 'F'"))


@query("dataset:l rule:s severity:s", """WITH i AS (SELECT o_custkey AS d, CASE WHEN o_custkey % 4 = 0 THEN 'v2.1' WHEN o_custkey % 4 <> 1 THEN 'v3.0' END AS v, count(*) FILTER (o_orderstatus = 'F') AS e, count(*) FILTER (o_orderstatus = 'O') AS f, count(*) FILTER (o_orderpriority LIKE '1%') AS t FROM orders GROUP BY 1),
k AS (SELECT * FROM i WHERE d % 13 <> 0 AND d % 17 <> 0)
SELECT d AS dataset, 'info' AS rule, 'error' AS severity FROM i WHERE d % 13 = 0 UNION ALL SELECT d, 'info_json', 'error' FROM i WHERE d % 13 <> 0 AND d % 17 = 0 UNION ALL SELECT d, 'version', 'error' FROM k WHERE v IS DISTINCT FROM 'v3.0' UNION ALL SELECT d, 'episodes', 'error' FROM k WHERE e = 0
UNION ALL SELECT d, 'frames', 'error' FROM k WHERE f = 0 UNION ALL SELECT d, 'tasks', 'error' FROM k WHERE t = 0 UNION ALL SELECT d, 'tasks_file', 'error' FROM k WHERE d % 5 = 0 UNION ALL SELECT d, 'data', 'error' FROM k WHERE d % 6 = 0 UNION ALL SELECT d, 'videos', 'error' FROM k WHERE d % 7 = 0 UNION ALL SELECT d, 'stats', 'warning' FROM k WHERE d % 3 = 0""")
def e15_readiness(t: Tables):
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    i = t.orders.groupBy(F.col("o_custkey").alias("dataset")).agg(status("F").alias("n_episodes"), status("O").alias("n_frames"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("n_tasks"))
    d = F.col("dataset")
    facts = {"has_info": d % 13 != 0, "info_readable": d % 17 != 0, "version": F.when(d % 4 == 0, "v2.1").when(d % 4 != 1, "v3.0"), "has_tasks": d % 5 != 0, "n_data_files": d % 6, "n_videos": F.when(d % 7 != 0, d), "has_stats": d % 3 != 0}
    return merging.readiness(i.withColumns(facts))


@query("dataset:s field:s value:s", "WITH i AS (SELECT p_brand AS dataset, CAST(min(p_size) AS VARCHAR) AS fps, CAST(count(DISTINCT p_type) > 2 AS VARCHAR) AS features FROM part GROUP BY 1), u AS (SELECT dataset, 'fps' AS field, fps AS value FROM i UNION ALL SELECT dataset, 'features', features FROM i) SELECT * FROM u WHERE value <> (SELECT min_by(value, dataset) FROM u v WHERE v.field = u.field)")
def e16_compatibility(t: Tables):
    i = t.part.groupBy(F.col("p_brand").alias("dataset")).agg(F.min("p_size").alias("fps"), (F.countDistinct("p_type") > 2).alias("features"))
    return merging.incompatibilities(i, ["fps", "features"])


_RATED = "rated AS (SELECT lang, source, doc_id, quality = 1 AS ok FROM documents JOIN labels USING (doc_id))"


def _rated(t: Tables):
    return t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id").withColumn("ok", F.col("quality") == 1)


@query("lang:s source:s n:l rate:d low:d high:d", f"""WITH {_RATED}, a AS (SELECT lang, source, count(*) AS n, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS rate FROM rated GROUP BY 1, 2), w AS (SELECT *, 1.96::DOUBLE AS z FROM a)
SELECT *, greatest(0, (rate + z * z / (2 * n) - z * sqrt(rate * (1 - rate) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)) AS low, least(1, (rate + z * z / (2 * n) + z * sqrt(rate * (1 - rate) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)) AS high FROM w""")
def e12_success_intervals(t: Tables):
    return reports.wilson(_rated(t), ["lang", "source"], "ok")


@query("lang:s success_rate:d n_failed:l top_failure:s", f"""WITH {_RATED}, f AS (SELECT lang, source, count(*) AS n, min(doc_id) AS d FROM rated WHERE NOT ok GROUP BY 1, 2), b AS (SELECT lang, source AS top_failure FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, d) = 1)
SELECT * FROM (SELECT lang, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS success_rate, count(*) FILTER (NOT ok) AS n_failed FROM rated GROUP BY 1) LEFT JOIN b USING (lang)""")
def e13_failure_summary(t: Tables):
    return reports.failure_summary(_rated(t), ["lang"], "ok", "source", "doc_id")


@query("quality:l toxic:l n:l share:d", "SELECT quality, toxic, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY quality) AS share FROM labels GROUP BY 1, 2")
def e17_agreement(t: Tables):
    return reports.agreement(t.labels, "quality", "toxic")


@query("k:l step:l rate:d percent:d hours_left:d", """WITH p AS (SELECT o_custkey AS k, o_orderkey AS step, epoch(o_orderdate) AS t FROM orders), l AS (SELECT *, lead(step) OVER w AS ps, lead(t) OVER w AS pt, row_number() OVER w AS r FROM p WINDOW w AS (PARTITION BY k ORDER BY step DESC)),
x AS (SELECT k, step, CASE WHEN t > pt THEN (step - ps) / (t - pt) END AS rate FROM l WHERE r = 1) SELECT *, 100.0 * step / 1000000 AS percent, round((1000000 - step) / rate / 3600 / 1e6, 2) AS hours_left FROM x""")
def f22_run_progress(t: Tables):
    p = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("step"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("t"))
    return reports.progress(p, "k", 1_000_000).withColumn("hours_left", F.round(F.col("hours_left") / 1e6, 2))


# orders of a customer as the lines of a log: rank0 tracebacks, short and long rules of dashes, words of trouble
_LINES = """l AS (SELECT o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, CASE WHEN o_orderkey % 11 = 0 THEN '[rank0]: Traceback (most recent call last):' WHEN o_orderkey % 13 = 0 THEN repeat('=', 65) WHEN o_orderkey % 13 = 1 THEN '-----'
 WHEN o_orderkey % 7 = 0 THEN 'Killed' WHEN o_orderkey % 7 = 1 THEN 'CUDA is out of memory' WHEN o_orderkey % 7 = 2 THEN 'RuntimeError: x' ELSE 'the step failed' END AS line FROM orders)"""


@query("path:l pos:l", f"""WITH {_LINES}, m AS (SELECT *, regexp_matches(line, '(error|exception|traceback|killed|oom|cuda)', 'i') AS err, max(pos) FILTER (contains(line, 'Traceback (most recent call last):')) OVER (PARTITION BY path) AS tb FROM l),
s AS (SELECT *, min(pos) FILTER (starts_with(line, repeat('=', 65)) AND pos > tb) OVER (PARTITION BY path) AS stop, bool_or(err) OVER (PARTITION BY path) AS any_err FROM m)
SELECT path, pos FROM s WHERE pos >= tb AND (stop IS NULL OR pos < stop) UNION ALL
SELECT path, pos FROM (SELECT path, pos, row_number() OVER (PARTITION BY path ORDER BY pos DESC) AS r FROM s WHERE tb IS NULL AND err) WHERE r <= 3 UNION ALL
SELECT path, pos FROM (SELECT path, pos, row_number() OVER (PARTITION BY path ORDER BY pos DESC) AS r FROM s WHERE tb IS NULL AND NOT any_err) WHERE r <= 2""")
def f23_log_errors(t: Tables):
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    line = (
        F.when(key % 11 == 0, "[rank0]: Traceback (most recent call last):").when(key % 13 == 0, "=" * 65).when(key % 13 == 1, "-----")
        .when(key % 7 == 0, "Killed").when(key % 7 == 1, "CUDA is out of memory").when(key % 7 == 2, "RuntimeError: x").otherwise("the step failed")
    )
    lines = t.orders.select(F.col("o_custkey").alias("path"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("pos"), line.alias("line"))
    return reports.log_errors(lines, most_matches=3, most_lines=2)


def _signals(t: Tables):
    names = dict(zip(control.SIGNALS, ("view", "click", "purchase", "signup", "error")))
    return t.ev.select(F.col("dataset").alias("key"), "ts", "ord", "value", *[(F.col("kind") == k).alias(s) for s, k in names.items()])


_MACHINE = """WITH RECURSIVE """ + EV + """, e AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ts, ord) AS i FROM ev),
r AS (SELECT dataset, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ord, 0 AS was, 0 AS phase, CAST(NULL AS BIGINT) AS entry FROM (SELECT DISTINCT dataset FROM ev)
 UNION ALL SELECT e.dataset, e.i, e.ord, r.phase, CASE WHEN r.phase = 1 AND e.i - coalesce(r.entry, e.i) > 5 THEN 0 WHEN r.phase = 0 AND kind = 'view' THEN 1 WHEN r.phase = 1 AND kind = 'click' THEN 2 WHEN r.phase = 2 AND kind = 'purchase' THEN 3 WHEN r.phase = 3 AND kind = 'signup' THEN 4 ELSE r.phase END,
 CASE WHEN r.phase = 1 AND e.i - coalesce(r.entry, e.i) <= 5 THEN coalesce(r.entry, e.i) END FROM r JOIN e ON e.dataset = r.dataset AND e.i = r.i + 1)"""


@query("key:l ord:l phase:l", f"{_MACHINE} SELECT dataset AS key, ord, phase FROM r WHERE i > 0")
def j1_phase_machine(t: Tables):
    return control.phases_batch(_signals(t), control.PhaseRules(1, 5))


@query("key:l ord:l from_phase:l phase:l", f"{_MACHINE} SELECT dataset AS key, ord, was AS from_phase, phase FROM r WHERE i > 0 AND was <> phase")
def j5_phase_changes(t: Tables):
    return control.phase_changes(control.phases_batch(_signals(t), control.PhaseRules(1, 5)))


_B0, _B1, _B2, _A1, _A2 = control.butterworth(2.0, 30.0)


@query("key:l ord:l filtered:d", f"""WITH RECURSIVE {EV}, e AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ts, ord) AS i FROM ev),
r AS (SELECT dataset, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ord, 0::DOUBLE AS x1, 0::DOUBLE AS x2, 0::DOUBLE AS y1, 0::DOUBLE AS y2 FROM (SELECT DISTINCT dataset FROM ev)
 UNION ALL SELECT e.dataset, e.i, e.ord, e.value, r.x1, {_B0!r}::DOUBLE * e.value + {_B1!r}::DOUBLE * r.x1 + {_B2!r}::DOUBLE * r.x2 - ({_A1!r}::DOUBLE) * r.y1 - ({_A2!r}::DOUBLE) * r.y2, r.y1 FROM r JOIN e ON e.dataset = r.dataset AND e.i = r.i + 1)
SELECT dataset AS key, ord, y1 AS filtered FROM r WHERE i > 0""")
def j4_low_pass(t: Tables):
    return control.low_passed(_signals(t), "value", 2.0, 30.0)


@query("key:l trace:s", f"WITH {EV} SELECT dataset AS key, string_agg(CAST(ord % 5 AS VARCHAR), ',' ORDER BY ord) AS trace FROM ev GROUP BY 1")
def j6_phase_trace(t: Tables):
    return control.phase_trace(t.ev.select(F.col("dataset").alias("key"), F.col("ord").alias("step"), (F.col("ord") % 5).alias("phase")))


@query("label:l phase:l n:l share:d n_matches:l", f"""{_MACHINE}, mk AS (SELECT *, lead(ts) OVER (PARTITION BY dataset ORDER BY ts, ord) AS nts FROM ev WHERE kind IN ('signup', 'purchase')),
sg AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY ts, nts) - 1 AS pos, ts AS a, nts AS z FROM mk WHERE kind = 'signup' AND nts IS NOT NULL),
lb AS (SELECT e.dataset, e.ord, coalesce(min_by(pos % 5, pos), -1) AS label FROM ev e LEFT JOIN sg ON sg.dataset = e.dataset AND e.ts >= a AND e.ts < z GROUP BY 1, 2)
SELECT label, phase, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY label) AS share, count(*) FILTER (label >= 0 AND label = phase) AS n_matches FROM r JOIN lb ON lb.dataset = r.dataset AND lb.ord = r.ord WHERE r.i > 0 GROUP BY 1, 2""")
def e17_machine_against_labels(t: Tables):
    """The machine's replay of each user's log against the stretches from a signup to the next mark, labelled in turn."""
    marks = episodes.numbered(episodes.paired_intervals(t.marks, 8.64e13)).where("end_ts is not null")
    segments = marks.select(F.col("dataset").alias("key"), F.col("episode").alias("pos"), (F.col("episode") % 5).alias("phase"), F.col("start_ts").alias("start_t"), F.col("end_ts").alias("end_t"))
    rows = jobs.machine_against_labels(_signals(t), segments, control.PhaseRules(1, 5), 8.64e13)
    hits = rows.groupBy(F.col("label").alias("__l"), F.col("phase").alias("__p")).agg(F.count_if("match").alias("n_matches"))
    return reports.agreement(rows, "label", "phase").join(hits.hint("merge"), (F.col("label") == F.col("__l")) & (F.col("phase") == F.col("__p")))
