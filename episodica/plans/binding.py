"""How queries are registered, and the given tables in the shapes that the operators take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_KINDS = {"l": ("long", "BIGINT"), "d": ("double", "DOUBLE"), "s": ("string", "VARCHAR"), "b": ("boolean", "BOOLEAN")}


def query(columns: str, sql: str | None = None):
    """Register a query: ``columns`` lists its output as name:kind (l, d to 6 digits, s, b), ``sql`` is the same in SQL."""
    spec = [c.split(":") for c in columns.split()]

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Tables(spark, sf_dir))
            return df.select(*[(F.round(F.col(c).cast("double"), 6) + 0.0 if k == "d" else F.col(c).cast(_KINDS[k][0])).alias(c) for c, k in spec])

        QUERIES[f.__name__] = run
        if sql:
            out = ", ".join((f"round(CAST({c} AS DOUBLE), 6) + 0.0" if k == "d" else f"CAST({c} AS {_KINDS[k][1]})") + f" AS {c}" for c, k in spec)
            ORACLE_SQL[f.__name__] = f"SELECT {out} FROM ({sql})"
        return f

    return add


def days(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 86400e6


class Tables:
    """The given tables, read as they are, and the views of them that stand for session data."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def ev(self) -> DataFrame:
        """Events as a log: dataset, ord, ts in ns, kind, value."""
        return self.events.select(F.col("user_id").alias("dataset"), F.col("event_id").alias("ord"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"), F.col("event_type").alias("kind"), "value")

    def kind(self, *kinds: str) -> DataFrame:
        return self.ev.where(F.col("kind").isin(*kinds))

    @property
    def marks(self) -> DataFrame:
        from ..operators import episodes

        return episodes.normalised_events(self.ev, F.col("kind"), ("signup",), ("purchase",))

    @property
    def episode_rows(self) -> DataFrame:
        from ..operators import episodes

        return episodes.episode_rows(self.kind("view", "click", "error"), self.marks, 8.64e13, 10)

    @property
    def one_episode(self) -> DataFrame:
        """Each user's whole log as one episode, t in hours."""
        return self.ev.withColumn("episode", F.lit(0)).withColumn("t", F.col("ts") / 3.6e12)

    @property
    def segments(self) -> DataFrame:
        """A customer's orders as phase segments in days: k, pos, phase, start_t, end_t, confidence."""
        w = Window.partitionBy("k").orderBy("start_t", "o_orderkey")
        o = self.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", days(F.col("o_orderdate")).alias("start_t"))
        return o.select("k", (F.row_number().over(w) - 1).alias("pos"), (F.col("o_orderkey") % 6).alias("phase"), "start_t", F.coalesce(F.lead("start_t").over(w), F.col("start_t") + 10).alias("end_t"), ((F.col("o_orderkey") % 100) / 100).alias("confidence"))

    @property
    def shipments(self) -> DataFrame:
        """Lines as frames of a customer: k, ts in days, ord."""
        o = self.orders.select("o_orderkey", F.col("o_custkey").alias("k"))
        return self.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("k", days(F.col("l_shipdate")).alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


#: The same views in SQL.
EV = "ev AS (SELECT user_id AS dataset, event_id AS ord, epoch_us(ts) * 1000 AS ts, event_type AS kind, value FROM events)"
MARKS = EV + ", marks AS (SELECT *, CASE kind WHEN 'signup' THEN 'start' ELSE 'end' END AS name FROM ev WHERE kind IN ('signup', 'purchase'))"
PAIRS = MARKS + """, nx AS (SELECT *, lead(name) OVER w AS nn, lead(ts) OVER w AS nts FROM marks WINDOW w AS (PARTITION BY dataset ORDER BY ts, ord)),
eps AS (SELECT dataset, ts AS start_ts, nts AS end_ts, nn = 'start' AS implicit, row_number() OVER (PARTITION BY dataset ORDER BY ts, nts NULLS LAST) - 1 AS episode FROM nx WHERE name = 'start')"""
BOUNDS = MARKS + """, fr0 AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ts, ord) - 1 AS rw FROM ev WHERE kind IN ('view', 'click', 'error')),
md AS (SELECT c.dataset, n, last_ts, coalesce(bool_or(name = 'start'), false) AS hs, coalesce(bool_or(name = 'end'), false) AS he FROM (SELECT dataset, count(*) AS n, max(ts) AS last_ts FROM fr0 GROUP BY 1) c LEFT JOIN marks m ON m.dataset = c.dataset GROUP BY 1, 2, 3),
wk AS (SELECT *, lead(name) OVER w AS nn, lead(ts) OVER w AS nts FROM marks WINDOW w AS (PARTITION BY dataset ORDER BY ts, ord)),
pr AS (SELECT wk.dataset, wk.ts AS st, wk.ord AS so, n, coalesce(nts, last_ts) AS et, coalesce(nn = 'end', true) AS incl FROM wk JOIN md ON md.dataset = wk.dataset WHERE hs AND he AND name = 'start'),
px AS (SELECT *, (SELECT count(*) FROM fr0 f WHERE f.dataset = pr.dataset AND f.ts < st) AS si, (SELECT count(*) FROM fr0 f WHERE f.dataset = pr.dataset AND f.ts < et) AS pos FROM pr),
pl AS (SELECT px.dataset, st, so, si, CASE WHEN NOT incl THEN pos WHEN pos >= n THEN n WHEN pos = 0 THEN 1 WHEN a.ts - et <= et - b.ts THEN pos + 1 ELSE pos END AS ei FROM px LEFT JOIN fr0 a ON a.dataset = px.dataset AND a.rw = pos LEFT JOIN fr0 b ON b.dataset = px.dataset AND b.rw = pos - 1),
pt AS (SELECT m.dataset, (SELECT count(*) FROM fr0 f WHERE f.dataset = m.dataset AND f.ts < m.ts) AS pos FROM marks m JOIN md ON md.dataset = m.dataset WHERE hs <> he UNION SELECT dataset, 0 FROM md WHERE hs <> he UNION SELECT dataset, n FROM md WHERE hs <> he),
bd AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY st, so) - 1 AS episode, si AS start_row, ei AS end_row, 'paired' AS mode FROM pl WHERE ei > si
 UNION ALL SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY pos) - 1, pos, nx, 'split' FROM (SELECT *, lead(pos) OVER (PARTITION BY dataset ORDER BY pos) AS nx FROM pt) WHERE nx IS NOT NULL
 UNION ALL SELECT dataset, 0, 0, n, 'whole' FROM md WHERE (NOT hs AND NOT he) OR (hs AND he AND dataset NOT IN (SELECT dataset FROM pl WHERE ei > si)))"""
EPISODE_ROWS = BOUNDS + """, er AS (SELECT f.dataset, f.ord, f.ts, f.kind, f.value, f.rw, b.episode FROM fr0 f JOIN bd b ON f.dataset = b.dataset AND f.rw >= b.start_row AND f.rw < b.end_row)"""
SEGMENTS = """seg AS (SELECT o_custkey AS k, row_number() OVER w - 1 AS pos, o_orderkey % 6 AS phase, epoch_us(o_orderdate) / 86400e6 AS start_t,
 coalesce(lead(epoch_us(o_orderdate) / 86400e6) OVER w, epoch_us(o_orderdate) / 86400e6 + 10) AS end_t, (o_orderkey % 100) / 100.0 AS confidence
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
SHIPMENTS = "ship AS (SELECT o_custkey AS k, epoch_us(l_shipdate) / 86400e6 AS ts, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
