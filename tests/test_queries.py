"""Each query against its SQL on the smallest tables."""

import duckdb
import pytest

from episodica.operators import episodes
from episodica.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(columns, values):
    fit = lambda x: round(x, 5) + 0.0 if isinstance(x, float) else x
    order = sorted(columns)
    return sorted((tuple(fit(v[columns.index(c)]) for c in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = db.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_merged_stats_of_every_dimension(spark, db):
    got = catalog.QUERIES["e9_merged_stats"](spark, DATA).where("stat = 'count' and feature = 'state'").collect()
    want = db.execute("SELECT max(len(embedding)), count(*) FROM embeddings").fetchone()
    assert sorted(r.pos for r in got) == list(range(want[0])) and {r.value for r in got} == {want[1]}


@pytest.mark.parametrize("name", ["c5_manual_trims", "c6_trim_requests", "h6_episode_overview"])
def test_rows_of_episodes_are_found_once(spark, monkeypatch, name):
    found, plain = [], episodes.boundaries
    monkeypatch.setattr(episodes, "boundaries", lambda *a: found.append(1) or plain(*a))
    catalog.QUERIES[name](spark, DATA)
    assert len(found) == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
