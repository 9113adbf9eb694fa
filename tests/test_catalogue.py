"""Every query of the memory engine against its SQL, over the smallest tables."""

import duckdb
import pytest

from annalist.operators import archive
from annalist.plans.all import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    expected = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(expected.columns, expected.fetchall())


def test_graph_queries_tell_nothing_apart_twice(spark):
    for name in ("pattern_relations", "graph_summary"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "distinct" not in plan and "expand" not in plan


def test_neighbours_are_dealt_over_tasks_of_a_fixed_size(spark, duck, monkeypatch):
    monkeypatch.setattr(archive, "TASK_ROWS", 500)
    df = QUERIES["relation_neighborhood"](spark, SF)
    count = duck.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    assert df.rdd.getNumPartitions() == -(-count // 500) > 4
    expected = duck.sql(ORACLE["relation_neighborhood"])
    assert rows(df.columns, map(tuple, df.collect())) == rows(expected.columns, expected.fetchall())
