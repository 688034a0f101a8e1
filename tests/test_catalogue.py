"""Every registered query of the reference's operators, beside its SQL."""

from __future__ import annotations

import pytest

from compare import connection, rows_of, rows_of_sql
from quillspark.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    names, expected = rows_of_sql(con, catalogue.SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) - {"betweenness_centrality"}))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_queries_without_sql_take_all_ids(spark, sf_dir):
    ids = lambda table, c: {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(c).collect()}
    assert {r.v for r in catalogue.QUERIES["nms_merge"](spark, sf_dir).select("v").collect()} == ids("lineitem", "l_orderkey")
    assert {r.video_id for r in catalogue.QUERIES["biased_timestamps"](spark, sf_dir).select("video_id").collect()} == ids("part", "p_partkey")
    large = sf_dir.replace("sf0.001", "sf0.01")
    n = sum(spark.read.parquet(f"{large}/{t}.parquet").count() for t in ("region", "nation", "supplier"))
    assert catalogue.QUERIES["closeness_centrality"](spark, large).count() == n


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
