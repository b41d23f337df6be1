import os

import pytest

from meshwork.jobs import queries as network
from meshwork.jobs import study
from meshwork.streaming import arrivals

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    import math

    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "as_tuple"):
        return float(value)
    return round(float(value), 7) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(network.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = network.queries()[name](spark, SMALL)
    want = duck.execute(network.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(network.queries().keys() - network.oracle_sql().keys()))
def test_other_queries_run(spark, name):
    assert network.queries()[name](spark, SMALL).count() > 0


def test_entry_without_the_other_folder(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_study_resumes(spark, tmp_path):
    folder = f"file://{tmp_path}/placed"
    planned = study.plan(spark, "test", [6, 8], ["0.10", "0.15"], 2, arm_length=2)
    assert planned.count() == planned.select("seed").distinct().count() == 8
    study.generate(planned.where("index = 0"), folder, 2)
    left = study.missing(planned, spark.read.parquet(folder))
    assert left.count() == 4
    study.generate(left, folder, 2)
    assert study.missing(planned, spark.read.parquet(folder)).count() == 0


def test_stream_of_bonds(spark, tmp_path):
    rows = [(1, 0, 0, 4, 0, 1), (1, 1, 1, 5, 0, 1), (1, 2, 2, 8, 0, 2)]
    folder = os.fspath(tmp_path / "bonds")
    for k, row in enumerate(rows):
        spark.createDataFrame([row], arrivals.BONDS).write.mode("append").parquet(folder)
    stream = arrivals.running_pairs(arrivals.bond_stream(spark, folder, 1)).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", os.fspath(tmp_path / "at")).start()
    stream.awaitTermination(120)
    got = {(r.molecule_a, r.molecule_b): r.multiplicity for r in spark.sql("SELECT * FROM running").collect()}
    assert got == {(0, 1): 2, (0, 2): 1}
