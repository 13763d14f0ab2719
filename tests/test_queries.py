"""Every query with SQL gives what DuckDB gives for it, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def plain(value):
    return round(float(value), 6) if not isinstance(value, (str, bool, type(None))) else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", ["evidence_sessions", "session_recall", "zip_sessions"])
def test_no_cell_grows_with_the_table(spark, tmp_path, monkeypatch, name):
    """Lists are collected of sessions or of bounded blocks: no plan collects more than 60 items into a row."""
    from pyspark.sql import functions as F

    for t, key in (("events", "event_id"), ("conversations", "conv_id")):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        step = rows.agg(F.max(key)).first()[0] + 1
        wide = rows.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumn(key, (F.col(key) + F.col("copy") * step).cast(rows.schema[key].dataType)).drop("copy")
        wide = wide.withColumn("user_id", F.lit(1).cast(rows.schema["user_id"].dataType)) if t == "events" else wide
        wide.write.parquet(f"{tmp_path}/{t}.parquet")
    real = {n: getattr(F, n) for n in ("collect_list", "collect_set")}
    for n in real:
        monkeypatch.setattr(F, n, lambda c, n=n: F.when(F.size(real[n](c)) > 60, F.raise_error(F.lit("more than 60 items in a row"))).otherwise(real[n](c)))
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    monkeypatch.undo()
    with duckdb.connect() as c:
        for t in ("events", "conversations"):
            c.sql(f"create view {t} as from '{tmp_path}/{t}.parquet/*.parquet'")
        want = c.sql(entry.oracle_sql()[name])
        columns = sorted(want.columns)
        at = [want.columns.index(x) for x in columns]
        assert sorted(([plain(r[x]) for x in columns] for r in got), key=str) == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=str)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
