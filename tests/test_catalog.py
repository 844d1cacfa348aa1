"""Every registered query against its SQL twin in DuckDB, or at least that it runs; and the entry module's contract."""

import datetime
import decimal
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from parley.operators import headings
from parley.plans import catalog
from parley.plans.frames import TABLES, Frames

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return str(v)
    return tuple(v) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=repr)
    if name in catalog.ORACLES:
        result = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=repr)
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ratio_decides_rows_of_the_fixture(spark):
    f = Frames(spark, SF)
    for told in (headings.recognised_fields, lambda lines, ratio: headings.placement_report(lines, catalog._values(f), ratio)):
        assert told(f.template_lines, ratio=True).exceptAll(told(f.template_lines, ratio=False)).count() > 0


@pytest.mark.parametrize("name", ["j3_word_speaker", "w1_fill_word_speakers", "w2_speaker_runs", "r8_smooth_runs", "r7_split_by_speaker"])
def test_turn_without_length_speaks_nowhere(spark, tmp_path, name):
    """The event of value 0 lies alone in a word of its own: the query and its twin give it to nobody."""
    rows = [(1, "2024-01-02 00:10:00", 7, "purchase", 0.0), (2, "2024-01-02 00:40:00", 7, "view", 3.0), (3, "2024-01-02 05:10:00", 7, "click", 0.0), (4, "2024-01-02 06:00:00", 7, "error", 9.0)]
    told = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    told.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    result = c.execute(catalog.ORACLES[name])
    at = [[d[0] for d in result.description].index(x) for x in columns]
    got = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=repr)
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=repr)
    if name == "j3_word_speaker":
        assert sorted({r[columns.index("speaker")] or "" for r in got}) == ["", "error", "view"]
