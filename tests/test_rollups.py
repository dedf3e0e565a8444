"""The rollup queries against their SQL, and the file sources."""

import duckdb
import pytest

from marlstone.plans import queries, rollups
from marlstone.sources import files

SMALL = "/root/testdata/sf0.001"
NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ == rollups.__name__]
TABLES = ("documents", "events", "conversations", "part", "customer", "orders", "lineitem")


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    sql = con.sql(queries.ORACLE[name])
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(sql.columns)
    rows = sorted(map(str, df.select(*sql.columns).toPandas().itertuples(index=False, name=None)))
    assert rows == sorted(map(str, sql.df().itertuples(index=False, name=None)))
    assert rows


def test_folder_scan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.TXT").write_bytes(b"ab\xff")
    (tmp_path / "b.unknown").write_text("x")
    (tmp_path / "empty.txt").write_text("")  # Spark lists no empty files
    rows = {r.name: r for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert (rows["a.TXT"].mime_type, rows["a.TXT"].size_bytes) == ("text/plain", 3)
    assert rows["b.unknown"].mime_type is None
    assert len(rows) == 2


def test_observations(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([("1", "t", "k"), ("2", "u", "k")], "event_id STRING, tenant STRING, kind STRING")
    files.write_observations(df, path)
    (tmp_path / "log" / "bad.txt").write_text("{not json\n\n")
    assert [r.event_id for r in files.read_observations(spark, path, tenant="u").collect()] == ["2"]
    assert files.count_observations(spark, path) == 3
