"""Every registered query of the report operators against its SQL, on the smallest tables."""

import datetime
import hashlib
import os

import duckdb
import pytest

from tallyloom import registry

TABLES = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 7)
    return value.replace(tzinfo=None) if getattr(value, "tzinfo", None) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sql, name):
    found = registry.QUERIES[name](spark, TABLES)
    asked = sql.sql(registry.ORACLE_SQL[name])
    names = sorted(found.columns)
    assert names == sorted(asked.columns)
    places = [asked.columns.index(c) for c in names]
    left = [tuple(map(plain, row)) for row in found.select(*names).collect()]
    right = [tuple(plain(row[i]) for i in places) for row in asked.fetchall()]
    assert sorted(left, key=repr) == sorted(right, key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, TABLES).count() > 0


def made_events(spark, folder, ids) -> str:
    rows = [(i, datetime.datetime(2024, 1, 1, 2, 0, i % 60), i % 7, "purchase" if i % 2 else "view") for i in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_a_digest_holds_its_whole_day(spark, tmp_path):
    made = registry.QUERIES["digest_sections"](spark, made_events(spark, tmp_path, [12_000, 1, 5_001, 3, 4_998]))
    want = {"access denied": [1, 3, 5_001], "page not found": [4_998, 12_000]}
    text = lambda name, i: f"{'purchase' if i % 2 else 'view'} by user {i % 7} at /u/{i % 7}"
    assert sorted((r.report_id, r.section_no, r.name, r.n_lines, r.digest) for r in made.collect()) == [
        ("2024-01-01", no, name, len(ids), hashlib.md5("\n".join(text(name, i) for i in ids).encode()).hexdigest()) for no, (name, ids) in enumerate(want.items())
    ]
