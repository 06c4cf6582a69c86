import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import history as H
from tallyloom.sources.store import Conflict, SummaryStore, VersionedTable, natural_key


def analyses(spark, days, n=6, cost=0.25):
    start = datetime.datetime(2026, 1, 1, 6)
    rows = [
        (start + datetime.timedelta(days=d, minutes=i), None if i % 2 else "ocms", f"s{i % 3}", ("Good", "Bad")[i % 2], f"text {d} {i}", cost * (i % 3), i if i % 4 else None, 2 * i)
        for d in days for i in range(n)
    ]
    return spark.createDataFrame(rows, "timestamp timestamp, log_source_type string, site_name string, system_status string, summary string, cost_usd double, input_tokens bigint, output_tokens bigint")


def listed(df):
    return sorted(map(str, df.collect()))


def test_appending_again_changes_nothing_and_versions_stay_readable(spark, tmp_path):
    store = SummaryStore(spark, str(tmp_path)).create()
    assert store.append(analyses(spark, range(3))) == 1
    before = listed(store.read())
    assert len(before) == 18
    assert store.append(analyses(spark, range(3))) == 1 and listed(store.read()) == before
    assert store.append(analyses(spark, range(2, 5))) == 2
    assert store.read().count() == 30 and listed(store.read(1)) == before
    assert [r.rows for r in store.table.history().collect()] == [0, 18, 30]
    SummaryStore(spark, str(tmp_path)).create()  # a table that is there stays
    assert store.read().count() == 30
    same = spark.range(1).select(F.lit(None).cast("string").alias("a"), F.lit("").alias("b"), F.lit("x").alias("c"))
    keys = [natural_key("a", "c"), natural_key("b", "c"), natural_key("c", "a"), natural_key("c", "b")]
    assert len(set(same.select(*[k.alias(str(i)) for i, k in enumerate(keys)]).first())) == 4


def test_a_change_that_breaks_off_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = SummaryStore(spark, str(tmp_path)).create()
    store.append(analyses(spark, range(3)))
    before = listed(store.read())

    def fail(*_):
        raise OSError("lost")

    now = F.lit("2026-01-03 06:02:00").cast("timestamp")
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", fail)
        for change in (lambda: store.append(analyses(spark, range(9))), lambda: store.retain(now, 1)):
            with pytest.raises(OSError):
                change()
            assert listed(store.read()) == before and store.table.version() == 1
    assert store.retain(now, 1) == 8 and store.read().count() == 10
    assert listed(store.read(1)) == before


def test_statistics_that_an_append_did_not_reach_are_made_by_the_next(spark, tmp_path, monkeypatch):
    store = SummaryStore(spark, str(tmp_path)).create()
    with monkeypatch.context() as m:
        m.setattr(SummaryStore, "_sum_up", lambda *_: None)
        store.append(analyses(spark, range(2)))
    store.append(analyses(spark, range(2)))
    assert store.daily_costs().agg(F.sum("n")).first()[0] == 12


def test_of_two_writers_of_a_version_the_later_tries_again(spark, tmp_path, monkeypatch):
    one, two = (VersionedTable(spark, str(tmp_path), "k string, v bigint, p string", ["k"], ["p"]) for _ in range(2))
    one.create()
    row = lambda k, p: spark.createDataFrame([(k, 1, p)], "k string, v bigint, p string")
    real, seen = two.version, [0]
    one.append(row("a", None))
    monkeypatch.setattr(two, "version", lambda: seen.pop() if seen else real())  # once it has seen version 0 only
    assert two.append(row("b", "p")) == 2
    assert sorted(r.k for r in one.read().collect()) == ["a", "b"] and [r.k for r in one.read(1).collect()] == ["a"]
    assert two.append(row("a", None)) == 2  # null partitions compare too
    monkeypatch.setattr(two, "version", lambda: 0)
    with pytest.raises(Conflict):
        two.append(row("c", "p"))


def test_merged_statistics_equal_a_full_scan_after_retention(spark, tmp_path):
    store = SummaryStore(spark, str(tmp_path)).create()
    for days in (range(4), range(3, 8)):
        store.append(analyses(spark, days))
    now = F.lit("2026-01-08 06:03:00").cast("timestamp")
    assert store.retain(now, 5) == 15
    rows = store.read()
    rounded = ("cost", "avg_cost", "avg_input", "avg_output")
    tidy = lambda df, *cs: sorted(map(str, df.select(*[F.round(c, 9).alias(c) if c in rounded else F.col(c) for c in cs]).collect()))
    scopes = ("log_source_type", "site_name", "system_status", "n", "cost", "scope")
    assert tidy(store.statistics(), *scopes) == tidy(H.statistics(rows), *scopes)
    costs = ("day", "cost", "n", "avg_cost", "avg_input", "avg_output")
    assert tidy(store.daily_costs(3), *costs) == tidy(H.daily_costs(rows, 3), *costs)
    assert store.daily_costs(99).agg(F.sum("n")).first()[0] == rows.count() == 33


def test_history_of_a_busy_site_is_dealt_out_by_span(spark):
    start = datetime.datetime(2026, 1, 1)
    stored = spark.createDataFrame([(f"s{i}", start + datetime.timedelta(hours=5 * i), "ocms", "hot" if i % 3 else "cold") for i in range(400)], "summary_id string, timestamp timestamp, log_source_type string, site_name string")
    reports = spark.createDataFrame([(f"r{d}", "ocms", "hot", start + datetime.timedelta(days=d)) for d in (0, 3, 7, 14, 30, 60)], "report_id string, source_type string, site_id string, run_time timestamp")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false")):
            spark.conf.set(k, v)
        got = H.attach_history(reports, stored)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = got.collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert "hashpartitioning(log_source_type" in plan and "span" in plan.split("hashpartitioning(log_source_type", 1)[1].split(")")[0]
    times = {r.summary_id: (r.timestamp, r.site_name) for r in stored.collect()}
    want = {(r.report_id, s) for r in reports.collect() for s, (at, site) in times.items() if site == "hot" and r.run_time - datetime.timedelta(days=7) <= at <= r.run_time}
    assert {(r.report_id, r.summary_id) for r in rows} == want and len(rows) == len(want)
