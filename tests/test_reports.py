from pyspark.sql import functions as F

from tallyloom import registry
from tallyloom.plans import inventory


def test_written_reports_do_not_grow_with_the_day(spark):
    made = spark.range(12_000).select(F.lit("2024-01-01").alias("report_id"), F.col("id").alias("wid"))
    reports = inventory._per_report(made, F.col("wid").cast("string"), lambda a: F.array_join(a, ","))
    held = [r.content.split(",") for r in reports.collect()]
    assert sorted(int(x) for h in held for x in h) == list(range(12_000))
    assert max(map(len, held)) <= inventory.REPORT_ENTRIES
    assert {r.report_id for r in reports.select(inventory._day()).collect()} == {"2024-01-01"}


def test_blocks_of_a_day_are_read_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inventory, "REPORT_ENTRIES", 7)
    kinds = F.element_at(F.array(*map(F.lit, ("error", "purchase", "signup", "view", "click"))), (F.col("id") % 5 + 1).cast("int"))
    events = spark.range(100).select(F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id"), kinds.alias("event_type"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 1800).alias("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    want = sorted((r.report_id, r.wid, r.timestamp, r.message) for r in inventory.entries(spark, str(tmp_path)).collect())
    for name in ("json_entries", "line_entries", "table_entries", "keyed_entries"):
        assert sorted((r.report_id, r.wid, r.timestamp, r.message) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_secrets_anywhere_in_a_text_are_redacted(spark, tmp_path):
    secrets = [
        "sk-ant-" + "a1" * 8, "sk-" + "b2" * 20, "123456789:" + "c3" * 18, "Bearer d4.e5", "Authorization: f6", "API-KEY=g7", "x-api-key: h8",
    ]
    before = "plain words " * 50
    docs = [(i, f"{before}{s} and more") for i, s in enumerate(secrets)] + [(9, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.redacted for r in registry.QUERIES["redacted_texts"](spark, str(tmp_path)).collect()}
    assert got == {i: f"[REDACTED] {before}[REDACTED] and more [REDACTED]" for i in range(len(secrets))} | {9: "[REDACTED]  [REDACTED]"}
