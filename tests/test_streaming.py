import json

from pyspark.sql import functions as F

from tallyloom.sources.store import outbox_table
from tallyloom.streaming import jobs


def entries(n=40):
    return [
        {"wid": i, "uid": 1, "type": "user", "message": f"Failed login {i} from x" if i % 2 else "page view", "severity": i % 5 + 3, "hostname": f"h{i % 3}", "site_id": "s", "timestamp": 1_767_225_600 + 20 * i}
        for i in range(n)
    ]


def drained(spark, frame, name):
    stream = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    return spark.table(name)


def folder_of(tmp_path, rows):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("[\n" + "\n".join(json.dumps(r) + "," for r in rows) + "\nbroken\n]\n")
    return str(folder)


def test_ingest_and_counts_equal_the_batch(spark, tmp_path):
    late = {**entries(1)[0], "wid": 999, "timestamp": 1_767_225_600 + 5 * 86400}
    folder = folder_of(tmp_path, [*entries(), late])
    batch = jobs.parse_lines(spark.read.text(folder))
    assert (batch.filter("ok").count(), batch.filter("not ok").count()) == (41, 1)
    streamed = drained(spark, jobs.counts(jobs.ingest(spark, folder).filter("ok")), "t2")
    closed = jobs.counts(batch.filter("ok")).filter("window_start < timestamp'2026-01-05'")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, closed.collect()))
    assert closed.agg(F.sum("n")).first()[0] == 40


def test_lines_are_typed_and_counted_as_those_of_reports(spark, tmp_path):
    import time

    from tallyloom.sources import reports

    lines = ['{"wid": 1, "severity": "bad"}', '{"wid": "x"}', '{"wid": 2}', '{"wid": 3, "message": "m"},', "[1]", "{broken", "", "[", "]"]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(lines))
    counts = jobs.LineCounts()
    spark.streams.addListener(counts)
    try:
        got = sorted(map(tuple, drained(spark, jobs.ingest(spark, str(folder)).filter("ok").select("wid", "severity", "message", "site_id", "timestamp"), "t1").collect()))
        until = time.time() + 30
        while not counts.batches and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counts)
    assert got == [(2, 0, "", "", 0), (3, 0, "m", "", 0)]
    whole = spark.createDataFrame([("r", "\n".join(lines))], "report_id string, content string")
    assert {r.wid for r in reports.parse_watchdog_json(whole)[0].collect()} == {2, 3}
    assert counts.total() == (6, 4)


def test_bursts_equal_the_batch(spark, tmp_path):
    folder = folder_of(tmp_path, [*entries(), {**entries(2)[1], "timestamp": 1_767_225_600 + 5 * 86400}])
    batch = jobs.failure_bursts(jobs.parse_lines(spark.read.text(folder)).filter("ok"), 3)
    streamed = drained(spark, jobs.failure_bursts(jobs.ingest(spark, folder).filter("ok"), 3), "t4")
    assert streamed.count() > 0
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))


def test_first_of_pattern_in_event_time_whatever_the_order_of_arrival(spark, tmp_path, monkeypatch):
    base = 1_767_225_600
    at = lambda wid, seconds, message="page 7 view", site="s": {**entries(1)[0], "wid": wid, "timestamp": base + seconds, "message": message, "site_id": site}
    # The window of 4 (from 100 s on) holds 1 and 2 and leaves 3, though 1 arrived first; equal times go to the smaller id.
    first = [at(1, 1000), at(2, 3600), at(3, 4000), at(4, 100), at(9, 50, "other"), at(8, 50, "other"), at(10, 60, "other", "t")]
    later = [at(5, 3900), at(6, 7601), at(7, 20_000), at(11, 40, "other")]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate((first, later, [at(99, 9_000_000, "end"), at(12, 30, "other")])):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        import os

        os.utime(folder / f"{i}.json", (base + i, base + i))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder))
        found = jobs.first_of_pattern(jobs.parse_lines(lines).filter("ok"))
        streamed = [r.asDict() for r in drained(spark, found, "t3").collect()]
    finally:
        spark.conf.unset(key)
    batch = jobs.first_of_pattern(jobs.parse_lines(spark.read.text(str(folder))).filter("ok"))
    assert batch.columns == found.columns
    rows = sorted((r.asDict() for r in batch.collect()), key=lambda r: r["wid"])
    assert [r["wid"] for r in rows] == [4, 5, 6, 7, 10, 12, 99]
    # 12 came after the watermark had passed it, so 11 stays, and 99 waits for its own; else both runs agree.
    assert sorted(r["wid"] for r in streamed) == [4, 5, 6, 7, 10, 11]
    same = {r["wid"]: r for r in rows}
    assert all(r == same[r["wid"]] for r in streamed if r["wid"] != 11)


def test_an_outbox_takes_each_part_once_even_if_the_checkpoint_is_lost(spark, tmp_path):
    source = tmp_path / "answers"
    source.mkdir()
    say = lambda i, status: json.dumps({"report_id": i, "system_status": status, "body": "text"})
    (source / "a.json").write_text(say("r", "Bad") + "\n" + say("q", "Good"))
    outbox = outbox_table(spark, f"{tmp_path}/out").create()

    def run(checkpoint):
        stream = spark.readStream.schema("report_id string, system_status string, body string").json(str(source))
        jobs.route(stream, outbox, f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.report_id, r.channel, r.part_no, r.text) for r in outbox.read().collect())

    first = run("one")
    assert first == [("q", "archive", 0, "text"), ("r", "alerts", 0, "text"), ("r", "archive", 0, "text")]
    (source / "b.json").write_text(say("s", "Good"))
    again = run("two")  # a new checkpoint: both files come in its batch 0
    assert again == sorted([*first, ("s", "archive", 0, "text")])
    assert run("two") == again
