"""Streaming twins of the event operators; each takes a stream or a batch and is checked against its batch run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from tallyloom.functions import lookups as L
from tallyloom.functions import text as T
from tallyloom.operators import events, prompts
from tallyloom.sources import reports
from tallyloom.sources.store import VersionedTable

#: A stream's entries name their site beside the fields of a watchdog entry.
SITE = ("site_id",)


def parse_lines(lines: DataFrame) -> DataFrame:
    """NDJSON lines (``value``) to entries with ``event_time``; ``ok`` is false where a line is no entry, and its fields are null.

    The rules are those of S4's lines: blank lines and lone brackets are skipped, one
    closing comma is cut, missing fields are zero or empty, a field of another type
    or a line over 10 MiB makes no entry.
    """
    bare = F.regexp_replace(T.trimmed(F.col("value")), r",\z", "")
    short = F.octet_length(T.trimmed(F.col("value"))) <= reports.MAX_LINE_BYTES
    rows = lines.filter(~T.trimmed(F.col("value")).isin("", "[", "]")).select(F.when(short, bare).alias("bare"))
    parsed = reports.with_entry(rows, F.col("bare"), SITE)
    return parsed.select("ok", "e.*").withColumn("event_time", F.timestamp_seconds("timestamp"))


#: Name of the counts that every batch of ``ingest`` reports.
LINES = "watchdog_lines"


def ingest(spark: SparkSession, folder: str) -> DataFrame:
    """T1 over a growing folder of NDJSON files; each batch reports its lines and those that are no entries (``LineCounts``)."""
    parsed = parse_lines(spark.readStream.text(folder))
    return parsed.observe(LINES, F.count("*").alias("lines"), F.count_if(~F.col("ok")).alias("bad"))


class LineCounts(StreamingQueryListener):
    """Keeps ``(lines, bad)`` of every batch of streams made by ``ingest``, by run and batch number.

    Add it with ``spark.streams.addListener``. A batch that runs again after a
    failure replaces its own counts.
    """

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], tuple[int, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(LINES)
        if row is not None and event.progress.numInputRows:
            self.batches[str(event.progress.id), event.progress.batchId] = (row["lines"], row["bad"])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def total(self) -> tuple[int, int]:
        """Lines and bad lines of all batches."""
        return sum(n for n, _ in self.batches.values()), sum(b for _, b in self.batches.values())


def counts(entries: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Entries per site and severity in tumbling windows; rows later than the watermark are dropped."""
    timed = entries.withWatermark("event_time", late)
    grouped = timed.groupBy(F.window("event_time", window).alias("w"), "site_id", L.severity_name(F.col("severity")).alias("severity_name"))
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "site_id", "severity_name", "n")


class _FirstOfKey(StatefulProcessor):
    """Events of a key in event time: kept until the watermark has passed them, then settled in order.

    Of events of one time only that with the least id is kept, so what a key
    holds is bounded by the times that lie within the watermark's delay.
    """

    def __init__(self, late_ms: int, names: list[str], schema: S.StructType):
        self.late_ms, self.names, self.schema = late_ms, names, schema

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint", "event string")
        self.until = handle.getValueState("until", "at bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import json

        import pandas as pd

        for frame in rows:
            for at, wid, event in zip(frame["at"].tolist(), frame["wid"].tolist(), frame["event"].tolist()):
                slot = (int(at),)
                if not self.waiting.containsKey(slot) or json.loads(self.waiting.getValue(slot)[0])[0] > wid:
                    self.waiting.updateValue(slot, (json.dumps([int(wid), event]),))
                    self.handle.registerTimer(int(at))
        return iter([pd.DataFrame({"event": pd.Series([], dtype=str)})])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        import json

        import pandas as pd

        at, first = expiredTimerInfo.getExpiryTimeInMs(), []
        if self.waiting.containsKey((at,)):
            if not self.until.exists() or at > self.until.get()[0]:
                first.append(json.loads(self.waiting.getValue((at,))[0])[1])
                self.until.update((at + self.late_ms,))
                self.handle.registerTimer(at + self.late_ms + 1)
            self.waiting.removeKey((at,))
        elif self.until.exists() and at > self.until.get()[0]:
            self.until.clear()
        return iter([pd.DataFrame({"event": pd.Series(first, dtype=str)})])

    def close(self) -> None:
        pass


def first_of_pattern(entries: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first event of each (site, message pattern), and then none until ``late`` has gone by since it.

    First means in event time, ties by id, in whatever order events arrive: a stream
    settles an event when the watermark has passed it, and later rows are dropped.
    Batch runs pass over each key's different times in order. Streams need the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = entries.withColumn("pattern", T.message_pattern(F.col("message")))
    late_ms = entries.sparkSession.range(1).select(_milliseconds(late)).first()[0]
    keys, columns = ["site_id", "pattern"], keyed.columns
    if not entries.isStreaming:
        one = keyed.groupBy(*keys, "event_time").agg(F.min_by(F.struct(*columns), "wid").alias("e")).select("e.*").select(*columns)
        ordered = one.repartition(*keys).sortWithinPartitions(*keys, "event_time")
        return ordered.mapInPandas(_first_in_order(keys, late_ms), keyed.schema)
    event = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("event")
    timed = keyed.withWatermark("event_time", late).select("event_time", *keys, F.unix_millis("event_time").alias("at"), "wid", event)
    found = timed.groupBy(*keys).transformWithStateInPandas(_FirstOfKey(late_ms, columns, keyed.schema), S.StructType([S.StructField("event", S.StringType())]), "Append", "EventTime")
    return found.select(F.from_json("event", keyed.schema).alias("e")).select("e.*")


def _milliseconds(late: str) -> Column:
    start = F.lit("2000-01-01").cast("timestamp")
    return F.unix_millis(start + F.expr(f"INTERVAL {late}")) - F.unix_millis(start)


def _first_in_order(keys: list[str], late_ms: int):
    """Rows sorted by key and time -> those that come more than ``late_ms`` after the last one kept of their key."""
    def run(frames):
        import pandas as pd

        now, until = None, None
        for frame in frames:
            kept = []
            times = frame["event_time"].astype("datetime64[ns]").astype("int64") // 1_000_000
            for i, (key, at) in enumerate(zip(zip(*(frame[k] for k in keys)), times)):
                if key != now or at > until:
                    now, until = key, at + late_ms
                    kept.append(i)
            yield frame.iloc[kept] if kept else pd.DataFrame(columns=frame.columns).astype(frame.dtypes)

    return run


def failure_bursts(entries: DataFrame, threshold: int = 5, late: str = "1 hour") -> DataFrame:
    """T4: hosts with repeated failed logins in sliding windows."""
    failed = F.lower("message").contains("failed login") | F.lower("message").contains("login failed")
    return events.repeated_failures(entries.withWatermark("event_time", late), failed, threshold, "10 minutes", "1 minute")


def route(analyses: DataFrame, outbox: VersionedTable, checkpoint: str):
    """T5: append every batch's messages to the outbox, in which a part of a report goes to a channel once.

    The outbox itself tells what is there already, so batches that run again add
    nothing, even if the checkpoint was lost and the stream starts over.
    """
    def put(batch: DataFrame, number: int) -> None:
        outbox.append(prompts.outbox(batch).withColumn("part_no", F.col("part_no").cast("int")))

    return analyses.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
