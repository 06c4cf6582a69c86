"""Watchdog entries: filters, statistics, message-pattern groups and the digest text.

``entries``: ``report_id, wid, uid, type, message, severity, hostname, location,
timestamp`` (epoch seconds).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.functions import lookups as L
from tallyloom.functions import text as T

NO_ENTRIES = "No watchdog entries found."


def by_severity(entries: DataFrame, low: int, high: int) -> DataFrame:
    """F1."""
    return entries.filter(F.col("severity").between(low, high))


def type_is(*parts: str) -> Column:
    """the type contains any of the parts, whatever the case."""
    return reduce(lambda a, b: a | b, (F.lower("type").contains(p.lower()) for p in parts))


def with_flags(entries: DataFrame) -> DataFrame:
    """F3."""
    return entries.withColumns({"is_critical": F.col("severity").between(0, 3), "is_warning": F.col("severity") == 4})


def stats(entries: DataFrame) -> DataFrame:
    """A1."""
    when = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")
    return entries.groupBy("report_id").agg(
        F.count("*").alias("total"), when(F.min("timestamp")).alias("oldest"), when(F.max("timestamp")).alias("newest")
    )


def severity_counts(entries: DataFrame) -> DataFrame:
    """A2: counts by level name; unknown levels share one."""
    return entries.groupBy("report_id", L.severity_name(F.col("severity")).alias("severity_name")).agg(F.count("*").alias("n"))


def type_counts(entries: DataFrame) -> DataFrame:
    """A3: counts with their rank, ties by type."""
    counts = entries.groupBy("report_id", "type").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("report_id").orderBy(F.desc("n"), "type")))


def report_stats(entries: DataFrame) -> DataFrame:
    """A4: totals with maps by severity and type, from counts per (report, severity, type)."""
    cells = entries.groupBy("report_id", "severity", "type").agg(F.count("*").alias("n"))
    sev = cells.groupBy("report_id", "severity").agg(F.sum("n").alias("n")).groupBy("report_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("by_severity"),
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("severity").between(0, 3), F.col("n")).otherwise(0)).alias("critical_count"),
        F.sum(F.when(F.col("severity") == 4, F.col("n")).otherwise(0)).alias("warning_count"),
    )
    typ = cells.groupBy("report_id", "type").agg(F.sum("n").alias("n")).groupBy("report_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type")
    )
    return sev.join(typ, "report_id")


def pattern_groups(entries: DataFrame) -> DataFrame:
    """A5: count and newest type of each message pattern of a report."""
    newest = F.struct((-F.col("timestamp")).alias("t"), (-F.col("wid")).alias("w"))
    return entries.withColumn("pattern", T.message_pattern(F.col("message"))).groupBy("report_id", "pattern").agg(
        F.count("*").alias("n"), F.min_by("type", newest).alias("type")
    )


def not_found_summary(entries: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent 404 patterns of a report with its total and the number of further patterns."""
    groups = pattern_groups(entries.filter(type_is("page not found")))
    whole = W.partitionBy("report_id")
    ranked = groups.withColumns({
        "rank": F.row_number().over(whole.orderBy(F.desc("n"), "pattern")), "total": F.sum("n").over(whole),
        "further": F.greatest(F.count("*").over(whole) - top, F.lit(0)),
    })
    return ranked.filter(F.col("rank") <= top).select("report_id", "rank", "pattern", "n", "total", "further")


def first_n(entries: DataFrame, low: int, high: int, n: int) -> DataFrame:
    """W8 in O1 order: the newest ``n`` entries of a severity range, with how many there are beyond."""
    whole = W.partitionBy("report_id")
    newest = whole.orderBy(F.desc("timestamp"), F.desc("wid"))
    ranked = by_severity(entries, low, high).withColumn("rank", F.row_number().over(newest)).withColumn("more", F.greatest(F.count("*").over(whole) - n, F.lit(0)))
    return ranked.filter(F.col("rank") <= n)


def daily_export(entries: DataFrame, day: Column, min_severity: Column | int = 3, limit: Column | int = 100, only_type: str | None = None) -> DataFrame:
    """Of one day's entries up to a severity, the newest ids per site."""
    start = F.unix_timestamp(day.cast("timestamp"))
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    kept = entries.filter((F.col("severity") <= as_col(min_severity)) & (F.col("timestamp") >= start) & (F.col("timestamp") <= start + 86_399))
    if only_type is not None:
        kept = kept.filter(F.col("type") == only_type)
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("site_id").orderBy(F.desc("wid")))).filter(F.col("rank") <= as_col(limit))


def kpis(entries: DataFrame, top: int = 3) -> DataFrame:
    """The metrics that prompts ask for, by keyword and type rules of our own."""
    text = F.lower(F.concat_ws(" ", "type", "message"))
    of = lambda pattern: F.count_if(text.rlike(pattern)).alias
    percent = F.regexp_extract("message", r"(\d+)%", 1)
    base = entries.groupBy("report_id").agg(
        of("login (attempt )?failed|failed login")("failed_logins"), of("access denied")("access_denied"), of("page not found")("not_found_count"),
        F.count_if((F.lower("type") == "php") & (F.col("severity") <= 3)).alias("php_errors"), of("pdoexception|database|mysql")("db_errors"),
        F.count_if(F.col("severity") <= 3).alias("error_count"), F.max(F.when(percent != "", percent.cast("int"))).alias("disk_usage_max"),
        F.max_by("message", F.when(F.lower("type") == "cron", F.struct("timestamp", "wid"))).alias("last_cron"),
    )
    tops = type_counts(entries.filter("severity <= 3")).filter(F.col("rank") <= top).groupBy("report_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "type"))), lambda s: s["type"]).alias("l")
    )
    return base.join(tops.select("report_id", F.array_join("l", ",").alias("top_error_types")), "report_id", "left")


def repeated_failures(events: DataFrame, failed: Column, threshold: int = 5, window: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Hosts with at least ``threshold`` failures in a window; works on streams too."""
    span = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    counted = events.filter(failed).groupBy(span.alias("w"), "hostname").agg(F.count("*").alias("failures"))
    return counted.filter(F.col("failures") >= threshold).select(F.col("w.start").alias("window_start"), "hostname", "failures")


def _section(title: str, rows: DataFrame, line: Column, order: list[str], head: Column | None = None, tail: Column | None = None) -> DataFrame:
    """One digest section per report as text."""
    listed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    body = F.array_join(F.transform(listed, lambda s: s["line"]), "")
    parts = [F.lit(f"## {title}\n"), *([head] if head is not None else []), body, *([tail] if tail is not None else []), F.lit("\n")]
    return rows.groupBy("report_id").agg(F.concat(*parts).alias("text"))


def digest(reports: DataFrame, entries: DataFrame) -> DataFrame:
    """``(report_id, content)`` for every report; one without entries gets a fixed text.

    Every section is an aggregate of its own keyed by report, and only small
    strings meet in the final join.
    """
    sev, num = L.severity_name(F.col("severity")), lambda c: F.col(c).cast("string")
    at = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss")
    detail = F.concat(F.lit("["), at, F.lit("] "), F.upper(sev), F.lit(" | "), "type", F.lit(" | "), "hostname", F.lit(" | "), "location", F.lit("\n  Message: "), "message", F.lit("\n"))
    order = F.create_map(*[F.lit(x) for i, n in enumerate(L.SEVERITIES) for x in (n, i)])
    named = severity_counts(entries).filter("severity_name <> 'unknown'").withColumn("o", order[F.col("severity_name")])
    grouped = lambda rows: pattern_groups(rows).withColumn("o", -F.col("n"))
    more = F.max("more")
    warned = grouped(by_severity(entries, 4, 4))
    access = grouped(entries.filter(type_is("access denied", "access")))
    parts = [
        stats(entries).select("report_id", F.concat(F.lit("## Summary Statistics\nTotal entries: "), num("total"), F.lit("\nTime range: "), "oldest", F.lit(" to "), "newest", F.lit("\n\n")).alias("text")),
        _section("Severity Breakdown", named, F.concat(F.lit("- "), F.upper("severity_name"), F.lit(": "), num("n"), F.lit("\n")), ["o"]),
        _section("Entry Types", type_counts(entries), F.concat(F.lit("- "), "type", F.lit(": "), num("n"), F.lit("\n")), ["rank"]),
        _section("Critical/Error Entries (Full Detail)", first_n(entries, 0, 3, 50), detail, ["rank"],
                 tail=F.when(more > 0, F.concat(F.lit("\n... and "), more.cast("string"), F.lit(" more critical/error entries\n"))).otherwise("")),
        _section("Warning Entries", warned, F.concat(F.lit("- ["), num("n"), F.lit("x] "), "type", F.lit(": "), "pattern", F.lit("\n")), ["o", "pattern"]),
        _section("Access/Permission Events", access, F.concat(F.lit("- ["), num("n"), F.lit("x] "), "pattern", F.lit("\n")), ["o", "pattern"]),
        _section("Page Not Found (404) Summary", not_found_summary(entries), F.concat(F.lit("- ["), num("n"), F.lit("x] "), "pattern", F.lit("\n")), ["rank"],
                 head=F.concat(F.lit("Total 404 errors: "), F.max("total").cast("string"), F.lit("\n")),
                 tail=F.when(F.max("further") > 0, F.concat(F.lit("... and "), F.max("further").cast("string"), F.lit(" more unique 404 patterns\n"))).otherwise("")),
        _section("Recent Notice/Info Entries (Sample)", first_n(entries, 5, 6, 20),
                 F.concat(F.lit("- ["), sev, F.lit("] "), "type", F.lit(": "), T.truncate(F.col("message"), 100), F.lit("\n")), ["rank"],
                 tail=F.when(more > 0, F.concat(F.lit("... and "), more.cast("string"), F.lit(" more notice/info entries\n"))).otherwise("")),
    ]
    texts = reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)))
    whole = texts.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    body = F.concat(F.lit("=== DRUPAL WATCHDOG LOG ANALYSIS ===\n\n"), F.array_join(F.transform("p", lambda s: s["text"]), ""))
    return reports.select("report_id").join(whole.select("report_id", body.alias("content")), "report_id", "left").fillna(NO_ENTRIES, ["content"])


def route_empty(reports: DataFrame, entries: DataFrame) -> DataFrame:
    """``reports`` with their number of entries and ``route``: ``analyse``, or ``inform`` for none."""
    counts = entries.groupBy("report_id").agg(F.count("*").alias("n_entries"))
    joined = reports.join(counts, "report_id", "left").fillna(0, ["n_entries"])
    return joined.withColumn("route", F.when(F.col("n_entries") == 0, "inform").otherwise("analyse"))
