"""Stored analyses: filters, statistics, cost reports, recent history and retention.

``summaries``: ``summary_id, timestamp, log_source_type, site_name,
system_status, summary, critical_issues, warnings, recommendations, metrics,
input_tokens, output_tokens, cost_usd``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def recent(summaries: DataFrame, now: Column, days: int) -> DataFrame:
    """F7."""
    return summaries.filter(F.col("timestamp") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def of_source(summaries: DataFrame, source: str | None, site: str = "") -> DataFrame:
    """F8: source and site must both match; no source, no filter."""
    if not source:
        return summaries
    return summaries.filter((F.col("log_source_type") == source) & (F.col("site_name") == site))


def statistics(summaries: DataFrame) -> DataFrame:
    """A10 in every scope at once: overall, by source and site, and each by status."""
    grouped = summaries.groupingSets(
        [[], ["system_status"], ["log_source_type", "site_name"], ["log_source_type", "site_name", "system_status"]],
        "log_source_type", "site_name", "system_status",
    )
    return grouped.agg(F.count("*").alias("n"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"), F.grouping_id().alias("scope"))


def daily_costs(summaries: DataFrame, days: int = 30) -> DataFrame:
    """Cost of the latest days that have any analysis."""
    per_day = summaries.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.sum("cost_usd").alias("cost"), F.count("*").alias("n"),
        F.avg(F.when(F.col("cost_usd") > 0, F.col("cost_usd"))).alias("avg_cost"),
        F.avg("input_tokens").alias("avg_input"), F.avg("output_tokens").alias("avg_output"),
    )
    return per_day.orderBy(F.desc("day")).limit(days)


def finding_counts(summaries: DataFrame) -> DataFrame:
    """A12."""
    return summaries.withColumns({f"n_{c}": F.size(F.coalesce(c, F.array())) for c in ("critical_issues", "warnings", "recommendations")})


def numbered(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """1 .. n, newest first."""
    return summaries.withColumn("no", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("timestamp"), "summary_id")))


def latest(summaries: DataFrame, n: int) -> DataFrame:
    """O2."""
    return summaries.orderBy(F.desc("timestamp"), "summary_id").limit(n)


def attach_history(reports: DataFrame, summaries: DataFrame, days: int = 7) -> DataFrame:
    """Each report with the summaries of its source and site in the days before its run, numbered.

    Time is cut into spans of ``days``, and a report meets the two spans that its
    days touch, so the join is on source, site and span: summaries of one busy site
    are dealt out by span, and none meets a report of another time.
    """
    width = int(days) * 86400
    span = lambda at: F.floor(F.unix_timestamp(at) / width)
    asked = reports.withColumn("span", F.explode(F.array(span(F.col("run_time")) - 1, span(F.col("run_time"))))).alias("r")
    stored = summaries.withColumn("span", span(F.col("timestamp"))).alias("s")
    same = (
        (F.col("r.source_type") == F.col("s.log_source_type")) & (F.col("r.site_id") == F.col("s.site_name")) & (F.col("r.span") == F.col("s.span"))
        & (F.col("s.timestamp") >= F.col("r.run_time") - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("s.timestamp") <= F.col("r.run_time"))
    )
    joined = asked.join(stored, same).select("r.report_id", *[F.col(f"s.`{c}`") for c in summaries.columns])
    return numbered(joined, ["report_id"])


def history_block(reports: DataFrame, summaries: DataFrame, days: int = 7) -> DataFrame:
    """``(report_id, history)``; empty for reports without recent summaries."""
    rows = finding_counts(attach_history(reports, summaries, days))
    count = lambda c, label: F.when(F.col(c) > 0, F.concat(F.lit(f"   {label}: "), F.col(c).cast("string"), F.lit("\n"))).otherwise("")
    item = F.concat(
        F.col("no").cast("string"), F.lit(". "), F.date_format("timestamp", "yyyy-MM-dd HH:mm"), F.lit(" - Status: "), "system_status",
        F.lit("\n   Summary: "), "summary", F.lit("\n"), count("n_critical_issues", "Critical Issues"), count("n_warnings", "Warnings"), F.lit("\n"),
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", item.alias("t")))), lambda x: x["t"]), "")
    blocks = rows.groupBy("report_id").agg(F.concat(F.lit("Previous "), F.count("*").cast("string"), F.lit(" analysis summaries:\n\n"), listed).alias("history"))
    return reports.select("report_id").join(blocks, "report_id", "left").fillna("", ["history"])


def expired(summaries: DataFrame, now: Column, days: int = 90) -> Column:
    """What retention deletes."""
    return F.col("timestamp") < now - F.expr(f"INTERVAL {int(days)} DAYS")
