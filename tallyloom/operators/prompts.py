"""Exclusions, prompt assembly, notification bodies, message splitting and the outbox."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.functions import lookups as L
from tallyloom.functions import text as T

#: Patterns of one scope that are used.
MOST_PATTERNS = 50
#: Bytes of a message part.
PART_BYTES = 4096
#: Bytes of patterns that are shipped to all tasks at most; more are joined by scope.
SHIPPED_BYTES = 32 << 20
# Our own wording: instructions by source, format reminder and closing request.
TEMPLATES = {
    "logwatch": "You review the daily digest of a Linux host. Report failures, security events and resource shortages.",
    "drupal_watchdog": "You review the event log of a web content system. Report errors, access problems and attacks.",
    "ocms": "You review the application logs of a content site. Report errors and unusual requests.",
}
REMINDER = "Answer with one JSON object: systemStatus, summary, criticalIssues, warnings, recommendations, metrics."
REQUEST = "Analyse the log above and answer in the stated format."


def resolve_exclusions(reports: DataFrame, exclusions: DataFrame) -> DataFrame:
    """``(report_id, place, scope, pattern)``: global patterns, then those of the source, then those of the site.

    ``exclusions``: ``(scope, site_id, pos, pattern)`` with scope global, logwatch,
    drupal, ocms or site. A scope gives its first 50 patterns, cleaned by X12.
    """
    ranked = exclusions.withColumn("r", F.row_number().over(W.partitionBy("scope", "site_id").orderBy("pos"))).filter(F.col("r") <= MOST_PATTERNS)
    cleaned = ranked.select("scope", "site_id", "r", T.clean_pattern(F.col("pattern")).alias("pattern")).filter("pattern <> ''")
    own = F.when(F.col("source_type") == "drupal_watchdog", "drupal").otherwise(F.col("source_type"))
    asked = reports.select("report_id", "site_id", F.explode(F.array(
        F.struct(F.lit(0).alias("place"), F.lit("global").alias("want")), F.struct(F.lit(1).alias("place"), own.alias("want")),
        F.struct(F.lit(2).alias("place"), F.when(own == "drupal", "site").alias("want")),
    )).alias("a")).select("report_id", "site_id", "a.*").filter("want is not null")
    same = (F.col("want") == F.col("scope")) & ((F.col("want") != "site") | (F.col("a.site_id") == F.col("e.site_id")))
    joined = asked.alias("a").join(cleaned.alias("e"), same)
    return joined.select("report_id", (F.col("place") * 1000 + F.col("r")).alias("place"), "scope", "pattern")


def apply_exclusions(findings: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """Findings without those that contain a pattern of their report, whatever the case.

    The join is on the report, so each finding meets its own few patterns.
    """
    listed = patterns.groupBy("report_id").agg(F.collect_set(F.lower("pattern")).alias("_patterns"))
    joined = findings.join(listed, "report_id", "left")
    hit = F.exists(F.coalesce("_patterns", F.array().cast("array<string>")), lambda p: F.lower(text_col).contains(p))
    return joined.filter(~F.coalesce(hit, F.lit(False))).select(*findings.columns)


def scopes_of(source_type: Column, site_id: Column) -> Column:
    """Names of the pattern lists that hold for a report: the global one, that of its source, and that of a CMS site."""
    own = F.when(source_type == "drupal_watchdog", "drupal").otherwise(source_type)
    return F.filter(F.array(F.lit("global"), own, F.when(own == "drupal", F.concat(F.lit("site/"), site_id))), lambda s: s.isNotNull())


def scoped_patterns(exclusions: DataFrame) -> DataFrame:
    """``(name, pattern)`` of ``(scope, site_id, pos, pattern)``: the first 50 of each list, cleaned by X12, in lower case."""
    ranked = exclusions.withColumn("r", F.row_number().over(W.partitionBy("scope", "site_id").orderBy("pos"))).filter(F.col("r") <= MOST_PATTERNS)
    name = F.when(F.col("scope") == "site", F.concat(F.lit("site/"), "site_id")).otherwise(F.col("scope"))
    return ranked.select(name.alias("name"), F.lower(T.clean_pattern(F.col("pattern"))).alias("pattern")).filter("pattern <> ''").distinct()


class _Lists:
    """Automata of pattern lists, each built when the first text of its scope comes, once in a worker."""

    def __init__(self, patterns: dict[str, list[str]]):
        self.patterns, self.built = patterns, {}

    def __getstate__(self) -> dict:
        return {"patterns": self.patterns, "built": {}}

    def hit(self, text: str, names: Iterator[str]) -> bool:
        for name in names:
            if name not in self.built:
                self.built[name] = self._build(self.patterns.get(name, ()))
            automaton = self.built[name]
            if automaton is not None and next(automaton.iter(text), None) is not None:
                return True
        return False

    @staticmethod
    def _build(patterns):
        import ahocorasick

        if not patterns:
            return None
        automaton = ahocorasick.Automaton()
        for p in patterns:
            automaton.add_word(p, True)
        automaton.make_automaton()
        return automaton


def without_excluded(findings: DataFrame, patterns: DataFrame, scopes: Column, text_col: str = "text", shipped_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """Findings without those whose text contains a pattern of one of their ``scopes``, whatever the case.

    Patterns (``scoped_patterns``) of a scope become one Aho-Corasick automaton, which
    reads a text once however many patterns it has. They are shipped to all tasks
    if their bytes are at most ``shipped_bytes``; else texts meet the lists of their
    scopes in joins. A null text holds no pattern; a finding without scopes stays.
    """
    spark = findings.sparkSession
    text, names = F.lower(F.col(text_col)), F.coalesce(scopes, F.array().cast("array<string>"))
    lists = patterns.groupBy("name").agg(F.collect_set("pattern").alias("patterns"))  # at most 50 of a scope
    if (patterns.agg(F.sum(F.octet_length("pattern") + F.octet_length("name"))).first()[0] or 0) <= shipped_bytes:
        shipped = spark.sparkContext.broadcast(_Lists({r["name"]: r["patterns"] for r in lists.collect()}))  # ``shipped_bytes`` at most

        @F.pandas_udf("boolean")
        def hit(texts: pd.Series, wanted: pd.Series) -> pd.Series:
            found = shipped.value
            return pd.Series([t is not None and found.hit(t, w) for t, w in zip(texts, wanted)], dtype=bool)

        return findings.filter(~hit(text, names))
    taken = {c.lower() for c in findings.columns}
    own, met = (next(n for i in range(len(taken) + 1) if (n := f"{base}_{i}") not in taken) for base in ("scopes", "hit"))
    marked = findings.withColumns({own: names, met: F.lit(False)})
    for i in range(3):
        joined = marked.alias("f").join(lists.alias("l"), F.get(F.col(f"f.{own}"), F.lit(i)) == F.col("l.name"), "left")
        now = F.coalesce(F.exists("l.patterns", lambda p: F.lower(F.col(f"f.`{text_col}`")).contains(p)), F.lit(False))
        marked = joined.select(*[F.col(f"f.`{c}`") for c in findings.columns], F.col(f"f.{own}"), (F.col(f"f.{met}") | now).alias(met))
    return marked.filter(~F.col(met)).drop(own, met)


def exclusion_blocks(reports: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(report_id, global_block, context_block)``; empty text for no patterns."""
    def block(scope: Column, title: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(scope, F.struct("place", "pattern"))))
        body = F.array_join(F.transform(listed, lambda s: F.concat(F.lit("- "), s["pattern"])), "\n")
        return F.when(F.size(listed) > 0, F.concat(F.lit(f"{title}\n"), body, F.lit("\n"))).otherwise("")

    per = patterns.groupBy("report_id").agg(
        block(F.col("scope") == "global", "Never report findings that contain:").alias("global_block"),
        block(F.col("scope") != "global", "For this source, leave out findings that contain:").alias("context_block"),
    )
    return reports.select("report_id").join(per, "report_id", "left").fillna("", ["global_block", "context_block"])


def prompts(reports: DataFrame, fitted: DataFrame, history: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(report_id, system_prompt, user_prompt)``."""
    joined = reports.select("report_id", "source_type", "site_name").join(fitted.select("report_id", "content"), "report_id").join(history, "report_id", "left").join(blocks, "report_id", "left")
    template = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv]), F.col("source_type")), F.lit(TEMPLATES["logwatch"]))
    g, c, h = (F.coalesce(x, F.lit("")) for x in ("global_block", "context_block", "history"))
    paragraph = lambda x: F.when(x != "", F.concat(x, F.lit("\n\n"))).otherwise("")
    site = F.when(F.coalesce("site_name", F.lit("")) != "", F.concat(F.lit("Site: "), "site_name", F.lit("\n\n"))).otherwise("")
    return joined.select(
        "report_id", F.concat(template, F.lit("\n\n"), paragraph(g), F.lit(REMINDER)).alias("system_prompt"),
        F.concat(site, F.lit("Log:\n"), T.safe_prompt_text(F.col("content")), F.lit("\n\n"), paragraph(T.safe_prompt_text(h)), paragraph(c), F.lit(REQUEST)).alias("user_prompt"),
    )


def _listed(mark: str, title: str, items: Column, counted: bool) -> Column:
    lines = F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\\. "), T.escape_markup(x), F.lit("\n"))), "")
    head = F.concat(F.lit(f"{mark} *{title}*"), F.concat(F.lit(" \\("), F.size(items).cast("string"), F.lit("\\)")) if counted else F.lit(""), F.lit("\n"))
    return F.when(F.size(items) > 0, F.concat(head, lines, F.lit("\n"))).otherwise("")


def _header(mark: Column | str, host: str, date: Column, zone: str) -> Column:
    site = F.when(F.coalesce("site_name", F.lit("")) != "", F.concat(F.lit(" \\- "), T.escape_markup(F.col("site_name")))).otherwise("")
    return F.concat(
        F.lit(f"{mark} *"), L.source_name(F.col("source_type")), F.lit(" Report*"), site, F.lit("\n🖥 Host\\: "), T.escape_markup(F.lit(host)),
        F.lit("\n📅 Date\\: "), T.escape_markup(F.date_format(date, "yyyy-MM-dd HH:mm:ss")), F.lit("\n🌍 Timezone\\: "), T.escape_markup(F.lit(zone)), F.lit("\n"),
    )


def notification(host: str, date: Column, zone: str = "UTC") -> Column:
    """R6 for an analysis: columns as decoded, with ``model, provider, cost_usd, duration_s, cache_read_tokens, cache_write_tokens``."""
    cached = F.when((F.col("cache_read_tokens") > 0) | (F.col("cache_write_tokens") > 0), F.concat(F.lit("• Cache Read\\: "), F.col("cache_read_tokens").cast("string"), F.lit(" tokens\n"))).otherwise("")
    entries = F.array_sort(F.map_entries(F.from_json("metrics", "map<string,string>")))
    metrics = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("• "), T.escape_markup(e["key"]), F.lit("\\: "), T.escape_markup(e["value"]), F.lit("\n"))), "")
    n = lambda c: F.size(c).cast("string")
    return F.concat(
        _header("🔍", host, date, zone), L.status_mark(F.col("system_status")), F.lit(" *Status\\:* "), "system_status", F.lit("\n\n📋 *Execution Stats*\n• LLM\\: "),
        T.escape_markup(F.col("model")), F.lit(" \\("), T.escape_markup(F.col("provider")), F.lit("\\)\n• Critical Issues\\: "), n("critical_issues"),
        F.lit("\n• Warnings\\: "), n("warnings"), F.lit("\n• Recommendations\\: "), n("recommendations"), F.lit("\n• Cost\\: "),
        T.escape_markup(F.concat(F.lit("$"), F.format_string("%.4f", "cost_usd"))), F.lit("\n• Duration\\: "), T.escape_markup(F.format_string("%.2fs", "duration_s")), F.lit("\n"),
        cached, F.lit("\n📊 *Summary*\n"), T.escape_markup(F.col("summary")), F.lit("\n\n"), _listed("🔴", "Critical Issues", F.col("critical_issues"), True),
        _listed("⚡", "Warnings", F.col("warnings"), True), _listed("💡", "Recommendations", F.col("recommendations"), False),
        F.when(F.size(entries) > 0, F.concat(F.lit("📈 *Key Metrics*\n"), metrics)).otherwise(""),
    )


def empty_notification(host: str, date: Column, zone: str = "UTC") -> Column:
    """R6 for a report without entries."""
    return F.concat(_header("ℹ️", host, date, zone), F.lit("\n📭 *No Entries Found*\n\nThere was nothing to analyse in the period\\."))


def _cut_by_bytes(line: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` bytes, each as long as whole characters allow. ASCII is cut by position, other text by characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(line), F.lit(1)), F.lit(limit))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a: Column, c: Column) -> Column:
        return F.when(
            F.octet_length(a["now"]) + F.octet_length(c) <= limit, F.struct(a["done"].alias("done"), F.concat(a["now"], c).alias("now"))
        ).otherwise(F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), c.alias("now")))

    by_character = F.aggregate(F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0)), start, step, lambda a: F.concat(a["done"], F.array(a["now"])))
    plain = F.octet_length(line) == F.length(line)
    return F.when(plain, F.transform(starts, lambda i: F.substring(line, i, F.lit(limit)))).otherwise(by_character)


def message_parts(message: Column, limit: int = PART_BYTES) -> Column:
    """An array of parts of at most ``limit`` bytes; a message that fits is one part as it is.

    Lines are packed greedily, each with a line feed after it. A line that does not
    fit with its line feed ends the part before it and is cut into parts of its own
    between characters, to which nothing is added.
    """
    def pieces_of(line: Column) -> Column:
        kept = F.array(F.struct(F.concat(line, F.lit("\n")).alias("text"), F.lit(True).alias("packs")))
        cut = F.transform(_cut_by_bytes(line, limit), lambda p: F.struct(p.alias("text"), F.lit(False).alias("packs")))
        return F.when(F.octet_length(line) < limit, kept).otherwise(cut)

    pieces = F.flatten(F.transform(F.split(message, "\n", -1), pieces_of))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    ended = lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"])))

    def step(a: Column, p: Column) -> Column:
        return (
            F.when(~p["packs"], F.struct(F.concat(ended(a), F.array(p["text"])).alias("done"), F.lit("").alias("now")))
            .when(F.octet_length(a["now"]) + F.octet_length(p["text"]) <= limit, F.struct(a["done"].alias("done"), F.concat(a["now"], p["text"]).alias("now")))
            .otherwise(F.struct(ended(a).alias("done"), p["text"].alias("now")))
        )

    return F.when(F.octet_length(message) <= limit, F.array(message)).otherwise(F.aggregate(pieces, start, step, ended))


def outbox(messages: DataFrame, alerts_configured: bool = True) -> DataFrame:
    """``(report_id, channel, part_no, text)`` from ``(report_id, system_status, body)``; a null status goes to the archive only."""
    alert = F.coalesce(L.is_alert(F.col("system_status")), F.lit(False)) & F.lit(alerts_configured)
    channels = F.when(alert, F.array(F.lit("archive"), F.lit("alerts"))).otherwise(F.array(F.lit("archive")))
    routed = messages.withColumn("channel", F.explode(channels))
    return routed.select("report_id", "channel", F.posexplode(message_parts(F.col("body"))).alias("part_no", "text"))


def unified(*sources: DataFrame) -> DataFrame:
    """``(report_id, source_type, site_id, event_no, text)`` of all sources."""
    columns = ["report_id", "source_type", "site_id", "event_no", "text"]
    return reduce(DataFrame.unionByName, (s.select(*columns) for s in sources))
