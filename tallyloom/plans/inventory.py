"""Further registered queries: filters, joins, text rules, sources and batch twins of the streams, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import answers as A
from tallyloom.functions import lookups as L
from tallyloom.functions import text as T
from tallyloom.operators import events as E
from tallyloom.operators import history as H
from tallyloom.operators import prompts as P
from tallyloom.operators import sections as S
from tallyloom.plans.queries import ENTRIES, SPACES, SUMMARIES, TOKENS, entries, read, summaries
from tallyloom.sources import reports as R
from tallyloom.sources.store import SummaryStore, outbox_table
from tallyloom.streaming import jobs as J
from tallyloom.workspace import new_path, written

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _any(keywords) -> str:
    """A pattern of DuckDB that finds any of the keywords."""
    return "|".join(keywords)


def _trim(value: str) -> str:
    return f"regexp_replace({value}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def _chain(value: str, *steps: tuple[str, str]) -> str:
    return reduce(lambda v, s: f"regexp_replace({v}, '{s[0]}', '{s[1]}', 'g')", steps, value)


LINES = "l AS (SELECT doc_id, generate_subscripts(a, 1) AS no, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))"
UUID = "[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return S.lines(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("content")))


# Filters and predicates


@query(ENTRIES + "SELECT report_id, wid, type FROM e WHERE contains(lower(type), 'access') OR contains(lower(type), 'page')")
def access_entries(spark, sf_dir):
    """F2."""
    return entries(spark, sf_dir).filter(E.type_is("access", "page")).select("report_id", "wid", "type")


@query(ENTRIES + "SELECT report_id, wid, severity BETWEEN 0 AND 3 AS is_critical, severity = 4 AS is_warning FROM e")
def flagged_entries(spark, sf_dir):
    """F3."""
    return E.with_flags(entries(spark, sf_dir)).select("report_id", "wid", "is_critical", "is_warning")


@query(f"""WITH {LINES}
SELECT doc_id, count(*) FILTER ({_trim('line')} <> '' AND regexp_matches(lower(line), '{_any(T.HOST_ESSENTIAL)}')) AS host_lines,
  count(*) FILTER (starts_with(line, '##') OR starts_with(line, '===') OR regexp_matches(lower(line), '{_any(T.CMS_ESSENTIAL)}')) AS cms_lines
FROM l GROUP BY 1""")
def telling_lines(spark, sf_dir):
    """how many lines of a report each rule would keep."""
    line = F.col("line")
    return doc_lines(spark, sf_dir).groupBy("doc_id").agg(
        F.count_if(T.is_essential_host_line(line)).alias("host_lines"), F.count_if(T.is_essential_cms_line(line)).alias("cms_lines")
    )


@query("""SELECT c_custkey AS report_id, count(o_orderkey) AS n_entries, CASE WHEN count(o_orderkey) = 0 THEN 'inform' ELSE 'analyse' END AS route
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def routed_reports(spark, sf_dir):
    """customers as reports, their orders as entries."""
    reports = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("report_id"))
    return E.route_empty(reports, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report_id")))


@query(SUMMARIES + "SELECT summary_id, timestamp FROM s WHERE timestamp >= TIMESTAMP '2000-06-01' - INTERVAL 90 DAY")
def recent_summaries(spark, sf_dir):
    """F7."""
    return H.recent(summaries(spark, sf_dir), F.lit("2000-06-01").cast("timestamp"), 90).select("summary_id", "timestamp")


@query(SUMMARIES + "SELECT summary_id, log_source_type, site_name FROM s WHERE log_source_type = '1-URGENT' AND site_name = (SELECT min(n_name) FROM nation)")
def source_summaries(spark, sf_dir):
    """F8: one source and the first site by name."""
    site = read(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return H.of_source(summaries(spark, sf_dir), "1-URGENT", site).select("summary_id", "log_source_type", "site_name")


STATUS = "CASE system_status WHEN 'P' THEN 'Awful' WHEN 'O' THEN 'Good' ELSE 'Satisfactory' END"


@query(SUMMARIES + f"""SELECT summary_id, {STATUS} IN ('Satisfactory', 'Bad', 'Awful') AS alert,
  CASE {STATUS} WHEN 'Awful' THEN '🔴' WHEN 'Good' THEN '🟢' ELSE '🟡' END AS mark FROM s""")
def status_alerts(spark, sf_dir):
    """F9, X19."""
    status = F.expr(STATUS)
    return summaries(spark, sf_dir).select("summary_id", L.is_alert(status).alias("alert"), L.status_mark(status).alias("mark"))


@query(f"SELECT doc_id, {TOKENS} > 200 AS over FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def over_budget(spark, sf_dir):
    """F10."""
    return read(spark, sf_dir, "documents").select("doc_id", (T.estimate_tokens(F.coalesce("text", F.lit(""))) > 200).alias("over"))


# Joins

SITES = """WITH sites AS (SELECT CAST(n_nationkey AS VARCHAR) AS site_id, n_name AS display_name, CASE n_nationkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'error' WHEN 2 THEN '' ELSE 'Main' END AS log_kind
  FROM nation WHERE n_regionkey <> 4) """


def sites_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations outside one region as a site configuration; site 0 is the default."""
    return read(spark, sf_dir, "nation").filter("n_regionkey <> 4").select(
        F.col("n_nationkey").cast("string").alias("site_id"), F.col("n_name").alias("display_name"), F.lit("0").alias("default_site"),
        F.expr("CASE n_nationkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'error' WHEN 2 THEN '' ELSE 'Main' END").alias("log_kind"), F.lit("error").alias("default_log_kind"),
    )


@query(SITES + """, r AS (SELECT s_suppkey AS report_id, CASE WHEN s_acctbal < 0 THEN '0' ELSE CAST(s_nationkey AS VARCHAR) END AS site_id FROM supplier)
SELECT report_id, site_id, display_name, CASE WHEN display_name IS NULL THEN 'unknown site' END AS reason FROM r LEFT JOIN sites USING (site_id)""")
def sited_requests(spark, sf_dir):
    """Suppliers as requests; those in debt name no site and get the default."""
    asked = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("report_id"), F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey").cast("string")).otherwise("").alias("site_id")
    )
    good, bad = R.with_site(asked, sites_of(spark, sf_dir))
    return good.select("report_id", "site_id", "display_name", F.lit(None).cast("string").alias("reason")).union(
        bad.select("report_id", "site_id", F.lit(None).cast("string"), "reason")
    )


@query(SITES + """, k AS (SELECT site_id, CASE log_kind WHEN 'all' THEN ['main', 'error'] WHEN 'Main' THEN ['main'] ELSE ['error'] END AS kinds FROM sites),
r AS (SELECT CAST(s_suppkey AS VARCHAR) AS site_id, '/srv/' || s_name AS directory FROM supplier)
SELECT site_id, kind, directory || '/logs/' || CASE kind WHEN 'error' THEN 'error.log' ELSE 'ocms.log' END || '.1' AS path
FROM (SELECT site_id, directory, unnest(kinds) AS kind FROM k JOIN r USING (site_id))""")
def site_log_files(spark, sf_dir):
    """Nations as sites, suppliers as the registry."""
    registry = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("site_id"), F.concat(F.lit("/srv/"), "s_name").alias("directory"), F.lit("www").alias("user"), F.lit(8080).alias("port")
    )
    return R.log_files(sites_of(spark, sf_dir), registry)[0].select("site_id", "kind", "path")


@query(SITES + "SELECT site_id, display_name, site_id = '0' AS is_default FROM sites")
def listed_sites(spark, sf_dir):
    """O3."""
    return R.available_sites(sites_of(spark, sf_dir))


SCOPES = """WITH x AS (SELECT CASE item_id % 5 WHEN 0 THEN 'global' WHEN 1 THEN 'logwatch' WHEN 2 THEN 'drupal' WHEN 3 THEN 'ocms' ELSE 'site' END AS scope,
  CASE item_id % 5 WHEN 4 THEN CAST(item_id % 25 AS VARCHAR) ELSE '' END AS site_id, item_id AS pos, regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g') AS pattern FROM benchmark) """
SOURCE_OF = "CASE s_nationkey % 3 WHEN 0 THEN 'logwatch' WHEN 1 THEN 'drupal_watchdog' ELSE 'ocms' END"
RESOLVED = SCOPES + f""", c AS (SELECT scope, site_id, row_number() OVER (PARTITION BY scope, site_id ORDER BY pos) AS r, trim(pattern) AS p FROM x),
d AS (SELECT scope, site_id, r, CASE WHEN length(p) > 200 THEN substr(p, 1, 197) || '...' ELSE p END AS pattern FROM c WHERE r <= 50 AND p <> ''),
q AS (SELECT s_suppkey AS report_id, CAST(s_nationkey AS VARCHAR) AS site_id, replace({SOURCE_OF}, '_watchdog', '') AS own FROM supplier),
m AS (SELECT report_id, CASE WHEN scope = 'global' THEN 0 WHEN scope = 'site' THEN 2000 ELSE 1000 END + r AS place, scope, pattern FROM q JOIN d
  ON scope = 'global' OR scope = own OR scope = 'site' AND own = 'drupal' AND q.site_id = d.site_id) """


def resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as reports, and the benchmark's texts as the exclusion patterns they resolve to."""
    reports = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("report_id"), F.expr(SOURCE_OF).alias("source_type"), F.col("s_nationkey").cast("string").alias("site_id"))
    listed = read(spark, sf_dir, "benchmark").select(
        F.expr("CASE item_id % 5 WHEN 0 THEN 'global' WHEN 1 THEN 'logwatch' WHEN 2 THEN 'drupal' WHEN 3 THEN 'ocms' ELSE 'site' END").alias("scope"),
        F.expr("CASE item_id % 5 WHEN 4 THEN CAST(item_id % 25 AS STRING) ELSE '' END").alias("site_id"),
        F.col("item_id").alias("pos"), F.regexp_replace("text", "[^a-zA-Z0-9 ]", "").alias("pattern"),
    )
    return reports, P.resolve_exclusions(reports, listed)


@query(RESOLVED + "SELECT report_id, place, scope, pattern FROM m")
def resolved_exclusions(spark, sf_dir):
    """J3, U1, X12."""
    return resolved(spark, sf_dir)[1]


@query(RESOLVED + """SELECT q.report_id,
  coalesce('Never report findings that contain:' || chr(10) || string_agg('- ' || pattern, chr(10) ORDER BY place, pattern) FILTER (scope = 'global') || chr(10), '') AS global_block,
  coalesce('For this source, leave out findings that contain:' || chr(10) || string_agg('- ' || pattern, chr(10) ORDER BY place, pattern) FILTER (scope <> 'global') || chr(10), '') AS context_block
FROM q LEFT JOIN m USING (report_id) GROUP BY 1""")
def exclusion_texts(spark, sf_dir):
    """R4."""
    reports, patterns = resolved(spark, sf_dir)
    return P.exclusion_blocks(reports, patterns)


@query(f"""WITH {LINES}, x AS (SELECT CASE item_id % 5 WHEN 0 THEN 'global' WHEN 1 THEN 'logwatch' WHEN 2 THEN 'drupal' WHEN 3 THEN 'ocms' ELSE 'site/' || (item_id % 25) END AS name, item_id AS pos,
  regexp_extract(text, '^[a-zA-Z]+ [a-zA-Z]+ [a-zA-Z]+') AS pattern FROM benchmark),
p AS (SELECT DISTINCT name, lower(pattern) AS pattern FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS r FROM x) WHERE r <= 50 AND pattern <> ''),
f AS (SELECT doc_id AS report_id, no, lower(line) AS line, CASE doc_id % 3 WHEN 0 THEN ['global', 'logwatch'] WHEN 1 THEN ['global', 'drupal', 'site/' || (doc_id % 25)] ELSE ['global', 'ocms'] END AS names FROM l),
h AS (SELECT DISTINCT report_id, no FROM f JOIN p ON list_contains(names, name) AND contains(line, pattern))
SELECT report_id, count(*) AS n_lines, count(*) FILTER (h.no IS NULL) AS n_kept FROM f LEFT JOIN h USING (report_id, no) GROUP BY 1""")
def kept_findings(spark, sf_dir):
    """Lines of every document without those that contain one of the patterns of their report: the first words of benchmark items."""
    findings = doc_lines(spark, sf_dir).select(F.col("doc_id").alias("report_id"), "line")
    source = F.expr("CASE report_id % 3 WHEN 0 THEN 'logwatch' WHEN 1 THEN 'drupal_watchdog' ELSE 'ocms' END")
    listed = read(spark, sf_dir, "benchmark").select(
        F.expr("CASE item_id % 5 WHEN 0 THEN 'global' WHEN 1 THEN 'logwatch' WHEN 2 THEN 'drupal' WHEN 3 THEN 'ocms' ELSE 'site' END").alias("scope"),
        F.expr("CASE item_id % 5 WHEN 4 THEN CAST(item_id % 25 AS STRING) ELSE '' END").alias("site_id"),
        F.col("item_id").alias("pos"), F.regexp_extract("text", "^[a-zA-Z]+ [a-zA-Z]+ [a-zA-Z]+", 0).alias("pattern"),
    )
    kept = P.without_excluded(findings, P.scoped_patterns(listed), P.scopes_of(source, (F.col("report_id") % 25).cast("string")), "line")
    counts = lambda df, c: df.groupBy("report_id").agg(F.count("*").alias(c))
    return counts(findings, "n_lines").join(counts(kept, "n_kept"), "report_id", "left").fillna(0, ["n_kept"])


HISTORY = SUMMARIES + """, r AS (SELECT log_source_type AS source_type, site_name AS site_id, max(timestamp) AS run_time, log_source_type || '/' || site_name AS report_id FROM s GROUP BY 1, 2),
h AS (SELECT report_id, s.*, row_number() OVER (PARTITION BY report_id ORDER BY timestamp DESC, summary_id) AS no FROM r JOIN s ON source_type = log_source_type AND site_id = site_name
  AND timestamp >= run_time - INTERVAL 7 DAY AND timestamp <= run_time) """


def reports_of(stored: DataFrame) -> DataFrame:
    """A report of every source and site, at the time of its last summary."""
    last = stored.groupBy(F.col("log_source_type").alias("source_type"), F.col("site_name").alias("site_id")).agg(F.max("timestamp").alias("run_time"))
    return last.withColumn("report_id", F.concat("source_type", F.lit("/"), "site_id"))


@query(HISTORY + "SELECT report_id, summary_id, no FROM h")
def attached_history(spark, sf_dir):
    """J6, W7."""
    stored = summaries(spark, sf_dir)
    return H.attach_history(reports_of(stored), stored).select("report_id", "summary_id", "no")


@query(HISTORY + """SELECT report_id, 'Previous ' || count(*) || ' analysis summaries:' || chr(10) || chr(10) || string_agg(no || '. ' || strftime(timestamp, '%Y-%m-%d %H:%M') || ' - Status: ' || system_status
  || chr(10) || '   Summary: order ' || summary_id || chr(10) || CASE system_status WHEN 'P' THEN '   Critical Issues: 2' || chr(10) ELSE '' END || '   Warnings: 1' || chr(10) || chr(10), '' ORDER BY no) AS history
FROM h GROUP BY 1""")
def history_texts(spark, sf_dir):
    """R3, A12."""
    none = F.array().cast("array<string>")
    stored = summaries(spark, sf_dir).withColumns({
        "summary": F.concat(F.lit("order "), "summary_id"), "critical_issues": F.when(F.col("system_status") == "P", F.array("summary_id", "site_name")).otherwise(none),
        "warnings": F.array("site_name"), "recommendations": none,
    })
    return H.history_block(reports_of(stored), stored)


# Aggregations and per-group top-k


@query("""SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice / 1e6), 8) AS cost, count(*) AS n, round(avg(o_totalprice / 1e6), 8) AS avg_cost,
  round(avg(o_custkey), 4) AS avg_input, round(avg(o_orderkey), 4) AS avg_output FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def latest_costs(spark, sf_dir):
    """A report of the latest 30 days."""
    calls = read(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("timestamp"), (F.col("o_totalprice") / 1e6).alias("cost_usd"), F.col("o_custkey").alias("input_tokens"), F.col("o_orderkey").alias("output_tokens")
    )
    return H.daily_costs(calls).select("day", "n", *[F.round(c, 8).alias(c) for c in ("cost", "avg_cost")], *[F.round(c, 4).alias(c) for c in ("avg_input", "avg_output")])


PAGE_ENTRIES = r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS report_id, regexp_replace(url, '[^\x20-\x7E]', '', 'g') AS u FROM pages WHERE url IS NOT NULL),
c AS (SELECT page_id, report_id, CASE WHEN length(u) > 80 THEN substr(u, 1, 80) || '...' ELSE u END AS u FROM p) """


@query(PAGE_ENTRIES + f"""SELECT * FROM (SELECT report_id, row_number() OVER w AS rank, pattern, n, CAST(sum(n) OVER (PARTITION BY report_id) AS BIGINT) AS total, greatest(count(*) OVER (PARTITION BY report_id) - 10, 0) AS further
  FROM (SELECT report_id, {_chain('u', (UUID, '[UUID]'), (IP, '[IP]'), (chr(92) + 'b' + chr(92) + 'd+' + chr(92) + 'b', '[N]'), ('/[a-zA-Z0-9/_-]+', '[PATH]'))} AS pattern, count(*) AS n FROM c GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY report_id ORDER BY n DESC, pattern)) WHERE rank <= 10""")
def not_found_patterns(spark, sf_dir):
    """Page addresses as 404 entries, a report per host."""
    pages = read(spark, sf_dir, "pages").filter("url is not null")
    missed = pages.select(
        F.regexp_extract("url", "://([^/?#]*)", 1).alias("report_id"), F.col("page_id").alias("wid"), F.lit("page not found").alias("type"), F.lit(0).alias("timestamp"),
        F.regexp_replace("url", r"[^\x20-\x7E]", "").alias("message"),
    )
    return E.not_found_summary(missed)


@query(ENTRIES + """, b AS (SELECT report_id, CAST(0 AS BIGINT) AS failed_logins, count(*) FILTER (severity = 4) AS access_denied, count(*) FILTER (severity = 6) AS not_found_count,
  count(*) FILTER (severity = 3) AS php_errors, CAST(0 AS BIGINT) AS db_errors, count(*) FILTER (severity <= 3) AS error_count FROM e GROUP BY 1)
SELECT *, CASE WHEN error_count > 0 THEN 'php' END AS top_error_types FROM b""")
def report_metrics(spark, sf_dir):
    """A13."""
    return E.kpis(entries(spark, sf_dir)).drop("disk_usage_max", "last_cron")


@query(ENTRIES + """SELECT site_id, wid, rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY wid DESC) AS rank FROM e
  WHERE severity <= 4 AND timestamp BETWEEN epoch(TIMESTAMP '2024-01-15') AND epoch(TIMESTAMP '2024-01-15') + 86399) WHERE rank <= 100""")
def exported_entries(spark, sf_dir):
    """One day's newest 100 of each site."""
    return E.daily_export(entries(spark, sf_dir), F.lit("2024-01-15"), 4, 100).select("site_id", "wid", "rank")


# Sections, compression and text rules


#: Entries whose lines are joined at once.
REPORT_ENTRIES = 5000


def _block() -> Column:
    """The report of a day and a block of ids."""
    return F.concat("report_id", F.lit("/"), F.floor(F.col("wid") / REPORT_ENTRIES).cast("string")).alias("report_id")


def _joined(order: str, text: str, between: str) -> Column:
    """The texts of a group in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), between)


@query(ENTRIES + f""", c AS (SELECT report_id, type, count(*) AS n_lines, string_agg(message, chr(10) ORDER BY wid) AS content FROM e GROUP BY 1, 2)
SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY type) - 1 AS section_no, type AS name, n_lines, md5(content) AS digest,
  CASE WHEN regexp_matches(type, '{_any(T.HOST_HIGH)}') OR regexp_matches(content, '{_any(T.HOST_HIGH)}') THEN 1 WHEN regexp_matches(type, '{_any(T.HOST_MEDIUM)}') THEN 2 ELSE 3 END AS host_priority,
  CASE WHEN regexp_matches(type, '{_any(T.CMS_HIGH)}') OR regexp_matches(content, '{_any(T.CMS_HIGH)}') THEN 1 WHEN regexp_matches(type, '{_any(T.CMS_MEDIUM)}') THEN 2 ELSE 3 END AS cms_priority
FROM c""")
def digest_sections(spark, sf_dir):
    """A host digest per day with a section per type, cut into its sections again.

    Lines are joined by blocks of ids and blocks by type, so no list holds all lines of a day.
    """
    block = F.floor(F.col("wid") / REPORT_ENTRIES).alias("block")
    per_block = entries(spark, sf_dir).groupBy("report_id", "type", block).agg(_joined("wid", "message", "\n").alias("t"))
    per_type = per_block.groupBy("report_id", "type").agg(_joined("block", "t", "\n").alias("t"))
    body = F.concat(F.lit("#### "), "type", F.lit(" ####\n"), "t", F.lit("\n"))
    whole = per_type.select("report_id", "type", body.alias("b")).groupBy("report_id").agg(_joined("type", "b", "\n").alias("content"))
    return S.sections(whole).select(
        "report_id", "section_no", "name", F.size(F.split("content", "\n", -1)).cast("long").alias("n_lines"), F.md5("content").alias("digest"),
        F.col("priority").alias("host_priority"), T.cms_priority(F.col("name"), F.col("content")).alias("cms_priority"),
    )


@query("""WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), k AS (SELECT *, len(a) AS n, CAST(greatest(ceil(len(a) * 0.35), 1) AS BIGINT) AS k FROM a)
SELECT doc_id, array_to_string(a[1:k], chr(10)) || chr(10) || CASE WHEN k < n THEN chr(10) || '[... ' || (n - k) || ' more lines omitted for brevity ...]' || chr(10) ELSE '' END AS head FROM k""")
def kept_heads(spark, sf_dir):
    """W2 on every document."""
    listed = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return read(spark, sf_dir, "documents").select("doc_id", S.keep_head(listed, F.lit(0.35).cast("double"), S.host_note).alias("head"))


_WORDS = f"len(regexp_extract_all(line, '[^{SPACES}]+'))"


@query(f"""WITH {LINES}, t AS (SELECT doc_id, {TOKENS} AS tokens, t FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
z AS (SELECT doc_id, no, count(*) OVER (PARTITION BY doc_id) AS n, sum(strlen(line)) OVER o + no - 1 AS b, sum({_WORDS}) OVER o AS w FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
k AS (SELECT doc_id, max(no) AS best FROM z WHERE no < n AND greatest((b + {len(S.NOTICE) + 1}) // 4, CAST(floor((w + {len(S.NOTICE.split())}) / 0.75) AS BIGINT)) <= 60 GROUP BY 1)
SELECT doc_id, CASE WHEN tokens <= 60 THEN t WHEN best IS NULL THEN '{S.NOTICE}' ELSE array_to_string(string_split(t, chr(10))[1:best], chr(10)) || chr(10) || '{S.NOTICE}' END AS trimmed
FROM t LEFT JOIN k USING (doc_id)""")
def trimmed_reports(spark, sf_dir):
    """Every document brought to 60 tokens by its first lines."""
    return read(spark, sf_dir, "documents").select("doc_id", S.trim_to_budget(F.coalesce("text", F.lit("")), F.lit(60)).alias("trimmed"))


@query(f"""WITH {LINES}, p AS (SELECT doc_id, 'id 0a1b2c3d-0000-4000-8000-00000000' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || ' at 2024-01-02 03:04:05, 12:00:01 took ' || doc_id || 'ms; ' || line AS line FROM l)
SELECT doc_id, norm, count(*) AS n FROM (SELECT doc_id, {_chain(_trim('line'), (UUID, 'UUID'), (IP, 'IP'), (r'\d{4}-\d{2}-\d{2}[' + r'\t\n\f\r ]+\d{2}:\d{2}:\d{2}', 'TIMESTAMP'),
    (r'\b\d{2}:\d{2}:\d{2}\b', 'TIME'), (r'\b\d+([a-zA-Z]+)\b', r'N\1'), (r'\b\d+\b', 'N'))} AS norm FROM p) GROUP BY 1, 2""")
def cms_normal_forms(spark, sf_dir):
    """X2 over every line, with an id, times and a duration put before it."""
    made = F.concat(
        F.lit("id 0a1b2c3d-0000-4000-8000-00000000"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit(" at 2024-01-02 03:04:05, 12:00:01 took "),
        F.col("doc_id").cast("string"), F.lit("ms; "), "line",
    )
    return doc_lines(spark, sf_dir).groupBy("doc_id", T.cms_normal_form(made).alias("norm")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN repeat('*', 9) WHEN 1 THEN 'sk-ant-***...' WHEN 2 THEN c_custkey || ':***...' ELSE 'Cust***...' END AS masked FROM customer""")
def masked_secrets(spark, sf_dir):
    """X9."""
    secret = F.expr("CASE c_nationkey % 4 WHEN 0 THEN right(c_name, 9) WHEN 1 THEN concat('sk-ant-', c_name) WHEN 2 THEN concat(c_custkey, ':', c_name) ELSE replace(c_name, '#', '-') END")
    return read(spark, sf_dir, "customer").select("c_custkey", T.mask_credential(secret).alias("masked"))


@query("""SELECT doc_id, hits[1] AS bearer, hits[2] AS api_key, true AS found FROM (SELECT doc_id, [CAST(1 AS BIGINT), CAST(1 AS BIGINT)] AS hits FROM documents)""")
def credential_audit(spark, sf_dir):
    """X8's counts and detector on texts with a token put before and after."""
    made = F.concat(F.lit("Bearer abc.def "), F.coalesce("text", F.lit("")), F.lit(" api_key=xyz"))
    counts = T.credential_counts(made)
    return read(spark, sf_dir, "documents").select("doc_id", counts[3].cast("long").alias("bearer"), counts[5].cast("long").alias("api_key"), T.has_credentials(made).alias("found"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 6 WHEN 'view' THEN 7 ELSE 5 END AS level FROM events""")
def labelled_levels(spark, sf_dir):
    """Event types as labels of several languages."""
    label = F.expr("CASE event_type WHEN 'error' THEN 'Fehler' WHEN 'purchase' THEN 'Предупреждение' WHEN 'signup' THEN 'Información' WHEN 'view' THEN 'Débogage' ELSE 'other' END")
    return read(spark, sf_dir, "events").select("event_id", L.label_level(label).alias("level"))


@query(f"""WITH a AS (SELECT doc_id, {_trim(_chain(_chain(_trim(_chain("coalesce(text, '')", ('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]', ''))), (r'[\r\n\t]', ' ')), (r'[\x00-\x1F\x7F]', '')))} AS p FROM documents)
SELECT doc_id, CASE WHEN length(p) > 200 THEN substr(p, 1, 197) || '...' ELSE p END AS pattern FROM a""")
def cleaned_patterns(spark, sf_dir):
    """X12 on the ASCII part of every document."""
    return read(spark, sf_dir, "documents").select("doc_id", T.clean_pattern(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "")).alias("pattern"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS cut FROM documents")
def cut_texts(spark, sf_dir):
    """X21."""
    return read(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 60).alias("cut"))


@query("SELECT p_partkey, greatest(w - p_size * 10 - 300 - p_size - greatest(w // 20, 2000), 1000) AS budget FROM (SELECT p_partkey, p_size, CASE WHEN p_size > 5 THEN p_size * 1000 ELSE 128000 END AS w FROM part)")
def token_budgets(spark, sf_dir):
    """Part sizes as context limits; small ones count as not stated."""
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", L.log_token_budget(F.when(size > 5, size * 1000).otherwise(0), size * 10, F.lit(300), size).alias("budget"))


RATES = ", ".join(f"('{p}', {a}, {b})" for p, a, b, _, _ in L.PRICES)


@query(f"""WITH r(prefix, i, o) AS (VALUES {RATES}), c AS (SELECT l_orderkey, l_linenumber, l_partkey AS i_n, l_suppkey AS o_n,
  CASE l_returnflag WHEN 'A' THEN (SELECT min(prefix) FROM r) || '-dated' WHEN 'N' THEN (SELECT max(prefix) FROM r) ELSE 'other' END AS model FROM lineitem)
SELECT l_orderkey, l_linenumber, round(i_n / 1e6 * coalesce(i, {L.FALLBACK[0]}) + o_n / 1e6 * coalesce(o, {L.FALLBACK[1]}), 9) AS cost, prefix IS NOT NULL AS known_model
FROM c LEFT JOIN r ON starts_with(model, prefix)""")
def call_costs(spark, sf_dir):
    """Order lines as model calls."""
    names = sorted(p[0] for p in L.PRICES)
    model = F.when(F.col("l_returnflag") == "A", F.lit(names[0] + "-dated")).when(F.col("l_returnflag") == "N", F.lit(names[-1])).otherwise("other")
    calls = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", model.alias("model"))
    cost = L.call_cost(F.col("l_partkey"), F.col("l_suppkey"), F.lit(0), F.lit(0))
    return L.with_prices(calls, L.price_table(spark), "model").select("l_orderkey", "l_linenumber", F.round(cost, 9).alias("cost"), "known_model")


# Model answers


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN '' WHEN 2 THEN 'Fine' WHEN 3 THEN 'Bad' ELSE 'Good' END AS system_status, CASE turn % 4 WHEN 1 THEN '' WHEN 3 THEN '' ELSE text END AS summary,
  CASE turn % 4 WHEN 0 THEN role || ',d' ELSE '' END AS critical_issues, CASE turn % 4 WHEN 0 THEN 'lone' ELSE '' END AS warnings,
  CASE turn % 4 WHEN 1 THEN 'no JSON object' WHEN 2 THEN 'invalid status' WHEN 3 THEN 'no summary' END AS reject FROM conversations WHERE text <> ''""")
def decoded_answers(spark, sf_dir):
    """Turns put into answers that are sound, without JSON, of no known status, or without a summary."""
    turns = read(spark, sf_dir, "conversations").filter("text <> ''")
    sound = F.concat(
        F.lit('Answer: {"criticalIssues": ["'), "role", F.lit('", "", {"description": "d"}, 7], "warnings": "lone", "recommendations": null, '),
        F.regexp_replace(F.to_json(F.struct(F.lit("Good").alias("systemStatus"), F.col("text").alias("summary"))), r"^\{", ""), F.lit(" and {more}"),
    )
    other = lambda status, summary: F.concat(F.lit("```"), F.to_json(F.struct(F.lit(status).alias("systemStatus"), summary.alias("summary"))), F.lit("```"))
    kind = F.col("turn") % 4
    made = F.when(kind == 0, sound).when(kind == 1, F.lit("No answer today.")).when(kind == 2, other("Fine", F.col("text"))).otherwise(other("Bad", F.lit("")))
    return A.decode(turns.select("conv_id", "turn", made.alias("response"))).select(
        "conv_id", "turn", "system_status", "summary", F.array_join("critical_issues", ",").alias("critical_issues"), F.array_join("warnings", ",").alias("warnings"), "reject"
    )


# Sources: entries written in each format and read back

BACK = "SELECT report_id, wid, timestamp, type, severity, message FROM e"
_FIELDS = ("wid", "uid", "type", "message", "severity", "hostname", "location", "timestamp")


def _per_report(made: DataFrame, text, joined) -> DataFrame:
    """Reports of a day and a block of ids; ``_day`` finds the day again."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("wid", text.alias("t")))), lambda s: s["t"])
    return made.groupBy(_block()).agg(joined(listed).alias("content"))


def _day() -> Column:
    return F.substring_index("report_id", "/", 1).alias("report_id")


@query(ENTRIES + BACK)
def json_entries(spark, sf_dir):
    """A day's entries as JSON arrays."""
    made = _per_report(entries(spark, sf_dir), F.to_json(F.struct(*_FIELDS)), lambda a: F.concat(F.lit("["), F.array_join(a, ",\n"), F.lit("]")))
    return R.parse_watchdog_json(made)[0].select(_day(), "wid", "timestamp", "type", "severity", "message")


@query(ENTRIES + BACK)
def line_entries(spark, sf_dir):
    """A day's entries as NDJSON with lines that do not parse."""
    made = _per_report(entries(spark, sf_dir), F.to_json(F.struct(*_FIELDS)), lambda a: F.concat(F.array_join(a, ",\n"), F.lit("\n{broken\n")))
    return R.parse_watchdog_json(made)[0].select(_day(), "wid", "timestamp", "type", "severity", "message")


@query(ENTRIES + BACK)
def table_entries(spark, sf_dir):
    """A day's entries as text tables."""
    row = F.concat(
        F.lit("  "), F.col("wid").cast("string"), F.lit("  "), F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit("  "), "type", F.lit("   "),
        L.severity_name(F.col("severity")), F.lit("  "), "message",
    )
    head = "note before\n  ID  Date  Type  Severity  Message\n ---- ----\n"
    made = _per_report(entries(spark, sf_dir), row, lambda a: F.concat(F.lit(head), F.array_join(a, "\n"), F.lit("\nnot a row\n")))
    return R.parse_watchdog_table(made)[0].select(_day(), "wid", "timestamp", "type", "severity", "message")


@query(ENTRIES + "SELECT report_id, wid, user_id AS uid, timestamp, type, severity, message FROM e")
def keyed_entries(spark, sf_dir):
    """A day's entries as objects keyed by id, with text numbers and localised labels."""
    label = F.expr("CASE severity WHEN 3 THEN 'Ошибка' WHEN 4 THEN 'Warnung' WHEN 5 THEN 'Avis' WHEN 6 THEN 'Info' ELSE 'Debug' END")
    texts = [F.col(c).cast("string").alias(c) for c in _FIELDS if c != "severity"]
    row = F.concat(F.lit('"'), F.col("wid").cast("string"), F.lit('":'), F.to_json(F.struct(*texts, label.alias("severity"))))
    made = _per_report(entries(spark, sf_dir), row, lambda a: F.concat(F.lit("{"), F.array_join(a, ","), F.lit("}")))
    return R.parse_keyed_export(made).select(_day(), "wid", "uid", "timestamp", "type", "severity", "message")


@query(ENTRIES + f""", {LINES} SELECT report_id, 'drupal_watchdog' AS source_type, site_id, wid AS event_no, message AS text FROM e
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'logwatch', '', no - 1, line FROM l UNION ALL SELECT CAST(conv_id AS VARCHAR), 'ocms', role, turn, text FROM conversations""")
def unified_events(spark, sf_dir):
    """U2, P3."""
    cms = entries(spark, sf_dir).select("report_id", F.lit("drupal_watchdog").alias("source_type"), "site_id", F.col("wid").alias("event_no"), F.col("message").alias("text"))
    host = doc_lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("report_id"), F.lit("logwatch").alias("source_type"), F.lit("").alias("site_id"), F.col("line_no").cast("long").alias("event_no"), F.col("line").alias("text"))
    app = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("report_id"), F.lit("ocms").alias("source_type"), F.col("role").alias("site_id"), F.col("turn").cast("long").alias("event_no"), "text")
    return P.unified(cms, host, app)


# Batch twins of the streams


@query(ENTRIES + "SELECT date_trunc('day', CAST(to_timestamp(timestamp) AT TIME ZONE 'UTC' AS TIMESTAMP)) AS window_start, site_id, CASE severity WHEN 3 THEN 'error' WHEN 4 THEN 'warning' WHEN 5 THEN 'notice' WHEN 6 THEN 'info' ELSE 'debug' END AS severity_name, count(*) AS n FROM e GROUP BY 1, 2, 3")
def windowed_counts(spark, sf_dir):
    """T2's batch twin."""
    return J.counts(entries(spark, sf_dir))


@query("WITH RECURSIVE " + ENTRIES.removeprefix("WITH ") + r""", k AS (SELECT site_id, timestamp AS t, min(wid) AS wid, regexp_replace(regexp_replace(message, '\b\d+\b', '[N]', 'g'), '/[a-zA-Z0-9/_-]+', '[PATH]', 'g') AS pattern FROM e GROUP BY 1, 2, 4),
f AS (SELECT site_id, pattern, min(t) AS t FROM k GROUP BY 1, 2 UNION ALL SELECT k.site_id, k.pattern, min(k.t) AS t FROM f JOIN k ON f.site_id = k.site_id AND f.pattern = k.pattern AND k.t > f.t + 21600 GROUP BY 1, 2)
SELECT k.site_id, k.pattern, k.t AS timestamp, k.wid FROM f JOIN k USING (site_id, pattern, t)""")
def first_patterns(spark, sf_dir):
    """T3's batch twin: the first event of each site and pattern, and then none for six hours."""
    seconds = entries(spark, sf_dir).withColumn("event_time", F.timestamp_seconds("timestamp"))
    return J.first_of_pattern(seconds, "6 hours").select("site_id", "pattern", "timestamp", "wid")


@query(ENTRIES + """SELECT wid % 50 > 1 AS ok, CASE WHEN wid % 50 > 1 THEN wid END AS wid, CASE WHEN wid % 50 > 1 THEN type END AS type, CASE WHEN wid % 50 > 1 THEN severity END AS severity,
  CASE WHEN wid % 50 > 1 THEN timestamp END AS timestamp, CASE WHEN wid % 50 > 1 THEN site_id END AS site_id, CASE WHEN wid % 50 > 1 THEN '' END AS referer FROM e""")
def streamed_lines(spark, sf_dir):
    """T1's batch twin: entries as lines, of which some break off and some give their severity as a text."""
    fields = [F.col(c) for c in (*_FIELDS, "site_id") if c != "severity"]
    text = lambda severity: F.to_json(F.struct(*fields, severity.alias("severity")))
    kind = F.col("wid") % 50
    line = F.when(kind == 0, text(F.lit("bad"))).when(kind == 1, F.substring(text(F.col("severity")), 1, 30)).otherwise(F.concat(F.lit(" "), text(F.col("severity")), F.lit(",")))
    return J.parse_lines(entries(spark, sf_dir).select(line.alias("value"))).select("ok", "wid", "type", "severity", "timestamp", "site_id", "referer")


@query(ENTRIES + """, w AS (SELECT hostname, unnest(generate_series(timestamp // 60 * 60 - 540, timestamp // 60 * 60, 60)) AS s FROM e WHERE severity = 3)
SELECT CAST(to_timestamp(s) AT TIME ZONE 'UTC' AS TIMESTAMP) AS window_start, hostname, count(*) AS failures FROM w GROUP BY 1, 2 HAVING count(*) >= 2""")
def failure_windows(spark, sf_dir):
    """T4's batch twin: errors as failed logins."""
    told = F.when(F.col("severity") == 3, F.concat(F.lit("Login failed: "), "message")).otherwise(F.col("message"))
    return J.failure_bursts(entries(spark, sf_dir).withColumn("message", told), 2)


# Files, configurations and stored tables, written and read back

#: Bytes that a file of ``admitted_files`` may hold.
FILE_BYTES = 300


@query(f"""SELECT item_id, strlen(text) + 1 AS size_bytes, CASE WHEN strlen(text) + 1 > {FILE_BYTES} THEN 'too large' WHEN strlen(text) + 1 < 100 THEN 'too short' END AS reason,
  CASE WHEN strlen(text) + 1 BETWEEN 100 AND {FILE_BYTES} THEN md5(text || chr(10)) END AS digest FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL""")
def admitted_files(spark, sf_dir):
    """Benchmark items as files, of which only those of fitting size are opened."""
    path = new_path(spark, "items")
    read(spark, sf_dir, "benchmark").filter("text is not null and item_id is not null").select("item_id", "text").write.partitionBy("item_id").text(path)
    good, bad = R.admitted(spark, path, "logwatch", F.current_timestamp(), FILE_BYTES / 2**20)
    item = F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id")
    return good.select(item, "size_bytes", F.lit(None).cast("string").alias("reason"), F.md5("content").alias("digest")).union(bad.select(item, "size_bytes", "reason", F.lit(None)))


@query("""WITH c AS (SELECT c_custkey // 50 AS config_id, c_custkey, c_name, c_custkey % 97 = 5 AS strange FROM customer),
b AS (SELECT config_id FROM c WHERE strange UNION SELECT config_id FROM c GROUP BY 1 HAVING config_id % 11 = 3)
SELECT config_id, CAST(c_custkey AS VARCHAR) AS site_id, c_name AS display_name, NULL AS reason FROM c WHERE config_id NOT IN (FROM b)
UNION ALL SELECT config_id, NULL, NULL, 'unknown field: sites.' || c_custkey || '.colour' FROM c WHERE strange
UNION ALL SELECT DISTINCT config_id, NULL, NULL, 'unknown field: zone' FROM c WHERE config_id % 11 = 3""")
def strict_sites(spark, sf_dir):
    """Customers as sites of configurations, some with fields that the application shape does not know."""
    key = F.floor(F.col("c_custkey") / 50).cast("bigint")
    site = F.struct(F.col("c_name").alias("name"), F.lit("main").alias("log_kind"), F.when(F.col("c_custkey") % 97 == 5, F.lit("red")).alias("colour"))
    sites = F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("id"), site.alias("s"))))
    made = read(spark, sf_dir, "customer").groupBy(key.alias("config_id")).agg(sites.alias("sites"))
    zone = F.when(F.col("config_id") % 11 == 3, F.lit("north")).alias("zone")
    texts = written(made.select("config_id", F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit("/r").alias("registry_path"), "sites", zone)).alias("content")), "configs")
    good, bad = R.parse_site_config(texts, "application")
    none = F.lit(None).cast("string")
    return good.select("config_id", "site_id", "display_name", none.alias("reason")).union(bad.select("config_id", "site_id", none, "reason"))


STORED = ENTRIES + """, v AS (SELECT events.event_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'ocms' ELSE 'logwatch' END AS log_source_type, CAST(user_id % 3 AS VARCHAR) AS site_name,
  CASE event_type WHEN 'error' THEN 'Bad' ELSE 'Good' END AS system_status, (user_id % 5) / 1e3 AS cost_usd, user_id AS input_tokens, event_id % 1000 AS output_tokens
  FROM events WHERE (event_id % 3 <> 0 OR event_id % 2 = 0) AND ts >= TIMESTAMP '2024-01-10') """


def stored(spark: SparkSession, sf_dir: str, times: int = 1) -> tuple[SummaryStore, int]:
    """Events as analyses in a store: two overlapping batches, the first ``times`` times, then all before a day deleted; and how many were."""
    made = read(spark, sf_dir, "events").select(
        "event_id", F.col("event_id").cast("string").alias("summary_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.when(F.col("event_type").isin("view", "click"), F.lit("ocms")).otherwise("").alias("log_source_type"),
        (F.col("user_id") % 3).cast("string").alias("site_name"), F.when(F.col("event_type") == "error", F.lit("Bad")).otherwise("Good").alias("system_status"),
        ((F.col("user_id") % 5) / 1e3).alias("cost_usd"), F.col("user_id").alias("input_tokens"), (F.col("event_id") % 1000).alias("output_tokens"),
    )
    store = SummaryStore(spark, new_path(spark, "store")).create()
    for part in ["event_id % 3 <> 0"] * times + ["event_id % 2 = 0"]:
        store.append(made.filter(part))
    return store, store.retain(F.lit("2024-01-20").cast("timestamp"), 10)


@query(STORED + """, o AS (SELECT count(*) AS n_deleted FROM events WHERE (event_id % 3 <> 0 OR event_id % 2 = 0) AND ts < TIMESTAMP '2024-01-10')
SELECT CAST(event_id AS VARCHAR) AS summary_id, log_source_type, site_name, CAST(ts AS DATE) AS summary_date, n_deleted FROM v, o""")
def stored_summaries(spark, sf_dir):
    """What a store holds after repeated appends and retention."""
    store, gone = stored(spark, sf_dir, 2)
    return store.read().select("summary_id", "log_source_type", "site_name", "summary_date", F.lit(gone).cast("bigint").alias("n_deleted"))


@query(STORED + """SELECT log_source_type, site_name, system_status, count(*) AS n, round(sum(cost_usd), 8) AS cost, grouping(log_source_type, site_name, system_status) AS scope
FROM v GROUP BY GROUPING SETS ((), (system_status), (log_source_type, site_name), (log_source_type, site_name, system_status))""")
def stored_statistics(spark, sf_dir):
    """A10 from the store's partial statistics, from which retention has subtracted."""
    return stored(spark, sf_dir)[0].statistics().withColumn("cost", F.round("cost", 8))


@query(STORED + """SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(cost_usd), 8) AS cost, round(avg(cost_usd) FILTER (cost_usd > 0), 8) AS avg_cost, round(avg(input_tokens), 4) AS avg_input,
  round(avg(output_tokens), 4) AS avg_output FROM v GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def stored_costs(spark, sf_dir):
    """A11 from the store's partial statistics: a report of the latest 30 days."""
    costs = stored(spark, sf_dir)[0].daily_costs(30)
    return costs.select("day", "n", *[F.round(c, 8).alias(c) for c in ("cost", "avg_cost")], *[F.round(c, 4).alias(c) for c in ("avg_input", "avg_output")])


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS report_id, unnest(CASE o_orderstatus WHEN 'F' THEN ['archive', 'alerts'] ELSE ['archive'] END) AS channel, 0 AS part_no, 'Order ' || o_orderkey AS text FROM orders""")
def routed_messages(spark, sf_dir):
    """T5's batch twin, S16: orders as analyses routed to the outbox, half of them twice."""
    made = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("report_id"), F.when(F.col("o_orderstatus") == "F", F.lit("Awful")).otherwise("Good").alias("system_status"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("body"),
    )
    outbox = outbox_table(spark, new_path(spark, "outbox")).create()
    for batch in (made.filter("report_id % 2 = 0"), made):
        outbox.append(P.outbox(batch))
    return outbox.read()
