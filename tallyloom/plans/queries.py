"""Registered queries of the log-report operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import lookups as L
from tallyloom.functions import text as T
from tallyloom.operators import events as E
from tallyloom.operators import history as H
from tallyloom.operators import prompts as P
from tallyloom.operators import sections as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"), F.col("text").alias("content"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watchdog entries from the events table, a report per day."""
    kinds = {"error": ("php", 3), "purchase": ("access denied", 4), "signup": ("user", 5), "view": ("page not found", 6), "click": ("content", 7)}
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[i])])[F.col("event_type")]
    return read(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("report_id"), F.col("event_id").alias("wid"), F.col("user_id").alias("uid"), pick(0).alias("type"),
        F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string"), F.lit(" at /u/"), F.col("user_id").cast("string")).alias("message"),
        pick(1).alias("severity"), F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string")).alias("hostname"), F.lit("/").alias("location"),
        F.unix_timestamp("ts").alias("timestamp"), F.col("ts").alias("event_time"), (F.col("user_id") % 3).cast("string").alias("site_id"),
    )


ENTRIES = """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS report_id, event_id AS wid, user_id,
  CASE event_type WHEN 'error' THEN 'php' WHEN 'purchase' THEN 'access denied' WHEN 'signup' THEN 'user' WHEN 'view' THEN 'page not found' ELSE 'content' END AS type,
  CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 5 WHEN 'view' THEN 6 ELSE 7 END AS severity,
  event_type || ' by user ' || user_id || ' at /u/' || user_id AS message, 'h' || (user_id % 10) AS hostname,
  CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, CAST(user_id % 3 AS VARCHAR) AS site_id FROM events) """
SPACES = "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
TOKENS = f"greatest(strlen(t) // 4, CAST(floor(len(regexp_extract_all(t, '[^{SPACES}]+')) / 0.75) AS BIGINT))"
NORM = (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^[{SPACES}]+|[{SPACES}]+$', '', 'g'), "
    r"'\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', 'IP', 'g'), '\b\d{1,2}:\d{2}:\d{2}\b', 'TIME', 'g'), "
    r"'\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{4}\b', 'DATE', 'g'), '\b\d+\b', 'N', 'g')"
)


@query(f"""
WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS no, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
n AS (SELECT *, {NORM} AS norm, count(*) OVER (PARTITION BY doc_id) AS lines FROM l),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY no) AS first, count(*) OVER (PARTITION BY doc_id, norm) AS times FROM n)
SELECT doc_id AS report_id, count(*) AS lines_before,
  count(*) FILTER (lines <= 10 OR norm = '' OR first = 1) + max(CASE WHEN lines > 10 THEN 1 ELSE 0 END) AS lines_after,
  max(CASE WHEN lines > 10 AND norm <> '' THEN times ELSE 1 END) AS most_repeated
FROM c GROUP BY doc_id""")
def collapse_lines(spark, sf_dir):
    """Lines of each report before and after near-duplicate collapse."""
    secs = doc_reports(spark, sf_dir).select("report_id", F.lit(0).alias("section_no"), F.coalesce("content", F.lit("")).alias("content"))
    lined = S.lines(secs)
    after = S.collapse_host(lined).withColumn("times", F.regexp_extract("line", r" \(occurred (\d+) times\)\z", 1).try_cast("long"))
    before = lined.groupBy("report_id").agg(F.count("*").alias("lines_before"))
    return before.join(after.groupBy("report_id").agg(F.count("*").alias("lines_after"), F.max(F.coalesce("times", F.lit(1))).alias("most_repeated")), "report_id")


def _rejoined(norm: str, least: int, suffix: str, closing: str) -> str:
    """SQL of every document's lines after near-duplicate collapse, joined again."""
    return f"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS no, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
n AS (SELECT *, {norm} AS norm, count(*) OVER (PARTITION BY doc_id) AS lines FROM l),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY no) AS first, count(*) OVER (PARTITION BY doc_id, norm) AS times FROM n)
SELECT doc_id AS report_id, md5(string_agg(line || CASE WHEN lines > {least} AND norm <> '' AND times > 1 THEN {suffix} ELSE '' END, chr(10) ORDER BY no) || {closing}) AS digest
FROM c WHERE lines <= {least} OR norm = '' OR first = 1 GROUP BY doc_id"""


def _one_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines as one section."""
    return S.lines(doc_reports(spark, sf_dir).select("report_id", F.lit(0).alias("section_no"), F.coalesce("content", F.lit("")).alias("content")))


@query(_rejoined(NORM, 10, "' (occurred ' || times || ' times)'", "CASE WHEN max(lines) > 10 THEN chr(10) ELSE '' END"))
def collapsed_texts(spark, sf_dir):
    """Every document's text after near-duplicate collapse."""
    joined = S.gathered(S.collapse_host(_one_section(spark, sf_dir)))
    return joined.select("report_id", F.md5(F.array_join("lines", "\n")).alias("digest"))


CMS_NORM = (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^[{SPACES}]+|[{SPACES}]+$', '', 'g'), "
    r"'[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}', 'UUID', 'g'), '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', 'IP', 'g'), "
    r"'\d{4}-\d{2}-\d{2}[\t\n\f\r ]+\d{2}:\d{2}:\d{2}', 'TIMESTAMP', 'g'), '\b\d{2}:\d{2}:\d{2}\b', 'TIME', 'g'), '\b\d+([a-zA-Z]+)\b', 'N\1', 'g'), '\b\d+\b', 'N', 'g')"
)


@query(_rejoined(CMS_NORM, 5, "' (x' || times || ')'", "''"))
def collapsed_cms_texts(spark, sf_dir):
    """The same by the rule of CMS digests."""
    joined = S.gathered(S.collapse_cms(_one_section(spark, sf_dir)))
    return joined.select("report_id", F.md5(F.array_join("lines", "\n")).alias("digest"))


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS no, unnest(a) AS raw, len(a) AS n, a FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
b AS (SELECT *, regexp_replace(raw, '\\r+$', '') AS line, regexp_replace(raw, '^[{SPACES}]+|[{SPACES}]+$', '', 'g') = '' AS blank FROM l),
p AS (SELECT *, {NORM} AS norm, CASE WHEN blank THEN NULL WHEN no <= 2 THEN 1 WHEN regexp_matches(lower(raw), '{'|'.join(T.HOST_ESSENTIAL)}') THEN 2 WHEN no > n - 2 THEN 3 END AS phase FROM b WHERE n > 6),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY phase, no) AS r FROM p WHERE phase IS NOT NULL),
f AS (SELECT doc_id, count(*) AS kept, string_agg(line, chr(10) ORDER BY phase, no) AS text FROM k WHERE r = 1 GROUP BY 1),
t AS (SELECT doc_id, 1 AS kept, line AS text FROM b WHERE n > 6 AND no = 3 AND NOT blank AND doc_id NOT IN (SELECT doc_id FROM f)),
d AS (SELECT DISTINCT doc_id, n, array_to_string(a, chr(10)) AS whole FROM l)
SELECT d.doc_id AS report_id, md5(CASE WHEN n <= 6 THEN whole ELSE concat_ws(chr(10), coalesce(f.text, t.text), CASE WHEN n > coalesce(f.kept, t.kept, 0) THEN '[... ' || (n - coalesce(f.kept, t.kept, 0)) || ' more lines omitted for brevity ...]' END) END) AS digest
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN t USING (doc_id)""")
def essential_texts(spark, sf_dir):
    """Every document's essential lines."""
    return S.essential_lines(_one_section(spark, sf_dir)).select("report_id", F.md5("essential").alias("digest"))


@query(f"SELECT doc_id AS report_id, {TOKENS} AS tokens FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def token_estimates(spark, sf_dir):
    """A9."""
    return doc_reports(spark, sf_dir).select("report_id", T.estimate_tokens(F.coalesce("content", F.lit(""))).alias("tokens"))


@query(f"""
SELECT norm, count(*) AS n FROM (SELECT {NORM} AS norm FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)) GROUP BY norm""")
def host_normal_forms(spark, sf_dir):
    """X1 over every line."""
    secs = doc_reports(spark, sf_dir).select("report_id", F.lit(0).alias("section_no"), F.coalesce("content", F.lit("")).alias("content"))
    return S.lines(secs).groupBy(T.host_normal_form(F.col("line")).alias("norm")).agg(F.count("*").alias("n"))


@query(ENTRIES + "SELECT report_id, count(*) AS total, strftime(to_timestamp(min(timestamp)), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(to_timestamp(max(timestamp)), '%Y-%m-%d %H:%M:%S') AS newest FROM e GROUP BY 1")
def entry_stats(spark, sf_dir):
    """A1."""
    return E.stats(entries(spark, sf_dir))


@query(ENTRIES + "SELECT report_id, CASE severity WHEN 3 THEN 'error' WHEN 4 THEN 'warning' WHEN 5 THEN 'notice' WHEN 6 THEN 'info' ELSE 'debug' END AS severity_name, count(*) AS n FROM e GROUP BY 1, 2")
def severity_breakdown(spark, sf_dir):
    """A2, X6."""
    return E.severity_counts(entries(spark, sf_dir))


@query(ENTRIES + "SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY n DESC, type) AS rank FROM (SELECT report_id, type, count(*) AS n FROM e GROUP BY 1, 2)")
def type_breakdown(spark, sf_dir):
    """A3."""
    return E.type_counts(entries(spark, sf_dir))


@query(ENTRIES + r"""SELECT report_id, pattern, count(*) AS n, arg_min(type, (-timestamp, -wid)) AS type
FROM (SELECT *, regexp_replace(regexp_replace(message, '\b\d+\b', '[N]', 'g'), '/[a-zA-Z0-9/_-]+', '[PATH]', 'g') AS pattern FROM e WHERE severity = 4) GROUP BY 1, 2""")
def warning_patterns(spark, sf_dir):
    """F1, X3, A5."""
    return E.pattern_groups(E.by_severity(entries(spark, sf_dir), 4, 4))


@query(ENTRIES + """SELECT report_id, wid, rank, more FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY timestamp DESC, wid DESC) AS rank,
  greatest(count(*) OVER (PARTITION BY report_id) - 50, 0) AS more FROM e WHERE severity BETWEEN 0 AND 3) WHERE rank <= 50""")
def newest_errors(spark, sf_dir):
    """W8, O1."""
    return E.first_n(entries(spark, sf_dir), 0, 3, 50).select("report_id", "wid", "rank", "more")


@query(ENTRIES + "SELECT report_id, count(*) AS total, count(*) FILTER (severity <= 3) AS critical_count, count(*) FILTER (severity = 4) AS warning_count FROM e GROUP BY 1")
def report_totals(spark, sf_dir):
    """A4, F3."""
    return E.report_stats(entries(spark, sf_dir)).select("report_id", "total", "critical_count", "warning_count")


@query(ENTRIES + "SELECT time_bucket(INTERVAL 10 MINUTE, to_timestamp(timestamp)::TIMESTAMP) AS window_start, hostname, count(*) AS failures FROM e WHERE severity = 3 GROUP BY 1, 2 HAVING count(*) >= 2")
def repeated_failures(spark, sf_dir):
    """A14, T4's batch twin."""
    return E.repeated_failures(entries(spark, sf_dir), F.col("severity") == 3, 2)


def _part(no: int, title: str, rows: str, line: str, order: str, head: str = "''", tail: str = "''") -> str:
    """SQL of one section of the digest; ``rows`` names its table."""
    return (
        f"SELECT report_id, {no} AS part, '## {title}' || chr(10) || {head} || string_agg({line}, '' ORDER BY {order}) || {tail} || chr(10) AS text FROM {rows} GROUP BY report_id"
    )


_LEVEL = "CASE severity WHEN 3 THEN 'error' WHEN 4 THEN 'warning' WHEN 5 THEN 'notice' WHEN 6 THEN 'info' ELSE 'debug' END"
_AT = "strftime(to_timestamp({}), '%Y-%m-%d %H:%M:%S')"
_MORE = "CASE WHEN max({0}) > 0 THEN {2} || '... and ' || max({0}) || ' more {1}' || chr(10) ELSE '' END"
_GROUPED = "SELECT report_id, pattern, count(*) AS n, arg_min(type, (-timestamp, -wid)) AS type FROM p WHERE {} GROUP BY 1, 2"
DIGESTS = ENTRIES + (
    r", p AS (SELECT *, regexp_replace(regexp_replace(message, '\b\d+\b', '[N]', 'g'), '/[a-zA-Z0-9/_-]+', '[PATH]', 'g') AS pattern FROM e), "
    f"sev AS (SELECT report_id, severity, upper({_LEVEL}) AS name, count(*) AS n FROM e GROUP BY 1, 2, 3), typ AS (SELECT report_id, type, count(*) AS n FROM e GROUP BY 1, 2), "
    f"crit AS (SELECT *, row_number() OVER w AS r, greatest(count(*) OVER (PARTITION BY report_id) - 50, 0) AS more FROM e WHERE severity <= 3 WINDOW w AS (PARTITION BY report_id ORDER BY timestamp DESC, wid DESC) QUALIFY r <= 50), "
    f"note AS (SELECT *, row_number() OVER w AS r, greatest(count(*) OVER (PARTITION BY report_id) - 20, 0) AS more FROM e WHERE severity IN (5, 6) WINDOW w AS (PARTITION BY report_id ORDER BY timestamp DESC, wid DESC) QUALIFY r <= 20), "
    f"warn AS ({_GROUPED.format('severity = 4')}), acc AS ({_GROUPED.format(chr(39) + 'access denied' + chr(39) + ' = type')}), "
    f"miss AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY n DESC, pattern) AS r, sum(n) OVER (PARTITION BY report_id) AS total, greatest(count(*) OVER (PARTITION BY report_id) - 10, 0) AS more "
    f"FROM ({_GROUPED.format(chr(39) + 'page not found' + chr(39) + ' = type')}) QUALIFY r <= 10), parts AS ("
    f"SELECT report_id, 0 AS part, '## Summary Statistics' || chr(10) || 'Total entries: ' || count(*) || chr(10) || 'Time range: ' || {_AT.format('min(timestamp)')} || ' to ' || {_AT.format('max(timestamp)')} || chr(10) || chr(10) AS text FROM e GROUP BY report_id UNION ALL "
    + " UNION ALL ".join((
        _part(1, "Severity Breakdown", "sev", "'- ' || name || ': ' || n || chr(10)", "severity"), _part(2, "Entry Types", "typ", "'- ' || type || ': ' || n || chr(10)", "n DESC, type"),
        _part(3, "Critical/Error Entries (Full Detail)", "crit", f"'[' || {_AT.format('timestamp')} || '] ' || upper({_LEVEL}) || ' | ' || type || ' | ' || hostname || ' | /' || chr(10) || '  Message: ' || message || chr(10)", "r",
              tail=_MORE.format("more", "critical/error entries", "chr(10)")),
        _part(4, "Warning Entries", "warn", "'- [' || n || 'x] ' || type || ': ' || pattern || chr(10)", "n DESC, pattern"),
        _part(5, "Access/Permission Events", "acc", "'- [' || n || 'x] ' || pattern || chr(10)", "n DESC, pattern"),
        _part(6, "Page Not Found (404) Summary", "miss", "'- [' || n || 'x] ' || pattern || chr(10)", "r", "'Total 404 errors: ' || CAST(max(total) AS BIGINT) || chr(10)", _MORE.format("more", "unique 404 patterns", "''")),
        _part(7, "Recent Notice/Info Entries (Sample)", "note", f"'- [' || {_LEVEL} || '] ' || type || ': ' || CASE WHEN length(message) > 100 THEN substr(message, 1, 97) || '...' ELSE message END || chr(10)", "r",
              tail=_MORE.format("more", "notice/info entries", "''")),
    ))
    + ") "
)


@query(DIGESTS + "SELECT report_id, '=== DRUPAL WATCHDOG LOG ANALYSIS ===' || chr(10) || chr(10) || string_agg(text, '' ORDER BY part) AS content FROM parts GROUP BY 1")
def watchdog_digests(spark, sf_dir):
    """R1 with A1-A6, W8."""
    e = entries(spark, sf_dir)
    return E.digest(e.select("report_id").distinct(), e)


def _has(text: str, keywords) -> str:
    """SQL of "the lower-cased text holds a keyword"; keywords here hold nothing that patterns read otherwise."""
    return f"regexp_matches(lower({text}), '{'|'.join(keywords)}')"


def _cut(header: str, reports: str, high, medium, general: str) -> str:
    """SQL of ``sec``: the numbered sections of the texts ``t`` of a table keyed by ``id``, with their priorities."""
    return (
        f"cut AS (SELECT id, t, regexp_extract_all(t, '{header}', 1) AS names, string_split_regex(t, '{header}') AS bodies FROM {reports}), "
        f"named AS ({general} SELECT id, i - 1 AS no, names[i] AS name, regexp_replace(bodies[i + 1], '^[{SPACES}]+|[{SPACES}]+$', '', 'g') AS content "
        "FROM (SELECT *, unnest(generate_series(1, len(names))) AS i FROM cut WHERE len(names) > 0)), "
        f"sec AS (SELECT *, CASE WHEN {_has('name', high)} OR {_has('content', high)} THEN 1 WHEN {_has('name', medium)} THEN 2 ELSE 3 END AS priority FROM named), "
    )


def _folded(norm: str, least: int, suffix: str, closing: str) -> str:
    """SQL of ``g``: the lines ``a`` that collapsing leaves of every section of ``sec``."""
    return f"""l AS (SELECT id, no, name, priority, generate_subscripts(a, 1) AS line_no, unnest(a) AS line FROM (SELECT *, string_split(content, chr(10)) AS a FROM sec)),
n AS (SELECT *, {norm} AS norm, count(*) OVER (PARTITION BY id, no) AS lines FROM l),
c AS (SELECT *, row_number() OVER (PARTITION BY id, no, norm ORDER BY line_no) AS first, count(*) OVER (PARTITION BY id, no, norm) AS times FROM n),
k AS (SELECT id, no, name, priority, line_no, line || CASE WHEN lines > {least} AND norm <> '' AND times > 1 THEN {suffix} ELSE '' END AS line
  FROM c WHERE lines <= {least} OR norm = '' OR first = 1 {closing}),
g AS (SELECT id, no, name, priority, list(line ORDER BY line_no) AS a FROM k GROUP BY ALL), """


def _tokens(text: str) -> str:
    return TOKENS.replace("(t)", f"({text})").replace("(t,", f"({text},")


_GAPS = "[\\t\\n\\f\\r ]*"
_RATIOS = ", ".join(f"({level}, {priority}, CAST({ratio} AS DOUBLE))" for level, step in enumerate(S.LADDER, 1) for priority, ratio in enumerate(step, 1))
_OMITTED = "'[... ' || ({}) || ' more lines omitted for brevity ...]'"
_HEADING = f"chr(10) || '{S.HASHES} ' || name || ' {S.HASHES}' || chr(10)"
FITTED = (
    f"WITH r AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), hard AS (SELECT * FROM r WHERE {TOKENS} > 400), "
    + _cut(f"(?m)^#{{3,}}{_GAPS}(.+?){_GAPS}#{{3,}}$", "hard", T.HOST_HIGH, T.HOST_MEDIUM, "SELECT id, 0 AS no, 'General' AS name, t AS content FROM cut WHERE len(names) = 0 UNION ALL")
    + _folded(NORM, 10, "' (occurred ' || times || ' times)'", "UNION ALL SELECT DISTINCT id, no, name, priority, lines + 1, '' FROM c WHERE lines > 10")
    + f"""steps AS (SELECT id, no, name, level, ratio, a, CAST(greatest(ceil(len(a) * ratio), 1) AS BIGINT) AS k FROM g JOIN (VALUES {_RATIOS}) AS ladder(level, priority, ratio) USING (priority)),
made AS (SELECT id, level, string_agg({_HEADING} || CASE WHEN ratio >= 1 THEN array_to_string(a, chr(10)) ELSE array_to_string(a[1:k], chr(10)) || chr(10)
  || CASE WHEN k < len(a) THEN chr(10) || {_OMITTED.format('len(a) - k')} || chr(10) ELSE '' END END || chr(10), '' ORDER BY no) AS t FROM steps GROUP BY ALL),
won AS (SELECT id, min(level) AS level, arg_min(t, level) AS t FROM made WHERE {TOKENS} <= 400 GROUP BY id),
el AS (SELECT id, no, generate_subscripts(a, 1) AS line_no, unnest(a) AS raw, len(a) AS n FROM g WHERE id NOT IN (SELECT id FROM won)),
eb AS (SELECT *, regexp_replace(raw, '\\r+$', '') AS line, regexp_replace(raw, '^[{SPACES}]+|[{SPACES}]+$', '', 'g') = '' AS blank FROM el WHERE n > 6),
ep AS (SELECT *, {NORM} AS norm, CASE WHEN blank THEN NULL WHEN line_no <= 2 THEN 1 WHEN {_has('raw', T.HOST_ESSENTIAL)} THEN 2 WHEN line_no > n - 2 THEN 3 END AS phase FROM eb),
ek AS (SELECT *, row_number() OVER (PARTITION BY id, no, norm ORDER BY phase, line_no) AS once FROM ep WHERE phase IS NOT NULL),
ef AS (SELECT id, no, count(*) AS kept, string_agg(line, chr(10) ORDER BY phase, line_no) AS t FROM ek WHERE once = 1 GROUP BY ALL),
third AS (SELECT id, no, 1 AS kept, line AS t FROM eb WHERE line_no = 3 AND NOT blank AND (id, no) NOT IN (SELECT (id, no) FROM ef)),
es AS (SELECT g.id, g.no, name, CASE WHEN len(a) <= 6 THEN array_to_string(a, chr(10)) ELSE concat_ws(chr(10), coalesce(ef.t, third.t),
  CASE WHEN len(a) > coalesce(ef.kept, third.kept, 0) THEN {_OMITTED.format('len(a) - coalesce(ef.kept, third.kept, 0)')} END) END AS t
  FROM g LEFT JOIN ef USING (id, no) LEFT JOIN third USING (id, no) WHERE g.id NOT IN (SELECT id FROM won)),
et AS (SELECT id, string_agg({_HEADING} || t || chr(10), '' ORDER BY no) AS t FROM es GROUP BY id),
tl AS (SELECT id, generate_subscripts(a, 1) AS i, unnest(a) AS line, len(a) AS n FROM (SELECT id, string_split(t, chr(10)) AS a FROM et WHERE {TOKENS} > 400)),
ts AS (SELECT id, i, n, line, sum(strlen(line) + CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER w + {len(S.NOTICE) + 1} AS b,
  sum(len(regexp_extract_all(line, '[^{SPACES}]+'))) OVER w + {len(S.NOTICE.split())} AS w FROM tl WINDOW w AS (PARTITION BY id ORDER BY i)),
tc AS (SELECT id, string_agg(line, chr(10) ORDER BY i) || chr(10) || '{S.NOTICE}' AS t FROM ts WHERE i < n AND greatest(b // 4, floor(w / 0.75)) <= 400 GROUP BY id)
SELECT id AS report_id, CAST(0 AS INTEGER) AS level, t AS content FROM r WHERE id NOT IN (SELECT id FROM hard) UNION ALL SELECT id, level, t FROM won
UNION ALL SELECT id, 6, t FROM et WHERE {TOKENS} <= 400 UNION ALL SELECT et.id, 7, coalesce(tc.t, '{S.NOTICE}') FROM et LEFT JOIN tc USING (id) WHERE {_tokens('et.t')} > 400"""
)


@query(FITTED)
def fitted_reports(spark, sf_dir):
    """Every report brought to 400 tokens."""
    return S.fit_host_reports(doc_reports(spark, sf_dir), F.lit(400))


_CMS_STEP = " ".join(f"WHEN {priority} THEN CAST({ratio} AS DOUBLE)" for priority, ratio in enumerate(S.CMS_RATIOS, 1))


@query(
    DIGESTS + ", d AS (SELECT report_id AS id, '=== DRUPAL WATCHDOG LOG ANALYSIS ===' || chr(10) || chr(10) || string_agg(text, '' ORDER BY part) AS t FROM parts GROUP BY 1), "
    + _cut(f"(?m)^(?:##|===){_GAPS}(.+?){_GAPS}(?:===)?$", "d", T.CMS_HIGH, T.CMS_MEDIUM, "")
    + _folded(CMS_NORM, 5, "' (x' || times || ')'", "")
    + f"""heads AS (SELECT id, no, name, 1.0 AS ratio, string_split(content, chr(10)) AS a FROM sec WHERE priority = 1 UNION ALL SELECT id, no, name, CASE priority {_CMS_STEP} END, a FROM g WHERE priority > 1),
hk AS (SELECT *, CAST(greatest(ceil(len(a) * ratio), 1) AS BIGINT) AS k FROM heads),
ht AS (SELECT id, no, name, CASE WHEN ratio >= 1 THEN array_to_string(a, chr(10)) ELSE array_to_string(a[1:k], chr(10)) || chr(10)
  || CASE WHEN k < len(a) THEN chr(10) || '[... ' || (len(a) - k) || ' similar entries omitted ...]' || chr(10) ELSE '' END END AS t FROM hk),
w AS (SELECT id, string_agg(chr(10) || '## ' || name || chr(10) || t || chr(10), '' ORDER BY no) AS t FROM ht WHERE t <> '' GROUP BY id),
tell AS (SELECT id, t, list_filter(string_split(t, chr(10)), lambda x: starts_with(x, '##') OR starts_with(x, '===') OR {_has('x', T.CMS_ESSENTIAL)}) AS a FROM w)
SELECT d.id AS report_id, CASE WHEN tell.t IS NULL THEN '' WHEN {_tokens('tell.t')} <= 400 THEN tell.t
  ELSE array_to_string(a[1:40], chr(10)) || CASE WHEN len(a) > 40 THEN chr(10) || chr(10) || '[... truncated to 40 lines due to size limits ...]' ELSE '' END END AS content FROM d LEFT JOIN tell USING (id)"""
)
def fitted_digests(spark, sf_dir):
    """W6, P2, X5, A8 on the digests of R1."""
    return S.fit_cms_reports(watchdog_digests(spark, sf_dir), F.lit(400))


SUMMARIES = """WITH s AS (SELECT CAST(o_orderkey AS VARCHAR) AS summary_id, o_orderdate AS timestamp, o_orderpriority AS log_source_type, n_name AS site_name,
  o_orderstatus AS system_status, o_totalprice / 1e6 AS cost_usd FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) """


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).join(F.broadcast(read(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey"))
    return joined.select(
        F.col("o_orderkey").cast("string").alias("summary_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("log_source_type"),
        F.col("n_name").alias("site_name"), F.col("o_orderstatus").alias("system_status"), (F.col("o_totalprice") / 1e6).alias("cost_usd"),
    )


@query(SUMMARIES + """SELECT log_source_type, site_name, system_status, count(*) AS n, round(coalesce(sum(cost_usd), 0), 8) AS cost, grouping(log_source_type, site_name, system_status) AS scope
FROM s GROUP BY GROUPING SETS ((), (system_status), (log_source_type, site_name), (log_source_type, site_name, system_status))""")
def summary_statistics(spark, sf_dir):
    """A10."""
    return H.statistics(summaries(spark, sf_dir)).withColumn("cost", F.round("cost", 8))


@query(SUMMARIES + "SELECT summary_id, timestamp, log_source_type, site_name FROM s ORDER BY timestamp DESC, summary_id LIMIT 20")
def latest_summaries(spark, sf_dir):
    """O2: a top-k report."""
    return H.latest(summaries(spark, sf_dir), 20).select("summary_id", "timestamp", "log_source_type", "site_name")


@query(SUMMARIES + "SELECT summary_id, row_number() OVER (PARTITION BY log_source_type, site_name ORDER BY timestamp DESC, summary_id) AS no FROM s")
def numbered_summaries(spark, sf_dir):
    """W7."""
    return H.numbered(summaries(spark, sf_dir), ["log_source_type", "site_name"]).select("summary_id", "no")


@query(f"""WITH f AS (SELECT substr(p_type, 1, 4) AS prefix FROM part WHERE substr(p_type, 1, 1) NOT IN ('P', 'L') UNION SELECT p_type FROM part WHERE substr(p_type, -1, 1) IN ('Y', 'D')),
m AS (SELECT p_type, max(length(prefix)) AS longest FROM (SELECT DISTINCT p_type FROM part) t JOIN f ON starts_with(p_type, prefix) GROUP BY 1)
SELECT p_partkey, coalesce(CAST(longest AS DOUBLE), {L.FALLBACK[0]}) AS rate, longest IS NOT NULL AS known_model FROM part LEFT JOIN m USING (p_type)""")
def priced_models(spark, sf_dir):
    """Part types priced by the longest of their families: four letters, the whole type where it ends in Y or D, or none."""
    part = read(spark, sf_dir, "part")
    short = part.filter(~F.substring("p_type", 1, 1).isin("P", "L")).select(F.substring("p_type", 1, 4).alias("prefix"))
    whole = part.filter(F.substring("p_type", -1, 1).isin("Y", "D")).select(F.col("p_type").alias("prefix"))
    families = short.union(whole).distinct().select("prefix", *[F.length("prefix").cast("double").alias(r) for r in L.RATES])
    return L.with_prices(part.select("p_partkey", "p_type"), families, "p_type").select("p_partkey", F.col(L.RATES[0]).alias("rate"), "known_model")


@query(r"""SELECT conv_id, turn, regexp_replace(upper(role) || ': ' || text, '([\\_*\[\]()~`>#+\-=|{}.!:])', '\\\1', 'g') AS escaped FROM conversations""")
def escaped_turns(spark, sf_dir):
    """X20."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.escape_markup(F.concat(F.upper("role"), F.lit(": "), "text")).alias("escaped"))


@query(r"""SELECT conv_id, turn, regexp_replace(upper(role) || ': ' || text, '(?i)\b(ASSISTANT|HUMAN|USER|SYSTEM)[\t\n\f\r ]*:', '[FILTERED]', 'g') AS filtered FROM conversations""")
def filtered_turns(spark, sf_dir):
    """X11's filter on marked turns."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.filter_injections(F.concat(F.upper("role"), F.lit(": "), "text")).alias("filtered"))


_REDACTIONS = (
    "sk-ant-[a-zA-Z0-9_-]{10,}", "sk-[a-zA-Z0-9_-]{32,}", "[0-9]{8,12}:[a-zA-Z0-9_-]{30,}", "Bearer[\\t\\n\\f\\r ]+[a-zA-Z0-9_.-]+",
    "(?i)authorization[:\\t\\n\\f\\r ]+[^\\t\\n\\f\\r ]+", "(?i)api[_-]?key[=:][^\\t\\n\\f\\r &\"'']+", "(?i)x-api-key[:\\t\\n\\f\\r ]+[^\\t\\n\\f\\r ]+",
)


@query("SELECT doc_id, " + "regexp_replace(" * len(_REDACTIONS) + "'Bearer abc.def ' || coalesce(text, '') || ' api_key=xyz'" + "".join(f", '{p}', '[REDACTED]', 'g')" for p in _REDACTIONS) + " AS redacted FROM documents")
def redacted_texts(spark, sf_dir):
    """X8 on whole texts with a token put before and after."""
    put = F.concat(F.lit("Bearer abc.def "), F.coalesce("text", F.lit("")), F.lit(" api_key=xyz"))
    return read(spark, sf_dir, "documents").select("doc_id", T.redact(put).alias("redacted"))


def _head(text: str) -> str:
    """SQL of how many characters of a text fit into one part."""
    return f"list_max(list_filter(range({P.PART_BYTES // 4}, {P.PART_BYTES + 1}), lambda n: strlen(substr({text}, 1, n)) <= {P.PART_BYTES}))"


@query(f"""WITH RECURSIVE m AS (SELECT conv_id AS report_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1),
l AS (SELECT report_id, unnest(a) AS line, generate_subscripts(a, 1) AS no FROM (SELECT report_id, string_split(body, chr(10)) AS a FROM m WHERE strlen(body) > {P.PART_BYTES})),
c AS (SELECT report_id, no, 1 AS k, substr(line, 1, {_head('line')}) AS piece, substr(line, {_head('line')} + 1) AS rest FROM l WHERE strlen(line) >= {P.PART_BYTES}
  UNION ALL SELECT report_id, no, k + 1, substr(rest, 1, {_head('rest')}), substr(rest, {_head('rest')} + 1) FROM c WHERE rest <> ''),
s AS (SELECT report_id, no, 1 AS k, line || chr(10) AS piece, true AS packs FROM l WHERE strlen(line) < {P.PART_BYTES} UNION ALL SELECT report_id, no, k, piece, false FROM c),
i AS (SELECT report_id, piece, packs, strlen(piece) AS b, row_number() OVER (PARTITION BY report_id ORDER BY no, k) AS i FROM s),
g AS (SELECT report_id, i, packs, b AS held, 0 AS part_no FROM i WHERE i = 1 UNION ALL
  SELECT i.report_id, i.i, i.packs, CASE WHEN i.packs AND g.packs AND held + b <= {P.PART_BYTES} THEN held + b ELSE b END, CASE WHEN i.packs AND g.packs AND held + b <= {P.PART_BYTES} THEN part_no ELSE part_no + 1 END
  FROM g JOIN i ON i.report_id = g.report_id AND i.i = g.i + 1),
p AS (SELECT report_id, part_no, string_agg(piece, '' ORDER BY i) AS text FROM g JOIN i USING (report_id, i) GROUP BY 1, 2 UNION ALL SELECT report_id, 0, body FROM m WHERE strlen(body) <= {P.PART_BYTES})
SELECT report_id, unnest(['archive', 'alerts']) AS channel, part_no, text FROM p""")
def message_parts(spark, sf_dir):
    """Conversations as routed message parts."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("body"))
    return P.outbox(turns.select(F.col("conv_id").alias("report_id"), F.lit("Bad").alias("system_status"), "body"))
