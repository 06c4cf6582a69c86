import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tallyloom import extension
from tallyloom.functions import lookups as L
from tallyloom.operators import events, history, prompts, sections

HOST = "intro\n### Disk ###\nfull\n\n#### SSH ####\n" + "\n".join(f"login {i} from 10.0.0.{i}" for i in range(12))


def reports(spark, *contents):
    return spark.createDataFrame(list(enumerate(contents)), "report_id int, content string")


def test_sections_and_lines(spark):
    got = sorted((r.report_id, r.section_no, r.name, r.content) for r in sections.sections(reports(spark, HOST, "plain", None, "")).collect())
    assert [g[:3] for g in got] == [(0, 0, "Disk"), (0, 1, "SSH"), (1, 0, "General"), (2, 0, "General"), (3, 0, "General")]
    assert got[0][3] == "full" and got[2][3] == "plain"


def test_near_duplicate_lines_collapse(spark):
    lined = sections.lines(sections.sections(reports(spark, HOST)))
    out = sections.collapse_host(lined).filter("name = 'SSH'").orderBy("line_no").collect()
    assert [r.line for r in out] == ["login 0 from 10.0.0.0 (occurred 12 times)", ""]
    assert [r.line for r in sections.collapse_host(lined).filter("name = 'Disk'").collect()] == ["full"]


@pytest.mark.parametrize("budget", [1, 12, 40, 250])
def test_reports_fit_their_budget(spark, budget):
    text = "### A ###\n" + "\n".join(f"error number {i} in unit u{i % 7}x" for i in range(600)) + "\n### B ###\n" + "\n".join(f"note {chr(97 + i % 26)}{chr(97 + i // 26)} fine" for i in range(200))
    out = sections.fit_host_reports(reports(spark, text, "short", None), F.lit(budget)).collect()
    assert len(out) == 3
    from tallyloom.functions import text as T

    sizes = spark.createDataFrame(out).select(T.estimate_tokens(F.col("content")).alias("n")).collect()
    assert all(r.n <= budget for r in sizes)


def plain_ladder(text, budget):
    """W4 without Spark, for lines that differ in plain integers only: every step's text is made and measured."""
    import math
    import re

    from tallyloom.functions import text as T

    def tokens(t):
        return max(len(t.encode()) // 4, int(len(t.split()) / 0.75))

    def has(t, words):
        return any(k in t.lower() for k in words)

    def norm(line):
        return re.sub(r"\d+", "N", line.strip())

    def collapsed(lines):
        if len(lines) <= 10:
            return lines
        times = {}
        for x in lines:
            times[norm(x)] = times.get(norm(x), 0) + 1
        out, seen = [], set()
        for x in lines:
            if norm(x) and norm(x) not in seen:
                seen.add(norm(x))
                out.append(x + (f" (occurred {times[norm(x)]} times)" if times[norm(x)] > 1 else ""))
            elif not norm(x):
                out.append(x)
        return out + [""]

    def head(lines, ratio):
        if ratio >= 1:
            return "\n".join(lines)
        k = max(1, math.ceil(len(lines) * ratio))
        note = f"\n[... {len(lines) - k} more lines omitted for brevity ...]\n" if k < len(lines) else ""
        return "\n".join(lines[:k]) + "\n" + note

    def essential(lines):
        if len(lines) <= 6:
            return "\n".join(lines)
        out, seen = [], set()
        for x in lines[:2] + [x for x in lines if has(x, T.HOST_ESSENTIAL)] + lines[-2:]:
            x = x.rstrip("\r")
            if x.strip() and norm(x) not in seen:
                seen.add(norm(x))
                out.append(x)
        if not out and lines[2].strip():
            out = [lines[2].rstrip("\r")]
        return "\n".join(out + [f"[... {len(lines) - len(out)} more lines omitted for brevity ...]"] * (len(out) < len(lines)))

    def joined(parts):
        return "".join(f"\n{sections.HASHES} {name} {sections.HASHES}\n{body}\n" for name, body in parts)

    if tokens(text) <= budget:
        return 0, text
    secs = []
    for part in re.split(r"(?m)^### ", text)[1:]:
        name, body = part.split(" ###", 1)
        high = has(name, T.HOST_HIGH) or has(body, T.HOST_HIGH)
        secs.append((name, 1 if high else 2 if has(name, T.HOST_MEDIUM) else 3, collapsed(body.strip().split("\n"))))
    for level, ratios in enumerate(sections.LADDER, 1):
        made = joined((name, head(lines, ratios[p - 1])) for name, p, lines in secs)
        if tokens(made) <= budget:
            return level, made
    made = joined((name, essential(lines)) for name, _, lines in secs)
    return (6, made) if tokens(made) <= budget else (7, None)


def test_the_ladder_takes_the_step_and_text_of_a_plain_version(spark):
    def word(i):
        return chr(97 + i % 26) + chr(97 + i // 26 % 26)

    noisy = [f"unit {word(i)} said {i}" for i in range(60)]
    texts = [
        "### Kernel ###\n" + "\n".join(noisy) + "\n### Disk Space ###\n" + "\n".join(f"part {word(i)}" for i in range(40)),
        "### Notes ###\n" + "\n".join(["same 1", "same 2", "", "same 3"] * 5 + noisy[:30] + ["an error here 7", "an error here 8", "end"]) + "\n### Tail ###\nx",
        "### Ünï ###\n" + "\n".join(f"größe {word(i)} {i}\r" for i in range(25)),
        "### Blank ###\nfirst\n" + "\n" * 12 + "last",
    ]
    budgets = (5, 27, 31, 40, 60, 80, 130, 180, 200, 260, 350, 420, 500)
    cases = {i * 1000 + b: (text, b) for i, text in enumerate(texts) for b in budgets}
    made = spark.createDataFrame([(k, *case) for k, case in cases.items()], "report_id int, content string, budget int")
    got = {r.report_id: (r.level, r.content) for r in sections.fit_host_reports(made, F.col("budget")).collect()}
    assert got.keys() == cases.keys()
    for k, case in cases.items():
        level, content = plain_ladder(*case)
        assert got[k][0] == level, k
        assert content is None or got[k][1] == content, k
    assert {level for level, _ in got.values()} == set(range(8))


def test_essential_lines_count_from_what_collapsing_left(spark):
    text = "### A ###\n" + "\n".join(["one 1"] * 9 + ["b", "c", "d", "e", "f", "g", "h"])
    lines = ["one 1 (occurred 9 times)", "b", "h"]
    got = [r for r in sections.fit_host_reports(reports(spark, text, "### B ###\n\n\n\n\n\n\n\n"), F.lit(22)).collect() if r.report_id == 0]
    level, content = plain_ladder(text, 22)
    assert (got[0].level, content or got[0].content) == (level, got[0].content)
    listed = spark.createDataFrame([(0, 0, "A", i, x) for i, x in enumerate(["", "", "third 3\r", "", "", "", "", ""])], "report_id int, section_no int, name string, line_no int, line string")
    assert sections.essential_lines(listed).first().essential == "third 3\n[... 7 more lines omitted for brevity ...]"
    kept = spark.createDataFrame([(0, 0, "A", i, x) for i, x in enumerate([lines[0], "b", "c", "d", "e", "f", "g", "h", ""])], "report_id int, section_no int, name string, line_no int, line string")
    assert sections.essential_lines(kept).first().essential.split("\n") == [lines[0], "b", "h", "[... 6 more lines omitted for brevity ...]"]


def test_trimming_keeps_the_longest_head(spark):
    text = "\n".join(f"line {i}" for i in range(50))
    got = reports(spark, text, "a b").select("report_id", sections.trim_to_budget(F.col("content"), F.lit(40)).alias("t")).orderBy("report_id").collect()
    assert got[1].t == "a b" and got[0].t.startswith("line 0\nline 1\n") and got[0].t.endswith(sections.NOTICE)


ENTRY = "report_id string, wid bigint, uid bigint, type string, message string, severity int, hostname string, location string, timestamp bigint, site_id string"


def entries(spark, n=60):
    rows = [("r", i, 1, ["php", "access denied", "page not found", "cron"][i % 4], f"m {i} /p/{i}", [3, 4, 4, 6][i % 4], "h", "/", 1_767_225_600 + i, "s") for i in range(n)]
    return spark.createDataFrame(rows, ENTRY)


def test_digest_and_routing(spark):
    wanted = spark.createDataFrame([("r",), ("none",)], "report_id string")
    got = {r.report_id: r.content for r in events.digest(wanted, entries(spark)).collect()}
    assert got["none"] == events.NO_ENTRIES
    assert "Total entries: 60" in got["r"] and "- [30x] page not found: m [N] [PATH]" in got["r"] and "Total 404 errors: 15" in got["r"]
    routes = {r.report_id: (r.n_entries, r.route) for r in events.route_empty(wanted, entries(spark)).collect()}
    assert routes == {"r": (60, "analyse"), "none": (0, "inform")}


def test_daily_export_and_kpis(spark):
    day = F.lit("2026-01-01")
    assert [r.wid for r in events.daily_export(entries(spark), day, 3, 2).orderBy("rank").collect()] == [56, 52]
    assert events.daily_export(entries(spark), F.lit("2026-01-02")).count() == 0
    row = events.kpis(entries(spark)).first()
    assert (row.php_errors, row.error_count, row.not_found_count, row.access_denied, row.top_error_types, row.last_cron) == (15, 15, 15, 15, "php", "m 59 /p/59")


def test_prices(spark):
    prices = spark.createDataFrame([("m-1", 1.0, 2.0, 0.0, 0.0), ("m-1-big", 4.0, 8.0, 0.0, 0.0)], L.PRICE_SCHEMA)
    calls = spark.createDataFrame([("m-1-2026", 1_000_000), ("m-1-big-x", 1_000_000), ("other", 0), (None, 0)], "model string, n int")
    zero = F.lit(0)
    out = L.with_prices(calls, prices).withColumn("cost", L.call_cost(F.col("n"), zero, zero, zero)).collect()
    assert {r.model: (r.known_model, r.cost) for r in out} == {"m-1-2026": (True, 1.0), "m-1-big-x": (True, 4.0), "other": (False, 0.0), None: (False, 0.0)}


SUMMARY = "summary_id string, timestamp timestamp, log_source_type string, site_name string, system_status string, summary string, critical_issues array<string>, warnings array<string>, input_tokens int, output_tokens int, cost_usd double"


def test_history_and_costs(spark):
    at = lambda d: F.lit(f"2026-01-{d:02d} 08:00:00").cast("timestamp")
    row = lambda i, d, site="s": spark.range(1).select(
        F.lit(str(i)).alias("summary_id"), at(d).alias("timestamp"), F.lit("ocms").alias("log_source_type"), F.lit(site).alias("site_name"), F.lit("Good").alias("system_status"),
        F.lit(f"day {d}").alias("summary"), F.array(F.lit("c")).alias("critical_issues"), F.array().cast("array<string>").alias("warnings"), F.array().cast("array<string>").alias("recommendations"),
        F.lit(10).alias("input_tokens"), F.lit(5).alias("output_tokens"), F.lit(0.5).alias("cost_usd"),
    )
    kept = row(1, 1).union(row(2, 9)).union(row(3, 10)).union(row(4, 10, "t")).union(row(5, 12))
    asked = spark.range(2).select(F.when(F.col("id") == 0, "r").otherwise("q").alias("report_id"), F.lit("ocms").alias("source_type"), F.when(F.col("id") == 0, "s").otherwise("z").alias("site_id"), at(11).alias("run_time"))
    got = {r.report_id: r.history for r in history.history_block(asked, kept).collect()}
    assert got["q"] == "" and got["r"].startswith("Previous 2 analysis summaries:\n\n1. 2026-01-10") and "Critical Issues: 1" in got["r"] and "Warnings" not in got["r"]
    assert [(str(r.day), r.cost, r.n) for r in history.daily_costs(kept, 2).collect()] == [("2026-01-12", 0.5, 1), ("2026-01-10", 1.0, 2)]
    assert history.of_source(history.recent(kept, at(12), 2), "ocms", "s").count() == 2


def test_exclusions_and_prompts(spark):
    asked = spark.createDataFrame([("a", "logwatch", "", ""), ("b", "drupal_watchdog", "s", "Site")], "report_id string, source_type string, site_id string, site_name string")
    listed = spark.createDataFrame([("global", "", 0, "Noise"), ("drupal", "", 0, "Cron"), ("site", "s", 0, "own"), ("site", "t", 0, "not")] + [("logwatch", "", i, f"p{i}") for i in range(60)], "scope string, site_id string, pos int, pattern string")
    patterns = prompts.resolve_exclusions(asked, listed)
    assert {r["count"] for r in patterns.filter("report_id = 'a'").groupBy("report_id").count().collect()} == {51}
    assert sorted(r.pattern for r in patterns.filter("report_id = 'b'").collect()) == ["Cron", "Noise", "own"]
    found = spark.createDataFrame([("b", "some NOISE here"), ("b", "fine"), ("c", "noise")], "report_id string, text string")
    assert sorted(r.text for r in prompts.apply_exclusions(found, patterns).collect()) == ["fine", "noise"]
    blocks = prompts.exclusion_blocks(asked, patterns)
    none = asked.select("report_id", F.lit("").alias("history"))
    made = {r.report_id: r for r in prompts.prompts(asked, asked.select("report_id", F.lit("the log").alias("content")), none, blocks).collect()}
    assert "Site: Site" in made["b"].user_prompt and "- own" in made["b"].user_prompt and "- Noise" in made["b"].system_prompt and "the log" in made["a"].user_prompt


def plain_parts(message, limit):
    if len(message.encode()) <= limit:
        return [message]
    parts, now = [], ""
    for line in message.split("\n"):
        if len(line.encode()) < limit:
            if len((now + line).encode()) + 1 > limit:
                parts, now = [*parts, now], ""
            now += line + "\n"
            continue
        parts, now = [*parts, now] if now else parts, ""
        piece = ""
        for c in line:
            if len((piece + c).encode()) > limit:
                parts, piece = [*parts, piece], ""
            piece += c
        parts.append(piece)
    return [*parts, now] if now else parts


def test_messages_are_split_by_bytes_without_loss(spark):
    texts = ["", "short", "x" * 4096, "x" * 4097, "x" * 9000, "\n".join("é" * 700 for _ in range(9)), "a\n\nb", "é" * 5000, "a" + "é" * 5000 + "\nend", "b\n" + "🙂" * 3000,
             "\n" * 5000, "line\n" * 1500, "one\n" + "x" * 4095 + "\n" + "y" * 4096 + "\ntwo"]
    frame = spark.createDataFrame([(t,) for t in texts], "m string")
    out = [r.p for r in frame.select(prompts.message_parts(F.col("m")).alias("p")).collect()]
    assert all(len(p.encode()) <= prompts.PART_BYTES for parts in out for p in parts)
    assert out == [plain_parts(t, prompts.PART_BYTES) for t in texts]
    assert out_of(spark, "x" * 5000).p == ["x" * 4096, "x" * 904]
    # Nothing is lost or added but the line feed after the last line of a message that is split.
    assert all("".join(p).replace("\n", "") == t.replace("\n", "") for p, t in zip(out, texts, strict=True))


def out_of(spark, text):
    return spark.createDataFrame([(text,)], "m string").select(prompts.message_parts(F.col("m")).alias("p")).first()


def test_extension_points(spark):
    extension.register_defaults()
    assert extension.source("logwatch").fit is sections.fit_host_reports
    with pytest.raises(KeyError):
        extension.source("unheard")
    with pytest.raises(ValueError):
        extension.register("x", extension.SourceSpec(None, sections.fit_host_reports, "p"))
    extension.register_sql(spark)
    row = spark.sql("SELECT host_normal_form(' a 10.0.0.1 7 ') AS a, redact('Bearer abc') AS b, estimate_tokens('a b c d') AS c").first()
    assert tuple(row) == ("a IP N", "[REDACTED]", 5)


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """The entry module imports from any folder and registers the other queries where the subpackage is missing."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.modules['tallyloom.llm'] = None; sys.path.insert(0, {root!r}); import __spark_entry__ as e; q = e.queries(); assert 'collapse_lines' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)


def test_every_report_query_runs(spark):
    import __spark_entry__
    from tallyloom import registry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    known = __spark_entry__.queries()
    empty = [name for name in registry.QUERIES if not known[name](spark, folder).count()]
    assert set(empty) <= {"repeated_failures", "failure_windows"}  # the smallest table need not hold a burst


def test_patterns_of_a_scope_meet_texts_by_automata_or_by_joins(spark):
    import random

    rng = random.Random(3)
    bits = ["Disk", "disk full", "éa", "É", "php", "a", "zz", "full"]
    lists = {n: sorted(rng.sample(bits, 3)) for n in ("global", "logwatch", "drupal", "site/1", "site/2")} | {"global": ["ZZ"]}
    listed = [(n.split("/")[0], n.split("/")[1] if "/" in n else "", i, p) for n, ps in lists.items() for i, p in enumerate(ps)] + [("ocms", "", i, f"p{i}") for i in range(60)]
    patterns = prompts.scoped_patterns(spark.createDataFrame(listed, "scope string, site_id string, pos int, pattern string"))
    assert patterns.filter("name = 'ocms'").count() == prompts.MOST_PATTERNS
    kinds = [("logwatch", "1"), ("drupal_watchdog", "1"), ("drupal_watchdog", "2"), ("drupal_watchdog", None), ("ocms", "1"), (None, None)]
    rows = [(i, *rng.choice(kinds), " ".join(rng.choice([*bits, "x", "P7", "p55"]) for _ in range(rng.randint(0, 3)))) for i in range(300)] + [(300, "ocms", "1", None)]
    findings = spark.createDataFrame([(*r, 1) for r in rows], "id int, source string, site string, text string, `a.b` int")
    scopes = prompts.scopes_of(F.col("source"), F.col("site"))
    lists["ocms"] = [f"p{i}" for i in range(50)]

    def stays(source, site, text):
        own = {"drupal_watchdog": "drupal"}.get(source, source)
        names = ["global", own] + ([f"site/{site}"] if own == "drupal" and site else [])
        return text is None or not any(p.lower() in text.lower() for n in names for p in lists.get(n, []))

    want = [i for i, *r in rows if stays(*r)]
    assert 0 < len(want) < 300
    for most in (1 << 20, 0):
        kept = prompts.without_excluded(findings, patterns, scopes, shipped_bytes=most)
        assert kept.columns == findings.columns and sorted(r.id for r in kept.collect()) == want


def test_calls_of_few_models_are_not_dealt_by_model(spark):
    calls = spark.createDataFrame([(i, L.PRICES[0][0] if i % 2 else "other") for i in range(10)], "n int, model string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        priced = L.with_prices(calls, L.price_table(spark))
        assert [r.known_model for r in priced.orderBy("n").collect()] == [bool(i % 2) for i in range(10)]
        assert "SortMergeJoin" not in priced._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_what_a_task_of_collapsing_sorts_does_not_grow_by_coalescing(spark):
    secs = spark.createDataFrame([("r", 0, "a\n" * 12)], "report_id string, section_no int, content string")
    plan = sections.collapse_host(sections.lines(secs))._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_trimming_cuts_only_the_lines_that_can_fit(spark):
    texts = ["ä" * 30 + "\n" + "b\n" * 40, "x\n" * 500, "a" * 5000, "one line", "w " * 40 + "\n" + "v", "\n" * 300, "a" * 200 + "\n" + "b" * 3 + "\n" + "c" * 3000]
    df = spark.createDataFrame([(t, b) for t in texts for b in (-1, 0, 1, 10, 11, 20, 60, 61)], "t string, b int")

    def tokens(s):
        return max(len(s.encode()) // 4, int(len(s.split()) / 0.75))

    def plain(t, b):
        if b <= 0 or tokens(t) <= b:
            return t
        lines = t.split("\n")
        fit = [k for k in range(1, len(lines)) if tokens("\n".join(lines[:k]) + "\n" + sections.NOTICE) <= b]
        return "\n".join(lines[: fit[-1]]) + "\n" + sections.NOTICE if fit else sections.NOTICE if tokens(sections.NOTICE) <= b else ""

    made = df.select("t", "b", sections.trim_to_budget(F.col("t"), F.col("b")).alias("out"))
    for r in made.collect():
        assert r.out == plain(r.t, r.b), (r.t[:20], r.b)
    assert "substring(t" in made._jdf.queryExecution().toString()
