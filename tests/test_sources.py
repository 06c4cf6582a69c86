import json

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import reports as R
from tallyloom.sources.store import SummaryStore


def one(spark, content, key="report_id"):
    return spark.createDataFrame([("r", content)], f"{key} string, content string")


ENTRY = {"wid": 1, "uid": 0, "type": "php", "message": "m", "severity": 3, "hostname": "h", "timestamp": 100}


def test_files_and_admission(spark, tmp_path):
    (tmp_path / "a.log").write_text("x" * 200)
    (tmp_path / "b.log").write_text("short")
    (tmp_path / "c.log").write_text("")
    with open(tmp_path / "huge.log", "wb") as f:
        f.truncate(2_200_000_000)  # more than a row can hold, so reading it would fail
    now = F.current_timestamp()
    assert {r.path.rsplit("/", 1)[-1]: r.size_bytes for r in R.profile(R.list_files(spark, str(tmp_path)), now).collect()}["a.log"] == 200
    name = lambda r: r.path.rsplit("/", 1)[-1]
    good, bad = R.admitted(spark, str(tmp_path), "logwatch", now)
    assert [(name(r), r.content, r.size_bytes) for r in good.collect()] == [("a.log", "x" * 200, 200)]
    assert {name(r): r.reason for r in bad.collect()} == {"b.log": "too short", "huge.log": "too large"}  # Spark lists no empty files
    assert good.rdd.getNumPartitions() == 1  # no task is made for the other files
    late = now + F.expr("INTERVAL 2 DAYS")
    good, bad = R.admitted(spark, str(tmp_path), "logwatch", late)
    assert good.count() == 0 and {name(r): r.reason for r in bad.collect()} == {"a.log": "older than 24 hours", "b.log": "older than 24 hours", "huge.log": "too large"}
    good, bad = R.admitted(spark, str(tmp_path), "drupal_watchdog", late)
    assert sorted(map(name, good.collect())) == ["a.log", "b.log"] and {r.reason for r in bad.collect()} == {"too large"}
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 99, 100, 11 << 20)], "size bigint")
    reasons = [r[0] for r in sizes.select(R.refusal(F.col("size"), now, "logwatch", now)).collect()]
    assert reasons == ["empty", "too short", "too short", None, "too large"]
    assert R.admitted(spark, str(tmp_path), "logwatch", now, 10_000 / 2**20)[0].count() == 1 and R.admitted(spark, str(tmp_path), "logwatch", now, 199 / 2**20)[0].count() == 0


def test_short_digests_pass_only_without_entries(spark):
    rows = spark.createDataFrame([("a", 0, "none"), ("b", 1, "short"), ("c", 1, "x" * 50)], "report_id string, n_entries long, content string")
    good, bad = R.admit_digests(rows)
    assert sorted(r.report_id for r in good.collect()) == ["a", "c"] and [(r.report_id, r.reason) for r in bad.collect()] == [("b", "too short")]


def test_several_files_of_a_report(spark):
    files = spark.createDataFrame([("/a", "main"), ("/b", "err")], "path string, content string")
    wanted = spark.createDataFrame([("two", 0, "main", "/a"), ("two", 1, "error", "/b"), ("one", 0, "main", "/a"), ("none", 0, "main", "/z")], "report_id string, pos int, kind string, path string")
    good, bad = R.labelled_union(files, wanted)
    got = {r.report_id: r.content for r in good.collect()}
    assert got["one"] == "main" and got["two"].index("MAIN LOG") < got["two"].index("ERROR LOG") and "Path: /b\n\nerr" in got["two"]
    assert [r.report_id for r in bad.collect()] == ["none"]


@pytest.mark.parametrize(
    ("content", "wids", "reason"),
    [
        (json.dumps([ENTRY, ENTRY | {"wid": 2}]), [1, 2], None), (json.dumps(ENTRY), [1], None), (json.dumps([{"wid": 5}]), [5], None),
        ("\n".join([json.dumps(ENTRY), "", "broken", json.dumps(ENTRY | {"wid": 3}) + ","]), [1, 3], None), ("[]", [], None), ("null", [], None),
        (json.dumps([ENTRY, {"wid": "text"}]), [], "no entries"), ("nothing", [], "no entries"), ("", [], "no entries"), (None, [], "no entries"),
        (json.dumps(ENTRY) + "\n" + "x" * (R.MAX_LINE_BYTES + 1), [], "a line is too long"), (json.dumps(ENTRY, indent=2), [1], None), ("[ ]", [], None), ('[{"wid": "x"},\n{"wid": 4}\n]', [4], None),
        ('[\n{"wid": "x"},\n{"wid": 4},\n]', [4], None), ('[{"wid": 1, "message": "a]},{\\"["}]', [1], None), ('[{"wid": 1}] x]', [], "no entries"), ('[{"wid": 1, "link": "open}]', [], "no entries"),
    ],
    ids=range(18),
)
def test_watchdog_json(spark, content, wids, reason):
    entries, rejects = R.parse_watchdog_json(one(spark, content))
    assert sorted(r.wid for r in entries.collect()) == wids
    assert [r.reason for r in rejects.collect()] == ([reason] if reason else [])


def test_a_long_array_is_split_without_holding_its_elements(spark, tmp_path):
    import tracemalloc

    text = ("[" + ",".join(json.dumps(ENTRY | {"wid": i, "message": "x" * 90}) for i in range(60_000)) + "]").encode()
    assert len(text) > 10_000_000
    tracemalloc.start()
    n = sum(1 for a, b in R.array_elements(text) if b > a)
    assert n == 60_000 and tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()
    (tmp_path / "array.json").write_bytes(text)
    given = spark.read.text(str(tmp_path), wholetext=True).select(F.lit("r").alias("report_id"), F.col("value").alias("content"))
    entries, rejects = R.parse_watchdog_json(given)
    assert tuple(entries.agg(F.count("*"), F.sum("wid"), F.countDistinct("entry_no")).first()) == (n, n * (n - 1) // 2, n)
    assert rejects.count() == 0


def test_reports_are_read_once_for_entries_and_rejects(spark):
    reads = spark.sparkContext.accumulator(0)

    def content(no):
        reads.add(1)
        entry = json.dumps(ENTRY | {"wid": no})
        return [f"[{entry}, {entry}]", f"{entry},\n{{broken\n{entry}", entry, "nothing"][no]

    given = spark.range(4).select(F.col("id").alias("report_id"), F.udf(content, "string")("id").alias("content"))
    entries, rejects = R.parse_watchdog_json(given)
    assert sorted((r.report_id, r.entry_no, r.wid) for r in entries.collect()) == [(0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 2, 1), (2, 0, 2)]
    assert [(r.report_id, r.reason) for r in rejects.collect()] == [(3, "no entries")]
    assert reads.value == 4


def test_flat_objects_are_passed_in_one_step():
    def held(text):
        return [p if p is None else text[p[0]:p[1]].strip() for p in R.array_elements(text)]

    assert sum(1 for _ in R._STRUCTURE.finditer(b'[{"a": "]}", "b": 2}, {"c": 1}]')) == 5
    assert held(b'[{"a": "]}\\"{", "b": 2}, 1, {"c": {"d": [2, "x"]}, "e": 1},\n{}]') == [b'{"a": "]}\\"{", "b": 2}', b"1", b'{"c": {"d": [2, "x"]}, "e": 1}', b"{}"]
    assert held(b'[{"a": 1}, {"b": "open}]') == [b'{"a": 1}', None] and held(b'[{"a": 1}}') == [b'{"a": 1}', None] and held(b'{"a": 1}') == [None]


def test_table_rows_by_the_one_word_rule(spark):
    rows = [
        "1  2024-01-02 03:04:05  php error PDO exception:  warning   foo", "2  2024-01-02 03:04:05  cron notice Run done.  Error count 0",
        "3  2024-01-02 03:04:05  php  error  a\rb", "4  2024-01-02 03:04:05  php  error  a\u2028b", "5  2024-13-02 03:04:05  php  error  x", "6  2024-01-02  03:04:05  php  error  x",
    ]
    entries, _ = R.parse_watchdog_table(one(spark, "ID\n" + "\n".join(rows)))
    got = {r.wid: (r.type, r.severity, r.message) for r in entries.collect()}
    assert got == {1: ("php", 3, "PDO exception:  warning   foo"), 2: ("cron", 5, "Run done.  Error count 0"), 3: ("php", 3, "a\rb"), 4: ("php", 3, "a\u2028b")}


def test_table_types_of_several_words(spark):
    rows = [
        "1  2024-01-02 03:04:05  page not found   info  view by  user", "2  2024-01-02 03:04:05  access denied   WARNING  x", "3  2024-01-02 03:04:05  page not found   odd  x",
        "4  2024-01-02 03:04:05 page not found  info  x", "5  2024-01-02 03:04:05  user error   warning  x", "6  2024-01-02 03:04:05  two  words  info  x",
    ]
    entries, _ = R.parse_watchdog_table(one(spark, "ID\n" + "\n".join(rows)))
    got = {r.wid: (r.type, r.severity, r.message) for r in entries.collect()}
    assert got == {
        1: ("page not found", 6, "view by  user"), 2: ("access denied", 4, "x"), 3: ("page", 5, "found   odd  x"),
        4: ("page", 5, "found  info  x"), 5: ("user", 3, "warning  x"), 6: ("two", 5, "info  x"),
    }


def test_missing_fields_are_zero(spark):
    row = R.parse_watchdog_json(one(spark, '[{"wid": 5, "message": "a\\\\b"}]'))[0].first()
    assert (row.uid, row.severity, row.timestamp, row.type, row.hostname, row.message) == (0, 0, 0, "", "", "a\\b")


def test_watchdog_table(spark):
    text = "9  2026-01-01 00:00:00  php  error  early\n ID  Date  Type  Severity  Message\n ----  ----\n 7   2026-01-02 03:04:05   access denied   warning   no way in\n 8  2026-01-02 03:04:06  cron  odd  done\n x  2026-01-02 03:04:06  cron  info  bad id\n 9  2026-13-02 03:04:06  cron  info  bad date\n11 2026-01-02 03:04:05 php error it broke\n ID again"
    entries, rejects = R.parse_watchdog_table(one(spark, text))
    assert sorted((r.wid, r.type, r.severity, r.message) for r in entries.collect()) == [(7, "access denied", 4, "no way in"), (8, "cron", 5, "done"), (11, "php", 3, "it broke")]
    assert rejects.count() == 0
    assert R.parse_watchdog_table(one(spark, " ID  Date"))[1].count() == 1


def test_keyed_export(spark):
    text = json.dumps({"5": {"wid": "5", "uid": "x", "type": "php", "severity": "Fehler", "timestamp": "10"}, "6": {"wid": "6", "severity": "?", "timestamp": None}})
    got = sorted((r.wid, r.uid, r.severity, r.timestamp) for r in R.parse_keyed_export(one(spark, text)).collect())
    assert got == [(5, 0, 3, 10), (6, 0, 5, None)]


def test_registry(spark):
    text = "# sites\na /srv/a user 8080 # main\nb /srv/b user\na /srv/c user 80\nc /srv/../c user 80\nd /srv/d user zero\ne /srv/e user 70000\n\nf\t/srv/f  user 1"
    good, bad = R.parse_registry(one(spark, text))
    assert sorted((r.site_id, r.port) for r in good.collect()) == [("a", 8080), ("f", 1)]
    assert {r.line_no: r.reason for r in bad.collect()} == {3: "not four fields", 4: "repeated id", 5: "path is not absolute and clean", 6: "bad port", 7: "bad port"}


CMS = {"drupal_root": "/d", "watchdog_path": "/w"}


def test_site_config_and_lookup(spark):
    text = json.dumps({"version": "1.0", "default_site": "a", "colour": 1, "sites": {"a": CMS | {"name": "A", "shape": [1]}, "b": CMS}})
    good, bad = R.parse_site_config(one(spark, text, "config_id"))
    assert sorted((r.site_id, r.format, r.display_name) for r in good.collect()) == [("a", "json", "A"), ("b", "json", "b")] and bad.count() == 0
    asked = spark.createDataFrame([("1", None), ("2", ""), ("3", "a"), ("4", "z")], "report_id string, site_id string")
    found, lost = R.with_site(asked, good)
    assert sorted(r.report_id for r in found.collect()) == ["1", "2", "3"] and [r.report_id for r in lost.collect()] == ["4"]
    assert sorted((r.site_id, r.is_default) for r in R.available_sites(good).collect()) == [("a", True), ("b", False)]


def test_a_fault_rejects_a_config_whole_with_all_reasons(spark):
    cases = {
        "sites": ({"sites": {"b": CMS | {"watchdog_format": "xml"}, "c": {"drupal_root": "/d"}, "d": CMS | {"min_severity": 9}, "e": CMS, "f": {}}},
                  [("b", "unknown format"), ("c", "no watchdog path"), ("d", "severity out of range"), ("f", "no drupal root")]),
        "none": ({"sites": {}}, [(None, "no sites")]), "default": ({"default_site": "q", "sites": {"a": CMS}}, [(None, "default site does not exist")]),
        "strange": ({"registry_path": "/r", "Version": "1", "sites": {"a": {"name": "A", "colour": 1}, "b.c": {"log_kind": "main", "Log": {"x": 1}}}, "extra": {"deep": 1}},
                    [(None, "unknown field: extra"), (None, "unknown field: sites.a.colour"), (None, "unknown field: sites.b.c.Log")]),
        "kind": ({"default_log_kind": "best", "sites": {"a": {}}}, [(None, "unknown log kind")]), "kinds": ({"sites": {"a": {"log_kind": "all"}, "b": {"log_kind": "odd"}}}, [("b", "unknown log kind")]),
        "fine": ({"registry_path": "/r", "sites": {"a": {"log_kind": "All"}, "b": {}}}, []),
    }
    texts = [(k, json.dumps(c)) for k, (c, _) in cases.items()] + [("broken", "{"), ("null", None)]
    good, bad = R.parse_site_config(spark.createDataFrame(texts, "config_id string, content string"))
    want = [(k, *r) for k, (_, rs) in cases.items() for r in rs] + [("broken", None, "does not parse"), ("null", None, "does not parse")]
    assert sorted(map(tuple, bad.collect()), key=str) == sorted(want, key=str)
    assert sorted((r.config_id, r.site_id) for r in good.collect()) == [("fine", "a"), ("fine", "b")]
    assert R.parse_site_config(spark.createDataFrame([("x", json.dumps({"sites": {"a": CMS}}))], "config_id string, content string"), "application")[1].count() == 2


@pytest.mark.parametrize(
    ("config", "reason"),
    [
        ({"version": "1.1", "global": ["a", " b"], "sites": {"s": ["c"]}}, None), ({"version": "2.0"}, "unknown version"), ({"version": "1.0", "ocms": [" "]}, "blank pattern"),
        ({"version": "1.0", "global": ["A", "a "]}, "repeated pattern"), ({"version": "1.0", "global": [str(i) for i in range(51)]}, "over 50 patterns"),
        ({"version": "1.2", "sites": {" ": ["x"]}}, "empty site id"), ({"global": ["a"]}, "does not parse"), ({"version": "1.0", "global": ["x" * 2**20]}, "over 1 MiB"),
    ],
    ids=range(8),
)
def test_exclusion_configs(spark, config, reason):
    good, bad = R.parse_exclusions(one(spark, json.dumps(config), "config_id"))
    assert [r.reason for r in bad.collect()] == ([reason] if reason else [])
    assert sorted((r.scope, r.site_id, r.pos, r.pattern) for r in good.collect()) == ([] if reason else [("global", "", 0, "a"), ("global", "", 1, " b"), ("site", "s", 0, "c")])


def test_summaries_are_stored_upgraded_and_expire(spark, tmp_path):
    path = f"{tmp_path}/summaries"
    old = spark.createDataFrame(
        [("2026-01-01T10:00:00Z", "s1", '["a"]', "", None), ("2026-03-01T10:00:00Z", "s2", "[]", "[]", "[]"), ("never", "s3", "[]", "[]", "[]"), ("2026-03-01T10:00:00Z", "s4", "{", "[]", "[]")],
        "timestamp string, summary string, critical_issues string, warnings string, recommendations string",
    )
    good, bad = R.upgrade_summaries(old)
    assert {r.summary: r.reason for r in bad.collect()} == {"s3": "bad timestamp", "s4": "bad JSON"}
    assert {r.summary: (r.critical_issues, r.warnings, r.log_source_type) for r in good.collect()} == {"s1": (["a"], [], "logwatch"), "s2": ([], [], "logwatch")}
    store = SummaryStore(spark, path).create()
    store.append(good)
    now = F.lit("2026-03-20 00:00:00").cast("timestamp")
    assert store.retain(now, 30) == 1
    assert [r.summary for r in store.read().collect()] == ["s2"]
    assert store.retain(now, 30) == 0
