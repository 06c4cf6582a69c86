"""Reading report files, watchdog exports, site registries, site and exclusion configs, and stored summaries.

Every scan returns good rows and a table of rejects with reasons; nothing is
collected to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.functions import lookups as L
from tallyloom.functions import text as T
from tallyloom.workspace import written

MAX_LINE_BYTES = 10 * 1024 * 1024
LEAST_BYTES = {"logwatch": 100, "drupal_watchdog": 50, "ocms": 1}
NUMBERS = {"wid": "bigint", "uid": "bigint", "severity": "int", "timestamp": "bigint"}
TEXTS = ("type", "message", "variables", "link", "location", "referer", "hostname")
#: Elements of an array, and their bytes, that are handed on together.
ELEMENTS, ELEMENT_BYTES = 4096, 4 << 20
EXCLUSION_SCOPES = ("global", "logwatch", "drupal", "ocms")
VERSIONS = ("1.0", "1.1", "1.2")


def scan_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row per file: ``(path, content, size_bytes, modified)``."""
    meta = "_metadata"
    return spark.read.text(paths, wholetext=True).select(
        F.col(f"{meta}.file_path").alias("path"), F.col("value").alias("content"),
        F.col(f"{meta}.file_size").alias("size_bytes"), F.col(f"{meta}.file_modification_time").alias("modified"),
    )


def profile(files: DataFrame, now: Column) -> DataFrame:
    """S3: sizes and ages."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("modified")) / 3600
    return files.select("path", "size_bytes", (F.col("size_bytes") / 1048576.0).alias("size_mb"), "modified", age.alias("age_hours"))


def list_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(path, size_bytes, modified)`` of files, by their metadata alone: no file is opened. Spark leaves empty files out of every scan, this one too."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def _limits(source_type: str, now: Column, max_mb: float) -> tuple[int, Column | None, int]:
    """The most bytes, the oldest time if there is one, and the least bytes that metadata can judge.

    What a watchdog file must hold is said of the digest made of it (``admit_digests``), not of the file.
    """
    watchdog = source_type == "drupal_watchdog"
    return int(max_mb * 1024 * 1024), None if watchdog else now - F.expr("INTERVAL 24 HOURS"), 1 if watchdog else LEAST_BYTES[source_type]


def refusal(size: Column, modified: Column, source_type: str, now: Column, max_mb: float = 10) -> Column:
    """Why a file is not admitted, by its metadata; the first failing check gives the reason, null admits."""
    most, oldest, least = _limits(source_type, now, max_mb)
    stale = F.lit(False) if oldest is None else modified < oldest
    return F.when(size > most, "too large").when(stale, "older than 24 hours").when(size == 0, "empty").when(size < least, "too short")


def admitted(spark: SparkSession, paths: list[str] | str, source_type: str, now: Column, max_mb: float = 10) -> tuple[DataFrame, DataFrame]:
    """``(reports, rejects)`` of files: listed first, and only those admitted are read.

    The limits on size and time are conditions on the metadata of the scan itself,
    so Spark leaves other files out of its listing and makes no task for them.
    ``now`` must be a constant. Rejects carry path, size and reason.
    """
    listed = list_files(spark, paths).withColumn("reason", refusal(F.col("size_bytes"), F.col("modified"), source_type, now, max_mb))
    most, oldest, least = _limits(source_type, now, max_mb)
    size, modified = F.col("_metadata.file_size"), F.col("_metadata.file_modification_time")
    files = spark.read.text(paths, wholetext=True).filter((size <= most) & (size >= least))
    if oldest is not None:
        files = files.filter(modified >= oldest)
    read = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), size.alias("size_bytes"), modified.alias("modified"))
    return read, listed.filter("reason is not null").select("path", "size_bytes", "reason")


def admit_digests(digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S2 for watchdog reports: ``(digests, rejects)`` of ``(report_id, n_entries, content)``: short ones pass only if there are no entries."""
    short = (F.octet_length("content") < LEAST_BYTES["drupal_watchdog"]) & (F.col("n_entries") > 0)
    return digests.filter(~short), digests.filter(short).select("report_id", F.lit("too short").alias("reason"))


def labelled_union(files: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reports, rejects)``: the files of a report in order, each under its label unless it is alone.

    ``wanted``: ``(report_id, pos, kind, path)``. Missing files are skipped; a
    report of which all are missing is rejected.
    """
    found = wanted.join(files.select("path", "content"), "path", "left")
    label = F.concat(F.lit("### OCMS "), F.upper("kind"), F.lit(" LOG\nPath: "), "path", F.lit("\n\n"), "content")
    per = found.groupBy("report_id").agg(
        F.count("*").alias("asked"), F.count("content").alias("there"), F.max("content").alias("only"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("pos", label.alias("t"))))), lambda s: s["t"]), "\n\n").alias("all"),
    )
    return (
        per.filter("there > 0").select("report_id", F.when(F.col("asked") == 1, F.col("only")).otherwise(F.col("all")).alias("content")),
        per.filter("there = 0").select("report_id", F.lit("all files are missing").alias("reason")),
    )


def entry_fields(value: Column, more: tuple[str, ...] = ()) -> Column:
    """Zero values for missing fields, from a struct of variants (``variants``); ``more`` names further texts."""
    numbers = [F.coalesce(F.try_variant_get(value[c], "$", t), F.lit(0)).cast(t).alias(c) for c, t in NUMBERS.items()]
    texts = [F.coalesce(F.try_variant_get(value[c], "$", "string"), F.lit("")).alias(c) for c in (*TEXTS, *more)]
    return F.struct(*numbers, *texts)


def well_typed(value: Column, more: tuple[str, ...] = ()) -> Column:
    """False where a field holds a value of another type; such an entry does not parse."""
    def kind(c: str) -> Column:
        return F.coalesce(F.schema_of_variant(value[c]), F.lit("VOID"))

    numbers = [kind(c).isin("BIGINT", "VOID") for c in NUMBERS]
    return reduce(lambda a, b: a & b, [*numbers, *(kind(c).isin("STRING", "VOID") for c in (*TEXTS, *more))])


def variants(value: Column, more: tuple[str, ...] = ()) -> Column:
    """The fields of an entry, each as a variant, from a JSON object that is parsed already."""
    return F.struct(*[F.try_variant_get(value, f"$.{c}", "variant").alias(c) for c in (*NUMBERS, *TEXTS, *more)])


def with_entry(texts: DataFrame, text: Column, more: tuple[str, ...] = ()) -> DataFrame:
    """``texts`` with ``ok``, whether ``text`` is one entry, an object whose fields have their types, and ``e``, its fields or null.

    A text is parsed once, into a column that all fields are taken from; a null text is no entry.
    """
    parsed = texts.withColumn("v", F.when(text.startswith("{"), F.try_parse_json(text))).withColumn("e", variants(F.col("v"), more))
    judged = parsed.withColumn("ok", F.col("v").isNotNull() & well_typed(F.col("e"), more))
    return judged.withColumn("e", F.when(F.col("ok"), entry_fields(F.col("e"), more))).drop("v")


_STRING = rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: An object that holds no other, a string, or one mark.
_STRUCTURE = re.compile(rb'\{(?:[^"\[\]{}]++|' + _STRING + rb')*+\}|' + _STRING + rb'|[\[\]{},"]', re.DOTALL)


def array_elements(text: bytes) -> Iterator[tuple[int, int] | None]:
    """Where the elements of a JSON array begin and end, one after the other; ``None`` at last if it is no whole array.

    Only brackets, commas and strings are looked at, and flat objects within an array are
    passed in one step. What an element holds is for its parser to judge.
    """
    depth, begin, some = 0, 0, False
    for m in _STRUCTURE.finditer(text):
        c, long = text[m.start()], m.end() - m.start() > 1
        if c == 123 and long:
            if depth == 0:
                break
        elif c in b"[{":
            depth += 1
            if depth == 1:
                begin = m.end()
        elif c in b"]}":
            depth -= 1
            if depth == 0:
                if some or text[begin:m.start()].strip():
                    yield begin, m.start()
                if text[m.end():].strip() or c != 93:
                    yield None
                return
        elif c == 44 and depth == 1:
            some = True
            yield begin, m.start()
            begin = m.end()
        elif c == 34 and not long:
            break
    yield None


def split_reports(shaped: DataFrame) -> DataFrame:
    """``(report_id, shape, entry_no, piece)`` of ``(report_id, shape, body)``: an array's elements, an object whole, lines, or nothing.

    One piece after the other leaves the text, a few megabytes at a time, so an
    array is never held in parsed form. A body that is no whole array ends with a piece that is null.
    """
    def pieces(shape: str, text: bytes) -> Iterator[bytes | None]:
        if shape == "array":
            return (None if place is None else text[place[0]:place[1]] for place in array_elements(text))
        return iter({"none": [], "object": [text]}[shape] if shape != "lines" else text.split(b"\n"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                for no, piece in enumerate(pieces(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())):
                    held.append((i, no, piece))
                    size += 0 if piece is None else len(piece)
                    if len(held) == ELEMENTS or size > ELEMENT_BYTES:
                        yield made(batch, held)
                        held, size = [], 0
            if held:
                yield made(batch, held)

    def made(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        places, numbers, texts = zip(*held)
        known = pa.array(places, pa.int32())
        columns = [batch.column(0).take(known), batch.column(1).take(known), pa.array(numbers, pa.int32()), pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["report_id", "shape", "entry_no", "piece"])

    given = shaped.select("report_id", "shape", F.col("body").cast("binary").alias("body"))
    split = given.mapInArrow(rows, f"report_id {given.schema['report_id'].dataType.simpleString()}, shape string, entry_no int, piece binary")
    return split.withColumn("piece", T.trimmed(F.col("piece").cast("string")))


def _read_pieces(shaped: DataFrame) -> DataFrame:
    """``(report_id, shape, entry_no, ok, too_long, e)``: every piece parsed once and stored, as entries, faults and rejects are all told from it."""
    lined = F.col("shape") == "lines"
    piece = F.when(lined & F.col("piece").endswith(","), F.substring("piece", F.lit(1), F.length("piece") - 1)).otherwise(F.col("piece"))
    pieces = split_reports(shaped).withColumn("too_long", lined & (F.octet_length("piece") > MAX_LINE_BYTES))
    read = with_entry(pieces.withColumn("text", F.when(~F.col("too_long"), piece)), F.col("text"))
    return written(read.select("report_id", "shape", "entry_no", "ok", "too_long", "e"), "entries")


def parse_watchdog_json(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entries, rejects)`` of ``(report_id, content)``: an array, else one object, else one object per line.

    An array of which any element is no entry is read by lines, as is an object with
    a field of another type. Lines that do not parse are dropped; a line over 10 MiB
    or no entry at all rejects the report. ``null`` and ``[]`` hold no entries.
    """
    body = reports.select("report_id", T.trimmed(F.coalesce("content", F.lit(""))).alias("body"))
    first = F.regexp_extract("body", r"(?d)\A\s*(.*)", 1)
    by_line = (F.instr("body", "\n") > 0) & first.rlike(r"^\{.*\},?\s*$") & F.try_parse_json(F.regexp_replace(first, r",\s*$", "")).isNotNull()
    lone = F.col("body").startswith("{") & F.coalesce(well_typed(variants(F.try_parse_json("body"))), F.lit(False)) & F.try_parse_json("body").isNotNull()
    shape = (
        F.when(F.col("body") == "null", "none").when(F.col("body").startswith("[") & F.col("body").endswith("]"), "array")
        .when(~by_line & lone, "object").otherwise("lines")
    )
    shaped = body.select("report_id", shape.alias("shape"), "body")  # not filtered, as a filter would make body and shape a second time
    read = _read_pieces(shaped)
    faulty = (F.col("shape") == "array") & ~F.col("ok")
    n_faulty, n_long = read.agg(F.count_if(faulty), F.count_if("too_long")).first()
    if n_faulty:
        broken = read.filter(faulty).select("report_id").distinct()
        again = _read_pieces(shaped.filter("shape = 'array'").join(broken, "report_id", "left_semi").select("report_id", F.lit("lines").alias("shape"), "body"))
        arrays = read.filter("shape = 'array'").join(broken, "report_id", "left_anti").select(*read.columns)
        read, n_long = read.filter("shape <> 'array'").union(arrays).union(again), n_long + again.filter("too_long").count()
    good = read.filter("ok")
    if n_long:
        lines = good.filter("shape = 'lines'").join(read.filter("too_long").select("report_id").distinct(), "report_id", "left_anti").select(*read.columns)
        good = good.filter("shape <> 'lines'").union(lines)
    told = read.filter("shape = 'lines'").groupBy("report_id").agg(F.bool_or("ok").alias("some"), F.bool_or("too_long").alias("too_long"))
    reason = F.when(F.col("too_long"), "a line is too long").when(~F.col("some"), "no entries")
    return good.select("report_id", "entry_no", "e.*"), told.select("report_id", reason.alias("reason")).filter("reason is not null")


def parse_watchdog_table(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entries, rejects)`` of tables with columns id, date, type, severity and message.

    Fields are parted by white space: type and severity are one word each, the
    message is the rest of its line. Where the second word is no severity, a type of
    several words with single blanks in it is taken if two blanks and more part it
    from its date and from a known severity. Lines up to the first header or rule
    line are ignored, and so are later ones; lines with a bad id or date are dropped;
    an unknown severity name counts as notice.
    """
    known = rf"(?i:{'|'.join(L.SEVERITIES)})\s"
    kind = rf"\S+(?=\s+{known})|(?<=\s\s)\S+(?:\s\S+)+(?=\s{{2,}}{known})|\S+"
    row = rf"(?ds)\A(\d+)\s+(\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}})\s+({kind})\s+(\S+)\s+(.*)\z"
    rows = reports.select("report_id", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line")).withColumn("line", T.trimmed(F.col("line")))
    header = F.col("line").startswith("ID") | F.col("line").startswith("---")
    head = F.when(header, F.col("line_no"))
    body = rows.withColumn("start", F.min(head).over(W.partitionBy("report_id"))).filter(~header & (F.col("line_no") > F.col("start")))
    part = lambda i: F.regexp_extract("line", row, i)
    level = L.severity_level(F.lower(part(4)))
    entries = body.select(
        "report_id", F.col("line_no").alias("entry_no"), part(1).try_cast("bigint").alias("wid"),
        F.unix_timestamp(F.try_to_timestamp(part(2), F.lit("yyyy-MM-dd HH:mm:ss"))).alias("timestamp"), part(3).alias("type"),
        F.when(level < 0, 5).otherwise(level).alias("severity"), part(5).alias("message"),
    ).filter("wid is not null and timestamp is not null")
    return entries, reports.join(entries, "report_id", "left_anti").select("report_id", F.lit("no entries").alias("reason"))


def parse_keyed_export(exports: DataFrame) -> DataFrame:
    """Entries of ``{wid: entry}`` objects; numeric strings become numbers, labels become levels by X7."""
    entry = "struct<wid:string,uid:string,type:string,message:string,severity:string,location:string,hostname:string,timestamp:string,date:string>"
    rows = exports.select("report_id", F.explode(F.map_values(F.from_json("content", f"map<string,{entry}>"))).alias("e"))
    number = lambda c: F.col(f"e.{c}").try_cast("bigint")
    return rows.select(
        "report_id", number("wid").alias("wid"), F.coalesce(number("uid"), F.lit(0)).alias("uid"), "e.type", "e.message",
        L.label_level(F.col("e.severity")).alias("severity"), F.col("e.severity").alias("severity_label"), "e.location", "e.hostname",
        number("timestamp").alias("timestamp"), "e.date",
    )


def parse_registry(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sites, rejects)`` of ``(report_id, content)``: four fields a line, ``#`` starts a comment."""
    rows = texts.select("report_id", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    rows = rows.withColumn("line", T.trimmed(F.regexp_replace("line", r"(?d)#.*", ""))).filter("line <> ''").withColumn("f", F.split("line", rf"[{T.SPACE}]+"))
    rows = rows.withColumns({"site_id": F.get("f", F.lit(0)), "directory": F.get("f", F.lit(1)), "user": F.get("f", F.lit(2)), "port": F.get("f", F.lit(3)).try_cast("int")})
    nth = F.row_number().over(W.partitionBy("report_id", "site_id").orderBy("line_no"))
    clean = F.col("directory").startswith("/") & ~F.col("directory").rlike(r"(^|/)\.{1,2}(/|$)|//|.+/$")
    reason = (
        F.when(F.size("f") != 4, "not four fields").when(nth > 1, "repeated id").when(F.col("port").isNull() | ~F.col("port").between(1, 65535), "bad port")
        .when(~clean, "path is not absolute and clean")
    )
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason is null").select("report_id", "site_id", "directory", "user", "port"), marked.filter("reason is not null").select("report_id", "line_no", "reason")


# The fields of the two site configurations; a star stands for any site id.
CMS_FIELDS = (
    "version", "default_site", "sites", "sites.*", "sites.*.name", "sites.*.drupal_root", "sites.*.watchdog_path",
    "sites.*.watchdog_format", "sites.*.min_severity", "sites.*.watchdog_limit",
)
APPLICATION_FIELDS = ("version", "default_site", "registry_path", "default_log_kind", "sites", "sites.*", "sites.*.name", "sites.*.log_kind")


def json_fields(configs: DataFrame, depth: int, any_key: tuple[str, ...] = (), within: tuple[str, ...] | None = None) -> DataFrame:
    """``(config_id, path, rule)``: every field of JSON objects down to ``depth``, found by walking the keys of a VARIANT.

    ``path`` names the field, ``rule`` is the path with a star for keys right under
    a path of ``any_key``. Arrays are not entered, and of fields only those whose rule
    is in ``within``, if that is given; text that is no JSON has no fields.
    """
    level = configs.select("config_id", F.lit("").alias("path"), F.lit("").alias("rule"), F.try_parse_json("content").alias("value"))
    found = []
    for _ in range(depth):
        objects = level.filter(F.schema_of_variant("value").startswith("OBJECT"))
        inner = objects.lateralJoin(configs.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("pos", "key", "inside"))
        dotted = lambda c, key: F.concat(F.when(F.col(c) != "", F.concat(F.col(c), F.lit("."))).otherwise(""), key)
        key = F.when(F.col("rule").isin(*any_key), F.lit("*")).otherwise(F.col("key"))
        level = inner.select("config_id", dotted("path", F.col("key")).alias("path"), dotted("rule", key).alias("rule"), F.col("inside").alias("value"))
        found.append(level.select("config_id", "path", "rule"))
        level = level if within is None else level.filter(F.lower("rule").isin(*within))
    return reduce(DataFrame.union, found)


def unknown_fields(configs: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """``(config_id, path)`` of fields outside ``allowed``, whose names count in any case; what they hold is not looked at."""
    fields = json_fields(configs, max(a.count(".") for a in allowed) + 1, tuple(a[:-2] for a in allowed if a.endswith(".*")), allowed)
    return fields.filter(~F.lower("rule").isin(*allowed)).select("config_id", "path")


def parse_site_config(configs: DataFrame, shape: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(sites, rejects)`` of ``(config_id, content)``: the CMS shape, or the application shape, which knows its fields.

    ``shape`` is ``cms`` or ``application``; without one a config that names a
    registry or a log kind is of the application shape. Any fault rejects a config
    whole, each with its reason: unknown fields (application shape only) with their
    path, no sites, an unknown default site, and faults of sites under their id.
    """
    site = "struct<name:string,drupal_root:string,watchdog_path:string,watchdog_format:string,min_severity:int,watchdog_limit:int,log_kind:string>"
    read = configs.withColumn("c", F.from_json("content", f"struct<version:string,default_site:string,registry_path:string,default_log_kind:string,sites:map<string,{site}>>"))
    kinds = F.coalesce(F.exists(F.map_values("c.sites"), lambda s: s["log_kind"].isNotNull()), F.lit(False))
    guessed = F.col("c.registry_path").isNotNull() | F.col("c.default_log_kind").isNotNull() | kinds
    read = read.withColumn("application", F.coalesce(guessed, F.lit(False)) if shape is None else F.lit(shape == "application"))
    top = (
        F.when(F.try_parse_json("content").isNull() | F.col("c").isNull(), "does not parse").when(F.col("c.sites").isNull() | (F.size("c.sites") == 0), "no sites")
        .when((F.coalesce("c.default_site", F.lit("")) != "") & ~F.coalesce(F.map_contains_key("c.sites", F.col("c.default_site")), F.lit(False)), "default site does not exist")
        .when(F.col("application") & L.log_kind(F.coalesce("c.default_log_kind", F.lit(""))).isNull(), "unknown log kind")
    )
    faulty = read.select("config_id", F.lit(None).cast("string").alias("site_id"), top.alias("reason")).filter("reason is not null")
    strange = unknown_fields(read.filter("application").select("config_id", "content"), APPLICATION_FIELDS)
    strange = strange.select("config_id", F.lit(None).cast("string").alias("site_id"), F.concat(F.lit("unknown field: "), "path").alias("reason"))
    rows = read.filter(top.isNull()).select(
        "config_id", "application", F.col("c.default_site").alias("default_site"), F.col("c.registry_path").alias("registry_path"),
        F.col("c.default_log_kind").alias("default_log_kind"), F.explode("c.sites").alias("site_id", "s"),
    )
    cms = ~F.col("application")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    form = F.coalesce(F.nullif("s.watchdog_format", F.lit("")), F.lit("json"))
    why = (
        F.when(cms & blank("s.drupal_root"), "no drupal root").when(cms & blank("s.watchdog_path"), "no watchdog path").when(cms & ~form.isin("json", "drush"), "unknown format")
        .when(cms & ~F.coalesce("s.min_severity", F.lit(0)).between(0, 7), "severity out of range").when(~cms & L.log_kind(F.coalesce("s.log_kind", F.lit(""))).isNull(), "unknown log kind")
    )
    marked = rows.withColumn("reason", why).withColumns({"format": form, "display_name": F.coalesce(F.nullif("s.name", F.lit("")), "site_id")})
    bad = faulty.union(strange).union(marked.filter("reason is not null").select("config_id", "site_id", "reason"))
    good = marked.join(bad.select("config_id").distinct(), "config_id", "left_anti").select("config_id", "site_id", "default_site", "display_name", "format", "registry_path", "default_log_kind", "s.*")
    return good, bad


def parse_exclusions(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(exclusions, rejects)``: ``(config_id, scope, site_id, pos, pattern)``; a config with any fault is rejected whole."""
    lists = ", ".join(f"{s}:array<string>" for s in EXCLUSION_SCOPES)
    read = configs.withColumn("c", F.from_json("content", f"struct<version:string, {lists}, sites:map<string,array<string>>>"))
    fixed = F.array(*[F.struct(F.lit(s).alias("scope"), F.lit("").alias("site_id"), F.col(f"c.{s}").alias("patterns")) for s in EXCLUSION_SCOPES])
    by_site = F.transform(F.map_entries(F.coalesce("c.sites", F.create_map().cast("map<string,array<string>>"))), lambda e: F.struct(F.lit("site").alias("scope"), e["key"].alias("site_id"), e["value"].alias("patterns")))
    scopes = read.select("config_id", F.explode(F.concat(fixed, by_site)).alias("s")).select("config_id", "s.*").filter("patterns is not null")
    trimmed = F.transform("patterns", lambda p: F.lower(T.trimmed(p)))
    fault = (
        F.when((F.col("scope") == "site") & (T.trimmed(F.col("site_id")) == ""), "empty site id").when(F.size("patterns") > 50, "over 50 patterns")
        .when(F.exists(trimmed, lambda p: p == ""), "blank pattern").when(F.size(F.array_distinct(trimmed)) < F.size(trimmed), "repeated pattern")
    )
    top = F.when(F.octet_length("content") > 1024 * 1024, "over 1 MiB").when(F.col("c").isNull() | F.col("c.version").isNull(), "does not parse").when(~F.col("c.version").isin(*VERSIONS), "unknown version")
    faults = read.select("config_id", top.alias("reason")).union(scopes.select("config_id", fault.alias("reason"))).filter("reason is not null")
    bad = faults.groupBy("config_id").agg(F.min("reason").alias("reason"))
    good = scopes.join(bad, "config_id", "left_anti").select("config_id", "scope", "site_id", F.posexplode("patterns").alias("pos", "pattern"))
    return good, bad


def with_site(requests: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reports, rejects)``: requests with their site, or the default one; an unknown site is rejected."""
    default = sites.agg(F.max("default_site").alias("_default"))
    asked = requests.join(F.broadcast(default)).withColumn("site_id", F.coalesce(F.nullif("site_id", F.lit("")), "_default")).drop("_default")
    return asked.join(sites.drop("default_site"), "site_id"), asked.join(sites, "site_id", "left_anti").withColumn("reason", F.lit("unknown site"))


def log_files(sites: DataFrame, registry: DataFrame, run_kind: str | None = None, span: str = "yesterday") -> tuple[DataFrame, DataFrame]:
    """``(paths, rejects)``: sites of the config that the registry knows, with the files of their log kind; ``all`` gives two."""
    kind = L.log_kind(F.coalesce(F.lit(run_kind), F.nullif("log_kind", F.lit("")), F.nullif("default_log_kind", F.lit("")), F.lit("main")))
    kinds = F.when(kind == "all", F.array(F.lit("main"), F.lit("error"))).otherwise(F.array(kind))
    both = sites.withColumn("kinds", kinds).join(registry.select("site_id", "directory", "user", "port"), "site_id")
    paths = both.select("site_id", "directory", "user", "port", F.posexplode("kinds").alias("pos", "kind")).withColumn("path", L.log_path(F.col("directory"), F.col("kind"), L.log_range(F.lit(span))))
    return paths, sites.join(registry, "site_id", "left_anti").select("site_id", F.lit("not in the registry").alias("reason"))


def available_sites(sites: DataFrame) -> DataFrame:
    """O3: sites in order with the default marked."""
    return sites.select("site_id", "display_name", (F.col("site_id") == F.col("default_site")).alias("is_default")).orderBy("site_id")


def upgrade_summaries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(summaries, rejects)`` of old rows: text timestamps, JSON text lists, and no source or site in the first version."""
    for name, default in (("log_source_type", "logwatch"), ("site_name", "")):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default))
    lists = ("critical_issues", "warnings", "recommendations")
    when = F.coalesce(F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp("timestamp"))
    read = rows.withColumns({"_at": when, **{f"_{c}": F.from_json(F.coalesce(F.nullif(c, F.lit("")), F.lit("[]")), "array<string>") for c in lists}})
    broken = reduce(lambda a, b: a | b, (F.try_parse_json(F.coalesce(F.nullif(c, F.lit("")), F.lit("[]"))).isNull() for c in lists))
    reason = F.when(F.col("_at").isNull(), "bad timestamp").when(broken, "bad JSON")
    marked = read.withColumn("reason", reason)
    columns = [c for c in rows.columns if c not in ("timestamp", *lists)]
    good = marked.filter("reason is null").select(*columns, F.col("_at").alias("timestamp"), *[F.coalesce(f"_{c}", F.array().cast("array<string>")).alias(c) for c in lists])
    return good, marked.filter("reason is not null").select(*columns, "timestamp", "reason")
