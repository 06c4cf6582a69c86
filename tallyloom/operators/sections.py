"""Reports to sections and lines, near-duplicate collapse, and compression to a token budget.

Tables are keyed by ``report_id``; sections by (``report_id``, ``section_no``). A
report is at most 100 MB by admission, so what is gathered per section or report
is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.functions import text as T

# Section headers. Only line feeds end lines; the gaps may span lines.
HOST_HEADER = r"(?md)^#{3,}[\t\n\f\r ]*(.+?)[\t\n\f\r ]*#{3,}$"
CMS_HEADER = r"(?md)^(?:##|===)[\t\n\f\r ]*(.+?)[\t\n\f\r ]*(?:===)?$"
# Shares of lines kept by priority 1, 2, 3 on the steps of the ladder.
LADDER = ((1.0, 1.0, 1.0), (1.0, 0.5, 0.2), (0.85, 0.35, 0.1), (0.7, 0.2, 0.05), (0.5, 0.1, 0.02))
CMS_RATIOS = (1.0, 0.5, 0.2)
NOTICE = "[... truncated to fit token budget ...]"
HASHES = "#" * 19

SECTION = ["report_id", "section_no"]


def sections(reports: DataFrame, header: str = HOST_HEADER, priority=T.host_priority, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(report_id, section_no, name, content, priority)`` and the ``carried`` columns of the report.

    Text before the first header goes; without a header the whole content is one
    section ``General``. Null content counts as empty.
    """
    body = F.coalesce(F.col("content"), F.lit(""))
    bodies = F.transform(F.slice(F.split(body, header, -1), 2, F.greatest(F.size(F.split(body, header, -1)) - 1, F.lit(0))), T.trimmed)
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(header), F.lit(1)).alias("name"), bodies.alias("content"))
    named = F.when(body.rlike(header), F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), p["content"].alias("content")))).otherwise(
        F.array(F.struct(F.lit("General").alias("name"), body.alias("content")))
    )
    out = reports.select("report_id", *carried, F.posexplode(named).alias("section_no", "s")).select("report_id", *carried, "section_no", "s.name", "s.content")
    return out.withColumn("priority", priority(F.col("name"), F.col("content")))


def lines(secs: DataFrame) -> DataFrame:
    """One row per line with its ordinal; a trailing line feed gives an empty last line."""
    keep = [c for c in secs.columns if c != "content"]
    return secs.select(*keep, F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))


def collapse(lined: DataFrame, norm, least: int, suffix, closing_line: bool) -> DataFrame:
    """Lines of one normal form become their first, with a count.

    Sections of up to ``least`` lines stay. Blank lines stay as they are.
    ``closing_line`` adds the empty last line that rejoined host sections get; it
    comes with a section's first line, which always stays, so no second pass is needed.
    """
    keys = [c for c in lined.columns if c not in ("line_no", "line")]
    width = int(lined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Set by number, as partitions that are coalesced grow with the table, and with them what a task sorts.
    with_norm = lined.withColumn("norm", norm(F.col("line"))).repartition(width, "report_id")
    whole = W.partitionBy(*SECTION)
    same = W.partitionBy(*SECTION, "norm")
    counted = with_norm.withColumns({
        "_lines": F.count("*").over(whole), "_times": F.count("*").over(same), "_first": F.row_number().over(same.orderBy("line_no")),
    })
    long = F.col("_lines") > least
    kept = counted.filter(~long | (F.col("norm") == "") | (F.col("_first") == 1))
    text = F.when(long & (F.col("norm") != "") & (F.col("_times") > 1), F.concat("line", suffix(F.col("_times")))).otherwise(F.col("line"))
    if not closing_line:
        return kept.select(*keys, "line_no", text.alias("line"))
    own = F.struct("line_no", text.alias("line"))
    closing = F.struct(F.col("_lines").cast("int").alias("line_no"), F.lit("").alias("line"))
    return kept.select(*keys, F.inline(F.when(long & (F.col("line_no") == 0), F.array(own, closing)).otherwise(F.array(own))))


def collapse_host(lined: DataFrame) -> DataFrame:
    """Over 10 lines, `` (occurred N times)``."""
    return collapse(lined, T.host_normal_form, 10, lambda n: F.concat(F.lit(" (occurred "), n.cast("string"), F.lit(" times)")), True)


def collapse_cms(lined: DataFrame) -> DataFrame:
    """Over 5 lines, `` (xN)``."""
    return collapse(lined, T.cms_normal_form, 5, lambda n: F.concat(F.lit(" (x"), n.cast("string"), F.lit(")")), False)


def gathered(lined: DataFrame) -> DataFrame:
    """Lines back to an array column ``lines`` per section, in order."""
    keys = [c for c in lined.columns if c not in ("line_no", "line")]
    listed = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lined.groupBy(*keys).agg(F.transform(listed, lambda s: s["line"]).alias("lines"))


def kept_lines(n: Column, ratio: Column) -> Column:
    """W2's ``max(1, ceil(n * ratio))``."""
    return F.greatest(F.ceil(n * ratio), F.lit(1)).cast("int")


def keep_head(listed: Column, ratio: Column, omitted) -> Column:
    """The first ``max(1, ceil(n * ratio))`` lines with a note of what is left out; a ratio of 1 changes nothing."""
    n = F.size(listed)
    k = kept_lines(n, ratio)
    head = F.concat(F.array_join(F.slice(listed, 1, k), "\n"), F.lit("\n"))
    note = F.when(k < n, omitted((n - k).cast("string"))).otherwise(F.lit(""))
    return F.when(ratio >= 1, F.array_join(listed, "\n")).otherwise(F.concat(head, note))


def host_note(k: Column) -> Column:
    return F.concat(F.lit("\n[... "), k, F.lit(" more lines omitted for brevity ...]\n"))


def cms_note(k: Column) -> Column:
    return F.concat(F.lit("\n[... "), k, F.lit(" similar entries omitted ...]\n"))


def essential_lines(lined: DataFrame) -> DataFrame:
    """The section's columns and ``essential``: first two lines, then telling ones, then the last two.

    ``line_no`` counts the given lines from 0 without gaps. Blank lines and repeated
    normal forms go. Sections of up to six lines stay as they are; if nothing is
    kept, the third line is tried too.
    """
    keys = [c for c in lined.columns if c not in ("line_no", "line")]
    n = F.count("*").over(W.partitionBy(*SECTION))
    bare = F.regexp_replace("line", r"\r+\z", "")
    phase = F.when(F.col("line_no") < 2, 1).when(T.is_essential_host_line(F.col("line")), 2).when(F.col("line_no") >= F.col("n") - 2, 3)
    placed = lined.withColumn("n", n).withColumn("phase", F.when((F.col("n") > 6) & (T.trimmed(F.col("line")) != ""), phase))
    normed = placed.withColumn("norm", F.when(F.col("phase").isNotNull(), T.host_normal_form(bare)))
    once = normed.withColumn("r", F.row_number().over(W.partitionBy(*SECTION, "norm").orderBy("phase", "line_no")))
    pick = F.when(F.col("phase").isNotNull() & (F.col("r") == 1), F.struct("phase", "line_no", bare.alias("line")))
    listed = once.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]).alias("lines"),
        F.transform(F.array_sort(F.collect_list(pick)), lambda s: s["line"]).alias("found"),
    )
    third = F.regexp_replace(F.get("lines", F.lit(2)), r"\r+\z", "")
    listed = listed.withColumn("kept", F.when((F.size("found") == 0) & (T.trimmed(third) != ""), F.array(third)).otherwise(F.col("found")))
    left_out = F.size("lines") - F.size("kept")
    noted = F.when(left_out > 0, F.concat("kept", F.array(F.concat(F.lit("[... "), left_out.cast("string"), F.lit(" more lines omitted for brevity ...]"))))).otherwise(F.col("kept"))
    return listed.select(*keys, F.when(F.size("lines") <= 6, F.array_join("lines", "\n")).otherwise(F.array_join(noted, "\n")).alias("essential"))


def trim_to_budget(content: Column, budget: Column) -> Column:
    """The longest run of first lines that fits together with the notice; then the notice alone; then nothing.

    Sizes add up over lines, so running sums decide without trying any text. Lines
    beyond four bytes a token cannot fit, so only those before are cut and summed.
    """
    reach = (F.greatest(budget, F.lit(0)).cast("long") + 1) * 4
    listed = F.split(F.substring(content, F.lit(1), F.least(reach, F.lit(1 << 30)).cast("int")), "\n", -1)
    sizes = F.transform(listed, lambda s: F.struct(F.octet_length(s).alias("b"), T.n_words(s).alias("w")))
    # The number of lines is carried along: named in the step, the text would be cut again at every line.
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("w"), F.lit(0).alias("i"), F.lit(0).alias("best"), F.size(listed).alias("n"))
    extra_b, extra_w = len(NOTICE) + 1, len(NOTICE.split())

    def step(a: Column, s: Column) -> Column:
        b, w, i = a["b"] + s["b"] + F.when(a["i"] > 0, 1).otherwise(0), a["w"] + s["w"], a["i"] + 1
        fits = T.tokens_of(b + extra_b, w + extra_w) <= budget
        return F.struct(b.cast("long").alias("b"), w.cast("long").alias("w"), i.alias("i"), F.when(fits & (i < a["n"]), i).otherwise(a["best"]).alias("best"), a["n"].alias("n"))

    best = F.aggregate(sizes, start, step)["best"]
    notice = F.when(T.estimate_tokens(F.lit(NOTICE)) <= budget, F.lit(NOTICE)).otherwise(F.lit(""))
    cut = F.concat(F.array_join(F.slice(listed, 1, best), "\n"), F.lit("\n" + NOTICE))
    return F.when((budget <= 0) | T.fits_budget(content, budget), content).when(best > 0, cut).otherwise(notice)


def heading(name: Column) -> Column:
    """R2: the line above a host section."""
    return F.concat(F.lit(f"\n{HASHES} "), name, F.lit(f" {HASHES}\n"))


def ladder_ratios(priority: Column) -> Column:
    """What a section of this priority keeps on each step, as an array."""
    high, medium, low = (F.array(*map(F.lit, step)) for step in zip(*LADDER))
    return F.when(priority == 1, high).when(priority == 3, low).otherwise(medium)


def ladder_sizes(name: Column, priority: Column, sizes: Column) -> Column:
    """Bytes ``b`` and words ``w`` that a rendered section takes on each step, from those of its lines.

    Both add up: lines are joined by line feeds, and headings, notes and sections
    end in one. So no step's text has to be made in order to measure it.
    """
    n = F.size(sizes)

    def step(ratio: Column) -> Column:
        k = F.when(ratio >= 1, n).otherwise(kept_lines(n, ratio))
        note = F.when(k < n, host_note((n - k).cast("string"))).otherwise(F.lit(""))
        feeds = k + F.when(ratio >= 1, 0).otherwise(1)
        start = F.struct(
            (F.octet_length(heading(name)) + F.octet_length(note) + feeds).cast("long").alias("b"),
            (T.n_words(heading(name)) + T.n_words(note)).cast("long").alias("w"),
        )
        return F.aggregate(F.slice(sizes, 1, k), start, lambda a, s: F.struct((a["b"] + s["b"]).alias("b"), (a["w"] + s["w"]).alias("w")))

    return F.transform(ladder_ratios(priority), step)


def _measured(collapsed: DataFrame) -> DataFrame:
    """``(report_id, budget, level, secs)``: the sections of a report, and the first step of the ladder that fits, or null."""
    keys = ["report_id", "budget", "section_no", "name", "priority"]
    sized = F.struct("line_no", "line", F.octet_length("line").cast("long").alias("b"), T.n_words(F.col("line")).cast("long").alias("w"))
    listed = collapsed.groupBy(*keys).agg(F.array_sort(F.collect_list(sized)).alias("listed"))
    steps = ladder_sizes(F.col("name"), F.col("priority"), F.col("listed"))
    per_section = listed.select(*keys, F.col("listed.line").alias("lines"), steps.alias("steps"))
    totals = [F.sum(F.col("steps")[i][part]).alias(f"{part}{i}") for i in range(len(LADDER)) for part in "bw"]
    secs = F.array_sort(F.collect_list(F.struct("section_no", "name", "priority", "lines"))).alias("secs")
    level = F.coalesce(*[F.when(T.tokens_of(F.col(f"b{i}"), F.col(f"w{i}")) <= F.col("budget"), i + 1) for i in range(len(LADDER))])
    return per_section.groupBy("report_id", "budget").agg(secs, *totals).select("report_id", "budget", level.alias("level"), "secs")


def fit_host_reports(reports: DataFrame, budget: Column) -> DataFrame:
    """``(report_id, level, content)``: the first step of the ladder whose text fits the budget.

    Level 0 is the report as it is, 1 to 5 are the ladder after collapsing, 6 the
    essential lines of what collapsing left, 7 those cut to the budget. Reports that
    fit at once take no part in the rest. Sums of line sizes choose the step, and
    its text alone is made.
    """
    sized = reports.select("report_id", F.coalesce("content", F.lit("")).alias("content"), budget.alias("budget"))
    fits = T.fits_budget(F.col("content"), F.col("budget"))
    easy = sized.filter(fits).select("report_id", F.lit(0).alias("level"), "content")
    measured = _measured(collapse_host(lines(sections(sized.filter(~fits), carried=("budget",)))))

    def one(s: Column) -> Column:
        ratio = F.element_at(ladder_ratios(s["priority"]), F.col("level"))
        return F.concat(heading(s["name"]), keep_head(s["lines"], ratio, host_note), F.lit("\n"))

    won = measured.filter("level is not null").select("report_id", "level", F.array_join(F.transform("secs", one), "").alias("content"))
    beyond = measured.filter("level is null").select("report_id", "budget", F.inline("secs"))
    essential = essential_lines(beyond.select("report_id", "budget", "section_no", "name", F.posexplode("lines").alias("line_no", "line")))
    tail = essential.groupBy("report_id", "budget").agg(F.array_sort(F.collect_list(F.struct("section_no", "name", "essential"))).alias("secs"))
    joined = F.array_join(F.transform("secs", lambda s: F.concat(heading(s["name"]), s["essential"], F.lit("\n"))), "")
    tail = tail.select("report_id", "budget", joined.alias("text")).select(
        "report_id", F.when(T.estimate_tokens(F.col("text")) <= F.col("budget"), 6).otherwise(7).alias("level"),
        trim_to_budget(F.col("text"), F.col("budget")).alias("content"),
    )
    return easy.union(won).union(tail)


def fit_cms_reports(reports: DataFrame, budget: Column) -> DataFrame:
    """``(report_id, content)``: sections by priority, then telling lines only, at most budget div 10 of them."""
    secs = sections(reports.filter("content <> ''"), CMS_HEADER, T.cms_priority)
    high = secs.filter("priority = 1").select("report_id", "section_no", "name", "priority", F.split("content", "\n", -1).alias("lines"))
    rest = gathered(collapse_cms(lines(secs.filter("priority <> 1"))))
    ratio = F.when(F.col("priority") == 1, CMS_RATIOS[0]).when(F.col("priority") == 2, CMS_RATIOS[1]).otherwise(CMS_RATIOS[2])
    kept = high.unionByName(rest).withColumn("text", keep_head(F.col("lines"), ratio, cms_note)).filter("text <> ''")
    whole = kept.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "name", "text"))).alias("secs"))
    text = F.array_join(F.transform("secs", lambda s: F.concat(F.lit("\n## "), s["name"], F.lit("\n"), s["text"], F.lit("\n"))), "")
    out = reports.select("report_id", budget.alias("budget")).join(whole.select("report_id", text.alias("text")), "report_id", "left")
    telling = F.filter(F.split("text", "\n", -1), T.is_essential_cms_line)
    most = F.greatest(F.floor(F.col("budget") / 10), F.lit(1)).cast("int")
    note = F.concat(F.lit("\n[... truncated to "), most.cast("string"), F.lit(" lines due to size limits ...]"))
    short = F.when(F.size(telling) > most, F.array_join(F.concat(F.slice(telling, 1, most), F.array(note)), "\n")).otherwise(F.array_join(telling, "\n"))
    return out.select("report_id", F.when(F.col("text").isNull(), "").when(T.estimate_tokens(F.col("text")) > F.col("budget"), short).otherwise(F.col("text")).alias("content"))
