"""Small fixed lookups: severities, display names, status marks, model prices, log kinds, token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Severity names by level.
SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
# Severity labels of exports in English, Russian, German, Spanish and French, by level.
LABELS = (
    ("Emergency", "Авария", "Notfall", "Emergencia", "Urgence"),
    ("Alert", "Тревога", "Alarm", "Alerta", "Alerte"),
    ("Critical", "Критический", "Критическая", "Kritisch", "Crítico", "Critique"),
    ("Error", "Ошибка", "Fehler", "Erreur"),
    ("Warning", "Предупреждение", "Warnung", "Advertencia", "Aviso", "Avertissement"),
    ("Notice", "Уведомление", "Hinweis", "Notificación", "Avis"),
    ("Info", "Инфо", "Информация", "Información", "Information"),
    ("Debug", "Отладка", "Depuración", "Débogage"),
)
# Model families with dollars per million tokens: input, output, cache write, cache read.
PRICES = (
    ("claude-haiku-4-5", 1.0, 5.0, 1.25, 0.10),
    ("claude-sonnet-4-6", 3.0, 15.0, 3.75, 0.30),
    ("claude-sonnet-4-5", 3.0, 15.0, 3.75, 0.30),
    ("claude-opus-4-7", 5.0, 25.0, 6.25, 0.50),
    ("claude-opus-4-6", 5.0, 25.0, 6.25, 0.50),
)
# Rates of unknown models.
FALLBACK = (3.0, 15.0, 3.75, 0.30)
RATES = ("input_rate", "output_rate", "cache_write_rate", "cache_read_rate")
PRICE_SCHEMA = "prefix string, input_rate double, output_rate double, cache_write_rate double, cache_read_rate double"

STATUSES = ("Excellent", "Good", "Satisfactory", "Bad", "Awful")
ALERTING = STATUSES[2:]
MARKS = {"Excellent": "✅", "Good": "🟢", "Satisfactory": "🟡", "Bad": "🟠", "Awful": "🔴"}
SOURCES = {"logwatch": "Logwatch", "drupal_watchdog": "Drupal Watchdog", "ocms": "OCMS"}

DEFAULT_CONTEXT = 128_000


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def severity_name(level: Column) -> Column:
    """Level to name, else ``unknown``."""
    return F.coalesce(F.try_element_at(_map(dict(enumerate(SEVERITIES))), level.cast("int")), F.lit("unknown"))


def severity_level(name: Column) -> Column:
    """Name to level, else -1."""
    return F.coalesce(F.try_element_at(_map({n: i for i, n in enumerate(SEVERITIES)}), name), F.lit(-1))


def label_level(label: Column) -> Column:
    """A localised label to its level, else 5."""
    return F.coalesce(F.try_element_at(_map({x: i for i, names in enumerate(LABELS) for x in names}), label), F.lit(5))


def status_mark(status: Column) -> Column:
    """The mark of a status, a blank mark if unknown."""
    return F.coalesce(F.try_element_at(_map(MARKS), status), F.lit("⚪"))


def source_name(source_type: Column) -> Column:
    """The display name of a source, ``Log`` if unknown."""
    return F.coalesce(F.try_element_at(_map(SOURCES), source_type), F.lit("Log"))


def is_alert(status: Column) -> Column:
    """F9."""
    return status.isin(*ALERTING)


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), PRICE_SCHEMA)


def with_prices(calls: DataFrame, prices: DataFrame, model_col: str = "model", fallback=FALLBACK) -> DataFrame:
    """``calls`` with the rates of the longest prefix of their model, and ``known_model``.

    Distinct models meet the prefixes, not calls, so the theta join is between two
    small sides. Calls are joined back on equality with the models that have a price,
    a line each, which are broadcast: a few models hold all calls, and a shuffle by
    model would put a model's calls into one task.
    """
    models = calls.select(F.col(model_col).alias("_model")).distinct()
    hit = models.join(F.broadcast(prices), F.col("_model").startswith(F.col("prefix")))
    best = hit.groupBy("_model").agg(F.max_by(F.struct(*RATES), F.length("prefix")).alias("_rates"))
    joined = calls.join(F.broadcast(best), calls[model_col] == best["_model"], "left")
    rates = [F.coalesce(F.col(f"_rates.{r}"), F.lit(x)).alias(r) for r, x in zip(RATES, fallback, strict=True)]
    return joined.select(*[calls[c] for c in calls.columns], *rates, F.col("_model").isNotNull().alias("known_model"))


def call_cost(input_tokens: Column, output_tokens: Column, cache_write: Column, cache_read: Column, local: Column | None = None) -> Column:
    """X17 from the rates that J5 added; calls to local providers cost nothing."""
    parts = zip((input_tokens, output_tokens, cache_write, cache_read), RATES, strict=True)
    total = sum((n.cast("double") / F.lit(1e6) * F.col(r) for n, r in parts), F.lit(0.0))
    return total if local is None else F.when(local, F.lit(0.0)).otherwise(total)


def log_token_budget(limit: Column, reserve: Column, system: Column, overhead: Column) -> Column:
    """What is left of a model's context for the log, at least 1000."""
    whole = F.when(limit > 0, limit).otherwise(DEFAULT_CONTEXT)
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    margin = F.greatest(F.floor(whole / 20), F.lit(2000))
    return F.greatest(whole - zero(reserve) - zero(system) - zero(overhead) - margin, F.lit(1000)).cast("long")


def log_kind(kind: Column) -> Column:
    """``main``, ``error`` or ``all``; blank means main, anything else null."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(k == "", "main").when(k.isin("main", "error", "all"), k)


def log_range(span: Column) -> Column:
    """``yesterday`` (also for blank) or ``today``, else null."""
    s = F.lower(F.trim(F.coalesce(span, F.lit(""))))
    return F.when(s == "", "yesterday").when(s.isin("yesterday", "today"), s)


def log_path(directory: Column, kind: Column, span: Column) -> Column:
    """The file of a site's log; yesterday's has been rotated once."""
    return F.concat(directory, F.lit("/logs/"), F.when(kind == "error", "error.log").otherwise("ocms.log"), F.when(span == "yesterday", ".1").otherwise(""))


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")
