"""Decoding model answers: the first JSON object in free text, escape repair, validation, list coercion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyloom.functions.lookups import STATUSES

#: The largest JSON object that is decoded, in bytes.
MAX_BYTES = 1024 * 1024
# Where a finding given as an object may keep its text, in order.
TEXT_KEYS = ("description", "message", "text", "issue", "recommendation", "warning", "summary", "detail", "title", "name")
LISTS = ("criticalIssues", "warnings", "recommendations")


def first_object(text: str | None) -> str:
    """From the first ``{`` to the brace that closes it outside strings; empty if none does."""
    at = (text or "").find("{")
    if at < 0:
        return ""
    depth, quoted, escaped = 0, False, False
    for i in range(at, len(text)):
        c = text[i]
        if escaped:
            escaped = False
        elif c == "\\" and quoted:
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c == "{":
            depth += 1
        elif not quoted and c == "}":
            depth -= 1
            if not depth:
                return text[at : i + 1]
    return ""


def repaired(json: str) -> str:
    """Without the backslash before anything that JSON does not escape."""
    out = json.split("\\")
    parts, i = [out[0]], 1
    while i < len(out):
        part = out[i]
        if part == "" and i + 1 < len(out):  # an escaped backslash; what follows is plain
            parts.append("\\\\" + out[i + 1])
            i += 2
            continue
        keep = part[:1] in set('"/bfnrtu') or part == ""
        parts.append(("\\" if keep else "") + part)
        i += 1
    return "".join(parts)


@F.pandas_udf(StructType([StructField("found", StringType()), StructField("fixed", StringType())]))
def extract_json(text: pd.Series) -> pd.DataFrame:
    """X13 and X14 in one pass: balanced braces are no regular language."""
    found = text.map(first_object)
    return pd.DataFrame({"found": found, "fixed": found.map(repaired)})


def _item_text(value: Column) -> Column:
    """The text of one list item, null where the item is skipped."""
    kind = F.schema_of_variant(value)
    plain = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    keyed = [
        F.when(
            F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) == "STRING", F.try_variant_get(value, f"$.{k}", "string")
        )
        for k in TEXT_KEYS
    ]
    found = F.coalesce(*[F.nullif(x, F.lit("")) for x in keyed])
    return F.when(kind == "STRING", F.nullif(plain, F.lit(""))).when(kind.startswith("OBJECT"), found)


def string_list(raw: Column) -> Column:
    """A JSON value as a list of strings.

    Null or missing: empty. Strings stay if not empty, objects give their first
    non-empty text under a known key, other items go. A lone string or object
    counts as a list of one.
    """
    value = F.try_parse_json(raw)
    listed = F.try_variant_get(value, "$", "array<variant>")
    items = F.when(F.schema_of_variant(value).startswith("ARRAY"), listed).otherwise(F.array(value))
    texts = F.transform(items, lambda v: F.when(v.isNotNull(), _item_text(v)))
    return F.coalesce(F.filter(texts, lambda t: t.isNotNull()), F.array().cast("array<string>"))


def decode(responses: DataFrame, text_col: str = "response") -> DataFrame:
    """``responses`` with the fields of the analysis in them and ``reject``, the reason if they hold none."""
    pulled = responses.withColumn("_json", extract_json(F.col(text_col)))
    value = F.try_parse_json(F.col("_json.fixed"))
    pulled = pulled.withColumn("_value", value)
    field = lambda name: F.try_variant_get("_value", f"$.{name}", "variant")
    text = lambda name: F.when(F.schema_of_variant(field(name)) == "STRING", F.try_variant_get("_value", f"$.{name}", "string"))
    odd = lambda name: field(name).isNotNull() & ~F.schema_of_variant(field(name)).isin("STRING", "VOID")
    metrics_kind = F.schema_of_variant(field("metrics"))
    pulled = pulled.withColumns({
        "system_status": F.coalesce(text("systemStatus"), F.lit("")), "summary": F.coalesce(text("summary"), F.lit("")),
        "_typed": ~(F.coalesce(odd("systemStatus"), F.lit(False)) | F.coalesce(odd("summary"), F.lit(False)))
        & F.coalesce(metrics_kind.startswith("OBJECT") | (metrics_kind == "VOID"), F.lit(True)),
        **{snake: string_list(F.to_json(field(name))) for name, snake in zip(LISTS, ("critical_issues", "warnings", "recommendations"), strict=True)},
        "metrics": F.coalesce(F.when(metrics_kind.startswith("OBJECT"), F.to_json(field("metrics"))), F.lit("{}")),
    })
    reason = (
        F.when(F.col("_json.found") == "", "no JSON object")
        .when(F.octet_length("_json.found") > MAX_BYTES, "JSON too large")
        .when(F.col("_value").isNull() | ~F.col("_typed"), "JSON does not parse")
        .when(F.col("system_status") == "", "no status")
        .when(~F.col("system_status").isin(*STATUSES), "invalid status")
        .when(F.col("summary") == "", "no summary")
    )
    return pulled.withColumn("reject", reason).drop("_json", "_value", "_typed")
