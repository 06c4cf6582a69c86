"""Source types that users add (E1) and SQL functions over log text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from tallyloom.functions import text as T
from tallyloom.operators import sections


@dataclass(frozen=True)
class SourceSpec:
    """What a source type needs: each part is a function of DataFrames or columns."""

    scan: Callable[..., DataFrame]
    fit: Callable[[DataFrame, Column], DataFrame]
    prompt: str


_SOURCES: dict[str, SourceSpec] = {}


def register(source_type: str, spec: SourceSpec) -> None:
    """Add or replace a source type."""
    if not source_type:
        raise ValueError("a source type needs a name")
    if spec is None or spec.scan is None or spec.fit is None or not spec.prompt:
        raise ValueError(f"source type {source_type} lacks a part")
    _SOURCES[source_type] = spec


def source(source_type: str) -> SourceSpec:
    if source_type not in _SOURCES:
        raise KeyError(f"unknown source type {source_type}; known: {', '.join(sorted(_SOURCES))}")
    return _SOURCES[source_type]


def register_defaults() -> None:
    from tallyloom.operators.prompts import TEMPLATES
    from tallyloom.sources.reports import scan_files

    register("logwatch", SourceSpec(scan_files, sections.fit_host_reports, TEMPLATES["logwatch"]))
    register("ocms", SourceSpec(scan_files, sections.fit_host_reports, TEMPLATES["ocms"]))
    register("drupal_watchdog", SourceSpec(scan_files, sections.fit_cms_reports, TEMPLATES["drupal_watchdog"]))


def _literal(s: str) -> str:
    return "r'" + s.replace("'", "\\x27") + "'"


def register_sql(spark: SparkSession) -> None:
    """X1-X3, X8, X11 without NFKC, and A9 as temporary SQL functions that inline into plans."""
    def chain(steps, start: str) -> str:
        for pattern, value in steps:
            start = f"regexp_replace({start}, {_literal(pattern)}, {_literal(value)})"
        return start

    trim = f"regexp_replace(s, {_literal(rf'^[{T.SPACE}]+|[{T.SPACE}]+' + chr(92) + 'z')}, '')"
    cut = "if(length(s) > 80, concat(substring(s, 1, 80), '...'), s)"
    bodies = {
        "host_normal_form": chain(T.HOST_STEPS, trim), "cms_normal_form": chain(T.CMS_STEPS, trim), "message_pattern": chain(T.MESSAGE_STEPS, cut),
        "redact": chain([(p, T.REDACTED) for p in T.CREDENTIALS], "s"), "filter_injections": chain([*[(p, T.FILTERED) for p in T.INJECTIONS], (r"\n{4,}", "\n\n\n")], "s"),
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN {body}")
    words = f"regexp_count(s, {_literal(f'[^{T.SPACE}]+')})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(s STRING) RETURNS BIGINT RETURN greatest(floor(octet_length(s) / 4), floor({words} / 0.75D))")
