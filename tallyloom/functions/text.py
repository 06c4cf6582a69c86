"""Column functions over log text: normal forms, priorities, redaction, prompt safety, token estimates.

Patterns are written for Java with line ends at ``\\n`` only and ASCII word
boundaries, so that results do not depend on Unicode word rules.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Unicode white space.
SPACE = r"\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACES = "\t\n\x0b\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
GAP = r"[\t\n\f\r ]"
_L, _R = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"

_IP = _L + r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}" + _R
_UUID = r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
_INT = _L + r"\d+" + _R

# Ordered (pattern, replacement) steps of the normal forms.
HOST_STEPS = (
    (_IP, "IP"),
    (_L + r"\d{1,2}:\d{2}:\d{2}" + _R, "TIME"),
    (_L + r"\d{4}-\d{2}-\d{2}" + _R + "|" + _L + r"\d{2}/\d{2}/\d{4}" + _R, "DATE"),
    (_INT, "N"),
)
CMS_STEPS = (
    (_UUID, "UUID"),
    (_IP, "IP"),
    (r"\d{4}-\d{2}-\d{2}" + GAP + r"+\d{2}:\d{2}:\d{2}", "TIMESTAMP"),
    (_L + r"\d{2}:\d{2}:\d{2}" + _R, "TIME"),
    (_L + r"\d+([a-zA-Z]+)" + _R, "N$1"),
    (_INT, "N"),
)
MESSAGE_STEPS = ((_UUID, "[UUID]"), (_IP, "[IP]"), (_INT, "[N]"), (r"/[a-zA-Z0-9/_-]+", "[PATH]"))

# Keywords of section priorities and of lines worth keeping.
HOST_HIGH = ("ssh", "security", "auth", "fail", "error", "critical", "kernel", "panic", "segfault", "oom", "firewall", "sudo", "root", "unauthorized", "denied")
HOST_MEDIUM = ("network", "disk", "mount", "service", "daemon", "warning", "load", "memory", "cpu")
HOST_ESSENTIAL = (
    "error", "fail", "failed", "critical", "panic", "denied", "unauthorized", "security", "sudo", "root", "ssh", "warning",
    "disk", "memory", "cpu", "load", "network", "service", "daemon", "kernel", "oom", "%",
)
CMS_HIGH = (
    "security", "access denied", "permission", "unauthorized", "forbidden", "login failed", "authentication", "csrf", "xss",
    "sql injection", "brute force", "blocked", "banned", "critical", "emergency", "alert", "error", "exception", "fatal",
    "pdoexception", "database", "mysql", "connection refused", "out of memory", "segfault", "core dump", "cron failed",
    "queue failed", "batch failed", "update failed", "migration failed",
)
CMS_MEDIUM = (
    "warning", "deprecated", "notice", "cron", "queue", "batch", "cache", "session", "module", "theme", "update", "migration",
    "slow", "timeout", "memory", "performance",
)
CMS_ESSENTIAL = ("error", "critical", "emergency", "alert", "security", "failed", "exception")

# Credential patterns, in order.
CREDENTIALS = (
    r"sk-ant-[a-zA-Z0-9_-]{10,}",
    r"sk-[a-zA-Z0-9_-]{32,}",
    r"\d{8,12}:[a-zA-Z0-9_-]{30,}",
    r"Bearer" + GAP + r"+[a-zA-Z0-9_.-]+",
    r"(?i)authorization[:\t\n\f\r ]+[^\t\n\f\r ]+",
    r"(?i)api[_-]?key[=:][^\t\n\f\r &\"']+",
    r"(?i)x-api-key[:\t\n\f\r ]+[^\t\n\f\r ]+",
)
REDACTED = "[REDACTED]"

# Prompt-injection patterns, in order.
_OVERRIDE = GAP + r"+(all" + GAP + r"+)?(previous|prior|above)" + GAP + r"+(instructions?|prompts?|rules?)"
INJECTIONS = (
    r"(?i)ignore" + _OVERRIDE,
    r"(?i)disregard" + _OVERRIDE,
    r"(?i)forget" + _OVERRIDE,
    r"(?i)you" + GAP + "+are" + GAP + "+now" + GAP + "+a",
    r"(?i)new" + GAP + "+instructions?:",
    r"(?i)system" + GAP + "*prompt" + GAP + "*:",
    r"(?i)" + _L + "ASSISTANT" + GAP + "*:",
    r"(?i)" + _L + "HUMAN" + GAP + "*:",
    r"(?i)" + _L + "USER" + GAP + "*:",
    r"(?i)" + _L + "SYSTEM" + GAP + "*:",
)
FILTERED = "[FILTERED]"
_HIDDEN = r"[\u200B-\u200F\u202A-\u202E\u2060-\u206F\uFEFF]"
_UNPRINTABLE = r"[^\p{L}\p{M}\p{N}\p{P}\p{S} \n\t\r]"

# Characters that message markup escapes; the backslash is among them.
MARKUP = r"[\\_*\[\]()~`>#+\-=|{}.!:]"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def _replaced(text: Column, steps) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)


def host_normal_form(line: Column) -> Column:
    """A host log line with addresses, times, dates and integers replaced; every step needs a digit."""
    bare = trimmed(line)
    return F.when(bare.rlike("[0-9]"), _replaced(bare, HOST_STEPS)).otherwise(bare)


def cms_normal_form(line: Column) -> Column:
    """A CMS digest line with ids, addresses, times, quantities and integers replaced."""
    return _replaced(trimmed(line), CMS_STEPS)


def message_pattern(message: Column) -> Column:
    """A message cut to 80 characters first, then with its variable parts replaced."""
    cut = F.when(F.length(message) > 80, F.concat(F.substring(message, 1, 80), F.lit("..."))).otherwise(message)
    return _replaced(cut, MESSAGE_STEPS)


def has_any(text: Column, keywords) -> Column:
    """True where the lower-cased text contains a keyword."""
    escaped = "|".join(k.replace("%", "\\%") for k in keywords)
    return F.lower(text).rlike(escaped)


def host_priority(name: Column, content: Column) -> Column:
    """1, 2 or 3."""
    high = has_any(name, HOST_HIGH) | has_any(content, HOST_HIGH)
    return F.when(high, 1).when(has_any(name, HOST_MEDIUM), 2).otherwise(3)


def cms_priority(name: Column, content: Column) -> Column:
    """1, 2 or 3."""
    high = has_any(name, CMS_HIGH) | has_any(content, CMS_HIGH)
    return F.when(high, 1).when(has_any(name, CMS_MEDIUM), 2).otherwise(3)


def is_essential_host_line(line: Column) -> Column:
    """F4."""
    return (trimmed(line) != "") & has_any(line, HOST_ESSENTIAL)


def is_essential_cms_line(line: Column) -> Column:
    """F5."""
    return line.startswith("##") | line.startswith("===") | has_any(line, CMS_ESSENTIAL)


def n_words(text: Column) -> Column:
    """Fields between Unicode white space, named by its property: that is one test a character, where a class of all of ``SPACE`` is twelve."""
    return F.regexp_count(text, F.lit(r"\P{IsWhite_Space}++"))


def tokens_of(n_bytes: Column, words: Column) -> Column:
    """A9 from sizes that add up over lines."""
    return F.greatest(F.floor(n_bytes / 4), F.floor(words / F.lit(0.75).cast("double"))).cast("long")


def estimate_tokens(text: Column) -> Column:
    """The larger of bytes div 4 and floor(words / 0.75)."""
    return tokens_of(F.octet_length(text), n_words(text))


def fits_budget(text: Column, budget: Column) -> Column:
    """Whether A9's estimate is within the budget; words are counted only where the bytes leave it open."""
    return F.when(F.floor(F.octet_length(text) / 4) > budget, False).otherwise(estimate_tokens(text) <= budget)


def redact(text: Column) -> Column:
    """Credentials replaced."""
    return _replaced(text, [(p, REDACTED) for p in CREDENTIALS])


def has_credentials(text: Column) -> Column:
    """X8's detector."""
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in CREDENTIALS))


def credential_counts(text: Column) -> Column:
    """Matches of each credential pattern on the given text, in pattern order."""
    return F.array(*[F.regexp_count(text, F.lit(p)) for p in CREDENTIALS])


def mask_credential(secret: Column) -> Column:
    """X9."""
    colon = F.instr(secret, ":") - 1
    return (
        F.when(F.length(secret) < 10, F.repeat(F.lit("*"), F.length(secret)))
        .when(secret.startswith("sk-ant-"), "sk-ant-***...")
        .when((colon >= 1) & (colon <= 12), F.concat(F.substring_index(secret, ":", 1), F.lit(":***...")))
        .otherwise(F.concat(F.substring(secret, 1, 4), F.lit("***...")))
    )


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def printable(text: Column) -> Column:
    """What follows NFKC in X10: hidden and unprintable characters dropped."""
    return F.regexp_replace(F.regexp_replace(text, _HIDDEN, ""), _UNPRINTABLE, "")


def normalise_unicode(text: Column) -> Column:
    """NFKC, then no hidden or unprintable characters but line feeds, tabs and returns.

    Python is needed for NFKC alone, which leaves ASCII as it is; such texts are not sent to it.
    """
    return printable(F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text))


def filter_injections(text: Column) -> Column:
    """X11 on text that X10 has been through."""
    return F.regexp_replace(_replaced(text, [(p, FILTERED) for p in INJECTIONS]), r"\n{4,}", "\n\n\n")


def injection_counts(text: Column) -> Column:
    """Matches of each injection pattern on the given text, in pattern order."""
    return F.array(*[F.regexp_count(text, F.lit(p)) for p in INJECTIONS])


def safe_prompt_text(text: Column) -> Column:
    """X11 in full."""
    return filter_injections(normalise_unicode(text))


def clean_pattern(pattern: Column) -> Column:
    """An exclusion pattern on one line, without controls, at most 200 characters."""
    flat = F.regexp_replace(trimmed(pattern), r"[\r\n\t]", " ")
    flat = trimmed(normalise_unicode(F.regexp_replace(flat, r"\p{Cc}", "")))
    return F.when(F.length(flat) > 200, F.concat(F.substring(flat, 1, 197), F.lit("..."))).otherwise(flat)


def escape_markup(text: Column) -> Column:
    """20 markup characters escaped with a backslash."""
    return F.regexp_replace(text, MARKUP, r"\\$0")


def truncate(text: Column, n: int) -> Column:
    """At most ``n`` characters, the last three dots if cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)
