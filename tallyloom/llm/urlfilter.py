"""URL filtering: rules by host and path, and a listed-URL check through a blocked Bloom filter.

A blocked Bloom filter keeps all bits of one key in one block of six 64-bit words,
so a probe reads one block. It has a block for every ``KEYS_PER_BLOCK`` listed keys,
which lets some two unlisted URLs in ten thousand through to the exact join, and
at most ``MOST_BLOCKS`` blocks, so that it can be broadcast; a list that would need
more lets more unlisted URLs through. The join takes them out again in any case.
Only possible hits are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ascii_lower, written

# Rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Words of host labels whose pages are listed.
LISTED_LABELS = ("ads-track", "casino-win", "cheap-pills", "free-bets")
#: Listed keys for each block of the filter.
KEYS_PER_BLOCK = 16
#: Most blocks of a filter, rows of about 100 bytes: the broadcast stays near 100 MB however long the list.
MOST_BLOCKS = 1 << 20
#: Bits that a key sets in its block, one in each of as many longs.
PROBES = 6

_AUTHORITY = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; without it, empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1))


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.`` and path without a trailing slash, scheme, query and fragment dropped."""
    return F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, r"/+$", ""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as (name, verdict); nulls where none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    chain = lambda value: reduce(lambda c, r: F.when(fits(r), F.lit(value(r))).otherwise(c), reversed(ordered), F.lit(None).cast("string"))
    return chain(lambda r: r[1] + r[2]), chain(lambda r: r[0])


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One set bit for each of the first PROBES longs of a block."""
    h = F.xxhash64(F.lit("bits"), key)
    place = lambda i: F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place(i)) for i in range(PROBES)]


def blocks_for(n_keys: int) -> int:
    """How many blocks the filter of a list of so many keys has."""
    return min(MOST_BLOCKS, max(1, -(-n_keys // KEYS_PER_BLOCK)))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0 ... )`` of a list ``(key)``; blocks without keys are left out, so at most ``blocks`` rows."""
    bits = listed.select(_block(F.col("key"), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(PROBES)])


def split_by_filter(pages: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """``pages`` (with ``key``) and a flag ``possible``: false is certain, true may be a false positive."""
    probed = pages.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(bloom), "block", "left")
    held = reduce(lambda a, b: a & b, (F.col(f"w{i}").bitwiseAND(b) == b for i, b in enumerate(_bits(F.col("key")))))
    return probed.withColumn("possible", F.coalesce(held, F.lit(False))).drop("block", *[f"w{i}" for i in range(PROBES)])


def listed_urls(pages: DataFrame, url_col: str = "url", labels=LISTED_LABELS) -> DataFrame:
    """``(key)``: canonical URLs of the pages on hosts with a listed label."""
    parts = pages.select(host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    on = F.arrays_overlap(F.split("host", r"\."), F.array(*[F.lit(x) for x in labels]))
    return parts.filter(on).select(canonical(F.col("host"), F.col("path")).alias("key")).distinct()


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, blocks: int | None = None) -> DataFrame:
    """``(id, host, path, rule, verdict, listed)`` for every row of ``pages``.

    The longest fitting rule decides; without one, a listed canonical URL is
    blocked and any other allowed. ``listed`` is a table ``(key)`` of different keys;
    it is written once, and its count gives the filter's ``blocks`` unless they are
    stated. Null urls and urls without ``://`` have empty host and path, fit no rule
    and are not listed. Repeated rows each get a verdict. Empty tables are allowed on
    both sides: an empty list blocks nothing by itself. Of other columns, whatever
    their names, none is read. A url may be as long as a task's memory holds. Both
    branches read the same columns; the misses never leave their partition.
    """
    listed = written(listed.select("key"), "listed")
    blocks = blocks or blocks_for(listed.count())
    parts = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    keyed = parts.withColumns({"rule": rule, "said": verdict, "key": canonical(F.col("host"), F.col("path"))})
    flagged = split_by_filter(keyed, bloom_filter(listed, blocks), blocks)
    possible = flagged.filter("possible and key <> ''").join(listed.select("key", F.lit(True).alias("found")), "key", "left")
    misses = flagged.filter("not (possible and key <> '')").withColumn("found", F.lit(False))
    columns = ["id", "host", "path", "rule", F.coalesce("said", F.when(F.col("found"), "block").otherwise("allow")).alias("verdict"), F.coalesce("found", F.lit(False)).alias("listed")]
    return possible.select(*columns).union(misses.select(*columns))
