"""Resolving WARC revisit records of the not-modified kind.

A revisit stands for a server's "304 Not Modified". It is resolved by an as-of
join: the latest earlier full response of the same canonical URL. The join is not
one window per URL, as a single URL may hold a large part of a crawl. Time is cut
at quantiles of all records into chunks of about ``ROWS`` records, so there are the
more of them the larger the crawl; within a (URL, chunk) the latest earlier response
is a window, and the last response of each chunk is carried over the chunks of the
URL.

Validators are then checked, and headers are merged as an HTTP cache would: what
a 304 may update comes from the revisit, what describes the stored body stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.llm.common import written
from tallyloom.llm.urlfilter import host, path

# Stored headers that a not-modified answer must not replace, as they describe the stored body.
BODY_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
#: Records that a chunk of time should hold.
ROWS = 1_000_000
#: Long chunks of time; each is cut again into as many as its records ask for.
LONG = 64


def canonical_url(url: Column) -> Column:
    """The resource that a URL names: host without a leading ``www.``, path without trailing slashes, and query.

    The parts of the query are put in order, as their order seldom matters, and
    empty ones go; scheme and fragment are dropped. Urls without ``://`` stand for
    themselves.
    """
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    parts = F.array_join(F.array_sort(F.array_remove(F.split(query, "&"), "")), "&")
    key = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), r"/+$", ""))
    return F.when(~url.contains("://"), url).otherwise(F.concat(key, F.when(parts == "", "").otherwise(F.concat(F.lit("?"), parts))))


def _cuts(at: str, parts: int) -> Column:
    """The values that cut ``at`` into ``parts`` of about equally many rows."""
    shares = ", ".join(str(i / parts) for i in range(1, parts)) or "1.0"
    return F.expr(f"approx_percentile({at}, array({shares}), {max(1000, 10 * parts)})")


def _below(cuts: str) -> Column:
    return F.size(F.filter(cuts, lambda c: c < F.col("at")))


def in_chunks(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """``rows`` with a number ``chunk`` that grows with ``at`` and has about ``size`` rows.

    Quantiles are taken twice, of all rows and within each of the ``LONG`` chunks, so
    that a row is compared with few of them. Rows of equal ``at`` share a chunk.
    """
    n = rows.count()
    finer = max(1, -(-n // (size * LONG)))
    first = rows.join(F.broadcast(rows.agg(_cuts("at", LONG).alias("cuts"))), how="cross")  # one row on the right
    first = first.withColumn("long_chunk", _below("cuts")).drop("cuts")
    if finer == 1:
        return first.withColumnRenamed("long_chunk", "chunk")
    inner = first.groupBy("long_chunk").agg(_cuts("at", finer).alias("cuts"))  # LONG rows
    cut = first.join(F.broadcast(inner), "long_chunk").withColumn("chunk", F.col("long_chunk") * finer + _below("cuts"))
    return cut.drop("cuts", "long_chunk")


def _opaque(etag: Column) -> Column:
    """An entity tag without its weakness mark: revalidation compares weakly."""
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def validated(now: Column, then: Column) -> Column:
    """Why the validators of a revisit hold or fail against the stored response.

    ``now`` and ``then`` are header maps with lower-case names. Entity tags decide
    where both have them; else Last-Modified decides; else nothing can be said.
    """
    tag, old_tag = _opaque(F.element_at(now, "etag")), _opaque(F.element_at(then, "etag"))
    date, old_date = F.element_at(now, "last-modified"), F.element_at(then, "last-modified")
    return (
        F.when(tag.isNotNull() & old_tag.isNotNull(), F.when(tag == old_tag, "etag").otherwise("etag-differs"))
        .when(date.isNotNull() & old_date.isNotNull(), F.when(date == old_date, "last-modified").otherwise("last-modified-differs"))
        .otherwise("no-validator")
    )


def merged_headers(now: Column, then: Column) -> Column:
    """The stored headers with those of the revisit that a 304 may bring."""
    brought = F.map_filter(now, lambda k, v: ~k.isin(*BODY_HEADERS) & v.isNotNull())
    kept = F.map_filter(then, lambda k, v: ~F.coalesce(F.map_contains_key(brought, k), F.lit(False)))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, brought))))


def resolve(records: DataFrame, size: int = ROWS) -> DataFrame:
    """Revisits with what they stand for.

    ``records``: ``record_id``, ``url``, ``at`` (a long, such as epoch
    milliseconds), ``kind`` ('response' or 'revisit'), ``headers`` (map with
    lower-case names), ``digest``. Records are ordered by (at, record_id), so a
    response at the same instant counts as earlier if its id is smaller; rows with
    null url, at or id cannot be placed and stay unresolved. Returns for each revisit
    ``(record_id, key, at, response_id, check, resolved, headers, digest)``;
    unresolved ones have check 'no-response' or the failing validator, and only
    their own headers. Repeated rows each get a line; an empty table gives none.
    Urls of any length are compared whole. Other columns are ignored, whatever
    their names.
    """
    rows = written(records.select("record_id", canonical_url(F.col("url")).alias("key"), "at", "kind", "headers", "digest"), "records")
    placeable = "key is not null and at is not null and record_id is not null"
    whole = in_chunks(rows.filter(placeable), size)
    # Headers and digests travel once: the window yields the id of the response, the join below brings the rest.
    order = W.partitionBy("key", "chunk").orderBy("at", "record_id")
    mark = F.when(F.col("kind") == "response", F.struct("at", "record_id"))
    near = F.last(mark, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    lasts = whole.filter("kind = 'response'").groupBy("key", "chunk").agg(F.max(F.struct("at", "record_id")).alias("last"))
    stops = whole.select("key", "chunk").distinct().join(lasts, ["key", "chunk"], "left")
    carried = stops.withColumn(
        "carried", F.max("last").over(W.partitionBy("key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    ).select("key", "chunk", "carried").filter("carried is not null")
    asked = whole.withColumn("near", near).filter("kind = 'revisit'").join(carried, ["key", "chunk"], "left")
    asked = asked.withColumn("found", F.coalesce("near", "carried")).select("record_id", "key", "at", "headers", "digest", F.col("found.record_id").alias("response_id"))
    asked = asked.union(rows.filter(f"kind = 'revisit' and not ({placeable})").select("record_id", "key", "at", "headers", "digest", F.lit(None).cast(records.schema["record_id"].dataType)))
    stored = rows.filter("kind = 'response'").groupBy("record_id").agg(F.max_by(F.struct("headers", "digest"), F.struct("at", "digest")).alias("stored"))
    stored = stored.select(F.col("record_id").alias("response_id"), "stored")
    joined = asked.join(stored, "response_id", "left")
    check = F.when(F.col("response_id").isNull(), "no-response").otherwise(validated(F.col("headers"), F.col("stored.headers")))
    sound = joined.withColumn("check", check).withColumn("resolved", F.col("check").isin("etag", "last-modified"))
    own = F.map_from_entries(F.array_sort(F.map_entries("headers")))
    return sound.select(
        "record_id", "key", "at", F.when(F.col("resolved"), F.col("response_id")).alias("response_id"), "check", "resolved",
        F.when(F.col("resolved"), merged_headers(F.col("headers"), F.col("stored.headers"))).otherwise(own).alias("headers"),
        F.when(F.col("resolved"), F.col("stored.digest")).alias("digest"),
    )
