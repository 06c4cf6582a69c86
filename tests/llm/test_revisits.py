import random

from pyspark.sql import functions as F

from tallyloom.llm import revisits

SCHEMA = "record_id long, url string, at long, kind string, headers map<string,string>, digest string, key string, chunk int"


def plain(records):
    out = []

    def key(url):
        place, _, query = url.partition("#")[0].removeprefix("http://").partition("?")
        return place.removeprefix("www.").rstrip("/"), sorted(x for x in query.split("&") if x)

    for rid, url, at, kind, headers, _, *_ in records:
        if kind != "revisit":
            continue
        earlier = [] if None in (rid, url, at) else [
            r for r in records if r[3] == "response" and r[1] is not None and key(r[1]) == key(url) and None not in (r[0], r[2]) and (r[2], r[0]) < (at, rid)
        ]
        then = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        check, old = "no-response", {}
        if then:
            now, old = headers or {}, then[4] or {}
            strip = lambda t: t.removeprefix("W/")
            if now.get("etag") and old.get("etag"):
                check = "etag" if strip(now["etag"]) == strip(old["etag"]) else "etag-differs"
            elif now.get("last-modified") and old.get("last-modified"):
                check = "last-modified" if now["last-modified"] == old["last-modified"] else "last-modified-differs"
            else:
                check = "no-validator"
        good = check in ("etag", "last-modified")
        merged = {**old, **{k: v for k, v in (headers or {}).items() if k not in revisits.BODY_HEADERS}} if good else headers
        out.append((rid, then[0] if good else None, check, merged, then[5] if good else None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(900):
        url = "http://hot.org/page" if rng.random() < 0.4 else f"http://h{rng.randrange(12)}.org/p{rng.randrange(9)}" + rng.choice(["", "/"])
        url = url.replace("//", rng.choice(["//", "//www."])) + rng.choice(["", "", "?", "?id=1", "?id=2", "?id=1&b=/", "?b=/&id=1", "?&b=/&id=1#top", "#top"])
        h = {}
        if rng.random() < 0.7:
            h["etag"] = rng.choice(["", "W/"]) + f'"{rng.randrange(3)}"'
        if rng.random() < 0.7:
            h["last-modified"] = f"d{rng.randrange(2)}"
        h |= {"content-length": str(i), "date": str(i)}
        rows.append((i, url, rng.randrange(200), rng.choice(["response", "revisit", "revisit", "metadata"]), h, f"g{i}", "clash", 3))
    rows += [(2000, None, 5, "revisit", {"a": "b"}, None, "x", 1), (2001, "http://hot.org/page", None, "revisit", {}, None, "x", 1), (None, "http://hot.org/page", 100, "revisit", {}, None, "x", 1)]
    rows.append((2002, "http://hot.org/page", 100, "revisit", None, None, "x", 1))
    frame = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    for size in (revisits.ROWS, 14, 3):
        got = [(r.record_id, r.response_id, r.check, r.headers, r.digest) for r in revisits.resolve(frame, size).collect()]
        assert sorted(got, key=str) == sorted([(a, b, c, d and dict(sorted(d.items())), e) for a, b, c, d, e in want], key=str)


def test_empty_table_and_repeats(spark):
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "http://a.org/", 1, "response", {"etag": '"x"'}, "d", "", 0), (2, "http://a.org", 2, "revisit", {"etag": '"x"'}, None, "", 0)]
    got = revisits.resolve(spark.createDataFrame(rows + rows[1:] + rows[:1], SCHEMA)).collect()
    assert [(r.record_id, r.response_id, r.resolved) for r in got] == [(2, 1, True)] * 2


def test_canonical_urls(spark):
    urls = ["http://WWW.A.org/b/?y=2&x=1#f", "https://a.org/b?x=1&y=2", "a.org/b", "http://m.a.org", "x://a?q", None, "", "http://a.org/" + "b" * 100_000]
    out = [r.key for r in spark.createDataFrame([(u,) for u in urls], "url string").select(revisits.canonical_url(F.col("url")).alias("key")).collect()]
    assert out == ["a.org/b?x=1&y=2", "a.org/b?x=1&y=2", "a.org/b", "m.a.org", "a?q", None, "", "a.org/" + "b" * 100_000]


def test_another_query_is_another_resource(spark):
    rows = [(1, "http://a.org/p?id=1", 1, "response", {"etag": '"x"'}, "d1", "", 0), (2, "http://a.org/p?id=2", 2, "response", {"etag": '"x"'}, "d2", "", 0),
            (3, "http://a.org/p?id=1", 3, "revisit", {"etag": '"x"'}, None, "", 0)]
    assert [(r.response_id, r.digest) for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, "d1")]


def test_more_records_make_more_chunks(spark):
    frame = spark.range(20_000).select((F.col("id") % 5000).alias("at"))
    sizes = revisits.in_chunks(frame, 100).groupBy("chunk").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("chunk").collect()
    assert len(sizes) > 150 and max(r.n for r in sizes) < 400
    assert all(a.hi < b.lo for a, b in zip(sizes, sizes[1:], strict=False))
