import random

from tallyloom.llm import urlfilter

SCHEMA = "page_id long, url string, key string, block int, found boolean"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    cut = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:cut]


def plain(url, listed):
    host, path = parts(url)
    rules = [(h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    name, verdict = max(rules, key=lambda r: len(r[0]), default=(None, None))
    bare = host.removeprefix("www.") if host.startswith("www.") else host.removeprefix("m.")
    known = bool(host or path) and bare + path.rstrip("/") in listed
    return host, path, name, verdict or ("block" if known else "allow"), known


URLS = [
    None, "", "no scheme", "http://", "http://a", "HTTP://EXAMPLE.com/en/x?q#f", "http://example.com/en", "https://www.example.com/en/",
    "http://sub.www.example.com/en/y", "http://notexample.com/en/", "http://x.net/es/", "http://net/fr/a", "http://xnet/fr/", "http://a.net/FR/",
    "http://h.org?x=/en/", "http://h.org#://net/es/", "x://y://z.net/es/", "http://İx.net/es/", "http://h.net/es", "http://casino-win.io/deal/", "http://m.casino-win.io/deal", "http://a.net\n/es/",
]


def test_against_brute_force(spark):
    rng = random.Random(3)
    urls = URLS + [f"http://{rng.choice(['', 'www.', 'm.'])}h{rng.randrange(40)}.{rng.choice(['org', 'net', 'com'])}/{rng.choice(['es/', 'fr/', 'en/', ''])}p{rng.randrange(30)}" for _ in range(800)]
    listed = {f"h{i}.org/p{i % 30}" for i in range(40)} | {f"h{i}.net/p{j}" for i in range(0, 40, 3) for j in range(30)} | {"casino-win.io/deal"}
    frame = spark.createDataFrame([(i, u, "clash", 1, True) for i, u in enumerate(urls)], SCHEMA)
    for blocks in (None, 65_536, 1):  # one block: nearly all are possible, and the exact join decides
        out = sorted(urlfilter.judge(frame, spark.createDataFrame([(k,) for k in listed], "key string"), blocks=blocks).collect())
        assert [tuple(r)[1:] for r in out] == [plain(u, listed) for u in urls]


def test_the_filter_never_misses(spark):
    listed = spark.range(4000).selectExpr("concat('k', id) AS key")
    pages = spark.range(12000).selectExpr("id", "concat('k', id) AS key")
    flagged = urlfilter.split_by_filter(pages, urlfilter.bloom_filter(listed, 512), 512)
    assert flagged.filter("id < 4000 and not possible").isEmpty()
    assert flagged.filter("id >= 4000 and possible").count() < 400


def test_listed_urls_repeats_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://www.casino-win.io/a/"), (2, "http://casino-win.io/a"), (3, "http://ok.io/"), (None, None)], "page_id long, url string")
    assert [r.key for r in urlfilter.listed_urls(pages).collect()] == ["casino-win.io/a"]
    none = pages.limit(0)
    assert urlfilter.judge(none, urlfilter.listed_urls(none)).count() == 0
    twice = urlfilter.judge(pages.union(pages), urlfilter.listed_urls(pages)).collect()
    assert sorted(str((r.id, r.verdict)) for r in twice) == sorted(2 * [str(x) for x in [(1, "block"), (2, "block"), (3, "allow"), (None, "allow")]])


def test_the_filter_grows_with_its_list(spark):
    assert [urlfilter.blocks_for(n) for n in (0, 1, 16, 17, 10**6, 10**12)] == [1, 1, 1, 2, 62_500, urlfilter.MOST_BLOCKS]
    n = 40_000
    listed = spark.range(n).selectExpr("concat('k', id) AS key")
    blocks = urlfilter.blocks_for(n)
    bloom = urlfilter.bloom_filter(listed, blocks)
    assert bloom.count() <= blocks
    others = spark.range(n, 6 * n).selectExpr("id", "concat('k', id) AS key")
    assert urlfilter.split_by_filter(others, bloom, blocks).filter("possible").count() < 5 * n // 1000


def test_an_empty_list_and_long_urls(spark):
    long = "http://h.org/" + "a" * 300_000
    pages = spark.createDataFrame([(1, long), (2, long + "/"), (3, "http://h.org/b")], "page_id long, url string")
    empty = spark.createDataFrame([], "key string")
    assert {r.verdict for r in urlfilter.judge(pages, empty).collect()} == {"allow"}
    listed = spark.createDataFrame([(long[7:],)], "key string")
    assert sorted((r.id, r.verdict) for r in urlfilter.judge(pages, listed).collect()) == [(1, "block"), (2, "block"), (3, "allow")]
