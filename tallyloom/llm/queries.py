"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import alignment, ann, decontaminate, licenses, packing, prefixes, revisits, sharding, simhash, substrings, toxicity, tries, urlfilter
from tallyloom.llm.common import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op5_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in every document, and the items near by."""
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
        F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"),
    )


ORACLE_SQL["op8_positional_index"] = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT rid, s, k, array_to_string(w[s : s + k - 1], ' ') AS phrase
  FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM w, ks WHERE len(w) >= k)),
m AS (SELECT d.rid, d.s, d.k, b.item_id FROM dw d JOIN bw b ON d.k = b.k AND d.phrase = b.phrase),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + k - 1)) AS p FROM m) GROUP BY rid),
it AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY rid),
tok AS (SELECT rid, unnest(generate_series(0, len(w) - 1)) AS pos, unnest(w) AS term FROM w WHERE len(w) > 0),
freq AS (SELECT term, count(*) AS freq FROM tok GROUP BY term),
pt AS (SELECT phrase, string_split(phrase, ' ') AS terms FROM bw GROUP BY phrase),
pl AS (
  SELECT p.*, freq, count(*) FILTER (freq IS NULL) OVER (PARTITION BY phrase) AS absent
  FROM (SELECT phrase, terms, unnest(generate_series(0, len(terms) - 1)) AS o, unnest(terms) AS term FROM pt) p LEFT JOIN freq USING (term)),
an AS (SELECT * FROM pl WHERE absent = 0 QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY freq, o) = 1),
ca AS (SELECT tok.rid, phrase, terms, pos - o AS s, w FROM tok JOIN an USING (term) JOIN w ON w.rid = tok.rid),
ne AS (
  SELECT DISTINCT rid, phrase FROM ca
  WHERE len(list_filter(generate_series(0, len(terms) - 1), lambda j: list_contains(w[greatest(s + j - 3, 0) + 1 : greatest(s + j + 4, 0)], terms[j + 1]))) = len(terms)),
ni AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM ne JOIN bw USING (phrase)) GROUP BY rid)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated,
  coalesce(ni.n_items, 0) AS n_near_items, sha256(coalesce(ni.items, '')) AS near_items_sha256
FROM w LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid) LEFT JOIN ni USING (rid)"""


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exact substring removal takes from every document."""
    return substrings.dedup_substrings(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of every category for every document."""
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


@query
def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def crawl_records(pages: DataFrame) -> DataFrame:
    """WARC-like records from pages: a full response for each, and one revisit some time after it.

    Entity tags are digests of the page; every fourth page by digest sends a
    Last-Modified only, and every eighth revisit's tag has changed.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    kind = F.conv(F.substring("digest", 1, 2), 16, 10).cast("int")
    base = pages.select("page_id", "url", digest.alias("digest"), F.length("html").cast("string").alias("size")).withColumn("kind_no", kind)
    date = F.concat(F.lit("day-"), F.substring("digest", 3, 3))
    tag = F.concat(F.lit('"'), F.col("digest"), F.lit('"'))
    pairs = lambda *p: F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n, _ in p]), F.array(*[v for _, v in p])), lambda k, v: v.isNotNull())
    response = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("at"), F.lit("response").alias("kind"),
        pairs(("etag", F.when(F.col("kind_no") % 4 != 0, tag)), ("last-modified", date), ("content-length", F.col("size")), ("date", F.concat(F.lit("t"), F.col("page_id").cast("string"))), ("cache-control", F.lit("max-age=60"))).alias("headers"),
        "digest",
    )
    changed = F.when(F.col("kind_no") % 8 == 1, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    revisit = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 10 + 5 + F.col("kind_no")).alias("at"), F.lit("revisit").alias("kind"),
        pairs(("etag", F.when(F.col("kind_no") % 4 != 0, changed)), ("last-modified", F.when(F.col("kind_no") % 16 != 0, date)), ("content-length", F.lit("0")), ("date", F.concat(F.lit("u"), F.col("page_id").cast("string"))), ("expires", F.lit("later"))).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return response.union(revisit)


@query
def op4_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit record with the response it stands for."""
    out = revisits.resolve(crawl_records(table(spark, sf_dir, "pages")))
    return out.select(
        "record_id", F.col("key").alias("canonical_url"), "response_id", "check", "resolved",
        F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("headers"),
        "digest",
    )


ORACLE_SQL["op4_revisit_resolution"] = r"""
WITH b AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, CAST(length(html) AS VARCHAR) AS size,
    CAST(('0x' || substr(md5(coalesce(html, '')), 1, 2)) AS INTEGER) AS k,
    CASE WHEN contains(url, '://') THEN string_split(substr(url, strpos(url, '://') + 3), '#')[1] END AS rest
  FROM pages),
u AS (
  SELECT *, string_split(rest, '?')[1] AS place, list_sort(list_filter(string_split(substr(rest, strpos(rest || '?', '?') + 1), '&'), lambda x: x <> '')) AS asked FROM b),
h AS (
  SELECT *, translate(string_split(place, '/')[1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
c AS (
  SELECT *, CASE WHEN rest IS NULL THEN url ELSE
      CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE host END || rtrim(substr(place, length(host) + 1), '/')
      || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS key,
    '"' || digest || '"' AS tag, 'day-' || substr(digest, 3, 3) AS day
  FROM h),
r AS (
  SELECT page_id * 2 AS record_id, key, page_id * 10 AS at, CASE WHEN k % 4 <> 0 THEN tag END AS etag, day AS modified, size, page_id, digest FROM c),
v AS (
  SELECT page_id * 2 + 1 AS record_id, key, page_id * 10 + 5 + k AS at,
    CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 8 = 1 THEN '"changed"' ELSE 'W/' || tag END END AS etag,
    CASE WHEN k % 16 <> 0 THEN day END AS modified, page_id FROM c),
m AS (
  SELECT v.*, arg_max(r.record_id, (r.at, r.record_id)) AS response_id
  FROM v LEFT JOIN r ON v.key = r.key AND (r.at < v.at OR r.at = v.at AND r.record_id < v.record_id)
  GROUP BY ALL),
j AS (
  SELECT m.*, r.etag AS old_etag, r.modified AS old_modified, r.size AS old_size, r.page_id AS old_page, r.digest AS old_digest,
    CASE WHEN m.response_id IS NULL THEN 'no-response'
      WHEN m.etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN regexp_replace(m.etag, '^W/', '') = r.etag THEN 'etag' ELSE 'etag-differs' END
      WHEN m.modified IS NOT NULL AND r.modified IS NOT NULL THEN CASE WHEN m.modified = r.modified THEN 'last-modified' ELSE 'last-modified-differs' END
      ELSE 'no-validator' END AS "check"
  FROM m LEFT JOIN r ON m.response_id = r.record_id)
SELECT record_id, key AS canonical_url, CASE WHEN "check" IN ('etag', 'last-modified') THEN response_id END AS response_id, "check",
  "check" IN ('etag', 'last-modified') AS resolved,
  CASE WHEN "check" IN ('etag', 'last-modified') THEN
    'cache-control=max-age=60;content-length=' || old_size || ';date=u' || page_id || coalesce(';etag=' || coalesce(etag, old_etag), '') || ';expires=later'
    || coalesce(';last-modified=' || coalesce(modified, old_modified), '')
  ELSE 'content-length=0;date=u' || page_id || coalesce(';etag=' || etag, '') || ';expires=later' || coalesce(';last-modified=' || modified, '') END AS headers,
  CASE WHEN "check" IN ('etag', 'last-modified') THEN old_digest END AS digest
FROM j"""


@query
def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document."""
    out = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "part", "map_version", "next_shard",
    )


@query
def op7_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for every page."""
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.listed_urls(pages)).withColumnRenamed("id", "page_id")


ORACLE_SQL["op7_blocked_bloom"] = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
k AS (SELECT *, regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '/+$', '') AS key FROM p),
listed AS (
  SELECT DISTINCT key FROM k WHERE list_has_any(string_split(host, '.'), ['ads-track', 'casino-win', 'cheap-pills', 'free-bets'])),
rules AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(verdict, rhost, rpath)),
f AS (
  SELECT page_id, host, path, key, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS said
  FROM k LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, host, path, rule,
  coalesce(said, CASE WHEN f.key <> '' AND f.key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
  f.key <> '' AND f.key IN (SELECT key FROM listed) AS listed
FROM f"""


@query
def op9_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op11_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document's tokens by two tokenizers."""
    documents, _ = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return documents.withColumnRenamed("id", "doc_id")


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return tries.prefix_trie(tries.rebuilt(tries.conversation_rows(table(spark, sf_dir, "conversations"))))


@query
def op13_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and how much of it the limit leaves."""
    return prefixes.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
