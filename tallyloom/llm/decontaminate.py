"""Benchmark decontamination with a distributed positional inverted index.

Everything here is DataFrame operations. The index stores a posting (term, row,
position) for the training tokens that can anchor a benchmark window. Each
window is searched from its rarest corpus terms: their posting lists, moved back
by the term's offset, are intersected on (row, start). What survives is compared
word for word on the row itself, so matches are exact; rows are never sampled
and frequent terms are never dropped.

A window is near where its rarest term stands and every other word of it stands at
most ``slop`` words off its place beside that term. The same two lists then meet
within ``slop`` of each other, and all words are compared on the row. An exact
match is near, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.llm.common import quoted, words, written
from tallyloom.llm.urlfilter import blocks_for, bloom_filter, split_by_filter

WINDOW = 10
#: How far off its place a word of a near match may stand.
SLOP = 3
#: Starts of near matches meet in buckets of so many words.
SPAN = 16
#: Posting lists that are intersected for each window.
LISTS = 2
#: Rows and bytes up to which a measured side is broadcast; beyond either the same join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20


def _small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a written table if it has few rows and, written out, few bytes; else leave the join to shuffle."""
    size = F.octet_length(F.to_json(F.struct(*[df[quoted(c)].alias(c) for c in df.columns])))
    counted = df.select(size.alias("size")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if counted[0] <= rows and counted[1] <= most else df


def windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``(item, phrase, terms)``: each item's runs of ``size`` words; a shorter item is one window, an empty one none."""
    listed = bench.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (
        listed.filter(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("terms"))
        .select("item", F.array_join("terms", " ").alias("phrase"), "terms")
        .distinct()
    )


def tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, th, n_words, w)``, stored: the words of every row, cut out of its text once for all that follows.

    A row's key is its id with a hash of its text, so rows that share an id stay apart.
    """
    own = lambda c: docs[quoted(c)]
    listed = docs.select(own(id_col).alias("id"), F.xxhash64(own(text_col)).alias("th"), words(own(text_col)).alias("w"))
    return written(listed.select("id", "th", F.size("w").cast("long").alias("n_words"), "w"), "tokens")


def tokens(rows: DataFrame) -> DataFrame:
    """``(id, th, pos, term)`` of tokenised rows."""
    return rows.select("id", "th", F.posexplode("w").alias("pos", "term"))


def anchors(found: DataFrame, toks: DataFrame, lists: int = LISTS) -> DataFrame:
    """``(phrase, n_lists, rank, term, offset)``: the rarest corpus terms of each window that can occur at all.

    Frequencies are counted over all tokens. A window with a term that the corpus
    lacks cannot occur and goes.
    """
    placed = written(
        found.select("phrase", "terms").distinct().select("phrase", F.posexplode("terms").alias("offset", "term")), "bench"
    )
    vocabulary = written(placed.select("term").distinct(), "vocabulary")
    freq = toks.join(_small(vocabulary), "term").groupBy("term").agg(F.count("*").alias("freq"))
    ranked = placed.join(freq, "term", "left").withColumns(
        {
            "rank": F.row_number().over(W.partitionBy("phrase").orderBy("freq", "offset")),
            "absent": F.count_if(F.col("freq").isNull()).over(W.partitionBy("phrase")),
            "n_lists": F.least(F.count("*").over(W.partitionBy("phrase")), F.lit(lists)),
        }
    )
    return ranked.filter(f"absent = 0 and rank <= {lists}").select("phrase", "n_lists", "rank", "term", "offset")


def positional_index(toks: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings ``(id, th, pos, term)`` of the terms asked for."""
    return written(toks.join(_small(terms), "term", "left_semi").select("term", "id", "th", "pos"), "postings")


class Decontaminator:
    """The index of one corpus for one benchmark, with exact and proximity search."""

    def __init__(self, docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", bench_text: str = "text", size: int = WINDOW, lists: int = LISTS):
        self.rows = tokenised(docs, id_col, text_col)
        self.windows = written(windows(bench, item_col, bench_text, size), "windows")
        toks = tokens(self.rows)
        self.anchors = written(anchors(self.windows, toks, lists), "anchors")
        self.index = positional_index(toks, written(self.anchors.select("term").distinct(), "terms"))

    def _moved(self, rank: int, slop: int) -> DataFrame:
        """Offset-adjusted list: where each window would start, by its anchor of this rank."""
        return (
            self.index.join(_small(self.anchors.filter(F.col("rank") == rank)), "term")
            .select("phrase", "n_lists", "id", "th", (F.col("pos") - F.col("offset")).alias("start"))
            .filter(F.col("start") >= -2 * slop)
        )

    def candidates(self, slop: int = 0) -> DataFrame:
        """``(phrase, id, th, start)`` where a window's anchor lists meet, up to ``slop`` words apart."""
        first = self._moved(1, slop)
        rest = self._moved(2, slop).drop("n_lists").withColumnsRenamed({"phrase": "p", "id": "i", "th": "t", "start": "s"})
        paired = first.filter("n_lists > 1")
        same = "phrase = p and id <=> i and th = t and start = s"
        if slop:
            # What lies within ``slop`` of a start is in its bucket or in one beside it.
            bucket = lambda c: F.floor(c / max(SPAN, 2 * slop + 1))
            start = F.col("start")
            paired = paired.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(start - slop), bucket(start + slop)))))
            rest = rest.withColumn("b", bucket(F.col("s")))
            same = f"phrase = p and id <=> i and th = t and bucket = b and abs(start - s) <= {slop}"
        columns = ["phrase", "id", "th", "start"]
        return first.filter("n_lists = 1").select(*columns).union(paired.join(rest, F.expr(same), "left_semi").select(*columns)).distinct()

    def matches(self, slop: int = 0) -> DataFrame:
        """Exact phrase matches per row: ``(id, th, found)`` with ``found`` an array of (start, phrase).

        With a ``slop`` there is an array ``near`` of the near matches beside it, and
        rows with either of them are listed.

        A candidate list is bounded by its row's words times the few windows that
        can start at one word. Rows meet their candidates in a shuffle; a Bloom filter
        of bounded size keeps the words of nearly all other rows out of it.
        """
        listed = written(
            self.candidates(slop).groupBy("id", "th").agg(F.collect_list(F.struct("start", "phrase")).alias("cands")), "candidates"
        )
        blocks = blocks_for(listed.count())
        bloom = bloom_filter(listed.select(F.col("th").alias("key")), blocks)
        possible = split_by_filter(self.rows.select("id", "th", "w", F.col("th").alias("key")), bloom, blocks).filter("possible")
        side = listed.withColumnsRenamed({"id": "i", "th": "t"}).hint("merge")
        joined = possible.join(side, F.expr("id <=> i and th = t")).select("id", "th", "w", "cands")
        exact = lambda c: (c["start"] >= 0) & (
            F.array_join(F.slice("w", F.greatest(c["start"], F.lit(0)) + 1, F.size(F.split(c["phrase"], " "))), " ") == c["phrase"]
        )

        def near(c: Column) -> Column:
            def stands(term: Column, j: Column) -> Column:
                low = F.greatest(c["start"] + j - slop, F.lit(0))
                return F.array_contains(F.slice("w", low + 1, F.greatest(c["start"] + j + slop + 1 - low, F.lit(0))), term)

            return F.forall(F.transform(F.split(c["phrase"], " "), stands), lambda held: held)

        held = {"found": F.filter("cands", exact)}
        if slop:
            held["near"] = F.filter("cands", lambda c: exact(c) | near(c))
        listed = joined.select("id", "th", *[c.alias(n) for n, c in held.items()])
        return listed.filter(" or ".join(f"size({n}) > 0" for n in held)).dropDuplicates(["id", "th"])

    def proximity(self, slop: int = SLOP) -> DataFrame:
        """``(id, th, item, phrase, start, exact)``: every near match of a window of an item, and whether it is exact."""
        listed = self.matches(slop).select("id", "th", "found", F.explode("near").alias("m"))
        placed = listed.select("id", "th", "m.phrase", "m.start", F.array_contains("found", F.col("m")).alias("exact"))
        return placed.join(_small(self.windows.select("item", "phrase")), "phrase").select("id", "th", "item", "phrase", "start", "exact")

    def report(self, slop: int = SLOP) -> DataFrame:
        """``(id, n_words, n_hit, items, contaminated, near_items)`` for every row of the corpus.

        Null texts have no words and no hits. Repeated rows each get their line.
        ``items`` holds the matching item ids as sorted strings, ``near_items`` those
        with near matches. An item with a null id is no item.
        """
        found = written(self.matches(slop), "matches")
        spans = F.array_sort(F.transform("found", lambda m: F.struct(m["start"], (m["start"] + F.size(F.split(m["phrase"], " "))).alias("stop"))))
        merged = F.aggregate(
            spans,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
            lambda a, s: F.struct(
                (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["reach"], s["start"]))).alias("n"),
                F.greatest(a["reach"], s["stop"]).alias("reach"),
            ),
        )
        hit = found.select("id", "th", merged["n"].alias("n_hit"))
        phrases = lambda name: F.transform(name, lambda m: F.struct(m["phrase"].alias("phrase"), F.lit(name).alias("kind")))
        ids = lambda name: F.array_sort(F.collect_set(F.when(F.col("kind") == name, F.col("item").cast("string"))))
        items = (
            found.select("id", "th", F.inline(F.array_distinct(F.concat(phrases("found"), phrases("near")))))
            .join(_small(self.windows.select("item", "phrase")), "phrase")
            .groupBy("id", "th").agg(ids("found").alias("items"), ids("near").alias("near_items"))
        )
        named = hit.join(items.withColumnsRenamed({"id": "i", "th": "t"}), F.expr("id <=> i and th = t")).select(
            F.col("id").alias("hit_id"), F.col("th").alias("hit_th"), "n_hit", "items", "near_items"
        )
        named = _small(written(named, "hits"))
        return self.rows.select("id", "th", "n_words").join(named, F.expr("id <=> hit_id and th = hit_th"), "left").select(
            "id", "th", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"),
        )


def decontaminate(docs: DataFrame, bench: DataFrame, **names) -> DataFrame:
    """Hits of every row of ``docs`` against the windows of ``bench``; see ``Decontaminator.report``."""
    return Decontaminator(docs, bench, **names).report()


def without_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs; their columns stay as they are, whatever their names."""
    found = Decontaminator(docs, bench, id_col, text_col, **names).matches()
    found = _small(written(found.select(F.col("id").alias("leak_id"), F.col("th").alias("leak_th")), "leaks"))
    own = lambda c: F.col(f"own.{quoted(c)}")
    same = own(id_col).eqNullSafe(F.col("found.leak_id")) & (F.xxhash64(own(text_col)) == F.col("found.leak_th"))
    return docs.alias("own").join(found.alias("found"), same, "left_anti")
