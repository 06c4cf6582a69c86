"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints within Hamming distance ``RADIUS`` must meet in some table. Give
each bit position a vector of ``RADIUS + 1`` bits; every non-zero vector ``v``
defines a mask that keeps the positions whose vector is odd against ``v``. The
vectors of at most ``RADIUS`` differing positions never span the whole space, so
some ``v`` is even against all of them, and its mask keeps none of them: the two
fingerprints agree there. That is a guarantee, not a probability.

A table's bucket that holds many fingerprints is cut again by the same
construction over the bits that its mask leaves free, which keeps the guarantee;
after three cuts at most 256 different fingerprints can share a bucket. Nothing
is capped or sampled.

Texts are *similar* where the sets of their five-word shingles overlap by at least
four fifths. Fingerprints of such texts differ in ten of 64 bits and often in
more; the masks that cover ten number 2,047. So ``similar`` adds tables keyed by
the least of rehashed shingles to the covering ones of radius three, and confirms
what meets in any table on the shingles themselves, first with one text of each key,
then between blocks of texts that are still in different groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import scratch, written
from tallyloom.llm.components import components

RADIUS = 3
BITS = 64
SEED = 42
#: Similar texts: words of a shingle, and the least share of two texts' shingles that both have.
SHINGLE, LEAST = 5, 0.8
#: Tables of least hashes, and the least hashes that make a key: a pair at LEAST misses all with probability (1 - LEAST ** 4) ** 12 < 0.002.
BANDS, MINIMA = 12, 4
#: Texts that are compared with one text in a task.
ROOT_SHARE = 1000
#: A block of one key's classes: about so many classes, or so many shingles.
BLOCK, BLOCK_GRAMS = 256, 1 << 20
#: Blocks of one key beyond which its classes meet by their rarest shingles.
MANY = 16
#: Shingles that are compared at once.
COLUMNS = 4096
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 16


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(found: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``shingle`` words, in chunks; of all words where they are fewer, of nothing where there are none."""
    if found and len(found) < shingle:
        found, shingle = [b" ".join(found)], 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(found) - shingle + 1, CHUNK):
        part = found[at : at + CHUNK + shingle - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        yield np.array([digest(x, SEED) for x in joined], dtype="<u8")


def simhash(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of one text; no words: zero."""
    return _fingerprint(_hashes(_words(text), shingle))


def _fingerprint(chunks: Iterable[np.ndarray]) -> int:
    """A bit is 1 where it is set in over half of the hashes."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in chunks:
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, th, fp)`` for every row: ``th`` hashes the text, ``fp`` is a signed long. Null or wordless texts get zero."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(x, shingle) for x in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), run(F.col(text_col)).alias("fp"))


def covering_masks(free: list[int], radius: int = RADIUS) -> list[tuple[int, list[int]]]:
    """Masks over the bit positions ``free``, each with the positions it leaves free."""
    size = 1 << (radius + 1)
    out = []
    for v in range(1, size):
        kept = [p for j, p in enumerate(free) if bin((j % size) & v).count("1") % 2]
        out.append((sum(1 << p for p in kept), [p for p in free if p not in set(kept)]))
    return out


def _mask_tables(levels: int = 3) -> list[list[tuple[int, int, int]]]:
    """Per level the rows (parent, table, mask); masks hold what all cuts so far keep."""
    level = [(0, 0, list(range(BITS)))]
    out = []
    for _ in range(levels):
        rows, after = [], []
        for parent, mask, free in level:
            for more, left in covering_masks(free):
                rows.append((parent, len(rows), mask | more))
                after.append((len(rows) - 1, mask | more, left))
        out.append(rows)
        level = after
    return out


def _links(found: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one small bucket."""
    bits = np.sort(found).view(np.uint64)
    left, out = np.arange(len(bits)), []
    while len(left):
        wave, left = left[:1], left[1:]
        root = wave[0]
        while len(wave) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for x in wave:
                near |= np.bitwise_count(bits[left] ^ bits[x]) <= radius
            wave, left = left[near], left[~near]
            out.extend((int(bits[x].view(np.int64)), int(bits[root].view(np.int64))) for x in wave)
    return out


def linked_pairs(fps: DataFrame, radius: int = RADIUS, limit: int = 2048) -> DataFrame:
    """Distinct fingerprints ``(fp)`` -> links ``(a, b)`` that span every group within ``radius``.

    Buckets of one fingerprint end at once. Buckets of up to ``limit`` are linked
    in a task, by a forest and not by all pairs; larger ones go to the next cut.
    """
    if radius != RADIUS:
        raise ValueError("the masks are laid out for radius 3")
    spark = fps.sparkSession

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def forest(groups: pd.Series) -> pd.Series:
        return pd.Series([_links(np.asarray(g, dtype=np.int64), radius) for g in groups])

    members = fps.select("fp", F.lit(0).alias("part"))
    out = None
    tables = _mask_tables()
    for depth, rows in enumerate(tables):
        masks = spark.createDataFrame([(p, t, m - (1 << 64) if m >> 63 else m) for p, t, m in rows], "part int, cut int, mask long")
        keyed = members.join(F.broadcast(masks), "part").select(
            "fp", F.col("cut").alias("part"), F.expr("fp & mask").alias("key")
        )
        if depth:
            keyed = keyed.distinct()
        sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1")
        sized = keyed.join(sizes, ["part", "key"])
        last = depth == len(tables) - 1
        small = sized if last else sized.filter(F.col("n") <= limit)
        grouped = small.groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
        found = grouped.select(F.explode(forest("fps")).alias("e")).select("e.a", "e.b")
        found = written(found.distinct(), "links")
        out = found if out is None else out.union(found)
        if last:
            break
        members = written(sized.filter(F.col("n") > limit).select("fp", "part"), "dense")
        if members.isEmpty():
            break
    return out.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 2048) -> DataFrame:
    """``(id, th, fp, root, component)`` for every row of ``docs``; ``root`` is the group's least fingerprint.

    ``component`` is the smallest id reachable over fingerprints that differ in
    at most three bits. Rows with null text or without words have fingerprint
    zero and are linked like any other; rows with a null id take part and get the
    smallest id of their group, null only if no member has one. Repeated rows
    stay. Equal fingerprints form one class before any table is built, so a group
    of copies costs one entry.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(linked_pairs(classes.select("fp"), limit=limit))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    reach = placed.groupBy("root").agg(F.min("least").alias("component"))
    final = written(placed.join(reach, "root").select("fp", "root", "component"), "placed")
    return rows.join(final, "fp").select("id", "th", "fp", "root", "component")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_COVER = np.array([mask for _, _, mask in _mask_tables(1)[0]], dtype=np.uint64)
_REHASH = _mixed(np.arange(1, BANDS * MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(text: str | None, shingle: int = SHINGLE) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's class (its set of shingles), its keys in all tables, and half of the bits of its shingles' hashes. A wordless text has no keys.

    32 bits tell the shingles of two texts apart: of 10,000 times 10,000 of them 0.02 agree by chance.
    """
    chunks = list(_hashes(_words(text), shingle))
    if not chunks:
        return xxhash.xxh3_128_digest(b""), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
    grams = np.unique(np.concatenate(chunks))
    least = np.full(len(_REHASH), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 4096):
        part = grams[at : at + 4096]
        least = np.minimum(least, _mixed(part[None, :] * _REHASH[:, None]).min(axis=1))
    bands = np.zeros(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, MINIMA).T:
        bands = _mixed(bands + column)
    met = np.concatenate([np.array([_fingerprint(chunks)], dtype="<i8").view(np.uint64) & _COVER, bands])
    few = np.unique((grams >> np.uint64(32)).astype(np.uint32))
    return xxhash.xxh3_128_digest(grams.tobytes()), _mixed(met + np.arange(len(met), dtype=np.uint64) * _REHASH[0]), few


def _sketched(shingle: int):
    def lists(arrays: list[np.ndarray], signed: type) -> pa.Array:
        ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(signed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [sketch(x, shingle) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([c for c, _, _ in made], pa.binary()), lists([k for _, k, _ in made], np.int64), lists([g for _, _, g in made], np.int32)],
                    names=["id", "th", "class", "keys", "grams"],
                )

    return run


def _confirmed(pairs: DataFrame, grams: DataFrame, least: float) -> DataFrame:
    """The pairs ``(class, root)`` whose shingles overlap enough. A root that many classes ask for is dealt to several tasks."""
    shares = pairs.groupBy("root").agg(F.ceil(F.count("*") / ROOT_SHARE).cast("int").alias("parts"))
    shares = written(shares, "shares")
    dealt = pairs.join(shares, "root").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    roots = grams.withColumnsRenamed({"class": "root", "grams": "others"}).join(shares, "root").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sides = dealt.join(grams, "class").select("class", "root", "part", "grams").join(roots.select("root", "part", "others"), ["root", "part"])
    both = F.size(F.array_intersect("grams", "others"))
    return sides.filter(both >= least * (F.size("grams") + F.size("others") - both)).select("class", "root")


def _unlike(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(key, class, root, size)`` of the keys whose classes ``links`` leave in several groups; of keys with the same classes one."""
    roots = components(links.withColumnsRenamed({"class": "a", "root": "b"})).withColumnsRenamed({"node": "class", "root": "known"})
    rooted = written(members.join(roots, "class", "left").select("key", "class", "size", F.coalesce("known", "class").alias("root")), "rooted")
    mark = lambda seed: F.sum(F.xxhash64("class", F.lit(seed)).cast("decimal(38,0)"))
    keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), mark(1).alias("x"), mark(2).alias("y"))
    keys = keys.filter("low < high").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return written(rooted.join(keys, "key", "left_semi"), "unlike")


def _rarest(classes: DataFrame, grams: DataFrame, least: float) -> DataFrame:
    """``(key, class, size)``: every class under each of its rarest shingles, as many as leave fewer than the share that two similar sets must have in common.

    Two sets that overlap by ``least`` have one of those in common, however often their other shingles occur.
    """
    each = classes.join(grams, "class").select("class", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    each = written(each, "shingles")
    ranked = each.join(each.groupBy("gram").agg(F.count("*").alias("often")), "gram").withColumn(
        "rank", F.row_number().over(Window.partitionBy("class").orderBy("often", "gram"))
    )
    taken = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1
    return ranked.filter(F.col("rank") <= taken).select(F.col("gram").cast("long").alias("key"), "class", "size")


def _between(least: float):
    """Links that join groups within one pair of blocks: a forest, not all pairs."""

    def run(block: pa.Table) -> pa.Table:
        names, roots = block.column("class").to_pylist(), block.column("root").to_pylist()
        here = np.array(block.column("here").to_pylist(), dtype=bool)
        arrays = [np.asarray(x.values) for x in block.column("grams")]
        sizes = np.array([len(x) for x in arrays], dtype=np.int64)
        rows, values = np.repeat(np.arange(len(names)), sizes), np.concatenate(arrays)
        _, column, often = np.unique(values, return_inverse=True, return_counts=True)
        shared = often[column] > 1
        rows, column = rows[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        one, two = (np.flatnonzero(here), np.flatnonzero(~here))
        two = two if len(two) else one
        both = np.zeros((len(one), len(two)), dtype=np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            held = np.zeros((len(names), COLUMNS), dtype=np.float32)
            held[rows[lo:hi], column[lo:hi] - at] = 1
            both += held[one] @ held[two].T
        both = both.astype(np.float64)
        near = both >= least * (sizes[one][:, None] + sizes[two][None, :] - both)
        parent = {r: r for r in roots}

        def top(r):
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        out = []
        for i, j in np.argwhere(near):
            i, j = one[i], two[j]
            x, y = top(roots[i]), top(roots[j])
            if x != y:
                parent[y] = x
                out.append((names[i], names[j]))
        return pa.table({"class": pa.array([a for a, _ in out], pa.binary()), "root": pa.array([b for _, b in out], pa.binary())})

    return run


def _settled(unlike: DataFrame, grams: DataFrame, least: float) -> DataFrame:
    """Links between the groups of every key: its classes are dealt to blocks by size and hash, and pairs of blocks are compared in tasks.

    A block holds about ``BLOCK`` classes or ``BLOCK_GRAMS`` shingles. Sizes of similar
    sets differ by at most one size class, so only those blocks are paired.
    """
    tier = F.floor(F.log("size") / F.log(F.lit(1 / least)) + 1e-9).cast("long")
    unlike = unlike.withColumn("tier", tier)
    weight = F.sum(F.greatest(F.lit(1 / BLOCK), F.col("size") / BLOCK_GRAMS))
    cells = written(unlike.groupBy("key", "tier").agg(F.ceil(weight).cast("long").alias("parts")), "cells")
    blocks = cells.select("key", "tier", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt = unlike.join(cells, ["key", "tier"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")))
    other = blocks.select("key", F.col("tier").alias("tier2"), F.col("part").alias("part2"))
    paired = blocks.join(other, "key").filter("tier2 = tier + 1 or tier2 = tier and part2 >= part")
    sides = F.array(F.struct("tier", "part", F.lit(True).alias("here")), F.struct(F.col("tier2").alias("tier"), F.col("part2").alias("part"), F.lit(False).alias("here")))
    place = F.struct("tier", "part", "tier2", "part2").alias("pair")
    sides = paired.select("key", place, F.explode(F.when(F.expr("tier = tier2 and part = part2"), F.slice(sides, 1, 1)).otherwise(sides)).alias("side"))
    sides = sides.select("key", "pair", "side.*")
    shipped = dealt.join(sides, ["key", "tier", "part"]).select("key", "pair", "class", "root", "here").join(grams, "class")
    return shipped.groupBy("key", "pair").applyInArrow(_between(least), "class binary, root binary")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``(id, th, root)`` for every row of ``docs``: ``root`` names the group of similar texts, ``th`` hashes the text.

    Texts with the same shingles are one class. In every table the classes of a key
    are compared with the least of them. Keys whose classes are then still in several
    groups are compared block by block, without the pairs that are in one group
    already. Where such a key holds more than ``MANY`` blocks, as with a passage that
    very many texts share, its classes meet by their rarest shingles first, which
    loses no pair. Null and wordless texts are one group; ids may be null or repeated.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    rows = written(rows.mapInArrow(_sketched(shingle), f"id {kind}, th long, class binary, keys array<long>, grams array<int>"), "sketches")
    classes = rows.groupBy("class").agg(F.first("keys").alias("keys"), F.first(F.size("grams")).alias("size"))
    members = written(classes.select(F.explode("keys").alias("key"), "class", "size"), "members")
    keys = written(members.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("least")).filter("n > 1"), "keys")
    met = written(members.join(keys, "key").select("key", "class", "size", "n", F.col("least").alias("root")), "met")
    if met.isEmpty():
        return rows.select("id", "th", F.col("class").alias("root"))
    asked = met.select("class").distinct()
    grams = written(rows.select("class", "grams").join(asked, "class", "left_semi").groupBy("class").agg(F.first("grams").alias("grams")), "grams")
    links = written(_confirmed(met.filter("class > root").select("class", "root").distinct(), grams, least), "links")
    left = _unlike(met.filter("n > 2 and class > root").select("key", "class", "size"), links)
    weight = F.sum(F.greatest(F.lit(1 / BLOCK), F.col("size") / BLOCK_GRAMS))
    dense = written(left.groupBy("key").agg(weight.alias("blocks")).filter(F.col("blocks") > MANY).select("key"), "dense")
    links = links.union(written(_settled(left.join(dense, "key", "left_anti"), grams, least), "links"))
    if not dense.isEmpty():
        hot = left.join(dense, "key", "left_semi").select("class").distinct()
        links = links.union(written(_settled(_unlike(_rarest(hot, grams, least), links), grams, least), "links"))
    roots = components(links.withColumnsRenamed({"class": "a", "root": "b"})).withColumnRenamed("node", "class")
    return rows.select("id", "th", "class").join(roots, "class", "left").select("id", "th", F.coalesce("root", "class").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of every group of similar texts: that of the smallest id, then of the smallest text hash.

    A null id counts after all others. Of repeated rows one stays. Columns stay as
    they are, whatever their names.
    """
    with scratch(docs.sparkSession) as lasting:
        groups = written(similar(docs, id_col, text_col, shingle, least), "groups")
        first = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("k"))
        keep = lasting(first.select(F.col("k.id").alias("keep_id"), F.col("k.th").alias("keep_th")).distinct(), "keep")
        repeated = not groups.groupBy("id", "th").count().filter("count > 1").isEmpty()
    same = (F.xxhash64(docs[text_col]) == keep["keep_th"]) & docs[id_col].eqNullSafe(keep["keep_id"])
    kept = docs.join(keep, same, "left_semi")
    return kept.dropDuplicates([id_col, text_col]) if repeated else kept
