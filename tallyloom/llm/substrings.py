"""Exact removal of long repeated substrings with a sampled, distributed suffix array.

A byte goes if some 200-byte string that covers it also starts elsewhere in the
corpus. Sorting every suffix of a corpus would move hundreds of bytes for each
byte of text, so the suffix array is sparse: each 200-byte window elects one of
its positions, the start of its least-hashed 32-byte string (leftmost on ties).
The election looks at the window alone, so equal windows elect the same relative
position, and an elected suffix meets all its equals under the same 32 bytes.

1. Equal whole texts become one, with their count.
2. Elected suffixes are keyed by their 32 bytes and by a hash of all that any of
   their windows can see (up to 168 bytes before and 200 after).
3. A key of one suffix has no repeat. Where all surroundings are alike, every
   window of every suffix repeats. Only the mixed keys, at the edges of repeats,
   ship surroundings; one suffix stands for all that have the same.
4. A mixed key's suffixes are ordered by deep-shallow sorting, forwards, and
   backwards by what precedes; two windows are equal where they fall in one class
   of both orders. Keys with very many different surroundings are dealt out by
   window instead of meeting in one task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import suffixsort
from tallyloom.llm.common import quoted, shared_folder, written

LENGTH = 200
GRAM = 32
#: Positions of a window that can be elected.
CHOICES = LENGTH - GRAM + 1
#: Bytes of a text that are hashed at once; with LENGTH - 1 more it must stay under 2 ** POS_BITS.
CHUNK = 1 << 19
POS_BITS = 20
#: Different surroundings of one key that a task sorts; keys with more are dealt out by window.
MOST = 4000

_BASE = 0x9E3779B97F4A7C15
_SIZE = CHUNK + LENGTH


def _powers(base: int) -> np.ndarray:
    out = np.full(_SIZE, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP: list[np.ndarray] = []


def elected(raw: bytes) -> np.ndarray:
    """The elected positions of one text, ascending."""
    if not _UP:
        _UP.extend((_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))))
    up, down = _UP
    out = []
    full = np.frombuffer(raw, dtype=np.uint8)
    for at in range(0, len(raw) - LENGTH + 1, CHUNK):
        part = full[at : at + CHUNK + LENGTH - 1]
        n = len(part)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h >>= np.uint64(POS_BITS)
        h <<= np.uint64(POS_BITS)
        h |= np.arange(len(h), dtype=np.uint64)
        rows = -(-len(h) // CHOICES)
        grid = np.full(rows * CHOICES, np.iinfo(np.uint64).max, dtype=np.uint64)
        grid[: len(h)] = h
        grid = grid.reshape(rows, CHOICES)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - LENGTH + 1
        least = np.minimum(behind[:windows], ahead[CHOICES - 1 : CHOICES - 1 + windows])
        least &= np.uint64((1 << POS_BITS) - 1)
        keep = np.ones(windows, dtype=bool)
        keep[1:] = least[1:] != least[:-1]
        out.append(least[keep].astype(np.int64) + at)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, raw) -> (t1, t2, pos, k, c): key hash and surroundings hash of each elected suffix."""
    for batch in batches:
        t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        counts, pos, k, c = [], [], [], []
        for raw in batch.column(2).to_pylist():
            at = elected(raw)
            counts.append(len(at))
            pos.append(at)
            for a in at.tolist():
                lo = a - CHOICES + 1 if a >= CHOICES else 0
                k.append(xxhash.xxh64_intdigest(raw[a : a + GRAM]))
                c.append(xxhash.xxh3_64_intdigest(raw[lo : a + LENGTH], a - lo))
        if not k:
            continue
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(t1, counts)), pa.array(np.repeat(t2, counts)),
                pa.array(np.concatenate(pos).astype(np.int32)),
                pa.array(np.array(k, dtype=np.uint64).view(np.int64)), pa.array(np.array(c, dtype=np.uint64).view(np.int64)),
            ],
            names=["t1", "t2", "pos", "k", "c"],
        )


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, raw, picks) -> one row per picked suffix with the bytes before (reversed) and from it."""
    for batch in batches:
        cols = {n: [] for n in ("t1", "t2", "pos", "k", "n", "m", "left", "right")}
        for t1, t2, raw, picks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for p in picks:
                a = p["pos"]
                for name, x in zip(cols, (t1, t2, a, p["k"], p["n"], p["m"], raw[max(0, a - CHOICES + 1) : a][::-1], raw[a : a + LENGTH]), strict=True):
                    cols[name].append(x)
            if len(cols["pos"]) >= 20_000:
                yield pa.RecordBatch.from_pydict(cols, schema=_ROWS)
                cols = {n: [] for n in cols}
        if cols["pos"]:
            yield pa.RecordBatch.from_pydict(cols, schema=_ROWS)


_ROWS = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("pos", pa.int32()), ("k", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])


def repeated_windows(keys: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For suffixes sorted by key: a row of flags each, true at i where the window that starts i bytes before repeats.

    ``left`` is what precedes a suffix, reversed; ``right`` is the suffix, cut at
    LENGTH. In the order of the suffixes two of them share t bytes where no
    neighbour between them shares fewer, so a running count of such breaks numbers
    the classes; the same holds backwards.
    """
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ranges = list(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True))
    fore, back = suffixsort.order(right, ranges), suffixsort.order(left, ranges)
    fore_lcp = suffixsort.neighbour_lcp(right, fore, starts, LENGTH)
    back_lcp = suffixsort.neighbour_lcp(left, back, starts, CHOICES - 1)
    left_n, right_n = (np.fromiter(map(len, x), dtype=np.int64, count=n) for x in (left, right))
    flags = np.zeros((n, CHOICES), dtype=bool)
    fore_class, back_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i in range(CHOICES):
        ok = np.flatnonzero((left_n >= i) & (right_n >= LENGTH - i))
        if len(ok) < 2:
            continue
        fore_class[fore] = np.cumsum(fore_lcp < LENGTH - i)
        back_class[back] = np.cumsum(back_lcp < i)
        key = fore_class[ok] * (n + 1) + back_class[ok]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(ok), dtype=bool)
        hit[by[1:]] |= same
        hit[by[:-1]] |= same
        flags[ok[hit], i] = True
    return flags


def _spans(flags: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first, last) of every run of true flags."""
    edge = np.zeros((len(flags), 1), dtype=np.int8)
    step = np.diff(np.hstack([edge, flags.astype(np.int8), edge]), axis=1)
    rows, begin = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return list(zip(rows.tolist(), begin.tolist(), (end - 1).tolist(), strict=True))


def _sorted_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in key order -> the spans that repeat; a key cut by a batch's end waits for the next batch."""
    names = ["t1", "t2", "pos", "k", "n", "left", "right"]
    held = {n: [] for n in names}

    def done(upto: int) -> pa.RecordBatch:
        now = {n: held[n][:upto] for n in names}
        for n in names:
            held[n] = held[n][upto:]
        flags = repeated_windows(np.array(now["k"], dtype=np.int64), now["left"], now["right"])
        flags[np.array(now["n"]) > 1] = False  # all windows of those repeat, which is known
        found = _spans(flags)
        return pa.RecordBatch.from_pydict(
            {
                "t1": [now["t1"][r] for r, _, _ in found], "t2": [now["t2"][r] for r, _, _ in found],
                "lo": [now["pos"][r] - last for r, _, last in found], "hi": [now["pos"][r] - begin + LENGTH for r, begin, _ in found],
            },
            schema=pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]),
        )

    for batch in batches:
        for n in names:
            held[n].extend(batch.column(batch.schema.get_field_index(n)).to_pylist())
        keys = held["k"]
        if len(keys) >= 8000 and keys[0] != keys[-1]:
            upto = len(keys) - 1
            while keys[upto - 1] == keys[-1]:
                upto -= 1
            yield done(upto)
    if held["k"]:
        yield done(len(held["k"]))


def _dealt_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of very large keys -> one row per window: its place against the suffix and a 128-bit hash of its bytes."""
    names = ("t1", "t2", "pos", "k", "n", "left", "right")
    for batch in batches:
        for t1, t2, pos, k, n, left, right in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names), strict=True):
            raw = left[::-1] + right
            starts = range(max(0, len(raw) - LENGTH + 1))
            if starts:
                yield pa.RecordBatch.from_pydict(
                    {
                        "k": [k] * len(starts), "i": [len(left) - s for s in starts],
                        "g": [xxhash.xxh3_128_digest(raw[s : s + LENGTH]) for s in starts], "t1": [t1] * len(starts), "t2": [t2] * len(starts),
                        "at": [pos - len(left) + s for s in starts], "n": [n] * len(starts),
                    },
                    schema=pa.schema([("k", pa.int64()), ("i", pa.int32()), ("g", pa.binary()), ("t1", pa.int64()), ("t2", pa.int64()), ("at", pa.int32()), ("n", pa.int64())]),
                )


def _merged(spans: list[dict], n: int) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((max(0, s["lo"]), min(n, s["hi"])) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, raw, spans) -> what stays of each text."""
    for batch in batches:
        cols = {n: [] for n in ("t1", "t2", "n_removed", "n_spans", "kept_sha256", "kept")}
        for t1, t2, raw, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            runs = _merged(spans, len(raw))
            edges = [0, *(x for run in runs for x in run), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            for name, x in zip(cols, (t1, t2, len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                cols[name].append(x)
        yield pa.RecordBatch.from_pydict(
            cols, schema=pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        )


def text_keys(text: str) -> list:
    """Two independent 64-bit hashes that stand for a whole text; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(1), whole).alias("t2")]


@contextmanager
def different_texts(docs: DataFrame, text_col: str = "text") -> Iterator[DataFrame]:
    """``(t1, t2, raw, copies)`` of the texts long enough to matter, written in buckets of the text's key.

    The buckets serve two later joins, which then move no text. The catalog knows
    the table within the block only.
    """
    spark = docs.sparkSession
    whole = docs.select(*text_keys(text_col), F.col(text_col).cast("binary").alias("raw")).filter(F.octet_length("raw") >= LENGTH)
    one = whole.groupBy("t1", "t2").agg(F.first("raw").alias("raw"), F.count("*").alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    try:
        (
            one.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}")
            .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "t1", "t2").saveAsTable(name)
        )
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeated_spans(texts: DataFrame, most: int = MOST) -> DataFrame:
    """``(t1, t2, lo, hi)``: byte ranges of the given texts that repeated windows cover; they may overlap."""
    anchors = written(texts.select("t1", "t2", "raw").mapInArrow(_anchors, "t1 long, t2 long, pos int, k long, c long"), "anchors")
    keys = (
        anchors.groupBy("k").agg(F.count("*").alias("total"), F.min("c").alias("c1"), F.max("c").alias("c2"))
        .filter("total > 1").select("k", (F.col("c1") == F.col("c2")).alias("alike"))
    )
    keys = written(keys, "keys")  # a plain side: a hot key's rows on the other side can then be split
    shared = written(anchors.join(keys, "k"), "shared")
    mixed = shared.filter("not alike")
    alike = mixed.groupBy("k", "c").agg(
        F.count("*").alias("n"), F.first("t1").alias("t1"), F.first("t2").alias("t2"), F.first("pos").alias("pos")
    )
    alike = written(alike, "alike")
    sizes = alike.groupBy("k").agg(F.count("*").alias("m"))
    picks = alike.join(sizes, "k").groupBy("t1", "t2").agg(F.collect_list(F.struct("pos", "k", "n", "m")).alias("picks"))
    rows = texts.select("t1", "t2", "raw").join(picks, ["t1", "t2"]).select("t1", "t2", "raw", "picks").mapInArrow(
        _surroundings, "t1 long, t2 long, pos int, k long, n long, m long, left binary, right binary"
    )
    rows = written(rows, "surroundings")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = (
        rows.filter(F.col("m") <= most).repartition(width, "k").sortWithinPartitions("k")
        .mapInArrow(_sorted_keys, "t1 long, t2 long, lo int, hi int")
    )
    dealt = rows.filter(F.col("m") > most).mapInArrow(_dealt_windows, "k long, i int, g binary, t1 long, t2 long, at int, n long")
    grams = dealt.groupBy("k", "i", "g").agg(F.count("*").alias("times"), F.max("n").alias("n")).filter("times > 1 or n > 1")
    large = dealt.join(grams.select("k", "i", "g"), ["k", "i", "g"]).filter("n = 1").select("t1", "t2", F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi"))
    around = lambda df: df.select(
        "t1", "t2", (F.col("pos") - (CHOICES - 1)).alias("lo"), (F.col("pos") + LENGTH).alias("hi")
    )
    known = mixed.join(alike.filter("n > 1").select("k", "c"), ["k", "c"], "left_semi")
    return around(shared.filter("alike")).union(around(known)).union(edges).union(large)


def cut_texts(texts: DataFrame, most: int = MOST) -> DataFrame:
    """``(t1, t2, n_removed, n_spans, kept_sha256, kept)`` of the different texts that lose bytes; see ``different_texts``.

    A text that occurs twice or more loses all of it, as every 200-byte string in
    it also starts in its copy; it still takes part against other texts.
    """
    spans = repeated_spans(texts, most).groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    cut = (
        texts.filter("copies = 1").select("t1", "t2", "raw").join(spans, ["t1", "t2"]).select("t1", "t2", "raw", "spans")
        .mapInArrow(_cut, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )
    copies = texts.filter("copies > 1").select(
        "t1", "t2", F.octet_length("raw").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"),
    )
    return cut.union(copies)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs``.

    Null texts count as empty; texts under 200 bytes lose nothing unless they are
    covered from a longer one, which cannot be. Repeated rows are copies of each
    other and lose everything. Null ids stay null.
    """
    with different_texts(docs, text_col) as texts:
        cut = written(cut_texts(texts, most).drop("kept"), "cut")
    whole = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"), *text_keys(text_col), F.octet_length(whole).cast("long").alias("n_bytes"),
        F.sha2(whole, 256).alias("sha"),
    )
    return rows.join(cut, ["t1", "t2"], "left").select(
        "id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated substrings cut out of the text, other columns as they are.

    Characters of which a cut takes some bytes go entirely. ``length_col``, where
    the table has it, becomes the new length of texts that were cut.
    """
    @F.pandas_udf("string")
    def text_of(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    with different_texts(docs, text_col) as texts:
        cut = cut_texts(texts).select(F.col("t1").alias("cut_1"), F.col("t2").alias("cut_2"), text_of("kept").alias("cut_text"))
        cut = written(cut, "cut-texts")
    k1, k2 = text_keys(text_col)
    joined = docs.join(cut, (k1 == cut["cut_1"]) & (k2 == cut["cut_2"]), "left")
    columns = []
    for name in docs.columns:
        own = docs[quoted(name)]
        if name == text_col:
            own = F.coalesce(cut["cut_text"], own)
        elif name == length_col:
            own = F.coalesce(F.length(cut["cut_text"]).cast(docs.schema[name].dataType), own)
        columns.append(own.alias(name))
    return joined.select(*columns)
