"""Tokens of two tokenizers over the same bytes, aligned where both end.

Every token is a range of bytes, so each tokenizer gives a rising list of ends, and
what aligns them is a merge of two sorted lists. The merge is cut by merge-path
partitioning: for every ``PIECE``-th step a binary search along the diagonal finds
how many ends of each list come before it, so a text of any length falls into pieces
of equal work that need nothing of each other. Pieces of long texts are dealt out to
all tasks; short texts are one piece, merged where they were encoded. A piece emits
what it can see alone: the pairs of tokens that end together, the groups between
their ends, and a head and a tail of groups that began or go on in another piece.
Heads and tails are stitched in the order of pieces.

Counts of linked pairs over the whole corpus are gathered from these rows, and every
document is measured by the counts of its pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import written
from tallyloom.llm.packing import WORD_PATTERN, byte_ranks

#: Steps of a merge, of both lists together, in a piece.
PIECE = 1 << 14
#: Words whose ids a worker remembers.
WORDS = 400_000
#: Characters of texts whose new words are encoded together.
TOGETHER = 1 << 20
#: Pairs whose counts are broadcast at most, 16 bytes each; more are joined by key, hot keys dealt to ``SALTS`` parts.
BROADCAST_PAIRS = 4_000_000
SALTS = 32

_RUN = re.compile(r"\s\s")
_GAP = re.compile(r"(?<=\S) (?=\S)")
_BLANK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def key_of(a: Column, b: Column) -> Column:
    """One number for a pair of ids."""
    return F.shiftleft(a.cast("long"), 32) + b


class PairEncoder:
    """Ids of both tokenizers for texts, word by word with a memory of words.

    The byte-level file starts a token at every single blank between characters
    that are no white space, and no piece of the other model holds a blank after
    another character (checked when it is loaded), so texts fall into words that
    both encode alone. Words that begin or end with white space or hold blanks are
    encoded one by one, the others together.
    """

    def __init__(self, path_a: str, path_b: str, most: int = WORDS):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.most = most
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        ranks = byte_ranks({t: i for t, i in vocabulary.items() if t not in special})
        self.words_a = tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            b"" if self.b.is_control(i) or self.b.is_unknown(i) else bytes([int(_BYTE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        if any(_BLANK in p.lstrip(_BLANK) for p in pieces):
            raise ValueError("a piece holds a blank within; words cannot be encoded alone")
        self.size_a, self.size_b = (np.array(list(map(len, t)), dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.leads_a = np.array([t.startswith(b" ") for t in self.bytes_a])
        self.leads_b = np.array([p.startswith(_BLANK) for p in pieces])
        self.comma_a, self.close_a = ([f"{i}{end}" for i in range(len(self.bytes_a))] for end in ",|")
        self.comma_b, self.close_b = ([f"{i}{end}" for i in range(len(self.bytes_b))] for end in ",;")
        self.comma_a, self.close_a, self.comma_b, self.close_b = (np.array(n, dtype=object) for n in (self.comma_a, self.close_a, self.comma_b, self.close_b))
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.unlike: set[str] = set()

    def _one(self, word: str) -> None:
        a, b, want = self.a.encode(" " + word, add_special_tokens=False).ids, self.b.encode(word), (" " + word).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            self.unlike.add(word)
        self.known_a[word], self.known_b[word] = np.array(a, dtype=np.int32).tobytes(), np.array(b, dtype=np.int32).tobytes()

    @staticmethod
    def _cut(ids: np.ndarray, leads: np.ndarray, table: list[bytes], words: list[str], want: bytes) -> list[bytes] | None:
        """The ids of each word out of those of all, or nothing if they do not fall apart at the words."""
        first = np.flatnonzero(leads[ids])
        if len(first) != len(words) or b"".join(map(table.__getitem__, ids.tolist())) != want:
            return None
        raw, edges = ids.astype(np.int32).tobytes(), [*(first * 4).tolist(), len(ids) * 4]
        return list(map(raw.__getitem__, map(slice, edges, edges[1:])))

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if " " not in w and w == w.strip()]
        joined = " ".join(plain)
        want = (" " + joined).encode()
        a = plain and self._cut(self.words_a.encode_to_numpy(" " + joined), self.leads_a, self.bytes_a, plain, want)
        b = a and self._cut(np.array(self.b.encode(joined), dtype=np.int32), self.leads_b, self.bytes_b, plain, want)
        if b:
            self.known_a.update(zip(plain, a))
            self.known_b.update(zip(plain, b))
        elif len(plain) > 64:  # the words that do not fit are few: look for them in smaller parts
            for part in (plain[i:i + len(plain) // 8 + 1] for i in range(0, len(plain), len(plain) // 8 + 1)):
                self._learn(part)
        else:
            for w in plain:
                self._one(w)
        for w in new:
            if w not in self.known_a:
                self._one(w)

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for every text; none where the joined bytes of one are not a blank and the text."""
        none = np.zeros(0, dtype=np.int32)
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and size < TOGETHER:
                text = texts[at]
                clean = text and not text[0].isspace() and not text[-1].isspace() and not _RUN.search(text)
                split.append(text.split(" ") if clean else _GAP.split(text) if text else [])
                size += len(text)
                at += 1
            new = {w for words in split for w in words}.difference(self.known_a)
            if len(self.known_a) + len(new) > self.most:
                for memory in (self.known_a, self.known_b, self.unlike):
                    memory.clear()
                new = {w for words in split for w in words}
            if new:
                self._learn(list(new))
            for words in split:
                if not words or (self.unlike and not self.unlike.isdisjoint(words)):
                    yield none, none
                else:
                    yield tuple(np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.int32) for known in (self.known_a, self.known_b))


@lru_cache(maxsize=1)
def encoder(path_a: str, path_b: str) -> PairEncoder:
    """The worker's encoder, which goes on remembering words from task to task."""
    return PairEncoder(path_a, path_b)


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> list[tuple[int, int]]:
    """Where pieces of ``piece`` merge steps begin in two rising lists, and where the last one ends.

    On diagonal d, a binary search finds the least number of ends of ``a`` that
    come before step d (ends of ``a`` first where both are equal). Equal ends are
    never parted, so pieces may be one step longer.
    """
    cuts, steps = [(0, 0)], len(a) + len(b)
    for d in range(piece, steps, piece):
        low, high = max(0, d - len(b)), min(d, len(a))
        while low < high:
            i = (low + high) // 2
            if a[i] <= b[d - i - 1]:
                low = i + 1
            else:
                high = i
        i, j = low, d - low
        if i and j < len(b) and a[i - 1] == b[j]:
            j += 1
        if cuts[-1] != (i, j):
            cuts.append((i, j))
    return [*cuts, (len(a), len(b))] if cuts[-1] != (len(a), len(b)) or steps == 0 else cuts


def merge_piece(names: PairEncoder, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple:
    """``(links_a, links_b, head_a, head_b, body, tail_a, tail_b)`` of one piece.

    Links are the places in the piece whose tokens end together; head and tail are
    ids of groups that other pieces may share, ``body`` the groups in between. The
    tail is all there is where nothing ends together.
    """
    place = np.searchsorted(ends_b, ends_a)
    both = place < len(b)
    both[both] = ends_b[place[both]] == ends_a[both]
    link_a = np.flatnonzero(both)
    link_b = place[link_a]
    texts = lambda names, ids: "".join(names[ids].tolist())[:-1]
    if not len(link_a):
        return link_a, link_b, "", "", "", texts(names.comma_a, a), texts(names.comma_b, b)
    fa, fb, la, lb = link_a[0] + 1, link_b[0] + 1, link_a[-1] + 1, link_b[-1] + 1
    inner_a, inner_b = a[fa:la], b[fb:lb]
    out = np.empty(len(inner_a) + len(inner_b), dtype=object)
    close_a, close_b = link_a[1:] - fa, link_b[1:] - fb  # last places of the groups after the first
    group_a = np.repeat(np.arange(len(close_a)), np.diff(close_a, prepend=-1))
    group_b = np.repeat(np.arange(len(close_b)), np.diff(close_b, prepend=-1))
    at_a = np.arange(len(inner_a)) + np.append(-1, close_b)[group_a] + 1 if len(close_a) else np.zeros(0, dtype=np.int64)
    at_b = np.arange(len(inner_b)) + close_a[group_b] + 1 if len(close_a) else np.zeros(0, dtype=np.int64)
    out[at_a], out[at_b] = names.comma_a[inner_a], names.comma_b[inner_b]
    out[at_a[close_a]], out[at_b[close_b]] = names.close_a[inner_a[close_a]], names.close_b[inner_b[close_b]]
    return link_a, link_b, texts(names.comma_a, a[:fa]), texts(names.comma_b, b[:fb]), "".join(out.tolist())[:-1], texts(names.comma_a, a[la:]), texts(names.comma_b, b[lb:])


_TIMES = [pa.field("keys", pa.list_(pa.int64())), pa.field("times", pa.list_(pa.int32()))]
_ENCODED = pa.schema([
    *(pa.field(n, pa.int64()) for n in ("row", "piece", "pieces", "n_a", "n_b", "n_groups")), pa.field("sha", pa.string()), *_TIMES,
    *(pa.field(n, pa.binary()) for n in ("a", "b")), *(pa.field(n, pa.int64()) for n in ("before_a", "before_b")),
])
_MERGED = pa.schema([
    *(pa.field(n, pa.int64()) for n in ("row", "piece", "n_a", "n_b", "n_groups")), *_TIMES,
    *(pa.field(n, pa.string()) for n in ("head_a", "head_b", "body", "tail_a", "tail_b")),
])


def _counted(link_a: np.ndarray, link_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, times = np.unique((a[link_a].astype(np.int64) << 32) + b[link_b], return_counts=True)
    return keys, times.astype(np.int32)


def _encode(path_a: str, path_b: str, piece: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoder(path_a, path_b)
        for batch in batches:
            out = []
            for row, (a, b) in zip(batch.column("row").to_pylist(), both(batch.column("text").to_pylist())):
                ends_a, ends_b = both.size_a[a].cumsum(), both.size_b[b].cumsum()
                cuts = diagonals(ends_a, ends_b, piece)
                if len(cuts) <= 2:
                    link_a, link_b, head_a, head_b, body, _, _ = merge_piece(both, a, b, ends_a, ends_b)
                    text = f"{head_a}|{head_b}" + (";" + body if body else "")
                    sha = hashlib.sha256(text.encode()).hexdigest() if len(a) else ""
                    out.append((row, 0, 1, len(a), len(b), len(link_a), sha, *_counted(link_a, link_b, a, b), None, None, 0, 0))
                else:
                    for no, ((i, j), (k, m)) in enumerate(zip(cuts, cuts[1:])):
                        before = (int(ends_a[i - 1]) if i else 0, int(ends_b[j - 1]) if j else 0)
                        out.append((row, no, len(cuts) - 1, k - i, m - j, None, None, None, None, a[i:k].tobytes(), b[j:m].tobytes(), *before))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _ENCODED)], schema=_ENCODED)

    return rows


def _merge(path_a: str, path_b: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoder(path_a, path_b)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = (np.frombuffer(r[c], dtype=np.int32) for c in "ab")
                link_a, link_b, *texts = merge_piece(both, a, b, both.size_a[a].cumsum() + r["before_a"], both.size_b[b].cumsum() + r["before_b"])
                out.append((r["row"], r["piece"], len(a), len(b), len(link_a), *_counted(link_a, link_b, a, b), *texts))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _MERGED)], schema=_MERGED)

    return rows


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document out of its pieces in order; only a digest and open groups are held."""
    row, sha, first, sizes, open_a, open_b = None, None, True, [0, 0, 0], [], []
    done: list[tuple] = []
    fields = ("row", "n_a", "n_b", "n_groups", "sha")

    def finished() -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if f == "sha" else pa.int64()) for v, f in zip(zip(*done), fields)], names=list(fields))
            done.clear()

    for batch in batches:
        for r in batch.to_pylist():
            if r["row"] != row:
                if row is not None:
                    done.append((row, *sizes, sha.hexdigest()))
                row, sha, first, sizes, open_a, open_b = r["row"], hashlib.sha256(), True, [0, 0, 0], [], []
            sizes = [n + r[c] for n, c in zip(sizes, ("n_a", "n_b", "n_groups"))]
            if r["n_groups"]:
                a, b = (",".join(x for x in (*kept, r[c]) if x) for kept, c in ((open_a, "head_a"), (open_b, "head_b")))
                sha.update((f"{'' if first else ';'}{a}|{b}" + (";" + r["body"] if r["body"] else "")).encode())
                first, open_a, open_b = False, [], []
            open_a.append(r["tail_a"])
            open_b.append(r["tail_b"])
        yield from finished()
    if row is not None:
        done.append((row, *sizes, sha.hexdigest()))
    yield from finished()


def _types(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE,
          broadcast_pairs: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """``(documents, pairs)``: alignments of every row, and the corpus-wide counts of linked pairs.

    ``documents``: ``(id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256)``. No token is empty, so each group is closed by exactly one
    link. A link is best if its pair's count is the highest of all pairs with its B
    id; ties all are. ``pairs``: ``(a_id, b_id, links, best)``. Null and empty texts,
    and those whose joined tokens are not a blank and the text, have no tokens;
    repeated rows and rows with null or equal ids are aligned and counted each for
    itself, other columns left out whatever their names. A text is encoded whole in one task.
    """
    spark = docs.sparkSession
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    given = given.withColumn("id", F.struct("id"))  # ids pass through the tasks as they are, whatever their type
    encoded = written(_with_id(given, _encode(path_a, path_b, piece)), "encoded")
    long = encoded.filter("pieces > 1").select("id", *(f.name for f in _ENCODED))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = written(long.drop("id").repartition(tasks, "row", "piece").mapInArrow(_merge(path_a, path_b), _types(_MERGED)), "merged")
    stitched = merged.drop("keys", "times").repartition(tasks, "row").sortWithinPartitions("row", "piece") \
        .mapInArrow(_stitch, "row long, n_a long, n_b long, n_groups long, sha string")
    stitched = encoded.filter("pieces > 1 and piece = 0").select("id", "row").join(stitched, "row").select("row", "id", "n_a", "n_b", "n_groups", "sha")
    whole = encoded.filter("pieces = 1").select("row", "id", "n_a", "n_b", "n_groups", "sha").union(stitched)
    lists = encoded.filter("pieces = 1").select("row", "keys", "times").union(merged.select("row", "keys", "times"))
    links = lists.select("row", F.inline(F.arrays_zip("keys", "times"))).withColumnRenamed("keys", "key")
    counts = links.groupBy("key").agg(F.sum("times").alias("links"))
    b_id = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    counts = written(counts.withColumn("b_id", b_id), "pair-counts")
    highest = counts.groupBy("b_id").agg(F.max("links").alias("highest"))
    counts = written(counts.join(highest, "b_id").select("key", "links", (F.col("links") == F.col("highest")).alias("best")), "pairs")
    if counts.count() <= broadcast_pairs:
        measured = links.join(F.broadcast(counts), "key")
    else:
        spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        measured = links.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(spread, ["key", "salt"])
    sums = measured.groupBy("row").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    documents = whole.join(sums, "row", "left").select("id.id", *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.col("sha").alias("groups_sha256"))
    pairs = counts.select(F.shiftright("key", 32).cast("int").alias("a_id"), b_id.cast("int").alias("b_id"), "links", "best")
    return documents, pairs


def _with_id(given: DataFrame, rows) -> DataFrame:
    """The rows that ``rows`` makes of ``given``, each with the id of the row it came from."""
    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = {r: i for i, r in enumerate(batch.column("row").to_pylist())}
            for out in rows(iter([batch])):
                take = pa.array([places[r] for r in out.column("row").to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), *out.columns], names=["id", *out.schema.names])

    return given.mapInArrow(carried, f"id {given.schema['id'].dataType.simpleString()}, {_types(_ENCODED)}")
