"""Vector bin packing of examples into sequences under three limits at once.

Every piece has three sizes: tokens, one segment, and loss-bearing tokens. A text
begins with tokens that bear no loss (the prompt of an instruction, or a leading
share of a plain document, as for a prefix language model) and goes on with
tokens that do. Texts may be cut, so what a waiting piece can give to an open
sequence is as much of its beginning as the limits leave room for. The next piece
is the one for which that has the largest dot product with what the sequence has
left, both in units of the limits: what a sequence has most of is used first, and
room that loss-bearing tokens may not take goes to prompts.

Packing goes on within a partition, over a pool of ``POOL`` pieces or
``POOL_TOKENS`` tokens, so memory is bounded, nothing is shuffled, and only the
last sequences of a partition are short. Sequence ids are the partition number
and a running number within it.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a sequence.
TOKENS = 1024
#: Pieces of a sequence.
SEGMENTS = 16
#: Loss-bearing tokens of a sequence of instructions or led documents.
LOSS = 960
#: Percentage of a plain document's tokens that leads it without loss.
LEAD = 25
#: Pieces that are packed together, and the tokens they may hold.
POOL = 8192
POOL_TOKENS = 1 << 23
#: Words whose ids a worker remembers.
WORDS = 600_000
#: Characters of texts whose new words are encoded together.
TOGETHER = 1 << 22
#: Closes every text.
END = 0

_RUN = re.compile(r"\s\s")
_GAP = re.compile(r"(?<=\S) (?=\S)")


# Fixed value: how this byte-level vocabulary cuts a text into words before merging bytes.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary as bytes -> id: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}


class Encoder:
    """Ids of whole texts by the byte-level tokenizer file at ``path``.

    The pre-tokenizer of this vocabulary starts a new word at every single space
    between two characters that are no white space, and a line feed between two such
    is a word of its own. So texts are encoded word by word with a memory of words, in
    which those of later lines begin with the line feed. Arrow cuts the texts and
    numbers their different words; only these are looked up, and those that come twice
    in a batch are remembered. New words are encoded together and told apart by their
    first tokens, as no other token begins with a space or is a line feed. They go to the faster of two encoders of the vocabulary,
    which gives the ids of the file's own tokenizer; that one encodes what begins a
    text, words with white space in them, and whole texts that hold a special token's
    string.
    """

    def __init__(self, path: str, most: int = WORDS):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole, self.most = Tokenizer.from_file(path), most
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special)) if special else r"(?!)")
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        ranks = byte_ranks({t: i for t, i in vocabulary.items() if t not in special})
        self.together = tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.leads[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.feed = ranks.get(b"\n", -1)
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of words, where each word's begin among them, and the words in that order."""
        lines, plain, spaced = [], [], []
        for w in words:
            (lines if w[0] == "\n" else spaced if " " in w else plain).append(w)
        made = []
        for few, between, before in ((lines, "", ""), (plain, " ", " ")):
            if few:
                ids = self.together.encode_to_numpy(before + between.join(few)).astype(self.dtype)
                first = np.flatnonzero(self.leads[ids] if before else ids == self.feed)
                made.append((ids, first) if len(first) == len(few) else self._each(few, before))
        if spaced:
            made.append(self._each(spaced, " "))
        begins, n = [], 0
        for ids, first in made:
            begins.append(first + n)
            n += len(ids)
        return np.concatenate([ids for ids, _ in made]), np.concatenate(begins), lines + plain + spaced

    def _each(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are encoded one by one."""
        ids = [self._ids(before + w) for w in words]
        return np.concatenate(ids), np.cumsum([0, *map(len, ids[:-1])])

    def _split(self, texts: list[str]) -> tuple[list[str], pa.Array, np.ndarray]:
        """What begins each text, the words after that of all texts, and how many each has."""
        heads, rests, others = [], [], {}
        for i, text in enumerate(texts):
            rest = None
            if not text or self.special.search(text):
                head = text
            elif text[0] != " " and text[-1] != " " and not _RUN.search(text):
                head, more, rest = text.replace("\n", " \n").partition(" ")
                rest = rest if more else None
            else:
                head, *others[i] = _GAP.split(text)
            heads.append(head)
            rests.append(rest)
        cut = pc.split_pattern(pa.array(rests, pa.string()), " ")
        if others:
            plain = cut.to_pylist()
            cut = pa.array([others.get(i, x) for i, x in enumerate(plain)], pa.list_(pa.string()))
        return heads, cut.flatten(), pc.fill_null(pc.list_value_length(cut), 0).to_numpy()

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            since, size = at, 0
            while at < len(texts) and size < TOGETHER:
                size += len(texts[at])
                at += 1
            heads, words, counts = self._split(texts[since:at])
            numbered = words.dictionary_encode()
            which, different = numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
            parts = list(map(self.known.get, different))
            lacking = [i for i, p in enumerate(parts) if p is None]
            had = np.ones(len(parts), dtype=bool)
            had[lacking] = False
            parts = list(filter(None, parts))
            flat = np.frombuffer(b"".join(parts), dtype=self.dtype)
            lengths, begins = np.zeros(len(had), dtype=np.int64), np.zeros(len(had), dtype=np.int64)
            lengths[had] = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // flat.itemsize
            begins[had] = np.cumsum(lengths[had]) - lengths[had]
            if lacking:
                place = dict(zip(map(different.__getitem__, lacking), lacking, strict=True))
                new, first, ordered = self._new(list(place))
                at_word = np.fromiter(map(place.__getitem__, ordered), dtype=np.int64, count=len(ordered))
                begins[at_word] = first + len(flat)
                lengths[at_word] = np.diff(first, append=len(new))
                flat = np.concatenate([flat, new])
                again = np.flatnonzero(~had & (np.bincount(which, minlength=len(had)) > 1))
                if len(self.known) + len(again) > self.most:
                    self.known.clear()
                for i, lo, n in zip(again.tolist(), begins[again].tolist(), lengths[again].tolist(), strict=True):
                    self.known[different[i]] = flat[lo : lo + n].tobytes()
            taken = lengths[which]
            ends = np.cumsum(taken)
            ids = flat[np.repeat(begins[which] - ends + taken, taken) + np.arange(int(taken.sum()))]
            edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
            for head, lo, hi in zip(heads, edges, edges[1:]):
                yield np.concatenate([self._ids(head), ids[lo:hi]]) if head else ids[lo:hi]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder, which goes on remembering words from task to task."""
    return Encoder(path)


class Piece:
    """A run of ids of one text: the first ``lead`` of them bear no loss."""

    __slots__ = ("key", "start", "ids", "lead", "total")

    def __init__(self, key: int, start: int, ids: np.ndarray, lead: int, total: int):
        self.key, self.start, self.ids, self.lead, self.total = key, start, ids, lead, total

    @property
    def loss(self) -> int:
        return len(self.ids) - self.lead

    def cut(self, n: int) -> tuple[Piece, Piece | None]:
        """The first ``n`` ids and the rest, if any."""
        if n == len(self.ids):
            return self, None
        lead = min(n, self.lead)
        return (
            Piece(self.key, self.start, self.ids[:n], lead, self.total),
            Piece(self.key, self.start + n, self.ids[n:], self.lead - lead, self.total),
        )


class Pool:
    """Waiting pieces by shape (ids, leading ids), one array entry for each shape."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = limits
        self.place: dict[tuple[int, int], int] = {}
        self.queues: list[deque[Piece]] = []
        self.free: list[int] = []
        self.sizes = np.zeros((2, 64))
        self.count = self.tokens = 0

    def add(self, piece: Piece) -> None:
        shape = (len(piece.ids), piece.lead)
        at = self.place.get(shape)
        if at is None:
            if self.free:
                at = self.free.pop()
            else:
                at = len(self.queues)
                self.queues.append(deque())
                if at == self.sizes.shape[1]:
                    self.sizes = np.hstack([self.sizes, np.zeros_like(self.sizes)])
            self.place[shape] = at
            self.sizes[:, at] = shape
        self.queues[at].append(piece)
        self.count += 1
        self.tokens += len(piece.ids)

    def _take(self, at: int) -> Piece:
        piece = self.queues[at].popleft()
        if not self.queues[at]:
            del self.place[(len(piece.ids), piece.lead)]
            self.sizes[:, at] = 0
            self.free.append(at)
        self.count -= 1
        self.tokens -= len(piece.ids)
        return piece

    def fill(self) -> list[Piece]:
        """One sequence: pieces in order, at least one, as one waits and no limit is below 1. Every piece is one segment."""
        limit_t, limit_s, limit_l = self.limits
        left_t, left_s, left_l = self.limits
        out: list[Piece] = []
        while self.count and left_t and left_s:
            size, lead = self.sizes[:, : len(self.queues)]
            give = np.minimum(lead + left_l, size)
            np.minimum(give, left_t, out=give)
            dot = give - lead
            np.maximum(dot, 0, out=dot)
            dot *= left_l / limit_l**2
            dot += give * (left_t / limit_t**2)  # a segment counts alike for every piece
            at = int(dot.argmax())
            if not give[at]:
                break
            piece, rest = self._take(at).cut(int(give[at]))
            if rest:
                self.add(rest)
            out.append(piece)
            left_t, left_s, left_l = left_t - len(piece.ids), left_s - 1, left_l - piece.loss
        return out


SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def _packer(path: str, limits: tuple[int, int, int], pool: int, lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, waiting = encoder(path), Pool(limits)
        context = TaskContext.get()
        base, number = (context.partitionId() if context else 0) << 32, 0
        rows: list[tuple] = []

        def put(pieces: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for p in pieces:
                n = len(p.ids)
                rows.append((p.key, p.start, n, zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, base + number, offset, p.loss))
                offset += n
            number += 1

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)
            rows.clear()
            return batch

        for batch in batches:
            keys, texts, prompts = (batch.column(i).to_pylist() for i in range(3))
            leads = [None if x is None else len(ids) for x, ids in zip(prompts, encode([x or "" for x in prompts]), strict=True)] if any(prompts) else prompts
            for key, ids, told in zip(keys, encode([x or "" for x in texts]), leads, strict=True):
                ids = np.append(ids, np.array([END], dtype=ids.dtype))
                free = len(ids) * lead // 100 if told is None else min(told, len(ids) - 1)
                waiting.add(Piece(key, 0, ids, free, len(ids)))
                while waiting.count >= pool or waiting.tokens >= POOL_TOKENS:
                    put(waiting.fill())
                    if len(rows) >= 20_000:
                        yield out()
        while waiting.count:
            put(waiting.fill())
            if len(rows) >= 20_000:
                yield out()
        if rows:
            yield out()

    return run


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", prompt: Column | None = None,
    lead: int = LEAD, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL,
) -> DataFrame:
    """Pieces of all texts and their places: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens)``.

    ``prompt`` names the leading part of each text that bears no loss; its tokens
    are counted on the prompt alone, and the closing id always bears loss. Without
    it, or where it is null, the first ``lead`` per cent of a text's ids bear none.
    No sequence exceeds any of the three limits. Null and empty texts are the
    closing id alone; texts of any length are cut as they are packed. Repeated rows
    and rows with null or equal ids are packed each for itself; an empty table has
    no pieces. Other columns are ignored, whatever their names.
    """
    if min(tokens, segments, loss, pool) < 1 or not 0 <= lead < 100:
        raise ValueError("every limit must be positive, and lead a percentage below 100")
    rows = docs.select(
        F.col(id_col).cast("long"), F.col(text_col).cast("string"), (F.lit(None).cast("string") if prompt is None else prompt)
    ).toDF("id", "text", "prompt")
    return rows.mapInArrow(_packer(path, (tokens, segments, loss), pool, lead), SCHEMA)
