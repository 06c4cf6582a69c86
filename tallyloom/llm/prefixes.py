"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

In byte-pair encoding with ordered merges a row of tokens is the encoding of its
letters exactly if every two neighbours in it are: the border between them is
never merged away. So a prefix has one last token, the one that ends there and
stands beside the last token of what it leaves, and its count is that of what it
leaves plus one. One pass over a word thus gives the counts of all its prefixes.
This vocabulary marks the end of a word, so two values are kept for each place:
the encoding if the word goes on, and if it ends there.

The pre-tokenizer drops white space and never looks behind, so the counts of a
text are running sums over its words. Words are remembered by the steps between
the counts of their prefixes; a text's counts are the running sum of its words'
steps, and nothing is encoded twice. From the stored counts questions about
truncation and budgets are answered by look-ups.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose steps, and pairs of tokens whose verdicts, a worker remembers.
WORDS = 800_000
PAIRS = 2_000_000
#: Longer pre-tokens are counted each time they come.
LONGEST = 1024
#: Prefixes in a row of the stored table.
BLOCK = 4096

# How this vocabulary cuts lower-cased ASCII text, and its contractions, which no shorter prefix holds.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
#: Where a run of characters can be cut so that both sides are counted apart.
_CUTS = re.compile(r"(?=[0-9])|(?<=[0-9])(?=[ -~])|(?<=[A-Za-z])(?=[!-&(-/:-@])|(?<=[!-&(-/:-@])(?=[A-Za-z])")


class Merges:
    """Counts of all prefixes of a word, given as the symbols that the merges start from."""

    def __init__(self, merges: list, end: str, symbols: set[str]):
        import ahocorasick

        self.rank, self.parts = {}, {}
        for i, m in enumerate(merges):
            left, right = m if not isinstance(m, str) else m.split(" ")
            self.rank[left, right] = i
            self.parts.setdefault(left + right, (left, right, i))
        tokens = symbols | {s + end for s in symbols} | self.parts.keys()
        self.tokens = sorted(tokens)
        number = {t: i for i, t in enumerate(self.tokens)}
        self.automaton = ahocorasick.Automaton()
        for word in {t.removesuffix(end) for t in tokens}:
            self.automaton.add_word(word, (len(word), number.get(word, -1), number.get(word + end, -1)))
        self.automaton.make_automaton()
        self.stood: dict[tuple[int, int], bool] = {}

    def _stands(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border of two tokens.

        Going back in time, the token made last is taken apart, until only the two
        symbols at the border are left. Two tokens that touch there would have
        merged if their merge came before the ones that used them up; of equal
        merges the leftmost comes first.
        """
        rank, parts = self.rank, self.parts
        left_end = right_end = len(rank)
        while True:
            r = rank.get((left, right))
            if r is not None and r < left_end and r <= right_end:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                left, left_end = a[1], a[2]
            else:
                right, right_end = b[0], b[2]

    def prefixes(self, word: str) -> list[int]:
        """Tokens of the first 1, 2, ... symbols of a word, each as a word of its own.

        The automaton finds the tokens at each place; every symbol is a token, so
        there is always one.
        """
        stood, tokens = self.stood, self.tokens
        last, count, out = [-1] * (len(word) + 1), [0] * (len(word) + 1), [0] * len(word)
        for stop, (size, going, ending) in self.automaton.iter(word):
            begin = stop + 1 - size
            before = last[begin]
            for token in (going, ending):
                if token < 0 or (out[stop] if token is ending else last[stop + 1] >= 0):
                    continue
                if begin:
                    stands = stood.get((before, token))
                    if stands is None:
                        if len(stood) >= PAIRS:
                            stood.clear()
                        stands = stood[before, token] = self._stands(tokens[before], tokens[token])
                    if not stands:
                        continue
                if token is ending:
                    out[stop] = count[begin] + 1
                else:
                    last[stop + 1], count[stop + 1] = token, count[begin] + 1
        return out

    def whole(self, word: str) -> int:
        """Tokens of a whole word: the last of ``prefixes`` without the other ends."""
        stood, tokens, final = self.stood, self.tokens, len(word) - 1
        last, count = [-1] * (final + 2), [0] * (final + 2)
        for stop, (size, going, ending) in self.automaton.iter(word):
            token = going if stop < final else ending
            if token < 0 or last[stop + 1] >= 0:
                continue
            begin = stop + 1 - size
            if begin:
                before = last[begin]
                stands = stood.get((before, token))
                if stands is None:
                    if len(stood) >= PAIRS:
                        stood.clear()
                    stands = stood[before, token] = self._stands(tokens[before], tokens[token])
                if not stands:
                    continue
            last[stop + 1], count[stop + 1] = token, count[begin] + 1
        return count[-1]


class PrefixCounter:
    """Steps between the counts of a text's prefixes, by the tokenizer file at ``path``."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.whole = Tokenizer.from_file(path)
        self.merges = Merges(model["merges"], model["end_of_word_suffix"], {t for t in model["vocab"] if len(t) == 1})
        special = sorted(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(map(re.escape, special)) if special else r"(?!)")
        self.plain: dict[str, str] = {}
        self.kinds: dict[str, str] = {}
        self.symbols: dict[str, str] = {}
        self.words: dict[str, int | list[int]] = {}
        self.known: dict[str, bytes] = {}
        self.totals: dict[str, int] = {}

    def _inner(self, token: str, symbols: str) -> list[int]:
        """Counts of the prefixes of one pre-token; a shorter part of a contraction is an apostrophe and letters."""
        if token not in _CONTRACTIONS:
            return self.merges.prefixes(symbols)
        apostrophe, letter = self.merges.whole("'"), self.merges.whole(token[1])
        return [apostrophe, *([apostrophe + letter] if len(token) == 3 else []), self.merges.whole(token)]

    def _whole(self, symbols: str) -> int:
        """The count of a whole pre-token."""
        n = self.words.get(symbols)
        if n is None:
            n = self.merges.whole(symbols)
            if len(symbols) <= LONGEST:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[symbols] = n
        return n

    def total(self, text: str) -> int:
        """The count of a whole word, that of its longest prefix."""
        if text.isascii() and text.isprintable() and not self.special.search(text):
            low = text.lower()
            return self._whole(low) if low.isalpha() else sum(map(self._whole, _ASCII.findall(low)))
        if text.isprintable() and not self.special.search(text):  # no white space but blanks, and words hold none
            whole = "".join(map(self._normal, text))
            if max(text) < "\u0300" or whole == self.whole.normalizer.normalize_str(text):
                return sum(self._whole("".join(map(self.symbols.__getitem__, whole[m.start():m.end()]))) for m in _ASCII.finditer(self._kinds(whole)))
        counts = self._counts(text)
        return counts[-1] if counts else 0

    def _ascii(self, text: str) -> list[int]:
        """Counts of the prefixes of printable ASCII text."""
        out, low = [], text.lower()
        base = 0
        for m in _ASCII.finditer(low):
            out.extend([base] * (m.start() - len(out)))
            token = m.group()
            inner = self._inner(token, token)
            out.extend([base + c for c in inner])
            base += inner[-1]
        out.extend([base] * (len(text) - len(out)))
        return out

    def _normal(self, c: str) -> str:
        if c not in self.plain:
            self.plain[c] = self.whole.normalizer.normalize_str(c)
        return self.plain[c]

    def _kinds(self, whole: str) -> str:
        """Normal text with an ASCII character of the same kind in each place, by the file's own rules."""
        for c in set(whole).difference(self.kinds):
            cut = self.whole.pre_tokenizer.pre_tokenize_str
            self.symbols[c] = cut(c)[0][0]
            self.kinds[c] = c if c.isascii() else "a" if len(cut("a" + c)) == 1 else "0" if len(cut(c + c)) == 2 else "!"
        return "".join(map(self.kinds.__getitem__, whole))

    def _run(self, run: str) -> list[int]:
        """Counts of the prefixes of text without white space and special tokens."""
        forms = [self._normal(c) for c in run]
        whole = "".join(forms)
        if max(run) >= "\u0300" and whole != self.whole.normalizer.normalize_str(run):  # characters that compose: what has no safe cut is encoded prefix by prefix
            out, base = [], 0
            for part in _CUTS.split(run):
                if part.isascii() and part.isprintable():
                    inner = self._ascii(part)
                else:
                    inner = [len(self.whole.encode(part[:k], add_special_tokens=False).ids) for k in range(1, len(part) + 1)]
                out.extend([base + c for c in inner])
                base += inner[-1] if inner else 0
            return out
        at = [0] * (len(whole) + 1)
        base = 0
        for m in _ASCII.finditer(self._kinds(whole)):
            token, byte = whole[m.start():m.end()], 0
            symbols = [self.symbols[c] for c in token]
            inner = self._inner(token, "".join(symbols))
            for place, s in enumerate(symbols, m.start() + 1):
                byte += len(s)
                at[place] = base + inner[byte - 1]
            base += inner[-1]
        out, place = [], 0
        for form in forms:
            place += len(form)
            out.append(at[place])
        return out

    def _plain(self, text: str) -> list[int]:
        """Counts of the prefixes of text without special tokens."""
        if text.isascii() and text.isprintable():
            return self._ascii(text)
        out, run = [], []
        base = 0

        def close() -> None:
            nonlocal base
            if run:
                joined = "".join(run)
                inner = self._ascii(joined) if joined.isascii() and joined.isprintable() else self._run(joined)
                out.extend([base + c for c in inner])
                base += inner[-1]
                run.clear()

        for c in text:
            if self._normal(c) == " ":
                close()
                out.append(base)
            else:
                run.append(c)
        close()
        return out

    def _counts(self, text: str) -> list[int]:
        """Counts of the prefixes; a special token's string is one token as soon as it is whole."""
        out, base, at = [], 0, 0
        for m in self.special.finditer(text):
            inner = self._plain(text[at:m.end() - 1])
            out.extend([base + c for c in inner])
            base = (out[m.start() - 1] if m.start() > at else base) + 1
            out.append(base)
            at = m.end()
        out.extend([base + c for c in self._plain(text[at:])])
        return out

    def _steps(self, word: str) -> bytes:
        counts = self._counts(word)
        return array("h", map(sub, counts, chain((0,), counts))).tobytes()

    @staticmethod
    def _remembered(known: dict, words: list[str], learn: Callable, most: int) -> Iterator:
        """What is known of words, after learning what is new; long words are forgotten at the next turn."""
        new = set(words).difference(known)
        if len(known) + len(new) > most:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = learn(w)
        return map(known.__getitem__, words)

    def __call__(self, text: str) -> np.ndarray:
        """Counts of the first 0, 1, 2, ... characters of a text."""
        steps = np.frombuffer(b"\0\0".join(self._remembered(self.known, text.split(" "), self._steps, WORDS // 4)), dtype=np.int16)
        counts = np.zeros(len(steps) + 1, dtype=np.int64)
        np.cumsum(steps, out=counts[1:])
        return counts

    def within(self, text: str, limit: int) -> tuple[int, int]:
        """The count of a whole text, and the characters of its longest prefix of at most ``limit`` tokens.

        Counts at word ends only rise, so the prefixes that matter are those of one word.
        """
        words = text.replace("\n", " ").split(" ")
        totals = list(self._remembered(self.totals, words, self.total, WORDS))
        n = sum(totals)
        if n <= limit:
            return n, len(text)
        at = base = 0
        for w, t in zip(words, totals):
            if base + t > limit:
                fits = [i for i, c in enumerate(self._counts(w), 1) if base + c <= limit]
                return n, at + (fits[-1] if fits else 0)
            at, base = at + len(w) + 1, base + t
        return n, len(text)


@lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    """The worker's counter, which goes on remembering words from task to task."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, block, start, counts)``: for every text the tokens of its first ``start``, ``start + 1``, ... characters.

    Texts of every length are cut into rows of ``BLOCK`` prefixes. ``row`` tells
    rows of equal ids apart. A null text is empty, and the empty text has one
    prefix with no tokens; other columns are left out, whatever their names.
    """
    given = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = given.schema["id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                counts = count(text.as_py())
                starts = list(range(0, len(counts), BLOCK))
                cut = np.append(starts, len(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column("id").slice(i, 1)] * len(starts)), pa.concat_arrays([batch.column("row").slice(i, 1)] * len(starts)),
                        pa.array(range(len(starts)), pa.int32()), pa.array(starts, pa.int64()),
                        pa.ListArray.from_arrays(cut, pa.array(counts.astype(np.int32))),
                    ],
                    names=["id", "row", "block", "start", "counts"],
                )

    return given.mapInArrow(rows, f"id {id_type}, row long, block int, start long, counts array<int>")


def tokens_at(prefixes: DataFrame, questions: DataFrame) -> DataFrame:
    """The tokens of the first ``chars`` characters, for questions ``(id, chars)``: a look-up in the stored table.

    All columns of the questions stay, and ``tokens`` and ``row`` join them. Null
    where the text is shorter; rows that share an id answer each for itself.
    """
    own = {"id", "chars"}
    asked = questions.select("id", "chars", F.struct(*[c for c in (f"`{c}`" for c in questions.columns if c not in own)] or [F.lit(1)]).alias("_rest")) \
        .withColumn("block", (F.col("chars") / BLOCK).cast("int"))
    found = asked.join(prefixes, ["id", "block"], "left")
    answer = F.get("counts", (F.col("chars") - F.col("start")).cast("int"))
    rest = [F.col("_rest")[c].alias(c) for c in questions.columns if c not in own]
    return found.select("id", "chars", "row", answer.alias("tokens"), *rest)


def longest_within(prefixes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(id, row, budget, chars, tokens)``: the most characters of a text that stay within a budget, and their tokens.

    For budgets ``(id, budget)``; the counts are not monotone within a word, so
    the last prefix within the budget is meant, and none for a negative one.
    """
    kept = F.filter(F.arrays_zip("counts", F.sequence(F.lit(0), F.size("counts") - 1).alias("i")), lambda s: s["counts"] <= F.col("budget"))
    within = prefixes.join(budgets.select("id", "budget").distinct(), "id").withColumn("last", F.try_element_at(kept, F.lit(-1))).filter("last is not null")
    best = F.max(F.struct((F.col("start") + F.col("last")["i"]).alias("chars"), F.col("last")["counts"].alias("tokens")))
    return within.groupBy("id", "row", "budget").agg(best.alias("b")).select("id", "row", "budget", "b.chars", "b.tokens")


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit, n_chars, chars_within)`` for every row.

    ``n_tokens`` is the count of the whole text, ``chars_within`` the most of its
    characters that stay within ``limit`` tokens. Null and empty texts have no
    tokens; repeated rows and rows with null or equal ids are counted each for
    itself; other columns are left out, whatever their names. A text is counted
    whole in one task, however long, with two bytes a character.
    """
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = given.schema["id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            sizes, tokens, chars, within = [], [], [], []
            for text in batch.column("text").to_pylist():
                n, fits = count.within(text, limit)
                sizes.append(len(text.encode()))
                tokens.append(n)
                chars.append(len(text))
                within.append(fits)
            over = [t > limit for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(v, pa.int64()) for v in (sizes, tokens)), pa.array(over, pa.bool_()), *(pa.array(v, pa.int64()) for v in (chars, within))],
                names=["id", "n_bytes", "n_tokens", "over_limit", "n_chars", "chars_within"],
            )

    return given.mapInArrow(rows, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean, n_chars long, chars_within long")
