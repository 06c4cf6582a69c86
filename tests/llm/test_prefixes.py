import random

import pytest

from tallyloom.llm import prefixes
from tallyloom.llm.queries import tokenizer_path

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizer_path("word_bpe_49k.json") if public_tokenizers else ""
PARTS = ["'s", "'re", "'v", "re", "ll", "<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\t", "é", "é", "İ", "ΑΣ", "ß", "́", "한국어", "한",
         "12", "٣", "!!", "--", "'", "日本語", "😀", " ", "\u001c", "\u0085", "\x00", "The", "INTERNATIONAL", "▁", "Å"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def count():
    return prefixes.PrefixCounter(PATH)


def texts(seed, n, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) if rng.random() < 0.6 else rng.choice("abcdefghijklmnopqrstuvwxyzAB,.-0 ") for _ in range(rng.randint(0, parts))) for _ in range(n)]


def test_every_prefix_has_the_count_of_the_library(library, count):
    for text in texts(1, 1500, 10):
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert count(text).tolist() == want, text
        for limit in (0, 1, 3):
            assert count.within(text, limit) == (want[-1], max(k for k, n in enumerate(want) if n <= limit)), text


def test_words_without_blanks_may_be_very_long(library, count):
    for text in ("ab" * 40_000, "é日" * 9000, "12!?" * 9000):
        assert int(count(text)[-1]) == count.within(text, 10)[0] == len(library.encode(text, add_special_tokens=False).ids)


def test_memory_is_cleared_when_full(library, count, monkeypatch):
    monkeypatch.setattr(prefixes, "WORDS", 12)
    monkeypatch.setattr(prefixes, "PAIRS", 5)
    fresh = prefixes.PrefixCounter(PATH)
    for text in texts(2, 60, 30):
        assert fresh.within(text, 9) == count.within(text, 9)
        assert fresh(text).tolist() == count(text).tolist()


def test_token_counts_of_rows(spark, library):
    rows = [(1, "Hello world"), (None, "x y"), (2, None), (2, ""), (3, "a " * 3000), (3, "a " * 3000)]
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, n_tokens int, `a.b` int")
    got = prefixes.token_counts(docs, PATH).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    key = lambda r: tuple((x is None, x or 0) for x in r[:3])
    assert sorted(((r.id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert {(r.over_limit, r.chars_within) for r in got if r.id == 3} == {(True, 4096)}
    assert prefixes.token_counts(docs.limit(0), PATH).collect() == []


def test_stored_prefixes_answer_questions(spark, library, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 16)
    given = dict(enumerate(texts(3, 12, 30)))
    stored = prefixes.prefix_counts(spark.createDataFrame(list(given.items()), "doc_id long, text string"), PATH)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    asked = [(i, n, f"q{n}") for i, t in given.items() for n in {0, len(t) // 2, len(t), len(t) + 1}]
    got = prefixes.tokens_at(stored, spark.createDataFrame(asked, "id long, chars int, block string")).collect()
    assert {(r.id, r.chars, r.block): r.tokens for r in got} == {(i, n, q): size(given[i][:n]) if n <= len(given[i]) else None for i, n, q in asked}
    budgets = [(i, b) for i in given for b in (-1, 0, 5)]
    got = prefixes.longest_within(stored, spark.createDataFrame(budgets, "id long, budget int")).collect()
    want = {(i, b): max((k for k in range(len(t) + 1) if size(t[:k]) <= b), default=None) for i, t in given.items() for b in (-1, 0, 5)}
    assert {(r.id, r.budget): r.chars for r in got} == {k: v for k, v in want.items() if v is not None}
