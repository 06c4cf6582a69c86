import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from tallyloom.llm import alignment
from tallyloom.llm.queries import tokenizer_path

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
PARTS = ["'s", "<|endoftext|>", "<s>", " ", "  ", "\n", "\t", "é", "ß", "한국어", "12", "!!", "日本語", "😀", " ", "\x00", "▁", "<0x41>", "\n\n", "the", "Ünter"]


def texts(seed, n, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) if rng.random() < 0.4 else rng.choice("abcdefgh   ,.") for _ in range(rng.randint(0, parts))) for _ in range(n)]


@pytest.fixture(scope="module")
def both():
    return alignment.PairEncoder(A, B)


def whole(both, text):
    """Ids of the whole text by the two libraries."""
    if not text:
        return [], []
    a, b, want = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text), (" " + text).encode()
    same = b"".join(both.bytes_a[i] for i in a) == want == b"".join(both.bytes_b[i] for i in b)
    return (a, b) if same else ([], [])


def plain(both, rows):
    """Every document's row by the definition."""
    aligned, counts = [], Counter()
    for i, text in rows:
        a, b = whole(both, text or "")
        ends_b, at, groups, links, p = {}, 0, [], [], 0
        for j, t in enumerate(b):
            at += len(both.bytes_b[t])
            ends_b[at] = j
        at = done_a = done_b = 0
        for p, t in enumerate(a):
            at += len(both.bytes_a[t])
            if at in ends_b:
                j = ends_b[at]
                groups.append(f"{','.join(map(str, a[done_a:p + 1]))}|{','.join(map(str, b[done_b:j + 1]))}")
                links.append((t, b[j]))
                done_a, done_b = p + 1, j + 1
        counts.update(links)
        aligned.append((i, len(a), len(b), len(groups), links, sha256(";".join(groups).encode()).hexdigest() if a else ""))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return sorted(
        ((i, na, nb, g, len(ls), sum(counts[x] == highest[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for i, na, nb, g, ls, sha in aligned),
        key=repr), counts, highest


def test_words_are_encoded_as_in_whole_texts(both):
    given = texts(1, 3000, 14)
    fresh = alignment.PairEncoder(A, B, most=200)
    for text, (a, b) in zip(given, fresh(given)):
        assert (a.tolist(), b.tolist()) == tuple(whole(both, text)), text


@pytest.mark.parametrize("piece", [1, 2, 7, 64])
def test_diagonals_cut_a_merge_into_equal_pieces(piece):
    rng = np.random.default_rng(piece)
    for n in (0, 1, 5, 200):
        a, b = (np.unique(rng.integers(0, 3 * n + 1, m)) for m in (n, n // 2))
        cuts = alignment.diagonals(a, b, piece)
        assert cuts[0] == (0, 0) and cuts[-1] == (len(a), len(b))
        for (i, j), (k, m) in zip(cuts, cuts[1:]):
            assert k >= i and m >= j and (k - i) + (m - j) <= piece + 1
            assert not len(a[:k]) or not len(b[m:]) or a[k - 1] < b[m]
            assert not len(b[:m]) or not len(a[k:]) or b[m - 1] < a[k]


@pytest.mark.parametrize(("piece", "pairs"), [(6, 0), (40, 10**6), (alignment.PIECE, 10**6)])
def test_alignment_equals_plain_version(spark, both, piece, pairs):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts(2, 60, 80))] + [(3, None), (3, ""), (5, "one one"), (5, "one one")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, `a.b` int")
    documents, counted = alignment.align(docs, A, B, piece=piece, broadcast_pairs=pairs)
    want, counts, highest = plain(both, rows)
    assert sorted((tuple(r) for r in documents.collect()), key=repr) == want
    assert {(r.a_id, r.b_id): (r.links, r.best) for r in counted.collect()} == {k: (n, n == highest[k[1]]) for k, n in counts.items()}


def test_no_rows(spark):
    documents, counted = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert documents.collect() == [] and counted.collect() == []
