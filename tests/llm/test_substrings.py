import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import Row

from tallyloom.llm import substrings, suffixsort


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(60) for _ in range(6)]
    texts = [None, "", "x", "a" * 150, "b" * 900, "cd" * 400, shared[0], shared[0], "z" * 199, "z" * 199]
    for _ in range(60):
        parts = [say(rng.randint(1, 80))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared).split()
            if rng.random() < 0.6:
                s[rng.randrange(len(s))] = "edit"
            a = rng.randint(0, 15)
            parts += [" ".join(s[a:]), say(rng.randint(0, 40))]
        texts.append(" ".join(parts))
    texts += texts[20:24]
    return texts


@pytest.mark.parametrize("most", [4000, 1])
def test_against_brute_force(spark, most):
    texts = corpus(random.Random(7))
    rows = [Row(doc_id=i, text=t, kept="clash", t1=1) for i, t in enumerate(texts)]
    got = substrings.dedup_substrings(spark.createDataFrame(rows), most=most).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == brute(texts)


def test_no_table_stays_in_the_catalog(spark):
    docs = spark.createDataFrame([(1, "ab" * 300), (2, "cd" * 80)], "doc_id long, text string")
    substrings.dedup_substrings(docs).collect()
    substrings.without_repeats(docs).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup_substrings(docs).count() == 0


def test_long_text_is_cut_into_chunks_without_loss(monkeypatch):
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(5000))
    whole = substrings.elected(raw)
    monkeypatch.setattr(substrings, "CHUNK", 700)
    assert substrings.elected(raw).tolist() == whole.tolist()
    assert all(any(i <= a <= i + 168 for a in whole) for i in range(0, 4800, 7))


def test_deep_shallow_order():
    rng = random.Random(3)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 60))]
        strings += [strings[0] + b"tail"] * 3 + [b"a" * 50] * 4
        cut = rng.randint(1, len(strings) - 1)
        ranked = suffixsort.order(strings, [(0, cut), (cut, len(strings))])
        got = [strings[i] for i in ranked]
        assert got == sorted(strings[:cut]) + sorted(strings[cut:])
        lcp = suffixsort.neighbour_lcp(strings, ranked, [0, cut], 70)
        assert lcp[cut] == -1
        assert all(lcp[i] == suffixsort.common_prefix(got[i - 1], got[i]) for i in range(1, len(got)) if i != cut)
