import random
import re
from collections import Counter

import pytest
from pyspark.sql import Row

from tallyloom.llm import decontaminate


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(texts, items):
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            k = min(10, len(b))
            spans = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in spans:
                    hit |= set(range(i, i + k))
                    if item is not None:
                        found.add(str(item))
        out.append((len(w), len(hit), sorted(found), bool(hit)))
    return out


def plain_near(texts, items, slop=3):
    """Per text the items with a near window, and every (text, start, item, phrase, exact) of one."""
    split = [words(t) for t in texts]
    freq = Counter(x for w in split for x in w)
    spans = {}
    for item, text in items:
        b = words(text)
        k = min(10, len(b))
        for i in range(len(b) - k + 1 if k and item is not None else 0):
            spans.setdefault(tuple(b[i : i + k]), set()).add(item)
    placed = set()
    for span, ids in spans.items():
        if all(x in freq for x in span):
            o = min(range(len(span)), key=lambda j: (freq[span[j]], j))
            for d, w in enumerate(split):
                for s in (p - o for p, x in enumerate(w) if x == span[o]):
                    if all(x in w[max(s + j - slop, 0) : max(s + j + slop + 1, 0)] for j, x in enumerate(span)):
                        placed |= {(d, s, item, " ".join(span), s >= 0 and tuple(w[s : s + len(span)]) == span) for item in ids}
    return [sorted({str(item) for at, _, item, _, _ in placed if at == d}) for d in range(len(texts))], placed


def corpus(rng):
    vocabulary = ["the", "of", "a"] * 10 + [f"t{i}" for i in range(60)] + ["é", "naïve", "x1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(8, 30))) for i in range(20)]
    items += [(20, ""), (21, None), (22, "solo"), (23, "the of"), (24, "the " * 14), (25, items[0][1]), (25, say(12))]
    texts = [None, "", "!!! ---", "Solo", "the " * 40, items[0][1].upper()]
    for _ in range(40):
        parts = [say(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, 4)
            parts += [", ".join(w[a : a + rng.randint(5, 25)]), say(rng.randint(0, 20))]
        if rng.random() < 0.5:
            w = words(rng.choice(items)[1])[:14]
            w = [x for y in w for x in ([rng.choice(vocabulary), y] if rng.random() < 0.2 else [y])]
            for i in range(0, len(w) - 1, 3):
                if rng.random() < 0.3:
                    w[i], w[i + 1] = w[i + 1], w[i]
            parts.insert(rng.randint(0, 1), " ".join(w))
        texts.append(" ".join(parts))
    return texts, items


def test_against_brute_force(spark):
    texts, items = corpus(random.Random(3))
    docs = spark.createDataFrame([Row(doc_id=i, text=t, term="clash", phrase=1, w=None) for i, t in enumerate(texts)], "doc_id long, text string, term string, phrase int, w int")
    bench = spark.createDataFrame([Row(item_id=i, text=t, terms="clash") for i, t in items])
    got = sorted(decontaminate.decontaminate(docs, bench).collect(), key=lambda r: r.id)
    assert [(r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got] == plain(texts, items)
    near, _ = plain_near(texts, items)
    assert [list(r.near_items) for r in got] == near
    assert any(set(n) - set(p[2]) for n, p in zip(near, plain(texts, items)))
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, p in enumerate(plain(texts, items)) if not p[3]]


def test_joins_beyond_the_broadcast_limit_agree(spark, monkeypatch):
    texts, items = corpus(random.Random(4))
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(map(tuple, df.select("id", "n_words", "n_hit", "items", "near_items").collect()))
    small = key(decontaminate.decontaminate(docs, bench))
    monkeypatch.setattr(decontaminate, "_small", lambda df, most=0: df.hint("merge"))
    assert key(decontaminate.decontaminate(docs, bench)) == small


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "one two"), (1, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text), (None, "one two")], "item_id long, text string")
    got = [(r.id, r.n_hit) for r in decontaminate.decontaminate(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 10), (1, 10), (None, 10), (2, 0), (1, 0)], key=str)
    none, nothing = docs.limit(0), bench.limit(0)
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, nothing).filter("contaminated").count() == 0
    assert decontaminate.without_leaks(docs, nothing).count() == 5


def test_proximity_finds_displaced_terms(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta x gamma delta"), (3, "delta alpha " + "x " * 30 + "beta")], "doc_id long, text string")
    index = decontaminate.Decontaminator(docs, bench)
    assert sorted((r.id, r.start, r.exact) for r in index.proximity(3).collect()) == [(1, 0, True), (2, 2, False)]
    assert [r.id for r in index.proximity(1).collect()] == [1]
    assert [r.id for r in index.matches().collect()] == [1]


@pytest.mark.parametrize("slop", [1, 3, 12])
def test_near_matches_against_brute_force(spark, slop):
    texts, items = corpus(random.Random(5))
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.id, r.start, r["item"], r.phrase, r.exact) for r in decontaminate.Decontaminator(docs, bench).proximity(slop).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_near(texts, items, slop)[1]
