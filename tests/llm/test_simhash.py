import random

import pytest
import xxhash
from pyspark.sql import Row

from tallyloom.llm import components, simhash

WORDS = [f"w{i}" for i in range(300)]


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(gap, " ")
    found = [w for w in lowered.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return [min(groups[find(i)]) for i in range(len(ids))]


def corpus(rng):
    texts = [None, "", " \t\n", "One", "one two", "É é", "x y z"]
    for _ in range(60):
        texts.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 400))))
    for t in texts[30:50]:
        s = t.split()
        s[rng.randrange(len(s))] = "edit"
        texts += [" ".join(s), t.upper(), t]
    return texts


@pytest.mark.parametrize("limit", [2048, 1])
def test_against_brute_force(spark, limit):
    texts = corpus(random.Random(5))
    ids = [3 * i + 1 for i in range(len(texts))]
    rows = [Row(doc_id=i, text=t, fp="clash", root=1, th=None) for i, t in zip(ids, texts, strict=True)]
    got = {r.id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string, root int, th int"), limit=limit).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i].fp % (1 << 64) for i in ids] == fps
    assert [got[i].component for i in ids] == plain_components(ids, fps)


def test_dense_buckets_of_fingerprints(spark):
    """Fingerprints that share most of their bits go through all cuts and lose no link."""
    rng = random.Random(2)
    fps = sorted({sum(1 << b for b in rng.sample(range(20), rng.randint(0, 9))) for _ in range(250)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.linked_pairs(frame, limit=8)
    found = {r.node: r.root for r in components.components(links).collect()}
    assert [found.get(f, f) for f in fps] == plain_components(fps, fps)


def test_every_pair_within_the_radius_meets():
    masks = [m for m, _ in simhash.covering_masks(list(range(64)))]
    rng = random.Random(1)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        assert any(not differ & m for m in masks)


def test_nulls_empty_and_repeats(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d"), (None, None), (5, ""), (7, "a b c d"), (7, "a b c d"), (9, "q r s t u")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.id or 0), r.component) for r in got) == [(0, 5), (0, 7), (5, 5), (7, 7), (7, 7), (9, 9)]
    kept = simhash.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, kept)) == [(5, ""), (7, "a b c d"), (9, "q r s t u")]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(90, 90), (100, 101)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def grams(text):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(found[i : i + 5]) for i in range(len(found) - 4)} or ({" ".join(found)} if found else set())


def plain_groups(texts):
    """The least position of each text's group, by comparing all pairs of shingle sets."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def near_copies(rng):
    """Texts with copies that differ by some words, on either side of four fifths."""
    texts = [None, "", " ", "one two", "ONE  two", "one two three"]
    for n in (60, 100, 200, 400, 1000):
        for _ in range(6):
            base = [rng.choice(WORDS) for _ in range(n)]
            texts.append(" ".join(base))
            for share in (0.9, 0.85, 0.81, 0.75, 0.6):
                other = list(base)
                for at in rng.sample(range(n), max(1, round(n * (1 - share) / (1 + share) / 5))):
                    other[at] = "changed"
                texts.append(" ".join(other))
    return texts


def groups_of(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    out = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string, root string, keys int")).collect()
    first = {}
    for r in sorted(out, key=lambda r: r.id):
        first.setdefault(r.root, r.id)
    return [first[r.root] for r in sorted(out, key=lambda r: r.id)]


def test_similar_texts_against_all_pairs(spark):
    texts = near_copies(random.Random(31))
    want = plain_groups(texts)
    assert len(set(want)) < len(texts) * 0.7
    assert groups_of(spark, texts) == want


def test_a_shared_passage_makes_no_group_and_hides_none(spark, monkeypatch):
    """Texts that share half of their words meet in some tables and are told apart, in one block, in many, and by their rarest shingles."""
    rng = random.Random(32)
    passage = " ".join(rng.choice(WORDS) for _ in range(150))
    texts = [f"{passage} " + " ".join(rng.choice(WORDS) for _ in range(90)) for _ in range(50)]
    texts += [t.replace(" ", "  ") + " more" for t in texts[::5]]
    want = plain_groups(texts)
    for block, many in ((256, 16), (8, 1000), (8, 1)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "MANY", many)
        assert groups_of(spark, texts) == want


def test_one_of_each_group_stays(spark):
    texts = near_copies(random.Random(33))
    frame = spark.createDataFrame([(len(texts) - i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, root string")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    want = plain_groups(texts[::-1])
    assert sorted(r.doc_id - 1 for r in kept.collect()) == sorted(set(want))
