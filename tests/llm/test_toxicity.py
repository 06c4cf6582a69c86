import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import toxicity

SCHEMA = "doc_id long, text string, scores string, y int"


def corpus(rng, n=600):
    plain = [f"word{i}" for i in range(200)]
    bad = ["clown", "idiot", "stupid", "trash", "pathetic"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            for b in rng.sample(bad, rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), b.upper())
        docs.append((i, " ".join(w), "clash", 1))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(random.Random(8))
    frame = spark.createDataFrame(docs, SCHEMA)
    out = {r.id: r for r in toxicity.toxicity(frame, spark.createDataFrame(labels[:400], "doc_id long, toxic int")).collect()}
    assert len(out) == 600
    truth = dict(labels)
    held = range(400, 600)
    assert sum(out[i].is_toxic == bool(truth[i]) for i in held) >= 195
    assert all(0 <= out[i][c] <= 1 for i in held for c in toxicity.CHAIN)


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (120, 4)).astype(float)
    labels = np.column_stack([x[:, 0], (x[:, 0] + x[:, 1] > 1).astype(float)])
    weights = toxicity.fit_chain(x, labels, np.arange(120) % 3)
    assert [len(w) for w in weights] == [5, 6]
    found = toxicity.predict_chain(x, weights)
    assert ((found > 0.5) == (labels > 0.5)).mean() > 0.95
    assert (toxicity.predict_chain(x[:1], weights) == found[:1]).all()


def test_nulls_ties_and_empty_tables(spark):
    docs, labels = corpus(random.Random(9), 200)
    extra = [(None, "idiot", "x", 1), (1000, None, "x", 1), (1001, "", "x", 1), (1002, "word1 " * 50_000, "x", 1), docs[0], docs[0]]
    frame = spark.createDataFrame(docs + extra, SCHEMA)
    marks = spark.createDataFrame([*labels, (1000, 1), (None, 1), (5, None), labels[0], (3, 0), (3, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(frame, marks).collect()
    assert len(out) == 206
    assert not any(r.is_toxic for r in out if r.id in (1000, 1001, 1002))
    none = frame.limit(0)
    assert toxicity.toxicity(none, marks).count() == 0
    for few in (marks.limit(0), spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")):
        assert toxicity.toxicity(frame, few).filter("is_toxic").count() == 0


def test_the_sample_is_bounded_and_balanced(spark):
    docs, labels = corpus(random.Random(10), 400)
    model = toxicity.train(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"), most_rows=160)
    assert {"idiot", "clown"} & set(model.names)


def test_a_small_sample_keeps_the_rates_of_the_table(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(3000):
        toxic = i % 10 == 0
        w = [rng.choice([f"word{k}" for k in range(40)]) for _ in range(20)]
        if rng.random() < (0.6 if toxic else 0.15):
            w.append("mild")  # 31 % of its rows are toxic
        if toxic and rng.random() < 0.3:
            w.append("idiot")
        docs.append((i, " ".join(w), "clash", 1))
        labels.append((i, int(toxic)))
    frame, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    texts = pd.Series([t for _, t, _, _ in docs])
    small, large = (toxicity.train(frame, marks, most_rows=n).score(texts)[:, -1] for n in (400, 20_000))
    assert ((small >= 0.5) == (large >= 0.5)).mean() >= 0.98
    assert abs(small.mean() - 0.1) < 0.03 and abs(large.mean() - 0.1) < 0.03


def plain_fit(x, y):
    """Ridge logistic regression by many small steps down the gradient."""
    x = np.column_stack([x, np.ones(len(x))])
    w, shrink = np.zeros(x.shape[1]), np.r_[np.ones(x.shape[1] - 1), 1e-6]
    size = 1 / (np.linalg.norm(x, 2) ** 2 / 4 + 1)
    for _ in range(20_000):
        w -= size * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + shrink * w)
    return lambda rows: 1 / (1 + np.exp(-np.column_stack([rows, np.ones(len(rows))]) @ w))


def plain_scores(docs, marks, hashes):
    """Every step of the operator in loops over Python lists: features, kinds, chain, scores."""
    bag = {i: set(t.lower().split()) for i, t in docs if i is not None and t}
    rows = sorted((i for i in marks if i in bag), key=lambda i: (hashes[i], i))
    n, rate = len(rows), sum(marks[i] for i in rows) / len(rows)
    z2 = {}
    for word in {w for i in rows for w in bag[i]}:
        held = [i for i in rows if word in bag[i]]
        gap = sum(marks[i] for i in held) - len(held) * rate
        if len(held) >= 5 and gap * gap > 16 * (len(held) * rate * (1 - rate) * (1 - len(held) / n) + 1e-9):
            z2[word] = gap
    names = sorted(z2)
    toxic = [i for i in rows if marks[i]]
    units = {i: {w for w in bag[i] if z2.get(w, 0) > 0} for i in toxic}
    units = {i: {w: len(u) ** -0.5 for w in u} for i, u in units.items() if u}
    cosine = lambda a, b: sum(v * b.get(w, 0) for w, v in a.items())

    def centre(members, normed=True):
        mean = {w: sum(units[i].get(w, 0) for i in members) / len(members) for w in names}
        norm = sum(v * v for v in mean.values()) ** 0.5 if normed else 1
        return {w: v / norm for w, v in mean.items()}

    mean = centre(list(units), normed=False)
    first = max(units, key=lambda i: round(cosine(units[i], mean), 9))
    second = min(units, key=lambda i: round(cosine(units[i], units[first]), 9))
    centres = [units[first], units[second]]
    for _ in range(20):
        own = {i: int(cosine(u, centres[1]) > cosine(u, centres[0]) + 1e-12) for i, u in units.items()}
        centres = [centre([i for i in own if own[i] == k]) if k in own.values() else centres[k] for k in (0, 1)]
    own = {i: int(cosine(u, centres[1]) > cosine(u, centres[0]) + 1e-12) for i, u in units.items()}
    flags = lambda i: [float(w in bag.get(i, ())) for w in names]
    x, every = np.array([flags(i) for i in rows]), np.array([flags(i) for i, _ in docs])
    folds = np.array([hashes[i] % 3 for i in rows])
    for y in ([own.get(i) == 0 for i in rows], [own.get(i) == 1 for i in rows], [marks[i] for i in rows]):
        y = np.array(y, dtype=float)
        every = np.column_stack([every, plain_fit(x, y)(every)])
        apart = np.zeros(len(rows))
        for f in range(3):
            apart[folds == f] = plain_fit(x[folds != f], y[folds != f])(x[folds == f])
        x = np.column_stack([x, apart])
    return every[:, -3:]


def test_against_a_plain_version(spark):
    docs, labels = corpus(random.Random(14), 260)
    marks = dict(labels[:200])
    frame = spark.createDataFrame(docs, SCHEMA)
    out = {r.id: r for r in toxicity.toxicity(frame, spark.createDataFrame(labels[:200], "doc_id long, toxic int")).collect()}
    hashes = {r.doc_id: r.h for r in frame.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    want = plain_scores([(i, t) for i, t, *_ in docs], marks, hashes)
    got = np.array([[out[i][c] for c in toxicity.CHAIN] for i, *_ in docs])
    assert np.abs(got - want).max() < 1e-3
    assert [out[i].is_toxic for i, *_ in docs] == [p >= 0.5 for p in want[:, -1]]


def test_rows_with_one_id_count_once(spark):
    docs, labels = corpus(random.Random(15), 60)
    repeated = [(3, f"text {k}", "x", 1) for k in range(500)]
    rows, stands = toxicity.training_rows(
        spark.createDataFrame(docs + repeated, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", "toxic", 20
    )
    ids = [r.id for r in rows.collect()]
    assert len(ids) == len(set(ids)) == 20 and set(stands) == {0, 1}


def test_columns_stay_and_no_name_is_taken_over(spark):
    docs, labels = corpus(random.Random(16), 200)
    frame = spark.createDataFrame(docs, SCHEMA).withColumnRenamed("y", "Scores_0")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.without_toxic(frame, marks)
    assert out.columns == frame.columns and {r.scores for r in out.collect()} == {"clash"}
    with pytest.raises(ValueError):
        toxicity.classify(frame, toxicity.train(frame, marks), into="SCORES")
