import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import ann


def plain(ids, x, query, k=20):
    at = ids.index(query)
    scores = np.zeros(len(ids))
    for c in range(x.shape[1]):
        scores += x[at, c] * x[:, c]
    order = sorted((-s, i) for s, i in zip(scores.tolist(), ids, strict=True) if i != query)
    return order[:k]


def test_recall_scores_and_order(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32).astype(float)
    x[100:160] = x[100]  # copies
    ids = list(range(3000))
    frame = spark.createDataFrame([(i, x[i].tolist(), "clash", 1) for i in ids], "vec_id long, embedding array<double>, e string, list int")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (-r.score, r.vec_id)
    assert sorted(got) == ids[::20]
    hits = total = 0
    for q, ranked in got.items():
        assert sorted(ranked) == list(range(1, 21))
        listed = [ranked[r] for r in range(1, 21)]
        assert listed == sorted(listed) and all(i != q for _, i in listed)
        want = plain(ids, x, q)
        assert all(-s == (np.float64(0) + _dot(x[q], x[i])) for s, i in listed)
        hits += len({i for _, i in want} & {i for _, i in listed})
        total += 20
    assert hits / total >= 0.9


def _dot(a, b):
    out = 0.0
    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        out += p * q
    return out


def test_every_query_gets_all_ranks_though_its_lists_are_thin(spark):
    rng = np.random.default_rng(8)
    centres = 10 * rng.normal(size=(16, 8))
    x = np.vstack([np.repeat(centres, 500, axis=0) + 0.1 * rng.normal(size=(8000, 8)), 60 * rng.normal(size=(14, 8))])
    asks = set(range(8000, 8014)) | {0, 4000}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id").isin(*asks)).collect():
        got.setdefault(r.query_id, set()).add((r.rank, r.vec_id))
    assert set(got) == asks and all({k for k, _ in g} == set(range(1, 21)) and len({v for _, v in g}) == 20 for g in got.values())


def test_unusable_vectors_few_rows_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]),
        (None, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [1.0, 2.0, 3.0]), (120, [-1.0, 0.0]),
    ]
    got = ann.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [
        (0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 120, -1.0), (120, 1, 2, -0.5), (120, 2, 0, -1.0), (120, 3, 1, -1.0),
    ]
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 20 == 0).count() == 0


def test_lists_are_balanced():
    x = np.random.default_rng(1).normal(size=(1024, 8))
    x[:400] = x[:400] * 0.01  # a dense region
    points = ann.balanced_centroids(x, 16)
    assert points.shape == (16, 8)


def test_recall_holds_with_many_lists_and_no_structure(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_SIZE", 16)  # 512 lists
    x = np.random.default_rng(5).normal(size=(10_000, 32))
    x = x / np.linalg.norm(x, axis=1)[:, None]
    ids = list(range(len(x)))
    frame = spark.createDataFrame([(i, x[i].tolist()) for i in ids], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 40 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: {i for _, i in plain(ids, x, q)} for q in ids[::40]}
    assert sum(len(want[q] & got[q]) for q in want) / sum(map(len, want.values())) >= 0.93
