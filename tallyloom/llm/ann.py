"""Nearest neighbours by inner product over balanced posting lists.

Vectors are lifted by one coordinate so that the largest inner product is the
least distance. A bounded sample is halved again and again at the median of its
widest direction, which gives centroids of equally full lists. Every different
vector goes to its nearest list, and near a boundary to several, so that a search
need not open both sides. A query walks a small neighbour graph over the
centroids, held in memory, and opens the lists whose distance is within a ratio
of the nearest one. That ratio is measured on the table itself: a sample of its
queries is compared with all vectors, and the ratio is the least that opens a list
of ``TARGET`` of their true neighbours. No number of lists is fixed, so recall
holds as the lists grow in number; on vectors without any structure this opens a
large share of them. Neighbouring lists are stored together in blocks of bounded
size, queries meet them in blocks, and only each query's best leave a block.

Equal vectors are one entry with its least ids, so a vector that a third of all
rows share costs one entry and one search.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.llm.common import written

#: Vectors of the sample that places the centroids, and the most lists.
SAMPLE = 20_000
LISTS = 2048
#: Vectors that a list should hold, and that a stored block may hold.
LIST_SIZE = 128
BLOCK = 2048
#: Neighbouring lists that are stored together, so that a query is sent once to all of them.
TOGETHER = 16
#: Pairs of blocks that are handed to Python at once.
PAIRS = 64
#: Candidates that a task holds before it leaves each query's best of them only.
HELD = 1_000_000
#: Queries that meet a block together.
QUERIES = 256
#: Replicas: up to REPLICAS lists whose distance is within NEAR times the least.
REPLICAS, NEAR = 4, 1.10
#: Search: the share of true neighbours that opened lists must hold, and the queries it is measured on.
TARGET, MEASURED = 0.95, 256
#: The walk goes on while it finds one of the BEAM nearest lists or one within the ratio.
BEAM = 48
#: Neighbours of a centroid in the graph.
DEGREE = 24


def usable(vector: Column) -> Column:
    """True for vectors that are not null, not zero, and hold finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of equally full parts of ``x``, halved at the median of the widest direction."""
    parts = [x]
    while len(parts) * 2 <= lists and len(parts[0]) >= 4:
        halves = []
        for part in parts:
            centred = part - part.mean(axis=0)
            axis = centred[np.linalg.norm(centred, axis=1).argmax()]
            for _ in range(6):
                axis = centred.T @ (centred @ axis)
                axis = axis / (np.linalg.norm(axis) or 1)
            by = np.argsort(centred @ axis, kind="stable")
            halves += [part[by[: len(by) // 2]], part[by[len(by) // 2 :]]]
        parts = halves
    return np.array([p.mean(axis=0) for p in parts])


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


class Centroids:
    """Centroids, a neighbour graph over them, and the largest norm of the indexed vectors."""

    def __init__(self, points: np.ndarray, norm: float):
        self.points, self.norm = points, norm
        d = _sq(points, points)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, : min(DEGREE, max(len(points) - 1, 0))]
        self.graph = [set(row.tolist()) for row in near]
        for i, row in enumerate(near.tolist()):
            for j in row[: DEGREE // 2]:
                self.graph[j].add(i)
            if i:
                self.graph[i].add(i // 2)  # long links keep the graph connected
                self.graph[i // 2].add(i)
        self.graph = [np.array(sorted(x), dtype=np.int64) for x in self.graph]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))[:, None]])

    def aim(self, q: np.ndarray) -> np.ndarray:
        scaled = q * (self.norm / np.linalg.norm(q, axis=1))[:, None]
        return np.hstack([scaled, np.zeros((len(q), 1))])

    def search(self, q: np.ndarray, ratio: float, width: int = BEAM, sizes: np.ndarray | None = None, need: int = 0) -> list[int]:
        """Lists for one aimed query within ``ratio`` of the nearest: best-first over the graph.

        Where these lists hold fewer than ``need`` different vectors by ``sizes``, the
        next nearest lists join them until they do, or until all lists are open.
        """
        entry = np.arange(0, len(self.points), max(1, len(self.points) // 16))
        seen = set(entry.tolist())
        dist = lambda which: ((self.points[which] - q) ** 2).sum(1)
        todo = sorted(zip(dist(entry).tolist(), entry.tolist(), strict=True))
        found = list(todo)
        best = [-d for d, _ in todo[:width]]
        heapq.heapify(best)
        least = todo[0][0]
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) == width and d > max(-best[0], least * ratio**2):
                break
            fresh = [j for j in self.graph[i].tolist() if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for e, j in zip(dist(np.array(fresh)).tolist(), fresh, strict=True):
                heapq.heappush(todo, (e, j))
                found.append((e, j))
                least = min(least, e)
                (heapq.heappush if len(best) < width else heapq.heappushpop)(best, -e)
        opened = [i for d, i in sorted(found) if d <= least * ratio**2]
        if sizes is not None and sizes[opened].sum() < need:
            rest = np.setdiff1d(np.argsort(dist(slice(None)), kind="stable"), opened, assume_unique=True)
            more = int(np.searchsorted(sizes[opened].sum() + np.cumsum(sizes[rest]), need)) + 1
            opened += rest[:more].tolist()
        return opened

    def ratio(self, q: np.ndarray, near: list[np.ndarray], target: float = TARGET) -> float:
        """The least ratio at which the lists opened for the queries ``q`` hold ``target`` of their neighbours ``near``."""
        need = []
        for own, x in zip(_sq(self.aim(q), self.points), near, strict=True):
            need += [max(1.0, own[h].min() / max(own.min(), 1e-300)) for h in self.homes(self.lift(x))]
        need.sort()
        return float(np.sqrt(need[int(np.ceil(target * len(need))) - 1])) * (1 + 1e-9) if need else 1.0

    def homes(self, x: np.ndarray) -> list[list[int]]:
        """Lists of each lifted vector: the nearest, and others nearly as near that lie in another direction."""
        d = _sq(x, self.points)
        order = np.argsort(d, axis=1)[:, : 2 * REPLICAS]
        out = []
        for row, near in zip(d, order.tolist(), strict=True):
            chosen = [near[0]]
            for j in near[1:]:
                if len(chosen) == REPLICAS or row[j] > row[near[0]] * NEAR**2:
                    break
                if all(((self.points[j] - self.points[i]) ** 2).sum() > row[j] * 0.5 for i in chosen):
                    chosen.append(j)
            out.append(chosen)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _sorted_dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, added up in the order of the components."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def _structs(column: pa.Array, row: int) -> list[pa.Array]:
    """The fields of the structs that one row lists."""
    return column[row].values.flatten()


def _rows(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _best(scores: np.ndarray, q: np.ndarray, x: np.ndarray, who: np.ndarray, e: np.ndarray, keep: int) -> pa.RecordBatch:
    """The ``keep`` best vectors of each query, and some more for ties; scores of minus infinity are no candidates."""
    n = min(keep + 8, scores.shape[1])
    top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    at, to = np.repeat(np.arange(len(q)), n), top.ravel()
    opened = np.isfinite(scores[at, to])
    at, to = at[opened], to[opened]
    return pa.RecordBatch.from_arrays([pa.array(who[at]), pa.array(e[to]), pa.array(_sorted_dot(q[at], x[to]))], names=["q", "e", "score"])


def _merged(found: list[pa.RecordBatch], keep: int) -> pa.RecordBatch:
    """Each query's ``keep`` best different vectors of several batches."""
    q, e, score = (np.concatenate([b.column(i).to_numpy() for b in found]) for i in range(3))
    by = np.lexsort((e, -score, q))
    q, e, score = q[by], e[by], score[by]
    new = np.r_[True, (q[1:] != q[:-1]) | (e[1:] != e[:-1])]
    q, e, score = q[new], e[new], score[new]
    begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    best = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)])) < keep
    return pa.RecordBatch.from_arrays([pa.array(q[best]), pa.array(e[best]), pa.array(score[best])], names=["q", "e", "score"])


def _combined(run, keep: int):
    """``run``, with what it finds for a query in a task merged before it leaves the task."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in run(batches):
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows > HELD:
                held = [_merged(held, keep)]
                rows = held[0].num_rows
                if rows > HELD // 2:
                    yield held[0]
                    held, rows = [], 0
        if held:
            yield _merged(held, keep)

    return merge


def _meet(keep: int):
    """Block by query block -> each query's ``keep`` best vectors among the lists that it opens in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored, waiting = (batch.column(batch.schema.get_field_index(c)) for c in ("block", "asked"))
            for row in range(batch.num_rows):
                e, v, lists = _structs(stored, row)
                who, a, opens = _structs(waiting, row)
                # A vector stands in several lists of a block; its first row is its place.
                e, first, place = np.unique(e.to_numpy(), return_index=True, return_inverse=True)
                x, q, lists = _rows(v)[first], _rows(a), lists.to_numpy()
                scores = np.full((len(q), len(x)), -np.inf)
                asks = np.repeat(np.arange(len(q)), [len(o) for o in opens.to_pylist()])
                opened = opens.flatten().to_numpy()
                for one in np.unique(lists):
                    at, to = asks[opened == one], place[lists == one]
                    if len(at):
                        scores[np.ix_(at, to)] = q[at] @ x[to].T
                yield _best(scores, q, x, who.to_numpy(), e, keep)

    return _combined(run, keep)


def _scan(asked: list[tuple[int, list[float]]], keep: int):
    """All vectors -> the ``keep`` best of each batch for every one of ``asked``, which are no neighbours of themselves."""
    who, q = np.array([e for e, _ in asked]), np.array([v for _, v in asked], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                e, x = batch.column(0).to_numpy(), _rows(batch.column(1))
                yield _best(np.where(who[:, None] == e[None], -np.inf, q @ x.T), q, x, who, e, keep)

    return _combined(run, keep)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            sample: int = SAMPLE, lists: int = LISTS, target: float = TARGET) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products found for every row that ``queries`` is true of.

    A row is no neighbour of itself, but its copies are. Unusable vectors, null ids
    and vectors of another length than the most common one take no part. Equal
    scores rank by smaller id. Repeated (id, vector) rows count once. Opened lists
    hold ``target`` of the true neighbours, as measured on up to ``MEASURED`` queries,
    and at least ``k`` candidates, or all there are. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == common["n"]).select("id", "v", F.coalesce("asks", F.lit(False)).alias("asks"), F.xxhash64("v").alias("e1"), F.xxhash64(F.lit(1), "v").alias("e2"))
    rows = written(rows.dropDuplicates(["id", "e1", "e2"]), "vectors")
    first = rows.select("id", "e1", "e2").withColumn("r", F.row_number().over(W.partitionBy("e1", "e2").orderBy("id"))).filter(F.col("r") <= k + 1)
    ids = first.groupBy("e1", "e2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    kinds = rows.groupBy("e1", "e2").agg(F.max("asks").alias("asks"), F.first("v").alias("v")).join(ids, ["e1", "e2"])
    # The least id of a vector names its entry.
    entries = written(kinds.select(F.col("ids")[0].alias("e"), "e1", "e2", "ids", "v", "asks"), "entries")
    whole = entries.agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    picked = np.array([r["v"] for r in entries.orderBy("e1", "e2").select("v").limit(sample).collect()])  # ``sample`` rows at most
    few = int(min(lists, max(1, whole["n"] // LIST_SIZE)))
    blank = Centroids(np.zeros((1, common["n"] + 1)), whole["norm"])
    index = Centroids(balanced_centroids(blank.lift(picked), few), whole["norm"])
    tried = [(r["e"], r["v"]) for r in entries.filter("asks").orderBy("e2", "e1").select("e", "v").limit(MEASURED).collect()]  # MEASURED rows at most
    ratio = 1.0
    if tried and len(index.points) > 1:
        scanned = entries.select("e", "v").mapInArrow(_scan(tried, k), "q long, e long, score double")
        true = scanned.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "e"))).filter(F.col("r") <= k)
        near: dict[int, list] = {}
        for r in true.select("q", "e").join(entries.select("e", "v"), "e").select("q", "v").collect():  # MEASURED * k rows at most
            near.setdefault(r["q"], []).append(r["v"])
        ratio = index.ratio(np.array([v for e, v in tried if e in near]), [np.array(near[e]) for e, _ in tried if e in near], target)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                homes = index.homes(index.lift(_matrix(part.column(1))))
                many = np.repeat(np.arange(part.num_rows), [len(h) for h in homes])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(many)), part.column(1).take(pa.array(many)), pa.array([j for h in homes for j in h], pa.int32()),
                        pa.array([n == 0 for h in homes for n in range(len(h))]),
                    ],
                    names=["e", "v", "list", "main"],
                )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = []
                for i, q in enumerate(index.aim(_matrix(part.column(1)))):
                    near: dict[int, list[int]] = {}
                    for j in index.search(q, ratio, sizes=sizes, need=k + 1):
                        near.setdefault(j // TOGETHER, []).append(j)
                    found += [(i, g, js) for g, js in near.items()]
                many = pa.array([i for i, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(many), part.column(1).take(many), pa.array([js for _, _, js in found], pa.list_(pa.int32())),
                        pa.array([g for _, g, _ in found], pa.int32()),
                    ],
                    names=["e", "v", "lists", "part"],
                )

    def blocks(df: DataFrame, name: str, size: int, *columns: str) -> DataFrame:
        """Rows of neighbouring lists in salted blocks of about ``size``; there are at most ``lists`` sizes."""
        counts = df.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
        salted = df.join(F.broadcast(counts), "part").withColumn("salt", F.pmod(F.xxhash64("e"), F.col("parts")))
        return salted.groupBy("part", "salt").agg(F.collect_list(F.struct(*columns)).alias(name)).select("part", name)

    placed = entries.select("e", "v").mapInArrow(place, "e long, v array<double>, list int, main boolean").withColumn("part", F.floor(F.col("list") / TOGETHER).cast("int"))
    placed = written(placed, "placed")
    # Every vector counts in its main list alone, so lists that hold k + 1 so counted hold k others than the query's own.
    sizes = np.zeros(len(index.points), dtype=np.int64)
    for r in placed.filter("main").groupBy("list").count().collect():  # one row for each list at most
        sizes[r["list"]] = r["count"]
    stored = blocks(placed, "block", BLOCK, "e", "v", "list")
    probed = entries.filter("asks").select("e", "v").mapInArrow(probe, "e long, v array<double>, lists array<int>, part int")
    asked = blocks(written(probed, "probed"), "asked", QUERIES, "e", "v", "lists")
    met = stored.join(asked, "part").select("block", "asked").mapInArrow(_meet(k + 1), "q long, e long, score double")
    one = met.groupBy("q", "e").agg(F.max("score").alias("score"))
    top = one.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "e"))).filter(F.col("r") <= k + 1)
    found = top.join(entries.select("e", "ids"), "e").select("q", "score", F.explode("ids").alias("vec_id"))
    heads = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    heads = heads.groupBy("q").agg(F.collect_list(F.struct("score", "vec_id")).alias("found"))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(batch)
    spark.conf.set(batch, str(PAIRS))  # a row holds two blocks
    try:
        heads = written(heads, "heads")
    finally:
        spark.conf.set(batch, usual)
    asking = rows.filter("asks").select(F.col("id").alias("query_id"), "e1", "e2").join(entries.select("e1", "e2", F.col("e").alias("q")), ["e1", "e2"])
    ranked = F.slice(F.filter(F.array_sort("found", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)), lambda s: s["vec_id"] != F.col("query_id")), 1, k)
    final = asking.join(heads, "q").select("query_id", F.posexplode(ranked).alias("rank", "s"))
    return final.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "s.vec_id", "s.score")
