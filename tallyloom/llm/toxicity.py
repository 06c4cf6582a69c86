"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each later model sees the words of
a text and the probabilities of the categories before it. In training those
probabilities come from models that did not see the row (out of fold), so that a
later model learns how far it can trust them.

The last category is the label of the table, which names no kinds of toxicity. The
earlier ones are kinds learned from the labelled rows: toxic rows are parted by the
words that speak for the label, each row to the group whose words it shares most.
No word is given beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD_BYTES, words, written

#: Learned kinds of toxicity, in the order in which the chain predicts them.
KINDS = ("kind_1", "kind_2")
CHAIN = (*KINDS, "toxic")
#: Words that may become features, by how unevenly they fall over the labels.
FEATURES = 512
#: Labelled rows that features are chosen and models fitted on.
MOST_ROWS = 20_000
#: Labelled rows a word needs.
LEAST_ROWS = 5
FOLDS = 3
CUTOFF = 0.5
RIDGE = 1.0
STEPS = 30
#: Rounds in which toxic rows are parted into kinds.
ROUNDS = 20
#: Rows of which sums are taken at once.
BLOCK = 2048


def features(labelled: DataFrame, most: int = FEATURES) -> list[tuple[str, bool]]:
    """The words that fall most unevenly over the label, by the square of their z-score, and whether they speak for it; at most ``most``."""
    total = labelled.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    if not total["n"] or not 0 < total["y"] < total["n"]:
        return []
    n, rate = total["n"], total["y"] / total["n"]
    counts = labelled.select("y", F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("rows"), F.sum("y").alias("hits"))
    gap = F.col("hits") - F.col("rows") * rate
    scored = counts.filter(F.col("rows") >= LEAST_ROWS).select(
        "word", (gap * gap / (F.col("rows") * rate * (1 - rate) * (1 - F.col("rows") / n) + 1e-9)).alias("z2"), (gap > 0).alias("speaks")
    )
    top = scored.filter("z2 > 16").orderBy(F.desc("z2"), "word").limit(most)
    return [(r["word"], r["speaks"]) for r in top.collect()]  # at most ``most`` words


def kinds(x: np.ndarray, many: int = len(KINDS), rounds: int = ROUNDS) -> np.ndarray:
    """The kind (from 0) of each row of word flags; -1: no flag is set.

    The first centre is the row nearest to the mean, each further one the row least
    like the centres so far; then rows go to the centre of the largest cosine, ties
    to the first, and centres to the mean of their rows.
    """
    out = np.full(len(x), -1)
    lit = np.flatnonzero(x.any(axis=1))
    if not len(lit):
        return out
    rows = x[lit] / np.linalg.norm(x[lit], axis=1, keepdims=True)
    centres = [rows[(rows @ rows.mean(axis=0)).argmax()]]
    while len(centres) < many:
        centres.append(rows[(rows @ np.array(centres).T).max(axis=1).argmin()])
    centres = np.array(centres)
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        for k in range(many):
            if (own == k).any():
                mean = rows[own == k].mean(axis=0)
                centres[k] = mean / np.linalg.norm(mean)
    out[lit] = (rows @ centres.T).argmax(axis=1)
    return out


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS, rows: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the bias, which is not shrunk. ``rows`` weighs the rows.

    Sums go over blocks of rows, so that beside ``x``, of any type, little memory is used.
    """
    rows = np.ones(len(x)) if rows is None else rows
    w = np.zeros(x.shape[1] + 1)
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6
    for _ in range(steps):
        slope, bend = shrink * w, np.diag(shrink)
        for at in range(0, len(x), BLOCK):
            part = np.column_stack([x[at : at + BLOCK].astype(float), np.ones(len(x[at : at + BLOCK]))])
            p, of = _sigmoid(part @ w), rows[at : at + BLOCK]
            slope = slope + part.T @ (of * (p - y[at : at + BLOCK]))
            bend = bend + (part * (of * p * (1 - p))[:, None]).T @ part
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, rows: np.ndarray | None = None) -> list[np.ndarray]:
    """One weight vector per category. Later models see out-of-fold probabilities of the earlier ones."""
    out, seen = [], x
    rows = np.ones(len(x)) if rows is None else rows
    for k in range(labels.shape[1]):
        y = labels[:, k]
        out.append(fit_linear(seen, y, rows=rows))
        apart = np.full(len(y), np.average(y, weights=rows) if len(y) else 0.0)
        for f in range(FOLDS):
            mine = folds == f
            if mine.any() and (~mine).any():
                w = fit_linear(seen[~mine], y[~mine], rows=rows[~mine])
                apart[mine] = _sigmoid(seen[mine] @ w[:-1] + w[-1])
        seen = np.column_stack([seen, apart.astype(seen.dtype)])
    return out


def predict_chain(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """A column of probabilities for each category of the chain."""
    seen = x
    for w in weights:
        seen = np.hstack([seen, _sigmoid(seen @ w[:-1] + w[-1])[:, None]])
    return seen[:, x.shape[1] :]


class Model:
    """Feature words and chain weights; with no words it finds nothing toxic."""

    def __init__(self, names: list[str], weights: list[np.ndarray]):
        self.names, self.weights = names, weights

    def score(self, texts: pd.Series) -> np.ndarray:
        index = {w.encode(): i for i, w in enumerate(self.names)}
        known = index.keys()
        x = np.zeros((len(texts), len(index)))
        for row, text in enumerate(texts):
            for w in known & set((text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()):
                x[row, index[w]] = 1
        return predict_chain(x, self.weights)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_rows: int) -> tuple[DataFrame, dict[int, float]]:
    """``(id, y, h, w)``, one row for each sampled id, and how many rows of its label a row stands for.

    Of several documents with one id, that with the least hash of its text is taken.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    marks = marks.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    part = lambda y: marks.filter(F.col("y") == y).orderBy("h", "id").limit(most_rows // 2)
    sample = F.broadcast(written(part(0).union(part(1)), "sample"))  # most_rows rows at most
    shares = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna().join(sample, "id")
    one = texts.groupBy("id", "y", "h").agg(F.min_by(F.array_distinct(words(F.col("text"))), F.xxhash64("text")).alias("w"))
    return written(one, "labelled"), {y: n / min(n, most_rows // 2) for y, n in shares.items()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          most_rows: int = MOST_ROWS) -> Model:
    """Fit the chain on labelled rows; rows with a null id or text, or a label other than 0 and 1, take no part.

    Fitting uses a bounded sample: of either label the ``most_rows // 2`` ids with
    the least hash, and one document for each. The ids are few enough to broadcast
    at every size of the corpus; texts leave the executors as feature words. A row
    weighs as many rows of its label as it stands for, so that probabilities keep
    the table's own rates when the sample does not. An id with several labels is
    toxic if one of them says so.
    """
    labelled, stands = training_rows(docs, labels, id_col, text_col, label_col, most_rows)
    chosen = features(labelled)
    if not chosen:
        return Model([], [np.array([-35.0])] + [np.r_[np.zeros(k), -35.0] for k in range(1, len(CHAIN))])
    names = [w for w, _ in chosen]
    listed = F.array(*[F.lit(w) for w in names])
    found = F.transform(F.array_intersect("w", listed), lambda w: F.array_position(listed, w).cast("short"))
    rows = labelled.select("id", "h", "y", found.alias("found")).orderBy("h", "id").toPandas()  # most_rows rows at most
    x = np.zeros((len(rows), len(names)), dtype=np.float32)
    for r, places in enumerate(rows["found"]):
        x[r, np.asarray(places, dtype=int) - 1] = 1
    y = rows["y"].to_numpy(dtype=float)
    kind = np.full(len(rows), -1)
    kind[y == 1] = kinds(x[y == 1] * np.array([speaks for _, speaks in chosen]))
    marks_of = np.column_stack([*((kind == k).astype(float) for k in range(len(KINDS))), y])
    weights = rows["y"].map(stands).to_numpy(dtype=float)
    return Model(names, fit_chain(x, marks_of, (rows["h"] % FOLDS).to_numpy() % FOLDS, weights / weights.mean()))


def classify(docs: DataFrame, model: Model, text_col: str = "text", into: str = "scores") -> DataFrame:
    """``docs`` with a struct column ``into`` of one probability per category and ``is_toxic``.

    ``into`` must be no name of ``docs``, as its values would be lost.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {into} already")

    @F.pandas_udf(", ".join([f"{c} double" for c in CHAIN] + ["is_toxic boolean"]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            p = np.vstack([model.score(texts.iloc[a : a + 2000]) for a in range(0, len(texts), 2000)] or [np.zeros((0, len(CHAIN)))])
            out = pd.DataFrame(p, columns=list(CHAIN))
            yield out.assign(is_toxic=out["toxic"] >= CUTOFF)

    return docs.withColumn(into, run(F.col(text_col)))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that the chain finds toxic; their columns stay as they are, whatever their names."""
    taken = {c.lower() for c in docs.columns}
    into = next(name for n in range(len(taken) + 1) if (name := f"scores_{n}") not in taken)
    scored = classify(docs, train(docs, labels, id_col, text_col, **options), text_col, into)
    return scored.filter(~F.col(into)["is_toxic"]).drop(into)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, <category> ..., is_toxic)`` for every row.

    Null and empty texts have no words and so no toxic ones; texts of any length are
    read whole. Repeated rows and rows with null or equal ids are scored each for
    itself. An empty table gives no rows; without labels of both kinds nothing is
    toxic. Other columns are ignored, whatever their names.
    """
    model = train(docs, labels, id_col, text_col)
    scored = classify(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return scored.select("id", "scores.*")
