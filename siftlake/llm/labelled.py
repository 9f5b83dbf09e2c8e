"""Bounded samples of labelled texts for the classifiers, and a small logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, settle, text_of


#: Characters of all labelled texts that come to the driver at most; longest word; pieces of longer ones and their distance.
CHARS, LONG, PIECE, STEP = 24_000_000, 40, 24, 12


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int,
           id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS) -> list[tuple[str, int]]:
    """Up to per_class (text, label) of either class, in a fixed order that hashes of the ids give.

    Only rows whose crc32(id as text) mod modulus is not held_out are used. Null ids and labels are not;
    of an id that is labelled twice the greater label counts, of an id that stands twice one text.
    The texts have at most `chars` characters together: taken in the order of the hashes, each class by
    itself, a text that would go beyond half of that is left out whole. The bounds are on the sample that
    comes to the driver; scoring reads every text.
    """
    ident = column(labels, id_col)
    known = labels.select(ident.alias("id"), column(labels, label).cast("int").alias("y")).filter(
        "id IS NOT NULL AND y IN (0, 1)"
    ).groupBy("id").agg(F.max("y").alias("y"))
    known = known.filter(F.crc32(F.col("id").cast("string")) % modulus != held_out)
    order = [F.xxhash64(F.lit(7), "id"), F.col("id")]
    picked = known.filter("y = 0").orderBy(*order).limit(per_class).unionByName(known.filter("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select(column(docs, id_col).alias("id"), text_of(column(docs, text_col)).alias("text"))
    # picked has at most 2 * per_class rows.
    found = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.max("text").alias("text"))
    found = settle(found.withColumn("h", order[0]), "labelled")
    left, fits = {0: chars // 2, 1: chars // 2}, []
    for r in sorted(found.select("h", "id", "y", F.char_length("text").alias("n")).collect()):
        if r.n <= left[r.y]:
            left[r.y] -= r.n
            fits.append(r.id)
    chosen = found if len(fits) == found.count() else found.join(F.broadcast(found.sparkSession.createDataFrame([(i,) for i in fits], found.select("id").schema)), "id")
    rows = sorted((r.id, r.text, r.y) for r in chosen.select("id", "text", "y").collect())
    rnd = np.random.default_rng(11)
    return [(rows[i][1], rows[i][2]) for i in rnd.permutation(len(rows))]


def class_sizes(labels: DataFrame, label: str, modulus: int, held_out: int, id_col: str = "doc_id") -> tuple[int, int]:
    """How many ids of either class may be learnt from; sample() takes of each class what its bounds let it."""
    ident = column(labels, id_col)
    known = labels.select(ident.alias("id"), column(labels, label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y")).filter(F.crc32(F.col("id").cast("string")) % modulus != held_out)
    found = dict(known.groupBy("y").count().collect())
    return found.get(0, 0), found.get(1, 0)


def prior_shift(ys, sizes: tuple[int, int] | None) -> float:
    """What to add to log-odds learnt from a sample with these labels, so that they are those of classes of these sizes."""
    n0, n1 = int((ys == 0).sum()), int((ys == 1).sum())
    if not sizes or not min(*sizes, n0, n1):
        return 0.0
    return float(np.log(sizes[1] / sizes[0]) - np.log(n1 / n0))


def words_of(text: str) -> list[str]:
    """What white space separates; a longer run than LONG is overlapping pieces that cover it, so all of it counts."""
    words = text.split()
    if words and max(map(len, words)) > LONG:
        return [p for w in words for p in ([w] if len(w) <= LONG else [w[i: i + PIECE] for i in range(0, len(w) - PIECE + STEP, STEP)])]
    return words


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (bias last) by Newton's method; classes as they come."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(h, x.T @ (y - p) - reg * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
