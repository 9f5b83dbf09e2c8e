"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

Every feature of a word (its letters, its shape, its ends) has a fixed sparse ternary index vector that a
hash gives. A word's vector is its index vector beside its context vector: the sum of the index vectors
of the words next to it in the labelled sample, kept for frequent words and, as the fallback for all
others, for word shapes. A document pools its words' vectors: mean, deviation and mean product of
neighbours. The network's logits are divided by a temperature fitted on texts set aside. A long run without
white space is overlapping pieces that cover it (labelled.words_of), so every character of a text counts.
Dimension, size, epochs and decay were chosen by folds within the rows whose labels may be learnt.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import located, picked, settle, slices, text_of, tidy
from .labelled import class_sizes, prior_shift, sample, sigmoid, words_of
from .toxicity import classified

#: Labelled texts of each class that come to the driver at most; sizes of an index vector and of the network.
PER_CLASS, DIM, HIDDEN = 3000, 32, 32
#: Words with a context vector of their own, words that a worker remembers, words pooled at once.
VOCABULARY, REMEMBERED, CHUNK = 20_000, 80_000, 1 << 12
NONZERO = 4


def _letters(word: str) -> str:
    if word.islower():
        return "a"
    if word.isupper():
        return "A" if len(word) > 1 else "Aa"
    return "Aa" if word[:1].isupper() and word[1:].islower() else "aA"


def shape(word: str) -> str:
    """Case, digits and punctuation of a word, runs as one: "Word!!" is "Aa!!", a long run of marks two."""
    if word.isalpha():
        return _letters(word)
    if word[:-1].isalpha():
        return _letters(word[:-1]) + ("0" if word[-1].isdigit() else word[-1])
    out: list[str] = []
    for c in word:
        k = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        run = 1 if k in "Aa0" else 2
        if out[-run:] != [k] * run:
            out.append(k)
    return "".join(out)


def index_vectors(features: list[str]) -> np.ndarray:
    """Sparse ternary vectors, a row per feature."""
    v = np.zeros((len(features), DIM), dtype=np.float32)
    h = np.fromiter((xxhash.xxh64_intdigest(f, 5) for f in features), dtype=np.uint64, count=len(features))
    rows = np.arange(len(features))
    for k in range(NONZERO):
        part = h >> np.uint64(12 * k)
        v[rows, (part % np.uint64(DIM)).astype(np.int64)] += np.where(part >> np.uint64(11) & np.uint64(1), 1.0, -1.0).astype(np.float32)
    return v


class Vectors:
    """Index and context vectors of words."""

    def __init__(self, context: dict[str, np.ndarray]):
        self.context = {k: i + 1 for i, k in enumerate(context)}
        self.around = np.array([np.zeros(DIM), *context.values()], dtype=np.float32)
        self.looks: dict[tuple[str, str, str], int] = {}
        self.look_table = np.zeros((1024, DIM), dtype=np.float32)

    def _looks(self, keys: list[tuple[str, str, str]]) -> np.ndarray:
        """Of what words share: shape and ends."""
        new = [k for k in dict.fromkeys(keys) if k not in self.looks]
        if len(self.looks) + len(new) > 30_000:
            self.looks.clear()
            new = list(dict.fromkeys(keys))
        if new:
            n = len(self.looks)
            while n + len(new) > len(self.look_table):
                self.look_table = np.concatenate([self.look_table, np.zeros_like(self.look_table)])
            shapes, starts, ends = (index_vectors([c + k[i] for k in new]) for i, c in enumerate("spe"))
            self.look_table[n: n + len(new)] = 2 * shapes + starts + ends
            self.looks.update(zip(new, range(n, n + len(new))))
        return self.look_table[np.fromiter(map(self.looks.__getitem__, keys), dtype=np.int64, count=len(keys))]

    def own(self, words: list[str], kinds: list[str]) -> np.ndarray:
        low = [w.lower() for w in words]
        looks = self._looks([(k, w[:2], w[-2:]) for w, k in zip(low, kinds)])
        return index_vectors(["w" + w for w in low]) * np.float32(0.5) + looks

    def of(self, words: list[str]) -> np.ndarray:
        kinds, get = [shape(w) for w in words], self.context.get
        rows = np.fromiter((get("w" + w) or get("s" + k, 0) for w, k in zip(words, kinds)), dtype=np.int64, count=len(words))
        return np.concatenate([self.own(words, kinds), self.around[rows]], axis=1)

    @classmethod
    def learn(cls, texts: list[str]):
        plain, counts = cls({}), Counter()
        for t in texts:
            counts.update(words_of(t))
        often = {w for w, n in counts.most_common(VOCABULARY) if n > 2}
        sums: dict[str, np.ndarray] = {}
        for t in texts:
            words = words_of(t)
            if not words:
                continue
            kinds = [shape(w) for w in words]
            own = plain.own(words, kinds)
            near = np.zeros_like(own)
            near[1:] += own[:-1]
            near[:-1] += own[1:]
            for keys in (["s" + k for k in kinds], ["w" + w if w in often else "" for w in words]):
                uniq = {k: i for i, k in enumerate(dict.fromkeys(keys))}
                where = np.fromiter(map(uniq.__getitem__, keys), dtype=np.int64, count=len(keys))
                order = np.argsort(where, kind="stable")
                begin = np.searchsorted(where[order], np.arange(len(uniq)))
                for k, v in zip(uniq, np.add.reduceat(near[order], begin, axis=0)):
                    if k:
                        sums[k] = sums[k] + v if k in sums else v
        return cls({k: (v / (np.linalg.norm(v) + 1e-6) * 3.0).astype(np.float32) for k, v in sums.items()})


class Pooler:
    """Pools texts by a bounded memory of word vectors."""

    def __init__(self, vectors: Vectors):
        self.vectors, self.rows, self.table = vectors, {}, np.zeros((1024, 2 * DIM), dtype=np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        try:
            return np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in rows]
        if len(rows) + len(new) > REMEMBERED:
            rows.clear()
            new = list(dict.fromkeys(words))
        while len(rows) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[len(rows): len(rows) + len(new)] = self.vectors.of(new)
        rows.update(zip(new, range(len(rows), len(rows) + len(new))))
        return np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))

    def of(self, text: str) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(6 * DIM + 1)
        n = len(words)
        total, square, product = (np.zeros(2 * DIM) for _ in range(3))
        for at in range(0, n, CHUNK):
            ids = self.ids(words[max(0, at - 1): at + CHUNK])
            m = self.table[ids]
            body = m[1:] if at else m
            one = np.ones(len(m), dtype=np.float32)
            total += one[: len(body)] @ body
            square += one[: len(body)] @ (body * body)
            product += one[1:] @ (m[1:] * m[:-1])
        mean = total / n
        spread = np.sqrt(np.maximum(square / n - mean * mean, 0))
        return np.concatenate([mean, spread, product / max(n - 1, 1) - mean * mean, [np.log1p(n)]])


class Network:
    """Input (standardised) -> HIDDEN tanh -> logit / temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 64, rate: float = 3e-3, decay: float = 1e-3):
        rnd = np.random.default_rng(3)
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        aside = np.arange(len(x)) % 6 == 0 if len(x) >= 60 else np.zeros(len(x), dtype=bool)
        z, fit = self._in(x), np.flatnonzero(~aside)
        self.p = [rnd.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(w) for w in self.p], [np.zeros_like(w) for w in self.p], 0
        for epoch in range(epochs):
            order = rnd.permutation(fit)
            for at in range(0, len(order), batch):
                i = order[at: at + batch]
                h = np.tanh(z[i] @ self.p[0] + self.p[1])
                d = (sigmoid(h @ self.p[2] + self.p[3][0]) - y[i]) / len(i)
                dh = np.outer(d, self.p[2]) * (1 - h * h)
                grads = [z[i].T @ dh + decay * self.p[0], dh.sum(axis=0), h.T @ d + decay * self.p[2], np.array([d.sum()])]
                step += 1
                lr = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= lr * first[k] / (np.sqrt(second[k]) + 1e-8)
        self.temperature, self.shift = 1.0, 0.0
        if aside.any():
            logits, t = self._logits(z[aside]), np.geomspace(0.3, 10, 60)
            loss = [np.mean(np.logaddexp(0, logits / k) - y[aside] * logits / k) for k in t]
            self.temperature = float(t[int(np.argmin(loss))])

    def _in(self, x):
        return np.clip((x - self.mean) / self.std, -6, 6)

    def _logits(self, z):
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._logits(self._in(x)) / self.temperature + self.shift)


class Model:
    def __init__(self, vectors, network, constant=0.0):
        self.vectors, self.network, self.constant = vectors, network, constant

    @classmethod
    def train(cls, rows: list[tuple[str, int]], sizes: tuple[int, int] | None = None):
        """sizes: of the classes that rows are a sample of, each drawn by itself."""
        ys = np.array([y for _, y in rows], dtype=float)
        if len(rows) < 8 or ys.min() == ys.max():
            return cls(None, None, float(ys.mean()) if len(rows) else 1.0)
        vectors = Vectors.learn([t for t, _ in rows])
        pooler = Pooler(vectors)
        network = Network(np.array([pooler.of(t) for t, _ in rows]), ys)
        network.shift = prior_shift(ys, sizes)
        return cls(vectors, network)

    def scores(self, texts: list[str], pooler: Pooler | None) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.constant)
        return self.network.scores(np.array([pooler.of(t) for t in texts]).reshape(len(texts), -1))


def train_model(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, per_class: int = PER_CLASS,
                id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    sizes = class_sizes(labels, label_col, modulus, held_out, id_col)
    model = Model.train(sample(docs, labels, label_col, modulus, held_out, per_class, id_col, text_col), sizes)
    tidy(docs.sparkSession)
    return model


def quality(docs: DataFrame, model: Model, modulus: int = 3, held_out: int = 1, threshold: float = 0.5,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    The model (train_model) is learnt from a sample of at most per_class texts of either class, never
    from held-out rows; scoring sees the text alone. Null texts are empty; a text without words has the
    score of a pool of zeros. Equal texts have equal scores; repeated rows and ids stay rows of their own. A model without rows of both classes gives the share of good ones (1 with
    no rows at all, which keeps everything). A null id is not held out. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make_scores():
        pooler = Pooler(shared.value.vectors)
        return lambda texts: shared.value.scores(texts, pooler)

    return classified(docs, make_scores, modulus, held_out, threshold, id_col, text_col)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows that score below the threshold; columns as they were.

    Only texts go through Python; what it rejects is written as locators, and the rest is picked while the
    files are scanned. Documents are not shuffled.
    """
    import pyarrow as pa

    spots = located(docs, "quality-docs")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = spots.select(text_of(F.col("doc").getField(text_col)).alias("text"), "file", "row")

    def run(batches):
        pooler = Pooler(shared.value.vectors)
        for b in slices(batches):
            low = shared.value.scores(b.column("text").to_pylist(), pooler) < threshold
            yield b.select(["file", "row"]).filter(pa.array(low))

    return picked(spots, settle(texts.mapInArrow(run, "file string, row long"), "rejected"), inside=False).select("doc.*")
