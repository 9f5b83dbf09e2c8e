"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary texts have a model each. The upper levels count by class: words, and pairs of words that are
frequent enough. They count as Kneser-Ney models do below the highest order, by the number of different words
that stand before, so that a passage which many texts share, or a text with many copies, counts once. Their backoff is shared: the Kneser-Ney continuation counts of both classes together, so
a rare expression is smoothed by what either class knows, and what neither has seen tells nothing but the
classes' backoff weights. A word that neither class has seen is judged by its spelling: character models of
the classes, again with shared lower orders, give its log-likelihood ratio, which counts at a weight.

A toxic text is an ordinary one but for a small share of its words. Its log-likelihood ratio is therefore that
of the mixture, log(1 - share + share * ratio) summed over the words, normalised by the root of their number,
so that chance in long texts weighs no more than in short ones. One rising curve of that number, fitted on
texts that the counts have not seen, is the score. Order, discount, share, weight, cut-offs and the curve were
chosen by folds within the rows whose labels may be learnt.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, slices, text_of, tidy
from .labelled import class_sizes, logistic, prior_shift, sample, sigmoid, words_of

#: Labelled texts of each class that come to the driver at most; n-gram order; discount.
PER_CLASS, ORDER, DISCOUNT = 4000, 6, 0.75
#: Words whose scores a worker remembers. A pair of words counts as one expression beyond so many words before it.
REMEMBERED, CONTEXTS = 300_000, 8
#: Share of toxic words in a toxic text, weight of an unseen word's spelling, bounds of a ratio.
SHARE, SPELLING, LOWEST, HIGHEST = 0.003, 0.25, -30.0, 12.0
#: Words that a known word follows at least, the part of the rows that calibrates, steepness of the curve.
LEAST, ASIDE, SCALE = 2, 3, 10.0
#: Bits of a letter in an n-gram's key; rarer letters are one.
BITS = 9
UNKNOWN, EDGE = 1, 2


def lower_words(text: str) -> list[str]:
    return words_of(text.lower())


class Alphabet:
    def __init__(self, counts: Counter):
        self.ids = {c: i + 3 for i, (c, _) in enumerate(counts.most_common((1 << BITS) - 4))}

    def grams(self, words: list[str], order: int):
        """(keys of all n-grams, number of n-grams of each word); a word ends with an edge."""
        ids, sizes = self.ids, np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        pad = order - 1
        flat = np.full(int(sizes.sum()) + pad * len(words), EDGE, dtype=np.uint64)
        ends = np.cumsum(sizes + pad)
        chars = np.fromiter((ids.get(c, UNKNOWN) for w in words for c in w), dtype=np.uint64, count=int(sizes.sum()) - len(words))
        inside = np.ones(len(flat), dtype=bool)
        begin = ends - sizes - pad
        for k in range(pad):
            inside[begin + k] = False
        last = inside.copy()
        inside[ends - 1] = False
        flat[inside] = chars
        keys = np.zeros(len(flat), dtype=np.uint64)
        for k in range(order):
            keys[k:] |= flat[: len(flat) - k] << np.uint64(BITS * k)
        return keys[last], sizes


class Ratio:
    """Log-likelihood ratios of words: toxic over ordinary."""

    def __init__(self, toxic: Counter, ordinary: Counter, order: int = ORDER, discount: float = DISCOUNT):
        letters = Counter()
        for words in (toxic, ordinary):
            for w, n in words.items():
                for c in w:
                    letters[c] += n
        self.alphabet, self.order = Alphabet(letters), order
        seen = [self._counted(c) for c in (toxic, ordinary)]
        every = np.unique(np.concatenate([k for k, _ in seen]))
        shared = self._shared(every, len(letters) + 2, discount)
        one, self.keys = np.uint64(BITS), every
        contexts, which = np.unique(every >> one, return_inverse=True)
        self.contexts, logs, backs = contexts, [], []
        for keys, n in seen:
            c = np.zeros(len(every))
            c[np.searchsorted(every, keys)] = n
            total = np.bincount(which, c, len(contexts))
            kinds = np.bincount(which, c > 0, len(contexts))
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
            own = np.where(total[which] > 0, np.maximum(c - discount, 0) / np.maximum(total[which], 1e-9), 0.0)
            logs.append(np.log(own + back[which] * shared))
            backs.append(np.log(back))
        self.gram_ratio, self.context_ratio = logs[0] - logs[1], backs[0] - backs[1]

    def _counted(self, words: Counter):
        items = list(words)
        keys, sizes = self.alphabet.grams(items, self.order)
        weight = np.repeat(np.array([words[w] for w in items], dtype=np.float64), sizes)
        uniq, where = np.unique(keys, return_inverse=True)
        return uniq, np.bincount(where, weight, len(uniq))

    def _shared(self, grams: np.ndarray, letters: int, discount: float) -> np.ndarray:
        """Of each n-gram, the probability of its last letter after its context less the farthest letter."""
        one = np.uint64(BITS)
        low = grams & np.uint64((1 << (BITS * (self.order - 1))) - 1)
        uniq, where, kinds = np.unique(low, return_inverse=True, return_counts=True)
        if self.order == 2:
            return ((np.maximum(kinds - discount, 0) + discount * len(uniq) / letters) / kinds.sum())[where]
        lower = object.__new__(Ratio)
        lower.order = self.order - 1
        below = lower._shared(uniq, letters, discount)
        _, ctx = np.unique(uniq >> one, return_inverse=True)
        total, types = np.bincount(ctx, kinds), np.bincount(ctx)
        return ((np.maximum(kinds - discount, 0) + discount * types[ctx] * below) / total[ctx])[where]

    def scores(self, words: list[str]) -> np.ndarray:
        """Length-normalised ratio of each word."""
        keys, sizes = self.alphabet.grams(words, self.order)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        ctx = keys >> np.uint64(BITS)
        cat = np.minimum(np.searchsorted(self.contexts, ctx), len(self.contexts) - 1)
        known = self.contexts[cat] == ctx
        value = np.where(hit, self.gram_ratio[at], np.where(known, self.context_ratio[cat], 0.0))
        return np.add.reduceat(value, np.cumsum(sizes) - sizes) / sizes


def _continued(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of words that follow one another, number of different words before each)."""
    pair = np.concatenate([np.zeros(0, np.uint64), *[x[1:-1] << np.uint64(32) | x[2:] for x in streams]])
    before = np.concatenate([np.zeros(0, np.uint64), *[x[:-2] for x in streams]])
    held = pair >= np.uint64(1 << 32)  # the first word of a text follows none
    pair, before = pair[held], before[held]
    order = np.lexsort((before, pair))
    pair, before = pair[order], before[order]
    new = np.ones(len(pair), dtype=bool)
    new[1:] = (pair[1:] != pair[:-1]) | (before[1:] != before[:-1])
    return np.unique(pair[new], return_counts=True)


class Words:
    """Log-likelihood ratios of words and of pairs of words: toxic over ordinary."""

    def __init__(self, rows: list[tuple[str, int]], discount: float = DISCOUNT, contexts: int = CONTEXTS, order: int = ORDER):
        counts, streams, ids = (Counter(), Counter()), ([], []), {"": 0}  # the empty word stands before a text
        for text, y in rows:
            words = lower_words(text)
            counts[y].update(set(words))
            streams[y].append(np.fromiter((ids.setdefault(w, len(ids)) for w in ("", "", *words)), dtype=np.uint64, count=len(words) + 2))
        vocabulary = list(ids)
        pairs = [_continued(s) for s in streams]
        c = [np.bincount((np.unique(np.concatenate([np.zeros(0, np.uint64), *[x[1:-1] << np.uint64(32) | x[2:] for x in s]])) & np.uint64(0xFFFFFFFF)).astype(np.int64),
                         minlength=len(ids)).astype(np.float64) for s in streams]
        self.spelling = Ratio(counts[1], counts[0], order, discount)
        total = [max(x.sum(), 1.0) for x in c]
        kinds = (c[0] > 0).astype(float) + (c[1] > 0)
        size = len(ids)
        shared = (np.maximum(kinds - discount, 0) + discount * size / (size + 1)) / max(kinds.sum(), 1.0)
        p = [np.maximum(x - discount, 0) / n + discount * (x > 0).sum() / n * shared for x, n in zip(c, total)]
        ratio = np.log(np.maximum(p[1], 1e-300)) - np.log(np.maximum(p[0], 1e-300))
        self.known = {w: r for w, r, n in zip(vocabulary, ratio.tolist(), (c[0] + c[1]).tolist()) if n >= LEAST}
        self._pair(pairs, p, vocabulary, discount, contexts)

    def _pair(self, found, p, vocabulary, discount, contexts) -> None:
        often = [(k[n > contexts], n[n > contexts].astype(float)) for k, n in found]
        every = np.unique(np.concatenate([k for k, _ in often]))
        first, second = (every >> np.uint64(32)).astype(np.int64), (every & np.uint64(0xFFFFFFFF)).astype(np.int64)
        logs = []
        for (keys, n), (some, m), own in zip(found, often, p):
            of = np.bincount((keys >> np.uint64(32)).astype(np.int64), n, len(vocabulary))  # of each first word
            held = np.bincount((some >> np.uint64(32)).astype(np.int64), m - discount, len(vocabulary))
            c = np.zeros(len(every))
            c[np.searchsorted(every, some)] = m - discount
            there = np.maximum(of[first], 1e-9)
            p2 = np.where(of[first] > 0, c / there + (1 - held[first] / there) * own[second], own[second])
            logs.append(np.log(np.maximum(p2, 1e-300)))
        part = np.unique(np.r_[first, second])
        self.members = {vocabulary[i]: k for k, i in enumerate(part.tolist())}
        self.pairs = np.searchsorted(part, first) << 32 | np.searchsorted(part, second)
        self.pair_ratio = logs[1] - logs[0]

    def scores(self, words: list[str]) -> list[float]:
        """Log-likelihood ratio of each word by itself."""
        out = [self.known.get(w) for w in words]
        new = [i for i, r in enumerate(out) if r is None]
        if new:
            rare = [words[i] for i in new]
            sizes = np.fromiter(map(len, rare), dtype=np.float64, count=len(rare)) + 1
            for i, r in zip(new, (SPELLING * self.spelling.scores(rare) * sizes).tolist()):
                out[i] = r
        return out


class Scorer:
    """A text's number, by a bounded memory of words."""

    def __init__(self, words: Words):
        self.words, self.seen = words, {}

    def ratios(self, words: list[str]) -> np.ndarray:
        get = self.seen.__getitem__
        try:
            r = np.fromiter(map(get, words), dtype=np.float64, count=len(words))
        except KeyError:
            new = [w for w in set(words) if w not in self.seen]
            if len(self.seen) + len(new) > REMEMBERED:
                self.seen.clear()
                new = list(set(words))
            self.seen.update(zip(new, self.words.scores(new)))
            r = np.fromiter(map(get, words), dtype=np.float64, count=len(words))
        if len(self.words.pairs) and len(words) > 1:
            member = self.words.members.get
            at = np.fromiter((member(w, -1) for w in words), dtype=np.int64, count=len(words))
            keys = np.where((at[:-1] >= 0) & (at[1:] >= 0), at[:-1] << 32 | at[1:], -1)
            spot = np.minimum(np.searchsorted(self.words.pairs, keys), len(self.words.pairs) - 1)
            r[1:] = np.where(self.words.pairs[spot] == keys, self.words.pair_ratio[spot], r[1:])
        return r

    def of(self, text: str) -> float:
        words = lower_words(text)
        if not words:
            return 0.0
        r = np.clip(self.ratios(words), LOWEST, HIGHEST)
        return float(np.arcsinh(SCALE * np.log1p(SHARE * np.expm1(r)).sum() / np.sqrt(len(words))))


class Model:
    """Counts, calibration and scores; train() needs rows of both classes, else scores are a constant."""

    def __init__(self, words, weights, constant=0.0):
        self.words, self.weights, self.constant = words, weights, constant

    @classmethod
    def train(cls, rows: list[tuple[str, int]], sizes: tuple[int, int] | None = None):
        """sizes: of the classes that rows are a sample of, each drawn by itself."""
        ys = np.array([y for _, y in rows], dtype=float)
        if len(rows) < 8 or ys.min() == ys.max():
            return cls(None, None, float(ys.mean()) if len(rows) else 0.0)
        aside = rows[::ASIDE]  # calibrates counts that have not seen it
        scorer = Scorer(Words([r for i, r in enumerate(rows) if i % ASIDE]))
        y = ys[::ASIDE]
        if y.min() == y.max():  # too few of a class
            aside, y, scorer = rows, ys, Scorer(Words(rows))
        weights = logistic(np.array([[scorer.of(t)] for t, _ in aside]), y)
        del scorer
        weights[-1] += prior_shift(ys, sizes)
        return cls(Words(rows), weights)

    def scores(self, texts: list[str], scorer: Scorer | None) -> np.ndarray:
        if self.words is None:
            return np.full(len(texts), self.constant)
        x = np.array([scorer.of(t) for t in texts], dtype=np.float64)
        return sigmoid(x * self.weights[0] + self.weights[1])


def classified(docs: DataFrame, make_scores, modulus: int, held_out: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; make_scores() gives a worker's function of texts."""
    ident = column(docs, id_col)
    out = F.coalesce(F.crc32(ident.cast("string")) % modulus == held_out, F.lit(False))
    narrow = docs.select(ident.alias("doc_id"), out.alias("held_out"), text_of(column(docs, text_col)).alias("text"))
    schema = T.StructType([
        narrow.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
    ])

    def run(batches):
        scores = make_scores()
        for b in slices(batches):
            s = scores(b.column("text").to_pylist()) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())],
                names=schema.fieldNames(),
            )

    return narrow.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.3, per_class: int = PER_CLASS,
             id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """A row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Labels are learnt from a sample of at most per_class texts of either class (see labelled.sample),
    never from held-out rows, and score() sees the text alone. Null texts are empty; a text without
    words has the score of a ratio of one. A run of more than 40 characters without white space counts as
    overlapping pieces that cover it. Equal texts have equal scores; repeated rows and ids stay rows of
    their own. Without rows of both classes to learn from, every score is the share of toxic ones among
    them (0 with none). A null id is not held out. Other columns are not read. No shuffle.
    """
    sc = docs.sparkSession.sparkContext
    sizes = class_sizes(labels, label_col, modulus, held_out, id_col)
    model = sc.broadcast(Model.train(sample(docs, labels, label_col, modulus, held_out, per_class, id_col, text_col), sizes))
    tidy(docs.sparkSession)

    def make_scores():
        scorer = Scorer(model.value.words)
        return lambda texts: model.value.scores(texts, scorer)

    return classified(docs, make_scores, modulus, held_out, threshold, id_col, text_col)
