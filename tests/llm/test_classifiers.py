import random
import zlib
from collections import Counter

import numpy as np
import pytest

from siftlake.llm import quality, toxicity
from siftlake.llm.labelled import sample

RND = random.Random(6)
SYLLABLES = ["ta", "re", "mi", "son", "el", "ko", "pa", "un"]


def prose(n):
    return " ".join("".join(RND.choice(SYLLABLES) for _ in range(RND.randint(1, 4))) for _ in range(n))


def corpus(n=400):
    docs, labels = [], []
    for i in range(n):
        toxic, good = i % 5 == 0, i % 7 != 0
        words = prose(RND.randint(20, 120)).split()
        if toxic:
            for _ in range(4):
                words.insert(RND.randrange(len(words)), RND.choice(["scum", "vile"]) + RND.choice(SYLLABLES))
        if not good:
            words = [w + "!!" for w in map(str.upper, words)]
        docs.append((i, " ".join(words), "en", 3))
        labels.append((i, int(good), int(toxic)))
    return docs + [(9000, None, "en", 3), (9001, "", "en", 3), (9002, "w " * 60_000, "en", 3), (None, "x", "en", 3), (0, docs[0][1], "en", 3)], labels + [(1, 1, 0), (None, 1, 1), (2, None, None)]


def frames(spark):
    docs, labels = corpus()
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels)


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_held_out_accuracy_and_edges(spark, which):
    docs, labels, rows, truth = frames(spark)
    if which == "toxic":
        out, mod, out_at, col, at = toxicity.toxicity(docs, labels), 4, 2, 2, 0.3
    else:
        out, mod, out_at, col, at = quality.quality(docs, quality.train_model(docs, labels)), 3, 1, 1, 0.5
    got = out.collect()
    assert len(got) == len(rows)
    y = {t[0]: t[col] for t in truth if t[0] is not None and t[col] is not None}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % mod == out_at) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= at) for r in got)
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.9 and len(held) > 50


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels, _, truth = frames(spark)
    got = sample(docs, labels, "toxic", 4, 2, 1000)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert got == sample(docs, flipped, "toxic", 4, 2, 1000) and len(sample(docs, labels, "toxic", 4, 2, 10)) == 20


def test_without_labels_scores_are_defined(spark):
    docs, labels, rows, _ = frames(spark)
    none = labels.limit(0)
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    model = quality.train_model(docs, none)
    assert {r.score for r in quality.quality(docs, model).collect()} == {1.0}
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_ratio_equals_kneser_ney_by_hand():
    toxic, plain = Counter({"ab": 2, "abc": 1}), Counter({"bc": 3, "ab": 1})
    r = toxicity.Ratio(toxic, plain, order=3, discount=0.5)

    def grams(words, n):
        out = Counter()
        for w, k in words.items():
            s = "^" * (n - 1) + w + "$"
            s = s.replace("$", "^")
            for i in range(n - 1, len(s)):
                out[s[i - n + 1: i + 1]] += k
        return out

    every = set(grams(toxic, 3)) | set(grams(plain, 3))
    bi = Counter(g[1:] for g in every)
    uni = Counter(g[1:] for g in bi)
    letters = len(set("".join(list(toxic) + list(plain)))) + 2

    def p1(c):
        return (max(uni[c] - 0.5, 0) + 0.5 * len(uni) / letters) / sum(uni.values())

    def p2(g):
        total = sum(v for k, v in bi.items() if k[0] == g[0])
        kinds = sum(1 for k in bi if k[0] == g[0])
        return (max(bi[g] - 0.5, 0) + 0.5 * kinds * p1(g[1])) / total

    def p3(g, c):
        total, kinds = sum(v for k, v in c.items() if k[:2] == g[:2]), sum(1 for k in c if k[:2] == g[:2])
        return (max(c[g] - 0.5, 0) + 0.5 * kinds * p2(g[1:])) / total if total else p2(g[1:])

    ct, cp = grams(toxic, 3), grams(plain, 3)
    for w in ("ab", "abc", "bc"):
        want = sum(np.log(p3(g, ct)) - np.log(p3(g, cp)) for g in grams({w: 1}, 3).elements()) / (len(w) + 1)
        assert r.scores([w])[0] == pytest.approx(want)


def test_word_ratios_by_hand():
    """Words and pairs of words by a naive Kneser-Ney model with shared continuation counts, and the text's number."""
    rnd = random.Random(8)
    rows = []
    for i in range(60):
        words = [rnd.choice(["the", "of", "sun", "moon", "tide"]) for _ in range(30)]
        if i % 3 == 0:
            words[4:6] = ["go", "away"]
            words.append("vile")
        elif i % 3 == 1:
            words[9:12] = ["go", "far", "away"]
        rows.append((" ".join(words), int(i % 3 == 0)))
    rows += [rows[0]] * 20  # copies change nothing
    model, d = toxicity.Words(rows, contexts=2), toxicity.DISCOUNT
    texts = [[["", "", *t.split()] for t, y in rows if y == k] for k in (0, 1)]
    counts = [Counter(w for _, w in {(a, w) for t in ts for a, w in zip(t[1:], t[2:])}) for ts in texts]
    pairs = [Counter(p[1:] for p in {p for t in ts for p in zip(t[1:], t[2:], t[3:])} | {("", *t[2:4]) for t in ts}) for ts in texts]
    kinds = Counter(w for c in counts for w in c)
    size = len(kinds) + 1  # with the empty word before a text

    def word(w, k):
        n = sum(counts[k].values())
        shared = (max(kinds[w] - d, 0) + d * size / (size + 1)) / sum(kinds.values())
        return max(counts[k][w] - d, 0) / n + d * len(counts[k]) / n * shared

    def pair(a, b, k):
        often = {p: n for p, n in pairs[k].items() if n > 2}
        total = sum(n for (x, _), n in pairs[k].items() if x == a)
        held = sum(n - d for (x, _), n in often.items() if x == a)
        return (max(often.get((a, b), 0) - d, 0) + (total - held) * word(b, k)) / total if total else word(b, k)

    shown = {p for c in pairs for p, n in c.items() if n > 2}
    text = ["the", "go", "away", "sun", "go", "far", "vile"]
    want = [np.log(word("the", 1) / word("the", 0))]
    for a, b in zip(text, text[1:]):
        p = [pair(a, b, k) if (a, b) in shown else word(b, k) for k in (0, 1)]
        want.append(np.log(p[1] / p[0]))
    scorer = toxicity.Scorer(model)
    assert scorer.ratios(text) == pytest.approx(want)
    assert want[2] > 1 > 0 > want[5] and want[6] > 0.5  # "go away" is a toxic phrase of ordinary words
    mixture = sum(np.log(1 - toxicity.SHARE + toxicity.SHARE * np.exp(min(x, 12))) for x in want) / len(text) ** 0.5
    assert scorer.of(" ".join(text)) == pytest.approx(np.arcsinh(toxicity.SCALE * mixture))
    rare = scorer.ratios(["vilest"])[0]
    assert rare == pytest.approx(toxicity.SPELLING * 7 * model.spelling.scores(["vilest"])[0])


def test_long_runs_count_as_a_whole():
    from siftlake.llm.labelled import LONG, words_of

    run = "".join(chr(0x4E00 + i % 3000) for i in range(400))
    parts = words_of("a " + run + " b")
    covered = parts[1]
    for p in parts[2:-1]:
        covered += p[next(k for k in range(len(p), -1, -1) if covered.endswith(p[:k])):]
    assert parts[0] == "a" and parts[-1] == "b" and covered == run and max(map(len, parts)) <= LONG
    assert words_of("x" * LONG) == ["x" * LONG] and words_of(" ") == []
    assert quality.shape("!" * 20 + "ab" * 9) != quality.shape("!" * 20 + "ab" * 9 + "9") and len(quality.shape("a1" * 20)) == 40


def test_sample_is_bounded_in_characters(spark):
    docs, labels, _, _ = frames(spark)
    got = sample(docs, labels, "toxic", 4, 2, 1000, chars=20_000)
    assert 10_000 < sum(len(t) for t, _ in got) <= 20_000 and {y for _, y in got} == {0, 1}


def test_temperature_and_pooling():
    v = quality.Vectors.learn([prose(200) for _ in range(5)])
    p = quality.Pooler(v)
    long = prose(9000)
    whole = p.of(long)
    small, quality.CHUNK = quality.CHUNK, 500
    try:
        assert np.allclose(whole, quality.Pooler(v).of(long), atol=1e-3)
    finally:
        quality.CHUNK = small
    assert not p.of("").any() and p.of("same " * 50)[2 * quality.DIM: 4 * quality.DIM].max() < 1e-2
