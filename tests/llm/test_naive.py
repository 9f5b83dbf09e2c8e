"""Operators against plain versions that follow their descriptions word by word."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftlake.llm import fingerprints, mixing, quality

M = 2**64 - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


GOLD = 0x9E3779B97F4A7C15


def toss(symbols, width):
    out = []
    for i, x in enumerate(symbols):
        left = symbols[i - 1] if i else ~x & (2**width - 1)
        low = (x ^ left) & -(x ^ left)
        out.append(2 * (low.bit_length() - 1) + int(x & low != 0))
    return out


def parsed(symbols, width):
    """The names of the phrases of one text's symbols."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    names = [mixed((s + GOLD) & M) for s, _ in runs]
    names = [mixed(n ^ mixed(k)) if k > 1 else n for n, (_, k) in zip(names, runs)]
    label = toss([s for s, _ in runs], width)
    for _ in range(2):
        label = toss(label, 8)
    cuts = [0]
    for i in range(1, len(label) - 1):
        if label[i - 1] < label[i] > label[i + 1] and i != 1:  # the first symbol's phrase has two at least
            cuts.append(i)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(runs)]):
        out.append(mixed(sum(mixed((n + k * GOLD) & M) for k, n in enumerate(names[a:b])) & M))
    return out


def naive_sketch(text):
    best, symbols, width = [None] * fingerprints.BINS, [ord(c) for c in text], 32
    for level in range(1, max(fingerprints.LEVELS) + 1):
        symbols, width = parsed(symbols, width), 64
        if level in fingerprints.LEVELS:
            for s in symbols:
                h = mixed((s + level * GOLD) & M)
                b = h % fingerprints.BINS
                best[b] = h if best[b] is None else min(best[b], h)
    return [0 if h is None else (h >> 32) & 0xFFFF | 1 for h in best]


def test_fingerprints_equal_a_naive_parser():
    rnd = random.Random(4)
    texts = ["a", "ab", "aab", "aaaa", "abcabc", "é漢😀xyz"] + ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 900))) for _ in range(60)]
    texts += ["".join(rnd.choice("ab") * rnd.randint(1, 5) for _ in range(300)), "word " * 200]
    for t, s in zip(texts, fingerprints.all_sketches(texts)):
        assert s.tolist() == naive_sketch(t), t[:40]


def test_mix_equals_a_naive_schedule(spark, tmp_path):
    rnd, block = random.Random(6), 16
    rows = [(i if i % 9 else 3, " ".join(["x"] * rnd.choice([0, 1, 5, 40, 333])), rnd.choice(["hot"] * 6 + ["b", None])) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    placed = docs.select("doc_id", "source", F.size(F.filter(F.split("text", " "), lambda x: x != "")).alias("size"), F.col("_metadata.row_index").alias("row"))
    placed = placed.withColumn("place", F.xxhash64(F.lit(0), "doc_id")).collect()
    m = mixing.mix(docs, block=block)
    goals = {(r.no_source, r.source): (r.goal, r.source_size, r.slots, r.lo, r.hi) for r in m.sources.collect()}
    total = sum(g[2] for g in goals.values())
    # The schedule, slot by slot.
    ranks, slots = Counter(), set()
    for t in range(total):
        x = (t % mixing.MODULUS * mixing.STEP % mixing.MODULUS) / mixing.MODULUS * total
        for key, (_, _, n, lo, hi) in goals.items():
            if lo <= x < hi:
                if ranks[key] < n:
                    slots.add((t, key, ranks[key]))
                ranks[key] += 1
    for key, (_, _, n, _, _) in goals.items():
        slots |= {(total, key, k) for k in range(ranks[key], n)}
    assert slots == {(r.t, (r.no_source, r.source), r["rank"]) for r in m.slots.collect()}
    # Words: block after block of each source's stream.
    want = Counter()
    for key, (goal, size, n, _, _) in goals.items():
        stream = []
        for r in sorted((r for r in placed if (r.source is None, r.source or "") == key), key=lambda r: (r.place & M, r.doc_id, r.row)):
            stream += [r.row] * r.size
        blocks = -(-size // block)
        for _, k, rank in sorted(slots):
            if k == key:
                epoch, b = divmod(rank, blocks)
                want.update(stream[b * block: min((b + 1) * block, size, goal - epoch * size)])
    assert {r.rid.row: r.taken for r in m.takes.collect()} == {r.row: want[r.row] for r in placed}
    assert sum(want.values()) == sum(g[0] for g in goals.values())


def test_mix_does_not_depend_on_the_files_and_splits_hot_ids(spark, tmp_path, monkeypatch):
    rows = [(i, "x " * (i % 50), "s") for i in range(400)] + [(7, "y y", "s")] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda d: sorted((r.doc_id, r.size, r.taken) for r in mixing.mix(d, block=16).takes.collect())
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    df.repartition(7).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / p)) for p in ("one", "many"))
    assert taken(one) == taken(many)
    monkeypatch.setattr(mixing, "REPEATS", 8)
    total = sum(t for _, _, t in taken(many))
    assert total == sum(t for _, _, t in taken(one))


def test_pools_equal_a_naive_one():
    texts = ["The the Cat!! sat", "x1 Y2 ### the cat", "sat on the MAT mat mat", "word"]
    v = quality.Vectors.learn(texts * 2)

    def index(feature):
        h, out = xxhash.xxh64_intdigest(feature, 5), np.zeros(quality.DIM)
        for k in range(quality.NONZERO):
            out[(h >> 12 * k) % quality.DIM] += 1.0 if (h >> 12 * k) >> 11 & 1 else -1.0
        return out

    def own(w):
        low = w.lower()
        return 0.5 * index("w" + low) + 2 * index("s" + quality.shape(w)) + index("p" + low[:2]) + index("e" + low[-2:])

    sums = {}
    often = Counter(w for t in texts * 2 for w in t.split())
    for t in texts * 2:
        words = t.split()
        for i, w in enumerate(words):
            near = sum((own(words[j]) for j in (i - 1, i + 1) if 0 <= j < len(words)), np.zeros(quality.DIM))
            for key in ["s" + quality.shape(w)] + (["w" + w] if often[w] > 2 else []):
                sums[key] = sums.get(key, 0) + near
    context = {k: 3 * s / (np.linalg.norm(s) + 1e-6) for k, s in sums.items()}

    def vector(w):
        return np.r_[own(w), context.get("w" + w, context.get("s" + quality.shape(w), np.zeros(quality.DIM)))]

    text = "The mat sat ### on a new MAT cat"
    m = np.array([vector(w) for w in text.split()])
    mean = m.mean(axis=0)
    want = np.r_[mean, m.std(axis=0), (m[1:] * m[:-1]).mean(axis=0) - mean * mean, np.log1p(len(m))]
    assert quality.Pooler(v).of(text) == pytest.approx(want, abs=1e-4)
