import hashlib
import random

import numpy as np
import pytest

from siftlake.llm import fingerprints, simhash
from siftlake.llm.components import components


def brute(prints, ids, bits):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if sum(bin(a ^ b).count("1") for a, b in zip(prints[i], prints[j])) <= bits:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


def corpus(seed=1):
    rnd = random.Random(seed)
    texts = [None, "", " \t ", "one", "One two", "one two three four"]
    for _ in range(40):
        base = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 4) for _ in range(rnd.randint(30, 300))]
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 1, 4])):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy).upper())
    return texts + texts[-3:]


def test_groups_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(1000 - i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, file string, f0 int")
    got = {r.doc_id: r for r in simhash.near_groups(df).collect()}
    ids = [1000 - i for i in range(len(texts))]
    prints = [simhash.fingerprint(t or "") for t in texts]
    assert [got[i].component_id for i in ids] == brute(prints, ids, 4)
    assert [got[i].fingerprint for i in ids] == [f"{p[0]:016x}" for p in prints] and got[1000].fingerprint == "0" * 16
    assert simhash.near_groups(df.limit(0)).count() == 0
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and len({i for i in ids}) > kept.count() >= 20


def test_fingerprint_by_the_book():
    import xxhash

    text, k = "The Quick  brown\tfox jumps over the lazy dog the quick brown fox", 4
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i: i + k]), 42) for i in range(len(words) - k + 1)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == [want]


@pytest.mark.parametrize("n,spread", [(30, 2), (400, 2), (400, 40)])
def test_buckets_lose_no_link(n, spread):
    rnd = random.Random(n + spread)
    centre = rnd.getrandbits(64)
    prints = [centre]
    while len(prints) < n:
        x = rnd.choice(prints)
        for _ in range(rnd.randint(1, spread)):
            x ^= 1 << rnd.randrange(64)
        prints.append(x)
    edges = simhash.linked(np.zeros(n, dtype=np.int64), np.array(prints, dtype=np.uint64)[:, None], np.arange(n), simhash.EXACT)
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert [root(i) for i in range(n)] == brute([[p] for p in prints], list(range(n)), 4) and len(edges) < n


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    texts = ["a b c d e f g h i j k l m n o p q r s t " * 6 + f"tail{i}" for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [simhash.fingerprint(t) for t in texts]
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    assert [got[i] for i in range(120)] == brute(prints, list(range(120)), 4)


def test_a_large_group_of_copies_costs_a_pass_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    base = "a b c d e f g h i j k l m n o p q r s t " * 6
    rows = [(i, base + f"tail{i}") for i in range(400)]
    nodes = spark.createDataFrame(rows, "node long, text string")
    prints = simhash.fingerprints(nodes, simhash.EXACT)
    made = []
    tiles = simhash._in_tiles
    monkeypatch.setattr(simhash, "_in_tiles", lambda *a: made.append(tiles(*a)) or made[-1])
    edges = simhash.links(prints, simhash.EXACT).distinct().collect()
    distinct = prints.select("f0").distinct().count()
    assert edges and made[0].count() < 21 * 400  # fewer than the rows that were dealt to buckets
    assert distinct > 1


def near_corpus():
    """Texts with edits that leave Jaccard similarities of 0.5 to 0.99, some of which the 48 bits do not tell apart."""
    rnd, texts = random.Random(12), [None, "", "one two", "One  TWO", "one three"]
    for _ in range(30):
        base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(base))
        for edits in (1, 1, 7, 9, 12):
            copy = list(base)
            for i in rnd.sample(range(200), edits):
                copy[i] = f"x{rnd.randrange(5000)}"
            texts.append(" ".join(copy))
    line = "the same line comes again "
    return texts + [line * 400 + " ".join(f"{c}{i}" for i in range(60)) for c in "abc"]


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def joined(sets):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("tile", [simhash.SET_TILE, 300])
def test_near_copies_equal_brute_force_on_shingle_sets(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "SET_TILE", tile)
    texts = near_corpus()
    want = joined([shingled(t) for t in texts])
    prints = [simhash.majority([simhash.shingle_set(t or "", 5)], simhash.NEAR) for t in texts]
    assert brute(prints, list(range(len(texts))), simhash.NEAR.bits) != want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df, simhash.NEAR).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()) == sorted(set(want))


def test_recall_by_band_of_similarity(spark):
    """Pairs at 0.8 or more that end in one group, by how alike they are; pairs come from edits of 300-word texts."""
    rnd, texts = random.Random(31), []
    for _ in range(120):
        base = [f"w{rnd.randrange(20000)}" for _ in range(300)]
        copy = list(base)
        for i in rnd.sample(range(300), rnd.randint(1, 7)):
            copy[i] = f"x{rnd.randrange(20000)}"
        texts += [" ".join(base), " ".join(copy)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df, simhash.NEAR).collect()}
    found, all_ = {}, {}
    for i in range(0, len(texts), 2):
        a, b = shingled(texts[i]), shingled(texts[i + 1])
        band = int(20 * len(a & b) / len(a | b))
        if similar(a, b):
            all_[band] = all_.get(band, 0) + 1
            found[band] = found.get(band, 0) + (got[i] == got[i + 1])
        else:
            assert got[i] != got[i + 1]
    assert len(all_) >= 3 and all(found[k] >= 0.9 * n for k, n in all_.items()), (found, all_)


def test_pivots_of_a_bucket_discard_pairs_of_different_clusters():
    rnd = random.Random(5)
    centres = [[rnd.getrandbits(64), rnd.getrandbits(64)] for _ in range(6)]
    prints = np.array([[c[0] ^ (1 << rnd.randrange(64)), c[1]] for c in centres for _ in range(20)], dtype=np.uint64)
    pivots = simhash.farthest(prints, 8)
    away = np.stack([np.bitwise_count(prints ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)
    gap = np.abs(away[:, None] - away[None]).max(axis=2)
    cluster = np.arange(120) // 20
    assert (gap[cluster[:, None] != cluster[None]] > simhash.NEAR.bits).mean() > 0.9


def test_alike_links_only_similar_sets_and_loses_none():
    sets = [simhash.shingle_set(t or "", 5) for t in near_corpus()]
    edges = simhash.alike(sets, 0.8)
    assert all(similar(set(sets[a].tolist()), set(sets[b].tolist())) for a, b in edges)
    want = joined([set(s.tolist()) for s in sets])
    assert len(edges) == len(sets) - len(set(want)) and all(want[a] == want[b] for a, b in edges)


def test_tables_are_exact():
    rnd = random.Random(9)
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for (m,) in simhash.EXACT.tables())


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(45)] + [(5, 5), (1, 0)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == root(x) for x in list(up))


def test_phrases_do_not_depend_on_the_offset():
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(400))
    a, b, other = fingerprints.all_sketches([text, "some other words come first " + text, text[::-1]])
    assert fingerprints.likeness(a, b) > 0.85 and fingerprints.likeness(a, other) < 0.1
    empty = fingerprints.all_sketches(["", ""])
    assert fingerprints.likeness(empty[0], empty[1]) == 1 and fingerprints.likeness(a, empty[0]) == 0
    assert (fingerprints.read(fingerprints.shown(a)) == a).all()
    alone, batch = fingerprints.sketches([text])[0], fingerprints.sketches(["x", text, "", "aaaa"])[1]
    assert (alone == batch).all()


@pytest.mark.parametrize("parts", ["1", "5"])
def test_edits_against_the_next_document(spark, parts):
    texts = [None, "", "ab", "é漢😀xyz"] + [" ".join([w] * 3 + [w * 2] * 40) for w in ("ann", "bob", "cat", "dog")] + ["z" * 100_000]
    rows = [(i * 3, t, "q") for i, t in enumerate(texts)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string, place string")
        got = {r.doc_id: r for r in fingerprints.against_edits(df).collect()}
        assert fingerprints.against_edits(df.limit(0)).count() == 0
        one = fingerprints.against_edits(df.filter("doc_id = 6")).first()
        assert one.near_next == 1.0
        same = spark.createDataFrame([(1, "a b"), (1, "c d"), (None, "e f"), (None, "e f")], "doc_id long, text string")
        assert fingerprints.against_edits(same).count() == 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        new = t[: len(t) - cut] + nxt[:cut]
        a, b, c = fingerprints.all_sketches([t, new, nxt])
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.shown(a), fingerprints.shown(b))
        assert r.near_edited == pytest.approx(float(fingerprints.likeness(a, b))) and r.near_next == pytest.approx(float(fingerprints.likeness(a, c)))
