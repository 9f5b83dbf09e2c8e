import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from siftlake.llm import packing, token_counts
from siftlake.llm.tokens import Encoder, default_vocabulary

TEXTS = ["", None, "Hello  world's <|endoftext|>end", "  \n\n\t x", "é漢字😀²½ \x1c", "a" * 5000, "word " * 3000, "same", "same", "!?!? 12345 <|endoftext|><|endoftext|>", "\u0000"]


def frame(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string")


def truth(text):
    return Tokenizer.from_file(default_vocabulary()).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    enc, rnd = Encoder(default_vocabulary()), random.Random(4)
    pool = list("ab Z'sl\t\n\r\x0b\x1c\x85 　²½٣漢é😀_-!0") + ["<|endoftext|>", "'ll", "'S", "  "]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    for t, e in zip(texts, enc.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert enc.ids(t) == enc.pack(e.ids), ascii(t)


def test_every_code_point_in_several_contexts():
    enc, rnd = Encoder(default_vocabulary()), random.Random(2)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    contexts = ["x {0}{0}'s!", "{0}'s", " {0}1a{0} ", "\t{0}\n {0}", "9{0} \u3000{0}.", "{0}"]
    rnd.shuffle(points)
    texts = ["a" + "|".join(rnd.choice(contexts).format(c) for c in points[i: i + 12]) for i in range(0, len(points), 12)]
    texts += [c.format(x) for c in contexts for x in "\u0558\u0c5c\u0cdc\U00010940\U00011db0\U000187f8\U000323b0\U0003d000"]
    wrong = [t for t, e in zip(texts, enc.tokenizer.encode_batch(texts, add_special_tokens=False)) if enc.ids(t) != enc.pack(e.ids)]
    assert not wrong and enc.odd is not None
    assert len(enc.ids("x \u0558\u0558's!")) == 4 * 9 and len(enc.ids("\u0c5c's")) == 4 * 5


def test_both_ways_to_merge_come_to_the_same():
    enc, rnd = Encoder(default_vocabulary()), random.Random(7)
    assert enc.merge is not None
    pool = ["a", "b", "th", "ing", "é", "漢", "😀", "0", "9", "!", " ", "\u0558", "qz", "ation", "\n", "İ", "ﬁ"]
    pieces = ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 24))) for _ in range(30_000)]
    fast = [enc.piece(p) for p in pieces]
    enc.merge = None
    assert fast == [enc.piece(p) for p in pieces]


def test_other_files_go_through_the_library(tmp_path):
    import json

    import public_tokenizers
    import sentencepiece

    steps = json.load(open(default_vocabulary()))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
                   {"truncation": {"direction": "Right", "max_length": 4, "strategy": "LongestFirst", "stride": 0}},
                   {"added_tokens": [{**steps["added_tokens"][0], "lstrip": True}]}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps({**steps, **change}))
        library, enc = Tokenizer.from_file(str(path)), Encoder(str(path))
        library.no_truncation()
        assert enc.easy == ("truncation" in change)
        for t in ["One TWO  <|endoftext|> three four five", "", "A"]:
            assert enc.ids(t) == enc.pack(library.encode(t, add_special_tokens=False).ids)
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert Encoder(path).ids("Hello wörld") == Encoder.pack(sentencepiece.SentencePieceProcessor(model_file=path).encode("Hello wörld"))


def test_tier_one_is_drawn_from_all_rows(spark, tmp_path):
    rows = [(i, ("early " if i < 3000 else "late ") * 30 if i % 10 else "x" * 50_000 + " longtext") for i in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(3).write.parquet(str(tmp_path / "sorted"))
    table = token_counts.frequent_lengths(spark.read.parquet(str(tmp_path / "sorted")), "text", default_vocabulary())
    assert {" early", " late", " longtext"} <= set(table) and table[" late"] == 1
    assert token_counts.frequent_lengths(spark.createDataFrame([], "doc_id long, text string"), "text", default_vocabulary()) == {}


def test_counts_with_odd_code_points_and_clashing_columns(spark):
    texts = ["x \u0558\u0558's!", "\u0c5c's", "\u0558 <|endoftext|> \u0558", "plain", None]
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in enumerate(texts)], "doc_id long, text string, _metadata int, file string")
    assert [r.n_tokens for r in token_counts.token_counts(df).orderBy("doc_id").collect()] == [len(truth(t)) for t in texts]
    got = {r.doc_id: r.doc_tokens for r in packing.pack(df).collect()}
    assert got == {i: len(truth(t)) + 1 for i, t in enumerate(texts)}


def test_repeated_ids_are_packed_as_documents_of_their_own(spark):
    df = spark.createDataFrame([(1, "one two three")] * 5 + [(1, "other words")], "doc_id long, text string").repartition(2)
    pieces = packing.pack(df, keep_ids=True).collect()
    whole = sum(5 * [len(truth("one two three")) + 1], len(truth("other words")) + 1)
    assert sum(r.length for r in pieces) == whole
    assert sum(r.start == 0 for r in pieces) == 6


def test_counts(spark):
    got = sorted(token_counts.token_counts(frame(spark, TEXTS)).collect(), key=str)
    want = sorted(((i if i != 3 else None, len((t or "").encode()), len(truth(t)), len(truth(t)) > 1024) for i, t in enumerate(TEXTS)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert token_counts.token_counts(frame(spark, TEXTS).limit(0)).count() == 0


def test_a_full_memory_changes_no_count(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 8)
    counts = token_counts.Counts(default_vocabulary(), {"same": 1})
    for t in TEXTS:
        assert counts.count(t or "") == len(truth(t))


def test_pieces_tile_documents_and_sequences(spark):
    rnd = random.Random(1)
    texts = TEXTS + [" ".join(rnd.choice(["alpha", "beta", "gamma."]) for _ in range(rnd.choice([1, 5, 200, 1500]))) for _ in range(200)]
    df = frame(spark, texts).filter("doc_id IS NOT NULL").repartition(3)
    pieces = packing.pack(df, keep_ids=True).toPandas()
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        ids = np.array([*truth(texts[int(i)]), 0], dtype="<u4")
        assert b"".join(g.ids) == ids.tobytes() and (g.doc_tokens == len(ids)).all()
        assert (g.start == g.length.cumsum() - g.length).all()
        assert all(zlib.crc32(x) == c for x, c in zip(g.ids, g.ids_crc32))
    assert set(pieces.doc_id) == {i for i in range(len(texts)) if i != 3}
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        n = int(g.length.sum())
        assert (g.offset == g.length.cumsum() - g.length).all() and n <= 1024 and n & (n - 1) == 0
    assert packing.pack(df.limit(0)).count() == 0
    nulls = packing.pack(frame(spark, TEXTS).filter("doc_id IS NULL"))
    assert nulls.agg({"length": "sum"}).first()[0] == len(truth(TEXTS[3])) + 1
