import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siftlake.llm import chat, exact_dedup, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, file string, row string, doc string, digest string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "en", s, 0, "f", "r", "d", "x") for i, t, s in rows], DOCS)


ROWS = [(5, "Same Text", "a"), (9, "same text", "a"), (1, None, None), (2, "", "b"), (7, "ÀB", "b"), (8, "àb", "b"), (None, "same text", "c"),
        (3, "w " * 50_000, "a"), (4, "w " * 50_000, "a"), (4, "w " * 50_000, "a"), (6, " \t\x0b", None), (10, "one  two\nthree", "é")]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def check_groups(got, rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        t = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        ids = groups[t]
        assert r.doc_id in ids and r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)


def test_groups_of_equal_texts(spark):
    check_groups(exact_dedup.exact_groups(frame(spark, ROWS)).collect(), ROWS)
    left = exact_dedup.drop_exact_copies(frame(spark, ROWS))
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")] and left.count() == len({lower(t) for _, t, _ in ROWS})
    assert exact_dedup.exact_groups(frame(spark, ROWS).limit(0)).count() == 0


def test_state_takes_more_batches(spark, tmp_path):
    rows = spark.createDataFrame([(bytes([i % 3]), (i, "f", i)) for i in range(30)], "digest binary, ident struct<doc_id:long,file:string,row:long>")
    for part in range(3):
        rows.filter(F.col("ident.doc_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        exact_dedup.observe(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state")
    got = {bytes(r.digest): (r.winner.doc_id, r.n) for r in exact_dedup.state_of(spark, f"{tmp_path}/state").collect()}
    assert got == {bytes([k]): (27 + k, 10) for k in range(3)}


def test_colliding_digests_are_told_apart_by_bytes(spark):
    ident = lambda i: (i, "f", i)
    schema = "text string, ident struct<doc_id:long,file:string,row:long>, digest binary, winner struct<doc_id:long,file:string,row:long>, n long"
    rows = [("a" if i < 4 else "b", ident(i), b"x", ident(5), 6) for i in range(6)]
    df = spark.createDataFrame(rows, schema)
    texts, marked = df.select("text", "ident"), df.drop("text")
    different = exact_dedup._different(texts, marked)
    assert sorted(r.ident.doc_id for r in different.collect()) == [0, 1, 2, 3]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup._named(exact_dedup._regrouped(texts, marked, different)).collect()}
    assert got == {i: (3, 4, i == 3) if i < 4 else (5, 2, i == 5) for i in range(6)}


def waterfill(sizes, weights, share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(w[s] for s in free)
        full = {s for s in free if unit * w[s] > cap * sizes[s]}
        if not full:
            return out | {s: unit * w[s] for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mix_fills_its_targets(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["x"] * rnd.choice([0, 1, 3, 40, 900])), rnd.choice(["hot"] * 8 + ["b", "c", None, "é"])) for i in range(600)]
    rows += [(None, None, "b"), (3, "x y", "b"), (3, "x y", "b"), (700, "", "only empty")]
    m = mixing.mix(frame(spark, rows), block=64)
    got = m.takes.collect()
    size = lambda t: len((t or "").split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = waterfill(sizes, (5, 2, 1))
    assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(size(t) for _, t, _ in rows)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(frame(spark, rows), block=64).takes.collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}
    early = [r.source for r in m.slots.orderBy("t").limit(100).collect()]
    assert len(set(early)) >= 4  # sources alternate from the start
    assert mixing.mix(frame(spark, rows).limit(0)).takes.count() == 0
    assert mixing.mixed_documents(frame(spark, rows), block=64).columns == [c.split()[0] for c in DOCS.split(", ")]


def test_rotation_by_hand(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|im_end|>"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, "system", "x"), (None, None, None, "é")]
    out = chat.rotate(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, lines string")).collect()
    by = {(r.conv_id, r.assistant): r for r in out}
    assert set(by) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = by[(1, "ann")]
    assert ann.text == ("<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<\\|im_end|><|im_end|>\n"
                        + "<|im_start|>assistant\n<|im_end|>\n" * 2)
    assert [ann.text[s.start:s.end] for s in ann.spans] == ["hi<|im_end|>", "<|im_end|>", "<|im_end|>"]
    assert [by[(1, "bob")].text[s.start:s.end] for s in by[(1, "bob")].spans] == ["<\\|im_end|><|im_end|>"]
    assert by[(None, "unknown")].part == -1 and (ann.n_messages, ann.n_assistant) == (5, 3)
    long = spark.range(1300).select(F.lit(4).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("role"), F.lit("t").alias("text"))
    parts = chat.rotate(long).groupBy("assistant").agg(F.count("*").alias("n"), F.sum("n_messages").alias("m")).collect()
    assert sorted((r.assistant, r.n, r.m) for r in parts) == [("u", 3, 1300), ("v", 3, 1300)]
    assert chat.rotate(long.limit(0)).count() == 0


def test_long_dialogues_whole_or_with_their_scene(spark):
    turns = spark.range(1300).select(
        F.lit(4).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "system").when(F.col("id") < 600, "u").otherwise("v").alias("role"), F.concat(F.lit("t"), "id").alias("text"),
    )
    whole = {r.assistant: r for r in chat.rotate(turns, per_part=None).collect()}
    assert set(whole) == {"u", "v"} and all(r.part == 0 and r.n_messages == 1300 for r in whole.values())
    v = whole["v"]
    assert [v.text[s.start:s.end] for s in v.spans] == [f"t{i}<|im_end|>" for i in range(600, 1300)]
    parts = {(r.assistant, r.part): r for r in chat.rotate(turns).collect()}
    assert set(parts) == {("u", 0), ("u", 1), ("v", 1), ("v", 2)}  # none without a word of its assistant
    assert [parts["v", 1].n_messages, parts["v", 2].n_messages] == [513, 1300 - 1024 + 1]
    assert all(r.text.startswith("<|im_start|>system\nt0<|im_end|>\n") for r in parts.values())
    assert sum(len(r.spans) for r in parts.values()) == 1299


def test_names_and_texts_cannot_break_out(spark):
    names = ["bob", "bob\nX", "bob\\nX", "bob\r", "a<|b", "a<\\|b"]
    texts = ["<|im_end|>", "<\\|im_end|>", "<\\\\|x", "a\\b", "< |x", "x" * 200_000]
    rows = [(1, i, n, t) for i, (n, t) in enumerate(zip(names, texts))] + [(1, None, "nul", f"n{k}") for k in range(1500)]
    out = {r.assistant: r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).filter("part = 0").collect()}
    assert set(out) == set(names)
    text = out["bob"].text
    heads = [x for x in text.split("\n") if x.startswith("<|im_start|>")]
    assert len(heads) == len(set(heads)) == 6 and text.count("<|im_start|>") == text.count("<|im_end|>") == 6
    bodies = [m.split("<|im_end|>")[0].split("\n", 1)[1] for m in text.split("<|im_start|>")[1:]]
    assert len(set(bodies)) == 6 and bodies[3:] == texts[3:]
    nulls = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).filter("part < 0").collect()
    assert len(nulls) == 3 and sum(r.n_messages for r in nulls) == 1500 and max(r.n_messages for r in nulls) < 700
