"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables and clashing column names, for every operator and the pipeline."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftlake.llm import chat, common, exact_dedup, fingerprints, mixing, packing, quality, queries, simhash, token_counts, toxicity, warc

CLASHES = "_metadata int, file string, row long, doc string, cell long, bits string, pos int, place string, spot int, words int, source_size string, kept string, item int, b0 string, f0 string"
EXTRA = (1, "f", 2, "d", 3, "b", 4, "p", 5, 6, "s", "k", 7, "b", "f")
LONG = "very long text of many words " * 20_000
ROWS = [
    (1, "one two three four five six", "en", "a", 5), (1, "one two three four five six", "en", "a", 5), (1, "another text under the same id", "en", "b", 5), (2, None, "en", None, None),
    (3, "", None, "a", 0), (None, "no id here", "en", "a", 1), (None, None, None, None, None), (4, "ONE two THREE four five SIX", "en", "é", 5), (5, LONG, "en", "a", 9), (6, " \t\n ", "en", "", 3), (7, "漢" * 3000, "zh", "b", 1),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars int, " + CLASHES


@pytest.fixture(scope="module", params=["files", "memory"])
def docs(spark, request, tmp_path_factory):
    df = spark.createDataFrame([(*r, *EXTRA) for r in ROWS], DOCS).repartition(3)
    if request.param == "files":
        path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
        df.write.parquet(path)
        df = spark.read.parquet(path)
    return df


def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(1, 8)] + [(None, 1, 1), (3, None, None), (3, 0, 1), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda s, d: warc.archive_round_trip(d.withColumnRenamed("text", "html").withColumnRenamed("lang", "url"), id_col="doc_id"),
    "op2": lambda s, d: mixing.mix(d).takes,
    "op3": lambda s, d: exact_dedup.exact_groups(d),
    "op4": lambda s, d: token_counts.token_counts(d),
    "op6": lambda s, d: toxicity.toxicity(d, labels(s)),
    "op7": lambda s, d: quality.quality(d, quality.train_model(d, labels(s))),
    "op9": lambda s, d: fingerprints.against_edits(d),
    "op9 alone": lambda s, d: fingerprints.fingerprint(d),
    "op10": lambda s, d: simhash.near_groups(d),
    "op10 sets": lambda s, d: simhash.near_groups(d, simhash.NEAR),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, docs, name):
    out = OPERATORS[name](spark, docs)
    assert out.count() == len(ROWS)
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_defined_values(spark, docs):
    groups = exact_dedup.exact_groups(docs).collect()
    six = [r for r in groups if r.keep_id == 4]
    assert [r.group_size for r in six] == [3, 3, 3] and [r.doc_id for r in six if r.kept] == [4] and len({r.text_sha256 for r in groups}) == 7
    empty = [r for r in groups if r.text_sha256.startswith("e3b0c442")]
    assert len(empty) == 3 and {r.keep_id for r in empty} == {3}
    takes = mixing.mix(docs).takes.collect()
    assert sum(r.taken for r in takes if r.size == 0) == 0 and all(r.taken <= 2 * r.size for r in takes)
    assert {r.n_tokens for r in token_counts.token_counts(docs).filter("doc_id = 3 OR doc_id = 2").collect()} == {0}
    pieces = packing.pack(docs, keep_ids=True).collect()
    assert sum(r.start == 0 for r in pieces) == len(ROWS) and all(zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)
    assert packing.pack(docs.limit(0)).count() == 0
    prints = fingerprints.fingerprint(docs).collect()
    assert len({r.fingerprint for r in prints if r.n_chars == 0}) == 1 and len({r.fingerprint for r in prints if r.doc_id == 1}) == 2
    near = simhash.near_groups(docs).collect()
    assert len({r.component_id for r in near if r.fingerprint == "0" * 16}) == 1
    for scored in (OPERATORS["op6"](spark, docs).collect(), OPERATORS["op7"](spark, docs).collect()):
        assert all(0 <= r.score <= 1 for r in scored) and not any(r.held_out for r in scored if r.doc_id is None)


def test_droppers_keep_columns_and_rows(spark, docs):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    apart = simhash.drop_near_copies(docs)
    assert apart.columns == docs.columns and apart.count() == 6
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.filter("text IS NULL OR text = ''").count() == 0
    assert quality.keep_good(docs, quality.train_model(docs, labels(spark))).columns == docs.columns


@pytest.mark.parametrize("cells", [1, 8192])
def test_picked_rows_are_those_wanted(spark, tmp_path, cells):
    spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("_metadata")).coalesce(2).write.parquet(str(tmp_path / "p"))
    spots = common.located(spark.read.parquet(str(tmp_path / "p")), "x")
    wanted = spots.filter("doc.doc_id % 5 = 0 OR doc.doc_id < 40000").select("file", "row")
    inside = common.picked(spots, wanted, True, cells)
    assert inside.count() == 40_000 + 12_000 and inside.filter("doc.doc_id % 5 <> 0 AND doc.doc_id >= 40000").count() == 0
    assert common.picked(spots, wanted, False, cells).count() == 48_000
    assert common.picked(spots, wanted.limit(0), True, cells).count() == 0 and common.picked(spots, wanted.limit(0), False, cells).count() == 100_000


def test_ids_of_pages_come_back_as_they_were(spark):
    ids = [" a ", "a", "b\tc", "b c", "x\r\ny", "%41", "A", "é😀", ""]
    df = spark.createDataFrame([(i, "http://u\r\nX: 1", "same") for i in ids] + [("z", "u", "other"), ("z", "u", "other")], "page_id string, url string, html string")
    back = warc.archive_round_trip(df).collect()
    top = max(ids, key=lambda s: s.encode())
    assert sorted(r.page_id for r in back) == sorted([*ids, "z", "z"])
    assert {r.refers_to for r in back if r.record_type == "revisit" and r.page_id != "z"} == {top} and [r.record_type for r in back if r.page_id == "z"].count("revisit") == 1


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_over_odd_tables(spark, tmp_path, empty):
    df = spark.createDataFrame([(*r, *EXTRA) for r in ROWS], DOCS)
    (df.limit(0) if empty else df).write.parquet(str(tmp_path / "documents.parquet"))
    (labels(spark).limit(0) if empty else labels(spark)).write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(pieces) == 0) == empty
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


def test_one_dialogue_without_an_id(spark):
    turns = spark.createDataFrame([(None, None, None, None), (None, 1, "a", "x" * 100_000), (1, 1, "a", ""), (1, 1, "a", ""), (1, 1, "", "t")], "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.assistant, r.part): (r.n_messages, r.n_assistant) for r in chat.rotate(turns).collect()}
    assert got == {(None, "unknown", -1): (1, 1), (None, "a", 0): (1, 1), (1, "a", 0): (3, 2), (1, "unknown", 0): (3, 1)}
    assert chat.rotate(turns.limit(0)).count() == 0


def test_chat_equals_its_sql_beside_null_turns(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    talk = [(1, i, "system" if i % 600 == 7 else "ab"[i % 2], f"t{i}") for i in range(-700, 1300)]
    rows = [*talk, (1, None, "system", "aside"), (1, None, "a", "late"), (2, None, "system", "alone"), (2, 0, "a", "x"), (2, 600, "a", "y"), (2, None, "b", "z"),
            (3, 5, "system", "scene"), (3, 5, "a", "x"), (3, 600, "b", "y"), (3, None, "system", "aside"), (None, None, "c", "w"), (None, -1, "c", "v")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL["op8_chat"]).fetchall()
    got = [tuple(r) for r in queries.op8_chat(spark, str(tmp_path)).collect()]
    assert set(want) <= set(got) and len(got) == len(set(got))
    # What the SQL drops is parts of its own, below all others; they open with a scene too.
    beside = {(r[0], r[1], r[2]): r[5] for r in set(got) - set(want)}
    assert set(beside) == {(1, "a", -3), (2, "b", -1), (None, "c", -2)}
    assert beside[1, "a", -3].startswith("<|im_start|>system\nt-593<|im_end|>\n") and "\nlate<|im_end|>" in beside[1, "a", -3]
