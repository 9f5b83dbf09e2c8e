import random
from collections import defaultdict

import pytest

from siftlake.llm import warc

MAGIC = "WARC/1.0\r\n"


def truth(rows, least=0):
    groups, out = defaultdict(list), {}
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    for p, ids in groups.items():
        m = max(ids)
        for i in ids:
            first = i == m or len(p) < least
            out[i] = (len(p), warc.base32_sha1(p), "response" if first else "revisit", None if first else m)
    return out


def rows():
    rnd = random.Random(3)
    fake = warc.record("response", "<x>", "http://f", 99, b"hello", "D", None, "d").decode()
    bits = ["a" * 250, MAGIC, fake + "\r\n", fake, "\r\n\r\n", "é", "WARC/1.", "Content-Length: 3\r\n\r\n", MAGIC + "Content-Length: 3\r\n\r\nabc\r\n\r\n" + MAGIC]
    out = [(i, f"http://u/{i}\r\nX: y" if i % 5 else None, rnd.choice([None, "", "same", "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 5)))])) for i in range(120)]
    return out + [(500, "u", "x" * 300_000)]


@pytest.mark.parametrize("split", ["128m", "20000"])
def test_round_trip_with_magic_in_payloads(spark, split):
    data = rows()
    df = spark.createDataFrame([(*r, 1, "z") for r in data], "page_id long, url string, html string, size int, file string").repartition(2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == truth(data)


def test_small_payloads_and_empty_tables(spark):
    data = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbbb"), (4, "u", "bbbbb"), (None, "u", "c")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive_round_trip(df, min_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response", None: "response"}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_what_follows_a_broken_record_is_not_read(spark, tmp_path):
    good = [warc.record("response", f"<{i}>", "u", i, b"p%d" % i, "D", None, "d") + b"\r\n" for i in range(4)]
    (tmp_path / "a.warc").write_bytes(good[0] + good[1] + b"junk" + good[2])
    (tmp_path / "b.warc").write_bytes(good[3])
    assert sorted(r.page for r in warc.read_archive(spark, str(tmp_path)).collect()) == ["0", "1", "3"]
