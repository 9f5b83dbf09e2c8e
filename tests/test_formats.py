import json
import os

import pytest
from pyspark.sql import functions as F

from siftlake.sources import formats


def rows(spark, n=2000):
    return spark.range(n).select(F.col("id"), (F.col("id") % 7).cast("string").alias("kind"), F.when(F.col("id") % 5 > 0, F.concat(F.lit('a "b",\n'), "id")).alias("text"))


def test_parquet_knobs_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "p")
    formats.write_parquet(rows(spark), path, "zstd", 3, bloom=["id"], sort=["id"], files=4)
    found = formats.footers(spark, path).collect()
    assert {r["codec"] for r in found} == {"ZSTD"} and {r["column"] for r in found} == {"id", "kind", "text"}
    assert sum(r["rows"] for r in found if r["column"] == "id") == 2000
    assert formats.files(spark, path).filter("bytes > 0").count() == len({r["file"] for r in found})
    assert spark.read.parquet(path).filter("id = 1234").count() == 1 and spark.read.parquet(path).filter("id = 9999").count() == 0


def test_ordered_copies_are_equal_bytes(spark, tmp_path):
    contents = []
    for k, parts in enumerate((1, 5)):
        path = str(tmp_path / f"o{k}")
        formats.ordered_copy(rows(spark).repartition(parts), path)
        contents.append([open(f"{path}/{n}", "rb").read() for n in sorted(os.listdir(path)) if n.endswith(".parquet")])
    assert contents[0] == contents[1]


def test_a_changed_page_is_noticed(spark, tmp_path):
    path = str(tmp_path / "c")
    formats.write_parquet(spark.range(1000).select(F.xxhash64("id").alias("v")), path, "none", files=1)
    name = next(f"{path}/{n}" for n in os.listdir(path) if n.endswith(".parquet"))
    assert formats.read_verified(spark, path, "v long").agg(F.sum(F.col("v") % 100)).first()
    data = bytearray(open(name, "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(name, "wb").write(data)
    crc = os.path.join(path, "." + os.path.basename(name) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        formats.read_verified(spark, path, "v long").agg(F.sum(F.col("v") % 100)).first()


def test_json_and_csv_round_trips(spark, tmp_path):
    df = rows(spark, 300)
    for write, read in ((formats.write_json, formats.read_json), (formats.write_csv, formats.read_csv)):
        path = str(tmp_path / write.__name__)
        write(df, path)
        back = read(spark, path, "id long, kind string, text string")
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_dropped_lines_leave_the_others_as_they_were(spark, tmp_path):
    source = tmp_path / "in.json"
    lines = [json.dumps({"state": s, "n": i}) for i, s in enumerate(["S0", "SF", "REJ", "SF", None])] + ["not json", '{"n":  1}']
    source.write_text("\n".join(lines) + "\n")
    formats.drop_lines(spark, str(source), str(tmp_path / "out"), "state", ["S0", "REJ"])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(lines[k] for k in (1, 3, 4, 5, 6))


def test_encrypted_columns_need_their_keys(spark, tmp_path):
    path, keys = str(tmp_path / "e"), {"foot": b"f" * 16, "col": b"c" * 16}
    df = rows(spark, 500).repartition(3)
    assert sum(r["rows"] for r in formats.write_encrypted(df, path, keys, "foot", {"col": ["text"]}).collect()) == 500
    back = formats.read_encrypted(spark, path, "id long, kind string, text string", keys)
    assert back.exceptAll(df).count() == 0 and back.count() == 500
    with pytest.raises(Exception):
        formats.read_encrypted(spark, path, "id long, kind string, text string", {"foot": keys["foot"]}).count()
    with pytest.raises(Exception):
        spark.read.schema("id long").parquet(path).collect()
