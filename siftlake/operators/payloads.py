"""Rows as compressed payloads: codecs with and without a trained dictionary, one row or a block of rows at a time."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def payload(df: DataFrame) -> DataFrame:
    """(payload): each row as JSON with its columns in order of their names."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).cast("binary").alias("payload"))


def train(payloads: DataFrame, size: int = 16_384, samples: int = 4_096) -> bytes:
    """A dictionary of at most size bytes from the payloads with the least hashes; samples bounds what the driver receives.

    The sample depends on the payloads' contents only. Training needs some variety: with too little it
    raises what the codec library says.
    """
    import zstandard

    least = payloads.select("payload", F.xxhash64("payload").alias("h")).orderBy("h", "payload").limit(samples)
    return zstandard.train_dictionary(size, [bytes(r["payload"]) for r in least.collect()]).as_bytes()


def _coders(codec: str, level: int, dictionary: bytes | None):
    if codec == "zlib":
        return lambda b: zlib.compress(b, level), zlib.decompress
    import zstandard

    held = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=level, **held).compress, zstandard.ZstdDecompressor(**held).decompress


def compressed(payloads: DataFrame, codec: str = "zstd", level: int = 3, dictionary: bytes | None = None, block: int = 1) -> DataFrame:
    """(rows, raw, stored): payloads in blocks of that many rows, joined by line feeds; the last block of a batch may be shorter."""

    def run(batches):
        import pyarrow as pa

        pack, _ = _coders(codec, level, dictionary)
        for b in batches:
            values = b.column(0).to_pylist()
            groups = [[v for v in values[i : i + block] if v is not None] for i in range(0, len(values), block)]
            whole = [b"\n".join(g) for g in groups]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(g) for g in groups], pa.int64()), pa.array([len(w) for w in whole], pa.int64()), pa.array([pack(w) for w in whole], pa.binary())],
                names=["rows", "raw", "stored"],
            )

    return payloads.select("payload").mapInArrow(run, "rows long, raw long, stored binary")


def expanded(blocks: DataFrame, codec: str = "zstd", dictionary: bytes | None = None) -> DataFrame:
    """(payload) of compressed blocks of payloads without line feeds, as JSON has none."""

    def run(batches):
        import pyarrow as pa

        _, unpack = _coders(codec, 0, dictionary)
        for b in batches:
            lines = [line for blob in b.column(0).to_pylist() for line in unpack(blob).split(b"\n")]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["payload"])

    return blocks.filter("rows > 0").select("stored").mapInArrow(run, "payload binary")


def regimes(payloads: DataFrame, dictionary: bytes, blocks: tuple[int, ...] = (1, 64)) -> DataFrame:
    """(codec, block, raw, stored, ratio) of each codec, with and without the dictionary."""
    out = None
    for block in blocks:
        for name, codec, level, held in (("zlib-6", "zlib", 6, None), ("zstd-3", "zstd", 3, None), ("zstd-3+dict", "zstd", 3, dictionary), ("zstd-19", "zstd", 19, None), ("zstd-19+dict", "zstd", 19, dictionary)):
            sums = compressed(payloads, codec, level, held, block).agg(F.sum("raw").alias("raw"), F.sum(F.length("stored")).alias("stored"))
            part = sums.select(F.lit(name).alias("codec"), F.lit(block).alias("block"), "raw", "stored", F.round(F.col("raw") / F.col("stored"), 3).alias("ratio"))
            out = part if out is None else out.unionByName(part)
    return out
