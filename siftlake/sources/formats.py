"""Sinks and sources by format: Parquet with its writer's knobs, line JSON, CSV; checksums and encryption of pages."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", level: int | None = None, row_group_bytes: int | None = None,
                  bloom: list[str] = (), sort: list[str] = (), files: int | None = None, checksums: bool = True) -> None:
    """df as Parquet files. Row groups are sized in bytes, as Spark does, not in rows.

    sort orders the rows over all files: ranges of the columns, sorted inside, so that footers prune.
    bloom names columns whose values get a Bloom filter in each row group.
    """
    if sort:
        df = (df.repartitionByRange(files, *sort) if files else df.repartitionByRange(*sort)).sortWithinPartitions(*sort)
    elif files:
        df = df.repartition(files)
    out = df.write.option("compression", codec).option("parquet.page.write-checksum.enabled", str(checksums).lower())
    if level is not None:
        out = out.option("parquet.compression.codec.zstd.level", str(level))
    if row_group_bytes:
        out = out.option("parquet.block.size", str(row_group_bytes))
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)


def ordered_copy(df: DataFrame, path: str, codec: str = "zstd", files: int = 1) -> None:
    """df sorted by all its columns: equal rows give equal files, whatever the tasks that made them.

    With several files the range bounds come from a sample that depends on df's partitions; only one file is stable.
    """
    write_parquet(df, path, codec, sort=df.columns, files=files)


def read_verified(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Parquet whose pages are checked against their checksums; a page that differs fails the job.

    The vectorized reader and the row reader both go through the page reader that checks. The switch is a
    setting of the file system configuration, which Spark copies from options of the read.
    """
    return spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line; nulls are left out, as in the logs that this imitates."""
    df.write.option("compression", "none").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, bad: str | None = None) -> DataFrame:
    """Line JSON. Without a schema all lines are read to infer one; bad names a column that keeps lines which do not parse."""
    reader = spark.read.option("samplingRatio", "1.0")
    if bad:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
    return (reader.schema(schema) if schema else reader).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; null is \\N, so that it differs from an empty text."""
    df.write.option("header", "true").option("nullValue", "\\N").option("emptyValue", "").option("escape", '"').option("quote", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("nullValue", "\\N").option("emptyValue", "").option("escape", '"').option("multiLine", "true").csv(path)


def drop_lines(spark: SparkSession, source: str, target: str, column: str, dropped: list[str]) -> None:
    """Line JSON without the lines whose column has one of the values; all others go on as they were, byte for byte.

    Lines without the column, or that do not parse, are kept: a filter on the way in loses nothing it does not know.
    """
    lines = spark.read.text(source)
    value = F.get_json_object("value", f"$.{column}")
    lines.filter(~F.coalesce(value.isin(*dropped), F.lit(False))).write.text(target)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified) of the files that a scan of path reads, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def footer_rows(spark: SparkSession, path: str | list[str], schema: str, rows_of) -> DataFrame:
    """What rows_of(file, footer) yields (dicts) for each Parquet file below path, or of a list of files.

    Files are listed without their content, dealt to tasks, and only their footers are read there.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(parsed)
        for b in batches:
            for name in b.column("path").to_pylist():
                fs, where = _place(name)
                with fs.open_input_file(where) as f:
                    rows = list(rows_of(name, pq.read_metadata(f)))
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    parsed = T.StructType.fromDDL(schema)
    return found.repartition(max(1, min(found.count(), 10_000))).mapInArrow(run, parsed)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """A row per column chunk: file, row_group, rows, column, physical type, codec, encodings, bytes packed and raw."""

    def rows_of(name: str, meta):
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for k in range(group.num_columns):
                c = group.column(k)
                yield {"file": name, "row_group": g, "rows": group.num_rows, "column": c.path_in_schema, "type": c.physical_type, "codec": c.compression,
                       "encodings": sorted(set(c.encodings)), "bytes": c.total_compressed_size, "raw_bytes": c.total_uncompressed_size}

    return footer_rows(spark, path, "file string, row_group int, rows long, column string, type string, codec string, encodings array<string>, bytes long, raw_bytes long", rows_of)


def write_encoded(df: DataFrame, path: str, encodings: dict[str, str]) -> DataFrame:
    """df as Parquet files whose columns have the encodings asked for (PLAIN, RLE_DICTIONARY, DELTA_BINARY_PACKED, ...).

    Spark's writer picks encodings itself, so tasks write by Arrow; (file, rows) when it is run. A task's file
    is moved into place when it is whole.
    """

    def run(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        fs, folder = _place(path)
        fs.create_dir(folder)
        final, rows = f"{folder}/part-{TaskContext.get().partitionId():05d}.parquet", 0
        part, b = f"{folder}/_{uuid.uuid4().hex}", head
        dictionary = [c for c, e in encodings.items() if e == "RLE_DICTIONARY"]
        forced = {c: e for c, e in encodings.items() if e != "RLE_DICTIONARY"}
        with pq.ParquetWriter(part, head.schema, filesystem=fs, use_dictionary=dictionary, column_encoding=forced or None) as out:
            while b is not None:
                out.write_batch(b)
                rows += b.num_rows
                b = next(batches, None)
        fs.move(part, final)
        yield pa.RecordBatch.from_pydict({"file": [final], "rows": pa.array([rows], pa.int64())})

    return df.mapInArrow(run, "file string, rows long")


def same_bytes(spark: SparkSession, a: str, b: str) -> bool:
    """Whether the data files of two folders are the same bytes, file by file in order of their names."""

    def digests(path: str) -> list[str]:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
        return [r[0] for r in found.select(F.sha2("content", 256), F.col("path")).orderBy("path").collect()]  # a row per file

    return digests(a) == digests(b)


def _factory(keys: dict[str, bytes]):
    """A stand-in for a key service: data keys are masked by a digest of their master key, which is not secure."""
    import hashlib

    import pyarrow.parquet.encryption as pe

    class Held(pe.KmsClient):
        def __init__(self):
            super().__init__()

        def _mask(self, master: str, n: int) -> bytes:
            if master not in keys:
                raise KeyError(f"no key {master}")
            return hashlib.shake_256(keys[master]).digest(n)

        def wrap_key(self, key_bytes, master_key_identifier):
            mask = self._mask(master_key_identifier, len(key_bytes))
            return base64.b64encode(bytes(a ^ b for a, b in zip(key_bytes, mask))).decode()

        def unwrap_key(self, wrapped_key, master_key_identifier):
            raw = base64.b64decode(wrapped_key)
            return bytes(a ^ b for a, b in zip(raw, self._mask(master_key_identifier, len(raw))))

    return pe.CryptoFactory(lambda config: Held()), pe


def _place(path: str):
    """(file system, path there) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_encrypted(df: DataFrame, path: str, keys: dict[str, bytes], footer_key: str, column_keys: dict[str, list[str]]) -> DataFrame:
    """df as encrypted Parquet files in a folder that all executors see; returns (file, rows) when it is run.

    Each task writes the rows of its partition as one file of a name of its own and moves it into place
    when it is whole, so a task that runs again replaces nothing that others read. Batches are written as
    they come; a partition is never held.
    """
    names = df.columns

    def run(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        factory, pe = _factory(keys)
        props = factory.file_encryption_properties(pe.KmsConnectionConfig(), pe.EncryptionConfiguration(footer_key=footer_key, column_keys=column_keys))
        fs, folder = _place(path)
        fs.create_dir(folder)
        final, rows = f"{folder}/part-{TaskContext.get().partitionId():05d}.parquet", 0
        part = f"{folder}/_{uuid.uuid4().hex}"
        with pq.ParquetWriter(part, head.schema, filesystem=fs, encryption_properties=props) as out:
            b = head
            while b is not None:
                out.write_batch(b)
                rows += b.num_rows
                b = next(batches, None)
        fs.move(part, final)
        yield pa.RecordBatch.from_pydict({"file": [final], "rows": pa.array([rows], pa.int64())})

    return df.select(*names).mapInArrow(run, "file string, rows long")


def read_encrypted(spark: SparkSession, path: str, schema: str, keys: dict[str, bytes], columns: list[str] | None = None) -> DataFrame:
    """The columns of encrypted files whose keys are held; a column without its key fails the job."""
    from pyarrow.fs import FileSelector

    fs, folder = _place(path)
    names = sorted(f.path for f in fs.get_file_info(FileSelector(folder)) if f.base_name.startswith("part-"))

    def run(batches):
        import pyarrow.parquet as pq

        factory, pe = _factory(keys)
        for b in batches:
            for name in b.column(0).to_pylist():
                props = factory.file_decryption_properties(pe.KmsConnectionConfig(), pe.DecryptionConfiguration())
                yield from pq.ParquetFile(_place(path)[0].open_input_file(name), decryption_properties=props).iter_batches(columns=columns)

    listed = spark.createDataFrame([(n,) for n in names], "file string")
    return listed.repartition(max(1, len(names)), "file").mapInArrow(run, schema)
