"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Reading splits a file anywhere. The magic "WARC/1.0" may also stand inside a payload, so each
occurrence is only a candidate: its task parses the header that follows and emits the offset of the
successor that the record's length claims. True records are those that the chain from the start of the
file reaches. Within a split the chains are a forest, numbered so that "p reaches q" is an interval
test; between splits pointer jumping doubles the reach each round, on rows of offsets alone. A payload
that holds the magic is put together from its chunks afterwards.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, located, picked, scratch, settle, slices, text_of

#: Fixed values of the format.
MAGIC, VERSION = b"WARC/1.0\r\n", "WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(page_id, file: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'{page_id}|{file}|{row}')}>"


def _clean(value: str) -> str:
    """A header value: one line."""
    return " ".join(value.split()) if any(c in value for c in "\r\n\t\x0b\x0c") else value


def _shown(page_id) -> str:
    """An id as a header value: percent-encoded but for what is safe in a line, so that no two ids look alike."""
    return quote(str(page_id), safe="", errors="surrogatepass")


def record(kind: str, rid: str, url: str, page_id, payload: bytes, digest: str, refers: str | None, date: str, size: int | None = None) -> bytes:
    """A record without the last of the line ends that close it; a revisit leaves its payload out and tells its size."""
    size = len(payload) if size is None else size
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {_shown(page_id)}")
    if refers:
        head += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return MAGIC + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n"


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
                  id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record per row of pages into WARC files below path, by Spark's committed text writer.

    Of rows with equal payloads of at least min_bytes, the one with the largest id (then file and row
    number) is a response and the others revisit it. Null html is the empty payload, null url empty, its
    line ends spaces; a null id is less than any other; ids are written percent-encoded, so texts of any
    characters come back as they were. Repeated rows and ids are records of their own. Other columns are
    ignored. No payload is shuffled: a revisit has none, and responses are written where they are read.
    """
    base = located(pages.select(
        column(pages, id_col).alias("page_id"), text_of(column(pages, url_col)).alias("url"), text_of(column(pages, html_col)).alias("html")
    ), "pages")
    ident = F.struct(F.col("doc.page_id").alias("page_id"), "file", "row").alias("ident")
    payload = F.encode(F.col("doc.html"), "UTF-8")
    rows = settle(base.select(F.unhex(F.sha1(payload)).alias("digest"), F.length(payload).alias("size"), ident), "page-digests")
    groups = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("ident").alias("winner"), F.count(F.lit(1)).alias("n"))
    revisits = rows.filter(F.col("size") >= min_bytes).join(groups.filter("n > 1"), "digest").filter("ident <> winner")
    revisits = settle(revisits.select("ident.file", "ident.row", "winner", "size", "digest"), "page-revisits")

    plain = picked(base, revisits, inside=False).select("doc.page_id", "doc.url", "doc.html", "file", "row")
    again = picked(base, revisits).select("doc.page_id", "doc.url", "file", "row").join(revisits, ["file", "row"]).select(
        "page_id", "url", "file", "row", F.col("size").cast("long").alias("size"), "digest",
        F.col("winner.page_id").alias("to_page"), F.col("winner.file").alias("to_file"), F.col("winner.row").alias("to_row"),
    )

    def respond(batches):
        for b in slices(batches):
            out = []
            for r in b.to_pylist():
                body = r["html"].encode("utf-8", "surrogatepass")
                rid = record_id(r["page_id"], r["file"], r["row"])
                out.append(record("response", rid, r["url"], r["page_id"], body, base32_sha1(body), None, date).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    def revisit(batches):
        for b in slices(batches):
            out = []
            for r in b.to_pylist():
                rid, refers = record_id(r["page_id"], r["file"], r["row"]), record_id(r["to_page"], r["to_file"], r["to_row"])
                digest = base64.b32encode(r["digest"]).decode("ascii")
                out.append(record("revisit", rid, r["url"], r["page_id"], b"", digest, refers, date, r["size"]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    written = plain.mapInArrow(respond, "value string").unionByName(again.mapInArrow(revisit, "value string"))
    written.write.option("lineSep", "\r\n").text(path)


CANDIDATE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("split", T.LongType()), T.StructField("at", T.LongType()),
    T.StructField("whole", T.BooleanType()), T.StructField("end", T.LongType()), T.StructField("exit", T.LongType()),
    T.StructField("tin", T.LongType()), T.StructField("tout", T.LongType()), T.StructField("total", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("rid", T.StringType()), T.StructField("refers", T.StringType()),
    T.StructField("page", T.StringType()), T.StructField("url", T.StringType()), T.StructField("declared", T.StringType()),
    T.StructField("size", T.LongType()), T.StructField("digest", T.StringType()),
])


def _header(chunk: bytes):
    """(fields by lower-case name, offset of the block) of a header that starts the chunk, or None."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in chunk[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    if not fields.get(b"content-length", b"").isdigit():
        return None
    return fields, end + 4


def _payload(kind: str, block: bytes):
    """(size, digest) of an HTTP payload; of a revisit only the size that its HTTP header claims."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return len(block), base32_sha1(block)
    if kind == "revisit":
        sizes = [x.partition(b":")[2].strip() for x in block[:end].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        return int(sizes[0]) if sizes and sizes[0].isdigit() else None, None
    return len(block) - end - 4, base32_sha1(block[end + 4:])


def _forest(found: list[dict]) -> None:
    """Numbers one split's candidates: exit is the first successor outside; p reaches q iff q.tin <= p.tin < q.tout."""
    index = {c["at"]: i for i, c in enumerate(found)}
    up = [index.get(c["end"]) if c["end"] is not None else None for c in found]
    weight = [1] * len(found)
    for i, p in enumerate(up):  # a successor stands after its candidate
        if p is not None:
            weight[p] += weight[i]
    free, roots = [0] * len(found), 0
    for i in range(len(found) - 1, -1, -1):
        c, p = found[i], up[i]
        if p is None:
            c["tin"], c["exit"] = roots, c["end"]
            roots += weight[i]
        else:
            c["tin"], c["exit"] = free[p], found[p]["exit"]
            free[p] += weight[i]
        c["tout"], free[i] = c["tin"] + weight[i], c["tin"] + 1


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between occurrences of the magic; in a split, in order."""
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("chunk"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per occurrence of the magic, offsets relative to the split's first chunk, and a row with the total of each split."""

    def run(batches):
        key, pos, found = None, 0, []

        def flush():
            _forest(found)
            rows = [*found, dict(file=key[0], split=key[1], total=pos)]
            cols = [pa.array([r.get(f.name) for r in rows], pa.string() if isinstance(f.dataType, T.StringType) else pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64()) for f in CANDIDATE.fields]
            return pa.RecordBatch.from_arrays(cols, names=CANDIDATE.fieldNames())

        for b in slices(batches):
            for file, split, chunk in zip(b.column("file").to_pylist(), b.column("split").to_pylist(), b.column("chunk").to_pylist()):
                if (file, split) != key:
                    if key is not None:
                        yield flush()
                    key, pos, found = (file, split), 0, []
                if split or pos:  # what precedes the first magic of a file follows none
                    c = dict(file=file, split=split, at=pos - len(MAGIC), end=None, whole=False)
                    if parsed := _header(chunk):
                        fields, block = parsed
                        size, name = int(fields[b"content-length"]), lambda k: fields[k].decode("utf-8", "surrogatepass") if k in fields else None
                        c |= dict(end=pos + block + size + 4, whole=len(chunk) >= block + size, kind=name(b"warc-type"), rid=name(b"warc-record-id"), refers=name(b"warc-refers-to"), page=unquote(name(b"x-page-id"), errors="surrogatepass") if b"x-page-id" in fields else None, url=name(b"warc-target-uri"), declared=name(b"warc-payload-digest"))
                        if c["whole"]:
                            c["size"], c["digest"] = _payload(c["kind"], chunk[block: block + size])
                    found.append(c)
                pos += len(chunk) + len(MAGIC)
        if key is not None:
            yield flush()

    return _chunks(spark, path).mapInArrow(run, CANDIDATE)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The true records below path: file, offset, kind, rid, refers, page, url, declared, size, digest.

    size and digest are those of the payload as read; a revisit's are looked up by resolve(). A file's
    chain ends where no record begins; what follows is not read. No files give no records.
    """
    found = settle(candidates(spark, path), "warc-candidates")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = found.filter("total IS NOT NULL").select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    spots = found.filter("total IS NULL").drop("total").join(bases, ["file", "split"])
    for c in ("at", "end", "exit"):
        spots = spots.withColumn(c, F.col(c) + F.col("base"))
    spots = settle(spots, "warc-spots")
    entries = _entries(spots).join(spots.select("file", "at", "split", "tin"), ["file", "at"]).select("file", "split", F.col("tin").alias("entry"))
    true = spots.join(entries, ["file", "split"]).filter("tin <= entry AND entry < tout AND end IS NOT NULL").drop("entry")
    whole = true.filter("whole")
    broken = settle(true.filter("NOT whole"), "warc-broken")
    if not broken.isEmpty():
        whole = whole.unionByName(_joined(spark, path, spots, true, broken))
    return whole.select("file", F.col("at").alias("offset"), "kind", "rid", "refers", "page", "url", "declared", "size", "digest")


def _entries(spots: DataFrame) -> DataFrame:
    """(file, at): the first true record of each split, by pointer jumping from the start of the file."""
    reached = spots.filter("at = 0").select("file", "at")
    most = spots.groupBy("file").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0] or 0
    if most < 2:
        return reached
    targets = spots.select("file", F.col("exit").alias("at")).distinct()
    jump = settle(spots.join(targets, ["file", "at"], "left_semi").unionByName(spots.filter("at = 0")).select("file", "at", F.col("exit").alias("to")).distinct(), "warc-jumps")
    step = 1
    while step <= most:
        hops = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = settle(reached.unionByName(hops.join(spots.select("file", "at"), ["file", "at"], "left_semi")).distinct(), "warc-reached")
        onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        jump = settle(jump.join(onward, ["file", "to"]).select("file", "at", F.col("further").alias("to")), "warc-jumps")
        step *= 2
    return reached


def _joined(spark: SparkSession, path: str, spots: DataFrame, true: DataFrame, broken: DataFrame) -> DataFrame:
    """broken with size and digest: records whose payload holds the magic, from all their chunks."""
    false = spots.join(true.select("file", "at"), ["file", "at"], "left_anti").select("file", "split", "at", F.lit(None).cast("long").alias("owner"))
    marks = broken.select("file", "split", "at", F.col("at").alias("owner")).unionByName(false)
    # The last record before each mark: within its split, else that of the splits before, of which a row each is left.
    inside = Window.partitionBy("file", "split").orderBy("at")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.groupBy("file", "split").agg(F.max("owner").alias("own")).select("file", "split", F.max("own").over(before).alias("carry"))
    owned = marks.withColumn("owner", F.last("owner", ignorenulls=True).over(inside)).join(carried, ["file", "split"])
    owned = owned.withColumn("owner", F.coalesce("owner", "carry")).drop("carry").filter("owner IS NOT NULL")
    ends = broken.select("file", F.col("at").alias("owner"), "end")
    owned = owned.join(ends, ["file", "owner"]).filter("at < end").select("file", "split", "at", "owner")
    bases = spots.select("file", "split", "base").distinct()
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("split", T.LongType()), T.StructField("rel", T.LongType()), T.StructField("chunk", T.BinaryType())])

    def place(batches):
        key, pos = None, 0
        for b in slices(batches):
            rel = []
            for file, split, chunk in zip(b.column("file").to_pylist(), b.column("split").to_pylist(), b.column("chunk").to_pylist()):
                if (file, split) != key:
                    key, pos = (file, split), 0
                rel.append(pos - len(MAGIC))
                pos += len(chunk) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("split"), pa.array(rel, pa.int64()), b.column("chunk")], names=schema.fieldNames())

    pieces = _chunks(spark, path).mapInArrow(place, schema).join(bases, ["file", "split"]).withColumn("at", F.col("rel") + F.col("base"))
    pieces = pieces.join(owned, ["file", "split", "at"]).groupBy("file", F.col("owner").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "chunk"))).alias("chunks"))
    told = broken.drop("size", "digest", "whole").join(pieces, ["file", "at"])
    out = T.StructType([f for f in told.schema.fields if f.name != "chunks"] + [T.StructField("whole", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("digest", T.StringType())])

    def assemble(batches):
        for b in slices(batches):
            sizes, digests, good = [], [], []
            for kind, chunks in zip(b.column("kind").to_pylist(), b.column("chunks").to_pylist()):
                body = MAGIC.join(c["chunk"] for c in chunks)
                fields, block = _header(body)
                size = int(fields[b"content-length"])
                good.append(len(body) >= block + size)
                s, d = _payload(kind, body[block: block + size])
                sizes.append(s)
                digests.append(d)
            keep = [b.column(f.name) for f in out.fields[:-3]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(good, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=out.fieldNames())

    return told.mapInArrow(assemble, out)


def resolve(records: DataFrame) -> DataFrame:
    """page, payload_bytes, payload_digest, record_type, refers_to, url: revisits have those of the response they name."""
    records = records.filter("kind IN ('response', 'revisit')")
    responses = records.filter("kind = 'response'")
    named = responses.select(F.col("rid").alias("refers"), F.col("page").alias("to_page"), F.col("size").alias("to_size"), F.col("digest").alias("to_digest"))
    revisits = records.filter("kind = 'revisit'").join(named, "refers").select(
        "page", F.col("to_size").alias("payload_bytes"), F.col("to_digest").alias("payload_digest"),
        F.lit("revisit").alias("record_type"), F.col("to_page").alias("refers_to"), "url",
    )
    plain = responses.select(
        "page", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "url",
    )
    return plain.unionByName(revisits)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id") -> DataFrame:
    """Writes pages as an archive in the shared folder, reads it back and returns resolve() of it."""
    spark = pages.sparkSession
    path = scratch(spark, "archive")
    write_archive(pages, path, min_bytes, id_col=id_col)
    records = settle(read_archive(spark, path), "warc-records")
    kind = pages.schema[id_col].dataType
    back = resolve(records)
    return back.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "url",
    )
