"""Packing by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's whole windows go out at once; what
remains is put into the open window that it fills best. When none has room and no more may be opened,
the fullest is topped up with the head of the piece and emitted, and the tail opens a new window. The
windows left open at the ends of the partitions are merged, a bounded number of partitions at a time;
what a merge leaves is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, settle, slices, text_of
from .tokens import default_vocabulary, encoder, known

#: Ids of a sequence, open windows of a partition, partitions whose leftovers are merged together.
LENGTH, OPEN, MERGED = 1024, 16, 64
#: Pieces that a task sends on at once; with their ids a piece has up to 4 KB.
PIECES = 1000
#: sequence_id: partition (or group of merged partitions) above a running number of so many bits.
COUNTER_BITS = 33
COLUMNS = ("doc", "start", "length", "crc", "tokens", "seq", "offset", "ids")


class Window:
    """An open sequence: pieces (doc, start, ids, tokens of the document) in order."""

    __slots__ = ("fill", "pieces")

    def __init__(self):
        self.fill, self.pieces = 0, []

    def add(self, doc, start, ids, tokens):
        self.pieces.append((doc, start, ids, tokens))
        self.fill += len(ids) // 4


class Packer:
    """Windows of one partition; done() gets each full sequence's pieces."""

    def __init__(self, done, length: int = LENGTH, most: int = OPEN):
        self.done, self.length, self.most, self.open = done, length, most, []

    def document(self, doc, ids: bytes) -> None:
        n, size = len(ids) // 4, self.length
        whole = n - n % size
        for at in range(0, whole, size):
            self.done([(doc, at, ids[4 * at: 4 * (at + size)], n)])
        if n > whole:
            self.piece(doc, whole, ids[4 * whole:], n)

    def piece(self, doc, start, ids: bytes, tokens) -> None:
        n = len(ids) // 4
        fits = [w for w in self.open if w.fill + n <= self.length]
        if fits:
            best = max(fits, key=lambda w: w.fill)
            best.add(doc, start, ids, tokens)
            if best.fill == self.length:
                self.emit(best)
            return
        if len(self.open) >= self.most:
            fullest = max(self.open, key=lambda w: w.fill)
            room = self.length - fullest.fill
            fullest.add(doc, start, ids[:4 * room], tokens)
            self.emit(fullest)
            start, ids = start + room, ids[4 * room:]
        new = Window()
        new.add(doc, start, ids, tokens)
        self.open.append(new)

    def emit(self, window: Window) -> None:
        self.open.remove(window)
        self.done(window.pieces)


def merge(windows, length: int = LENGTH):
    """Sequences (lists of pieces) out of the pieces of leftover windows: full ones, then powers of two."""
    flat = [p for w in windows for p in w]
    left = sum(len(p[2]) // 4 for p in flat)
    out, queue, i = [], flat, 0
    while left:
        room = length if left >= length else 1 << (left.bit_length() - 1)
        left -= room
        seq = []
        while room:
            doc, start, ids, tokens = queue[i]
            n = len(ids) // 4
            if n <= room:
                seq.append(queue[i])
                i += 1
            else:
                seq.append((doc, start, ids[:4 * room], tokens))
                queue[i] = (doc, start + room, ids[4 * room:], tokens)
                n = room
            room -= n
        out.append(seq)
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, open_windows: int = OPEN,
         id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its ids, then id 0; null counts as the empty text, which is the id 0 alone. Every id
    lies in exactly one piece. Sequences are full or as long as a power of two, so nothing is padded.
    Repeated rows are packed as separate documents, null ids as they come; an empty table gives no
    row. keep_ids adds the ids themselves (little-endian unsigned 32-bit integers).
    """
    vocabulary = vocabulary or default_vocabulary()
    found = known(vocabulary)
    narrow = docs.select(column(docs, id_col).alias("doc"), text_of(column(docs, text_col)).alias("text"))
    kind = narrow.schema["doc"].dataType
    schema = T.StructType([
        T.StructField("doc", kind), *[T.StructField(c, T.LongType()) for c in COLUMNS[1:7]], T.StructField("ids", T.BinaryType()),
        T.StructField("task", T.LongType()), T.StructField("window", T.IntegerType()),
    ])
    types = [None, *[pa.int64()] * 6, pa.binary(), pa.int64(), pa.int32()]

    def batch(rows, doc_type):
        cols = list(zip(*rows)) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t or doc_type) for c, t in zip(cols, types)], names=[f.name for f in schema.fields]
        )

    def run(batches):
        enc, task = encoder(vocabulary, found), TaskContext.get().partitionId()
        rows, count, doc_type = [], 0, None

        def done(pieces, window=None):
            nonlocal count
            seq, at = (task << COUNTER_BITS) + count, 0
            count += 1
            for doc, start, ids, tokens in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), tokens, seq, at, ids if keep_ids or window is not None else None, task, window))
                at += n

        packer = Packer(done, length, open_windows)
        for b in slices(batches):
            doc_type = b.column("doc").type
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                packer.document(doc, enc.ids(text) + b"\0\0\0\0")
                if len(rows) >= PIECES:
                    yield batch(rows, doc_type)
                    rows.clear()
        for i, w in enumerate(packer.open):
            done(w.pieces, i)
        if rows:
            yield batch(rows, doc_type)

    pieces = settle(narrow.mapInArrow(run, schema), "packed")
    closed = pieces.filter("window IS NULL").drop("window", "task")
    open_ = pieces.filter("window IS NOT NULL").withColumn("grp", F.expr(f"task div {MERGED}"))
    merged_schema = T.StructType(schema.fields[:8])

    def merged(key, pdf):
        pdf = pdf.sort_values(["task", "window", "offset"])
        windows = [list(zip(w.doc, w.start, w.ids, w.tokens)) for _, w in pdf.groupby(["task", "window"], sort=True)]
        base, rows = (1 << 62) + (int(key[0]) << COUNTER_BITS), []
        for k, seq in enumerate(merge(windows, length)):
            at = 0
            for doc, start, ids, tokens in seq:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), tokens, base + k, at, ids if keep_ids else None))
                at += n
        return _frame(rows, pdf["doc"])

    tail = open_.groupBy("grp").applyInPandas(merged, merged_schema)
    out = closed.unionByName(tail)
    named = out.select(
        F.col("doc").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        F.col("seq").alias("sequence_id"), "offset", *(["ids"] if keep_ids else []),
    )
    return named


def _frame(rows, docs):
    import pandas as pd

    out = pd.DataFrame(rows, columns=list(COLUMNS))
    if docs.dtype == np.int64 and len(out):
        out["doc"] = out["doc"].astype("int64")
    return out
