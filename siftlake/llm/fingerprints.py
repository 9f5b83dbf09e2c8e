"""Document fingerprints by locally consistent parsing.

A text is a row of symbols. Runs of one symbol become one symbol; deterministic coin tossing then gives
each symbol a small label from its own bits and its left neighbour's, and local maxima of the labels cut
the row into phrases. A phrase's name is a hash of its symbols' names, and the names are the next
level's symbols. Cuts depend on a few neighbours only, so equal substrings get equal phrases inside,
wherever they stand. A fingerprint is a one-permutation MinHash of the phrase names of some levels.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, located, settle, slices, text_of

#: Levels whose phrases are compared (phrases have about 3, 9, 27 ... characters), and bins of 16 bits.
LEVELS, BINS = (2, 3, 4), 64
#: Characters parsed together.
CHARS = 400_000
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels of neighbouring symbols that differ: place and value of the lowest bit that tells x from its left neighbour."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]  # the first symbol of a text differs from nothing but itself
    diff = x ^ left
    low = diff & (~diff + x.dtype.type(1))
    return (np.bitwise_count(low - x.dtype.type(1)) << 1) + ((x & low) != 0)


def phrases(symbols: np.ndarray, doc: np.ndarray):
    """(names, doc) of the next level; symbols of one text are contiguous."""
    new = np.ones(len(symbols), dtype=bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.r_[at, len(symbols)])
    x, doc = symbols[at], doc[at]
    names = _mix(x.astype(np.uint64) + _GOLD)
    many = runs > 1
    names[many] = _mix(names[many] ^ _mix(runs[many].astype(np.uint64)))
    first = np.ones(len(x), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    starts = np.flatnonzero(first)
    label = _toss(x, starts).astype(np.uint8)
    for _ in range(2):
        label = _toss(label, starts).astype(np.uint8)
    cut = first.copy()
    if len(label) > 2:
        cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    cut[1:] &= ~first[:-1] | first[1:]  # a phrase has two symbols at least, if its text has
    begin = np.flatnonzero(cut)
    length = np.diff(np.r_[begin, len(x)])
    place = (np.arange(len(x)) - np.repeat(begin, length)).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(names + place * _GOLD), begin)), doc[begin]


def sketches(texts: list[str], levels=LEVELS, bins: int = BINS) -> np.ndarray:
    """(len(texts), bins) of 16-bit values, 0 for an empty bin."""
    best = np.full((len(texts), bins), np.iinfo(np.uint64).max, dtype=np.uint64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if sizes.sum():
        symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        flat = best.reshape(-1)
        for level in range(1, max(levels) + 1):
            symbols, doc = phrases(symbols, doc)
            if level in levels:
                h = _mix(symbols + np.uint64(level * int(_GOLD) % 2**64))
                np.minimum.at(flat, doc.astype(np.int64) * bins + (h % np.uint64(bins)).astype(np.int64), h)
    out = (best >> np.uint64(32)).astype(np.uint16) | np.uint16(1)
    out[best == np.iinfo(np.uint64).max] = 0
    return out


def all_sketches(texts: list[str]) -> np.ndarray:
    """sketches(), some characters at a time."""
    parts, at = [], 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (chars == 0 or chars + len(texts[end]) <= CHARS):
            chars += len(texts[end])
            end += 1
        parts.append(sketches(texts[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros((0, BINS), dtype=np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity row by row; equal fingerprints (also two of nothing) have 1."""
    any_, same = ((a != 0) | (b != 0)).sum(axis=-1), ((a == b) & (a != 0)).sum(axis=-1)
    return np.where(any_ == 0, 1.0, same / np.maximum(any_, 1))


def shown(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u2").astype(np.uint16)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_chars, fingerprint. Null is empty: all bins are empty."""
    narrow = docs.select(column(docs, id_col).alias("doc_id"), text_of(column(docs, text_col)).alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches):
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([shown(s) for s in all_sketches(texts)], pa.string())],
                names=schema.fieldNames(),
            )

    return narrow.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as many first characters of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next lesser id (of equal ids, by hash of the text, then by a hash of
    the place in the files, so that equal rows can lie in different partitions; null ids come last); after the last
    comes the first. Null texts are empty. An empty table gives no row. Texts are
    dealt by ranges of the id, so each partition needs but one text of the partition after it.
    """
    field = F.col("doc").getField
    spots = located(docs, "print-docs").select(field(id_col).alias("doc_id"), text_of(field(text_col)).alias("text"), F.xxhash64("file", "row").alias("spot"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc(), F.col("spot").asc()]
    placed = spots.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    result = [
        placed.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ]
    extra = [T.StructField("task", T.LongType()), T.StructField("place", T.StringType()), T.StructField("text", T.StringType())]
    schema = T.StructType(result + extra)

    def finished(ids, texts, nexts, own, after, kind):
        changed = [edited(a, b) for a, b in zip(texts, nexts)]
        prints = all_sketches(changed)
        cols = [
            pa.array(ids, kind), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
            pa.array([shown(s) for s in own], pa.string()), pa.array([shown(s) for s in prints], pa.string()),
            pa.array(likeness(own, prints), pa.float64()), pa.array(likeness(own, after), pa.float64()),
        ]
        return cols

    def batch(cols, task, place, texts=None):
        n = len(cols[0])
        cols = cols + [pa.array([task] * n, pa.int64()), pa.array([place] * n, pa.string()), pa.array(texts or [None] * n, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    def end(i, text, sketch, task, place, kind):
        cols = [pa.array([i], kind), pa.array([len(text)], pa.int64()), pa.nulls(1, pa.string()), pa.array([shown(sketch)], pa.string()),
                pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
        return batch(cols, task, place, [text])

    def run(batches):
        task, last, kind = TaskContext.get().partitionId(), None, None
        for b in slices(batches):
            if not b.num_rows:
                continue
            kind = b.column("doc_id").type
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            own = all_sketches(texts)
            if last is None:
                yield end(ids[0], texts[0], own[0], task, "head", kind)
            else:
                ids, texts, own = [last[0], *ids], [last[1], *texts], np.concatenate([last[2][None], own])
            if len(ids) > 1:
                yield batch(finished(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:], kind), task, "inside")
            last = (ids[-1], texts[-1], own[-1])
        if last is not None:
            yield end(*last, task, "tail", kind)

    found = settle(placed.mapInArrow(run, schema), "fingerprints-by-id")
    heads = found.filter("place = 'head'").select("task", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    tails = found.filter("place = 'tail'").select("task", "doc_id", "text", "fingerprint")
    # A row per partition, not per document.
    by_task = Window.orderBy("task")
    first_task = F.first("task").over(by_task.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tasks = heads.select("task").withColumn("after", F.coalesce(F.lead("task").over(by_task), first_task))
    seams = tails.join(tasks, "task").join(heads.withColumnRenamed("task", "after"), "after").select(
        "doc_id", "text", "fingerprint", "next_text", "next_print"
    )

    def close(batches):
        for b in slices(batches):
            if b.num_rows:
                own, after = (np.stack([read(f) for f in b.column(c).to_pylist()]) for c in ("fingerprint", "next_print"))
                ids, texts, nexts = (b.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))
                yield pa.RecordBatch.from_arrays(finished(ids, texts, nexts, own, after, b.column("doc_id").type), names=[f.name for f in result])

    names = [f.name for f in result]
    return found.filter("place = 'inside'").select(*names).unionByName(seams.mapInArrow(close, T.StructType(result)))
