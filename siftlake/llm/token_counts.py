"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

Tier 1 is a table of the lengths of frequent pre-tokens, learnt from whole texts that a hash picks from
all rows of the table, and broadcast (at most TABLE entries). What it lacks is encoded by the library and
kept in a bounded cache of the worker (tier 2). The sample decides only how often tier 2 is asked, never
a count. Sampled texts are counted in tasks, each of which sends one bounded summary.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, located, settle, slices, text_of
from .tokens import LONGEST, REMEMBERED, Encoder, Traits, default_vocabulary, encoder, known

#: Texts of the sample, tasks that count them, entries of a task's summary and of tier 1.
SAMPLE, TASKS, TABLE = 1000, 8, 32_768
_LENGTHS: dict[str, dict[str, int]] = {}


def sampled_texts(docs: DataFrame, text_col: str, rows: int = SAMPLE) -> DataFrame:
    """(text) of the rows with the least hashes of their locators. Only locators are read to find them, then only their files."""
    spots = located(docs, "count-docs")
    at = spots.select(F.xxhash64(F.lit(5), "file", "row").alias("h"), "file", "row").orderBy("h", "file", "row").limit(rows)
    picked = settle(at, "count-sample")
    files = [r.file for r in picked.select("file").distinct().collect()]  # at most `rows`
    there = spots.filter(F.col("file").isin(files))
    found = there.join(F.broadcast(picked), ["file", "row"])  # at most `rows`
    return found.select(text_of(F.col("doc").getField(text_col)).alias("text"))


def frequent_lengths(docs: DataFrame, text_col: str, vocabulary: str) -> dict[str, int]:
    """Tier 1: pre-token -> number of tokens."""
    found = known(vocabulary)
    enc = Encoder(vocabulary, found)
    if not enc.easy:
        return {}  # the library encodes whole texts

    def count(batches):
        split, seen = encoder(vocabulary, found).split, Counter()
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                seen.update(p for p in split(text) if len(p) <= LONGEST)
                if len(seen) > 8 * TABLE:
                    seen = Counter(dict(seen.most_common(4 * TABLE)))
        top = seen.most_common(TABLE)
        yield pa.RecordBatch.from_arrays([pa.array([[p for p, _ in top]]), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["pieces", "n"])

    seen = Counter()
    dealt = sampled_texts(docs, text_col).repartition(TASKS)
    for pieces, n in dealt.mapInArrow(count, "pieces array<string>, n array<bigint>").collect():  # TASKS summaries
        for p, k in zip(pieces, n):
            seen[p] += k
    top = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:TABLE]]
    return {p: len(enc.piece(p)) for p in top}


class Counts:
    """Numbers of tokens by worker-wide lookups."""

    def __init__(self, vocabulary: str, table: dict[str, int], found: Traits | None = None):
        self.enc, self.table = encoder(vocabulary, found), table
        self.known = _LENGTHS.setdefault(vocabulary, dict(table))
        for p, n in table.items():
            self.known.setdefault(p, n)

    def plain(self, text: str) -> int:
        pieces, get = self.enc.split(text), self.known.__getitem__
        try:
            return sum(map(get, pieces))
        except KeyError:
            new = [p for p in set(pieces) if p not in self.known]
        lengths = [len(self.enc.piece(p)) for p in new]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            self.known.update(self.table)
        here = dict(zip(new, lengths))
        self.known.update((p, n) for p, n in here.items() if len(p) <= LONGEST)
        return sum(self.known[p] if p in self.known else here[p] if p in here else len(self.enc.piece(p)) for p in pieces)

    def count(self, text: str) -> int:
        enc = self.enc
        if not enc.by_pieces(text):
            return len(enc.library(text))
        return sum(1 if p in enc.special else self.plain(p) for p in enc.parts(text))


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    As the library counts them (tokenizers for a .json, sentencepiece for a .model) without added special
    tokens; special strings in a text are its default. Null counts as empty (0 tokens). Rows stay as they
    are, repeated ones, too; other columns, whatever their names, are not read. The texts are not shuffled,
    but for the sample.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    found = known(vocabulary)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, text_col, vocabulary))
    narrow = docs.select(column(docs, id_col).alias("doc_id"), text_of(column(docs, text_col)).alias("text"))
    schema = T.StructType([
        narrow.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ])

    def run(batches):
        counts = Counts(vocabulary, table.value, found)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            n = [counts.count(t) for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return narrow.mapInArrow(run, schema)
