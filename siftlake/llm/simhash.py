"""SimHash near-duplicates through pivot distance tables.

A text's fingerprint has the majority bits of the XXH64 hashes of its word shingles; `lanes` of 64 bits
each give wider fingerprints (further lanes are mixed from the same hash). Rows that cannot differ are one
node. Nodes meet in buckets. Within a bucket the Hamming distances to many reference fingerprints (pivots)
are computed once for each node; a pair whose distances to any pivot differ by more than the threshold is
discarded by the triangle inequality, the survivors are verified on the fingerprints themselves, and the
bucket sends a spanning forest, never all pairs. The forests' components are the groups.

Exact plans deal nodes by blocks of bits: each pair within the threshold agrees in some `agree` of `blocks`
blocks, as there are more blocks than differing bits. Their pivots are random fingerprints.

A plan with a `similarity` asks for more differing bits than blocks can cover. It deals nodes by `bands` of
`rows` minima of their shingle hashes, so that how many nodes share a bucket depends on how alike they are,
not on how many there are; fingerprints are those of the set of shingles, and pivots are members of the
bucket, which tell its clusters apart. These groups are candidates only: within each, nodes are linked when
the Jaccard similarity of their whole texts' shingle sets reaches the threshold, and the components of these
links are the groups. All pairs of a group are open to the test; nodes that are linked already are not
compared again, so a group of near copies costs no pairs.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import located, picked, settle, slices, text_of, tidy
from .components import components

#: Nodes of a bucket that one task handles together; larger buckets are split into tiles of so many.
TILE = 4096
#: Buckets up to this size are compared by shifted rows, larger ones by growing components.
SMALL = 48
#: Shingles hashed at once.
CHUNK = 1 << 16
#: Shingles that one task compares together, about; larger groups of candidates are split into tiles.
SET_TILE = 1 << 17


@dataclass(frozen=True)
class Plan:
    """shingle: words; bits: threshold; lanes: 64-bit words of a fingerprint; buckets by blocks or by bands.

    similarity: least Jaccard similarity of linked rows' shingle sets; None: the bits decide.
    """

    shingle: int = 4
    bits: int = 4
    lanes: int = 1
    blocks: int = 6
    bands: int = 0
    rows: int = 5
    pivots: int = 24
    seed: int = 42
    similarity: float | None = None

    def tables(self) -> list[tuple[int, ...]]:
        """For each table, a mask for each lane."""
        agree, width = self.blocks - self.bits, 64 * self.lanes
        if agree < 1:
            raise ValueError("there must be more blocks than differing bits")
        edge = [i * width // self.blocks for i in range(self.blocks + 1)]
        sets = [[b for k in c for b in range(edge[k], edge[k + 1])] for c in combinations(range(self.blocks), agree)]
        return [tuple(sum(1 << (b - 64 * i) for b in s if b // 64 == i) for i in range(self.lanes)) for s in sets]

    def references(self) -> np.ndarray:
        rnd = random.Random(self.seed + 1)
        return np.array([[rnd.getrandbits(64) for _ in range(self.lanes)] for _ in range(self.pivots)], dtype=np.uint64)


#: For the contract: 4-word shingles, links at 4 or fewer of 64 bits, found exactly.
EXACT = Plan()
#: For near copies of word 5-shingles at a similarity of 0.8. Such sets have a cosine of 0.89 or more, an angle of
#: 0.15 half turns, 19.5 of 128 bits with a deviation of 4.1; 32 bits leave 3. 24 bands of 5 minima bring a pair
#: at 0.8 together with a probability of 0.9999, one at 0.5 with 0.53, one at 0.2 with 0.008.
NEAR = Plan(shingle=5, bits=32, lanes=2, bands=24, pivots=8, similarity=0.8)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; others go through the splitmix64 finaliser."""
    if lane == 0:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * lane) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _hashes(text: str, k: int):
    """Arrays of the hashes of a text's shingles, in order. A-Z are lower-cased, white space is ASCII."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII alone
    if not words:
        return
    if len(words) < k:
        words, k = [b" ".join(words)], 1
    total = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        part = words[at: min(at + CHUNK, total) + k - 1]
        grams = map(b" ".join, zip(*[part[i:] for i in range(k)]))
        yield np.fromiter((digest(g, 42) for g in grams), dtype=np.uint64, count=len(part) - k + 1)


def shingle_set(text: str, k: int) -> np.ndarray:
    """The hashes of all shingles of the text, each once; no words: none."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *_hashes(text, k)]))


def minima(shingles: np.ndarray, plan: Plan) -> list[int]:
    """A key for each band: of one permutation's minima in bands * rows bins; an empty bin takes that of the next ones."""
    n = plan.bands * plan.rows
    z = _mixed(shingles, plan.lanes + 1)
    bins, value = z % np.uint64(n), z // np.uint64(n)
    order = np.lexsort((value, bins))
    held, first = np.unique(bins[order], return_index=True)
    least = np.zeros(n, dtype=np.uint64)
    if len(held):
        at = np.searchsorted(held, np.arange(n, dtype=np.uint64)) % len(held)  # the bin itself or the next that is held
        far = (held[at].astype(np.int64) - np.arange(n)) % n
        least = value[order][first][at] * np.uint64(1024) + far.astype(np.uint64)
    return [xxhash.xxh64_intdigest(least[i * plan.rows: (i + 1) * plan.rows].tobytes(), i) for i in range(plan.bands)]


def fingerprint(text: str, plan: Plan = EXACT) -> list[int]:
    """The lanes of a text's fingerprint; no words: zeros."""
    return majority(_hashes(text, plan.shingle), plan)


def majority(hashes, plan: Plan) -> list[int]:
    """The lanes of the bits that more than half of the hashes have."""
    total = 0
    ones = np.zeros((plan.lanes, 64), dtype=np.int64)
    for h in hashes:
        total += len(h)
        for lane in range(plan.lanes):
            bits = np.unpackbits(_mixed(h, lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[lane] += bits.sum(axis=0, dtype=np.int64)
    return [sum(1 << int(b) for b in np.flatnonzero(row * 2 > total)) for row in ones]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(texts: DataFrame, plan: Plan = EXACT) -> DataFrame:
    """texts (text, and others that stay) with the lanes f0, f1, ... as longs in place of the text.

    Under a plan with a similarity the lanes are those of the set of shingles, and the set's digest
    (d0, d1) and its bands (b0, b1, ...) follow.
    """
    names = _lanes(plan) + (["d0", "d1", *_bands(plan)] if plan.similarity is not None else [])
    rest = [f for f in texts.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, *[T.StructField(c, T.LongType()) for c in names]])

    def numbers(text: str) -> list[int]:
        if plan.similarity is None:
            return [_signed(x) for x in fingerprint(text, plan)]
        s = shingle_set(text, plan.shingle)
        whole = xxhash.xxh128_intdigest(s.tobytes(), len(s) & 0xFFFFFFFF)
        lanes = majority((s[i: i + CHUNK] for i in range(0, len(s), CHUNK)), plan)
        return [_signed(x) for x in (*lanes, whole >> 64, whole & (2**64 - 1), *minima(s, plan))]

    def run(batches):
        for b in slices(batches):
            found = np.array([numbers(t) for t in b.column("text").to_pylist()], dtype=np.int64).reshape(b.num_rows, len(names))
            cols = [pa.array(found[:, i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in rest], *cols], names=schema.fieldNames())

    return texts.mapInArrow(run, schema)


def _lanes(plan: Plan) -> list[str]:
    return [f"f{i}" for i in range(plan.lanes)]


def _bands(plan: Plan) -> list[str]:
    return [f"b{i}" for i in range(plan.bands)]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(member, least member) for the components of the links a-b among n rows."""
    up = {}

    def root(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in list(up) if root(x) != x]


def farthest(f: np.ndarray, n: int) -> list[np.ndarray]:
    """Up to n rows, each the farthest from those before it: one of each cluster, if there are no more than n."""
    out, least = [f[0]], np.bitwise_count(f ^ f[0]).sum(axis=1, dtype=np.int16)
    while len(out) < n and least.max() > 0:
        out.append(f[int(least.argmax())])
        least = np.minimum(least, np.bitwise_count(f ^ out[-1]).sum(axis=1, dtype=np.int16))
    return out


def linked(buckets: np.ndarray, prints: np.ndarray, nodes: np.ndarray, plan: Plan) -> list[tuple[int, int]]:
    """Edges (node, node) of a spanning forest of each bucket's links; rows are sorted by bucket."""
    n, limit = len(buckets), plan.bits
    if n < 2:
        return []
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    sizes = np.diff(np.r_[starts, n])
    size_of = np.repeat(sizes, sizes)
    few = np.flatnonzero((size_of > 1) & (size_of <= SMALL))
    out: list[tuple[int, int]] = []
    refs = plan.references()

    def away(f: np.ndarray, pivots) -> np.ndarray:
        """Distances of each row to the pivots: one fingerprint for all rows, or one for each."""
        return np.stack([np.bitwise_count(f ^ r).sum(axis=1, dtype=np.int16) for r in pivots], axis=1)

    if len(few):
        f, g, key = prints[few], buckets[few], nodes[few]
        own = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        count = np.diff(np.r_[own, len(g)])
        # Members of the bucket at even spaces, or the references.
        members = [f[np.repeat(own + count * k // plan.pivots, count)] for k in range(plan.pivots)]
        dist, links_a, links_b = away(f, members if plan.bands else refs), [], []
        for off in range(1, int(sizes[sizes <= SMALL].max())):
            i = np.flatnonzero(g[off:] == g[:-off])
            if not len(i):
                break
            i = i[np.abs(dist[i] - dist[i + off]).max(axis=1) <= limit]
            i = i[np.bitwise_count(f[i] ^ f[i + off]).sum(axis=1, dtype=np.int16) <= limit]
            links_a.append(i)
            links_b.append(i + off)
        if links_a:
            out += [(int(key[x]), int(key[y])) for x, y in _forest(len(few), np.concatenate(links_a), np.concatenate(links_b))]
    for s, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        f, key = prints[s: s + m], nodes[s: s + m]
        dist = away(f, farthest(f, plan.pivots) if plan.bands else refs)
        order = np.argsort(dist[:, 0], kind="stable")
        alive, first = order, dist[order, 0]
        for seed in order.tolist():
            at = np.searchsorted(first, dist[seed, 0])
            here = np.flatnonzero(alive[at:] == seed) if len(alive) else []
            if not len(here):
                continue  # reached already
            alive, first = np.delete(alive, at + here[0]), np.delete(first, at + here[0])
            reach = [seed]
            while reach:
                x = reach.pop()
                lo = np.searchsorted(first, dist[x, 0] - limit, "left")
                hi = np.searchsorted(first, dist[x, 0] + limit, "right")
                near = alive[lo:hi]
                spot = np.flatnonzero(np.abs(dist[near] - dist[x]).max(axis=1) <= limit)
                spot = spot[np.bitwise_count(f[near[spot]] ^ f[x]).sum(axis=1, dtype=np.int16) <= limit]
                if len(spot):
                    hit = near[spot]
                    out += [(int(key[y]), int(key[seed])) for y in hit.tolist()]
                    reach += hit.tolist()
                    alive, first = np.delete(alive, lo + spot), np.delete(first, lo + spot)
    return out


def links(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Edges (u, v) whose components are those of all links within plan.bits that share a bucket; nodes: node, lanes and bands."""
    lanes = _lanes(plan)
    if plan.bands:
        buckets = [F.xxhash64(F.lit(t), F.col(c)) for t, c in enumerate(_bands(plan))]
    else:
        buckets = [
            F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(lanes, masks)])
            for t, masks in enumerate(plan.tables())
        ]
    dealt = nodes.select("node", *lanes, F.explode(F.array_distinct(F.array(*buckets))).alias("bucket"))
    counted = settle(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("rep")).filter("n > 1"), "bucket-sizes")
    large, star = settle(counted.filter(F.col("n") > TILE).select("bucket", "rep"), "large-buckets"), None  # its size is known, so Spark may broadcast it
    if not large.isEmpty():
        firsts = nodes.select(F.col("node").alias("rep"), *[F.col(c).alias(f"r{c}") for c in lanes])
        near = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"r{c}"))) for c in lanes) <= plan.bits
        hot = settle(dealt.join(large.join(firsts, "rep"), "bucket").select("node", *lanes, "bucket", "rep", near.alias("near")), "hot-buckets")
        star = hot.filter("near AND node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
        dealt = dealt.join(large, "bucket", "left_anti").select("node", *lanes, "bucket").unionByName(
            _in_tiles(hot, "bucket", "node", F.lit(1), TILE).select("node", *lanes, F.col("tile").alias("bucket")))
    sorted_ = dealt.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        kept = None
        for b in batches:
            if kept is not None:
                b = pa.Table.from_batches([kept, b]).combine_chunks()
                b = b.to_batches()[0]
            keys = b.column("bucket").to_numpy()
            if len(keys) and keys[0] == keys[-1]:
                kept = b
                continue
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            yield from edges(b.slice(0, cut))
            kept = b.slice(cut)
        if kept is not None:
            yield from edges(kept)

    def edges(b):
        if b.num_rows < 2:
            return
        prints = np.stack([b.column(c).to_numpy().view(np.uint64) for c in lanes], axis=1)
        out = linked(b.column("bucket").to_numpy(), prints, b.column("node").to_numpy(), plan)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])

    found = sorted_.mapInArrow(run, "u long, v long")
    return found if star is None else found.unionByName(star)


def _in_tiles(hot: DataFrame, key: str, item: str, load, tile: int) -> DataFrame:
    """hot rows (key, item, near) with a `tile` for each task that compares them; rows of a tile share it.

    Rows that are near their key's first row are linked to it, hence to one another, and are not compared
    again: only the far ones meet each other and the near ones, by pairs of parts of about `tile` load. So
    a group of copies, however large, costs a pass, and the rest costs pairs with it.
    """
    sizes = hot.groupBy(key).agg(*[
        F.ceil(F.coalesce(F.sum(F.when(side, load)), F.lit(0)) / tile).cast("int").alias(n) for n, side in (("near_parts", F.col("near")), ("far_parts", ~F.col("near")))
    ])
    placed = hot.join(settle(sizes, "hot-sizes"), key)
    part = lambda n: F.pmod(F.xxhash64(item), F.col(n)).cast("int")
    upto = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(F.array().cast("array<bigint>"))
    far, near = part("far_parts"), part("near_parts")
    among = upto("far_parts", lambda j: F.xxhash64(key, F.lit("far"), F.least(far, j), F.greatest(far, j)))
    across = upto("near_parts", lambda i: F.xxhash64(key, F.lit("near"), far, i))
    tiles = F.when(F.col("near"), upto("far_parts", lambda j: F.xxhash64(key, F.lit("near"), j, near))).otherwise(F.concat(among, across))
    return placed.withColumn("tile", F.explode(tiles)).drop("near_parts", "far_parts")


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of a spanning forest of the links between sets at that Jaccard similarity; each pair is a link."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    names, flat = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *[sets[i] for i in order]]), return_inverse=True)
    ends = np.cumsum(sizes[order])
    begins = ends - sizes[order]
    alive = np.arange(len(sets))  # places in the order of sizes that no link reaches so far
    mine = np.zeros(len(names), dtype=bool)
    out: list[tuple[int, int]] = []
    while len(alive):
        reach, alive = [int(alive[0])], alive[1:]
        while reach and len(alive):
            x = reach.pop()
            n = int(ends[x] - begins[x])
            # A set of a size beyond these bounds cannot be similar enough.
            there = sizes[order[alive]]
            lo, hi = np.searchsorted(there, n * similarity - 1e-9, "left"), np.searchsorted(there, n / similarity + 1e-9, "right")
            near = alive[lo:hi]
            if not len(near):
                continue
            mine[flat[begins[x]: ends[x]]] = True
            spans = [mine[flat[begins[y]: ends[y]]] for y in near.tolist()]
            mine[flat[begins[x]: ends[x]]] = False
            common = np.fromiter(map(np.count_nonzero, spans), dtype=np.int64, count=len(near))
            hit = np.flatnonzero(common >= similarity * (n + there[lo:hi] - common) - 1e-9)
            if len(hit):
                out += [(int(order[y]), int(order[x])) for y in near[hit].tolist()]
                reach += near[hit].tolist()
                alive = np.delete(alive, lo + hit)
    return out


def _confirmed(candidates: DataFrame, plan: Plan) -> DataFrame:
    """Edges (u, v) of items that are similar enough; candidates: item, root (of its group of candidates), text."""

    def read(batches):
        for b in slices(batches):
            sets = [shingle_set(t, plan.shingle) for t in b.column("text").to_pylist()]
            held = pa.array([s.tobytes() for s in sets], pa.binary())
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("root"), size, held], names=["item", "root", "size", "shingles"])

    sets = settle(candidates.select("item", "root", "text").mapInArrow(read, "item long, root long, size long, shingles binary"), "near-sets")
    load = F.col("size") + 64  # a row has its own cost
    large, star = settle(sets.groupBy("root").agg(F.sum(load).alias("load")).filter(F.col("load") > SET_TILE).select("root"), "large-groups"), None
    dealt = sets.join(large, "root", "left_anti").select("item", "shingles", F.xxhash64("root").alias("tile"))
    if not large.isEmpty():
        many = sets.join(large, "root", "left_semi")
        firsts = many.filter("item = root").select("root", F.col("shingles").alias("first"))

        def compare(batches):
            for b in slices(batches, 64):
                near, last, first = [], None, None
                for s, f in zip(b.column("shingles"), b.column("first").to_pylist()):
                    if f is not last:
                        last, first = f, np.frombuffer(f, dtype=np.uint64)
                    s = np.frombuffer(s.as_py(), dtype=np.uint64)
                    common = len(np.intersect1d(s, first, assume_unique=True))
                    near.append(common >= plan.similarity * (len(s) + len(first) - common) - 1e-9)
                keep = [b.column(c) for c in ("item", "root", "size", "shingles")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(near, pa.bool_())], names=["item", "root", "size", "shingles", "near"])

        met = many.join(firsts, "root").select("item", "root", "size", "shingles", "first")
        hot = settle(met.mapInArrow(compare, "item long, root long, size long, shingles binary, near boolean"), "hot-sets")
        star = hot.filter("near AND item <> root").select(F.col("item").alias("u"), F.col("root").alias("v"))
        dealt = dealt.unionByName(_in_tiles(hot, "root", "item", load, SET_TILE).select("item", "shingles", "tile"))
    sorted_ = dealt.repartition("tile").sortWithinPartitions("tile")

    def run(batches):
        key, items, held = None, [], []
        for b in slices(batches):
            for t, i, s in zip(b.column("tile").to_pylist(), b.column("item").to_pylist(), b.column("shingles")):
                if t != key:
                    yield from edges(items, held)
                    key, items, held = t, [], []
                items.append(i)
                held.append(np.frombuffer(s.as_py(), dtype=np.uint64))
        yield from edges(items, held)

    def edges(items, held):
        out = alike(held, plan.similarity) if len(items) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([items[x] for x, _ in out], pa.int64()), pa.array([items[y] for _, y in out], pa.int64())], names=["u", "v"])

    found = sorted_.mapInArrow(run, "u long, v long")
    return found if star is None else found.unionByName(star)


def near_groups(docs: DataFrame, plan: Plan = EXACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, fingerprint (hex), component_id (least id of its group),
    group_key (of the group itself, should ids repeat), file, row.

    Null texts are empty; texts without words share the fingerprint zero and are linked like any
    other. Null ids are greater than all others. Rows that repeat are in one group. An empty table
    gives no row. Other columns are not read. Under a plan with a similarity, rows of one fingerprint
    may be in different groups.
    """
    return _groups(located(docs, "near-docs"), plan, id_col, text_col)


def _texts(spots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    field = F.col("doc").getField
    return spots.select(field(id_col).alias("doc_id"), "file", "row", text_of(field(text_col)).alias("text"))


def _groups(spots: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    lanes = _lanes(plan)
    rows = settle(fingerprints(_texts(spots, id_col, text_col), plan).withColumn("item", F.monotonically_increasing_id()), "fingerprints")
    hexed = F.lower(F.concat(*[F.lpad(F.hex(F.col(c)), 16, "0") for c in reversed(lanes)]))
    same = lanes if plan.similarity is None else ["d0", "d1"]  # what makes rows one node
    more = [F.any_value(c).alias(c) for c in ([] if plan.similarity is None else lanes + _bands(plan))]
    counted = rows.groupBy(*same).agg(F.min("doc_id").alias("least"), F.min("item").alias("node"), *more)
    nodes = settle(counted, "near-nodes")  # a node is the first of its rows
    exact = plan.similarity is None
    between = (lambda: None) if exact else (lambda: tidy(spots.sparkSession))  # a stage of many rounds, each leaves its plans
    groups = components(links(nodes, plan), between=between)
    if not exact:
        between()
        held = settle(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), "near-candidates")  # roots are not among the nodes
        spotted = settle(rows.select("item", "file", "row").join(held.withColumnRenamed("node", "item"), "item"), "near-spotted")
        texts = _texts(picked(spots, spotted), id_col, text_col).drop("doc_id").join(spotted, ["file", "row"])
        groups = components(_confirmed(texts, plan), between=between)
        between()
    named = nodes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = settle(named.groupBy("root").agg(F.min("least").alias("component_id")), "near-ids")  # so a hot group's join can be split
    by_node = settle(named.join(ids, "root").select(*same, "component_id", F.col("root").alias("group_key")), "near-components")
    return rows.join(by_node, same).select("doc_id", hexed.alias("fingerprint"), "component_id", "group_key", "file", "row")


def drop_near_copies(docs: DataFrame, plan: Plan = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: the one with the least id, then locator. Documents are not shuffled."""
    spots = located(docs, "near-docs")
    found = settle(_groups(spots, plan, id_col, text_col), "near-found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    stays = found.groupBy("group_key").agg(F.min(order).alias("at")).select("at.file", "at.row")
    return picked(spots, stays).select("doc.*")
