"""MinHash near-dedup with odd sketches.

Per document: the set of word shingles (64-bit hashes), HASHES MinHash samples in BANDS bands, and an odd sketch, the samples folded
into a bitmap of parities, so that the population count of two sketches' XOR estimates how many samples differ.

1. Documents with equal sets are one class (grouped by a 128-bit digest, pre-aggregated); one class is one node from here on, with a
   number of its own.
2. Nodes that share a band bucket are compared by sketch inside the bucket's task, which emits at most one edge per member: a seed
   takes all members that may be similar, then these are seeds for what is left. That is the exact closure of "may be similar"
   without emitting pairs. Buckets over CELL members are dealt as a grid of cells, so no task gets an unbounded one.
3. The components of these edges are candidate clusters: every true link lies within one. The full shingle sets of their members are
   computed from the texts and sent to their cluster's task once (large clusters again as a grid of cells), where links are confirmed
   on the full sets in the same seed-by-seed way: pairs are only left out when both ends are already in one component.
4. Components of the confirmed links.

With 32 bands of 4 rows a pair at similarity 0.8 misses all buckets with probability 5e-8; the sketch lets pass what it estimates at
about 0.55 or more (over five deviations below 0.8). No document, bucket or cluster is capped. Joins to what many rows share (a
bucket's size, a cluster's grid, a component's name, a class) broadcast the hot ones and scatter their rows.

Defined results: a null, empty or blank text has no shingles, is linked with nothing and is its own component; fewer words than a
shingle give one shingle. Repeated rows have equal sets and share a component; rows with one id and different texts are documents of
their own, linked by their texts alone. Rows with a null id belong to their component; if no
member has an id, component_id is null; such a row is ``kept`` only in a component without ids. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import join_hot, mix, only, shingle_hashes, slices, stash, text_col, utf8, words
from .components import components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BITS = 512
MOST = 96  # differing sketch bits that may still be similar: estimates of about 0.55
CELL = 4096  # members of a bucket cell
CELL_SHINGLES, CELL_MEMBERS = 400_000, 1024  # shingles and members of a cluster cell
_ODD = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z lower-cased, words are runs without ASCII white space."""
    _, _, h, at = words(*utf8(texts))
    return [np.unique(shingle_hashes(h[a:b], k)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def minhash(s: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(s), 1024):
        np.minimum(low, (s[a : a + 1024] * _ODD[:, None]).min(1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (number, sample) pairs, as words of 64 bits."""
    bit = mix(low + np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.uint64)


def estimate(differ: np.ndarray | int) -> np.ndarray:
    """Similarity from the number of differing sketch bits."""
    return 1 + BITS / (4 * HASHES) * np.log(np.maximum(1e-9, 1 - 2 * np.asarray(differ) / BITS))


_SIG = "doc_id long, place long, n_shingles long, digest string, bands array<long>, sketch binary"


def _signs(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("near")
        for part in slices(it, "text", 1 << 20):
            n, digest, bands, sketch = [], [], [], []
            for s in sets_of(text_col(part, "text"), k):
                n.append(len(s))
                if len(s):
                    low = minhash(s)
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                    bands.append(band_keys(low).view(np.int64))
                    sketch.append(odd_sketch(low).tobytes())
                else:
                    digest.append(None)
                    bands.append(None)
                    sketch.append(None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("place"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "place", "n_shingles", "digest", "bands", "sketch"])

    return run


def closure(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Spanning edges of the graph over 0..n-1 whose links ``near(seed, others)`` tells (booleans): each seed with the ones it takes.
    Only members not yet reached are compared, so a group of like members costs one comparison each."""
    left = np.arange(n)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            seed = queue.pop()
            hit = near(seed, left)
            if hit.any():
                yield seed, left[hit]
                queue += left[hit].tolist()
                left = left[~hit]


def _groups(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows that are equal in the first ``keys`` columns (sorted), as lists of slices."""
    held, last = [], None
    for batch in it:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held


class Edges:
    """Collects edges into batches."""

    def __init__(self) -> None:
        self.a, self.b = [], []

    def add(self, a: int, b: np.ndarray) -> None:
        self.a.append(np.full(len(b), a))
        self.b.append(b)

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.a and sum(map(len, self.a)) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(self.a)), pa.array(np.concatenate(self.b))], ["a", "b"])
            self.a, self.b = [], []


def _stack(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, size and sketch words of a cell's rows, each node once."""
    node = np.concatenate([p.column("node").to_numpy() for p in parts])
    size = np.concatenate([p.column("n_shingles").to_numpy() for p in parts])
    raw = b"".join(x for p in parts for x in p.column("sketch").to_pylist())
    return node, size, np.frombuffer(raw, np.uint64).reshape(len(node), BITS // 64)


def may_be_similar(sketch: np.ndarray, size: np.ndarray, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    def near(seed: int, others: np.ndarray) -> np.ndarray:
        low, high = np.minimum(size[seed], size[others]), np.maximum(size[seed], size[others])
        fits = 100 * low >= percent * high
        fits[fits] = np.bitwise_count(sketch[others[fits]] ^ sketch[seed]).sum(1) <= MOST
        return fits

    return near


def _bucket_edges(percent: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Edges()
        for parts in _groups(it, 3):
            node, size, sketch = _stack(parts)
            for seed, taken in closure(len(node), may_be_similar(sketch, size, percent)):
                out.add(node[seed], node[taken])
            yield from out.flush(8192)
        yield from out.flush(1)

    return run


def _member_sets(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("near")
        seen = np.zeros(0, np.int64)  # nodes of this task: rows with the same id and text come to one task
        for part in slices(it, "text", 2 << 20):
            fresh = part.column("node").to_numpy()
            _, first = np.unique(fresh, return_index=True)
            part = part.take(pa.array(np.sort(first[~np.isin(fresh[first], seen)])))
            seen = np.concatenate([seen, part.column("node").to_numpy()])
            sets = sets_of(text_col(part, "text"), k)
            right = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() == d for s, d in zip(sets, part.column("digest").to_pylist())]
            names = ["cluster", "grid", "node", "n_shingles", "sketch"]
            full = pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array([s.tobytes() for s in sets], pa.binary())], [*names, "shingles"])
            yield full.filter(pa.array(right))

    return run


def confirmed(node: np.ndarray, size: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Spanning edges of the links that hold on the full sets."""
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(code.max()) + 1, np.int32)
    maybe = may_be_similar(sketch, size, percent)

    def near(seed: int, others: np.ndarray) -> np.ndarray:
        hit = maybe(seed, others)
        some = others[hit]
        if len(some):
            mine = code[off[seed] : off[seed + 1]]
            mark[mine] = 1
            n = size[some]
            at = np.cumsum(n) - n
            rows = np.repeat(off[some] - at, n) + np.arange(int(n.sum()))
            both = np.add.reduceat(mark[code[rows]], at)
            mark[mine] = 0
            hit[hit] = 100 * both >= percent * (n + size[seed] - both)
        return hit

    yield from closure(len(node), near)


def _cluster_edges(percent: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Edges()
        for parts in _groups(it, 3):
            node, size, sketch = _stack(parts)
            sets = [np.frombuffer(x, np.uint64) for p in parts for x in p.column("shingles").to_pylist()]
            _, first = np.unique(node, return_index=True)
            for seed, taken in confirmed(node[first], size[first], sketch[first], [sets[i] for i in first], percent):
                out.add(node[first][seed], node[first][taken])
            yield from out.flush(8192)
        yield from out.flush(1)

    return run


def _cells(df: DataFrame, grid: str, salt: str) -> DataFrame:
    """Deals each row of a group with a grid of g x g to the g cells of its line: (i, j) with i <= j; g = 1 is one cell."""
    mine = F.pmod(F.xxhash64(F.col(salt)), F.col(grid))
    lines = F.transform(F.sequence(F.lit(0), F.col(grid) - 1), lambda t: F.struct(F.least(mine, t.cast("long")).alias("i"), F.greatest(mine, t.cast("long")).alias("j")))
    return df.withColumn("_c", F.explode(lines)).withColumn("ci", F.col("_c.i")).withColumn("cj", F.col("_c.j")).drop("_c")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Links: percent * union <= 100 * intersection."""
    place = F.xxhash64("text").alias("place")  # with the id, it finds a class's text again
    rows = docs.select(F.col("doc_id").cast("long"), place, "text")
    signs = stash(rows.mapInArrow(_signs(k), _SIG), "op6-signs")
    full = signs.where("n_shingles > 0")
    found = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("at")
    classes = full.groupBy("digest").agg(found, F.count("*").alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "op6-classes")  # written: from here on the numbers are facts

    keys = classes.select("node", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keys = join_hot(keys, sizes, "key", "n", total).where("n IS NOT NULL")
    keys = _cells(keys.withColumn("grid", F.ceil(F.col("n") / CELL).cast("int")), "grid", "node").select("key", "ci", "cj", "node")
    sketches = classes.select("node", "n_shingles", "sketch")
    cells = keys.join(sketches, "node").select("key", "ci", "cj", "node", "n_shingles", "sketch")
    maybe = cells.repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj").mapInArrow(_bucket_edges(percent), "a long, b long")
    clusters = components(maybe)

    members = clusters.join(classes.select("node", "n_shingles", "sketch", "digest", "at"), "node").withColumnRenamed("root", "cluster")
    work = F.greatest(F.ceil(F.sum("n_shingles") / CELL_SHINGLES), F.ceil(F.count("*") / CELL_MEMBERS)).cast("int")
    weight = stash(members.groupBy("cluster").agg(work.alias("grid"), F.count("*").alias("n")), "op6-weights")
    total = weight.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = join_hot(members, weight, "cluster", "n", total).drop("n").withColumn("_i", F.col("at.doc_id")).withColumn("_p", F.col("at.place")).drop("at")
    found = rows.join(members, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("place") == F.col("_p")))
    found = found.select("cluster", "grid", "node", "n_shingles", "sketch", "digest", "text")
    sets = found.mapInArrow(_member_sets(k), "cluster long, grid int, node long, n_shingles long, sketch binary, shingles binary")
    cells = _cells(sets, "grid", "node").select("cluster", "ci", "cj", "node", "n_shingles", "sketch", "shingles")
    links = cells.repartition("cluster", "ci", "cj").sortWithinPartitions("cluster", "ci", "cj").mapInArrow(_cluster_edges(percent), "a long, b long")
    roots = components(links)

    # a component is named at the very end, by the smallest id of its classes
    known = classes.select("node", "digest", "n_docs", F.col("at.doc_id").alias("low_id")).join(roots, "node", "left")
    lows = stash(known.where("root IS NOT NULL").groupBy("root").agg(F.min("low_id").alias("low"), F.count("*").alias("m")), "op6-lows")
    total = lows.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    known = join_hot(known, lows, "root", "m", total)
    known = known.select("digest", "n_docs", F.when(F.col("root").isNull(), F.col("low_id")).otherwise(F.col("low")).alias("component_id"))
    out = join_hot(signs.select("doc_id", "n_shingles", "digest"), known, "digest", "n_docs", full.count())
    lonely = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", lonely.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
