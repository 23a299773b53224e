"""Helpers that the corpus operators share: shared-folder tables, joins on hot keys, Arrow batches, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where that is unset and all is one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):  # the session may be gone; nothing depends on this
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(drop)
    return path


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, fixes what is not deterministic."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes to be no column yet (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_hot(big: DataFrame, small: DataFrame, key: str, size: str, total: int, share: int = 1000, few: int = 0, hot_if: Column | None = None, inner: bool = False) -> DataFrame:
    """Left join of ``big`` to ``small`` (unique in ``key``; ``size`` = rows of ``big`` that have the key).

    Keys that have at least total/share rows are at most ``share`` many, so those rows of ``small`` are broadcast whatever the
    input's size (``hot_if`` bounds their width where it isn't fixed); the rows of ``big`` they serve are scattered in the shuffled
    join of the rest. A ``small`` of at most ``few`` rows (counted) is broadcast as a whole; pass that only where its rows have a fixed width.
    """
    least = max(1000, total // share)
    out = [c for c in small.columns if c != key]
    if few and small.limit(few + 1).count() <= few:
        return big.join(F.broadcast(small), key, "inner" if inner else "left").select(*big.columns, *out)
    is_hot = F.coalesce((F.col(size) >= least) & (F.lit(True) if hot_if is None else hot_if), F.lit(False))
    if inner:  # rows of hot keys stay where they are
        few_hot, cold = F.broadcast(small.where(is_hot)), small.where(~is_hot)
        rest = big.join(F.broadcast(small.where(is_hot).select(key)), key, "left_anti")
        return big.join(few_hot, key).select(*big.columns, *out).unionByName(rest.join(cold, key).select(*big.columns, *out))
    hot = small.where(is_hot).select(F.col(key).alias("_hk"), F.struct(*out).alias("_hot"))
    tagged = big.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").drop("_hk")
    tagged = tagged.withColumn("_js", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*big.columns).bitwiseOR(F.lit(1))))
    rest = small.where(~is_hot).select(F.col(key).alias("_jk"), F.pmod(F.hash(F.col(key)), F.lit(1)).cast("long").alias("_j0"), F.struct(*out).alias("_rest"))  # 0, but no literal, which Catalyst would take out of the join's keys
    joined = tagged.join(rest, (F.col(key) == F.col("_jk")) & (F.col("_js") == F.col("_j0")), "left").withColumn("_got", F.coalesce("_hot", "_rest"))
    return joined.select(*big.columns, *[F.col(f"_got.{c}").alias(c) for c in out])


def crc32_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def text_col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and their n+1 offsets from 0. No copy of the data."""
    col = pa.concat_arrays([col]) if col.offset else col
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[: len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(it: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``most`` bytes of text each (one row at least), so that numpy's work arrays stay small."""
    for batch in it:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


# ---- what a worker remembers ----

_owner: list = ["", None]


def only(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Call at the start of a task. A Python worker serves tasks of one operator after another and would keep what each remembers
    (words, tables); now it forgets what another operator left, and freed memory goes back to the system."""
    if _owner[0] != owner:
        if _owner[1]:
            _owner[1]()
        _owner[:] = [owner, forget]
        gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)



class Known(dict):
    """Word -> its number. A word that is asked for first is put on the list ``new`` and has the number -1 - place until it is learnt."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, word) -> int:
        self[word] = n = -1 - len(self.new)
        self.new.append(word)
        return n


def segments(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut at blanks (which go), so that a long text's words are never all held as strings."""
    a = 0
    while (b := text.find(" ", a + most)) >= 0:
        yield text[a:b]
        a = b + 1
    yield text[a:]


def ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... n[0] numbers, then those of starts[1], and so on."""
    at = np.cumsum(n) - n
    return np.repeat(starts - at, n) + np.arange(int(n.sum()))


# ---- hashing of words and shingles, vectorised over a batch ----

_B = np.uint64(0x9E3779B97F4A7C13)  # odd, 3 mod 8
_BI = np.uint64(pow(int(_B), -1, 1 << 64))
def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public domain constants of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_RAND = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_BLOCK = 1 << 20
_POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_BLOCK, _B, np.uint64)]))
_INV = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_BLOCK, _BI, np.uint64)]))


def _words(buf: np.ndarray, off: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block: starts, ends, and hashes before mixing (polynomials of the bytes, from each word's start)."""
    solid = ~apart[buf]
    first = np.empty(len(buf), bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    inner = off[1:-1][off[1:-1] < len(buf)]
    first[inner] = True
    starts = np.flatnonzero(solid & first)
    last = np.empty(len(buf), bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    last[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(solid & last) + 1
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_RAND[_LOWER[buf]] * _POW[: len(buf)], out=run[1:])
    return starts, ends, (run[ends] - run[starts]) * _INV[starts]


def words(buf: np.ndarray, off: np.ndarray, apart: np.ndarray = _SPACE, most: int = _BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch, A-Z lower-cased: starts, ends, 64-bit hashes, and the n+1 word offsets of the texts.

    ``apart`` tells which of the 256 bytes stand between words: ASCII white space by default. The bytes are worked on in blocks of
    ``most`` (at most 2^20), also within a text: a word that goes on in the next block has its two hashes joined. So the work arrays
    stay small however long a text is; what is returned has 24 bytes a word.
    """
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    open_word = False  # the last word found may go on
    for a in range(0, len(buf), most):
        block = buf[a : a + most]
        lo, hi = np.searchsorted(off, [a, a + len(block)], side="left")
        cuts = np.concatenate([[0], off[lo:hi] - a, [len(block)]])
        s, e, h = _words(block, cuts, apart)
        s, e = s + a, e + a
        if open_word and len(s) and s[0] == a and (lo == hi or off[lo] != a or not len(off)):
            ps, pe, ph = parts[-1]
            n = int(pe[-1] - ps[-1])
            ph[-1:] += h[:1] * np.uint64(pow(int(_B), n, 1 << 64))
            pe[-1] = e[0]
            s, e, h = s[1:], e[1:], h[1:]
        if len(s):
            parts.append((s, e, h))
        open_word = bool(parts[-1][1].size and parts[-1][1][-1] == a + len(block))
    starts, ends, h = (np.concatenate(x) for x in zip(*parts))
    return starts, ends, mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, off)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes; fewer words give one hash of the whole sequence, none give none."""
    if not len(h):
        return h
    n = min(k, len(h))
    s = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        s = s * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i]
    return mix(s + np.uint64(n))
