"""Best-fit packing of tokenised documents into sequences, online and in bounded space.

Documents become byte-level BPE ids plus one end id. Only documents longer than a sequence are cut, into full pieces after a first
piece that holds the remainder. Each task packs its pieces as they come into a fixed number of open bins: a bitset with one bit per
amount of free space finds the fullest bin that still fits in a few word operations; when all bins are open and none fits, the
fullest closes. What is open at a task's end (bounded by bins * tasks) is packed once more by the same packer, largest pieces
first, over few tasks.

Ids are those of the tokenizers library as it comes, so a special token's string in a text is that token. They are remembered per word
in the worker (bounded), as byte-level BPE never merges across a blank before a word; each distinct word is encoded once, texts with
other runs of white space or a special token's string are encoded whole.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are packed like any other (pieces of such rows
can't be told apart by doc_id); an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Known, only, ranges, segments, slices, stash, text_col


class WordIds:
    """Token ids of texts, as little-endian 32-bit bytes, through a memory of words. One object per worker and tokenizer file.

    A known word's ids lie in ``flat`` from ``at`` on, ``size`` of them; -1 marks a word that makes its text irregular.
    """

    _by_path: dict[str, WordIds] = {}
    KEEP = 1_000_000

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]  # found in a text before it is cut into words
        vocab = self.tok.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for s, i in vocab.items() if s.startswith("Ġ")]] = True
        self.known, self.count, self.used = Known(), 0, 0
        self.at, self.size, self.flat = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.int32)

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> np.ndarray:
        """Ids of ' ' + word for each word, put into the tables; returns the words' numbers."""
        odd = [not w or w[0].isspace() or w[-1].isspace() for w in words]
        some = [w for w, x in zip(words, odd) if not x]
        ids, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if some:
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            first = np.flatnonzero(self.starts[ids])
            if len(first) == len(some) and first[0] == 0:
                n = np.diff(first, append=len(ids))
            else:
                each = [e.ids for e in self.tok.encode_batch_fast([" " + w for w in some], add_special_tokens=False)]
                ids, n = np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each])
        size = np.full(len(words), -1, np.int64)
        size[~np.array(odd)] = n
        self.at = _room(self.at, self.count, self.used + np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0))
        self.size = _room(self.size, self.count, size)
        self.flat = _room(self.flat, self.used, ids)
        numbers = np.arange(self.count, self.count + len(words))
        self.known.update(zip(words, numbers.tolist()))
        self.count, self.used = self.count + len(words), self.used + len(ids)
        return numbers

    def _numbers(self, words: list[str]) -> np.ndarray:
        got = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            new, self.known.new = self.known.new, []
            learnt = np.concatenate([self._learn(new[a : a + 2000]) for a in range(0, len(new), 2000)])
            got = np.where(got < 0, learnt[np.maximum(-1 - got, 0)], got)
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        before, used = self.count, self.used
        out: list[bytes] = [b""] * len(texts)
        odd = [k for k, t in enumerate(texts) if any(x in t for x in self.added)]
        skip = set(odd)
        held: list[tuple[int, list[str]]] = []  # text and words; the first of a text's words has no blank before it
        many, heads = 0, []
        for k, t in enumerate(texts):
            if k in skip:
                continue
            for j, part in enumerate(segments(t)):
                w = part.split(" ")
                if not j:
                    heads.append((k, w[0]))
                    if not w[0] or w[0][-1].isspace():
                        if len(w) > 1 or len(part) < len(t):
                            odd.append(k)
                            break
                    w = w[1:]
                held.append((k, w))
                many += len(w)
                if many > 1 << 18:
                    self._join(held, out, odd)
                    held, many = [], 0
        self._join(held, out, odd)
        for (k, _), ids in zip(heads, self._ids([h for _, h in heads])):
            out[k] = ids + out[k]
        for k, ids in zip(odd, self._ids([texts[k] for k in odd])):
            out[k] = ids
        if self.count > self.KEEP:  # what this batch added goes; the words known before stay
            for w in list(itertools.islice(reversed(self.known), self.count - before)):
                del self.known[w]
            self.count, self.used = before, used
        return out

    def _join(self, held: list[tuple[int, list[str]]], out: list[bytes], odd: list[int]) -> None:
        numbers = self._numbers(list(itertools.chain.from_iterable(w for _, w in held)))
        size = self.size[numbers]
        ends = np.cumsum([len(w) for _, w in held])
        strange = np.flatnonzero(size < 0)
        odd += {held[i][0] for i in np.searchsorted(ends, strange, side="right").tolist()}
        size = np.maximum(size, 0)
        ids = self.flat[ranges(self.at[numbers].astype(np.int64), size.astype(np.int64))].astype("<u4")
        stops = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], ends]).astype(np.int64)]
        for (k, _), a, b in zip(held, stops.tolist(), stops[1:].tolist()):
            out[k] += ids[a:b].tobytes()


def _room(old: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``old`` with ``more`` after the ``used`` entries; grows by doubling."""
    if used + len(more) > len(old):
        wide = np.zeros(max(used + len(more), 2 * len(old)), old.dtype)
        wide[:used] = old[:used]
        old = wide
    old[used : used + len(more)] = more
    return old


class OpenBins:
    """Best-fit over at most ``most`` open bins of ``size``. ``add`` returns (bin, offset, bin that closed or None)."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most, self.free, self.open, self.next = size, most, 0, 0, 0
        self.at: dict[int, list[int]] = {}  # free space -> open bins; bit f of self.free says that at[f] isn't empty

    def _put(self, b: int, space: int) -> None:
        self.at.setdefault(space, []).append(b)
        self.free |= 1 << space

    def _take(self, space: int) -> int:
        b = self.at[space].pop()
        if not self.at[space]:
            self.free &= ~(1 << space)
        return b

    def add(self, n: int) -> tuple[int, int, int | None]:
        fits = self.free >> n
        closed = None
        if fits:
            space = n + ((fits & -fits).bit_length() - 1)
            b = self._take(space)
        else:
            if self.open >= self.most:
                closed = self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            b, space, self.next = self.next, self.size, self.next + 1
            self.open += 1
        if space == n:
            self.open -= 1
            return b, self.size - space, b if closed is None else closed
        self._put(b, space - n)
        return b, self.size - space, closed


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long, open boolean"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _PIECE)], schema=_PIECE)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the remainder first, then full ones."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


class Packer:
    """Packs rows as they come; full and closed bins' rows are ready at once, those of open bins wait (most * size ids at worst)."""

    def __init__(self, size: int, bins: int, base: int) -> None:
        self.bins, self.size, self.base = OpenBins(size, bins), size, base
        self.waiting: dict[int, list[tuple]] = {}
        self.ready: list[tuple] = []
        self.alone = 0

    def add(self, row: tuple) -> None:
        """row: doc_id, piece, start, length, crc, ids."""
        if row[3] == self.size:  # a full piece is a sequence; odd numbers are theirs
            self.ready.append((*row, self.base + 2 * self.alone + 1, 0, False))
            self.alone += 1
            return
        b, offset, _ = self.bins.add(row[3])
        self.waiting.setdefault(b, []).append((*row, self.base + 2 * b, offset, False))
        if _ is not None:
            self.ready += self.waiting.pop(_)
        if _ != b and offset + row[3] == self.size and b in self.waiting:
            self.ready += self.waiting.pop(b)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.ready:
            yield _batch(self.ready)
            self.ready = []

    def rest(self) -> Iterator[pa.RecordBatch]:
        rows = [(*r[:-1], True) for b in self.waiting.values() for r in b]
        for k in range(0, len(rows), 4096):
            yield _batch(rows[k : k + 4096])


def _packs(path: str, size: int, bins: int, end_id: int, with_ids: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("packing", WordIds._by_path.clear)
        coder, packer = WordIds.of(path), Packer(size, bins, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4").tobytes()
        for part in slices(it, "text"):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), coder.encode(text_col(part, "text").to_pylist())):
                ids += end
                for k, (s, n) in enumerate(cut(len(ids) // 4, size)):
                    body = ids[4 * s : 4 * (s + n)]
                    packer.add((doc_id, k, s, n, zlib.crc32(body), body if with_ids else None))
            yield from packer.flush()
        yield from packer.rest()

    return run


def _repacks(size: int, bins: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, bins, (1 << 62) + (TaskContext.get().partitionId() << 40))
        for batch in it:
            cols = [batch.column(n).to_pylist() for n in _PIECE.names[:6]]
            for row in zip(*cols):
                packer.add(row)
            yield from packer.flush()
        for batch in packer.rest():
            yield batch.set_column(8, "open", pa.array([False] * batch.num_rows))

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, bins: int = 256, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (null unless with_ids), sequence_id, offset.

    ``tokenizer_path`` must exist on every executor (the installed tokenizer package).
    """
    spark = docs.sparkSession
    pieces = stash(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_packs(tokenizer_path, size, bins, end_id, with_ids), _DDL), "op9-pieces")
    rest = pieces.where("open")
    tasks = max(1, rest.count() // 100_000)
    again = rest.withColumn("_t", F.pmod(F.xxhash64("sequence_id"), F.lit(tasks)))
    again = again.repartition(tasks, "_t").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32").drop("_t")
    done = again.mapInArrow(_repacks(size, 1 << 14), _DDL)
    return pieces.where(~F.col("open")).unionByName(done).drop("open")
