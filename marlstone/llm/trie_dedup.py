"""Exact dedup by Patricia-trie owners.

Each map task first folds equal texts in a trie of its own (bounded by bytes, flushed when full). What is left, one row per
distinct text and flush, goes to the owner of its (normalised length, content hash). Owners insert the full byte strings into a
compressed radix trie whose terminal nodes keep the best row, the smallest id and the count; beyond a byte limit the largest
subtree is spilled to Spark's own local folder (as shuffles spill; the task makes it anew if its executor is lost) and finished later.
Only bytes that are equal from end to end share a terminal: the tries decide what the groups are, which row stays and how many there
are. The rows of ``exact_dedup`` are then told their group by the SHA-256 of the normalised text, which the result carries anyway.

Defined results: a null text counts as empty; empty texts form one group; rows with a null id count in ``group_size`` but are kept
only if no row with an id has as many code points, and then all of the group's rows without an id are ``kept``; repeated rows with the same id and text are one group and are all ``kept`` if
their id is. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from struct import Struct

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WHITE, join_hot, slices, text_col

_HEAD = Struct("<IqqqqB")  # key bytes, code points, best id, smallest id, rows, 1 if there is an id
Payload = tuple[int, int, int, int, int]  # code points, best id, smallest id, rows, 1 if there is an id


def merge(a: Payload, b: Payload) -> Payload:
    """The better of two rows (most code points, then one with an id, then smallest id), the smallest id and the sum of rows."""
    best = max(a, b, key=lambda p: (p[0], p[4], -p[1]))
    ids = [p[2] for p in (a, b) if p[4]]
    return best[0], best[1], min(ids, default=0), a[3] + b[3], best[4]


#: Bytes that a node takes besides its label, about: a list, a dict, a bytes object, a payload of five numbers.
NODE = 450


class Patricia:
    """Compressed radix trie over bytes. A node is [label, children by first byte, payload or None]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def insert(self, key: bytes, payload: Payload) -> int:
        """Returns the bytes by which the trie grew, about."""
        node, at, grown = self.root, 0, 0
        while True:
            if at == len(key):
                node[2] = merge(node[2], payload) if node[2] else payload
                return grown
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, payload]
                return grown + NODE + len(key) - at
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = len(os.path.commonprefix([label, key[at : at + len(label)]])) if len(label) < 64 else self._common(label, key, at)
            fork = [label[:n], {label[n]: child}, None]
            child[0] = label[n:]
            node[1][key[at]] = fork
            node, at, grown = fork, at + n, NODE

    @staticmethod
    def _common(label: bytes, key: bytes, at: int) -> int:
        low, high = 0, min(len(label), len(key) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if label[low:mid] == key[at + low : at + mid]:
                low = mid
            else:
                high = mid - 1
        return low

    def items(self) -> Iterator[tuple[bytes, Payload]]:
        todo = [(self.root, b"")]
        while todo:
            node, prefix = todo.pop()
            full = prefix + node[0]
            if node[2]:
                yield full, node[2]
            todo += [(child, full) for child in node[1].values()]


class Owner:
    """Tries by the byte at ``depth``, the subtrees. When they hold more than ``limit`` bytes, the largest goes to a file; its
    keys are appended there from then on, and finished by an owner of their own, one level below what they have in common."""

    def __init__(self, limit: int, depth: int = 0) -> None:
        self.limit, self.depth, self.held = limit, depth, 0
        self.tries: dict[bytes, Patricia] = {}
        self.size: dict[bytes, int] = {}
        self.spilled: dict[bytes, tuple] = {}
        self.common: dict[bytes, bytes] = {}

    def insert(self, key: bytes, payload: Payload) -> None:
        sub = key[self.depth : self.depth + 1]
        if sub in self.spilled:
            self._append(sub, key, payload)
            return
        grown = self.tries.setdefault(sub, Patricia()).insert(key, payload)
        self.size[sub] = self.size.get(sub, 0) + grown
        self.held += grown
        while self.held > self.limit and len(self.tries) + len(self.spilled) > 0:
            large = max((s for s in self.tries if s), key=lambda s: self.size[s], default=None)
            if large is None:
                break
            self._spill(large)

    def _spill(self, sub: bytes) -> None:
        self.spilled[sub] = (tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None),)
        self.held -= self.size.pop(sub)
        for key, payload in self.tries.pop(sub).items():
            self._append(sub, key, payload)

    def _append(self, sub: bytes, key: bytes, payload: Payload) -> None:
        self.common[sub] = os.path.commonprefix([self.common[sub], key]) if sub in self.common else key
        self.spilled[sub][0].write(_HEAD.pack(len(key), *payload) + key)

    def items(self) -> Iterator[tuple[bytes, Payload]]:
        for trie in self.tries.values():
            yield from trie.items()
        self.tries.clear()
        for sub, (file,) in self.spilled.items():
            below = Owner(self.limit, max(self.depth + 1, len(self.common[sub])))
            with file:
                file.seek(0)
                while head := file.read(_HEAD.size):
                    n, *payload = _HEAD.unpack(head)
                    below.insert(file.read(n), tuple(payload))
            yield from below.items()


_FOLDED = pa.schema([("len", pa.int64()), ("chash", pa.int64()), ("body", pa.binary()), ("cp", pa.int64()), ("best", pa.int64()), ("low", pa.int64()), ("rows", pa.int64()), ("has", pa.int64())])
_GROUPS = pa.schema([("text_sha256", pa.string()), ("best_cp", pa.int64()), ("keep_id", pa.int64()), ("low_id", pa.int64()), ("group_size", pa.int64())])


def _rows(items: Iterator[tuple[bytes, Payload]]) -> Iterator[pa.RecordBatch]:
    """Folded rows in batches of about 4 MB."""
    out, size = [], 0
    for key, payload in items:
        out.append((len(key), xxhash.xxh3_64_intdigest(key) - (1 << 63), key, *payload))
        size += len(key) + 64
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _FOLDED)], schema=_FOLDED)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _FOLDED)], schema=_FOLDED)


def folder(flush: int):
    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = Owner(1 << 62)
        for batch in it:
            for part in slices(iter([batch]), "text"):
                texts = text_col(part, "text").cast(pa.large_binary())
                for doc_id, cp, text in zip(part.column("doc_id").to_pylist(), part.column("cp").to_pylist(), texts):
                    has = doc_id is not None
                    owner.insert(text.as_py().translate(None, WHITE), (cp, doc_id or 0, doc_id or 0, 1, int(has)))
                    if owner.held > flush:
                        yield from _rows(owner.items())
                        owner = Owner(1 << 62)
        yield from _rows(owner.items())

    return fold


def grower(limit: int):
    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = Owner(limit)
        for batch in it:
            cols = [batch.column(n) for n in ("body", "cp", "best", "low", "rows", "has")]
            for key, *payload in zip(cols[0], *(c.to_pylist() for c in cols[1:])):
                owner.insert(key.as_py(), tuple(payload))
        out = []
        for key, (cp, best, low, rows, has) in owner.items():
            out.append((hashlib.sha256(key).hexdigest(), cp, best if has else None, low if has else None, rows))
            if len(out) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _GROUPS)], schema=_GROUPS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _GROUPS)], schema=_GROUPS)

    return own


def text_groups(docs: DataFrame, flush_bytes: int = 32 << 20, trie_bytes: int = 96 << 20) -> DataFrame:
    """One row per distinct normalised text: text_sha256, best_cp, keep_id, low_id, group_size."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("cp"))
    folded = rows.mapInArrow(folder(flush_bytes), "len long, chash long, body binary, cp long, best long, low long, rows long, has long")
    return folded.repartition("len", "chash").mapInArrow(grower(trie_bytes), "text_sha256 string, best_cp long, keep_id long, low_id long, group_size long")


def exact_dedup(docs: DataFrame, flush_bytes: int = 32 << 20, trie_bytes: int = 96 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, low_id (the group's smallest id).

    Equal: identical after deleting space, tab, LF, VT, FF and CR. Of equal texts the one with the most code points stays, then
    the smallest id.
    """
    from ._shared import stash

    norm = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "")
    each = docs.select(F.col("doc_id").cast("long"), F.sha2(norm.cast("binary"), 256).alias("text_sha256"))
    groups = stash(text_groups(docs, flush_bytes, trie_bytes), "op2-groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    out = join_hot(each, groups, "text_sha256", "group_size", total)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "low_id")
