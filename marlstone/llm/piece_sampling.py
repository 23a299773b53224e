"""SentencePiece encoding and decoding: k distinct segmentations per text by Gumbel top-k over the lattice.

The lattice of a text has an edge for each piece of the whole vocabulary, runs of blanks too, and byte fallback where a character has
none. It is held as the lattices of words: a text is split at each blank that follows another character, and a blank belongs to the word
after it. No piece spans such a place (a vocabulary that has one that does is told, and its texts are not split there), so nothing is
left out. Edges weigh log(1 / (2 + rank)) * alpha of the piece's rank, made into a distribution over
whole segmentations by the suffix sums of the lattice. Sampling without replacement is a best-first (A*) search on perturbed scores:
the set of all segmentations has one Gumbel maximum; following its path, at each node the segmentations that leave the path form a set
whose maximum is a Gumbel truncated below the path's own, which is an exact bound for all of them. The best open set is opened next, so
k openings give the k largest perturbed scores in order. The (k+1)-th score is the threshold from which the inclusion score
1 - exp(-exp(log p - threshold)) of each sample follows. Leaving sets that lie NEAR nats or further down the path are held as one set
with one exact Gumbel, and get scores of their own, below it, if it is ever the best: NEAR changes the work, not the distribution.

All random numbers are hashes of (row key, sample, word, step), and all sums are over one state or one text, so a row's samples don't
depend on where, when or beside what it is processed. Words that a worker has met keep their lattices (KEEP bounds them).

Encoding is lossless: no normalisation, decoding gives back the text. A U+2581 in a text is no blank; it goes by its bytes.

Defined results: null and empty texts give one sample without pieces (log p 0, inclusion 1); a text with fewer than k segmentations
gives those it has; rows with a null id are keyed by their text; rows with equal ids and texts get equal samples. A word of over
LONGEST code points is cut at the next places that no piece spans, which leaves its segmentations and their probabilities as they are;
where there is no such place (a run of one character) its lattice is whole, at 32 bytes an edge. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._shared import Known, mix, only, slices, text_col

NEAR = 30.0  # nats of prefix up to which leaving sets are kept one by one; what lies further is one set until it is the best
LONGEST = 1024  # code points of a word from which it is cut at the next place that no piece spans
AT_ONCE = 1 << 13  # code points of a word whose lattice is made in one go; that of a longer one is made from its end in blocks of as many
KEEP = 3_000_000  # edges of known words that a worker holds (32 bytes each) before it starts anew
_M = np.uint64(0x9E3779B97F4A7C15)
_EDGE = np.dtype([("cum", "f8"), ("logp", "f8"), ("src", "i4"), ("to", "i4"), ("piece", "i4"), ("_", "i4")])
_APART = re.compile("(?<=[^ ]) ")
_OUT = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_crc32 long, ids binary, text_sha256 string"


class Pieces:
    """Vocabulary of a SentencePiece model as hash tables by piece length. One object per worker and file."""

    _by_path: dict[str, Pieces] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text, self.byte, found = {}, np.zeros(256, np.int64), {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = piece.replace("▁", " ")
                self.text[i] = piece.encode()
                found.setdefault(len(piece), []).append((piece, i, -np.log(2 - sp.get_score(i))))
        self.apart = not any(_APART.search(r[0]) for rows in found.values() for r in rows)  # no piece spans two words
        sizes = np.zeros(max(self.text) + 1, np.int32)
        sizes[list(self.text)] = [len(x) for x in self.text.values()]
        self.at = np.cumsum(sizes, dtype=np.int32) - sizes
        self.sizes = sizes
        self.bytes = np.frombuffer(b"".join(self.text[i] for i in sorted(self.text)), np.uint8)
        self.longest = max(found)
        self.tables, self.begins = {}, np.zeros((self.longest + 1, 1 << 16), bool)  # begins: by length, hashes that a longer piece may begin with
        for n, rows in found.items():
            cp = np.frombuffer("".join(r[0] for r in rows).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
            h = np.zeros(len(rows), np.uint64)
            for j in range(n):
                h = h * _M + cp[:, j] + np.uint64(1)
                if j < n - 1:
                    self.begins[j + 1, (mix(h) >> np.uint64(48)).astype(np.int64)] = True
            h = mix(h)
            order = np.argsort(h)
            seen = np.zeros(1 << 16, bool)
            seen[(h >> np.uint64(48)).astype(np.int64)] = True
            bucket = np.searchsorted(h[order] >> np.uint64(48), np.arange(1 << 16, dtype=np.uint64)).astype(np.int32)  # where keys with those first 16 bits begin
            keys = np.append(h[order], np.uint64(0xFFFFFFFFFFFFFFFF))
            self.tables[n] = (keys, np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order], seen, bucket)
        self.weight = np.zeros(max(self.text) + 1)
        for _, ids, lp, _, _ in self.tables.values():
            self.weight[ids] = lp
        self.worst = min(t[2].min() for t in self.tables.values()) - 2.0

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def match(self, c: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
        """By place and length, longest first: 1 + number of the piece there, 0 for none; a code point without a piece is kept as a
        negative number. ``left``: characters that a piece at the place may have; places of the first ``most`` characters count."""
        found = np.zeros((len(c), self.longest), np.int32)
        h = np.zeros(len(c), np.uint64)
        place = np.flatnonzero(left[:most] >= 1)
        for size in range(1, self.longest + 1):
            place = place[left[place] >= size]
            if not len(place):
                break
            h[place] = g = h[place] * _M + c[place + size - 1] + np.uint64(1)
            m = mix(g)
            short = (m >> np.uint64(48)).astype(np.int64)
            if size in self.tables:
                keys, ids, _, seen, bucket = self.tables[size]
                some = np.flatnonzero(seen[short])
                want, at = m[some], bucket[short[some]]
                got = keys[at]
                on = np.flatnonzero(got < want)
                while len(on):
                    at[on] += 1
                    got[on] = keys[at[on]]
                    on = on[got[on] < want[on]]
                ok = np.flatnonzero((got == want) & (at < len(ids)))
                found[place[some[ok]], -size] = ids[at[ok]] + 1
            if size == 1:
                lack = place[found[place, -1] == 0]
                found[lack, -1] = -1 - c[lack].astype(np.int32)
            place = place[self.begins[size][short]]
        return found

    def match_long(self, c: np.ndarray, a: int, b: int) -> np.ndarray:
        """``match`` at places a to b - 1 of one word's characters c."""
        some = c[a : b + self.longest]
        return self.match(some, len(c) - a - np.arange(len(some)), b - a)[: b - a]

    def blocks(self, word: str) -> list:
        """The word, or if it is too long its blocks, cut at the first places from LONGEST characters on that no piece spans. All but
        the first are in a tuple, which tells them from a word."""
        if len(word) <= LONGEST:
            return [word]
        c, reach, free = codes(" " + word), 0, []
        for a in range(0, len(c), 1 << 16):
            got = self.match_long(c, a, min(a + (1 << 16), len(c))) != 0
            ends = np.maximum.accumulate(np.maximum(np.arange(a, a + len(got)) + self.longest - got.argmax(1), reach))
            reach = int(ends[-1])
            free.append(a + 1 + np.flatnonzero(ends == np.arange(a, a + len(got)) + 1))
        free, cuts = np.concatenate(free), [1]
        while cuts[-1] <= len(word):
            cuts.append(int(free[np.searchsorted(free, min(cuts[-1] + LONGEST, len(c)))]))
        parts = [word[x - 1 : y - 1] for x, y in zip(cuts, cuts[1:])]
        return [parts[0], *((x,) for x in parts[1:])]

    def decode(self, ids: np.ndarray, most: int = 1 << 18) -> bytes:
        """UTF-8 bytes of the pieces' text, without the blank that stands before the first word."""
        parts = []
        for a in range(0, len(ids), most):
            some = ids[a : a + most]
            n = self.sizes[some]
            where = np.repeat(self.at[some] + n - np.cumsum(n, dtype=np.int32), n)
            where += np.arange(len(where), dtype=np.int32)
            parts.append(self.bytes[where].tobytes())
        return b"".join(parts)[1:]


class Lattice:
    """Lattices of the words that a worker has met. State = place in a word; the edges of state s are lo[s] to lo[s + 1] - 1, longest
    first, with the cumulative probabilities within the state; a word's last state has none. Nothing in it depends on other words."""

    _by_model: dict[tuple, Lattice] = {}

    def __init__(self, model: Pieces, alpha: float) -> None:
        self.model, self.alpha = model, alpha
        self.clear()

    @classmethod
    def of(cls, model: Pieces, alpha: float) -> Lattice:
        return cls._by_model.setdefault((id(model), alpha), cls(model, alpha))

    def clear(self) -> None:
        self.first = Known()
        self.n_states, self.n_edges = 0, 0
        self.table, self.lo = np.zeros(0, _EDGE), np.zeros(1, np.int32)

    def _room(self, states: int, edges: int) -> None:
        """Makes the tables large enough. That of edges begins with room for twice KEEP, of which only what is filled takes memory, so
        that it is not copied as it grows; a long text's grows in place by a step. An edge's numbers lie side by side: they are read
        together, at random places."""
        if self.n_edges + edges > len(self.table):
            self.cum = self.logp = self.src = self.to = self.piece = None  # views of it, which may move
            if self.n_edges:
                self.table.resize(max(self.n_edges + edges, len(self.table) + (1 << 20)), refcheck=False)
            else:
                self.table = np.zeros(max(edges, 2 * KEEP), _EDGE)
            self.cum, self.logp, self.src, self.to, self.piece = (self.table[x] for x in _EDGE.names[:5])
        if self.n_states + states >= len(self.lo):
            wide = np.zeros(max(self.n_states + states + 1, 2 * len(self.lo)), np.int32)
            wide[: self.n_states + 1] = self.lo[: self.n_states + 1]
            self.lo = wide

    def states(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First states of all words (split at blanks) of all texts, and the texts' n+1 offsets."""
        if self.n_edges > KEEP:
            self.clear()
        out, off, held, many = [], [0], [], 0
        for text in texts:
            n = 0
            for part in (_segments(text) if self.model.apart else [text]) if text else ():
                words = _split(part) if self.model.apart else [part]
                if len(part) > LONGEST and len(max(words, key=len)) > LONGEST:
                    words = [x for w in words for x in self.model.blocks(w)]
                held.append(words)
                n += len(words)
                many += len(words)
                if many > 1 << 17:
                    out.append(self._numbers(held, many))
                    held, many = [], 0
            off.append(off[-1] + n)
        return np.concatenate([*out, self._numbers(held, many)]), np.array(off)

    def _numbers(self, held: list[list], many: int) -> np.ndarray:
        """First states of the words; new ones are learnt."""
        got = np.fromiter(map(self.first.__getitem__, itertools.chain.from_iterable(held)), np.int32, many)
        if self.first.new:
            new, self.first.new = self.first.new, []
            size = np.fromiter(map(len, new if tuple not in set(map(type, new)) else (w[0] if isinstance(w, tuple) else w for w in new)), np.int64, len(new))
            at = np.zeros(len(new), np.int32)
            for i in np.flatnonzero(size >= AT_ONCE).tolist():
                at[i] = self._add_long(new[i])
            rest = np.flatnonzero(size < AT_ONCE)
            lot = np.cumsum(size[rest] + 50) >> 18
            for i in np.split(rest, np.flatnonzero(np.diff(lot)) + 1) if len(rest) else ():
                at[i] = self._add(new[i[0] : i[-1] + 1] if i[-1] - i[0] == len(i) - 1 else [new[j] for j in i.tolist()])
            got = np.where(got < 0, at[np.maximum(-1 - got, 0)], got)
        return got

    def _add(self, words: list) -> np.ndarray:
        """Learns words; returns their first states."""
        model = self.model
        whole = [w[0] if isinstance(w, tuple) else " " + w for w in words]
        n = np.fromiter(map(len, whole), np.int64, len(whole))
        first = np.cumsum(n + 1) - (n + 1)  # each word has a state for each character and one for its end
        c = codes("\0".join(whole) + "\0")
        left = np.repeat(first + n, n + 1) - np.arange(len(c))  # characters up to the word's end
        found = model.match(c, left, len(c))
        flat = found.ravel()
        at = np.flatnonzero(flat)
        src, piece = at // model.longest, flat[at]
        to = src + model.longest - at % model.longest
        w = np.where(piece < 0, model.worst, model.weight[np.maximum(piece - 1, 0)]) * self.alpha
        piece = np.where(piece < 0, piece, piece - 1)
        deg = np.bincount(src, minlength=len(c))
        lo = np.concatenate([[0], np.cumsum(deg)])
        beta, level = np.zeros(len(c)), left[src]
        by = np.argsort(level.astype(np.uint16), kind="stable")  # words have AT_ONCE characters at most
        cuts = np.searchsorted(level[by], np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(cuts, cuts[1:]):  # suffix sums, nearest to the words' ends first
            if b > a:
                e = by[a:b]
                v, s = w[e] + beta[to[e]], src[e]
                new = np.empty(len(e), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                start = np.flatnonzero(new)
                top = np.maximum.reduceat(v, start)
                beta[s[start]] = top + np.log(np.add.reduceat(np.exp(v - top[np.cumsum(new) - 1]), start))
        lp = w + beta[to] - beta[src]
        cum, rank = np.exp(lp), np.arange(len(src)) - np.repeat(lo[:-1], deg)
        for r in range(1, int(deg.max(initial=0))):  # sums within a state only, so that they don't depend on what stands beside it
            at = np.flatnonzero(rank == r)
            cum[at] += cum[at - 1]
        cum[lo[1:][deg > 0] - 1] = np.inf
        self._room(len(c), len(src))
        self.lo[self.n_states + 1 : self.n_states + 1 + len(c)] = lo[1:] + self.n_edges
        end = self.n_edges + len(src)
        for mine, more in ((self.cum, cum), (self.logp, lp), (self.src, src + self.n_states), (self.to, to + self.n_states), (self.piece, piece)):
            mine[self.n_edges : end] = more
        first = first + self.n_states
        self.first.update(zip(words, first.tolist()))
        self.n_states += len(c)
        self.n_edges += len(src)
        return first

    def _add_long(self, word: str | tuple) -> int:
        """Learns one long word from its end on, block by block; returns its first state. Its states are numbered from the end."""
        model = self.model
        c = codes(word[0] if isinstance(word, tuple) else " " + word)
        beta = [0.0] * (len(c) + 1)  # by characters up to the word's end
        self._room(1, 0)
        end = self.n_states  # the state of the word's end
        self.lo[end + 1] = self.n_edges
        self.n_states += 1
        for b in range(len(c), 0, -AT_ONCE):
            a = max(0, b - AT_ONCE)
            flat = model.match_long(c, a, b)[::-1].ravel()
            at = np.flatnonzero(flat)
            piece = flat[at]
            src = len(c) - b + 1 + at // model.longest
            to = src - (model.longest - at % model.longest)
            w = np.where(piece < 0, model.worst, model.weight[np.maximum(piece - 1, 0)]) * self.alpha
            lo = np.concatenate([[0], np.cumsum(np.bincount(src - (len(c) - b + 1), minlength=b - a))])
            weights, targets, bounds = w.tolist(), to.tolist(), lo.tolist()
            cum = np.empty(len(src))
            lp = np.empty(len(src))
            for s, (x, y) in enumerate(zip(bounds, bounds[1:]), len(c) - b + 1):
                v = [weights[e] + beta[targets[e]] for e in range(x, y)]
                top = max(v)
                beta[s] = top + math.log(sum(math.exp(z - top) for z in v))
                lp[x:y] = v = [z - beta[s] for z in v]
                cum[x:y] = list(itertools.accumulate(map(math.exp, v)))
                cum[y - 1] = np.inf
            self._room(b - a, len(src))
            self.lo[self.n_states + 1 : self.n_states + 1 + b - a] = lo[1:] + self.n_edges
            last = self.n_edges + len(src)
            piece = np.where(piece < 0, piece, piece - 1)
            for mine, more in ((self.cum, cum), (self.logp, lp), (self.src, src + end), (self.to, to + end), (self.piece, piece)):
                mine[self.n_edges : last] = more
            self.n_states += b - a
            self.n_edges = last
        self.first[word] = end + len(c)
        return end + len(c)

    def walk(self, state: np.ndarray, key: np.ndarray, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """Sampled edges from each state to its word's end, end to end, and the number of edges of each."""
        if len(state) > block:
            parts = [self.walk(state[a : a + block], key[a : a + block]) for a in range(0, len(state), block)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        steps, alone, live, cur = [], [], np.arange(len(state)), state
        count = np.zeros(len(state), np.int64)
        go = self.lo[cur] < self.lo[cur + 1]
        while True:
            if not go.all():
                live, cur, key = live[go], cur[go], key[go]
            if len(live) <= 4:
                alone = [(k, len(steps), self._walk_one(s, x, len(steps))) for k, s, x in zip(live.tolist(), cur.tolist(), key.tolist())]
                break
            u, e = uniform(key, len(steps)), self.lo[cur]
            miss = np.flatnonzero(u >= self.cum[e])
            while len(miss):
                e[miss] += 1
                miss = miss[u[miss] >= self.cum[e[miss]]]
            steps.append((live, e))
            count[live] += 1
            cur = self.to[e]
            go = self.lo[cur] < self.lo[cur + 1]
        for k, _, path in alone:
            count[k] += len(path)
        out, at = np.zeros(int(count.sum()), np.int32), np.cumsum(count) - count
        for t, (k, e) in enumerate(steps):
            out[at[k] + t] = e
        for k, t, path in alone:
            out[at[k] + t : at[k] + t + len(path)] = path
        return out, count

    def _walk_one(self, state: int, key: int, step: int) -> array:
        """The rest of one walk, from its step-th edge on; the same numbers as in ``walk``."""
        path, lo, cum, to = array("i"), self.lo, self.cum, self.to
        while (e := int(lo[state])) < lo[state + 1]:
            u = uniform_one(key, step)
            while u >= cum[e]:
                e += 1
            path.append(e)
            state, step = int(to[e]), step + 1
        return path


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _segments(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut where words end (those blanks go), so that a long text's words are never all
    held as strings."""
    a = 0
    while cut := _APART.search(text, a + most):
        yield text[a : cut.start()]
        a = cut.end()
    yield text[a:]


def _split(part: str) -> list[str]:
    """Words, without the one blank that each begins with: further ones stay, and so do all of those that a text begins with."""
    return _APART.split(part) if "  " in part or part.startswith(" ") else part.split(" ")


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    return ((mix(key + np.uint64((salt + 1) * int(_M) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


_WORD = 0xFFFFFFFFFFFFFFFF


def mix_one(h: int) -> int:
    """``mix`` of one number."""
    h &= _WORD
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _WORD
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _WORD
    return h ^ (h >> 31)


def uniform_one(key: int, salt: int = 0) -> float:
    return ((mix_one(key + (salt + 1) * int(_M)) >> 11) + 0.5) * 2.0**-53


def gumbel_one(key: int) -> float:
    return -math.log(-math.log(uniform_one(key)))


def below(top: float, g):
    """A Gumbel truncated below top, from an untruncated one of the same location. Monotone in g."""
    return -np.logaddexp(-top, -g)


def untruncated(top: float, v: np.ndarray) -> np.ndarray:
    """The g for which below(top, g) is v."""
    with np.errstate(divide="ignore"):
        return np.where(v < top, v - np.log(np.maximum(-np.expm1(np.minimum(v - top, 0.0)), 1e-300)), np.inf)


class Path:
    """A sampled segmentation and the sets of those that leave it.

    edges; ends: of each word, as numbers of edges; fresh: the first edge whose leaving set is this path's; top: the perturbed score;
    open: untruncated Gumbels of the leaving sets of edges up to ``near``; far: that of all sets beyond, taken as one; best: the score of
    the best open set; used: edges already taken out of a leaving set.
    """

    __slots__ = ("best", "cum", "edges", "ends", "far", "fresh", "logp", "near", "open", "top", "used")

    def __init__(self, lat: Lattice, edges: np.ndarray, ends: np.ndarray, fresh: int, top: float, seed) -> None:
        self.edges, self.ends, self.fresh, self.top, self.used = edges, ends, fresh, top, {}
        lp = lat.logp[edges]
        self.logp, n = float(lp.sum()), fresh + 64
        while True:
            self.cum = lp[:n].cumsum()
            base = self.cum[fresh] if fresh < len(edges) else 0.0
            self.near = int(np.searchsorted(-self.cum, NEAR - base))
            if self.near < len(self.cum) or n >= len(edges):
                break
            n *= 2
        self.near = min(len(edges), max(fresh + 1, self.near))
        rest = float(lp[self.near :].sum())
        if rest > -1e-12 and self.near < len(edges):  # too near 1 to be held as one set
            self.near, self.cum = len(edges), lp.cumsum()
        self.open = self._locations(lat, 0, self.near) + gumbel(uniform(mix(np.arange(self.near, dtype=np.uint64) + np.uint64(seed(5))), 0))
        self.open[:fresh] = -np.inf  # those sets belong to the path that this one left
        self.far = -np.inf
        if self.near < len(edges):
            self.far = float(self.cum[self.near - 1]) + math.log(-math.expm1(rest)) + gumbel_one(seed(6))
        self.rate()

    def _locations(self, lat: Lattice, a: int, b: int) -> np.ndarray:
        """Log masses of the sets that leave at edges a to b - 1."""
        edges = self.edges[a:b]
        lp = lat.logp[edges]
        with np.errstate(divide="ignore"):
            out = self.cum[a:b] - lp + np.log(np.maximum(-np.expm1(lp), 0.0))
        state = lat.src[edges]
        lone = lat.lo[state + 1] - lat.lo[state] < 2
        for i in np.flatnonzero((lp > -1e-12) & ~lone).tolist():  # 1 - p has few digits left: its siblings' sum
            lo, own = int(lat.lo[state[i]]), int(edges[i])
            out[i] = self.cum[a + i] - lp[i] + np.logaddexp.reduce(np.delete(lat.logp[lo : lat.lo[state[i] + 1]], own - lo))
        return np.where(lone, -np.inf, out)  # an edge without a sibling can't be left

    def rate(self) -> None:
        self.best = float(below(self.top, max(float(self.open.max(initial=-np.inf)), self.far)))

    def pick(self, lat: Lattice, seed) -> int:
        """The edge whose leaving set is the best. Where that lies far, the sets beyond ``near`` get scores of their own, below the best."""
        if self.far > self.open.max(initial=-np.inf):
            self.cum = lat.logp[self.edges].cumsum()
            where = self._locations(lat, self.near, len(self.edges))
            mass = np.cumsum(np.exp(where - where.max()))
            t = int(np.searchsorted(mass, uniform_one(seed(7)) * mass[-1], side="right").clip(0, len(mass) - 1))
            while t and mass[t] == mass[t - 1]:
                t -= 1
            more = untruncated(self.top, below(self.best, where + gumbel(uniform(mix(np.arange(len(where), dtype=np.uint64) + np.uint64(seed(8))), 0))))
            more[t] = self.far
            self.open, self.near, self.far = np.concatenate([self.open, more]), len(self.edges), -np.inf
        return int(self.open.argmax())

    def leave(self, lat: Lattice, t: int, seed) -> int:
        """Takes an edge out of the leaving set of edge t, by its share; what stays of the set gets a score below the one it had."""
        own, top = int(self.edges[t]), self.best
        state = int(lat.src[own])
        lo, hi = int(lat.lo[state]), int(lat.lo[state + 1])
        left = lat.logp[lo:hi].copy()
        used = self.used.setdefault(t, [own])
        left[np.array(used) - lo] = -np.inf
        weight = np.exp(left - left.max())
        e = lo + int(np.searchsorted(np.cumsum(weight), uniform_one(seed(3)) * weight.sum(), side="right").clip(0, hi - lo - 1))
        while weight[e - lo] == 0:
            e -= 1
        used.append(e)
        left[e - lo] = -np.inf
        self.open[t] = -np.inf
        if len(used) < hi - lo:
            g = float(self.cum[t] - lat.logp[own]) + np.logaddexp.reduce(left) + gumbel_one(seed(4))
            self.open[t] = untruncated(self.top, below(top, g))
        self.rate()
        return e


def sample(model: Pieces, texts: list[str], keys: np.ndarray, k: int, alpha: float, lat: Lattice | None = None) -> Iterator[tuple]:
    """(text number, sample, log p, perturbed score, inclusion, ids) of every text's samples. All texts are walked together; each text's
    search uses only its own numbers."""
    lat = lat or Lattice.of(model, alpha)
    starts, off = lat.states(texts)
    seeds = lambda d, r: lambda what, key=int(keys[d]) + 1_000_003 * r: mix_one(key + what)
    full = np.flatnonzero(np.diff(off)).tolist()
    for d in np.flatnonzero(np.diff(off) == 0):
        yield int(d), 0, 0.0, 0.0, 1.0, np.zeros(0, np.int64)
    size = np.diff(off)
    place = np.arange(len(starts), dtype=np.uint64) - np.repeat(off[:-1], size).astype(np.uint64)
    words = mix(place + np.repeat(mix(keys + np.uint64(1)), size))
    edges, count = lat.walk(starts, words)
    ends = np.cumsum(count)
    tops = gumbel(uniform(mix(keys + np.uint64(2)), 0))
    paths: dict[int, list[Path]] = {}
    for d in full:
        a, b = off[d], off[d + 1]
        base = int(ends[a - 1]) if a else 0
        paths[d] = [Path(lat, edges[base : ends[b - 1]], ends[a:b] - base, 0, float(tops[d]), seeds(d, 0))]
    for r in range(1, k):
        left = []
        for d in full:
            p = max(paths[d], key=lambda q: q.best)
            if np.isfinite(p.best):
                top, seed = p.best, seeds(d, r)
                t = p.pick(lat, seed)
                left.append((d, p, t, p.leave(lat, t, seed), int(np.searchsorted(p.ends, t, side="right")), top))
        if not left:
            break
        states = np.concatenate([x for d, p, t, e, w, _ in left for x in (lat.to[e : e + 1], starts[off[d] + w + 1 : off[d + 1]])])
        key = mix(np.concatenate([words[off[d] + w : off[d + 1]] for d, p, t, e, w, _ in left]) + np.uint64(r))
        tails, count = lat.walk(states, key)
        ends, at = np.cumsum(count), 0
        for d, p, t, e, w, top in left:
            n = int(size[d]) - w
            a = int(ends[at - 1]) if at else 0
            tail = tails[a : int(ends[at + n - 1])]
            whole = np.concatenate([p.edges[:t], np.array([e], np.int32), tail])
            paths[d].append(Path(lat, whole, np.concatenate([p.ends[:w], ends[at : at + n] - a + t + 1]), t + 1, top, seeds(d, r)))
            at += n
    for d in full:
        threshold = max(p.best for p in paths[d])
        for r, p in enumerate(paths.pop(d)):
            logp = p.logp
            inclusion = 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(700.0, logp - threshold))))
            ids = lat.piece[p.edges]
            lack = np.flatnonzero(ids < 0)
            if len(lack):  # bytes in place of each character that has no piece
                raw = [chr(-1 - i).encode("utf-8", "surrogatepass") for i in ids[lack].tolist()]
                n = np.ones(len(ids), np.int64)
                n[lack] = [len(b) for b in raw]
                ids = np.repeat(ids, n)
                ids[ids < 0] = model.byte[np.frombuffer(b"".join(raw), np.uint8)]
            yield d, r, logp, p.top, inclusion, ids


def _samples(path: str, k: int, alpha: float, with_ids: bool, with_digest: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pieces", Lattice._by_model.clear)
        model = Pieces.of(path)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.string()]
        for part in slices(it, "text", 1 << 20):
            texts, doc_ids = text_col(part, "text").to_pylist(), part.column("doc_id").to_pylist()
            keys = np.array([xxhash.xxh3_64_intdigest(str(i) if i is not None else "text " + t) for i, t in zip(doc_ids, texts)], np.uint64)
            rows = []
            for d, r, logp, top, inclusion, ids in sample(model, texts, keys, k, alpha):
                raw = ids.astype("<u4").tobytes()
                rows.append((doc_ids[d], r, len(ids), logp, top, inclusion, zlib.crc32(raw), raw if with_ids else None, hashlib.sha256(model.decode(ids)).hexdigest() if with_digest else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in _OUT.split(", ")])

    return run


def sample_pieces(docs: DataFrame, model_path: str, k: int = 2, alpha: float = 1.0, with_ids: bool = True, with_digest: bool = False) -> DataFrame:
    """k samples per row: doc_id, sample, n_pieces, log_prob, perturbed, inclusion, ids_crc32, ids (32-bit little-endian), text_sha256 (of
    the text that the sample's ids decode to; null unless asked for)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_samples(model_path, k, alpha, with_ids, with_digest), _OUT)


def decode_pieces(samples: DataFrame, model_path: str) -> DataFrame:
    """Adds ``text``, decoded from ``ids``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(model_path)
        for batch in it:
            texts = [model.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") if x is not None else None for x in batch.column("ids").to_pylist()]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    return samples.mapInArrow(run, StructType([*samples.schema.fields, StructField("text", StringType())]))
