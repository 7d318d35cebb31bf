"""Sampled SentencePiece encodings without replacement, and exact decoding.

A text's lattice has its characters' gaps as nodes and vocabulary pieces as edges.  Pieces don't cross
a space that follows a letter, or a line feed, so the lattice is a row of short ones, one
for each chunk (spaces and the word behind them); each different chunk is worked out once and kept for
later batches while there is room.  Piece weights are Zipf weights of their ranks.

Distinct segmentations come by the Gumbel top-k trick: the root gets a Gumbel as the largest
perturbed log probability of all segmentations; the best segmentation is found top down, and
leaves behind the sets that part from it at each of its steps, each with a Gumbel truncated at its
parent's value as its own largest.  An A-star search pops the set with the largest value and goes on
from there.  The value that would have come next gives each sample's inclusion probability.
All random numbers are hashes of the row's key, the sample's number and the place in the text.
Everything but the sums along a text is done for all texts of a batch at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS, add_columns, fresh, give_back, pick, prepare, texts_of, unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_CHUNK = re.compile(r" *[^ \n]+|\n| +")
_SPACE = "▁"
_ROOM = 250_000  # characters worked on together
_BUILD = 1 << 17  # nodes built together
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1, fixed by key and place (unsigned longs)."""
    h = _mix(key + (place + np.uint64(1)) * _GOLD)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0


class Vocabulary:
    """Pieces of a SentencePiece model as a trie over code points, with log weights."""

    def __init__(self, proto: bytes, alpha: float = 0.5):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        parts = [b""] * sp.get_piece_size()
        self.part = parts.__getitem__
        self.byte = {}
        kids: dict[tuple[int, int], int] = {}
        piece = [-1]
        normal = []
        self.left_out = 0  # pieces that cross a space behind a letter, or a line feed
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte[b], parts[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                s = sp.id_to_piece(i).replace(_SPACE, " ")
                parts[i] = s.encode("utf-8", "surrogatepass")
                if len(_CHUNK.findall(s)) == 1:
                    normal.append((sp.get_score(i), i, s))
                else:
                    self.left_out += 1
        if len(self.byte) < 256:
            raise ValueError("the model needs pieces for all bytes")
        self.weight = np.full(len(parts), -np.inf)
        for rank, (_, i, s) in enumerate(sorted(normal, key=lambda x: (-x[0], x[1]))):
            self.weight[i] = -alpha * np.log(rank + 10.0)
            node = 0
            for c in map(ord, s):
                node = kids.setdefault((node, c), len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = i
        self.byte_weight = -alpha * np.log(2.0 * len(parts))
        self.bytes = np.array([self.byte[b] for b in range(256)], np.int32)
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.spelled_at = np.cumsum(self.lengths) - self.lengths
        self.spelled = np.frombuffer(b"".join(parts), np.uint8)
        self.piece = np.array(piece, np.int64)
        self.longest = max((len(s) for *_, s in normal), default=0)
        bits = max(10, int(np.ceil(np.log2(len(kids) + 1))) + 2)
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._kids = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        for (node, c), kid in kids.items():
            key = node << 21 | c
            at = ((key * int(_GOLD)) & (1 << 64) - 1) >> (64 - bits)
            while self._keys[at] >= 0:
                at = (at + 1) & self._mask
            self._keys[at], self._kids[at] = key, kid

    def step(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Child of each node by a code point, or -1."""
        key = node << 21 | c
        at = ((key.astype(np.uint64) * _GOLD) >> self._shift).astype(np.int64)
        found = self._keys[at]
        out = np.where(found == key, self._kids[at], -1)
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self._mask
            found = self._keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self._kids[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a list of pieces: bytes join to characters, the first space goes."""
        if not ids:
            return ""
        return b"".join(map(self.part, ids)).decode("utf-8", "surrogatepass")[1:]


class Lattice:
    """Lattices of many chunks side by side, kept for the batches to come: edges sorted by start, with conditional probabilities.

    What is kept is bounded: when a batch would lift it over ``room`` nodes, the batch begins anew.  A chunk's
    numbers don't depend on the chunks around it.
    """

    def __init__(self, vocabulary: Vocabulary, room: int = 3 << 19):
        self.vocabulary, self.room = vocabulary, room
        self.size = self.start = self.end = self.first = self.to = self.piece = np.zeros(0, np.int32)
        self.log_p = self.cum = np.zeros(0)
        self._clear()

    def _clear(self) -> None:
        self.known = Numbers()
        self.chunks = self.nodes = self.edges = 0

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write behind what is there, in an array that grows by quarters."""
        held = getattr(self, name)
        if at + len(values) > len(held):
            more = np.empty(max(at + len(values), 5 * len(held) // 4), held.dtype)
            more[:at] = held[:at]
            setattr(self, name, more)
            held = more
        held[at : at + len(values)] = values

    def numbers(self, chunks: list[list[str]]) -> np.ndarray:
        """The numbers of all chunks, one text after the other; those not known yet get their lattices."""
        flat = lambda: np.fromiter(map(self.known.__getitem__, chain.from_iterable(chunks)), np.int64)
        out = flat()
        new = list(islice(self.known, self.chunks, None))
        if self.nodes and self.nodes + sum(map(len, new)) + len(new) > self.room:
            self._clear()
            out = flat()
            new = list(self.known)
        at = 0
        while at < len(new):  # a part at a time, as building takes several times what is kept
            end, nodes = at, 0
            while end < len(new) and nodes < _BUILD:
                nodes += len(new[end]) + 1
                end += 1
            self._build(new[at:end])
            at = end
        return out

    def _build(self, chunks: list[str]) -> None:
        vocabulary = self.vocabulary
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        start = np.cumsum(size + 1) - size - 1  # each chunk has a node more than characters
        chars = np.frombuffer("\0".join(chunks).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32).astype(np.int64)
        n = len(chars)
        end = np.repeat(start + size, size + 1)
        inner = np.flatnonzero(np.arange(n) < end)
        src, dst, piece, weight = [], [], [], []
        at, node = inner, np.zeros(len(inner), np.int64)
        single = np.zeros(n, bool)
        for d in range(1, vocabulary.longest + 1):
            node = vocabulary.step(node, chars[at + d - 1])
            on = node >= 0
            at, node = at[on], node[on]
            got = vocabulary.piece[node]
            hit = got >= 0
            src.append(at[hit])
            dst.append(at[hit] + d)
            piece.append(got[hit])
            weight.append(vocabulary.weight[got[hit]])
            if d == 1:
                single[at[hit]] = True
            on = at + d < end[at]
            at, node = at[on], node[on]
            if not len(at):
                break
        lone = inner[~single[inner]]  # characters without a piece of their own go by bytes
        c = chars[lone]
        src.append(lone)
        dst.append(lone + 1)
        piece.append(np.where(c < 128, vocabulary.bytes[np.minimum(c, 127)], -1 - c))
        weight.append(_width(c) * vocabulary.byte_weight)
        # edges by start, long pieces first: a start is in a list once at most, so each list fills one place of each start
        ways = np.bincount(np.concatenate(src), minlength=n)
        first = np.concatenate(([0], np.cumsum(ways)))
        free, total = first[:-1].copy(), int(first[-1])
        flat = [np.empty(total, kind) for kind in (np.int64, np.int64, np.int64, np.float64)]
        for part in zip(src[::-1], dst[::-1], piece[::-1], weight[::-1], strict=True):
            put = free[part[0]]
            free[part[0]] += 1
            for out, values in zip(flat, part, strict=True):
                out[put] = values
        src, dst, piece, weight = flat
        # log mass of all ways from a node to its chunk's end, nodes with less left to go first
        mass = np.zeros(n)
        left = end[src] - src
        by_left = np.argsort(left.astype(np.int16) if len(left) and left.max() < 1 << 15 else left, kind="stable")
        cuts = np.searchsorted(left[by_left], np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            e = by_left[a:b]
            if len(e):
                heads = np.flatnonzero(np.concatenate(([True], src[e][1:] != src[e][:-1])))
                mass[src[e[heads]]] = np.logaddexp.reduceat(weight[e] + mass[dst[e]], heads)
        log_p = weight + mass[dst] - mass[src]
        cum = np.exp(log_p)
        late = np.flatnonzero(ways > 1)
        for rank in range(1, int(ways.max(initial=0))):  # cumulated inside each node, the nodes' second edges first
            late = late[ways[late] > rank]
            cum[first[late] + rank] += cum[first[late] + rank - 1]
        for name, values in (("size", size), ("start", start + self.nodes)):
            self._put(name, self.chunks, values)
        for name, values in (("end", end + self.nodes), ("first", first + self.edges)):  # the next build writes over the last of first
            self._put(name, self.nodes, values)
        for name, values in (("to", dst + self.nodes), ("piece", piece), ("log_p", log_p), ("cum", cum)):
            self._put(name, self.edges, values)
        self.chunks, self.nodes, self.edges = self.chunks + len(chunks), self.nodes + n, self.edges + total

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node: the first whose cumulated probability reaches ``u``."""
        e, most = self.first[node], self.first[node + 1] - 1
        todo = np.flatnonzero((self.cum[e] < u) & (e < most))
        while len(todo):
            e[todo] += 1
            todo = todo[(self.cum[e[todo]] < u[todo]) & (e[todo] < most[todo])]
        return e

    def walk(self, node: np.ndarray, key: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random ways from each node to its chunk's end: edges in order, and how many each has.

        ``shift`` plus the node gives the place that, with ``key``, fixes the random numbers.
        """
        steps = []
        counts = np.zeros(len(node), np.int64)
        live = np.flatnonzero(node < self.end[node])
        at = node[live]
        while len(live):
            e = self.draw(at, uniform(key[live], (shift[live] + at).astype(np.uint64)))
            steps.append((live, e))
            counts[live] += 1
            at = self.to[e]
            on = at < self.end[at]
            live, at = live[on], at[on]
        starts = np.cumsum(counts) - counts
        edges = np.empty(int(counts.sum()), np.int32)
        for t, (who, e) in enumerate(steps):
            edges[starts[who] + t] = e
        return edges, counts


def _width(c: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8."""
    return 1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF)


def _ends(counts: np.ndarray) -> np.ndarray:
    """Where each of the counts begins, and the end of all."""
    return np.concatenate(([0], np.cumsum(counts)))


def _log_inclusion(log_p: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """log of 1 - exp(-exp(log_p - bound)): how likely a sample is among the k largest, given the next value."""
    x = log_p - np.where(np.isfinite(bound), bound, 0.0)
    out = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.clip(x, -30, 700.0)))))
    return np.where(np.isfinite(bound), out, 0.0)


class Numbers(dict):
    """A number for each different key, in the order of first use."""

    def __missing__(self, key: str) -> int:
        out = self[key] = len(self)
        return out


@dataclass
class Round:
    """One sample of each text that has one, and the open sets it leaves: those that part from it at one of its steps."""

    edges: np.ndarray  # of all texts, one after the other
    at: np.ndarray  # where each text's edges begin
    by_chunk: np.ndarray  # edges in each chunk
    log_p: np.ndarray  # of each text's sample
    gone: dict[int, tuple[int, ...]]  # edges excluded where a text's sample parted from an earlier one
    parted: np.ndarray  # that step of each text, as a place in edges
    place: np.ndarray  # of each open set's step in edges
    value: np.ndarray
    cut: np.ndarray  # where each text's open sets begin
    top: np.ndarray  # largest value of each text's open sets, and where
    top_at: np.ndarray

    def find_tops(self) -> None:
        n = len(self.at) - 1
        self.top, self.top_at = np.full(n, -np.inf), np.zeros(n, np.int64)
        some = np.flatnonzero(np.diff(self.cut))
        if len(some):
            most = np.maximum.reduceat(self.value, self.cut[some])
            reach = np.flatnonzero(self.value == np.repeat(most, np.diff(self.cut)[some]))
            self.top[some], self.top_at[some] = most, reach[np.searchsorted(reach, self.cut[some])]


class Sampler:
    """The A-star search over the segmentations of many texts at once."""

    def __init__(self, vocabulary: Vocabulary, kept: int = 3 << 19):
        self.vocabulary, self.lattice = vocabulary, Lattice(vocabulary, kept)

    @staticmethod
    def _gumbel(keys: np.ndarray, number: int, places: np.ndarray) -> np.ndarray:
        own = _mix(keys ^ np.uint64(0x5851F42D4C957F2D * (number + 1) & (1 << 64) - 1))
        return -np.log(-np.log(uniform(own, places.astype(np.uint64) + np.uint64(1 << 40))))

    def _round(self, number: int, edges: np.ndarray, at: np.ndarray, by_chunk: np.ndarray, value: np.ndarray, parted: np.ndarray, gone: dict, rest: np.ndarray) -> Round:
        """Take a sample of each text that parted at ``parted``, and leave the sets that part from it there or later.

        ``rest`` has the probability of the edges left where it parted; none in the first round."""
        lattice, n = self.lattice, len(at) - 1
        log_p, ahead, whole = lattice.log_p[edges], np.zeros(len(edges) + 1), np.zeros(n)
        for t, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if b > a:  # summed for each text on its own, so the sums don't depend on its neighbours
                np.cumsum(log_p[a:b], out=ahead[a + 1 : b + 1])
                whole[t] = ahead[b]
                ahead[a] = 0.0  # the text before has been read
        place = np.flatnonzero(log_p < 0.0)  # elsewhere there is no other way
        if len(rest):
            place = place[place >= parted[np.searchsorted(at, place, "right") - 1]]
        text = np.searchsorted(at, place, "right") - 1
        mass = -np.expm1(np.minimum(log_p[place], 0.0))
        if len(rest):
            here = place == parted[text]
            mass[here] = rest[text[here]]
        with np.errstate(divide="ignore"):
            mass = np.log(mass)
        g = mass + ahead[place] + self._gumbel(self.keys[text], number + 1, place - at[text])
        g = np.where(np.isfinite(g), -np.logaddexp(-value[text], -g), -np.inf)
        out = Round(edges, at, by_chunk, whole, gone, parted, place, g, np.searchsorted(text, np.arange(n + 1)), np.zeros(0), np.zeros(0))
        out.find_tops()
        return out

    def __call__(self, texts: list[str], keys: np.ndarray, k: int | np.ndarray) -> tuple[list[Round], np.ndarray]:
        """Rounds of samples, in falling order of perturbed value, and for each text the value that would come next.

        ``k`` is the number of samples, for all texts or for each."""
        lattice = self.lattice
        wanted = np.broadcast_to(np.asarray(k), (len(texts),))
        own = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        cut = _ends(np.fromiter(map(len, own), np.int64, len(own)))
        chunk = lattice.numbers(own)
        size, start = lattice.size[chunk].astype(np.int64), lattice.start[chunk].astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(cut))
        place = np.cumsum(size) - size
        shift = place - (place[cut[:-1][owner]] if len(owner) else place) - start  # node plus shift is the place in the text
        self.keys = keys = _mix(keys.astype(np.uint64))
        edges, by_chunk = lattice.walk(start, keys[owner], shift)
        at = _ends(by_chunk)[cut]
        value = self._gumbel(keys, 0, np.zeros(len(texts)))
        rounds = [self._round(0, edges, at, by_chunk, value, at[:-1], {}, np.zeros(0))]
        for number in range(1, int(wanted.max(initial=1))):
            tops = np.stack([r.top for r in rounds])
            best = tops.argmax(axis=0)
            value = tops.max(axis=0)
            todo = np.flatnonzero(np.isfinite(value) & (wanted > number))
            if not len(todo):
                break
            salt = np.uint64(0xD1342543DE82EF95 * number & (1 << 64) - 1)
            from_round = [rounds[i] for i in best[todo].tolist()]
            ties = [int(r.top_at[t]) for r, t in zip(from_round, todo.tolist(), strict=True)]
            spot = np.array([int(r.place[i]) for r, i in zip(from_round, ties, strict=True)])
            own_edge = np.array([int(r.edges[p]) for r, p in zip(from_round, spot.tolist(), strict=True)])
            for r, i in zip(from_round, ties, strict=True):
                r.value[i] = -np.inf
            gone = {
                t: r.gone[t] if t in r.gone and p == r.parted[t] else (e,)
                for r, t, p, e in zip(from_round, todo.tolist(), spot.tolist(), own_edge.tolist(), strict=True)
            }
            step = spot - np.array([int(r.at[t]) for r, t in zip(from_round, todo.tolist(), strict=True)])
            # another edge from there, by the probabilities of those that are left
            node = np.searchsorted(lattice.first[: lattice.nodes + 1], own_edge, "right") - 1
            first, ways = lattice.first[node].astype(np.int64), (lattice.first[node + 1] - lattice.first[node]).astype(np.int64)
            p = np.zeros((len(todo), int(ways.max())))
            row = np.repeat(np.arange(len(todo)), ways)
            col = np.arange(len(row)) - np.repeat(np.cumsum(ways) - ways, ways)
            p[row, col] = np.exp(lattice.log_p[first[row] + col])
            out_of = [(j, e - f) for j, (t, f) in enumerate(zip(todo.tolist(), first.tolist(), strict=True)) for e in gone[t]]
            p[tuple(np.array(out_of).T)] = 0.0
            cum = p.cumsum(axis=1)
            u = uniform(keys[todo] ^ np.uint64(number), (step + (1 << 41)).astype(np.uint64))
            pick_at = (cum < (u * cum[:, -1])[:, None]).sum(axis=1)
            edge = first + pick_at
            p[np.arange(len(todo)), pick_at] = 0.0
            rest = np.zeros(len(texts))
            rest[todo] = p.cumsum(axis=1)[:, -1]
            gone = {t: (*gone[t], e) for t, e in zip(todo.tolist(), edge.tolist(), strict=True)}
            # the tail is drawn anew from there on
            ends = {id(r): np.cumsum(r.by_chunk) for r in rounds}
            c = np.array([int(np.searchsorted(ends[id(r)], q, "right")) for r, q in zip(from_round, spot.tolist(), strict=True)])
            last = cut[todo + 1]
            tail = _ends(last - c)
            where = np.arange(tail[-1]) + np.repeat(c - tail[:-1], last - c)  # chunks of all tails
            nodes = start[where]
            nodes[tail[:-1]] = lattice.to[edge]
            drawn, counts = lattice.walk(nodes, keys[owner[where]] ^ salt, shift[where])
            drawn_at = _ends(counts)[tail]
            parts: list[np.ndarray] = []
            by_chunk = np.zeros(len(chunk), np.int64)
            by_chunk[where] = counts
            for j, (r, t) in enumerate(zip(from_round, todo.tolist(), strict=True)):
                parts += [r.edges[r.at[t] : spot[j]], edge[j : j + 1], drawn[drawn_at[j] : drawn_at[j + 1]]]
                by_chunk[cut[t] : c[j]] = r.by_chunk[cut[t] : c[j]]
                by_chunk[c[j]] += spot[j] - (ends[id(r)][c[j]] - r.by_chunk[c[j]]) + 1
            counts = np.zeros(len(texts), np.int64)
            counts[todo] = step + 1 + np.diff(drawn_at)
            at = _ends(counts)
            parted = at[:-1].copy()
            parted[todo] += step
            for r in rounds:
                r.find_tops()
            rounds.append(self._round(number, np.concatenate(parts), at, by_chunk, value, parted, gone, rest))
        return rounds, np.stack([r.top for r in rounds]).max(axis=0)

    def ids(self, edges: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the edges, with characters that go by bytes spelled out, and where each text's begin."""
        found = self.lattice.piece[edges]
        far = np.flatnonzero(found < 0)
        if not len(far):
            return found, at
        c = -1 - found[far].astype(np.int64)
        wide = np.ones(len(found), np.int64)
        wide[far] = _width(c)
        places = _ends(wide)
        out = np.repeat(found, wide)
        for j in range(4):
            on = wide[far] > j
            shift = 6 * (wide[far[on]] - 1 - j)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide[far[on]]] if j == 0 else 0x80
            out[places[far[on]] + j] = self.vocabulary.bytes[(c[on] >> shift & (0x3F if j else 0xFF)) | lead]
        return out, places[at]

    def exact(self, texts: list[str], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the pieces of each text decode to it."""
        v = self.vocabulary
        want = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        long = v.lengths[ids]
        places = _ends(long)
        same = np.diff(places[at]) == np.fromiter(map(len, want), np.int64, len(want))
        if same.all():
            got = v.spelled[np.arange(places[-1]) + np.repeat(v.spelled_at[ids] - places[:-1], long)]
            if np.array_equal(got, np.frombuffer(b"".join(want), np.uint8)):
                return same
        return np.array([v.decode(ids[a:b].tolist()) == t for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)])


def sample(texts: list[str], keys: np.ndarray, vocabulary: Vocabulary, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to ``k`` distinct encodings, in falling order of perturbed value: ids, log
    probability and log inclusion probability.  A text with fewer segmentations returns all."""
    sampler = Sampler(vocabulary)
    rounds, bound = sampler(texts, keys, k)
    out: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in texts]
    for number, r in enumerate(rounds):
        ids, at = sampler.ids(r.edges, r.at)
        log_q = _log_inclusion(r.log_p, bound)
        for t in range(len(texts)):
            if at[t + 1] > at[t] or not number:
                out[t].append((ids[at[t] : at[t + 1]], float(r.log_p[t]), float(log_q[t])))
    return out


SAMPLE = T.StructType([
    T.StructField("rank", T.IntegerType()), T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("log_prob", T.DoubleType()),
    T.StructField("log_inclusion", T.DoubleType()), T.StructField("exact", T.BooleanType()),
])


def read_model(path: str = MODEL) -> bytes:
    """The model file, read where the driver runs; tasks get its bytes."""
    return Path(path).read_bytes()


def _rows(sampler: Sampler, texts: list[str], keys: np.ndarray, k: int | np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The place of each sample's text, and the columns of SAMPLE; samples of a text by rank."""
    rounds, bound = sampler(texts, keys, k)
    text, rank, log_p, log_q, exact, lists = [], [], [], [], [], []
    for number, r in enumerate(rounds):
        ids, at = sampler.ids(r.edges, r.at)
        have = np.flatnonzero(np.diff(at)) if number else np.arange(len(texts))
        text.append(have)
        rank.append(np.full(len(have), number + 1, np.int32))
        log_p.append(r.log_p[have])
        log_q.append(_log_inclusion(r.log_p, bound)[have])
        exact.append(sampler.exact([texts[t] for t in have.tolist()], ids, np.append(at[have], at[-1])))
        lists += [ids[a:b] for a, b in zip(at[have].tolist(), at[have + 1].tolist(), strict=True)]
    flat = [np.concatenate(x) for x in (text, rank, log_p, log_q, exact)]
    order = np.argsort(flat[0], kind="stable")
    text, rank, log_p, log_q, exact = (x[order] for x in flat)
    lists = [lists[i] for i in order.tolist()]
    cuts = pa.array(_ends(np.fromiter(map(len, lists), np.int64, len(lists))), pa.int32())
    pieces = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(lists), pa.int32()))
    return text, [pa.array(rank), pieces, pa.array(log_p), pa.array(log_q), pa.array(exact)]


def encode(docs: DataFrame, k: int = 2, alpha: float = 0.5, key: str = "doc_id", path: str = MODEL, kept: int = 3 << 19, copies: str | None = None) -> DataFrame:
    """One row for each sampled encoding: the columns of ``docs`` without ``text``, then ``rank`` (from 1), ``pieces``,
    ``log_prob``, ``log_inclusion`` and ``exact`` (the pieces decode to the text).

    Up to ``k`` distinct encodings a text, fewer if it has fewer.  Null and empty texts have one, without pieces.
    Seeds come from column ``key`` alone, so repeated rows get the same samples, and so do all rows
    whose key is null and whose texts are equal.  Input columns named like an output are replaced.  A model's
    pieces that cross a space behind a letter or a line feed have no edges (``Vocabulary.left_out`` counts them;
    the default model has none), so both probabilities are those of segmentations without them.  A task keeps lattices of
    ``kept`` nodes for later batches (some 60 bytes each); fewer take less memory and more time, and change no result.

    With ``copies``, a column of numbers, a row stands for so many copies of a document and gives one row for each: the n-th has the n-th
    of at most ``k`` samples, from the first again where there are no more.  A text has no more samples than copies.
    """
    proto = read_model(path)
    rest = [c for c in fresh(docs, "text", *SAMPLE.names).columns if c != copies]
    hashed = unused(docs, "key")
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").alias("text"), F.coalesce(F.xxhash64(key), F.lit(0).cast("long")).alias(hashed), *([F.col(f"`{copies}`").cast("long")] if copies else []))
    schema = T.StructType([*[f for f in docs.schema.fields if f.name in rest], *SAMPLE.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(Vocabulary(proto, alpha), kept)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                texts = [x or "" for x in batch.column(len(rest)).to_pylist()]
                keys = batch.column(len(rest) + 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                often = batch.column(len(rest) + 2).to_numpy() if copies else None
                at = 0
                while at < len(texts):
                    end, room = at, _ROOM
                    while end < len(texts) and (room > 0 or end == at):
                        room -= len(texts[end])
                        end += 1
                    text, columns = _rows(sampler, texts[at:end], keys[at:end], k if often is None else np.minimum(often[at:end], k))
                    if often is not None:
                        have = np.bincount(text, minlength=end - at)
                        owner = np.repeat(np.arange(end - at), often[at:end])
                        nth = np.arange(len(owner)) - np.repeat(_ends(often[at:end])[:-1], often[at:end])
                        taken = _ends(have)[owner] + nth % have[owner]
                        text, columns = text[taken], [c.take(pa.array(taken)) for c in columns]
                    place = pa.array(text + at)
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).take(place) for i in range(len(rest))], *columns], names=names)
                    at = end
        del sampler
        give_back()

    prepare(docs.sparkSession)
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` with ``text``, put together from ``pieces``; null pieces have null text."""
    proto = read_model(path)

    def make():
        vocabulary = Vocabulary(proto)
        return lambda batch: [pa.array([None if x is None else vocabulary.decode(x) for x in batch.column(batch.schema.get_field_index("pieces")).to_pylist()], pa.string())]

    return add_columns(encoded, [T.StructField("text", T.StringType())], make)


def report(docs: DataFrame, k: int = 2) -> DataFrame:
    """``doc_id, sample, n_pieces, log_prob, log_inclusion, pieces_hash, exact`` of every sampled encoding."""
    out = encode(pick(docs, "doc_id", "text"), k)
    return out.select("doc_id", F.col("rank").alias("sample"), F.size("pieces").alias("n_pieces"), "log_prob", "log_inclusion", F.xxhash64("pieces").alias("pieces_hash"), "exact")
