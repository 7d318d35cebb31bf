"""Hierarchical packing of tokenized documents into windows of several lengths.

A document's whole windows of the longest length stand alone; its rest is routed to the tier of the shortest window that
holds it.  Each tier packs its rests, longest first, and fills what they leave free, best fit first, with rests of shorter
tiers, so that windows of a tier are exactly full.  What stays behind meets once more in longest windows, and only there is
a rest cut to fill a window's end.  What a task has over at its end goes into windows of powers of two, so no sequence
has any padding.  Windows of one tier are dealt to step groups of equally many tokens, those costly for attention apart.

Every task packs the documents of its own partition as they come, a block at a time, so nothing is shuffled or gathered:
memory holds a block, the chunks known to the tokenizer, and a batch of texts, however many documents there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS, give_back, prepare
from .tokens import BYTE_BPE, ByteBpe, Encoder, in_parts, read

Piece = tuple[int, int, int]  # a document held, where the piece begins in it, its length
Window = list[Piece]

OUT = [
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("tier", T.IntegerType()), T.StructField("step_id", T.LongType()),
]


class _Shelf:
    """Things by their size, at most ``top``; finds the largest up to a size."""

    def __init__(self, top: int):
        self.held: list[list] = [[] for _ in range(top + 1)]
        self.sizes = 0  # a bit for each size that is there

    def put(self, size: int, thing) -> None:
        self.held[size].append(thing)
        self.sizes |= 1 << size

    def largest(self, most: int) -> int:
        """The largest size there, up to ``most``; 0 if there is none."""
        return max(0, (self.sizes & ((2 << most) - 1)).bit_length() - 1)

    def take(self, size: int):
        thing = self.held[size].pop()
        if not self.held[size]:
            self.sizes ^= 1 << size
        return thing


def tiers_of(window: int, least: int = 64) -> list[int]:
    """Window lengths, longest first: halves down to ``least``."""
    out = [window]
    while out[-1] // 2 >= least:
        out.append(out[-1] // 2)
    return out


def pack_block(pieces: list[Piece], tiers: list[int]) -> tuple[list[tuple[int, Window]], list[Piece]]:
    """Full windows as (tier, pieces), and what is left over: less than a longest window.

    ``pieces`` are no longer than the longest tier.
    """
    top = tiers[0]
    shelf, full, groups = _Shelf(top), [], _Shelf(top)
    for p in pieces:
        shelf.put(p[2], p)
    for tier in tiers:
        while (size := shelf.largest(tier)) > tier // 2 or (size and tier == tiers[-1]):
            window, room = [shelf.take(size)], tier - size
            while room and (size := shelf.largest(min(room, tier // 2))):
                window.append(shelf.take(size))
                room -= size
            if room:
                groups.put(tier - room, window)
            else:
                full.append((tier, window))
    # what couldn't fill a window of its tier fills longest windows
    short: list[tuple[int, Window]] = []
    while size := groups.largest(top):
        window, room = groups.take(size), top - size
        while room and (size := groups.largest(room)):
            window += groups.take(size)
            room -= size
        if room:
            short.append((room, window))
        else:
            full.append((top, window))
    # the emptiest windows give their pieces, cut where needed, to the fullest
    short.sort(key=lambda x: x[0])
    spare: list[Piece] = []
    while short:
        room, window = short.pop(0)
        while room:
            if not spare:
                if not short:
                    break
                spare = sorted(short.pop()[1], key=lambda p: p[2])
            at = next((k for k, p in enumerate(spare) if p[2] == room), len(spare) - 1)
            doc, start, size = spare.pop(at)
            fits = min(size, room)
            window.append((doc, start, fits))
            room -= fits
            if size > fits:
                spare.append((doc, start + fits, size - fits))
                spare.sort(key=lambda p: p[2])
        if room:
            return full, window
        full.append((top, window))
    return full, spare


def powers(pieces: list[Piece]) -> list[tuple[int, Window]]:
    """Pieces as windows of powers of two, the longest first, cut at the windows' ends."""
    total = sum(p[2] for p in pieces)
    out: list[tuple[int, Window]] = []
    queue = list(pieces)[::-1]
    while total:
        size = room = 1 << (total.bit_length() - 1)
        window: Window = []
        while room:
            doc, start, long = queue.pop()
            fits = min(long, room)
            window.append((doc, start, fits))
            if long > fits:
                queue.append((doc, start + fits, long - fits))
            room -= fits
        out.append((size, window))
        total -= size
    return out


class _Packer:
    """The packing of one task."""

    def __init__(self, task: int, window: int, tiers: list[int], step: int):
        self.base, self.window, self.tiers, self.step = task << 40, window, tiers, step
        self.docs: dict[int, tuple[object, np.ndarray, int]] = {}  # id, ids from the rest on, and where the rest begins
        self.left: list[Piece] = []
        self.ready: dict[int, list[Window]] = {}
        self.rows: list[tuple] = []
        self.number = self.steps = self.tokens = self.sequences = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        number, self.number = self.number, self.number + 1
        self.docs[number] = (doc_id, ids, n)
        for at in range(0, n - w + 1, w):
            self.ready.setdefault(w, []).append([(number, at, w)])
        if n % w:
            self.left.append((number, n - n % w, n % w))
        self.tokens += n

    def settle(self, last: bool = False) -> None:
        """Pack what is there; full windows go to step groups."""
        full, self.left = pack_block(self.left, self.tiers)
        if last:
            full += powers(self.left)
            self.left = []
        for tier, window in full:
            self.ready.setdefault(tier, []).append(window)
        for tier, windows in self.ready.items():
            each = max(1, self.step // tier)
            steps = -(-len(windows) // each) if last else len(windows) // each
            # whole steps only, but for the last; windows by attention cost, dealt to and fro
            windows.sort(key=lambda x: sum(p[2] ** 2 for p in x), reverse=True)
            for k, window in enumerate(windows[: steps * each]):
                lap, place = divmod(k, steps)
                self._emit(tier, window, self.steps + (steps - 1 - place if lap % 2 else place))
            self.ready[tier] = windows[steps * each :]
            self.steps += steps
        held = {p[0] for p in self.left} | {p[0] for x in self.ready.values() for window in x for p in window}
        self.docs = {k: v for k, v in self.docs.items() if k in held}
        self.tokens = 0

    def _emit(self, tier: int, window: Window, step: int) -> None:
        sequence, offset = self.base | self.sequences, 0
        self.sequences += 1
        for number, start, size in window:
            doc_id, ids, n = self.docs[number]
            self.rows.append((doc_id, start, size, zlib.crc32(ids[start : start + size]), n, sequence, offset, tier, self.base | step))
            offset += size

    def take(self, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True))
        self.rows = []
        kinds = [kind, *[pa.int64()] * 6, pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pack(docs: DataFrame, window: int = 2048, end: int = 1, step: int = 1 << 15, block: int = 1 << 20, path: str = BYTE_BPE) -> DataFrame:
    """One row for each piece: ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids_crc32`` (of its ids as
    little-endian unsigned 32-bit numbers), ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence, ``tier`` (the length of the
    sequence, ``window`` or a smaller power of two) and ``step_id`` (sequences of one tier with ``step`` tokens in all, fewer at a
    task's end).

    A document's ids are those of its text by the byte-level BPE at ``path``, special tokens added nowhere, and ``end`` behind them.
    Each id is in exactly one piece, and no sequence has padding.  Null and empty texts have ``end`` alone.  Rows that repeat, or
    whose id is null, are documents of their own.  An empty table gives no rows.  Other columns are ignored.  A text of any
    length is encoded whole, so a task holds the longest text's ids once, and about ``block`` ids besides.  The
    same partitions give the same sequences.
    """
    if window & (window - 1) or window < 64:
        raise ValueError("the longest window must be a power of two, 64 at least")
    data, tiers = read(path), tiers_of(window)
    rows = docs.select(F.col("doc_id"), F.col("text"))
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *OUT])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder([ByteBpe(data, special=True)], lead=False)
        context = TaskContext.get()
        packer = _Packer(context.partitionId() if context else 0, window, tiers, step)
        own = None
        for whole in batches:
            own = whole.schema.field(0).type
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                ids_of = batch.column(0).to_pylist()
                texts = [x or "" for x in batch.column(1).to_pylist()]
                for a, b in in_parts(texts):
                    chunks, at = encoder(texts[a:b])
                    ids, counts = encoder.ids(0, chunks)
                    cut = np.concatenate(([0], np.cumsum(counts)))[at].tolist()
                    for k in range(b - a):
                        mine = np.empty(cut[k + 1] - cut[k] + 1, "<u4")
                        mine[:-1] = ids[cut[k] : cut[k + 1]]
                        mine[-1] = end
                        packer.add(ids_of[a + k], mine)
                        if packer.tokens >= block:
                            packer.settle()
                            if packer.rows:
                                yield packer.take(own, names)
        if own is not None:
            packer.settle(last=True)
            if packer.rows:
                yield packer.take(own, names)
        del encoder, packer
        give_back()

    prepare(docs.sparkSession)
    return rows.mapInArrow(run, schema)
