"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet in a corpus.

Both token sequences of a text end at known bytes.  They are merged in lockstep: one state vector holds, for all documents of
a batch, a pointer into A's tokens and one into B's.  A step emits the link of each pair pointed at, advances the pointer whose
token ends first, or both where they end together, which is a cut, and finished documents leave the vector.  A long
document is several entries of the vector, each with a run of A's tokens, so that the steps of a batch don't follow its longest text.

An id pair's count is the number of documents that hold it linked.  Documents keep their different pairs, tasks add pairs up
before they shuffle, and each document's pairs then meet the counts again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS, checkpoint, give_back, prepare, remove
from .tokens import BYTE_BPE, PIECE_BPE, ByteBpe, Encoder, PieceBpe, in_parts, read

LANE = 128  # tokens of A that an entry of the state vector covers at most
#: Pairs that tasks hold as a table of 13 bytes each; more of them are joined instead.
TABLE = 6_000_000
_HELD = 1 << 21  # pairs that a task adds up at a time

LINKED = [
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType()),
]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, docs_a: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (places in A and B) and cuts (likewise) of documents that lie one behind the other.

    ``ends_*`` are the bytes where the tokens end, counted through all documents; a document's A tokens begin at its ``docs_a``.
    A and B end together at each document's end.
    """
    size = np.diff(docs_a)
    lanes = -(-size // lane)
    begin = np.repeat(docs_a[:-1], lanes) + lane * (np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(begin + lane, np.repeat(docs_a[1:], lanes))
    # the B token over an entry's first byte
    b = np.searchsorted(ends_b, np.concatenate(([0], ends_a))[begin], "right")
    a = begin
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(a):
        links_a.append(a)
        links_b.append(b)
        end_a, end_b = ends_a[a], ends_b[b]
        cut = end_a == end_b
        cuts_a.append(a[cut])
        cuts_b.append(b[cut])
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        on = a < stop
        if not on.all():
            a, b, stop = a[on], b[on], stop[on]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (links_a, links_b, cuts_a, cuts_b))


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids, right-aligned before one free byte, and how many each has."""
    width = len(str(max(n - 1, 0)))
    table = np.zeros((n, width + 1), np.uint8)
    value = np.arange(n)
    for k in range(width):
        table[:, width - 1 - k] = 48 + value // 10**k % 10
    return table, np.fromiter((len(str(i)) for i in range(n)), np.int64, n)


class Aligner:
    """Aligned batches of texts."""

    def __init__(self, a: ByteBpe, b: PieceBpe):
        self.encoder = Encoder([a, b], lead=True)
        self.lengths = (a.lengths, b.lengths)
        self.base = len(b.parts)
        self.digits, self.width = _digits(max(len(a.parts), len(b.parts)))
        self.kind = "<u4" if len(a.parts) * self.base <= 1 << 32 else "<u8"

    def _spelled(self, text: str, n: int, ids: np.ndarray) -> bool:
        parts = self.encoder.tokenizers[n].parts
        return b"".join([parts[i] for i in ids.tolist()]) == b" " + text.encode()

    def __call__(self, texts: list[str]) -> list[list]:
        """The columns of LINKED for each text."""
        chunks, at = self.encoder(texts)
        found = [self.encoder.ids(n, chunks) for n in (0, 1)]
        cut = [np.concatenate(([0], np.cumsum(counts)))[at] for _, counts in found]
        ids = [x for x, _ in found]
        keep = np.diff(at) > 0
        for n in (0, 1):
            wrong = np.flatnonzero(~self.encoder.tables[n].spells[chunks])
            for t in np.unique(np.searchsorted(at, wrong, "right") - 1).tolist():
                keep[t] &= self._spelled(texts[t], n, ids[n][cut[n][t] : cut[n][t + 1]])
        if not keep.all():  # texts that a tokenizer doesn't spell have no tokens
            for n in (0, 1):
                size = np.where(keep, np.diff(cut[n]), 0)
                ids[n] = ids[n][np.repeat(keep, np.diff(cut[n]))]
                cut[n] = np.concatenate(([0], np.cumsum(size)))
        return self._columns(len(texts), ids, cut)

    def _columns(self, texts: int, ids: list[np.ndarray], cut: list[np.ndarray]) -> list[list]:
        ends = [np.cumsum(size[x]) for size, x in zip(self.lengths, ids, strict=True)]
        link_a, link_b, cut_a, cut_b = lockstep(*ends, cut[0])
        doc = np.searchsorted(cut[0], link_a, "right") - 1
        groups = np.bincount(np.searchsorted(cut[0], cut_a, "right") - 1, minlength=texts)
        n_links = np.bincount(doc, minlength=texts)
        # the different pairs of each document, in order, and how often each is linked
        pair = ids[0][link_a].astype(np.int64) * self.base + ids[1][link_b]
        if self.kind == "<u4":
            both = np.sort(doc << 32 | pair)
            head = np.flatnonzero(np.diff(both, prepend=-1))
            key, owner = both[head] & 0xFFFFFFFF, both[head] >> 32
        else:
            order = np.lexsort((pair, doc))
            head = np.flatnonzero((np.diff(doc[order], prepend=-1) != 0) | (np.diff(pair[order], prepend=-1) != 0))
            key, owner = pair[order][head], doc[order][head]
        times = np.diff(head, append=len(pair)).astype("<u4")
        key = key.astype(self.kind)
        where = np.searchsorted(owner, np.arange(texts + 1)).tolist()
        return [
            np.diff(cut[0]), np.diff(cut[1]), groups, n_links, self._hashes(texts, ids, cut, cut_a, cut_b),
            [key[x:y].tobytes() for x, y in zip(where[:-1], where[1:], strict=True)], [times[x:y].tobytes() for x, y in zip(where[:-1], where[1:], strict=True)],
        ]

    def _hashes(self, texts: int, ids: list[np.ndarray], cut: list[np.ndarray], cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups as text."""
        last = []
        for x, c in zip(ids, (cut_a, cut_b), strict=True):
            mark = np.zeros(len(x), bool)
            mark[c] = True
            last.append(mark)
        group = [np.cumsum(m) - m for m in last]
        in_group = [np.bincount(g, minlength=len(cut_a)) for g in group]
        ahead = [np.cumsum(n) for n in in_group]
        # a group's A tokens stand behind all B tokens of the groups before it, its B tokens behind all A tokens up to its own
        place_a = np.arange(len(ids[0])) + (ahead[1] - in_group[1])[group[0]]
        place_b = np.arange(len(ids[1])) + ahead[0][group[1]]
        total = len(ids[0]) + len(ids[1])
        token, mark = np.empty(total, np.int64), np.empty(total, np.uint8)
        token[place_a], token[place_b] = ids
        mark[place_a] = np.where(last[0], ord("|"), ord(","))
        mark[place_b] = np.where(last[1], ord(";"), ord(","))
        size = self.width[token] + 1
        rows = self.digits[token]
        rows[:, -1] = mark
        text = rows[np.arange(rows.shape[1]) >= (rows.shape[1] - size)[:, None]]
        ends = np.concatenate(([0], np.cumsum(size)))[cut[0] + cut[1]].tolist()
        flat = memoryview(text)
        return [hashlib.sha256(flat[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:], strict=True)]


def linked(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE) -> DataFrame:
    """``doc_id`` and LINKED of every document: its different pairs (A's id times B's vocabulary plus B's id) with their numbers of links."""
    data_a, data_b = read(path_a), read(path_b)
    rows = docs.select(F.col("doc_id"), F.col("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *LINKED])
    names, kinds = schema.names, [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteBpe(data_a), PieceBpe(data_b))
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                for a, b in in_parts(texts):
                    columns = aligner(texts[a:b])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)
        del aligner
        give_back()

    prepare(docs.sparkSession)
    return rows.mapInArrow(run, schema)


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all cells, one cell after the other, and how many each has."""
    wide = np.dtype(kind).itemsize
    cells = [memoryview(x.as_buffer()) for x in column]
    return np.frombuffer(b"".join(cells), kind), np.fromiter((len(x) // wide for x in cells), np.int64, len(cells))


def pair_counts(found: DataFrame, base: int, kind: str) -> DataFrame:
    """``pair, n, best``: how many documents hold each pair linked, and whether no other pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, kind), np.zeros(0, np.int64)
        more: list[np.ndarray] = []

        def merge() -> None:
            nonlocal keys, counts
            fresh, n = np.unique(np.concatenate(more), return_counts=True)
            more.clear()
            every, place = np.unique(np.concatenate((keys, fresh)), return_inverse=True)
            keys, counts = every, np.bincount(place, np.concatenate((counts, n)), len(every)).astype(np.int64)

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            more.append(_flat(batch.column(0), kind)[0])
            if sum(map(len, more)) >= _HELD:
                merge()
            if len(keys) >= 2 * _HELD:  # what a task holds is bounded; a pair may then come more than once
                yield give()
                keys, counts = keys[:0], counts[:0]
        if more:
            merge()
        if len(keys):
            yield give()
        give_back()

    parts = found.select("pairs").mapInArrow(run, "pair long, n long")
    n = parts.groupBy("pair").agg(F.sum("n").alias("n"))
    # an A id has at most as many partners as B has ids
    return n.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / base))))


def _by_table(found: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """Sums over each document's links, from a table of all pairs that every task holds."""
    rows = counts.toArrow()
    order = np.argsort(rows["pair"].to_numpy())
    keys = rows["pair"].to_numpy()[order].astype(kind)
    table = found.sparkSession.sparkContext.broadcast((keys, rows["n"].to_numpy()[order], rows["best"].to_numpy()[order]))
    schema = T.StructType([*[f for f in found.schema.fields if f.name not in ("pairs", "times")], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = table.value
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            pairs, size = _flat(column("pairs"), kind)
            times, _ = _flat(column("times"), "<u4")
            at = np.searchsorted(keys, pairs)
            ends = np.concatenate(([0], np.cumsum(size)))
            sums = []
            for weight in (best, n):
                run_up = np.concatenate(([0], np.cumsum(weight[at] * times.astype(np.int64))))
                sums.append(pa.array(run_up[ends[1:]] - run_up[ends[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[column(c) for c in names[:-2]], *sums], names=names)
        give_back()

    return found.mapInArrow(run, schema)


def _by_join(found: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """The same by a join on the pair, whatever the number of pairs."""
    row = F.monotonically_increasing_id()
    found = checkpoint(found.withColumn("row", row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, size = _flat(batch.column(1), kind)
            times, _ = _flat(batch.column(2), "<u4")
            owner = np.repeat(batch.column(0).to_numpy(), size)
            for a in range(0, len(pairs), _HELD):
                cut = slice(a, a + _HELD)
                yield pa.RecordBatch.from_arrays([pa.array(owner[cut]), pa.array(pairs[cut].astype(np.int64)), pa.array(times[cut].astype(np.int64))], names=["row", "pair", "times"])

    links = found.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long").join(counts, "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    rest = [c for c in found.columns if c not in ("pairs", "times", "row")]
    return found.join(sums, "row", "left").select(*rest, zero("n_best"), zero("count_sum"))


def align(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE, table: int = TABLE) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of every row of ``docs``.

    A encodes a space and the text, B the text behind the space that it adds itself, both without special tokens.  A text that is
    null or empty, or that the bytes of A's or B's tokens don't spell, has no tokens: zeros and an empty hash.
    Rows that repeat, or whose id is null, are documents of their own.  An empty table gives no rows; other columns are ignored.  Texts
    are taken whole, whatever their length.  Up to ``table`` different pairs in the corpus are sent to the tasks as a table,
    measured first; beyond, documents' pairs are joined with them.  The result is written once to the checkpoint folder.
    """
    spark = prepare(docs.sparkSession)
    base = len(PieceBpe(read(path_b)).parts)
    kind = "<u4" if len(ByteBpe(read(path_a)).parts) * base <= 1 << 32 else "<u8"
    folder = f"{spark.sparkContext.getCheckpointDir()}/linked-{uuid.uuid4()}"
    try:
        linked(docs, path_a, path_b).write.option("compression", "zstd").parquet(folder)
        found = spark.read.parquet(folder)
        counts = checkpoint(pair_counts(found, base, kind))
        small = counts.limit(table + 1).count() <= table
        return checkpoint((_by_table if small else _by_join)(found, counts, kind))
    finally:
        remove(spark, folder)


def report(docs: DataFrame) -> DataFrame:
    return align(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
