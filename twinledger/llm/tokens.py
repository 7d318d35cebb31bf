"""Token ids of whole texts by public tokenizers, with each different chunk of the texts encoded once.

A chunk is a space and what stands behind it up to the next space that has neither white space nor a text's end beside it.
Neither tokenizer used here lets a token reach over such a place, so the ids of a text are those of its chunks, one after the
other.  Known chunks are kept for the batches to come while there is room.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .pieces import MODEL, Numbers

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", MODEL
#: Fixed value: the pre-tokenizer of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than the space itself.
_OTHERS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in _OTHERS)
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"
_CHARS = 1_000_000  # characters encoded together


def read(path: str) -> bytes:
    """A tokenizer's file, read where the driver runs; tasks get its bytes."""
    return Path(path).read_bytes()


def _regular(texts: pa.Array) -> np.ndarray:
    """Texts whose spaces all stand alone between characters that are no white space."""
    odd = pc.match_substring_regex(texts, f"  |^ | $| [{_CLASS}]|[{_CLASS}] ")
    return ~odd.to_numpy(zero_copy_only=False)


def _listed(chunks: pa.Array) -> list[str]:
    """The strings of an array, none of which holds a space: cut from one text, which is faster than one by one."""
    if not len(chunks):
        return []
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(chunks)], pa.int64()), chunks), pa.scalar(" ", chunks.type))[0].as_py().split(" ")


class ByteBpe:
    """A byte-level BPE from the file of the ``tokenizers`` library.

    ``special`` says whether the strings of special tokens stand for these; else they are plain text.
    Where merges are ranked by their ids, a faster library for the same vocabulary does the work.
    """

    def __init__(self, data: bytes, special: bool = False):
        told = json.loads(data)
        before = told.get("pre_tokenizer") or {}
        extra = [t for t in told.get("added_tokens", []) if t["special"]]
        if told.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("needs a byte-level BPE without a normalizer or a prefix space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in extra):
            raise ValueError("special tokens must not reach for white space")
        # byte-level alphabets write printable bytes as themselves and the others, in order, from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        names = {t["content"]: t["id"] for t in extra}
        vocab = told["model"]["vocab"]
        ranks = {bytes(map(letter.__getitem__, w)): i for w, i in vocab.items() if w not in names}
        self.parts = [b""] * (1 + max([*vocab.values(), *names.values()]))
        for w, i in [*ranks.items(), *((w.encode(), i) for w, i in names.items())]:
            self.parts[i] = w
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        made = [vocab.get(a + b, -1) for a, b in pairs]
        self.names = [n for n in names if n] if special else []
        if made == sorted(set(made)) and not told["model"].get("ignore_merges"):
            import tiktoken

            bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={n: names[n] for n in self.names})
            self._many, self._one = bpe.encode_ordinary, lambda t: bpe.encode(t, allowed_special="all", disallowed_special=())
        else:
            import tokenizers

            bpe = tokenizers.Tokenizer.from_str(data.decode())
            bpe.encode_special_tokens = not special
            self._many = self._one = lambda t: bpe.encode(t, add_special_tokens=False).ids
        self.lengths = np.fromiter(map(len, self.parts), np.int64, len(self.parts))

    def encode(self, chunks: list[str | tuple[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, how many each has, and whether they spell it.

        A chunk is what stands behind a space; a tuple holds a text's first chunk, which has none."""
        alone = [k for k, c in enumerate(chunks) if type(c) is tuple or not c or c[0].isspace() or c[-1].isspace()]
        if self.names and any(n in "\0".join(c for c in chunks if type(c) is str) for n in self.names):
            alone = sorted({*alone, *(k for k, c in enumerate(chunks) if any(n in c for n in self.names))})
        lone = np.zeros(len(chunks), bool)
        lone[alone] = True
        flat = [c for c, x in zip(chunks, lone.tolist(), strict=True) if not x] if alone else chunks
        # all others in one text: tokens never reach over the spaces, so chunks are found again by bytes
        ids = np.array(self._many(" " + " ".join(flat)) if flat else [], np.int32)
        size = np.zeros(len(chunks), np.int64)
        if flat:
            ends = np.cumsum(pc.binary_length(pa.array(flat, pa.string())).to_numpy() + 1)
            size[~lone] = np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), ends, "left") + 1, prepend=0)
        own = [self._one(c[0] if type(c) is tuple else f" {c}" if c else "") for c in (chunks[k] for k in alone)]
        size[alone] = list(map(len, own))
        out = np.empty(int(size.sum()), np.int32)
        mine = np.repeat(lone, size)
        out[~mine] = ids
        out[mine] = list(chain.from_iterable(own))
        return out, size, np.ones(len(chunks), bool)


class PieceBpe:
    """A SentencePiece model that puts a space before texts: the chunk behind its space is what it is given."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.parts = [bytes([int(n[1:-1], 16)]) if sp.is_byte(i) else n.replace(_SPACE, " ").encode() for i, n in enumerate(names)]
        self.lengths = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        if any(_SPACE in n.lstrip(_SPACE) for n in names):
            raise ValueError("pieces must not hold a space behind a letter")

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``ByteBpe.encode``."""
        found = self.sp.encode(chunks, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        want = [f" {c}".encode() if c else b"" for c in chunks]
        ends = np.cumsum(counts)
        total = np.concatenate(([0], np.cumsum(self.lengths[ids])))[np.concatenate(([0], ends))]
        same = np.diff(total) == np.fromiter(map(len, want), np.int64, len(want))
        part, listed = self.parts, ids.tolist()
        if not same.all() or b"".join([part[i] for i in listed]) != b"".join(want):
            same = np.array([b"".join([part[i] for i in listed[a:b]]) == w for a, b, w in zip([0, *ends.tolist()], ends.tolist(), want, strict=False)], bool)
        return ids, counts, same


@dataclass
class _Table:
    ids: np.ndarray
    first: np.ndarray  # where each chunk's ids begin, and the end of all
    spells: np.ndarray  # whether the ids' bytes are the chunk's


class Encoder:
    """Ids of texts by one or several tokenizers, chunk by chunk.

    With ``lead`` texts stand behind a space.  ``room`` bounds the characters of the chunks that are kept; what doesn't fit
    begins anew and changes no result.
    """

    def __init__(self, tokenizers: list[ByteBpe | PieceBpe], lead: bool, room: int = 8 << 20):
        self.tokenizers, self.lead, self.room = tokenizers, lead, room
        self._clear()

    def _clear(self) -> None:
        self.known, self.chars = Numbers(), 0
        self.tables = [_Table(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)) for _ in self.tokenizers]

    def _odd(self, text: str) -> list[str | tuple[str]]:
        """Chunks of a text that isn't regular."""
        first, *rest = _CUT.split(text)
        return [first if self.lead else (first,), *rest]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all chunks, one text after the other, and where each text's begin."""
        column = pa.array(texts, pa.large_string())
        fine = _regular(column)
        lists = pc.split_pattern(column.filter(pa.array(fine)), " ")
        counts = np.zeros(len(texts), np.int64)
        counts[fine] = np.diff(lists.offsets.to_numpy())
        odd = {int(k): self._odd(texts[k]) for k in np.flatnonzero(~fine)}
        for k, own in odd.items():
            counts[k] = len(own)
        at = np.concatenate(([0], np.cumsum(counts)))
        coded = lists.flatten().dictionary_encode()
        local, place = _listed(coded.dictionary), coded.indices.to_numpy()
        heads = [] if self.lead else [texts[k].split(" ", 1)[0] for k in np.flatnonzero(fine).tolist()]
        parts = [local, [(h,) for h in heads], *odd.values()]
        seen = len(self.known)
        flat = lambda: np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        number = flat()
        new = list(islice(self.known, seen, None))
        chars = sum(map(len, new))
        if seen and self.chars + chars > self.room:
            self._clear()
            number = flat()
            new = list(self.known)
            chars = sum(map(len, new))
        self.chars += chars
        if new:
            for n, (t, table) in enumerate(zip(self.tokenizers, self.tables, strict=True)):
                ids, sizes, same = t.encode(new)
                self.tables[n] = _Table(np.concatenate((table.ids, ids)), np.concatenate((table.first, table.first[-1] + np.cumsum(sizes))), np.concatenate((table.spells, same)))
        out = np.empty(int(at[-1]), np.int64)
        out[np.repeat(fine, counts)] = number[place]
        if heads:
            out[at[:-1][fine]] = number[len(local) : len(local) + len(heads)]
        begin = len(local) + len(heads)
        for k, own in odd.items():
            out[at[k] : at[k + 1]] = number[begin : begin + len(own)]
            begin += len(own)
        return out, at

    def ids(self, n: int, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the ``n``-th tokenizer for chunk numbers, one after the other, and how many each chunk has."""
        table = self.tables[n]
        start = table.first[chunks]
        counts = table.first[chunks + 1] - start
        ends = np.cumsum(counts)
        return table.ids[np.arange(int(counts.sum())) + np.repeat(start - ends + counts, counts)], counts


def in_parts(texts: list[str], most: int = _CHARS) -> list[tuple[int, int]]:
    """Runs of texts of about ``most`` characters; a longer text is a run of its own."""
    out, at, held = [], 0, 0
    for k, t in enumerate(texts):
        if k > at and held + len(t) > most:
            out.append((at, k))
            at, held = k, 0
        held += len(t)
    return [*out, (at, len(texts))] if len(texts) > at else out

