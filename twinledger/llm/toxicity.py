"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of word characters, each lower-cased.  Labelled tokens come from the training rows alone: a
word or word beginning that occurs in several toxic documents and almost only there marks
its tokens in toxic documents.  The field has two states (plain, toxic); a token's features are
hashes of the word, its beginnings and its ending, so it also tags words never seen
in training.  Forward and backward messages give each token's marginal, and a small
logistic model turns a document's marginals into its score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, crc_bucket, labelled_sample, pick, texts_of

TOKEN = re.compile(r"\w+")
BUCKETS = 1 << 17
#: Labels are learned from rows whose crc32 of the id modulo 5 is not 0.
MODULUS, HELD = 5, 0
#: Most labelled rows read for training.
SAMPLE = 4000
_CACHE = 200_000


def tokenize(text: str) -> list[str]:
    return [w.lower() for w in TOKEN.findall(text)]


def pieces(word: str) -> list[str]:
    """What a token is known by: the word, its beginnings and its ending."""
    return [f"={word}", *[f"^{word[:n]}" for n in (3, 4, 5, 6, 7) if len(word) >= n], f"{word[-3:]}$"]


def feature_ids(word: str) -> list[int]:
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in pieces(word)]


@dataclass
class Model:
    weights: np.ndarray  # of each hashed feature, for toxic against plain
    moves: np.ndarray  # 2 x 2, log weight of going from one state to the next
    first: float  # log weight of starting toxic
    head: np.ndarray  # of the logistic model over a document's summary


def _messages(psi: np.ndarray, head: np.ndarray, a: np.ndarray, s: float) -> np.ndarray:
    """Ratio toxic : plain of the forward messages at every token of a batch of texts.

    ``head`` marks the first token of each text.  All tokens are updated at once from their
    predecessors until nothing changes, each round only where the predecessor has changed: the
    same numbers as one pass from left to right, in as many rounds as a message travels.
    """
    r = psi * (a[0, 1] / a[0, 0])
    r[head] = psi[head] * s
    todo = np.flatnonzero(~head)
    while len(todo):
        before = r[todo - 1]
        new = psi[todo] * (a[0, 1] + before * a[1, 1]) / (a[0, 0] + before * a[1, 0])
        moved = np.abs(new - r[todo]) > 1e-13 * np.abs(new)
        r[todo] = new
        todo = todo[moved] + 1
        todo = todo[todo < len(r)]
        todo = todo[~head[todo]]
    return r


def _back(psi: np.ndarray, tail: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Ratio of the backward messages, in the same way from the right."""
    b = np.full(len(psi), (a[1, 0] + a[1, 1] * 0) / a[0, 0])
    b[tail] = 1.0
    todo = np.flatnonzero(~tail)
    while len(todo):
        x = psi[todo + 1] * b[todo + 1]
        new = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
        moved = np.abs(new - b[todo]) > 1e-13 * np.abs(new)
        b[todo] = new
        todo = todo[moved] - 1
        todo = todo[todo >= 0]
        todo = todo[~tail[todo]]
    return b


def marginals(scores: np.ndarray, sizes: np.ndarray, model: Model, pairs: bool = False):
    """Probability of toxic at every token; ``sizes`` cuts the tokens into texts.

    With ``pairs`` also the expected number of each move and of toxic starts, for training.
    """
    n = len(scores)
    psi = np.exp(np.clip(scores, -30, 30))
    a, s = np.exp(model.moves), float(np.exp(model.first))
    ends = np.cumsum(sizes[sizes > 0])
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[ends - sizes[sizes > 0]] = True
    tail[ends - 1] = True
    r, b = _messages(psi, head, a, s), _back(psi, tail, a)
    p = r * b / (1 + r * b)
    if not pairs:
        return p
    t = np.flatnonzero(~head)
    fr, bx = r[t - 1], psi[t] * b[t]
    joint = np.stack([np.full(len(t), a[0, 0]), a[0, 1] * bx, fr * a[1, 0], fr * a[1, 1] * bx])
    joint /= joint.sum(axis=0)
    return p, joint.sum(axis=1).reshape(2, 2), p[head].sum()


def summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text: 1, log odds of the highest marginal, log of the expected toxic tokens, log of its length."""
    out = np.zeros((len(sizes), 4))
    out[:, 0] = 1
    full = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[full]
    top, total = np.zeros(len(sizes)), np.zeros(len(sizes))
    if len(p):
        top[full], total[full] = np.maximum.reduceat(p, starts), np.add.reduceat(p, starts)
    top = np.clip(top, 1e-4, 1 - 1e-4)
    out[:, 1] = np.log(top / (1 - top))
    out[:, 2] = np.log(total + 0.02)
    out[:, 3] = np.log1p(sizes)
    return out


def mark(texts: list[str], labels: list[int], least: int = 3, purity: float = 0.9) -> list[np.ndarray]:
    """Labelled tokens: for each text, which tokens are toxic."""
    seen = [Counter(), Counter()]
    tokens = [tokenize(x) for x in texts]
    for words, y in zip(tokens, labels, strict=True):
        seen[y].update({p for w in set(words) for p in pieces(w)[:-1]})
    prior = max(1, sum(labels)) / max(1, len(labels))
    bad = {p for p, n in seen[1].items() if n >= least and n / (n + seen[0][p]) >= purity and n / (n + seen[0][p]) > prior}
    return [np.array([bool(y) and any(p in bad for p in pieces(w)[:-1]) for w in words], bool) for words, y in zip(tokens, labels, strict=True)]


def train(rows: list[tuple[str, int]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-6, seed: int = 1) -> Model:
    """Fit the field and the document model on labelled texts by stochastic gradient ascent."""
    rng = np.random.default_rng(seed)
    texts, labels = [t for t, _ in rows], [int(y) for _, y in rows]
    model = Model(np.zeros(BUCKETS), np.array([[0.0, -2.0], [-1.0, 0.0]]), -3.0, np.array([-1.0, 1.0, 0.0, 0.0]))
    if not rows:
        return model
    known: dict[str, int] = {}
    ids: list[list[int]] = []
    docs = []
    for text, y in zip(texts, mark(texts, labels), strict=True):
        own = np.fromiter((known.setdefault(w, len(known)) for w in tokenize(text)), np.int64)
        docs.append((own, y))
    ids = [feature_ids(w) for w in known]
    width = max((len(x) for x in ids), default=1)
    table = np.full((len(ids), width), BUCKETS, np.int64)  # the last place stays zero
    for i, x in enumerate(ids):
        table[i, : len(x)] = x
    weights, power = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-2)
    move_power, first_power = np.full((2, 2), 1.0), 1.0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 64):
            part = [docs[i] for i in order[at : at + 64]]
            sizes = np.array([len(x) for x, _ in part])
            if not sizes.sum():
                continue
            words, y = np.concatenate([x for x, _ in part]), np.concatenate([v for _, v in part])
            model.weights = weights
            used, back = np.unique(words, return_inverse=True)
            p, moved, started = marginals(weights[table[used]].sum(axis=1)[back], sizes, model, pairs=True)
            by_word = np.bincount(back, weights=y - p, minlength=len(used))
            grad = np.bincount(table[used].ravel(), weights=np.repeat(by_word, width), minlength=BUCKETS + 1)
            grad -= decay * len(words) * weights
            grad[BUCKETS] = 0
            power += grad * grad
            weights += rate * grad / np.sqrt(power)
            head = np.zeros(len(words), bool)
            head[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            t = np.flatnonzero(~head)
            real = np.bincount(2 * y[t - 1] + y[t], minlength=4).reshape(2, 2)
            g = (real - moved) / len(words)
            move_power += g * g
            model.moves = np.clip(model.moves + rate * g / np.sqrt(move_power), -8, 4)
            g = (y[head].sum() - started) / len(part)
            first_power += g * g
            model.first = float(np.clip(model.first + rate * g / np.sqrt(first_power), -8, 2))
    model.weights = weights[:BUCKETS]
    per_word = weights[table].sum(axis=1)
    sizes = np.array([len(x) for x, _ in docs])
    p = marginals(per_word[np.concatenate([x for x, _ in docs])], sizes, model)
    x, y = summary(p, sizes), np.array(labels, float)
    mean, std = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    mean[0], std[0] = 0, 1
    z, head = (x - mean) / std, np.zeros(4)
    for _ in range(500):  # logistic regression, Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(z @ head, -30, 30)))
        h = (z * (q * (1 - q))[:, None]).T @ z + 1e-2 * len(z) / 100 * np.eye(4)
        step = np.linalg.solve(h, z.T @ (y - q) - 1e-2 * len(z) / 100 * head)
        head += step
        if np.abs(step).max() < 1e-9:
            break
    model.head = head / std
    model.head[0] = head[0] - (head[1:] * mean[1:] / std[1:]).sum()
    return model


class Words(dict):
    """Emission of each token as it is written, worked out once while it stays in the table."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weight = weights.tolist().__getitem__

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHE:
            self.clear()
        out = self[word] = sum(map(self.weight, feature_ids(word.lower())))
        return out


FIELDS = [
    T.StructField("toxicity", T.DoubleType()),
    T.StructField("toxic_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
]


def tag(docs: DataFrame, model: Model, least: float = 0.5, tokens: int = 2_000_000) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic_spans`` (code points, end exclusive).

    Spans are the tokens with a marginal of ``least`` or more, neighbours joined.  Null and wordless
    texts are scored by the document model alone and have no spans.  Rows are scored each on their own, so
    repeated rows and null ids don't matter; columns named like an output are replaced.
    """

    def make():
        words = Words(model.weights)

        def spans(text: str, p: np.ndarray) -> list[dict]:
            if not len(p) or p.max() < least:
                return []
            out: list[dict] = []
            at = [m.span() for m in TOKEN.finditer(text)]
            for i in np.flatnonzero(p >= least).tolist():
                if out and out[-1]["i"] == i - 1:
                    out[-1].update(i=i, end=at[i][1])
                else:
                    out.append({"i": i, "start": at[i][0], "end": at[i][1]})
            return [{"start": x["start"], "end": x["end"]} for x in out]

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts, scores, found = texts_of(batch, "text"), [], []
            held: list[np.ndarray] = []
            first = 0

            def flush(to: int) -> None:
                sizes = np.array([len(x) for x in held])
                p = marginals(np.concatenate(held) if held else np.zeros(0), sizes, model) if sizes.sum() else np.zeros(0)
                z = summary(p, sizes) @ model.head
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                cuts = np.cumsum(sizes)[:-1] if len(sizes) else []
                found.extend(spans(t, q) for t, q in zip(texts[first:to], np.split(p, cuts), strict=True))
                held.clear()

            n = 0
            for i, text in enumerate(texts):
                own = TOKEN.findall(text)
                held.append(np.fromiter(map(words.__getitem__, own), np.float64, len(own)))
                n += len(own)
                if n >= tokens:
                    flush(i + 1)
                    first, n = i + 1, 0
            if held:
                flush(len(texts))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return [pa.array(np.concatenate(scores)), pa.array(found, kind)]

        return work

    return add_columns(docs, FIELDS, make)


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted, toxic_spans`` of every row of ``docs``.

    At most ``bound`` labelled rows, none of them held out, train the model.  Without labelled
    rows the scores say nothing but the prior.  ``held_out`` of a null id is false.  Null texts are scored as empty ones, repeated
    rows each on their own.  An empty table gives no rows; a text is tagged whole, whatever its length.
    """
    model = train(labelled_sample(docs, labels, "toxic", MODULUS, HELD, bound))
    out = tag(pick(docs, "doc_id", "text"), model)
    held = F.coalesce(crc_bucket(F.col("doc_id"), MODULUS) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
