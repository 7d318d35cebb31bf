"""Quality classifier on supervised subword embeddings.

A word (a run without ASCII white space, case and punctuation kept) has a hashed vector
for itself and one for each of its character n-grams; its own vector is their mean, and a
document's vector the mean over its words.  A softmax layer turns that into class
probabilities.  Vectors and layer are learned by numpy stochastic gradient descent.

All of it is linear up to the softmax, so in scoring each hashed feature shrinks to one number,
its part of the difference of the two classes, and a word to the mean of these.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, crc_bucket, labelled_sample, pick, texts_of

BUCKETS, DIM, NGRAMS = 1 << 17, 16, (3, 4)
#: Labels are learned from rows whose crc32 of the id modulo 3 is not 1.
MODULUS, HELD = 3, 1
#: Most labelled rows read for training.
SAMPLE = 3000
_CACHE = 200_000


#: Stands in a document's word list once for each word that repeats the one before it.
SAME = b"\x00same"


def words_of(text: str) -> list[bytes]:
    own = text.encode("utf-8", "surrogatepass").split()
    return own + [SAME] * sum(map(eq, own, own[1:]))


def feature_ids(word: bytes) -> list[int]:
    """Hashes of the word and of its character n-grams with both ends marked."""
    marked = f"<{word.decode('utf-8', 'surrogatepass')}>"
    grams = {marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)}
    crc = zlib.crc32
    return [crc(b"=" + word) % BUCKETS, *[crc(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]]


@dataclass
class Model:
    parts: np.ndarray  # of each hashed feature, class 1 against class 0
    bias: float


def train(rows: list[tuple[str, int]], epochs: int = 10, rate: float = 4.0, seed: int = 1) -> Model:
    """Learn on labelled texts and fold what was learned to a number for each feature; without texts every score is one half."""
    vectors, layer, bias = learn(rows, epochs, rate, seed)
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def learn(rows: list[tuple[str, int]], epochs: int = 10, rate: float = 4.0, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the hashed features, weights and bias of the softmax layer."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2)
    known: dict[bytes, list[int]] = {}
    docs = []
    for text, y in rows:
        count = Counter(words_of(text))
        total = sum(count.values())
        ids, share = [], []
        for w, n in count.items():
            own = known.get(w) or known.setdefault(w, feature_ids(w))
            ids += own
            share += [n / total / len(own)] * len(own)
        used, back = np.unique(np.array(ids, np.int32), return_inverse=True)
        docs.append((used, np.bincount(back, weights=share, minlength=len(used)).astype(np.float32), int(y)))
    known.clear()
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, share, y = docs[i]
            now = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            out = layer @ hidden + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[y] -= 1  # gradient of the loss by the outputs
            back = p @ layer
            layer -= np.float32(now / 8) * np.outer(p, hidden).astype(np.float32)
            bias -= now / 80 * p
            if len(ids):
                vectors[ids] -= np.float32(now) * share[:, None] * back.astype(np.float32)
    return vectors, layer, bias


class Words(dict):
    """Part of each word in the score, worked out once while it stays in the table."""

    def __init__(self, parts: np.ndarray):
        super().__init__()
        self.part = parts.tolist().__getitem__

    def __missing__(self, word: bytes) -> float:
        if len(self) >= _CACHE:
            self.clear()
        ids = feature_ids(word)
        out = self[word] = sum(map(self.part, ids)) / len(ids)
        return out


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of class 1; null and wordless texts get that of the bias.

    Rows are scored each on their own, so repeated rows and null ids don't matter; a column of that name is
    replaced.
    """

    def make():
        words = Words(model.parts)

        def one(text: str) -> float:
            own = words_of(text)
            z = model.bias + (sum(map(words.__getitem__, own)) / len(own) if own else 0.0)
            return 1 / (1 + float(np.exp(-min(max(z, -30.0), 30.0))))

        return lambda batch: [pa.array([one(x) for x in texts_of(batch, "text")], pa.float64())]

    return add_columns(docs, [T.StructField(name, T.DoubleType())], make)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Train on at most ``bound`` labelled rows, none of them held out."""
    return train(labelled_sample(docs, labels, "quality", MODULUS, HELD, bound))


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    ``held_out`` of a null id is false; such rows are scored like any other.  Null texts are scored as empty ones.  An empty
    table gives no rows; a text is scored whole, whatever its length.
    """
    out = score(pick(docs, "doc_id", "text"), fit(docs, labels, bound), "score")
    held = F.coalesce(crc_bucket(F.col("doc_id"), MODULUS) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
