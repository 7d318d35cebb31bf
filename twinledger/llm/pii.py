"""Personal data: fixed patterns, and a linear-chain conditional random field that adds to them.

The patterns give the base spans.  The field sees tokens (runs without white space) by word
shape only: the token's own shapes and those of its neighbours.  It is trained from the small
labelled table below, and decoded by Viterbi in numpy batches.  Only tokens with a digit
or an at sign, and their direct neighbours, may have a label; so a text's tokens fall into short
windows that are decoded on their own with the same result as the whole text.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, pick, texts_of, unused

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't begin inside a run of digits: what stops it at the run's start stops it later too.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[^\W\d_]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, each found from its at sign, in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            out.append((start, end.end()))
        free = end.end() if end else at + 1
        at = text.find("@", free)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) by the patterns, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


# ---- the field ----

LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
BUCKETS = 1 << 12
_TOUCHED = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")

#: The labelled table.  A span stands in brackets with its kind; # is any digit, h a hexadecimal one, w a made-up word.
TABLE = """
reach me at [email|w@w] please
reach me at [email|w.w@w] or later
mail [email|w @ w.w] today
mail [email|w.## @ w.w.w] today
send to [email|w##@w##] now
write [email|w_w@w] .
w w [email|w.##@w#.w.w] w w
w [email|w@w.w] , w w
my number is [phone|(###) ###-####] w
my number is [phone|(###) ### ####] w
call [phone|###-###-####] after w
call [phone|###.###.####] w w
w w [phone|### ### ####] w
ring [phone|(###)###-####] w
w w [phone|+# (###) ###-####] w w
w [phone|+## ### ### ####] w
phone [phone|0## ### #####] w
w [phone|00## ### #######] w
card [card|#### #### #### ####] w
w [card|####-####-####-####] w w
w [card|####.####.####.####] w w
w [card|####/####/####/####] w
w w [card|################] w w
pay with [card|#### ###### #####] w
card number [card|#### #### #### ####] expires ##/##
server [ip|###.###.###.###] w
w w [ip|##.###.##.#] w w
host [ip|#.##.###.##] down
w [ip|192.168.#.##:####] w
w w w w
w w , w w .
w w. W w w w. W w
Licensed under the W License, Version #.#.
version #.#.# of w
version ##.#.# w w
in #### w w
w in ####, w w
on ####-##-## w w
on ##/##/#### w
at ##:## w w
at ##:##:## w w
page ## of ###
w # w ## w ###
chapter # section #.#
price ##.## or ###.## w
$ #,### w
costs ##,### w w
##% of w
room ### floor #
token = "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh"
w w token = "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh" w w
key hhhhhhhhhhhhhhhh w
w hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh w
w@ w w
@w w w
@w## said w
w w @ w w
w w @ ## w
(#) w w (##) w
[##] w w
w### w W## w
###w w
isbn ###-#-##-######-# w
order ######## w
order number ########## w w
id ###### w ######
w | w## | ## | w
#### | #### | w
# # # # # #
## ## ## w
### ### w
#### - #### w w
#### - ####
w - ## - w
w*** ##### w%%%
""".strip().splitlines()


def _table(copies: int = 12, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """The table with its placeholders filled, some copies of each line: tokens and labels."""
    rng = np.random.default_rng(seed)
    pick_of = lambda s: s[int(rng.integers(len(s)))]
    word = lambda: "".join(pick_of("bcdfglmnprst") + pick_of("aeiou") for _ in range(int(rng.integers(1, 5))))

    def fill(part: str) -> str:
        part = re.sub(r"(?<![A-Za-z])w(?![A-Za-z])", lambda m: word(), part)
        part = re.sub(r"(?<![A-Za-z])W(?![A-Za-z])", lambda m: word().capitalize(), part)
        part = re.sub(r"h{4,}", lambda m: "".join(pick_of("0123456789abcdef") for _ in m.group()), part)
        part = re.sub("#", lambda m: pick_of("0123456789"), part)
        return part.upper() if rng.random() < 0.1 else part

    tail = ("", "", "", ".", ",", "!!", "***", "%%%", "###", "$$$", ")")
    out = []
    for line in TABLE * copies:
        tokens, labels = [], []
        for kind, span, plain in re.findall(r"\[(email|ip|card|phone)\|([^\]]+)\]|((?:(?!\[(?:email|ip|card|phone)\|).)+)", line):
            own = fill(span or plain).split()
            labels += [(1 + 2 * KINDS.index(kind) + (i > 0)) if kind else 0 for i in range(len(own))]
            if kind and own:
                own[-1] += pick_of(tail)
            tokens += own
        out.append((tokens, labels))
    return out


def shapes(token: str) -> tuple[str, str]:
    """The token's shape with its letter runs shortened, and one with all runs shortened."""
    core = token.strip("\"'.,;:!?*%#$&|<>")
    exact = _LETTERS.sub(lambda m: "A" if m.group().isupper() else "a", _DIGIT.sub("9", core))
    return exact, re.sub(r"9+", "9", exact)


@functools.lru_cache(100_000)
def feature_ids(before: str, token: str, after: str) -> tuple[int, ...]:
    """Hashed word-shape features of a token between its neighbours; '' stands for none."""
    exact, short = shapes(token)
    digits = sum(c in "0123456789" for c in token)
    names = [
        "bias", f"e {exact}", f"s {short}", f"n {min(digits, 20)}", f"@ {token.count('@')}", f"len {min(len(token), 20)}",
        f"b {shapes(before)[1]}", f"a {shapes(after)[1]}", f"be {shapes(before)[0]}", f"ae {shapes(after)[0]}",
        f"bs {shapes(before)[0]} {short}", f"as {short} {shapes(after)[0]}", f"+ {token[:1]}", f"alpha {any(c.isalpha() for c in token)}",
    ]
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names)


_ALLOWED = np.array([[not b.startswith("I") or a[1:] == b[1:] for b in LABELS] for a in LABELS])
_START = np.array([not b.startswith("I") for b in LABELS])
_OFF = -1e9


def _windows(tokens: list[str]) -> list[tuple[int, int]]:
    """Ranges of tokens that may have a label: those with a digit or at sign and their neighbours."""
    near = sorted({j for i, t in enumerate(tokens) if re.search("[0-9@]", t) for j in (i - 1, i, i + 1) if 0 <= j < len(tokens)})
    out: list[list[int]] = []
    for i in near:
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return [(a, b) for a, b in out]


def _stack(rows: list[list[tuple[int, ...]]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions of windows laid side by side (windows, tokens, labels), and the windows' lengths."""
    sizes = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), sizes.max(), len(LABELS)))
    flat = np.array([f for r in rows for f in r])
    where = np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.arange(n) for n in sizes])
    out[where] = weights[flat].sum(axis=1)
    return out, sizes


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - m).sum(axis=axis, keepdims=True)) + m).squeeze(axis)


class Field:
    """Weights of hashed features for each label, and of moves between labels."""

    def __init__(self) -> None:
        self.weights = np.zeros((BUCKETS, len(LABELS)))
        self.moves = np.where(_ALLOWED, 0.0, _OFF)

    def viterbi(self, rows: list[list[tuple[int, ...]]]) -> list[np.ndarray]:
        """Best labels of each window, windows of like length together."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 4096 and len(rows[order[end]]) <= 2 * len(rows[order[at]]):
                end += 1
            e, sizes = _stack([rows[i] for i in order[at:end]], self.weights)
            best = np.where(_START, e[:, 0], _OFF)
            back = np.zeros(e.shape, np.int16)
            for t in range(1, e.shape[1]):
                way = best[:, :, None] + self.moves
                back[:, t] = way.argmax(axis=1)
                best = np.where((t < sizes)[:, None], way.max(axis=1) + e[:, t], best)
            state, path = best.argmax(axis=1), np.zeros(e.shape[:2], int)
            for t in range(e.shape[1] - 1, -1, -1):
                path[:, t] = state
                state = np.where(t < sizes, back[np.arange(len(state)), t, state], state) if t else state
            for k, i in enumerate(order[at:end]):
                out[i] = path[k, : sizes[k]]
            at = end
        return out

    def fit(self, rows: list[list[tuple[int, ...]]], labels: list[list[int]], rounds: int = 80, rate: float = 0.4, decay: float = 0.02) -> None:
        """Gradient ascent on the likelihood, all windows at once."""
        k = len(LABELS)
        sizes = np.array([len(r) for r in rows])
        where = np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.arange(n) for n in sizes])
        flat, gold = np.array([f for r in rows for f in r]), np.concatenate(labels)
        real = np.zeros((k, k))
        for y in labels:
            np.add.at(real, (y[:-1], y[1:]), 1)
        power_w, power_m = np.full(self.weights.shape, 1e-3), np.full((k, k), 1e-3)
        for _ in range(rounds):
            e, _ = _stack(rows, self.weights)
            width = e.shape[1]
            f, b = np.zeros(e.shape), np.zeros(e.shape)
            f[:, 0] = np.where(_START, e[:, 0], _OFF)
            for t in range(1, width):
                f[:, t] = _lse(f[:, t - 1][:, :, None] + self.moves, 1) + e[:, t]
            for t in range(width - 2, -1, -1):
                step = _lse(self.moves + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
                b[:, t] = np.where((t + 1 < sizes)[:, None], step, 0.0)
            p = f + b
            p = np.exp(p - _lse(p, 2)[:, :, None])[where]
            total = _lse(f[np.arange(len(rows)), sizes - 1], 1)
            moved = np.zeros((k, k))
            for t in range(1, width):
                on = t < sizes
                x = f[on, t - 1][:, :, None] + self.moves + (e[on, t] + b[on, t])[:, None, :] - total[on][:, None, None]
                moved += np.exp(x).sum(axis=0)
            diff = -p
            diff[np.arange(len(gold)), gold] += 1
            grad = np.zeros(self.weights.shape)
            np.add.at(grad, flat.ravel(), np.repeat(diff, flat.shape[1], axis=0))
            grad -= decay * self.weights
            power_w += grad * grad
            self.weights += rate * grad / np.sqrt(power_w)
            grad = np.where(_ALLOWED, real - moved - decay * self.moves, 0.0)
            power_m += grad * grad
            self.moves += rate * grad / np.sqrt(power_m)


@functools.lru_cache(1)
def field() -> Field:
    """The field trained from the labelled table."""
    rows, labels = [], []
    for tokens, y in _table():
        for a, b in _windows(tokens):
            around = ["", *tokens, ""]
            rows.append([feature_ids(*around[i : i + 3]) for i in range(a, b)])
            labels.append(y[a:b])
    out = Field()
    out.fit(rows, labels)
    return out


def _touched(text: str) -> list[list[tuple[int, int]]]:
    """Windows of a text as places of their tokens, each with one more token on either side for context.

    A missing neighbour at the text's ends is an empty place.
    """
    cores = [m.span() for m in _TOUCHED.finditer(text)]
    if not cores:
        return []

    def before(i: int) -> tuple[int, int]:
        while i > 0 and text[i - 1].isspace():
            i -= 1
        end = i
        while i > 0 and not text[i - 1].isspace():
            i -= 1
        return i, end

    def after(i: int) -> tuple[int, int]:
        n = len(text)
        while i < n and text[i].isspace():
            i += 1
        start = i
        while i < n and not text[i].isspace():
            i += 1
        return start, i

    out: list[list[tuple[int, int]]] = []
    for span in cores:
        if out and span in out[-1][-2:]:  # already there as a neighbour
            run = out[-1][: out[-1].index(span) + 1]
        elif out and before(span[0]) in out[-1][-2:]:
            run = out[-1][: out[-1].index(before(span[0])) + 1] + [span]
        else:
            one = before(span[0])
            run = [before(one[0]), one, span]
            out.append([])
        one = after(span[1])
        out[-1] = run + [one, after(one[1])]
    return out


def plausible(kind: int, span: str) -> bool:
    """What a shape can't tell: a card passes Luhn, an address has parts up to 255, and so on."""
    digits = _DIGIT.findall(span)
    if kind == 0:
        return span.count("@") == 1
    if kind == 1:
        parts = re.findall("[0-9]+", span)[:4]
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    return 13 <= len(digits) <= 19 and _luhn("".join(digits)) if kind == 2 else 7 <= len(digits) <= 15


def added_spans(texts: list[str], model: Field) -> list[list[tuple[int, int, int]]]:
    """What the field finds in each text, without the marks around a span."""
    rows, places = [], []
    for k, text in enumerate(texts):
        for run in _touched(text):
            own = [text[a:b] for a, b in run]
            inner = [i for i in range(1, len(run) - 1) if own[i]]
            rows.append([feature_ids(own[i - 1], own[i], own[i + 1]) for i in inner])
            places.append((k, [run[i] for i in inner]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (k, run), labels in zip(places, model.viterbi(rows) if rows else [], strict=True):
        i = 0
        while i < len(labels):
            if labels[i] % 2 == 0:  # O; an I never comes first
                i += 1
                continue
            j = i + 1
            while j < len(labels) and labels[j] == labels[i] + 1:
                j += 1
            a, b = run[i][0], run[j - 1][1]
            inside = texts[k][a:b]
            b -= len(inside) - len(inside.rstrip("\"'.,;:!?*%#$&|<>])}"))
            inside = texts[k][a:b]
            a += len(inside) - len(inside.lstrip("\"'.,;:!?*%#$&|<>[{"))
            kind = int(labels[i]) // 2
            if a < b and plausible(kind, texts[k][a:b]):
                out[k].append((kind, a, b))
            i = j
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])


def find(docs: DataFrame, name: str = "pii") -> DataFrame:
    """``docs`` with ``pii`` (or ``name``): spans of personal data by kind as in KINDS, then start.

    Offsets count code points, the end is exclusive.  ``base`` tells the patterns' spans from those the
    field adds; the field adds only where no base span is.  Null and empty texts have none.  Rows are
    looked at each on their own, so repeated rows and null ids don't matter; a column of that name is replaced.  An empty
    table gives no rows, and texts are looked at whole, whatever their length.
    """
    model = field()

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = texts_of(batch, "text")
            out = []
            for base, more in zip(map(base_spans, texts), added_spans(texts, model), strict=True):
                new = [(*x, False) for x in more if not any(a < x[2] and x[1] < b for _, a, b in base)]
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": is_base} for k, a, b, is_base in sorted([*[(*x, True) for x in base], *new])])
            kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
            return [pa.array(out, pa.list_(kind))]

        return work

    return add_columns(docs, [T.StructField(name, T.ArrayType(SPAN))], make)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, of every row of ``docs``."""
    found = find(pick(docs, "doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("pii")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in capitals; ``n_chars`` follows where it exists.

    Overlapping spans go as one, under the first one's name.  Texts without spans stay as they are, null ones null.
    An empty table stays empty; a text is redacted whole, whatever its length.
    """
    names, spans, clean = docs.columns, unused(docs, "pii"), unused(docs, "clean")
    found = find(docs, spans)

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for text, own in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", spans)), strict=True):
                if own:
                    parts, at = [], 0
                    for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
                        at = max(at, s["end"])
                    text = "".join(parts) + text[at:]
                out.append(text)
            return [pa.array(out, pa.string())]

        return work

    done = add_columns(found, [T.StructField(clean, T.StringType())], make)
    length = F.when(F.size(spans) > 0, F.length(clean).cast("long"))
    new = {"text": F.col(clean), "n_chars": F.coalesce(length, F.col("n_chars")) if "n_chars" in names else None}
    return done.select(*[(F.col(f"`{c}`") if new.get(c) is None else new[c]).alias(c) for c in names])
