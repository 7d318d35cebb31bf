"""Edit distances of very many pairs of texts at once."""

from __future__ import annotations

import numpy as np

#: Bits of a word, and entries of the table of one step.
WORD, TABLE = 64, 1 << 21


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and each one's length."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def _table(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of one width, and which places are theirs."""
    there = np.arange(size.max(initial=0)) < size[:, None]
    out = np.zeros(there.shape, flat.dtype)
    out[there] = flat
    return out, there


def _short(patterns: list[str], texts: list[str], p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distances of ``patterns[p]``, each of 1 to 64 characters, and ``texts[t]``: a pair is one word of vertical differences
    (Myers, Hyyrö), and all pairs go on by one character of their text together."""
    flat, m = _codes(patterns)
    letters, own = np.unique(flat, return_inverse=True)
    width = len(letters) + 1
    if len(patterns) * width > TABLE and len(p) > 1:
        half = len(p) // 2
        return np.concatenate([_some(patterns, texts, p[:half], t[:half]), _some(patterns, texts, p[half:], t[half:])])
    own, there = _table(own.astype(np.int64), m)
    eq_of = np.zeros((len(patterns), width), np.uint64)
    for i in range(own.shape[1]):
        rows = np.flatnonzero(there[:, i])
        eq_of[rows, own[rows, i]] |= np.uint64(1 << i)
    eq_of = eq_of.ravel()
    flat, n = _codes(texts)
    place = np.minimum(np.searchsorted(letters, flat), len(letters) - 1)
    steps = np.ascontiguousarray(_table(np.where(letters[place] == flat, place, len(letters)), n)[0].T)
    order = np.argsort(-n[t], kind="stable") if n.min() < n.max() else np.arange(len(t))
    p, t = p[order], t[order]
    base, long = p * width, n[t]
    vp, vn = np.full(len(p), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(p), np.uint64)
    one = np.uint64(1)
    # how many pairs have a text of more than j characters
    going = np.searchsorted(-long, -np.arange(steps.shape[0]), "left")
    for j, k in enumerate(going.tolist()):
        if not k:
            break
        eq = eq_of.take(base[:k] + steps[j].take(t[:k], mode="clip"), mode="clip")  # all within, and so not looked at again
        up, down = vp[:k], vn[:k]
        xv = eq | down
        xh = eq & up
        xh += up
        xh ^= up
        xh |= eq
        ph = xh | up
        np.invert(ph, out=ph)
        ph |= down
        xh &= up  # falls from here on
        ph <<= one
        ph |= one
        xh <<= one
        np.bitwise_and(ph, xv, out=down)
        xv |= ph
        np.invert(xv, out=xv)
        np.bitwise_or(xh, xv, out=up)
    size = m[p].astype(np.uint64)
    mine = np.iinfo(np.uint64).max >> (np.uint64(WORD) - size)
    out = np.empty(len(p), np.int64)
    out[order] = long + np.bitwise_count(vp & mine) - np.bitwise_count(vn & mine)
    return out


def _some(patterns: list[str], texts: list[str], p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``_short`` of those texts that the pairs have."""

    def those(all_: list[str], at: np.ndarray) -> tuple[list[str], np.ndarray]:
        used = np.zeros(len(all_), bool)
        used[at] = True
        return [all_[i] for i in np.flatnonzero(used).tolist()], (np.cumsum(used) - 1)[at]

    (patterns, p), (texts, t) = those(patterns, p), those(texts, t)
    return _short(patterns, texts, p, t)


def _long(pattern: str, text: str) -> int:
    """The same for one pair, of any length, with one large number for the word."""
    full, at = (1 << len(pattern)) - 1, {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    vp, vn = full, 0
    for c in text:
        eq = at.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        ph = (vn | ~(xh | vp)) << 1 | 1
        mh = (vp & xh) << 1
        vp, vn = (mh | ~(xv | ph)) & full, ph & xv & full
    return len(text) + vp.bit_count() - vn.bit_count()


def edit_distances(a: list[str], b: list[str], at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Levenshtein distances, in code points, of ``a[at]`` and ``b[to]``, pair by pair; no text is empty."""
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.empty(len(at), np.int64)
    first = size_a[at] <= size_b[to]
    fits = np.minimum(size_a[at], size_b[to]) <= WORD
    for own, (x, y, p, t) in ((first, (a, b, at, to)), (~first, (b, a, to, at))):
        some = np.flatnonzero(own & fits)
        if len(some):
            out[some] = _some(x, y, p[some], t[some])
        for i in np.flatnonzero(own & ~fits).tolist():
            out[i] = _long(x[p[i]], y[t[i]])
    return out
