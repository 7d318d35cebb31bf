import hashlib
import itertools
import random
import re

import numpy as np

from twinledger.llm import pii

DOCS = "doc_id long, text string, pii string, n_chars long"


def luhn(d):
    t = 0
    for i, c in enumerate(d[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        t += n if n < 10 else n - 9
    return t % 10 == 0


def plain(text):
    """The contract's patterns as they are written."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(9)
    for _ in range(20000):
        t = "".join(rng.choice(["a", "b.", "@", ".", "1", "25", "4", "-", " ", "+", "(", ")", "é", "_", "@c.d", "1.2.3.4", "+1 55", "4111111111111111"]) for _ in range(rng.randint(0, 22)))
        assert pii.base_spans(t) == plain(t), t


def test_long_texts_are_linear():
    for t in ("a" * 300000 + "@", "1" * 300000 + ".", "@" * 100000, "+1 " * 50000, "9." * 100000, "x" * 400000 + " 1"):
        pii.base_spans(t)
        pii._touched(t)


def brute(model, row):
    def score(y):
        s = sum(model.weights[list(f), y[i]].sum() for i, f in enumerate(row)) + sum(model.moves[a, b] for a, b in zip(y, y[1:]))
        return s if pii._START[y[0]] else -1e12

    return max(itertools.product(range(len(pii.LABELS)), repeat=len(row)), key=score)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    m = pii.Field()
    m.weights += rng.normal(size=m.weights.shape)
    m.moves += np.where(pii._ALLOWED, rng.normal(size=m.moves.shape), 0)
    rows = [[tuple(rng.integers(0, pii.BUCKETS, 14)) for _ in range(n)] for n in (1, 2, 3, 4, 2, 4)]
    for row, got in zip(rows, m.viterbi(rows), strict=True):
        assert tuple(got) == brute(m, row)


def test_field_on_unseen_lines():
    m, wrong, n = pii.field(), 0, 0
    for tokens, y in pii._table(copies=3, seed=1234):
        for a, b in pii._windows(tokens):
            around = ["", *tokens, ""]
            wrong += list(m.viterbi([[pii.feature_ids(*around[i : i + 3]) for i in range(a, b)]])[0]) != y[a:b]
            n += 1
    assert wrong / n < 0.05


def test_windows_are_those_of_the_table():
    rng = random.Random(2)
    for _ in range(3000):
        tokens = [rng.choice(["ab", "c1", "x@y", "d", "7", "e", "f"]) for _ in range(rng.randint(0, 14))]
        text = "".join(t + rng.choice([" ", "  ", "\n"]) for t in tokens)
        got = [[text[a:b] for a, b in run] for run in pii._touched(text)]
        want = [[*(["", *tokens, ""][a : b + 2])] for a, b in pii._windows(tokens)]
        assert [[t for t in g[1:-1] if t] for g in got] == [w[1:-1] for w in want]
        for g, w in zip(got, want, strict=True):
            inner = [i for i in range(1, len(g) - 1) if g[i]]
            assert g[inner[0] - 1] == w[0] and g[inner[-1] + 1] == w[-1]


def test_rows(spark):
    text = "Élan j.doe@mail3.example.com, +1 (555) 555-5657 and 1.22.133.255 with 4111 1111 1111 1111. Call (555) 123-4567 now"
    rows = [(1, text, "x", 5), (1, text, "x", 5), (2, None, None, None), (None, "", "x", 0), (3, "clean words " * 20000, "x", 7), (4, "p 4111111111111112 q", "x", 20), (5, "+123456789@b.cd", "x", 3)]
    df = spark.createDataFrame(rows, DOCS)
    out = pii.report(df).collect()
    assert len(out) == len(rows)
    for r in out:
        t = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain(t))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, *_ in plain(t)) for j in range(4)]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        if r.doc_id == 1:
            a = text.index("(555) 123")
            assert f"phone:{a}:{a + 14}" in r.spans
        if r.doc_id in (2, None, 3, 4):
            assert r.spans == ""
    clean = pii.redact(df)
    assert clean.columns == ["doc_id", "text", "pii", "n_chars"]
    got = {r.doc_id: r for r in clean.collect()}
    assert got[1].text == "Élan <EMAIL>, <PHONE> and <IP> with <CARD>. Call <PHONE> now" and got[1].n_chars == len(got[1].text)
    assert got[3].text == rows[4][1] and got[2].text is None and got[2].n_chars is None and got[5].text == "<EMAIL>"
    assert pii.report(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0
