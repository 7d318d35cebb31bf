import random
import re
from itertools import permutations

from twinledger.llm import audit


def brute(rows, labels):
    def mask(doc, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        later = any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, _ in rows)
        tests = (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), later,
        )
        return frozenset(c for c, f in zip("ABCDE", tests, strict=True) if f)

    docs = [(p or "", mask(d, t or ""), any(x == d and q == 1 for x, q, _ in labels), any(x == d and q == 1 for x, _, q in labels)) for d, t, p in rows]
    out, value = {}, {}
    for part in {p for p, *_ in docs}:
        mine = [x for x in docs if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                redundant = sum(c in m and bool(m & set(order[: k - 1])) for _, m, _, _ in mine)
                left = [x for x in left if c not in x[1]]
                out[part, order, k] = [len(left), len(gone), redundant, sum(m == {c} for _, m, _, _ in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                value[part, c] = value.get((part, c), 0) + len(gone)
    return sorted((p, o, k, *v, value[p, o[k - 1]]) for (p, o, k), v in out.items())


def test_orders(spark):
    rnd = random.Random(2)
    words = ["alpha", "beta", "Gamma", "DELTA", "x#y", "a|b", "c"] + [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rnd.choices(words[: rnd.choice([3, 40, 207])], k=rnd.choice([5, 99, 100, 150]))), rnd.choice(["en", "de", "", None])) for i in range(150)]
    rows += [(200 + i, rows[i][1], "en") for i in range(40)] + [(300, None, "en"), (301, "", None), (None, rows[3][1], "de"), (5, rows[5][1], "en"), (6, rows[5][1], "en"), (303, "A" * 50_000 + " é", "fr")]
    labels = [(i, rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(0, 220, 2)] + [(4, 1, 1), (None, 1, 1), (8, None, None)]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, lang string, mask string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = audit.report(docs, marks)
    assert out.columns == ["part", "filter_order", "step", *audit.METRICS, "shapley"]
    assert sorted(map(tuple, out.collect())) == brute(rows, [x for x in labels if x[0] is not None])
    assert audit.report(docs.limit(0), marks).count() == 0
    only = audit.report(docs.where("lang = 'fr'"), marks.limit(0)).where("filter_order = 'CABDE'").orderBy("step").collect()
    assert [r["removed"] for r in only] == [1, 0, 0, 0, 0] and [r["redundant"] for r in only] == [0, 1, 0, 0, 0] and only[0]["shapley"] == 60
