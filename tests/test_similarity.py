import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinledger.functions import distances
from twinledger.functions.strings import similarity
from twinledger.operators import partial

SIDE = "pair_id string, id long, ord long, fields array<string>, raw string"


def plain(x, y):
    prev = list(range(len(y) + 1))
    for i, c in enumerate(x):
        cur = [i + 1]
        for j, d in enumerate(y):
            cur.append(min(prev[j] + (c != d), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("table", [distances.TABLE, 50])
def test_edit_distances(monkeypatch, table):
    monkeypatch.setattr(distances, "TABLE", table)
    rng = random.Random(1)
    make = lambda: ["".join(rng.choice("abcé😀") for _ in range(n)) for n in (1, 2, 3, 30, 63, 64, 65, 66, 130) for _ in range(3)]
    a, b = make(), make()
    at, to = (x.ravel() for x in np.meshgrid(range(len(a)), range(len(b))))
    assert distances.edit_distances(a, b, at, to).tolist() == [plain(a[i], b[j]) for i, j in zip(at, to, strict=True)]


def test_scores_are_the_column_expression(spark):
    """Short, long, missing and non-Latin values, in records of different widths."""
    rng = random.Random(2)
    values = ["aa", "ab", "é", "编码映射", "编码", "", None, "x" * 64, "x" * 65 + "y", "x" * 70, "a😀b"]
    rows = lambda: [("p", i, i, [rng.choice(values) for _ in range(rng.choice([1, 2, 3, 4]))], "") for i in range(99)] + [("p", 99, 99, [], ""), (None, 100, 100, ["aa"], "")]
    a, b = (spark.createDataFrame(rows(), SIDE) for _ in range(2))
    got = {(r.a_id, r.b_id): (r.score, r.first_col) for r in partial.candidates(a, b).collect()}
    both = a.select("pair_id", F.col("id").alias("a"), F.col("fields").alias("x")).join(b.select("pair_id", F.col("id").alias("b"), F.col("fields").alias("y")), "pair_id")
    usable = lambda v: F.length(v).between(1, 64)
    first = F.array_position(F.transform("x", lambda v: F.coalesce(F.array_contains(F.filter("y", usable), v), F.lit(False))), True) - 1
    want = {(r.a, r.b): (r.s, r.f) for r in both.select("a", "b", similarity(F.col("x"), F.col("y")).alias("s"), first.alias("f")).where("s >= 0.6 and f >= 0").collect()}
    assert got == want and len(got) > 100


def test_values_of_few_rows_are_few_tasks(spark):
    """3,000 values that one row of each side has are as little work as they are pairs."""
    d = spark.range(3000).selectExpr("'p' AS pair_id", "id", "id AS ord", "array(md5(string(id))) AS fields", "'' AS raw")
    found = partial.candidates(d, d)
    assert found.rdd.getNumPartitions() <= 8 and found.where("a_id = b_id and score = 1").count() == found.count() == 3000
    assert partial.assign(found).where("a_id = b_id").count() == 3000
