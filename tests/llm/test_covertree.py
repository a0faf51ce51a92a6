import math

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import covertree as ct


def plain(rows, is_anchor, positives=5, negatives=5):
    rows = sorted({(i, y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows})
    out = []
    for a, y, v in rows:
        if not is_anchor(a):
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w)), i, z == y) for i, z, w in rows if i != a))
        for s, i, _ in [x for x in scored if x[2]][:positives]:
            far = [(n, k) for n, k, same in scored if not same and 80 * -s <= 100 * -n <= 100 * -s][:negatives]
            out += [(a, i, r + 1, k, -s, -n) for r, (n, k) in enumerate(far)]
    return sorted(out)


def test_search_equals_all_products():
    rng = np.random.default_rng(2)
    for t in range(40):
        n, d = int(rng.integers(1, 500)), int(rng.integers(1, 9))
        x = [rng.integers(-5, 6, (n, d)), np.floor(256 * rng.normal(size=(n, d))), rng.integers(0, 4, (n, 1)) * 100 + rng.integers(0, 3, (n, d)), np.zeros((n, d)), 10**5 + rng.integers(0, 2, (n, d))][t % 5].astype(np.int64)
        label, ids = rng.integers(0, 3, n), rng.permutation(n).astype(np.int64)
        tree = ct.plant(ids, label, x, max(1.0, float(np.sqrt((x * x).sum(1).max()))))
        assert sorted(tree.ids.tolist()) == sorted(ids.tolist())
        for i in rng.integers(0, n, 6):
            s = x @ x[i]
            a, b = np.quantile(s, [0.3, 0.9]).astype(int)
            windows = np.array([[-(1 << 62), 1 << 62], [a, b], [a // 2, a], [b, b]], np.int64)
            for same in (True, False):
                for (score, found), (lo, hi) in zip(ct.search(tree, int(ids[i]), int(label[i]), x[i], windows, 5, same), windows):
                    m = ((label == label[i]) == same) & (ids != ids[i]) & (s >= lo) & (s <= hi)
                    first = np.lexsort((ids[m], -s[m]))[:5]
                    assert score.tolist() == s[m][first].tolist() and found.tolist() == ids[m][first].tolist()


def test_covering_radii_hold():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(600, 5))).astype(np.int64)
    norm = float(np.sqrt((x * x).sum(1).max()))
    tree = ct.plant(np.arange(600), np.zeros(600, int), x, norm)
    unit = ct.augmented(tree.x, norm)

    def below(node):
        rows = list(range(*tree.rows[node]))
        for child in range(*tree.children[node]):
            assert tree.radius[child] <= tree.radius[node] / ct.SHRINK + 1e-3
            rows += below(child)
        assert ct.angles(unit[rows] @ unit[tree.centre[node]]).max() <= tree.radius[node] + ct.SLACK
        return rows

    assert sorted(below(0)) == list(range(600))


def test_operator_equals_plain_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 4)) / 3
    rows = [(i, int(rng.integers(0, 3)), [float(c) for c in np.float32(base[rng.integers(6)] + rng.normal(size=4) * 0.05)]) for i in range(900)]
    rows += [(1000 + i, i % 2, [0.5, 0.25, 0.0, -0.5]) for i in range(300)]  # copies
    rows += rows[:20]  # repeated rows
    rows += [(40, 2, [0.1, 0.2, 0.3, 0.4])]  # an id with two vectors
    odd = [(None, 1, [1.0] * 4), (7000, None, [1.0] * 4), (7100, 1, None), (7200, 1, [1.0, None, 1.0, 1.0]), (7300, 1, [1.0, math.nan, 1.0, 1.0]), (7400, 1, [math.inf] * 4), (7500, 1, []), (7600, 1, [1.0] * 5), (7700, 1, [1e300] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").withColumn("LOW", F.lit(1)).withColumn("q", F.lit("x"))
    got = ct.hard_negatives(df, F.col("vec_id") % 20 == 0, block=64)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, lambda i: i % 20 == 0)
    assert {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"} == set(got.columns)


def test_small_and_empty_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(0, 1, [1.0, 2.0])], [(0, 1, [0.0]), (1, 1, [0.0]), (2, 2, [0.0])], [(100, 1, [1.0]), (3, 1, [1.0]), (5, 2, [1.0]), (4, 2, [0.9]), (6, 3, [0.7])]):
        got = ct.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0)
        assert sorted(tuple(r) for r in got.collect()) == plain(rows, lambda i: i % 100 == 0)
