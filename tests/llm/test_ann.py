import math

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(x, q, k=10):
    d = np.sqrt(((x[q].astype(float) - x.astype(float)) ** 2).sum(1))
    d[q] = np.inf
    return sorted(range(len(x)), key=lambda i: (d[i], i))[:k]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (700, 24)) for c in range(6)]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], SCHEMA)
    rows = ann.nearest(df, F.col("id") % 50 == 0, 10).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found) == list(range(0, len(x), 50))
    hits = 0
    for q, own in found.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 11))
        for _, i, score in own:
            assert math.isclose(score, float(np.sqrt(((x[q].astype(float) - x[i].astype(float)) ** 2).sum())), rel_tol=1e-12)
        assert [s for _, _, s in own] == sorted(s for _, _, s in own)
        hits += len({i for _, i, _ in own} & set(brute(x, q)))
    assert hits / (10 * len(found)) >= 0.95


def test_vectors_that_take_no_part_ties_and_repeats(spark):
    bad = [(100, None), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (600, [1.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0]), (9, [1.0, 0.5])]
    df = spark.createDataFrame(bad + good, SCHEMA).withColumn("score", F.lit("x")).withColumn("ID", F.lit(1))
    out = ann.nearest(df, F.col("id") % 100 == 0, 10).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"])] == [(0, 1, 3, 0.0), (0, 2, 7, 0.0), (0, 3, 9, 0.5)]


def test_one_vector_may_be_most_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(400)] + [(1000 + k, [float(k), 1.0, 0.0]) for k in range(60)]
    out = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") == 300, 5).collect()
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"])] == [0, 1, 2, 3, 4]


def test_empty_table(spark):
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("id") == 0).collect() == []


def ranked_ids(spark, rows, q, k=10, **more):
    out = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") == q, k, **more).collect()
    return [r.vec_id for r in sorted(out, key=lambda r: r["rank"])]


def test_a_tight_cluster_larger_than_a_shortlist(spark, monkeypatch):
    monkeypatch.setattr(ann, "CODEWORDS", 4)  # too few to tell the cluster's vectors apart
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 10, (1500, 8)), 5 + rng.normal(0, 1e-4, (900, 8))]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    for q in (2399, 1700):
        assert ranked_ids(spark, rows, q, probes=10_000) == brute(x, q)


def test_copies_and_repeated_rows_do_not_push_out_nearer_vectors(spark):
    # 1,500 copies, rows that repeat one id, and nearer vectors of larger ids, all under one code
    near = [(90_000 + k, [1.0, 1.0 + 1e-5 * (k + 1)]) for k in range(5)]
    far = [(10_000 + 10 * k, [float(k % 31) * 3 - 40, float(k % 37) * 3 - 50]) for k in range(1200)]
    rows = near + far + [(k, [1.0, 1.01]) for k in range(1500)] + [(5000, [1.0, 1.001])] * 700 + [(5000, [9.0, 9.0])] + [(99_999, [1.0, 1.0])]
    assert ranked_ids(spark, rows, 99_999, 8, probes=10_000) == [90_000, 90_001, 90_002, 90_003, 90_004, 5000, 0, 1]


def test_query_ids_with_several_vectors(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 9.0]), (100, [0.0, 9.0]), (1, [0.0, 8.8]), (2, [1.0, 0.5]), (2, [50.0, 50.0]), (3, [30.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0, k=3).collect()
    assert [(r.rank, r.vec_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 0.2), (2, 2, 0.5), (3, 3, 29.0)]
