import hashlib
import math
import random

from leafmill.llm import mixing as mx

SCHEMA = "doc_id long, source string, size long, weight double"


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def brute(rows):
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    goal, taken = targets(sizes), {}
    for s in sizes:
        own = []
        for k, source, n, w in rows:
            if source == s:
                u = (int(hashlib.md5(str("" if k is None else k).encode()).hexdigest()[:13], 16) + 0.5) / 16**13
                own.append((-math.log(u) / w if w and w > 0 else math.inf, k is None, k or 0, n or 0))
        epochs = goal[s] // sizes[s] if sizes[s] else 0
        rest, total = goal[s] - epochs * sizes[s], 0
        for key, _, k, n in sorted(own):
            taken[k] = n * (epochs + (total < rest and total + n / 2 <= rest))
            total += n
    return goal, taken


def test_equals_sorting_each_source(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice(["hot", "hot", "hot", "a", "é", "z", None]), rng.choice([0, 1, 5, 100, 2000]), rng.choice([0.5, 1.0, 2.0, None])) for k in range(3000)]
    rows += [(9000 + k, f"small{k}", 10, 1.0) for k in range(5)]
    goal, taken = brute(rows)
    out = mx.mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert math.isclose(r.target, goal[r.source], rel_tol=1e-9), r
        assert r.taken == taken[r.doc_id], r
        assert r.taken <= 3 * r.size
    for s, t in goal.items():
        assert abs(sum(r.taken for r in out if r.source == s) - t) <= max(r.size for r in out if r.source == s)


def test_odd_rows(spark):
    rows = [(1, "a", None, 1.0), (1, "a", None, 1.0), (None, None, 5, None), (2, "b", 0, -1.0), (2, "a", 3, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("weight", "Weight")
    out = mx.mix_sources(df).collect()
    assert len(out) == 5 and all(0 <= r.taken <= 3 * r.size for r in out)
    assert mx.mix_sources(df.limit(0)).collect() == []


def test_rows_as_often_as_taken(spark):
    docs = spark.createDataFrame([(k, "word " * 10, ["a", "b", "c", "c"][k % 4], "x") for k in range(400)] + [(None, None, None, "y")], "doc_id long, text string, source string, weight string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1)], "doc_id long, quality int")
    out = mx.mixed(docs, labels)
    assert out.columns == docs.columns
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    goal = targets({"a": 1000, "b": 1000, "c": 2000, None: 0})
    assert all(abs(10 * n[s] - goal[s]) <= 10 for s in "abc")


def test_equal_keys_and_very_long_texts(spark):
    # no weight makes all keys infinite: ties go to the smaller id, and exactly the first ones are taken a second time
    rows = [(k, ["a", "b", "c"][k % 3], 10, 0.0) for k in range(300)]
    out = mx.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in "abc":
        copies = [r.copies for r in sorted((r for r in out if r.source == s), key=lambda r: r.doc_id)]
        assert copies == sorted(copies, reverse=True) and copies[0] - copies[-1] <= 1
    docs = spark.createDataFrame([(1, "w " * 2_000_000, "a"), (2, "v " * 2_000_000, "a"), (3, " \t" * 1_000_000, "b")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(r.doc_id for r in mx.mixed(docs, labels).collect()) == [1, 2, 3]  # a text without words takes none of the budget
