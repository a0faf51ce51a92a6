import random
import time

import numpy as np

from leafmill.operators import compare


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_least_script_is_least():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = (rng.integers(0, rng.integers(1, 8), rng.integers(0, 25)) for _ in range(2))
        kept = compare.least_script(a, b)
        assert all(a[i] == b[j] for i, j in kept)
        assert all(i < u and j < v for (i, j), (u, v) in zip(kept, kept[1:]))
        assert len(kept) == longest_common(a.tolist(), b.tolist())
    assert compare.least_script(np.arange(30), np.arange(40, 70), 59) is None


def test_rising_chain_is_longest():
    rng = random.Random(5)
    for _ in range(200):
        v = [rng.randrange(12) for _ in range(rng.randrange(14))]
        chain = [v[k] for k in compare.rising(v)]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] += max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert len(chain) == max(best, default=0) and all(x < y for x, y in zip(chain, chain[1:]))


def test_matched_keeps_equal_words_in_order():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a = rng.integers(0, 30, 60)
        b = np.delete(a, rng.integers(0, 60, 8))
        b[rng.integers(0, len(b), 5)] = 99
        kept = compare.matched(a, b)
        assert all(a[i] == b[j] for i, j in kept) and kept == sorted(kept)
        assert all(u > i and v > j for (i, j), (u, v) in zip(kept, kept[1:]))


def test_long_pairs_take_little_time():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 200, 60_000)
    b = np.delete(a, rng.integers(0, 60_000, 9))
    start = time.time()
    assert len(compare.matched(a, b)) == len(b)
    assert time.time() - start < 3


def test_changes_with_pages(spark):
    rows = [
        (1, "He pays 500 dollars on Monday\fand signs here", "He pays 750 dollars on Monday\fToday and signs"),
        (2, "one two three", ""),
        (3, None, "new\fwords here"),
        (4, "ﬁne “x” a–b co­op", 'fine "x" a-b coop'),
        (5, "a b c d", "a b c d"),
    ]
    df = spark.createDataFrame(rows, "pair int, before string, after string")
    changes = compare.word_diff(df)
    got = sorted((r.pair, r.kind, r.a_from, r.a_to, r.b_from, r.b_to, r.before, r.after, r.before_page, r.after_page) for r in changes.collect())
    assert got == [
        (1, "added", 6, 6, 6, 7, "", "Today", 1, 1),
        (1, "changed", 2, 3, 2, 3, "500", "750", 0, 0),
        (1, "removed", 8, 9, 9, 9, "here", "", 1, 1),
        (2, "removed", 0, 3, 0, 0, "one two three", "", 0, 0),
        (3, "added", 0, 0, 0, 3, "", "new words here", 0, 0),
    ]
    report = {r.pair: r.text for r in compare.changes_report(changes).collect()}
    assert report[1] == "Changed (page 1 → 1): 500 → 750\nAdded (page 2): Today\nRemoved (page 2): here"


def test_random_pairs_are_rebuilt(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        a = [rng.choice("abcdefghij") + rng.choice(["", "1", "2"]) for _ in range(rng.randrange(80))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = rng.choices("abcxyz", k=rng.randrange(3))
        rows.append((k, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "pair int, before string, after string")
    out = {r.pair: r.text for r in compare.rebuilt(df, compare.word_diff(df)).collect()}
    assert out == {k: b for k, _, b in rows}

def test_only_what_differs_is_shuffled(spark):
    # one row a word went through a shuffle before, for all words of both sides
    df = spark.createDataFrame([(1, "a b c\fd e", "a x c\fd e e"), (2, None, "é "), (3, "", None)], "pair int, before string, after string")
    changes = compare.word_diff(df)
    assert changes._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert changes._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    gaps = {(r.pair, r.a0, r.b0): (r.wa, r.wb) for r in compare.gaps(df).collect()}
    assert gaps == {(1, 1, 1): (["b"], ["x"]), (1, 4, 4): ([], ["e"]), (2, 0, 0): ([], ["é"])}
