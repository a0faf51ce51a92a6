import random

import numpy as np

from leafmill.llm import neardup as nd
from leafmill.llm.common import shingles, word_hashes

SCHEMA = "doc_id long, text string"


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def sets(text):
    w = words(text)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows, percent):
    """The component of each row, by comparing all pairs."""
    s = [sets(t) for _, t in rows]
    label = {k: k for k, _ in rows if k is not None}
    edges = [(a, b) for i, (a, _) in enumerate(rows) for j, (b, _) in enumerate(rows[:i]) if a is not None and b is not None and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return [label.get(k) for k, _ in rows]


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    text = lambda n: rng.choices(vocabulary, k=n)
    rows = []
    for _ in range(12):
        base = text(120)
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    rows += [rows[0], rows[0].upper(), " ".join(text(4)), "one two", "ONE\ttwo ", "", None, "  ", " ".join(text(3000))]
    return list(enumerate(rows, 5))


def check(spark, rows, percent):
    out = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), percent).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for (k, t), component in zip(rows, brute(rows, percent)):
        assert got[k].component_id == component, (k, got[k], component)
        assert got[k].n_shingles == len(sets(t))
        assert got[k].kept == (k == component)


def test_equals_comparing_all_pairs(spark):
    check(spark, corpus(), 85)


def test_at_the_default_threshold(spark):
    check(spark, corpus()[:60], 80)


def test_rows_that_repeat_or_have_no_id(spark):
    rng = random.Random(2)
    t = " ".join(rng.choices("abcdefghijkl", k=60))
    rows = [(3, t), (3, t), (None, t), (9, t), (9, "quite another text of seven words"), (12, "quite another text of seven words")]
    out = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, True), (3, 3, True), (3, 3, True), (9, 3, False), (9, 3, False), (12, 3, False)]


def test_one_of_each_group_stays_with_all_columns(spark):
    t = "a b c d e f g h i j"
    rows = [(1, t, "x", 0), (1, t, "x", 0), (2, t, "y", 1), (3, "", "z", 2), (3, "", "z", 2), (None, t, "w", 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", _other string, kept int")
    out = nd.without_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r._other) for r in out.collect()) == [(0, "w"), (1, "x"), (3, "z"), (3, "z")]


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_coordinate_fills_and_estimates_similarity():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 100, 5000):
        s = nd.sketch(rng.integers(0, 1 << 63, n, np.uint64))
        assert len(s) == nd.COORDINATES and (s >> np.uint64(47) < 2 * nd.COORDINATES).all()
    errors = []
    for _ in range(30):
        x = rng.integers(0, 1 << 63, 1000, np.uint64)
        errors.append((nd.sketch(x[:800]) == nd.sketch(x[200:])).mean() - 600 / 1000)
    assert abs(np.mean(errors)) < 0.02


def test_shingles_of_pieces_equal_those_of_the_whole(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=5000))
    whole = shingles(word_hashes(text))
    monkeypatch.setattr("leafmill.llm.common.pieces.__defaults__", (100,))
    assert (shingles(word_hashes(text)) == whole).all()


def test_an_id_with_different_texts_is_compared_in_the_second_round(spark, monkeypatch):
    monkeypatch.setattr(nd, "bands", lambda coordinates: np.arange(40))  # all in the same buckets
    text = lambda n, c: " ".join(f"{c}{k}" for k in range(n))
    for one, other in ((9, 12), (-1, 12)):
        rows = [(-5, text(44, "h")), (one, text(40, "a")), (one, text(45, "b")), (other, text(40, "a") + " more"), (20, text(42, "c"))]
        out = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), 85).collect()}
        assert out == {-5: -5, one: one, other: one, 20: 20}


def test_different_texts_of_the_id_that_stays_are_kept(spark):
    rows = [(5, "a b c d e f g", "x"), (5, "A b c  d e f g", "x"), (5, "quite another text of seven words", "y"), (5, " ", "z"), (8, "a b c d e f g", "w"), (8, "", "v")]
    out = nd.without_near_duplicates(spark.createDataFrame(rows, SCHEMA + ", _set_key string"))
    assert sorted((r.doc_id, r._set_key) for r in out.collect()) == [(5, "x"), (5, "y"), (5, "z"), (8, "v")]


def test_one_bucket_of_many_members_that_are_not_linked(spark, monkeypatch):
    monkeypatch.setattr(nd, "bands", lambda coordinates: np.arange(40))  # all in the same buckets
    monkeypatch.setattr(nd, "RARE", 2)  # so that it takes several rounds
    rng = random.Random(6)
    base, rows = [f"w{k}" for k in range(90)], []
    other = [w if k % 25 else f"o{k}" for k, w in enumerate(base)]
    for k in range(90):
        own = list(rng.choice((base, other)))
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice(([], ["x"], [f"new{k}"], [own[at], "y"]))
        rows.append((1000 - k, " ".join(own)))
    check(spark, rows, 85)
    check(spark, rows, 80)
    # no original in the table, and every version far from the others or close to a few
    far = [(k, " ".join(w if (i + k) % 9 or rng.random() < 0.5 else f"z{k // 2}" for i, w in enumerate(base))) for k in range(60)]
    check(spark, far, 70)


def size_bits(df):
    """How many bits the size has that Spark estimates for ``df``."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimated_sizes_do_not_grow_with_the_rounds(spark):
    """Joins multiply them: carried through rounds, they once filled the driver's memory."""
    names = random.Random(5).sample(range(10_000), 24)
    labels = nd.components(spark.createDataFrame(list(zip(names, names[1:])), "a long, b long"))
    assert size_bits(labels) < 1000
    assert {tuple(r) for r in labels.collect()} == {(v, min(names)) for v in names}


def test_estimated_sizes_do_not_grow_with_the_rounds_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(nd, "RARE", 1)
    monkeypatch.setattr(nd, "HUBS", 1)
    rows, opened, own = corpus(), [], nd.mixed_buckets
    monkeypatch.setattr(nd, "mixed_buckets", lambda members, labels, most: (opened.append(max(size_bits(members), size_bits(labels))), own(members, labels, most))[1])
    check(spark, rows, 70)
    assert len(opened) > 1 and max(opened) < 20_000, opened
