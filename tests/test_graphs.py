"""Reachability and chains against plain searches, and their rounds."""

import random

from leafmill.operators import tables


def plain_unreached(nodes, edges, roots):
    seen = set(roots)
    todo = list(roots)
    while todo:
        f, n = todo.pop()
        for g, a, b in edges:
            if (g, a) == (f, n) and (g, b) not in seen:
                seen.add((g, b))
                todo.append((g, b))
    return sorted(set(nodes) - seen)


def counted(monkeypatch):
    rounds, own = [], tables.cut
    monkeypatch.setattr(tables, "cut", lambda df: rounds.append(1) or own(df))
    return rounds


def test_unreachable_equals_a_plain_search(spark):
    rnd = random.Random(7)
    nodes, edges, roots = [], [], []
    for f in range(12):  # graphs of every kind in one table
        n = rnd.randrange(2, 25)
        nodes += [(f, k) for k in range(n)]
        edges += [(f, rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(2 * n))]
        edges += [(f, k, k + 1) for k in range(n // 2)] + edges[-2:]
        roots += [(f, rnd.randrange(n)) for _ in range(rnd.randrange(3))]
    nodes += [(90, k) for k in range(5)] + [(91, 1)]
    edges += [(90, k, (k + 1) % 5) for k in range(5)]  # a ring that nothing leads to
    key = "file_id int, node int"
    got = tables.unreachable(spark.createDataFrame(nodes, key), spark.createDataFrame(edges, "file_id int, src int, dst int"), spark.createDataFrame(roots, key))
    assert sorted(tuple(r) for r in got.collect()) == plain_unreached(nodes, edges, roots)


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    rounds = counted(monkeypatch)
    nodes = [(1, k) for k in range(2003)]
    edges = [(1, k, k + 1) for k in range(2000)]
    got = tables.unreachable(spark.createDataFrame(nodes, "file_id int, node int"), spark.createDataFrame(edges, "file_id int, src int, dst int"), spark.createDataFrame([(1, 0)], "file_id int, node int"))
    assert sorted(r.node for r in got.collect()) == [2001, 2002]
    assert len(rounds) < 40


def test_a_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch):
    rounds = counted(monkeypatch)
    certs = [(1, f"c{k}", f"c{k + 1}") for k in range(1000)] + [(1, "c1000", "c1000"), (2, "a", "b"), (2, "b", "c"), (2, "c", "a"), (2, "x", "a"), (3, "y", "nobody")]
    got = tables.issuer_chain(spark.createDataFrame(certs, "file_id int, subject string, issuer string"))
    assert len(rounds) <= 12
    by = {}
    for r in got.filter("leaf in ('c0', 'c990', 'a', 'x', 'y')").collect():
        by.setdefault((r.file_id, r.leaf), []).append((r.depth, r.subject))
    assert sorted(by[1, "c0"]) == [(k, f"c{k}") for k in range(1, 1001)] and len(by[1, "c990"]) == 10
    assert sorted(by[2, "a"]) == [(1, "b"), (2, "c")] and sorted(by[2, "x"]) == [(1, "a"), (2, "b"), (3, "c")]
    assert (3, "y") not in by
