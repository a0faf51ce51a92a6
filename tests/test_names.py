"""Unique names against the rule gone through in order."""

import random
import re

from leafmill.operators import pages


def in_order(names):
    used, out = set(), []
    for own in names:
        name, n = own, 2
        while name.lower() in used:
            name, n = re.sub(r"((?:\.[^.]*)?)$", lambda m: f" ({n}){m[1]}", own, count=1), n + 1
        used.add(name.lower())
        out.append(name)
    return out


def test_families_of_every_kind(spark):
    rnd = random.Random(9)
    names = []
    for f in range(25):  # many families in one table
        stem, end = f"f{f}", rnd.choice([".txt", "", ".b.c"])
        for _ in range(rnd.randrange(1, 30)):
            text = stem.upper() if rnd.random() < 0.2 else stem
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2, 3])):
                text += f" ({rnd.choice([1, 2, 2, 3, 4, 5, 7, '02'])})"
            names.append(text + end)
    rnd.shuffle(names)
    out = pages.unique_names(spark.createDataFrame(list(enumerate(names)), "tab_order int, name string"))
    assert [r.unique for r in sorted(out.collect(), key=lambda r: r.tab_order)] == in_order(names)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_no_name_at_all_and_none_repeated(spark):
    schema = "tab_order int, name string"
    assert pages.unique_names(spark.createDataFrame([], schema)).count() == 0
    assert [r.unique for r in pages.unique_names(spark.createDataFrame([(1, "a (2)"), (2, "b")], schema)).orderBy("tab_order").collect()] == ["a (2)", "b"]
