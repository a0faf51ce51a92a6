"""Items of a page meet once: one exchange, no join, and the same rows as a plain version gives."""

import random

from pyspark.sql import functions as F

from leafmill.operators import columns, layout, tables
from leafmill.plans import recipe
from leafmill.queries import media

ITEM = "doc_id int, page int, item_no int, text string, x double, y double, width double, size double, bold boolean"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return sum(line.lstrip(" :+-").startswith("Exchange") for line in plan(df).splitlines())


def plain_index(rows):
    """(item_no, start, chars) of a page's items in order."""
    at, spaced, out = 0, True, []
    for k, (no, text, x, y, width, size) in enumerate(rows):
        chars, after = [], rows[k + 1] if k + 1 < len(rows) else None
        for i, c in enumerate(text or ""):
            if not (c.isspace() and spaced):
                chars.append(i)
            spaced = c.isspace()
        if after and (abs(after[3] - y) > size * 0.5 or after[2] - (x + width) > size * 0.15):
            chars += [] if spaced else [len(text or "")]
            spaced = True
        out.append((no, at, chars))
        at += len(chars)
    return out


def test_page_index_is_one_exchange_and_takes_null_texts(spark):
    rng = random.Random(5)
    rows = {p: [(k, rng.choice(["", None, " ", "a", "b ", " c", "d  e", "\tf"]), 10.0 * k, 50.0 + 20 * rng.randint(0, 1), float(rng.choice([8, 10])), 10.0) for k in range(40)] for p in range(6)}
    df = spark.createDataFrame([(1, p, *r, False) for p, page in rows.items() for r in page], ITEM)
    indexed = columns.page_index(df, ["item_no"])
    assert exchanges(indexed) == 1 and "Join" not in plan(indexed)
    got = {p: sorted((r.item_no, r.start, list(r.chars)) for r in indexed.filter(f"page = {p}").collect()) for p in rows}
    assert got == {p: plain_index(page) for p, page in rows.items()}


def test_page_lines_are_the_lines_of_line_text(spark):
    rng = random.Random(7)
    rows = [(1, p, k, rng.choice(["a", "b ", " c", "d e ", "", " "]), float(rng.randint(0, 300)), float(rng.choice([50, 52, 70, 90])), float(rng.randint(0, 20)), float(rng.choice([8, 10, 10.1, 12])), rng.choice([True, False, None])) for p in range(5) for k in range(30)]
    df = spark.createDataFrame(rows, ITEM)
    own = layout.page_lines(df)
    assert exchanges(own) == 1 and "Window" not in plan(own)
    want = layout.line_text(layout.group_lines(df))
    assert own.columns == want.columns
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect()))


def test_markdown_is_one_exchange(spark):
    rows = [(1, 0, 0, "Head_1", 1, False), (1, 0, 1, "• a", None, True), (1, 0, 2, "2) b", None, True), (1, 0, 3, "x\ty", None, False), (1, 0, 4, "1\t2\t3", None, False), (1, 1, 0, "4\t5", None, False), (1, 1, 1, " ", None, False), (1, 1, 2, "end", None, None)]
    df = spark.createDataFrame(rows, "doc_id int, page int, paragraph int, text string, level int, list boolean")
    made = layout.markdown_document(df, page_marks=True)
    assert exchanges(made) == 1 and "Window" not in plan(made)
    assert [r.text for r in made.collect()] == ["<!-- Page 1 -->\n\n# Head\\_1\n\n- a\n2. b\n\n| x | y |  |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n\n<!-- Page 2 -->\n\n4 5\n\nend"]
    assert [r.text for r in layout.markdown_document(df).collect()] == ["# Head\\_1\n\n- a\n2. b\n\n| x | y |  |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| 4 | 5 |  |\n\nend"]


def test_a_recipe_makes_each_text_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def shout(t):
        made.add(1)
        return t.upper()

    steps = [recipe.Step("shout", ("text",), one=lambda t: (shout(t), F.lit(None).cast("string"))), recipe.clean_step(), recipe.seal_step()]
    files = spark.createDataFrame([(k, "a.txt", "text", f"t{k}") for k in range(12)], "tab_order int, name string, kind string, text string")
    out = recipe.run_recipe(files, steps).outputs.collect()
    assert made.value == 12
    assert sorted(r.unique for r in out) == sorted(["a.txt", *(f"a ({k}).txt" for k in range(2, 13))])
    assert all(r.text.split("\n")[0] == f"T{r.tab_order}" and "sha256:" in r.text for r in out)


def test_a_step_of_the_search_shuffles_no_edges(spark, monkeypatch):
    plans, own = [], tables.cut
    monkeypatch.setattr(tables, "cut", lambda df: (plans.append(plan(df)), own(df))[1])
    for n, factors in ((60, (2, 3)), (40, (2,))):  # with two edges from each node, and as chains
        nodes = spark.createDataFrame([(1, k) for k in range(1, n)], "file_id int, node int")
        edges = spark.createDataFrame([(1, k, k * f) for k in range(1, n) for f in factors], "file_id int, src int, dst int")
        seen, new = set(), {1}
        while new:
            seen, new = seen | new, {k * f for k in new for f in factors if k < n} - seen - new
        assert sorted(r.node for r in tables.unreachable(nodes, edges, nodes.filter("node = 1")).collect()) == sorted(set(range(1, n)) - seen)
    rounds = [p for p in plans if "LeftAnti" in p and "Scan ExistingRDD" in p and "BroadcastHashJoin" in p]
    assert len(rounds) > 4 and not any("SortMergeJoin" in p for p in rounds)


def test_pictures_are_made_by_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert media._pictures(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
