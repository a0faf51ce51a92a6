"""The index of stretches against every text tried on every needle."""

import random

from leafmill.operators import contains, layout, tables


def test_index_equals_all_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    texts = [(k, "".join(rnd.choice("abc é") for _ in range(rnd.randrange(60)))) for k in range(150)] + [(900, None), (901, ""), (902, "abc é" * 4000)]
    needles = [("".join(rnd.choice("abc é") for _ in range(rnd.randrange(0, 7))), k) for k in range(120)] + [(None, 500), ("abc", 501), ("zzz", 502), ("ab😀", 503)]
    t, n = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(needles, "q string, no int")
    want = sorted((i, k) for i, text in texts for q, k in needles if text is not None and q is not None and q in text)
    for few in (0, 1000):
        monkeypatch.setattr(contains, "FEW", few)
        out = contains.containing(t, n, "t", "q")
        assert sorted((r.id, r.no) for r in out.collect()) == want
        if not few:
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_queries_without_a_nested_loop(spark):
    items = spark.createDataFrame([(k, f"Item {k % 7} of {k}", f"more words {k % 5}") for k in range(60)], "id int, name string, text string")
    typed = [(f"item {k % 7}",) for k in range(7)] + [(f"of {k}",) for k in range(100)] + [("  ",), ("words 3 item",)]
    queries = spark.createDataFrame(typed, "query string")
    many = tables.keyword_rank(items, queries, 4)
    assert "NestedLoop" not in many._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in many.collect():
        got.setdefault(r["query"], []).append((r["id"], r["score"]))
    for q in ("item 3", "of 5", "words 3 item", "  "):
        alone = [(r["id"], r["score"]) for r in tables.keyword_rank(items, q, 4).collect()]
        assert sorted(got[q]) == sorted(alone) and len(alone) == 4
    notes = spark.createDataFrame([("d", 0, k, f"Note  {k} OF\nall") for k in range(90)], "doc_id string, page int, annot_no int, text string")
    asked = spark.createDataFrame([(f"note {k} of",) for k in range(90)], "query string")
    hits = layout.annotation_hits(notes, asked)
    assert sorted((r.annot_no, r["query"]) for r in hits.collect()) == [(k, f"note {k} of") for k in range(90)]


def test_templates_of_several_values(spark):
    made = [("Hello", "Hola"), ("{0} of {1}", "{1}: {0}"), ("{0} of {1} files", "{1} Dateien: {0}"), ("{#} pages", "{#} Seiten"), ("{0}+{0}", "2*{0}"), ("a\\Eb {0}.", "<{0}{9}>"), ("({0})", "{0} {0}")]
    texts = ["Hello", "Hello world", "x of y", "x of y files", "3 pages", "three pages", "1,000\u00a0 pages", "1+2", "a\\Eb $1.", "({1})", "(\n)", "of "]
    out = tables.template_match(spark.createDataFrame([(x,) for x in texts] * 2 + [(None,)], "text string"), spark.createDataFrame(made, "template string, translation string"))
    got = {r.text: r.shown for r in out.collect()}
    assert got == {"Hello": "Hello", "Hello world": "Hello world", "x of y": "y: x", "x of y files": "y Dateien: x", "3 pages": "3 Seiten", "three pages": "three pages", "1,000\u00a0 pages": "1,000\u00a0 Seiten",
                   "1+2": "2*2", "a\\Eb $1.": "<$1{9}>", "({1})": "{1} {1}", "(\n)": "\n \n", "of ": "of ", None: None}
