import random

import pytest

from leafmill.llm import decontaminate as dc

ITEM, DOC = "item_id long, text string", "doc_id long, text string"


def sets(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def corpus():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    text = lambda n: rng.choices(vocabulary, k=n)
    items = [text(rng.randint(5, 60)) for _ in range(30)]
    docs = []
    for k in range(80):
        body, item = text(rng.choice([5, 50, 400, 4000])), list(items[k % 30])
        for _ in range(rng.randint(0, 2)):
            item[rng.randrange(len(item))] = "changed"
        at = rng.randrange(len(body))
        docs.append(body[:at] + item + body[at:] if k % 3 else body)
    return [(k, " ".join(d)) for k, d in enumerate(docs)], [(k, " ".join(i)) for k, i in enumerate(items)]


def test_equals_exact_containment(spark):
    docs, items = corpus()
    docs[3] = (3, docs[3][1].upper().replace(" ", "\n\t"))
    got = {(r.doc_id, r.item_id): (r.item_shingles, r.shared) for r in dc.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    want = {}
    for d, t in docs:
        own = sets(t)
        for i, u in items:
            q = sets(u)
            if len(q & own) >= 0.8 * len(q) - 1e-9:
                want[d, i] = (len(q), len(q & own))
    assert got == want and len(want) > 20


def test_short_items_are_one_shingle(spark):
    docs = [(1, "x the cat sat y"), (2, "the cat"), (3, "cat the")]
    got = dc.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame([(7, "The CAT"), (8, "cat the x q")], ITEM)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 7), (2, 7)]


def test_odd_rows_and_clashing_columns(spark):
    item = "one two three four five six"
    docs = [(1, item, "a"), (1, item, "a"), (1, "clean", "b"), (None, item, "c"), (None, None, "d"), (2, "", "e"), (2, " \n", "f")]
    df = spark.createDataFrame(docs, DOC + ", _bad_id string").withColumnRenamed("_bad_id", "_BAD_ID")
    items = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, "")], ITEM)
    out = dc.without_contaminated(df, items)
    assert out.columns == df.columns
    assert sorted(r._BAD_ID for r in out.collect()) == ["b", "d", "e", "f"]


@pytest.mark.parametrize("docs, items", [([], [(1, "a b c d e")]), ([(1, "a b c d e")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    assert dc.contaminated(d, i).collect() == []
    assert dc.without_contaminated(d, i).count() == len(docs)


def test_ids_that_are_null_or_have_several_texts(spark):
    one, two, none = ("a b c d e f g h", "i j k l m n o p", "q r s t u v w x")
    items = [(1, one), (1, two), (1, one), (None, none), (None, "only three words"), (2, one)]
    docs = [(10, f"x {one} y"), (11, f"x {two} y"), (12, f"{none} z"), (13, "are only three words here"), (None, two), (14, "clean"), (15, f"{one} 1 {two}")]
    got = dc.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    want = [(10, 1), (10, 2), (11, 1), (12, None), (13, None), (None, 1), (15, 1), (15, 1), (15, 2)]
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted(want, key=str)
    kept = dc.without_contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    assert [r.doc_id for r in kept.collect()] == [14]


def test_query_equals_its_sql_with_odd_items(spark, tmp_path):
    from leafmill.llm.queries import QUERIES, SQL
    from tests.compare import same_rows

    docs, items = corpus()
    items += [(None, "one two three four five six"), (None, "seven eight"), (items[0][0], "another text of the same item it is"), (900, ""), (901, None)]
    docs += [(5000, "zero one two three four five six"), (5001, "and seven eight too"), (5002, "so another text of the same item it is then"), (None, "seven eight")]
    for name, rows, schema in (("documents", docs, DOC), ("benchmark", items, ITEM)):
        spark.createDataFrame(rows, schema).toPandas().astype({schema.split()[0]: "Int64"}).to_parquet(f"{tmp_path}/{name}.parquet")
    same_rows(spark, QUERIES["op6_decontamination"], SQL["op6_decontamination"], str(tmp_path))


def test_very_long_text(spark):
    words = " ".join(f"w{i}" for i in range(300_000))
    got = dc.contaminated(spark.createDataFrame([(1, words + " a b c d e f")], DOC), spark.createDataFrame([(1, "a b c d e f"), (2, "w5 w6 w7 w8 w9"), (3, "no such words in the text")], ITEM)).collect()
    assert sorted(r.item_id for r in got) == [1, 2]
