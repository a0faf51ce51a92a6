from leafmill.operators import compare, pages
from leafmill.plans import recipe
from leafmill.streaming import stream

FOLDER = "/root/testdata/sf0.001"


def test_word_diff(spark):
    rows = [(1, "He pays 500 dollars on Monday", "He pays 750 dollars on Monday Signed today."), (2, "ﬁne “x” a–b", 'fine "x" a-b'), (3, "", "new"), (4, "same", "same")]
    df = spark.createDataFrame(rows, "pair long, before string, after string")
    got = sorted((r.pair, r.kind, r.before, r.after) for r in compare.word_diff(df).collect())
    assert got == [(1, "added", "", "Signed today."), (1, "changed", "500", "750"), (3, "added", "", "new")]
    s = {r.pair: r for r in compare.comparison_summary(df).collect()}
    assert (s[1].words_before, s[1].words_after, s[1].unchanged) == (6, 8, 5) and s[4].unchanged == 1


def test_unique_names_go_in_order(spark):
    names = ["a.pdf", "A.pdf", "a (2).pdf", "a.pdf", "b", "b", "c (2).x", "c.x", "c.x", "c (2).x", "d.e", "D.E", "d.e"]
    want = ["a.pdf", "A (2).pdf", "a (2) (2).pdf", "a (3).pdf", "b", "b (2)", "c (2).x", "c.x", "c (3).x", "c (2) (2).x", "d.e", "D (2).E", "d (3).e"]
    out = pages.unique_names(spark.createDataFrame(list(enumerate(names)), "tab_order int, name string")).collect()
    assert [r.unique for r in sorted(out, key=lambda r: r.tab_order)] == want


def test_pages_merge_by_a_text_order(spark):
    rows = [("b/2", 0), ("b/2", 1), ("a/9", 0), ("", 0), ("é", 0), ("é", 1)]
    out = pages.merge_docs(spark.createDataFrame(rows, "doc string, page int")).collect()
    assert sorted((r.merged, r.doc, r.page) for r in out) == [(0, "", 0), (1, "a/9", 0), (2, "b/2", 0), (3, "b/2", 1), (4, "é", 0), (5, "é", 1)]


def test_a_failing_row_drops_out_and_others_go_on(spark):
    rows = [(0, "a.txt", "text", "mail a@b.example"), (1, "b.txt", "text", ""), (2, "c.png", "image", "x"), (3, "a.txt", "text", "fine")]
    r = recipe.run_recipe(spark.createDataFrame(rows, "tab_order int, name string, kind string, text string"), recipe.PRESETS["share safely"])
    assert sorted((x.unique, x.text) for x in r.outputs.collect()) == [("a (2).txt", "fine"), ("a.txt", "mail [removed]")]
    assert [(x.name, x.step) for x in r.failures.collect()] == [("b.txt", "check")]
    assert [x.name for x in r.untouched.collect()] == ["c.png"]


def test_a_stream_gives_what_a_table_gives(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    source = stream.read_stream(spark, str(tmp_path / "in"), docs.schema)
    stream.run_available(stream.stream_redacted(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(stream.stream_redacted(docs)).count() == 0 and got.count() == docs.count()
