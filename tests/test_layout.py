from leafmill.functions.text import expand_tabs, sentence_chunks
from leafmill.operators import columns, layout
from pyspark.sql import functions as F

ITEM = "doc_id int, page int, item_no int, text string, x double, y double, width double, size double, bold boolean"


def items(spark, rows):
    return spark.createDataFrame([(1, 0, k, t, float(x), float(y), float(w), float(s), b) for k, (t, x, y, w, s, b) in enumerate(rows)], ITEM)


def test_a_line_has_the_size_and_baseline_of_most_of_its_text(spark):
    df = items(spark, [("2", 60, 95, 4, 6, False), ("E = mc", 20, 100, 40, 12, False), ("far", 200, 100, 20, 12, False)])
    (r,) = layout.line_text(layout.group_lines(df)).collect()
    assert (r.text, r.y, r.size, r.right) == ("E = mc2\tfar", 100.0, 12.0, 220.0)


def test_an_indent_does_not_break_a_list_item(spark):
    rows = [(1, 0, 1, "• one item that", 20.0, 200.0, 100.0, 10.0, False), (1, 0, 2, "goes on here", 40.0, 200.0, 112.0, 10.0, False), (1, 0, 3, "plain text", 20.0, 200.0, 140.0, 10.0, False), (1, 0, 4, "indented", 40.0, 200.0, 152.0, 10.0, False)]
    lines = spark.createDataFrame(rows, "doc_id int, page int, line int, text string, x double, right double, y double, size double, bold boolean")
    got = [r.paragraph for r in sorted(layout.group_paragraphs(lines).collect(), key=lambda r: r.line)]
    assert got == [1, 1, 2, 3]


def test_centred_lines_stand_apart(spark):
    rows = [(1, 0, 1, "A centred title", 250.0, 350.0, 100.0, 10.0, False), (1, 0, 2, "then the text from the left edge on", 50.0, 550.0, 112.0, 10.0, False)]
    lines = spark.createDataFrame(rows, "doc_id int, page int, line int, text string, x double, right double, y double, size double, bold boolean")
    widths = spark.createDataFrame([(1, 0, 600.0)], "doc_id int, page int, page_width double")
    got = sorted((r.line, r.paragraph, r.centered) for r in layout.group_paragraphs(lines, widths).collect())
    assert got == [(1, 1, True), (2, 2, False)]
    assert [r.paragraph for r in layout.group_paragraphs(lines).collect()] == [1, 1]


def test_tables_and_short_pages_are_not_split(spark):
    rows = [(f"c{k % 2}", 50 + k % 2 * 300, 100 + k // 2 * 14, 30, 10, False) for k in range(40)]
    widths = spark.createDataFrame([(1, 0, 600.0)], "doc_id int, page int, page_width double")
    assert {r.column for r in columns.split_columns(items(spark, rows), widths).collect()} == {0}
    long = [(f"c{k % 2}", 50 + k % 2 * 280, 100 + k // 2 * 14, 220, 10, False) for k in range(40)]
    assert {r.column for r in columns.split_columns(items(spark, long), widths).collect()} == {0, 1}
    assert {r.column for r in columns.split_columns(items(spark, long[:18]), widths).collect()} == {0}


def test_boxes_over_items_and_white_space(spark):
    df = items(spark, [("  Jane\t ", 10, 50, 80, 10, False), ("Doe", 95, 50, 30, 10, False), ("next", 10, 80, 40, 10, False), ("", 60, 80, 0, 10, False)])
    indexed = columns.page_index(df, ["item_no"])
    assert columns.indexed_text(indexed).collect()[0].text == "Jane Doe next "
    spans = spark.createDataFrame([(1, 0, 2, 7)], "doc_id int, page int, start int, stop int")
    sizes = spark.createDataFrame([(1, 0, 100.0, 100.0)], "doc_id int, page int, page_width double, page_height double")
    got = sorted((r.item_no, round(r.box.x, 4), round(r.box.width, 4), round(r.box.y, 4), round(r.box.height, 4)) for r in columns.span_boxes(spans, indexed, sizes).collect())
    # "ne" and the tab of the first item (its characters 4 to 6 of 8), "Do" of the second
    assert got == [(0, 0.49, 0.32, 0.4, 0.135), (1, 0.94, 0.22, 0.4, 0.135)]


def test_empty_items_and_tiny_bodies_stop_no_job(spark):
    rects = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 100.0, 100.0)], "doc_id int, page int, rect int, x1 double, y1 double, x2 double, y2 double")
    df = items(spark, [("", 10, 50, 0, 10, False), ("ab", 20, 50, 20, 10, False)])
    assert [r.text for r in layout.text_in_rect(df, rects).collect()] == ["ab"]
    p = spark.createDataFrame([(1, "tiny", 0.1, 1, False, False)], "doc_id int, text string, size double, lines int, bold boolean, list boolean")
    assert [r.level for r in layout.heading_levels(p).collect()] == [None]


def test_tabs_go_to_stops(spark):
    df = spark.createDataFrame([("a\tb\t\tc",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(expand_tabs(F.col("t"))).collect()] == ["a   b       c", "", None]


def test_no_text_is_lost_in_chunks(spark):
    texts = ["!" * 1500, "...lead in. " + "word " * 400, "a! ! ! " * 300, "x" * 2500, "", "short!"]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sentence_chunks(F.col("t"))).collect()]
    for text, chunks in zip(texts, out):
        assert all(len(c) <= 1000 for c in chunks)
        assert "".join("".join(chunks).split()) == "".join(text.split())


def test_markdown_tables_and_single_rows(spark):
    rows = [(1, 0, 0, "Head", 1, False), (1, 0, 1, "a\tb\tc", None, False), (1, 0, 2, "1\t2", None, False), (1, 0, 3, "3. third", None, True), (1, 0, 4, "- x_y", None, True), (1, 1, 0, "p\tq", None, False)]
    p = spark.createDataFrame(rows, "doc_id int, page int, paragraph int, text string, level int, list boolean")
    assert layout.markdown_document(p).collect()[0].text == "# Head\n\n| a | b | c |\n| --- | --- | --- |\n| 1 | 2 |  |\n\n3. third\n- x\\_y\n\np q"


def test_a_cell_of_any_width_gives_bands(spark):
    cells = [(1, 0, r, 0.0, 50.5) for r in range(12)] + [(1, 0, r, 100.0, 3e9) for r in range(12)] + [(1, 0, 12, 60.0, 70.0), (2, 0, 0, 1.0, 2.0)]
    got = columns.column_bands(spark.createDataFrame(cells, "doc_id int, page int, row int, x0 double, x1 double")).collect()
    assert sorted((r.doc_id, r.band, r.x0, r.x1) for r in got) == [(1, 0, 0, 51), (1, 1, 100, 3_000_000_000)]


def test_reading_order_takes_one_exchange_for_the_items(spark):
    import re

    items = [(1, 0, k, f"w{k}", 40.0 + 330 * (k >= 40) + k % 4 * 60, 100.0 + k % 40 // 4 * 14, 55.0, 10.0, False) for k in range(80)]
    df = spark.createDataFrame(items, "doc_id int, page int, item_no int, text string, x double, y double, width double, size double, bold boolean")
    words = columns.reading_order_words(df, spark.createDataFrame([(1, 0, 600.0)], "doc_id int, page int, page_width double"))
    assert len(re.findall("Exchange hashpartitioning", words._jdf.queryExecution().executedPlan().toString())) <= 3
    assert [r.word for r in sorted(words.collect(), key=lambda r: r.pos)] == [f"w{k}" for k in range(80)]
    assert {r.column for r in columns.split_columns(df, spark.createDataFrame([(1, 0, 600.0)], "doc_id int, page int, page_width double")).collect()} == {0, 1}


def test_page_rows_meet_their_items_once(spark):
    # cells, bands and rows were joined and sorted again and again before
    cells = [(1, 0, k, t, float(x), 100.0 + 14 * (k // 3), 60.0, 10.0, False) for k, (t, x) in enumerate([("a", 72), ("b", 200), ("c", 340), ("d", 72), ("(7)", 134), ("9.50", 340), (" ", 72), ("e  f", 201)])]
    items = spark.createDataFrame(cells, "doc_id int, page int, item_no int, text string, x double, y double, width double, size double, bold boolean")
    plan = columns.table_rows(items)._jdf.queryExecution()
    assert "Join" not in plan.optimizedPlan().toString() and plan.executedPlan().toString().count("Exchange") == 1
    rows = sorted((r.row, r.band, r.text, r.number) for r in columns.table_rows(items).collect())
    assert rows == [(1, 0, "a", None), (1, 1, "b", None), (1, 2, "c", None), (2, 0, "d (7)", None), (2, 2, "9.50", 9.5), (3, 1, "e f", None)]
    assert rows == sorted((r.row, r.band, r.text, r.number) for r in columns.page_rows(layout.group_lines(items)).collect())
