"""Columns, cells, phrases, blocks and documents, on pages set from the words of ``conversations`` and from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions.spans import regex_spans
from leafmill.functions.text import text_blocks
from leafmill.operators import columns, layout
from leafmill.sources.tables import read_table

WIDE, HIGH = 600.0, 800.0


def _words(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), w.alias("w"))


def _items(spark, sf_dir):
    """Turns of 40 words and more in two columns of four words a line, others in lines of eight; every fourth word is bold.

    Turns are dealt by page as texts, so the words made from them are where their page's other words are and are not dealt again.
    """
    df = _words(spark, sf_dir).repartition("doc_id", "page").select("doc_id", "page", F.size("w").alias("n"), F.posexplode("w").alias("k", "text"))
    two, half = F.col("n") >= 40, F.ceil(F.col("n") / 2)
    right = two & (F.col("k") >= half)
    own, wide = F.when(right, F.col("k") - half).otherwise(F.col("k")), F.when(two, 4).otherwise(8)
    x = F.when(right, 330).otherwise(40) + (own % wide) * 60
    return df.select("doc_id", "page", F.col("k").alias("item_no"), "text", x.cast("double").alias("x"), (100 + F.floor(own / wide) * 14).cast("double").alias("y"), F.lit(55.0).alias("width"), F.lit(10.0).alias("size"), (F.col("k") % 4 == 0).alias("bold"))


def _sizes(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", "page", F.lit(WIDE).alias("page_width"), F.lit(HIGH).alias("page_height"))


def reading_order(spark, sf_dir):
    words = columns.reading_order_words(_items(spark, sf_dir), _sizes(spark, sf_dir))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"])
    return words.groupBy("doc_id", "page").agg(F.array_join(in_order, " ").alias("text"))


def phrases(spark, sf_dir):
    return columns.merge_phrases(_items(spark, sf_dir)).select("doc_id", "page", F.col("phrase").cast("long").alias("phrase"), "text", "x", "width")


def blocks(spark, sf_dir):
    """Each column is one block, though its lines come between those of the other."""
    p = columns.merge_phrases(_items(spark, sf_dir))
    lines = p.select("doc_id", "page", F.col("phrase").alias("line"), "text", "x", (F.col("x") + F.col("width")).alias("right"), "y", "size", F.lit(False).alias("bold"))
    return columns.translate_blocks(lines).select("doc_id", "page", "x", F.regexp_replace("text", "[ -]", "").alias("letters"), F.col("lines").cast("long").alias("lines"))


def boxes(spark, sf_dir):
    """Boxes of the last two words of each page."""
    indexed = columns.page_index(_items(spark, sf_dir), ["item_no"])
    spans = columns.indexed_text(indexed).select("doc_id", "page", F.explode(regex_spans(F.col("text"), r"\S+ \S+$")).alias("s")).select("doc_id", "page", "s.start", "s.stop")
    found = columns.span_boxes(spans, indexed, _sizes(spark, sf_dir))
    return found.select("doc_id", "page", F.col("item_no").cast("long").alias("item_no"), *[F.round(f"box.{c}", 9).alias(c) for c in ("x", "y", "width", "height")])


def hits(spark, sf_dir):
    """Pages' places of "of the", over the border of two items."""
    indexed = columns.page_index(_items(spark, sf_dir), ["item_no"])
    return columns.find_text(columns.indexed_text(indexed), "OF  the").select("doc_id", "page", F.col("start").cast("long").alias("start"))


def segments(spark, sf_dir):
    """Stretches of bold and plain text in lines of eight words."""
    df = _words(spark, sf_dir).select("doc_id", "page", F.posexplode("w").alias("item_no", "text"))
    k = F.col("item_no")
    items = df.select("*", (40 + k % 8 * 60).cast("double").alias("x"), (100 + F.floor(k / 8) * 14).cast("double").alias("y"), F.lit(55.0).alias("width"), F.lit(10.0).alias("size"), (k % 4 == 0).alias("bold"))
    return layout.line_segments(layout.group_lines(items)).select("doc_id", "page", F.col("line").cast("long").alias("line"), F.col("segment").cast("long").alias("segment"), "text", "bold")


def _numbered(spark, sf_dir):
    """Lines of orders, numbered in each from 1 as ``at``."""
    df = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return df.withColumn("at", F.row_number().over(w))


def page_rows(spark, sf_dir):
    """Orders as pages with a table: line, quantity and price."""
    df, at = _numbered(spark, sf_dir), F.col("at")
    cells = F.array(*[F.struct(F.lit(k).alias("c"), t.alias("text"), F.lit(x).alias("x")) for k, t, x in ((0, F.concat(F.lit("No"), at.cast("string")), 72.0), (1, F.format_string("(%d)", F.col("l_quantity").cast("int")), 200.0), (2, F.format_number("l_extendedprice", 2), 340.0))])
    items = df.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), "at", F.inline(cells))
    items = items.select("doc_id", "page", (at * 3 + F.col("c")).cast("int").alias("item_no"), "text", "x", (100.0 + at * 14).alias("y"), F.lit(60.0).alias("width"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"))
    return columns.table_rows(items).select("doc_id", "row", "band", "text", "number")


def markdown(spark, sf_dir):
    """Orders as documents: a heading, a list of parts, a table of quantities."""
    n, none = F.col("at"), F.lit(None).cast("int")
    paragraph = lambda no, text, level, listed: F.struct(no.alias("paragraph"), text.alias("text"), level.alias("level"), F.lit(listed).alias("list"))
    head = paragraph(F.lit(0), F.concat(F.lit("Order_"), "l_orderkey"), F.lit(1), False)
    part = paragraph(n, F.concat(F.lit("• part "), "l_partkey"), none, True)
    row = paragraph(n + 100, F.concat(F.lit("*"), n.cast("string"), F.lit("\t"), F.col("l_quantity").cast("int").cast("string")), none, False)
    # an order's paragraphs come from its lines where these are numbered: the heading from the first
    own = F.when(n == 1, F.array(head, part, row)).otherwise(F.array(part, row))
    p = _numbered(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.inline(own))
    return layout.markdown_document(p, page_marks=True)


def joined(spark, sf_dir):
    """Paragraphs cut by page breaks: the second to fourth word of each turn, a page for each turn."""
    w = _words(spark, sf_dir).filter("size(w) > 1")
    p = w.select("doc_id", "page", F.lit(0).alias("paragraph"), F.array_join(F.slice("w", 2, 3), " ").alias("text"), F.lit(1).cast("long").alias("lines"), F.lit(10.0).alias("size"), F.lit(False).alias("list"))
    return layout.join_across_pages(p).select("doc_id", "page", "text", "lines")


def headings(spark, sf_dir):
    """Lines of orders as paragraphs of several sizes against a body of 10 points."""
    df, n = _numbered(spark, sf_dir), F.least("at", F.lit(7))
    size = F.element_at(F.array(*map(F.lit, (10.0, 16.0, 13.0, 11.5, 10.0, 10.0, 10.0))), n.cast("int"))
    text = F.when(n == 1, F.repeat(F.lit("body "), 40)).when(n == 6, "A bold line.").when(n == 7, "• an item").otherwise(F.concat(F.lit("line "), n.cast("string")))
    p = df.select(F.col("l_orderkey").alias("doc_id"), F.col("at").alias("paragraph"), size.alias("size"), text.alias("text"), F.lit(1).alias("lines"), (n >= 5).alias("bold"), (n == 7).alias("list"))
    return layout.heading_levels(p).select("doc_id", "paragraph", F.col("level").cast("long").alias("level"))


def lines_of_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    rows = text_blocks(d, "doc_id", "text")
    t = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sha2(F.array_join(t, "|"), 256).alias("sha"))


def blank(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_tax")
    pages = df.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_returnflag") == "N").alias("has_text"), (F.col("l_tax") / 100).alias("ink"))
    counts = [layout.blank_pages(pages, level).groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("level", F.lit(level)) for level in layout.BLANK]
    return counts[0].union(counts[1]).union(counts[2])


def textless(spark, sf_dir):
    """Pages that have none but blank items: turns, with the text of every third left out."""
    pages = _words(spark, sf_dir).select("doc_id", "page").distinct()
    items = _words(spark, sf_dir).select("doc_id", "page", F.when(F.col("page") % 3 == 0, " ").otherwise(F.array_join("w", " ")).alias("text"))
    return layout.textless_pages(pages, items)


QUERIES = {f"layout_{f.__name__}": f for f in (reading_order, phrases, blocks, boxes, hits, segments, page_rows, markdown, joined, headings, lines_of_text, blank, textless)}
_W = r"w AS (SELECT conv_id AS doc_id, turn AS page, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations)"
_K = f"{_W}, k AS (SELECT *, len(w) AS n, (len(w) + 1) // 2 AS half, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS k FROM w), i AS (SELECT *, n >= 40 AS two, n >= 40 AND k >= half AS r FROM k), p AS (SELECT *, CASE WHEN r THEN k - half ELSE k END AS own, CASE WHEN two THEN 4 ELSE 8 END AS wide FROM i)"
_N = "k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k FROM lineitem)"
SQL = {
    "layout_reading_order": f"WITH {_W} SELECT doc_id, page, array_to_string(w, ' ') AS text FROM w WHERE len(w) > 0",
    "layout_phrases": f"WITH {_K}, g AS (SELECT doc_id, page, own // wide AS row, r, string_agg(t, ' ' ORDER BY k) AS text, count(*) AS c FROM p GROUP BY ALL) SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY row, r) AS phrase, text, CASE WHEN r THEN 330.0 ELSE 40.0 END::DOUBLE AS x, (c * 60 - 5)::DOUBLE AS width FROM g",
    "layout_blocks": f"WITH {_K} SELECT doc_id, page, CASE WHEN r THEN 330.0 ELSE 40.0 END::DOUBLE AS x, replace(string_agg(t, '' ORDER BY k), '-', '') AS letters, ((count(*) + any_value(wide) - 1) // any_value(wide))::BIGINT AS lines FROM p GROUP BY doc_id, page, r",
    "layout_boxes": f"WITH {_K} SELECT doc_id, page, k AS item_no, round(((CASE WHEN r THEN 330 ELSE 40 END + own % wide * 60 - 1) / 600.0)::DOUBLE, 9) AS x, round(((100 + own // wide * 14 - 10) / 800.0)::DOUBLE, 9) AS y, round((57 / 600.0)::DOUBLE, 9) AS width, round((13.5 / 800.0)::DOUBLE, 9) AS height FROM p WHERE n > 1 AND k >= n - 2",
    "layout_hits": rf"WITH {_W}, t AS (SELECT doc_id, page, lower(array_to_string(w, ' ')) AS t FROM w), s AS (SELECT doc_id, page, string_split(t, 'of the') AS s FROM t WHERE contains(t, 'of the')), k AS (SELECT *, unnest(range(1, len(s))) AS k FROM s) SELECT doc_id, page, (list_sum(list_transform(s[1:k], lambda x: length(x))) + 6 * (k - 1))::BIGINT AS start FROM k",
    "layout_segments": f"WITH {_K}, s AS (SELECT doc_id, page, k // 8 AS line, (k % 8) // 4 * 2 + CASE WHEN k % 4 > 0 THEN 1 ELSE 0 END AS segment, string_agg(t, ' ' ORDER BY k) AS t FROM k GROUP BY ALL) SELECT doc_id, page, (line + 1)::BIGINT AS line, segment::BIGINT AS segment, CASE WHEN segment > 0 THEN ' ' ELSE '' END || t AS text, segment % 2 = 0 AS bold FROM s",
    "layout_page_rows": f"""WITH {_N}, n AS (SELECT l_orderkey AS doc_id, k::INT AS row, k AS l, l_quantity::INT AS q, l_extendedprice AS p FROM k)
SELECT doc_id, row, 0 AS band, 'No' || l AS text, NULL::DOUBLE AS number FROM n UNION ALL SELECT doc_id, row, 1, '(' || q || ')', -q::DOUBLE FROM n UNION ALL SELECT doc_id, row, 2, format('{{:,.2f}}', p), p::DOUBLE FROM n""",
    "layout_markdown": rf"""WITH {_N}, l AS (SELECT l_orderkey AS doc_id, string_agg('- part ' || l_partkey, chr(10) ORDER BY k) AS items, string_agg('| \*' || k || ' | ' || l_quantity::INT || ' |', chr(10) ORDER BY k) FILTER (k > 1) AS rest, count(*) AS n, min(k) AS f, min_by(l_quantity::INT, k) AS q FROM k GROUP BY 1)
SELECT doc_id, '<!-- Page 1 -->' || chr(10) || chr(10) || '# Order\_' || doc_id || chr(10) || chr(10) || items || chr(10) || chr(10) || CASE WHEN n = 1 THEN '\*' || f || ' ' || q ELSE '| \*' || f || ' | ' || q || ' |' || chr(10) || '| --- | --- |' || chr(10) || rest END AS text FROM l""",
    "layout_joined": rf"""WITH {_W}, t AS (SELECT doc_id, page, array_to_string(w[2:4], ' ') AS text FROM w WHERE len(w) > 1),
c AS (SELECT *, CASE WHEN regexp_matches(lag(text) OVER o, '[\p{{L}},]$') AND regexp_matches(text, '^\p{{Ll}}') THEN 0 ELSE 1 END AS new FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY page)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page) AS g FROM c) SELECT doc_id, min(page) AS page, string_agg(text, ' ' ORDER BY page) AS text, count(*)::BIGINT AS lines FROM g GROUP BY doc_id, g""",
    "layout_headings": f"WITH {_N} SELECT l_orderkey AS doc_id, k AS paragraph, CASE k WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 3 END::BIGINT AS level FROM k",
    "layout_lines_of_text": r"""WITH t AS (SELECT doc_id, list_transform(string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n+$', ''), chr(10)), lambda x: CASE WHEN x = '' THEN ' ' ELSE replace(x, chr(9), '    ') END) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(l)::BIGINT AS lines, sha256(array_to_string(l, '|')) AS sha FROM t""",
    "layout_blank": "SELECT l_orderkey AS doc_id, level, count(*) AS n FROM lineitem, (VALUES ('strict', 0.00002), ('normal', 0.0003), ('scanned', 0.004)) v(level, most) WHERE l_returnflag <> 'N' AND l_tax / 100 <= most GROUP BY ALL",
    "layout_textless": f"WITH {_W} SELECT doc_id, page FROM w WHERE page % 3 = 0 OR len(w) = 0 GROUP BY ALL",
}
