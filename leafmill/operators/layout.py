"""Lines and paragraphs from positioned text: ``doc_id, page, item_no, text, x, y, width, size, bold``; y grows downwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.spans import let, running
from leafmill.operators.contains import containing

# Page numbers in margins, list marks, and sizes of headings against the body.
PAGE_NUMBER = r"(?i)^(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?$|^[-–—]\s*\d{1,4}\s*[-–—]$"
BULLET = r"^\s*([•●○◦▪▫■□‣⁃∙·*–-])\s+"
NUMBERED = r"(?i)^\s*(\(?(\d{1,3}|[a-z]|[ivxlcdm]{1,5})[.)])\s+"
HEADINGS = [(1.6, 1), (1.3, 2), (1.12, 3)]
BLANK = {"strict": 0.00002, "normal": 0.0003, "scanned": 0.004}
PAGE = ("doc_id", "page")


def mode_of(values: Column, weights: Column) -> Column:
    """The value of an array, rounded to halves, that has the most weight; of equal ones the first."""
    half = F.transform(values, lambda v: F.floor(v * 2 + 0.5) / 2)

    def one(k: Column) -> Column:
        weight = F.aggregate(F.zip_with(half, weights, lambda v, w: F.when(v == k, w).otherwise(0)), F.lit(0), lambda x, y: x + y)
        return F.struct(weight.alias("w"), (-F.array_position(half, k)).alias("first"), k.alias("value"))

    return F.array_max(F.transform(F.array_distinct(half), one))["value"]


def lines_of(items: Column) -> Column:
    """An array of items (``y``, ``x``, ``size`` and more), sorted by y, x and number, cut into lines: an array of arrays.

    An item is on the line before it if its baseline is within 45 % of the larger size of the line's anchor, its largest item so far. That is
    a running state, so the items are folded in order; what is folded up is only where lines begin.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("size"), F.array().cast("array<int>").alias("begins"))

    def step(acc: Column, i: Column) -> Column:
        same = F.coalesce(F.abs(i["y"] - acc["y"]) <= F.greatest(F.lit(1.5), F.lit(0.45) * F.greatest(i["size"], acc["size"])), F.lit(False))
        taller = ~same | (i["size"] > acc["size"])
        begins = F.when(same, acc["begins"]).otherwise(F.concat(acc["begins"], F.array(acc["n"])))
        return F.struct((acc["n"] + 1).alias("n"), F.when(taller, i["y"]).otherwise(acc["y"]).alias("y"), F.when(taller, i["size"]).otherwise(acc["size"]).alias("size"), begins.alias("begins"))

    def cut(x: Column) -> Column:
        return F.transform(x["begins"], lambda at, k: F.slice(x["items"], at + 1, F.coalesce(F.get(x["begins"], k + 1), F.size(x["items"])) - at))

    return let(let(items, lambda i: F.struct(i.alias("items"), F.aggregate(i, start, step, lambda a: a["begins"]).alias("begins"))), cut)


def line_pages(items: DataFrame, by: tuple[str, ...] = PAGE, fields: list[str] | None = None) -> DataFrame:
    """``by`` and ``_lines``: the lines of each page from its top, each an array of its items' ``fields`` (all that are not in ``by``)."""
    first = ["y", "x", "item_no", "size"]
    rest = [c for c in fields or items.columns if c not in (*by, *first)]
    used = items.filter((F.trim("text") != "") & (F.col("size") > 0))
    page = used.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*first, *rest))).alias("_items"))
    return page.select(*by, lines_of(F.col("_items")).alias("_lines"))


def group_lines(items: DataFrame, by: tuple[str, ...] = PAGE) -> DataFrame:
    """``items`` with ``line``: numbered from the top of each page, or of each column where ``by`` has one.

    A page's items travel as one array, once; a page is small, and pages are dealt over the cluster.
    """
    rest = [c for c in items.columns if c not in by]
    numbered = F.flatten(F.transform("_lines", lambda line, k: F.transform(line, lambda i: F.struct(*[i[c].alias(c) for c in rest], (k + 1).alias("line")))))
    return line_pages(items, by).select(*by, F.inline(numbered))


def _pieces(lined: DataFrame, tab_gap: float, by: tuple[str, ...]) -> DataFrame:
    """``lined`` with ``_t``, the item's text with the tab or space that its gap to the items before stands for."""
    w = Window.partitionBy(*by, "line").orderBy("x", "item_no")
    before = F.max(F.col("x") + F.col("width")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap, last = F.col("x") - before, F.lag("text").over(w)
    df = lined.withColumn("_tab", F.coalesce(gap > tab_gap * F.col("size"), F.lit(False)))
    space = F.coalesce((gap > 0.15 * F.col("size")) & ~last.rlike(r"\s$") & ~F.col("text").rlike(r"^\s"), F.lit(False))
    own = F.when(F.coalesce(F.lead("_tab").over(w), F.lit(False)), F.rtrim("text")).otherwise(F.col("text"))
    return df.withColumn("_t", F.when(F.col("_tab"), F.concat(F.lit("\t"), F.ltrim(own))).when(space, F.concat(F.lit(" "), own)).otherwise(own))


def line_text(lined: DataFrame, tab_gap: float = 3, by: tuple[str, ...] = PAGE) -> DataFrame:
    """``doc_id, page, line, text, x, right, y, size, bold``: wide gaps between items become tabs, smaller ones spaces.

    A line has the size of most of its characters, and the baseline of its first item of that size.
    """
    rows = _pieces(lined, tab_gap, by).groupBy(*by, "line").agg(
        F.array_sort(F.collect_list(F.struct("x", "item_no", "_t", "y", "size", F.length("text").alias("n")))).alias("_i"),
        F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"), F.bool_and(F.coalesce("bold", F.lit(False))).alias("bold"),
    )
    rows = rows.withColumn("size", mode_of(F.col("_i.size"), F.col("_i.n")))
    main = F.get(F.filter("_i", lambda i: F.abs(i["size"] - F.col("size")) < 0.01), F.lit(0))["y"]
    return rows.select(*by, "line", F.array_join("_i._t", "").alias("text"), "x", "right", F.coalesce(main, F.get("_i", F.lit(0))["y"]).alias("y"), "size", "bold")


def page_lines(items: DataFrame, tab_gap: float = 3, by: tuple[str, ...] = PAGE) -> DataFrame:
    """``line_text`` of items that have no lines yet: a page's items meet once, as an array, and only its lines come out of it."""
    pages = line_pages(items, by, ["text", "width", "bold"])

    def with_gaps(line: Column) -> Column:
        reach = running(F.transform(line, lambda i: i["x"] + i["width"]), lambda u, v: F.greatest(u, v))
        own = lambda r: lambda i, k: F.struct(*[i[c].alias(c) for c in ("x", "y", "size", "text", "bold")], (i["x"] + i["width"]).alias("right"), (i["x"] - F.get(r, k - 1)).alias("gap"))
        return let(reach, lambda r: F.transform(line, own(r)))

    tab = lambda i: F.coalesce(i["gap"] > tab_gap * i["size"], F.lit(False))

    def piece(line: Column, i: Column, k: Column) -> Column:
        last = F.get(line, k - 1)["text"]
        space = F.coalesce((i["gap"] > 0.15 * i["size"]) & ~last.rlike(r"\s$") & ~i["text"].rlike(r"^\s"), F.lit(False))
        own = F.when(F.coalesce(tab(F.get(line, k + 1)), F.lit(False)), F.rtrim(i["text"])).otherwise(i["text"])
        return F.when(tab(i), F.concat(F.lit("\t"), F.ltrim(own))).when(space, F.concat(F.lit(" "), own)).otherwise(own)

    def shown(line: Column) -> Column:
        # most lines are of one size
        sizes = F.transform(line, lambda i: i["size"])
        size = F.when(F.array_min(sizes) == F.array_max(sizes), F.floor(F.array_min(sizes) * 2 + 0.5) / 2).otherwise(mode_of(sizes, F.transform(line, lambda i: F.length(i["text"]))))
        main = lambda z: F.coalesce(F.get(F.filter(line, lambda i: F.abs(i["size"] - z) < 0.01), F.lit(0))["y"], F.get(line, F.lit(0))["y"])
        return let(size, lambda z: F.struct(
            F.array_join(F.transform(line, lambda i, k: piece(line, i, k)), "").alias("text"), F.array_min(F.transform(line, lambda i: i["x"])).alias("x"),
            F.array_max(F.transform(line, lambda i: i["right"])).alias("right"), main(z).alias("y"), z.alias("size"), F.forall(line, lambda i: F.coalesce(i["bold"], F.lit(False))).alias("bold"),
        ))

    by_x = lambda line: F.array_sort(F.transform(line, lambda i: F.struct(*[i[c].alias(c) for c in ("x", "item_no", "y", "size", "text", "width", "bold")])))
    lines = F.transform("_lines", lambda line, k: F.struct((k + 1).alias("line"), let(let(by_x(line), with_gaps), shown).alias("l")))
    return pages.select(*by, F.inline(lines)).select(*by, "line", "l.text", "l.x", "l.right", "l.y", "l.size", "l.bold")


def line_segments(lined: DataFrame, tab_gap: float = 3, by: tuple[str, ...] = PAGE) -> DataFrame:
    """``doc_id, page, line, segment, text, bold, italic, size``: stretches of one style in each line, from 0; ``italic`` may be missing."""
    lined = lined if "italic" in lined.columns else lined.withColumn("italic", F.lit(False))
    w = Window.partitionBy(*by, "line").orderBy("x", "item_no")
    df = _pieces(lined, tab_gap, by).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("bold", "italic")})
    new = (F.col("bold") != F.lag("bold").over(w)) | (F.col("italic") != F.lag("italic").over(w)) | (F.abs(F.col("size") - F.lag("size").over(w)) >= 0.25)
    df = df.withColumn("segment", F.sum(F.when(new, 1).otherwise(0)).over(w).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "item_no", "_t"))), lambda s: s["_t"]), "")
    return df.groupBy(*by, "line", "segment").agg(text.alias("text"), F.first("bold").alias("bold"), F.first("italic").alias("italic"), F.min_by("size", F.struct("x", "item_no")).alias("size"))


def remove_running_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Without lines in the top or bottom 8 % of a page (``doc_id, page, height``) that are page numbers, or whose text, digits apart, is
    on at least half of the pages and on three."""
    key = F.lower(F.trim(F.regexp_replace(F.regexp_replace("text", r"\d+", "#"), r"\s+", " ")))
    df = lines.join(pages, ["doc_id", "page"]).withColumn("_margin", (F.col("y") < F.col("height") * 0.08) | (F.col("y") > F.col("height") * 0.92)).withColumn("_key", key)
    count = pages.groupBy("doc_id").agg(F.count("*").alias("_pages"))
    often = df.filter("_margin").groupBy("doc_id", "_key").agg(F.countDistinct("page").alias("_n")).join(count, "doc_id").filter((F.col("_n") >= 3) & (F.col("_n") * 2 >= F.col("_pages"))).select("doc_id", "_key", F.lit(True).alias("_often"))
    out = df.join(often, ["doc_id", "_key"], "left")
    return out.filter(~(F.col("_margin") & (F.trim("text").rlike(PAGE_NUMBER) | F.coalesce("_often", F.lit(False))))).select(*lines.columns)


def group_paragraphs(lines: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """``lines`` with ``paragraph``, numbered in each page: a new one after a gap, a change of size or weight, at a list mark or a tab,
    at an indent that does not continue a list item, between centred and other lines, and after a short line that ends a sentence.

    ``widths`` (``doc_id, page, page_width``) tells which lines are centred; without it none is.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    df = lines.withColumn("page_width", F.lit(None).cast("double")) if widths is None else lines.join(widths.select("doc_id", "page", "page_width"), ["doc_id", "page"], "left")
    wide, middle = F.col("page_width"), (F.col("x") + F.col("right")) / 2
    centred = (F.abs(middle - wide / 2) < wide * 0.03) & (F.col("right") - F.col("x") < wide * 0.7) & (F.col("x") > wide * 0.12)
    begins = F.col("text").rlike(BULLET) | F.col("text").rlike(NUMBERED)
    df = df.withColumns({"centered": F.coalesce(centred, F.lit(False)), "list": begins, "_widest": F.max("right").over(Window.partitionBy("doc_id", "page"))})
    text, last = F.col("text"), F.lag("text").over(w)
    gap, prior = F.col("y") - F.lag("y").over(w), F.lag("size").over(w)
    hard = (
        last.isNull() | F.rtrim(last).contains("\t") | text.contains("\t") | (gap > F.greatest("size", prior) * 1.75) | (gap < 0) | (F.abs(F.col("size") - prior) > prior * 0.15)
        | F.col("list") | (F.col("bold") != F.lag("bold").over(w)) | (F.col("centered") != F.lag("centered").over(w))
        | (F.rtrim(last).rlike(r"[.!?:][\"”’)]?$") & (F.lag("right").over(w) < F.col("_widest") - F.col("size") * 4))
    )
    # an indent never breaks a list item, and what it begins is none: so the last break of another kind tells
    df = df.withColumn("_hard", hard).withColumn("_in_list", F.last(F.when(F.col("_hard"), F.col("list")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    indent = ~F.coalesce("_in_list", F.lit(False)) & (F.col("x") > F.lag("x").over(w) + F.col("size") * 1.2)
    number = F.sum(F.when(F.col("_hard") | F.coalesce(indent, F.lit(False)), 1).otherwise(0)).over(w).cast("int")
    return df.withColumn("paragraph", number).select(*lines.columns, "list", "centered", "paragraph")


def paragraph_text(paragraphs: DataFrame) -> DataFrame:
    """``doc_id, page, paragraph, text, lines, size, bold, list``; words cut by a hyphen at a line's end are joined."""
    from leafmill.functions.text import join_lines

    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"])
    rows = paragraphs.groupBy("doc_id", "page", "paragraph").agg(texts.alias("_texts"), F.count("*").alias("lines"), F.max("size").alias("size"), F.bool_and("bold").alias("bold"), F.min_by("list", "line").alias("list"))
    return rows.withColumn("text", join_lines(F.col("_texts"))).drop("_texts")


def heading_levels(paragraphs: DataFrame) -> DataFrame:
    """``level``: 1 to 3 by size against the document's body, or 3 for a short bold line; null for text."""
    half = F.floor(F.col("size") * 2 + 0.5) / 2
    weight = paragraphs.groupBy("doc_id", half.alias("_s")).agg(F.sum(F.length("text")).alias("_w"))
    body = weight.groupBy("doc_id").agg(F.max_by("_s", F.struct("_w", -F.col("_s"))).alias("_body"))
    df, t = paragraphs.join(body, "doc_id"), F.trim("text")
    plain = F.col("list") | t.contains("\t") | (F.col("lines") > 3) | (F.length(t) > 200) | ~t.rlike(r"\p{L}")
    level = F.when(plain, F.lit(None))
    for ratio, n in HEADINGS:
        level = level.when(F.try_divide("size", "_body") >= ratio, n)
    level = level.when(F.col("bold") & (F.col("lines") == 1) & (F.length(t) <= 80) & ~t.rlike("[.:,;]$"), 3)
    return df.withColumn("level", level).drop("_body")


def text_in_rect(items: DataFrame, rects: DataFrame) -> DataFrame:
    """The characters of items whose middle is inside each rectangle ``doc_id, page, rect, x1, y1, x2, y2``, on the same page."""
    n = F.length("text")
    hit = items.filter(n > 0).join(rects, ["doc_id", "page"]).filter(F.col("y").between(F.least("y1", "y2") - 2, F.greatest("y1", "y2") + 2))
    middle = lambda i: F.col("x") + (i - F.lit(0.5)) * F.col("width") / n
    inside = F.filter(F.sequence(F.lit(1), n), lambda i: middle(i).between(F.least("x1", "x2"), F.greatest("x1", "x2")))
    part = F.array_join(F.transform(inside, lambda i: F.substring(F.col("text"), i, F.lit(1))), "")
    found = hit.withColumn("_p", part).filter("_p <> ''").groupBy("doc_id", "page", "rect").agg(F.array_sort(F.collect_list(F.struct("item_no", "_p"))).alias("_l"))
    return found.select("doc_id", "page", "rect", F.trim(F.regexp_replace(F.array_join(F.transform("_l", lambda s: s["_p"]), " "), r"\s+", " ")).alias("text"))


def blank_pages(pages: DataFrame, level: str = "normal") -> DataFrame:
    """Pages ``has_text, ink`` without text whose share of dark pixels is at most that of ``level``: strict, normal or scanned."""
    return pages.filter(~F.coalesce("has_text", F.lit(False)) & (F.col("ink") <= BLANK[level]))


def textless_pages(pages: DataFrame, items: DataFrame) -> DataFrame:
    return pages.join(items.filter(F.trim("text") != "").select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def annotation_hits(annotations: DataFrame, queries: DataFrame) -> DataFrame:
    """``doc_id, page, annot_no, query`` of annotations whose text holds a query, without regard to case and runs of white space.

    Many queries are looked up in an index of the texts' stretches of characters (``contains``).
    """
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    q = queries.select("query", flat(F.col("query")).alias("_q")).filter("_q <> ''").distinct()
    texts = annotations.select("doc_id", "page", "annot_no", flat(F.col("text")).alias("_t"))
    return containing(texts, q, "_t", "_q").select("doc_id", "page", "annot_no", "query")


def join_across_pages(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` with those that a page break cut made one: the first ends with a letter or comma, the next begins in lower case on a later
    page, both in one size and no list. The whole stands where its first part did."""
    w = Window.partitionBy("doc_id").orderBy("page", "paragraph")
    flows = ~F.col("list") & ~F.lag("list").over(w) & F.rtrim(F.lag("text").over(w)).rlike(r"[\p{L},]$") & F.col("text").rlike(r"^\s*\p{Ll}") & (F.abs(F.lag("size").over(w) - F.col("size")) < 0.5)
    df = paragraphs.withColumns({"_flows": F.coalesce(flows, F.lit(False)), "_turned": F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(False))})
    df = df.withColumn("_run", F.sum(F.when(F.col("_flows"), 0).otherwise(1)).over(w))
    turned = F.max(F.col("_flows") & F.col("_turned")).over(Window.partitionBy("doc_id", "_run").orderBy("page", "paragraph"))
    df = df.withColumn("_joined", turned).withColumn("_whole", F.sum(F.when(F.col("_joined"), 0).otherwise(1)).over(w))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "paragraph", F.trim("text").alias("t")))), lambda s: s["t"])
    first = {c: F.min_by(c, F.struct("page", "paragraph")).alias(c) for c in paragraphs.columns if c not in ("doc_id", "text", "lines")}
    return df.groupBy("doc_id", "_whole").agg(*first.values(), F.array_join(texts, " ").alias("text"), F.sum("lines").alias("lines")).select(*paragraphs.columns)


def markdown_document(paragraphs: DataFrame, page_marks: bool = False) -> DataFrame:
    """``doc_id, text``: paragraphs with their ``level`` and ``list`` as Markdown, a blank line between them but not inside lists.

    Paragraphs with tabs in a row are a table, the first of them its head; one alone is text. With ``page_marks`` a comment with the page's
    number, from 1, stands before the first paragraph of each page, and ends a table. A document's paragraphs travel as one array, once.
    """
    from leafmill.functions.text import escape_markdown

    t = F.trim("text")
    row = t.contains("\t") & F.col("level").isNull()
    number = F.regexp_extract(t, r"^\s*\(?(\d{1,3})[.)]\s", 1)
    body = escape_markdown(F.regexp_replace(F.regexp_replace(t, BULLET, ""), NUMBERED, ""))
    shown = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), escape_markdown(t))).when(F.col("list"), F.concat(F.when(number != "", F.concat(number, F.lit(". "))).otherwise("- "), body)).otherwise(escape_markdown(t))
    cells = F.when(row, F.transform(F.split(t, "\t+"), lambda c: F.trim(escape_markdown(c))))
    item = F.struct("page", "paragraph", row.alias("row"), (F.coalesce("list", F.lit(False)) & F.col("level").isNull() & ~row).alias("list"), cells.alias("cells"), F.when(~row, shown).alias("shown"))
    docs = paragraphs.filter(F.trim("text") != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("_p"))

    def with_blocks(every: Column) -> Column:
        turned = lambda k: F.coalesce(F.get(every, k - 1)["page"] != F.get(every, k)["page"], F.lit(True)) & F.lit(page_marks)
        goes_on = lambda i, k: i["row"] & F.coalesce(F.get(every, k - 1)["row"], F.lit(False)) & ~turned(k)
        begins = F.filter(F.transform(every, lambda i, k: F.when(~goes_on(i, k), F.struct(k.alias("at"), turned(k).alias("mark")))), lambda b: b.isNotNull())
        part = lambda b, at, k: F.slice(every, at["at"] + 1, F.coalesce(F.get(b, k + 1)["at"], F.size(every)) - at["at"])
        return let(begins, lambda b: F.transform(b, lambda at, k: F.struct(at["mark"].alias("mark"), part(b, at, k).alias("rows"))))

    def table(rows: Column) -> Column:
        wide = F.array_max(F.transform(rows, lambda r: F.size(r["cells"])))
        line = lambda w: lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r["cells"], F.array_repeat(F.lit(""), w - F.size(r["cells"]))), " | "), F.lit(" |"))
        ruled = lambda w, lines: F.array_join(F.concat(F.slice(lines, 1, 1), F.array(F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), w))), F.slice(lines, F.lit(2), F.size(lines))), "\n")
        return let(wide, lambda w: let(F.transform(rows, line(w)), lambda lines: ruled(w, lines)))

    def written(blocks: Column) -> Column:
        def piece(b: Column, k: Column) -> Column:
            first = F.get(b["rows"], F.lit(0))
            listed = first["list"] & F.coalesce(F.get(F.get(blocks, k - 1)["rows"], F.lit(0))["list"], F.lit(False)) & ~b["mark"]
            lead = F.when(k == 0, "").when(listed, "\n").otherwise("\n\n")
            head = F.when(b["mark"], F.concat(F.lit("<!-- Page "), (first["page"] + 1).cast("string"), F.lit(" -->\n\n"))).otherwise("")
            text = F.when(~first["row"], first["shown"]).when(F.size(b["rows"]) > 1, table(b["rows"])).otherwise(F.array_join(first["cells"], " "))
            return F.concat(lead, head, text)

        return F.array_join(F.transform(blocks, piece), "")

    return docs.select("doc_id", let(let(F.col("_p"), with_blocks), written).alias("text"))
