"""Columns, cells and phrases of positioned text: ``doc_id, page, item_no, text, x, y, width, size, bold``; y grows downwards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.spans import SPACE, let, prefix_sums, regex_spans, running
from leafmill.functions.text import cell_number, join_lines
from leafmill.operators.layout import PAGE, group_lines, line_pages, lines_of

# Fixed values of columns: where a gutter is sought (shares of the page's width), how wide it is at least, how many items a page has
# at least, what share of them may cross a gutter, how many lines a side has at least, and what share of it their median covers.
MIDDLE, GUTTER, LEAST_ITEMS, CROSSING, LEAST_LINES, LINE_SHARE = (0.3, 0.7), 8, 20, 0.03, 5, 0.5
COLUMN = (*PAGE, "column")


def covered_ranges(spans: Column, more_than: Column) -> Column:
    """The ranges (``start``, ``stop``) of whole numbers that more than ``more_than`` of ``spans`` cover, from left to right.

    A sweep: each span is +1 at its start and -1 at its stop, and running sums of the sorted edges count the spans over each
    stretch, however wide it is.
    """
    edges = F.array_sort(F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("by"))), F.transform(spans, lambda s: F.struct(s["stop"].alias("at"), F.lit(-1).alias("by")))))

    def swept(e: Column) -> Column:
        over = prefix_sums(F.transform(e, lambda x: x["by"]))
        parts = F.zip_with(e, over, lambda x, n: F.struct(x["at"].alias("start"), n.alias("n")))
        ended = lambda p: F.transform(p, lambda x, k: F.struct(x["start"].alias("start"), F.coalesce(F.get(p, k + 1)["start"], x["start"]).alias("stop"), x["n"].alias("n")))
        thick = let(parts, lambda p: F.filter(ended(p), lambda x: (x["stop"] > x["start"]) & (x["n"] > more_than)))
        # stretches that touch are one range
        begins = lambda t: F.filter(F.transform(t, lambda x, k: F.when((k == 0) | (F.get(t, k - 1)["stop"] < x["start"]), k)), lambda k: k.isNotNull())
        joined = lambda t, b: F.transform(b, lambda at, k: F.struct(F.get(t, at)["start"].alias("start"), F.get(t, F.coalesce(F.get(b, k + 1), F.size(t)) - 1)["stop"].alias("stop")))
        return let(thick, lambda t: let(begins(t), lambda b: joined(t, b)))

    return let(edges, swept)


def _columns_of(items: DataFrame, widths: DataFrame) -> DataFrame:
    """``doc_id, page, _gutter, _used, _left, _right``: the middle of each page's gutter, if it has one, its items in order, and their lines left and right of it."""
    page = items.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y", "x", "item_no", "size", "width", "text"))).alias("_all")).join(widths.select(*PAGE, "page_width"), list(PAGE), "left")
    page = page.withColumns({"_lo": F.floor(F.col("page_width") * MIDDLE[0]), "_hi": F.ceil(F.col("page_width") * MIDDLE[1]), "_text": F.filter("_all", lambda i: F.trim(i["text"]) != "")})
    spans = F.transform("_text", lambda i: F.struct(F.greatest("_lo", F.floor(i["x"])).alias("start"), F.least("_hi", F.ceil(i["x"] + i["width"])).alias("stop")))
    most = F.greatest(F.lit(1), F.floor(F.size("_text") * CROSSING))
    page = page.withColumn("_closed", covered_ranges(F.filter(spans, lambda s: s["stop"] > s["start"]), most))
    begins = F.concat(F.array("_lo"), F.transform("_closed", lambda c: c["stop"]))
    open_ = F.transform(begins, lambda b, k: F.struct((F.coalesce(F.get("_closed", k)["start"], F.col("_hi")) - b).alias("wide"), (-b).alias("back")))
    page = page.withColumn("_open", F.array_max(open_))
    page = page.withColumn("_middle", F.when((F.size("_text") >= LEAST_ITEMS) & (F.col("_open.wide") >= GUTTER), F.col("_open.wide") / 2 - F.col("_open.back")))
    page = page.withColumn("_used", F.filter("_text", lambda i: i["size"] > 0))
    left = lambda i: i["x"] + i["width"] / 2 < F.col("_middle")
    split = F.col("_middle").isNotNull()
    page = page.withColumns({"_left": F.when(split, lines_of(F.filter("_used", left))), "_right": F.when(split, lines_of(F.filter("_used", lambda i: ~left(i))))})
    right_of = lambda i: i["x"] + i["width"]

    def long(lines: str, wide: Column) -> Column:
        own = F.array_sort(F.transform(lines, lambda line: F.array_max(F.transform(line, right_of)) - F.array_min(F.transform(line, lambda i: i["x"]))))
        return let(own, lambda w: (F.size(w) >= LEAST_LINES) & (F.get(w, F.floor(F.size(w) / 2).cast("int")) > wide * LINE_SHARE))

    begin = F.array_min(F.transform(F.filter("_all", left), lambda i: i["x"]))
    end = F.array_max(F.transform(F.filter("_all", lambda i: ~left(i)), right_of))
    good = split & long("_left", F.col("_middle") - begin) & long("_right", end - F.col("_middle"))
    return page.select(*PAGE, F.when(good, F.col("_middle")).alias("_gutter"), "_used", "_left", "_right")


def split_columns(items: DataFrame, widths: DataFrame) -> DataFrame:
    """``items`` with ``column``: 0, or 1 for what stands right of a gutter; ``widths``: ``doc_id, page, page_width``.

    A gutter is the widest stretch in the middle of the page that hardly any item crosses. A page of fewer than 20 items is not split, nor is one
    where the lines of a side are few or short, as the cells of a table are.
    """
    out = items.join(_columns_of(items, widths).select(*PAGE, "_gutter"), list(PAGE), "left")
    return out.withColumn("column", F.when(F.col("x") + F.col("width") / 2 >= F.col("_gutter"), 1).otherwise(0)).drop("_gutter")


def page_index(items: DataFrame, order: list[str], by: tuple[str, ...] = PAGE) -> DataFrame:
    """``items`` with ``start, chars``: where an item's characters begin in its page's text, and the item's own offset of each of them.

    White space is made one space, none begins the text, and items that do not touch, or begin a new line, get a space between them. A page's items
    travel as one array, once; what stands before an item, and where it begins, are running results over that array.
    """
    first = [*order, *(c for c in ["item_no"] if c not in order)]
    rest = [c for c in items.columns if c not in (*by, *first)]
    page = items.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*first, *rest))).alias("_items"))
    n = lambda i: F.coalesce(F.length(i["text"]), F.lit(0))
    none = F.array().cast("array<int>")

    def apart(every: Column, i: Column, k: Column) -> Column:
        after = F.get(every, k + 1)
        return F.coalesce((F.abs(after["y"] - i["y"]) > i["size"] * 0.5) | (after["x"] - (i["x"] + i["width"]) > i["size"] * 0.15), F.lit(False))

    def with_ends(every: Column) -> Column:
        # whether a space ends what stands up to here: null where the item has no say in it
        own = lambda i, far: F.when((n(i) > 0) | far, far | F.coalesce(F.substring(i["text"], -1, 1).rlike(f"[{SPACE}]"), F.lit(False)))
        say = F.transform(every, lambda i, k: own(i, apart(every, i, k)))
        return F.struct(every.alias("items"), running(say, lambda u, v: F.coalesce(v, u)).alias("spaced"))

    def kept(text: Column, size: Column, spaced: Column) -> Column:
        """The offsets of the characters that are no white space, or the first of it."""
        white = lambda s: F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: c.rlike(f"[{SPACE}]"))
        seldom = let(white(text), lambda s: F.filter(F.sequence(F.lit(0), size - 1), lambda k: ~(F.get(s, k) & F.when(k == 0, spaced).otherwise(F.get(s, k - 1)))))
        return F.when(size == 0, none).when(text.rlike(f"[{SPACE}]"), seldom).otherwise(F.sequence(F.lit(0), size - 1))

    def with_chars(x: Column) -> Column:
        def chars(i: Column, k: Column) -> Column:
            spaced = F.coalesce(F.get(x["spaced"], k - 1), F.lit(True))
            ends = F.when(n(i) == 0, spaced).otherwise(F.substring(i["text"], -1, 1).rlike(f"[{SPACE}]"))
            return F.concat(kept(i["text"], n(i), spaced), F.when(apart(x["items"], i, k) & ~ends, F.array(n(i))).otherwise(none))

        return F.struct(x["items"].alias("items"), F.transform(x["items"], chars).alias("chars"))

    def with_starts(x: Column) -> Column:
        at = prefix_sums(F.transform(x["chars"], lambda c: F.size(c)))
        item = lambda i, k, ends: F.struct(*[i[c].alias(c) for c in (*first, *rest)], (F.get(ends, k) - F.size(F.get(x["chars"], k))).alias("start"), F.get(x["chars"], k).alias("chars"))
        return let(at, lambda ends: F.transform(x["items"], lambda i, k: item(i, k, ends)))

    whole = let(let(let(F.col("_items"), with_ends), with_chars), with_starts)
    return page.select(*by, F.inline(whole)).select(*items.columns, "start", "chars")


def indexed_text(indexed: DataFrame, by: tuple[str, ...] = PAGE) -> DataFrame:
    """``doc_id, page, text`` of items with ``start, chars``."""
    shown = F.array_join(F.transform("chars", lambda k: F.regexp_replace(F.coalesce(F.nullif(F.substring("text", k + 1, F.lit(1)), F.lit("")), F.lit(" ")), f"[{SPACE}]", " ")), "")
    parts = F.array_sort(F.collect_list(F.struct("start", "item_no", shown.alias("t"))))
    return indexed.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def find_text(pages: DataFrame, query: str) -> DataFrame:
    """``doc_id, page, start, stop``: every place of ``query`` in the pages' texts (``text``), without regard to case and runs of white space.

    With ``span_boxes`` a hit that goes over several items gets a box for each.
    """
    needle = " ".join(query.split()).lower()
    if not needle:
        return pages.select(*PAGE, F.lit(0).alias("start"), F.lit(0).alias("stop")).filter(F.lit(False))
    # letters whose lower case is longer stay as they are, so that positions hold
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    low = F.array_join(F.transform(chars, lambda c: F.when(F.length(F.lower(c)) == 1, F.lower(c)).otherwise(c)), "")
    quoted = re.sub(r"([^\w\s])", r"\\\1", needle)
    hits = pages.select(*PAGE, F.explode(regex_spans(low, quoted)).alias("s"))
    return hits.select(*PAGE, "s.start", "s.stop")


def span_boxes(spans: DataFrame, indexed: DataFrame, sizes: DataFrame) -> DataFrame:
    """``spans`` (``doc_id, page, start, stop`` in the page's text) with ``item_no`` and ``box``: a row for each item that a span covers.

    A box has shares of the page (``sizes``: ``page_width, page_height``): from the first to the last character, as wide as the item's mean, nine
    tenths of the size above the baseline and a quarter below, and a point around. Boxes without width are left out.
    """
    own = indexed.select(*PAGE, "item_no", F.length("text").alias("_n"), "x", "y", "width", "size", F.col("start").alias("_from"), (F.col("start") + F.size("chars")).alias("_to"), "chars")
    hit = spans.join(own, list(PAGE)).filter((F.col("start") < F.col("_to")) & (F.col("stop") > F.col("_from")))
    first = F.get("chars", F.greatest("start", "_from") - F.col("_from"))
    last = F.least(F.get("chars", F.least("stop", "_to") - F.col("_from") - 1) + 1, F.col("_n"))
    n = F.greatest(F.lit(1), F.col("_n"))
    hit = hit.withColumns({"_x0": F.col("x") + F.col("width") * first / n, "_x1": F.col("x") + F.col("width") * last / n}).filter("_x1 > _x0").join(sizes.select(*PAGE, "page_width", "page_height"), list(PAGE))
    box = F.struct(
        ((F.col("_x0") - 1) / F.col("page_width")).alias("x"), ((F.col("y") - F.col("size") * 0.9 - 1) / F.col("page_height")).alias("y"),
        ((F.col("_x1") - F.col("_x0") + 2) / F.col("page_width")).alias("width"), ((F.col("size") * 1.15 + 2) / F.col("page_height")).alias("height"),
    )
    return hit.select(*spans.columns, "item_no", box.alias("box"))


def reading_order_words(items: DataFrame, widths: DataFrame) -> DataFrame:
    """``doc_id, page, pos, word``: the words of each page, columns from left to right and lines from top to bottom.

    A page's items meet once, as an array; columns, lines and words are made from that.
    """
    page = _columns_of(items, widths)
    lines = F.when(F.col("_gutter").isNotNull(), F.concat("_left", "_right")).otherwise(lines_of(F.col("_used")))

    def words(line: Column) -> Column:
        def text(row: Column) -> Column:
            def with_gap(i: Column, k: Column) -> Column:
                after = F.get(row, k + 1)
                apart = (F.abs(after["y"] - i["y"]) > i["size"] * 0.5) | (after["x"] - (i["x"] + i["width"]) > i["size"] * 0.15)
                return F.concat(i["text"], F.when(F.coalesce(apart, F.lit(False)), F.lit(" ")).otherwise(F.lit("")))

            return F.array_join(F.transform(row, with_gap), "")

        by_x = F.transform(F.array_sort(F.transform(line, lambda i: F.struct(i["x"].alias("x"), i["item_no"].alias("item_no"), i.alias("i")))), lambda s: s["i"])
        return F.filter(F.split(let(by_x, text), f"[{SPACE}]+"), lambda w: w != "")

    return page.select(*PAGE, lines.alias("_lines")).select(*PAGE, F.posexplode(F.flatten(F.transform("_lines", words))).alias("pos", "word"))


def line_cells(lined: DataFrame) -> DataFrame:
    """``doc_id, page, row, cell, x0, x1, text``: a line cut wherever the gap is wider than a word space; ``row`` is the line's number."""
    w = Window.partitionBy(*PAGE, "line").orderBy("x", "item_no")
    gap = F.col("x") - F.max(F.col("x") + F.col("width")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = lined.withColumn("_gap", gap).withColumn("cell", F.sum(F.when(F.col("_gap") <= 0.9 * F.col("size"), 0).otherwise(1)).over(w).cast("int"))
    space = F.when((F.col("_gap") > 0.15 * F.col("size")) & (F.col("_gap") <= 0.9 * F.col("size")), " ").otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("x", "item_no", F.concat(space, "text").alias("t"))))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["t"]), ""), f"[{SPACE}]+", " "))
    cells = df.groupBy(*PAGE, F.col("line").alias("row"), "cell").agg(F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"), text.alias("text"))
    return cells.filter("text <> ''")


def column_bands(cells: DataFrame, tolerated: float = 0.1) -> DataFrame:
    """``doc_id, page, band, x0, x1``: ranges of x that more than a tenth of the rows of several cells ``doc_id, page, row, x0, x1`` cover."""
    keys = ["doc_id", "page"]
    rows = cells.groupBy(*keys, "row").agg(F.collect_list(F.struct(F.floor("x0").alias("start"), F.greatest(F.ceil("x1"), F.floor("x0") + 1).alias("stop"))).alias("_spans")).filter(F.size("_spans") >= 2)
    page = rows.groupBy(*keys).agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.floor(F.count("*") * tolerated).alias("_most"))
    bands = page.select(*keys, F.posexplode(covered_ranges(F.col("_spans"), F.col("_most"))).alias("band", "_b"))
    return bands.select(*keys, "band", F.col("_b.start").alias("x0"), F.col("_b.stop").alias("x1"))


def _cells_of(line: Column) -> Column:
    """The cells (``x0``, ``x1``, ``text``) of a line's items, as ``line_cells`` cuts them."""
    ordered = F.array_sort(F.transform(line, lambda i: F.struct(*[i[c].alias(c) for c in ("x", "item_no", "width", "size", "text")])))

    def with_gaps(items: Column) -> Column:
        reach = running(F.transform(items, lambda i: i["x"] + i["width"]), lambda u, v: F.greatest(u, v))
        return let(reach, lambda r: F.transform(items, lambda i, k: F.struct(i["x"].alias("x"), (i["x"] + i["width"]).alias("right"), i["size"].alias("size"), i["text"].alias("text"), (i["x"] - F.get(r, k - 1)).alias("gap"))))

    def cells(items: Column) -> Column:
        begins = F.filter(F.transform(items, lambda i, k: F.when(~F.coalesce(i["gap"] <= 0.9 * i["size"], F.lit(False)), k)), lambda k: k.isNotNull())
        return let(begins, lambda b: F.transform(F.transform(b, lambda at, k: F.slice(items, at + 1, F.coalesce(F.get(b, k + 1), F.size(items)) - at)), cell))

    def cell(part: Column) -> Column:
        space = lambda i: F.when((i["gap"] > 0.15 * i["size"]) & (i["gap"] <= 0.9 * i["size"]), " ").otherwise("")
        text = F.array_join(F.transform(part, lambda i: F.concat(space(i), i["text"])), "")
        return F.struct(F.array_min(F.transform(part, lambda i: i["x"])).alias("x0"), F.array_max(F.transform(part, lambda i: i["right"])).alias("x1"), F.trim(F.regexp_replace(text, f"[{SPACE}]+", " ")).alias("text"))

    return F.filter(let(let(ordered, with_gaps), cells), lambda c: c["text"] != "")


def _rows_of(pages: DataFrame) -> DataFrame:
    """``page_rows`` of pages with ``_lines``, arrays of ``line`` and its ``items``: all of it is made from that array, without another sort."""
    span = lambda c: F.struct(F.floor(c["x0"]).alias("start"), F.greatest(F.ceil(c["x1"]), F.floor(c["x0"]) + 1).alias("stop"))

    def with_bands(rows: Column) -> Column:
        several = F.filter(rows, lambda r: F.size(r["cells"]) >= 2)
        bands = let(several, lambda s: F.when(F.size(s) > 0, covered_ranges(F.flatten(F.transform(s, lambda r: F.transform(r["cells"], span))), F.floor(F.size(s) * 0.1))))
        return F.struct(rows.alias("rows"), bands.alias("bands"))

    def banded(x: Column) -> Column:
        band = lambda c: F.greatest(F.coalesce(F.size(F.filter(x["bands"], lambda b: c["x0"] >= b["start"] - 1)), F.lit(0)) - 1, F.lit(0)).alias("band")
        placed = F.transform(x["rows"], lambda r: F.struct(r["line"].alias("line"), F.transform(r["cells"], lambda c: F.struct(band(c), c["text"].alias("text"))).alias("cells")))
        own = lambda r: lambda b: F.struct(r["line"].alias("row"), b.alias("band"), F.array_join(F.transform(F.filter(r["cells"], lambda c: c["band"] == b), lambda c: c["text"]), " ").alias("text"))
        return F.flatten(F.transform(placed, lambda r: F.transform(F.array_distinct(F.transform(r["cells"], lambda c: c["band"])), own(r))))

    rows = F.transform("_lines", lambda r: F.struct(r["line"].cast("int").alias("line"), _cells_of(r["items"]).alias("cells")))
    out = pages.select(*PAGE, F.inline(let(let(rows, with_bands), banded)))
    return out.withColumn("number", cell_number(F.col("text")))


def page_rows(lined: DataFrame) -> DataFrame:
    """``doc_id, page, row, band, text, number``: the cells of a page in columns that hold over all its rows; ``number`` where a cell shows one.

    A cell belongs to the last band that begins no more than a point right of it; cells of a row in one band are joined by a space.
    """
    lines = lined.groupBy(*PAGE, "line").agg(F.collect_list(F.struct("x", "item_no", "width", "size", "text")).alias("items"))
    return _rows_of(lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line", "items"))).alias("_lines")))


def table_rows(items: DataFrame) -> DataFrame:
    """``page_rows`` of items that have no lines yet: a page's items meet once, as an array, and only its rows come out of it."""
    pages = line_pages(items, fields=["width", "text"])
    return _rows_of(pages.select(*PAGE, F.transform("_lines", lambda items, k: F.struct((k + 1).alias("line"), items.alias("items"))).alias("_lines")))


def merge_phrases(runs: DataFrame) -> DataFrame:
    """``doc_id, page, phrase, text, x, y, width, size, bold``: runs on one line, in one size and close together as one."""
    lined = group_lines(runs)
    w = Window.partitionBy(*PAGE).orderBy("line", "x", "item_no")
    gap, size = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w), F.col("size")
    same = (F.lag("line").over(w) == F.col("line")) & (F.abs(F.lag("y").over(w) - F.col("y")) < size * 0.3) & (F.abs(F.lag("size").over(w) - size) < size * 0.15) & (gap > -0.3 * size) & (gap < 0.9 * size)
    space = F.coalesce((gap > 0.15 * size) & ~F.lag("text").over(w).endswith(" ") & ~F.col("text").startswith(" "), F.lit(False))
    df = lined.withColumns({"_same": F.coalesce(same, F.lit(False)), "_space": space})
    df = df.withColumn("phrase", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(w).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("line", "x", "item_no", F.concat(F.when(F.col("_same") & F.col("_space"), " ").otherwise(""), "text").alias("t"))))
    out = df.groupBy(*PAGE, "phrase").agg(
        F.trim(F.array_join(F.transform(parts, lambda p: p["t"]), "")).alias("text"), F.min("x").alias("x"), F.min_by("y", F.struct("line", "x")).alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), F.min_by("size", F.struct("line", "x")).alias("size"), F.bool_and(F.coalesce("bold", F.lit(False))).alias("bold"),
    )
    return out.filter("text <> ''")


def translate_blocks(lines: DataFrame) -> DataFrame:
    """``doc_id, page, block, text, x, y, right, size, bold, lines`` of lines ``doc_id, page, line, text, x, right, y, size, bold``.

    A line goes on with the lowest open block of its size, weight and column whose last line is one line's pitch above it and did not
    end the paragraph by being short. Blocks stay open to the end of the page, so a page is folded in order over its open blocks.
    """
    page = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line", "x", "right", "y", "size", "bold", "text"))).alias("_lines"))
    line = "struct<line:int,x:double,right:double,y:double,size:double,bold:boolean,text:string>"
    none = F.array().cast(f"array<struct<l:double,r:double,lines:array<{line}>>>")

    def goes_on(block: Column, new: Column) -> Column:
        last = F.element_at(block["lines"], -1)
        size, pitch = F.greatest(last["size"], new["size"]), new["y"] - last["y"]
        shared = F.least(last["right"], new["right"]) - F.greatest(last["x"], new["x"])
        short = last["right"] < block["r"] - F.greatest(0.2 * (block["r"] - block["l"]), 3 * size)
        alike = (F.abs(last["size"] - new["size"]) <= 0.15 * size) & (last["bold"] == new["bold"]) & pitch.between(0.9 * size, 1.9 * size)
        return alike & (shared >= 0.3 * F.least(last["right"] - last["x"], new["right"] - new["x"])) & ~(short & (F.abs(new["x"] - block["l"]) < size))

    def step(acc: Column, new: Column) -> Column:
        fits = F.transform(acc, lambda b, i: F.when(goes_on(b, new), F.struct(F.element_at(b["lines"], -1)["y"].alias("y"), (-i).alias("at"))))
        best = -F.array_max(fits)["at"]
        grown = F.transform(acc, lambda b, i: F.when(i == best, F.struct(F.least(b["l"], new["x"]).alias("l"), F.greatest(b["r"], new["right"]).alias("r"), F.concat(b["lines"], F.array(new)).alias("lines"))).otherwise(b))
        fresh = F.array(F.struct(new["x"].alias("l"), new["right"].alias("r"), F.array(new).alias("lines")))
        return F.when(best.isNull(), F.concat(acc, fresh)).otherwise(grown)

    rows = F.transform("_lines", lambda i: F.struct(i["line"].cast("int").alias("line"), *[i[c].cast("double").alias(c) for c in ("x", "right", "y", "size")], F.coalesce(i["bold"], F.lit(False)).alias("bold"), i["text"].alias("text")))
    blocks = page.select(*PAGE, F.posexplode(F.aggregate(rows, none, step)).alias("block", "_b"))
    first = F.get("_b.lines", F.lit(0))
    return blocks.select(*PAGE, "block", join_lines(F.col("_b.lines.text")).alias("text"), F.col("_b.l").alias("x"), first["y"].alias("y"), F.col("_b.r").alias("right"), first["size"].alias("size"), first["bold"].alias("bold"), F.size("_b.lines").alias("lines"))
