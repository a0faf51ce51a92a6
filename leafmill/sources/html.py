"""HTML as rows: one for each block, link and picture, in order."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = "kind string, level int, text string, target string, place int, span int"
_HEADINGS = {f"h{k}": k for k in range(1, 7)}
#: Elements whose text is a block of its own kind; those that only part blocks.
_KINDS = {**dict.fromkeys(_HEADINGS, "heading"), "li": "item", "blockquote": "quote", "pre": "code", "td": "cell", "th": "cell"}
_BREAKING = set("p div article section main header footer nav aside ul ol menu table thead tbody tfoot tr caption body html form fieldset figure figcaption details summary address dl dt dd hr br option select".split())
#: So many rows, and those of one more page, are held in Python at a time.
HELD = 4096
_SILENT = {"script", "style", "template", "noscript", "head", "svg"}
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_IN_HEAD = set("base basefont bgsound link meta noscript script style template title".split())
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

# Fixed values of HTML: which open elements a start tag ends, and what they are looked for in.
_CELLS, _ROWS, _GROUPS = ("td", "th"), ("tr", "td", "th"), ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")
_TABLE, _BOX = frozenset({"table", "template"}), frozenset({"table", "template", "td", "th", "caption", "button", "object"})
_ENDS = {
    "li": (("li",), _BOX | {"ul", "ol", "menu"}), "dt": (("dt", "dd"), _BOX | {"dl"}), "dd": (("dt", "dd"), _BOX | {"dl"}),
    "option": (("option",), _BOX | {"select", "datalist"}), "optgroup": (("option", "optgroup"), _BOX | {"select", "datalist"}),
    "td": (_CELLS, _TABLE), "th": (_CELLS, _TABLE), "tr": (_ROWS, _TABLE), "thead": (_GROUPS, _TABLE), "tbody": (_GROUPS, _TABLE), "tfoot": (_GROUPS, _TABLE),
    "a": (("a",), _BOX), "body": (("head",), frozenset()),
}
#: Start tags that end a paragraph.
_AFTER_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li dt dd main menu nav ol p pre section table ul".split())
#: An end tag does not reach over these, unless it is one of them or of a part of a table.
_WALLS = {"table", "td", "th", "caption", "template"}
_PARTS = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}


def _hidden(attrs: dict) -> bool:
    return "hidden" in attrs or bool(_HIDING.search(attrs.get("style") or ""))


def _span(attrs: dict) -> int:
    """A cell's columns: 1 to 1,000, as HTML has it."""
    given = re.match(r"\s*(\d+)", attrs.get("colspan") or "")
    return min(1000, max(1, int(given[1][:9]))) if given else 1


class _Blocks(HTMLParser):
    """Collects ``(kind, level, text, target, place, span)``; text is what a reader sees, with single spaces.

    ``open`` is the stack of open elements, as ``(tag, muted, what it knows, kind and facts of its text)``, ``count`` how many of each tag
    it holds. An element ends by its end tag, with one around it, or by a start tag that HTML does not let it hold.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.open: list[tuple[str, bool, dict, tuple[str, dict]]] = []
        self.count: Counter = Counter()
        self.links: list[dict] = []
        self.text: list[str] = []
        self.muted = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            kind, own = self.open[-1][3] if self.open else ("paragraph", {})
            self.rows.append((kind, own.get("level", 0), text, None, own.get("place"), own.get("span")))

    def pop(self) -> None:
        tag, muted, own, _ = self.open[-1]
        if "target" in own:
            self.links.remove(own)
            self.rows.append(("link", 0, " ".join("".join(own["text"]).split()), own["target"], None, None))
        elif tag in _KINDS or tag in _BREAKING:
            self.flush()
        self.open.pop()
        self.count[tag] -= 1
        self.muted -= muted

    def end(self, tags: tuple[str, ...], walls: frozenset | set) -> None:
        """Ends the elements down to the outermost of ``tags`` that no wall hides."""
        if not any(self.count[t] for t in tags):
            return
        at = None
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k][0]
            at = k if tag in tags else at
            if tag in walls and tag not in tags:
                break
        while at is not None and len(self.open) > at:
            self.pop()

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if self.open and self.open[-1][0] == "head" and tag not in _IN_HEAD:
            self.pop()  # what the head can't hold ends it
        if tag in _AFTER_P:
            self.end(("p",), _BOX)
        if tag in _ENDS:
            self.end(*_ENDS[tag])
        if tag in _HEADINGS and self.open and self.open[-1][0] in _HEADINGS:
            self.pop()
        if tag in _KINDS or tag in _BREAKING:
            self.flush()
        hidden = _hidden(attrs)
        own: dict = {}
        if tag in _HEADINGS:
            own["level"] = _HEADINGS[tag]
        elif tag == "li":
            own["level"] = 1 + self.count["li"]
        elif tag == "table":
            own["row"] = own["column"] = 0
        elif tag in _ROWS:
            table = next((x[2] for x in reversed(self.open) if x[0] == "table"), {}) if self.count["table"] else {}
            if tag == "tr" or not table.get("row"):
                table["row"], table["column"] = table.get("row", 0) + 1, 0
            if tag != "tr":
                own |= {"level": table["row"], "place": table["column"] + 1, "span": _span(attrs)}
                table["column"] += own["span"]
        elif tag == "img" and not self.muted and not hidden:
            source = attrs.get("src") or ""
            self.rows.append(("picture", int(source.startswith("data:")), attrs.get("alt"), source, None, None))
        elif tag == "a" and "href" in attrs and not self.muted and not hidden:
            own |= {"target": attrs["href"] or "", "text": []}
            self.links.append(own)
        if tag not in _VOID:
            around = self.open[-1][3] if self.open else ("paragraph", {})
            kind = (_KINDS[tag], own) if tag in _KINDS else ("paragraph", {}) if tag == "table" else around
            self.open.append((tag, hidden or tag in _SILENT, own, kind))
            self.count[tag] += 1
            self.muted += self.open[-1][1]

    def handle_endtag(self, tag):
        if tag in _HEADINGS:
            self.end(tuple(_HEADINGS), _BOX)
        elif tag == "br" or tag == "p" and not self.count["p"]:
            self.flush()
        elif tag not in ("body", "html") and self.count[tag]:  # after the body's end there may still be text
            at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag or (self.open[k][0] in _WALLS and tag not in _PARTS) or (self.open[k][0] == "table" and tag != "table")), None)
            if at is not None and self.open[at][0] == tag:
                while len(self.open) > at:
                    self.pop()

    def handle_startendtag(self, tag, attrs):
        """``<x/>`` is a start tag, but in a drawing."""
        if not self.count["svg"]:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.pop()
        if not self.muted:
            self.text.append(data)
            for own in self.links:
                own["text"].append(data)

    def parse_marked_section(self, i, report=1):
        """``<![…`` in a page is a comment up to the next ``>``."""
        at = self.rawdata.find(">", i)
        return at + 1 if at >= 0 else -1


def rows_of(page: str | None) -> list[tuple]:
    """The rows of one page; of one that the parser gives up, those up to there."""
    parser = _Blocks()
    try:
        parser.feed(page or "")
        parser.close()
    except (AssertionError, ValueError, RecursionError):
        pass
    parser.flush()
    while parser.open:
        parser.pop()
    return parser.rows


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, seq, kind, level, text, target, place, span`` of each page. Kinds: heading, paragraph, item, quote, code, cell, link, picture.
    ``level``: of a heading or list, a cell's row in its table from 1, 1 for a picture stored in the page. ``place``, ``span``: a cell's first
    column from 1, counted with the spans of the cells before it in its row, and its number of columns.

    Elements whose end tags are left out end where HTML says. What scripts, styles and the head hold is left out, and so are elements
    that are hidden by attribute or style. A null or empty page has no rows; a page that can't be read to its end has those before.
    Each page is parsed by itself, so nothing is shuffled.
    """

    def packed(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        keys = ids.take(pa.array([r[0] for r in out], pa.int64()))
        columns = [pa.array([r[j] for r in out], kind) for j, kind in ((1, pa.int32()), (2, pa.string()), (3, pa.int32()), (4, pa.string()), (5, pa.string()), (6, pa.int32()), (7, pa.int32()))]
        return pa.RecordBatch.from_arrays([keys, *columns], names=[key, "seq", "kind", "level", "text", "target", "place", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, page in enumerate(batch.column(1)):
                out += [(k, n, *row) for n, row in enumerate(rows_of(page.as_py()))]
                if len(out) >= HELD:
                    yield packed(batch.column(0), out)
                    out = []
            yield packed(batch.column(0), out)

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, seq int, {BLOCKS}")
