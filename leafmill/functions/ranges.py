"""Page lists as people type them. Pages count from 0 in results, from 1 in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One page or range; "from the end"; separators.
PART = r"(?i)^(\d*)\s*(?:(-|–|to)\s*(\d*))?$"
FROM_END = r"(?i)^(?:-|last\s*)(\d+)$"
SEPARATORS = "[,;]"
_LONGS = "array<bigint>"


def _parts(spec: Column) -> Column:
    return F.filter(F.transform(F.split(spec, SEPARATORS), lambda p: F.trim(p)), lambda p: p != "")


def _number(text: Column) -> Column:
    """The number in a text of digits: null for none, and the largest there is for one that is larger."""
    return F.when(text != "", F.coalesce(text.try_cast("bigint"), F.lit((1 << 63) - 1)))


def parse_page_ranges(spec: Column, pages: Column) -> Column:
    """``groups`` (an array of pages for each part) and ``error``, null if all parts are good.

    Errors: ``empty``, ``invalid``, ``missing`` (no such page), ``backwards``; that of the first bad part counts.
    """

    def read(part: Column) -> Column:
        a, dash, b = (F.regexp_extract(part, PART, k) for k in (1, 2, 3))
        good = part.rlike(PART) & ((a != "") | (b != ""))
        low = F.coalesce(_number(a), F.lit(1).cast("bigint"))
        high = F.when(dash == "", low).otherwise(F.coalesce(_number(b), pages.cast("bigint")))
        missing = (low < 1) | (low > pages) | (high < 1) | (high > pages)
        error = F.when(~good, "invalid").when(missing, "missing").when(low > high, "backwards")
        return F.struct(error.alias("error"), F.when(error.isNull(), F.sequence(low - 1, high - 1)).alias("group"))

    read_parts = F.transform(_parts(spec), read)
    bad = F.get(F.filter(read_parts, lambda x: x["error"].isNotNull()), F.lit(0))["error"]
    error = F.when(F.size(read_parts) == 0, "empty").otherwise(bad)
    return F.struct(F.when(error.isNull(), F.transform(read_parts, lambda x: x["group"])).alias("groups"), error.alias("error"))


def format_page_ranges(pages: Column) -> Column:
    """Page numbers of sorted pages as text: runs become ranges, ``1-3, 5``."""
    start = F.struct(F.array().cast("array<struct<a:bigint,b:bigint>>").alias("runs"))

    def step(acc: Column, p: Column) -> Column:
        last = F.get(acc["runs"], F.size(acc["runs"]) - 1)
        p = p.cast("bigint")
        one = F.array(F.struct(p.alias("a"), p.alias("b")))
        longer = F.concat(F.slice(acc["runs"], 1, F.size(acc["runs"]) - 1), F.array(F.struct(last["a"].alias("a"), p.alias("b"))))
        return F.struct(F.when((F.size(acc["runs"]) > 0) & (last["b"] + 1 == p), longer).otherwise(F.concat(acc["runs"], one)).alias("runs"))

    runs = F.aggregate(pages, start, step, lambda acc: acc["runs"])
    shown = F.transform(runs, lambda r: F.when(r["a"] == r["b"], (r["a"] + 1).cast("string")).otherwise(F.concat((r["a"] + 1).cast("string"), F.lit("-"), (r["b"] + 1).cast("string"))))
    return F.array_join(shown, ", ")


def pages_to_delete(spec: Column, pages: Column) -> Column:
    """The sorted pages that a list names, without those that the file does not have; null where a part is no page or range."""

    def read(part: Column) -> Column:
        end = F.when(F.lower(part) == "last", F.lit(1).cast("bigint")).otherwise(_number(F.regexp_extract(part, FROM_END, 1)))
        a, dash, b = (F.regexp_extract(part, PART, k) for k in (1, 2, 3))
        low, high = _number(a), F.when(F.regexp_extract(part, PART, 2) == "", _number(a)).otherwise(_number(b))
        to = F.least(F.coalesce(high, pages), pages).cast("bigint")
        bad = F.when(end.isNotNull(), end < 1).otherwise(~part.rlike(PART) | low.isNull() | (low < 1) | F.coalesce(high < low, F.lit(False)))
        first = F.when(end.isNotNull(), F.greatest(F.lit(0), pages - end)).otherwise(low - 1).cast("bigint")
        last = F.when(end.isNotNull(), pages).otherwise(to).cast("bigint")
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(None).cast(_LONGS)).when(first >= last, F.array().cast(_LONGS)).otherwise(F.sequence(first, last - 1))

    read_parts = F.transform(_parts(spec), read)
    return F.when(F.exists(read_parts, lambda x: x.isNull()), F.lit(None)).otherwise(F.array_sort(F.array_distinct(F.flatten(read_parts))))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """``template`` with each ``{name}`` replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def padded(number: Column, digits: int) -> Column:
    """The number's text, zeros before it up to ``digits``; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def bates_label(number: Column, prefix: str = "", suffix: str = "", digits: int = 6) -> Column:
    return F.concat(F.lit(prefix), padded(number, digits), F.lit(suffix))
