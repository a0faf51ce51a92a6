"""Page algebra on ``conversations``: a conversation is a document, a turn a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import ranges
from leafmill.operators import pages as ops
from leafmill.sources.tables import read_table

SPEC, GONE = "1-2, 2-", "1, last 2"


def _pages(spark, sf_dir):
    df = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return df.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.length("text").cast("long").alias("n"))


def _names(spark, sf_dir):
    """Names as files would have them: many equal ones, some that already carry a number."""
    df = read_table(spark, sf_dir, "documents", "doc_id", "source", "lang")
    name = F.when(F.col("doc_id") % 10 == 3, F.concat("source", F.lit(" (2).txt"))).otherwise(F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")), F.lit(".txt")))
    return df.select(F.col("doc_id").alias("tab_order"), name.alias("name"))


def merge(spark, sf_dir):
    return ops.merge_docs(_pages(spark, sf_dir))


def extract(spark, sf_dir):
    return ops.extract_groups(_pages(spark, sf_dir), F.lit(SPEC))


def split_every(spark, sf_dir):
    return ops.split_every(_pages(spark, sf_dir), 3)


def delete(spark, sf_dir):
    return ops.delete_pages(_pages(spark, sf_dir), F.lit(GONE))


def rearrange(spark, sf_dir):
    """Every document backwards without its first page; in a third of them the list asks for a page that is not there."""
    pages = _pages(spark, sf_dir).withColumn("rotation", F.lit(270))
    edits = pages.join(ops.page_counts(pages), "doc").filter("page > 0 or doc % 3 = 0")
    edits = edits.select("doc", F.when((F.col("doc") % 3 == 0) & (F.col("page") == 0), F.col("pages")).otherwise(F.col("page")).alias("page"), (F.col("pages") - 1 - F.col("page")).alias("at"), F.lit(180).alias("turn"))
    return ops.rearrange_pages(pages, edits)


def insert(spark, sf_dir):
    return ops.insert_blanks(_pages(spark, sf_dir), 2, 3)


def rotate(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("rotation", (F.col("page") % 4 * 90).cast("int"))
    return ops.rotate_pages(pages, F.col("page") % 2 == 0, 270)


def number(spark, sf_dir):
    return ops.number_pages(_pages(spark, sf_dir), "page {n} of {total}", 1, F.col("page") > 0)


def bates(spark, sf_dir):
    return ops.bates_number(_pages(spark, sf_dir), prefix="LM-", digits=3)


def bates_ends(spark, sf_dir):
    """First and last number of each document."""
    return bates(spark, sf_dir).groupBy("doc").agg(F.min_by("bates", "page").alias("first"), F.max_by("bates", "page").alias("last"))


def formatted(spark, sf_dir):
    """Turns of users as page lists."""
    df = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role").filter("role = 'user'")
    lists = df.groupBy(F.col("conv_id").alias("doc")).agg(F.array_sort(F.collect_list("turn")).alias("p"))
    return lists.select("doc", ranges.format_page_ranges(F.col("p")).alias("pages"))


def header(spark, sf_dir):
    pages = _pages(spark, sf_dir).join(ops.page_counts(_pages(spark, sf_dir)), "doc")
    values = {"page": F.col("page") + 1, "pages": F.col("pages"), "file": F.col("doc"), "date": F.lit("2026-01-02")}
    return pages.select("doc", "page", ranges.fill_template(F.lit("{file}: {page}/{pages} ({date})"), values).alias("header"))


def spec_errors(spark, sf_dir):
    """What is wrong with a page list that depends on the document."""
    spec = F.element_at(F.array(F.lit("2-"), F.lit("x"), F.lit("9-3"), F.lit(" ; "), F.lit("1-99")), (F.col("doc") % 5 + 1).cast("int"))
    counts = ops.page_counts(_pages(spark, sf_dir))
    return counts.select("doc", ranges.parse_page_ranges(spec, F.col("pages"))["error"].alias("error"))


def unique_names(spark, sf_dir):
    return ops.unique_names(_names(spark, sf_dir))


def merge_order(spark, sf_dir):
    """Documents merged by a tab order that is not that of their ids."""
    pages = _pages(spark, sf_dir).withColumn("tab", -F.col("doc"))
    return ops.merge_docs(pages, "tab").drop("tab")


QUERIES = {
    "pages_merge": merge,
    "pages_merge_by_tab": merge_order,
    "pages_extract": extract,
    "pages_split_every": split_every,
    "pages_delete": delete,
    "pages_rearrange": rearrange,
    "pages_insert": insert,
    "pages_rotate": rotate,
    "pages_number": number,
    "pages_bates": bates,
    "pages_bates_ends": bates_ends,
    "pages_format_ranges": formatted,
    "pages_header": header,
    "pages_spec_errors": spec_errors,
    "files_unique_names": unique_names,
}

_P = "p AS (SELECT conv_id AS doc, turn AS page, length(text)::BIGINT AS n FROM conversations), c AS (SELECT doc, count(*) AS pages FROM p GROUP BY doc)"
_AT = "a AS (SELECT doc, coalesce(sum(pages) OVER (ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM c)"
_BATES = f"WITH {_P}, {_AT.format('doc')}, b AS (SELECT p.doc, page, n, 'LM-' || CASE WHEN off + page + 1 > 999 THEN (off + page + 1)::VARCHAR ELSE lpad((off + page + 1)::VARCHAR, 3, '0') END AS bates FROM p JOIN a ON a.doc = p.doc)"
SQL = {
    "pages_merge": f"WITH {_P}, {_AT.format('doc')} SELECT p.doc, page, n, off + page AS merged FROM p JOIN a ON a.doc = p.doc",
    "pages_merge_by_tab": f"WITH {_P}, {_AT.format('-doc')} SELECT p.doc, page, n, off + page AS merged FROM p JOIN a ON a.doc = p.doc",
    "pages_extract": f"WITH {_P}, g AS (SELECT p.*, pages FROM p JOIN c ON c.doc = p.doc WHERE pages >= 2) SELECT doc, page, n, 0 AS part, page::INT AS at FROM g WHERE page < 2 UNION ALL SELECT doc, page, n, 1, (page - 1)::INT FROM g WHERE page >= 1",
    "pages_split_every": f"WITH {_P} SELECT doc, page, n, page // 3 AS part, page % 3 AS at FROM p",
    "pages_delete": f"WITH {_P} SELECT p.doc, page, n, CASE WHEN pages <= 3 THEN page ELSE page - 1 END AS at FROM p JOIN c ON c.doc = p.doc WHERE pages <= 3 OR (page > 0 AND page < pages - 2)",
    "pages_rearrange": f"WITH {_P} SELECT p.doc, page, n, CASE WHEN p.doc % 3 = 0 OR pages = 1 THEN 270 ELSE 90 END AS rotation, CASE WHEN p.doc % 3 = 0 OR pages = 1 THEN page ELSE pages - 1 - page END AS at FROM p JOIN c ON c.doc = p.doc WHERE p.doc % 3 = 0 OR pages = 1 OR page > 0",
    "pages_insert": f"WITH {_P} SELECT p.doc, page, n, CASE WHEN page >= 3 THEN page + 2 ELSE page END AS at FROM p UNION ALL SELECT doc, k, NULL, least(3, pages) + k FROM c, range(2) t(k)",
    "pages_rotate": f"WITH {_P} SELECT doc, page, n, CASE WHEN page % 2 = 0 THEN (page % 4 * 90 + 270) % 360 ELSE page % 4 * 90 END::INT AS rotation FROM p",
    "pages_number": f"WITH {_P} SELECT p.doc, page, n, CASE WHEN page > 0 THEN 'page ' || page || ' of ' || (pages - 1) END AS label FROM p JOIN c ON c.doc = p.doc",
    "pages_bates": f"{_BATES} SELECT * FROM b",
    "pages_bates_ends": f"{_BATES} SELECT doc, arg_min(bates, page) AS first, arg_max(bates, page) AS last FROM b GROUP BY doc",
    "pages_format_ranges": """WITH u AS (SELECT conv_id AS doc, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations WHERE role = 'user'),
r AS (SELECT doc, min(turn) AS a, max(turn) AS b FROM u GROUP BY doc, g)
SELECT doc, string_agg(CASE WHEN a = b THEN (a + 1)::VARCHAR ELSE (a + 1) || '-' || (b + 1) END, ', ' ORDER BY a) AS pages FROM r GROUP BY doc""",
    "pages_header": f"WITH {_P} SELECT p.doc, page, p.doc || ': ' || (page + 1) || '/' || pages || ' (2026-01-02)' AS header FROM p JOIN c ON c.doc = p.doc",
    "pages_spec_errors": f"WITH {_P} SELECT doc, CASE doc % 5 WHEN 0 THEN CASE WHEN pages < 2 THEN 'missing' END WHEN 1 THEN 'invalid' WHEN 2 THEN CASE WHEN pages < 9 THEN 'missing' ELSE 'backwards' END WHEN 3 THEN 'empty' ELSE CASE WHEN pages < 99 THEN 'missing' END END AS error FROM c",
    "files_unique_names": """WITH f AS (SELECT doc_id AS tab_order, CASE WHEN doc_id % 10 = 3 THEN source || ' (2).txt' ELSE CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || '.txt' END AS name FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY tab_order) AS k, lower(replace(name, ' (2)', '')) AS own FROM f),
t AS (SELECT own, min(tab_order) AS first FROM k WHERE contains(name, ' (2)') GROUP BY own),
s AS (SELECT own, min(tab_order) AS second FROM k WHERE k = 2 AND NOT contains(name, ' (2)') GROUP BY own)
-- " (2)" goes to the file that has it as its own name if that comes before the second file of the name without it
SELECT tab_order, name, CASE WHEN contains(name, ' (2)') THEN CASE WHEN k = 1 AND (second IS NULL OR first < second) THEN name ELSE replace(name, '.txt', ' (' || (k + CASE WHEN first < coalesce(second, first + 1) THEN 0 ELSE 1 END) || ').txt') END
            WHEN k = 1 THEN name ELSE replace(name, '.txt', ' (' || (k + CASE WHEN first < second THEN 1 ELSE 0 END) || ').txt') END AS "unique" FROM k LEFT JOIN t USING (own) LEFT JOIN s USING (own)""",
}
