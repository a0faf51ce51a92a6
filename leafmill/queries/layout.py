"""Layout, recipes and readers, on data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import layout
from leafmill.plans import recipe
from leafmill.sources.tables import read_table


def _items(spark, sf_dir):
    """Turns as pages of words set in lines of eight, with a running head, a page number, and every fifth line indented further down.

    Turns are dealt by page as texts, so the words made from them are where their page's other words are and are not dealt again.
    """
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text").repartition("doc_id", "page")

    def item(no, text, x, y, width, size):
        return F.struct(no.cast("int").alias("item_no"), text.alias("text"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(width).alias("width"), size.alias("size"), F.lit(False).alias("bold"))

    def word(w, k):
        row, col = F.floor(k / 8), k % 8
        return item(k, w, 72 + col * 60, 100 + row * 14 + F.floor(row / 5) * 20, 50.0, F.when(row == 0, 16.0).otherwise(10.0))

    margin = F.array(item(F.lit(-2), F.lit("Report 2026"), F.lit(72.0), F.lit(20.0), 50.0, F.lit(8.0)), item(F.lit(-1), F.concat(F.lit("page "), F.col("page") + 1), F.lit(72.0), F.lit(9980.0), 50.0, F.lit(8.0)))
    words = F.coalesce(F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), word), F.slice(margin, 1, 0))
    return turns.select("doc_id", "page", F.inline(F.concat(margin, words)))


def _pages(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations", "conv_id", "turn").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit(10000.0).alias("height"))


def _lines(spark, sf_dir):
    return layout.page_lines(_items(spark, sf_dir))


def lines(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("lines"))


def body_lines(spark, sf_dir):
    kept = layout.remove_running_lines(_lines(spark, sf_dir), _pages(spark, sf_dir))
    return kept.groupBy("doc_id", "page").agg(F.count("*").alias("lines"))


def _paragraphs(spark, sf_dir):
    kept = layout.remove_running_lines(_lines(spark, sf_dir), _pages(spark, sf_dir))
    return layout.paragraph_text(layout.group_paragraphs(kept))


def paragraphs(spark, sf_dir):
    """Every word of a page is in one of its paragraphs."""
    p = _paragraphs(spark, sf_dir)
    return p.groupBy("doc_id", "page").agg(F.sum(F.length(F.regexp_replace("text", r"[\s-]", ""))).alias("letters"), (F.count("*") > 0).alias("any"))


def rects(spark, sf_dir):
    """What stands under a rectangle over the second word of each page's first line."""
    r = _pages(spark, sf_dir).select("doc_id", "page", F.lit(1).alias("rect"), F.lit(130.0).alias("x1"), F.lit(90.0).alias("y1"), F.lit(184.0).alias("x2"), F.lit(105.0).alias("y2"))
    return layout.text_in_rect(_items(spark, sf_dir), r).select("doc_id", "page", "text")


def _files(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    return d.select(F.col("doc_id").alias("tab_order"), F.concat("source", F.lit(".txt")).alias("name"), F.when(F.col("lang") == "fr", "image").otherwise("text").alias("kind"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text")).alias("text"))


def recipe_outputs(spark, sf_dir):
    return recipe.run_recipe(_files(spark, sf_dir), recipe.PRESETS["numbered bundle"]).outputs.select("tab_order", F.substring_index("text", " ", 1).alias("label"))


def recipe_failures(spark, sf_dir):
    return recipe.run_recipe(_files(spark, sf_dir), recipe.PRESETS["share safely"]).failures.groupBy("step", "message").agg(F.count("*").alias("n"))


def recipe_untouched(spark, sf_dir):
    return recipe.run_recipe(_files(spark, sf_dir), recipe.PRESETS["share safely"]).untouched.agg(F.count("*").alias("n"))


def recipe_plan(spark, sf_dir):
    p = recipe.plan_files(_files(spark, sf_dir), recipe.PRESETS["share safely"])
    return p.groupBy("kind", F.array_join("touches", ",").alias("touches"), "kind_after").agg(F.count("*").alias("n"))


def recipe_sealed(spark, sf_dir):
    """Texts with their seals, and what the plan said of them."""
    steps = recipe.PRESETS["sealed originals"]
    files = _files(spark, sf_dir).withColumn("text", F.regexp_replace("text", "@", " at "))
    out = recipe.run_recipe(files, [s for s in steps if s.name != "redact"]).outputs
    return out.select("tab_order", F.regexp_extract("text", "\\nsha256:([0-9a-f]{64})$", 1).alias("seal"))


QUERIES = {"recipe_sealed": recipe_sealed, "layout_lines": lines, "layout_body_lines": body_lines, "layout_paragraphs": paragraphs, "layout_rects": rects, "recipe_outputs": recipe_outputs, "recipe_failures": recipe_failures, "recipe_untouched": recipe_untouched, "recipe_plan": recipe_plan}
_WORDS = r"w AS (SELECT conv_id AS doc_id, turn AS page, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations)"
_TEXTS = "f AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'fr')"
SQL = {
    "layout_lines": f"WITH {_WORDS} SELECT doc_id, page, (2 + (len(w) + 7) // 8)::BIGINT AS lines FROM w",
    "layout_body_lines": f"WITH {_WORDS}, c AS (SELECT doc_id, count(*) AS pages FROM w GROUP BY doc_id) SELECT w.doc_id, page, ((len(w) + 7) // 8 + CASE WHEN pages < 3 THEN 1 ELSE 0 END)::BIGINT AS lines FROM w JOIN c ON c.doc_id = w.doc_id WHERE len(w) > 0 OR pages < 3",
    "layout_paragraphs": f"WITH {_WORDS}, c AS (SELECT doc_id, count(*) AS pages FROM w GROUP BY doc_id) SELECT w.doc_id, page, (length(replace(array_to_string(w, ''), '-', '')) + CASE WHEN pages < 3 THEN 10 ELSE 0 END)::BIGINT AS letters, true AS any FROM w JOIN c ON c.doc_id = w.doc_id WHERE len(w) > 0 OR pages < 3",
    "layout_rects": f"WITH {_WORDS} SELECT doc_id, page, w[2] AS text FROM w WHERE len(w) > 1",
    "recipe_sealed": r"SELECT doc_id AS tab_order, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN doc_id % 9 = 0 THEN '' ELSE replace(text, '@', ' at ') END, '[\x00-\x08\x0e-\x1f]', '', 'g'), '[ \t]+', ' ', 'g'), '^ +', ''), ' +$', '')) AS seal FROM documents WHERE lang <> 'fr' AND NOT (doc_id % 9 <> 0 AND text IS NULL)",
    "recipe_outputs": f"WITH {_TEXTS}, t AS (SELECT doc_id AS tab_order, (row_number() OVER (ORDER BY doc_id NULLS FIRST))::VARCHAR AS n FROM f WHERE length(text) > 0) SELECT tab_order, 'LM-' || lpad(n, greatest(6, length(n))::INTEGER, '0') AS label FROM t",
    "recipe_failures": f"WITH {_TEXTS} SELECT 'check' AS step, 'fewer than 1 characters' AS message, count(*) AS n FROM f WHERE coalesce(length(text), 0) < 1 HAVING count(*) > 0",
    "recipe_untouched": "SELECT count(*) AS n FROM documents WHERE lang = 'fr'",
    "recipe_plan": "SELECT CASE WHEN lang = 'fr' THEN 'image' ELSE 'text' END AS kind, CASE WHEN lang = 'fr' THEN '' ELSE 'check,redact' END AS touches, CASE WHEN lang = 'fr' THEN 'image' ELSE 'text' END AS kind_after, count(*) AS n FROM documents GROUP BY ALL",
}
