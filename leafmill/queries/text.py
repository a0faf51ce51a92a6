"""Text and number functions over ``documents`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as fn
from leafmill.sources.tables import read_table


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


def counts(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", fn.count_words(t).cast("long").alias("words"), fn.has_words(t).alias("has_words"))


def lines(spark, sf_dir):
    out = fn.join_lines(F.split("text", "\n"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(out, 256).alias("sha"))


def markdown(spark, sf_dir):
    out = fn.escape_markdown(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(out).cast("long").alias("n"), F.sha2(out, 256).alias("sha"))


def chunks(spark, sf_dir):
    """Every chunk is short enough, and together they are the text but for spaces."""
    c = _docs(spark, sf_dir).select("doc_id", "text", fn.sentence_chunks(F.col("text")).alias("c"))
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    return c.select("doc_id", F.exists("c", lambda x: F.length(x) > 1000).alias("too_long"), (bare(F.array_join("c", "")) == bare(F.col("text"))).alias("whole"))


def cells(spark, sf_dir):
    price = F.format_number("l_extendedprice", 2)
    shown = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("("), price, F.lit(")"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("$ "), price)).otherwise(F.lit("007"))
    return read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice").select("l_orderkey", "l_linenumber", F.round(fn.cell_number(shown), 2).alias("value"))


def clocks(spark, sf_dir):
    seconds = fn.parse_clock(fn.format_clock(F.col("l_orderkey") % 9000))
    return read_table(spark, sf_dir, "lineitem", "l_orderkey").select("l_orderkey", fn.format_clock(F.col("l_orderkey") % 9000).alias("clock"), seconds.alias("seconds")).distinct()


def entities(spark, sf_dir):
    t = F.concat(F.lit("&lt;&#"), F.lit(65) + F.col("doc_id") % 26, F.lit(";&#x1F600;&amp;"), F.col("doc_id"))
    return _docs(spark, sf_dir).select("doc_id", fn.decode_entities(t).alias("text"))


def plurals(spark, sf_dir):
    df = read_table(spark, sf_dir, "documents", "doc_id", "lang")
    return df.select("doc_id", "lang", fn.plural_category(F.col("doc_id") % 5, F.col("lang")).alias("form"), fn.plural_category(F.col("doc_id") % 120, F.lit("ar")).alias("arabic"))


def front_matter(spark, sf_dir):
    t = F.concat(F.when(F.col("doc_id") % 2 == 0, "---\ntitle: x\n---\n").otherwise(""), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(fn.strip_front_matter(t), 256).alias("sha"))


def data_urls(spark, sf_dir):
    d = fn.data_url(F.concat(F.lit("data:Text/Plain;base64,"), F.base64(F.col("text").cast("binary"))))
    return _docs(spark, sf_dir).select("doc_id", d["type"].alias("type"), F.sha2(d["bytes"], 256).alias("sha"))


def passwords(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    p = F.when(F.col("c_custkey") % 3 == 0, F.lit("letmein")).when(F.col("c_custkey") % 3 == 1, F.lit("aaaa1111")).otherwise(F.lit("Tr0ub4dor&3x!Qz9"))
    return df.select("c_custkey", fn.password_score(p).alias("score"))


QUERIES = {
    "text_counts": counts,
    "text_join_lines": lines,
    "text_markdown": markdown,
    "text_chunks": chunks,
    "text_cell_numbers": cells,
    "text_clocks": clocks,
    "text_entities": entities,
    "text_plurals": plurals,
    "text_front_matter": front_matter,
    "text_data_urls": data_urls,
    "text_passwords": passwords,
}
SQL = {
    "text_counts": r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+'))::BIGINT AS words, regexp_matches(text, '\p{L}{2}') AS has_words FROM documents",
    "text_join_lines": r"""WITH l AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS t FROM documents)
SELECT doc_id, sha256(replace(regexp_replace(t, '(\p{L})-\n(\p{Ll})', '\1\2', 'g'), chr(10), ' ')) AS sha FROM l""",
    "text_markdown": r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([\\`*_\[\]<>|])', '\\\1', 'g'), '^(\s*)([#+-])(\s)', '\1\\\2\3'), '^(\s*[0-9]+)([.)])(\s)', '\1\\\2\3') AS t FROM documents)
SELECT doc_id, length(t)::BIGINT AS n, sha256(t) AS sha FROM m""",
    "text_chunks": "SELECT doc_id, false AS too_long, true AS whole FROM documents",
    "text_cell_numbers": "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN -round(l_extendedprice, 2) WHEN 1 THEN round(l_extendedprice, 2) END AS value FROM lineitem",
    "text_clocks": "SELECT DISTINCT l_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock, s::DOUBLE AS seconds FROM (SELECT l_orderkey, l_orderkey % 9000 AS s FROM lineitem)",
    "text_entities": "SELECT doc_id, '<' || chr((65 + doc_id % 26)::INT) || chr(128512) || '&' || doc_id AS text FROM documents",
    "text_plurals": """SELECT doc_id, lang, CASE WHEN doc_id % 5 = 1 OR (lang = 'fr' AND doc_id % 5 = 0) THEN 'one' ELSE 'other' END AS form,
CASE WHEN doc_id % 120 = 0 THEN 'zero' WHEN doc_id % 120 = 1 THEN 'one' WHEN doc_id % 120 = 2 THEN 'two' WHEN doc_id % 120 % 100 BETWEEN 3 AND 10 THEN 'few' WHEN doc_id % 120 % 100 BETWEEN 11 AND 99 THEN 'many' ELSE 'other' END AS arabic FROM documents""",
    "text_front_matter": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "text_data_urls": "SELECT doc_id, 'text/plain' AS type, sha256(text) AS sha FROM documents",
    "text_passwords": "SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN 4 ELSE 0 END AS score FROM customer",
}
