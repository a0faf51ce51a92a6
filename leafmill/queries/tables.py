"""Metadata, comparison and decoded tables, on data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import metadata as md
from leafmill.operators import compare, findings, tables
from leafmill.sources.tables import read_table

KEYS = ["GPSLatitude", "dc:creator", "xmp:CreatorTool", "ExposureTime", "Software", "ColorSpace", "Comment", "XResolution"]


def _pick(column, values):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))


def _entries(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return df.select(F.col("l_orderkey").alias("file_id"), _pick(F.col("l_linenumber"), ["exif", "xmp"]).alias("grp"), _pick(F.col("l_partkey"), KEYS).alias("key"), F.col("l_quantity").cast("string").alias("value"))


def classified(spark, sf_dir):
    return tables.classify_entries(_entries(spark, sf_dir)).groupBy("key", "sensitivity").agg(F.count("*").alias("n"))


def audit(spark, sf_dir):
    return findings.audit_summary(tables.classify_entries(_entries(spark, sf_dir)))


def high_only(spark, sf_dir):
    return findings.filter_sensitivity(tables.classify_entries(_entries(spark, sf_dir)), "high").groupBy("file_id").agg(F.count("*").alias("n"))


def humanized(spark, sf_dir):
    return _entries(spark, sf_dir).select("key", md.humanize_key(F.col("key")).alias("label")).distinct()


def stripped(spark, sf_dir):
    """Entries before, and after all but low ones were taken out."""
    before = tables.classify_entries(_entries(spark, sf_dir)).select("file_id", F.lit("before").alias("stage"), "grp", "key", "value", "sensitivity")
    after = before.filter("sensitivity = 'low'").withColumn("stage", F.lit("after"))
    d = tables.diff_before_after(before.union(after).drop("sensitivity"))
    return d.groupBy("change").agg(F.count("*").alias("n"))


def camera(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    key = _pick(F.col("l_linenumber"), ["ExposureTime", "FNumber", "FocalLength"])
    return df.select("l_orderkey", "l_linenumber", md.camera_value(key, F.col("l_quantity")).alias("shown"))


def dates(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    exif, pdf = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"), F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+02'00'"))
    return df.select("o_orderkey", md.parse_exif_date(exif).alias("exif"), md.parse_pdf_date(pdf).alias("pdf"))


def places(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer", "c_custkey")
    text = F.concat(F.lit("+"), (F.col("c_custkey") % 120).cast("string"), F.lit("-122.5+010/"))
    return df.select("c_custkey", md.iso6709(text).alias("place"))


def media_groups(spark, sf_dir):
    keys = ["com.apple.quicktime.make", "creation_time", "title-eng", "encoder", "handler_name", "xyz", "foo"]
    return read_table(spark, sf_dir, "customer", "c_custkey").select(md.detail_group(_pick(F.col("c_custkey"), keys)).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


def software(spark, sf_dir):
    df = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    value = F.concat(_pick(F.col("p_partkey"), ["Adobe Photoshop ", "Midjourney ", "Writer ", ""]), F.col("p_name"))
    return df.select(md.editor_flags(F.lit("Software"), value).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def _pairs(spark, sf_dir):
    return compare.version_pairs(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", "text")


def diff_rebuilt(spark, sf_dir):
    """Every version word by word, made from the one before it and the changes alone."""
    pairs = _pairs(spark, sf_dir)
    return compare.rebuilt(pairs, compare.word_diff(pairs))


def diff_summary(spark, sf_dir):
    """Words of both versions; what is unchanged and what was put in make up the version after."""
    s = compare.comparison_summary(_pairs(spark, sf_dir))
    return s.select("pair", "words_before", "words_after", (F.col("unchanged") <= F.least("words_before", "words_after")).alias("adds_up"))


def diff_edited(spark, sf_dir):
    """Texts against a version in which the second word was replaced, the last doubled, and a page break and a word put before all: the report's lines."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    w = F.transform(compare.page_words(F.col("text")), lambda x: x["word"])
    d = d.select(F.col("doc_id").alias("pair"), F.array_distinct(w).alias("w")).filter(F.size("w") > 4)
    new = F.transform("w", lambda x, i: F.when(i == 1, F.lit("REPLACED~1")).otherwise(x))
    d = d.select("pair", F.array_join("w", " ").alias("before"), F.concat(F.lit("ADDED~1\f"), F.array_join(new, " "), F.lit(" "), F.element_at("w", -1)).alias("after"))
    return compare.changes_report(compare.word_diff(d)).select("pair", "changes", F.sha2("text", 256).alias("sha"))


def diff_anchors(spark, sf_dir):
    """Words that stand once on both sides."""
    whole = compare.prepared(_pairs(spark, sf_dir)).withColumns({"head": F.lit(0), "tail": F.lit(0)})
    return compare.unique_anchors(compare.words_of(whole)).groupBy("pair").agg(F.count("*").alias("anchors"))


def diff_ends(spark, sf_dir):
    return compare.prepared(_pairs(spark, sf_dir)).filter("size(a) + size(b) > 0").select("pair", "head")


def unreached(spark, sf_dir):
    """Orders that no chain from order 1, each leading to some further on, reaches."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey")
    nodes = o.select(F.lit(1).alias("file_id"), F.col("o_orderkey").alias("node"))
    edges = nodes.select("file_id", F.col("node").alias("src"), F.explode(F.array(F.col("node") * 2, F.col("node") * 3)).alias("dst"))
    return tables.unreachable(nodes, edges, nodes.filter("node = 1")).select("node")


def chains(spark, sf_dir):
    """Issuers as a chain of customers: each one's is the half of its number."""
    c = read_table(spark, sf_dir, "customer", "c_custkey")
    certs = c.select(F.lit(1).alias("file_id"), F.col("c_custkey").alias("subject"), F.greatest(F.lit(1), F.floor(F.col("c_custkey") / 2)).cast("long").alias("issuer"))
    return tables.issuer_chain(certs).select("leaf", "depth", "subject")


def outlines(spark, sf_dir):
    df = read_table(spark, sf_dir, "conversations", "conv_id", "turn")
    return tables.outline_tree(df.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), (F.col("turn") % 3).cast("int").alias("level")))


def signatures(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag")
    s = df.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("field"), F.col("l_quantity").alias("end"), F.lit(45.0).alias("file_length"), (F.col("l_returnflag") == "N").alias("intact"), F.col("l_shipdate").alias("signed_at"), F.lit("1995-01-01").cast("timestamp").alias("not_before"), F.lit("1997-01-01").cast("timestamp").alias("not_after"))
    return tables.signature_rollup(s)


def forms(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    fields = p.select(F.col("p_partkey").alias("doc_id"), F.lit("f").alias("name"), _pick(F.col("p_partkey"), ["text", "dropdown"]).alias("kind"), F.lit("old").alias("value_s"), F.when(F.col("p_partkey") % 2 == 1, F.array(F.lit("new"), F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("options"), F.when(F.col("p_partkey") % 2 == 0, 2).cast("int").alias("max_length"), F.lit(False).alias("editable"), (F.col("p_size") > 40).alias("read_only"))
    values = p.select(F.col("p_partkey").alias("doc_id"), F.lit("f").alias("name"), F.when(F.col("p_partkey") % 4 == 3, "other").otherwise("new").alias("value_s"))
    return tables.apply_values(fields, values).select("doc_id", "value_s")


def targets(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", "c_custkey")
    rels = c.select(F.lit("f").alias("file_id"), F.lit("word/_rels/document.xml.rels").alias("rels"), F.concat(_pick(F.col("c_custkey"), ["../media/./", "/media/", "media/"]), F.col("c_custkey").cast("string")).alias("target"), (F.col("c_custkey") % 5 == 0).alias("external"), F.col("c_custkey").alias("id"))
    parts = c.filter("c_custkey % 2 = 0").select(F.lit("f").alias("file_id"), F.concat(F.lit("media/"), F.col("c_custkey").cast("string")).alias("path"))
    return tables.resolve_targets(rels, parts).select("id", "path", "found")


def lookups(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    texts = c.select(_pick(F.col("c_custkey"), ["de", "fr"]).alias("lang"), _pick(F.col("c_custkey"), ["Hello {n}", "Bye {n}", "Other {n}"]).alias("key"), F.create_map(F.lit("n"), F.col("c_name")).alias("params"), "c_custkey")
    catalog = spark.createDataFrame([("de", "Hello {n}", "Hallo {n}"), ("fr", "Bye {n}", "Au revoir {n}")], "lang string, key string, text string")
    return tables.catalog_lookup(texts, catalog).select("c_custkey", "shown")


def catalogs(spark, sf_dir):
    """Part names as a catalogue in four languages, with gaps and slips."""
    p = read_table(spark, sf_dir, "part", "p_partkey")
    key = F.concat(F.lit("k {n} "), F.col("p_partkey").cast("string"))
    catalog = p.filter("p_partkey % 7 <> 0").select(_pick(F.col("p_partkey"), ["de", "fr", "es", "en"]).alias("lang"), key.alias("key"), F.when(F.col("p_partkey") % 11 == 0, "lost").otherwise("t {n}").alias("text"))
    return tables.catalog_quality(catalog, p.filter("p_partkey % 5 <> 0").select(key.alias("key")))


def ranked(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return tables.keyword_rank(d.select(F.col("doc_id").alias("id"), F.substring("text", 1, 200).alias("name"), "text"), "the of", 20)


def ranked_all(spark, sf_dir):
    """Three queries at once over all parts, with the brand as a keyword; one has no words."""
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type").withColumn("keywords", F.array("p_brand"))
    q = spark.createDataFrame([("BRAND#1 a",), ("  ",), ("e brand#2",)], "query string")
    return tables.keyword_rank(p, q, None, "p_partkey", "p_name", "p_type", "keywords")


def modes(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem", "l_returnflag", "l_discount", "l_quantity", "l_orderkey", "l_linenumber")
    df = df.withColumn("order", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("value", F.col("l_discount") * 40)
    return tables.weighted_mode(df, ["l_returnflag"], "value", "l_quantity", "order")


QUERIES = {f"table_{f.__name__}": f for f in (classified, audit, high_only, humanized, stripped, camera, dates, places, media_groups, software, diff_rebuilt, diff_summary, diff_edited, diff_anchors, diff_ends, unreached, chains, outlines, signatures, forms, targets, lookups, catalogs, ranked, ranked_all, modes)}

_LEVEL = "CASE WHEN key IN ('GPSLatitude', 'dc:creator') THEN 'high' WHEN key IN ('ExposureTime', 'ColorSpace', 'XResolution') THEN 'low' ELSE 'medium' END"
_E = f"""e AS (SELECT l_orderkey AS file_id, ['exif', 'xmp'][l_linenumber % 2 + 1] AS grp, ['{"', '".join(KEYS)}'][(l_partkey % 8 + 1)::INT] AS key, l_quantity AS value FROM lineitem), c AS (SELECT *, {_LEVEL} AS sensitivity FROM e)"""
_W = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
_PAIRS = f"""p AS (SELECT conv_id || '-' || turn AS pair, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, text AS after FROM conversations),
w AS (SELECT pair, {_W.format('before')} AS a, {_W.format('after')} AS b FROM p WHERE before IS NOT NULL)"""
SQL = {
    "table_classified": f"WITH {_E} SELECT key, sensitivity, count(*) AS n FROM c GROUP BY ALL",
    "table_audit": f"WITH {_E} SELECT grp, count(*) FILTER (sensitivity = 'high') AS high, count(*) FILTER (sensitivity = 'medium') AS medium, count(*) FILTER (sensitivity = 'low') AS low, min(CASE sensitivity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS worst_rank FROM c GROUP BY grp",
    "table_high_only": f"WITH {_E} SELECT file_id, count(*) AS n FROM c WHERE sensitivity = 'high' GROUP BY file_id",
    "table_humanized": "SELECT * FROM (VALUES ('GPSLatitude', 'GPS Latitude'), ('dc:creator', 'Creator'), ('xmp:CreatorTool', 'Creator Tool'), ('ExposureTime', 'Exposure Time'), ('Software', 'Software'), ('ColorSpace', 'Color Space'), ('Comment', 'Comment'), ('XResolution', 'X Resolution')) t(key, label)",
    "table_stripped": f"WITH {_E}, d AS (SELECT DISTINCT file_id, grp, key, value, sensitivity FROM c) SELECT CASE WHEN sensitivity = 'low' THEN 'left' ELSE 'removed' END AS change, count(*) AS n FROM d GROUP BY 1",
    "table_camera": "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_quantity::BIGINT || ' s' WHEN 1 THEN 'f/' || l_quantity::BIGINT ELSE l_quantity::BIGINT || ' mm' END AS shown FROM lineitem",
    "table_dates": "SELECT o_orderkey, date_trunc('second', o_orderdate) AS exif, date_trunc('second', o_orderdate) - INTERVAL 2 HOUR AS pdf FROM orders",
    "table_places": "SELECT c_custkey, CASE WHEN c_custkey % 120 <= 90 THEN (c_custkey % 120) || ', -122.5 (10 m)' END AS place FROM customer",
    "table_media_groups": "SELECT CASE c_custkey % 7 WHEN 0 THEN 'device' WHEN 1 THEN 'dates' WHEN 2 THEN 'text' WHEN 3 THEN 'software' WHEN 5 THEN 'location' WHEN 6 THEN 'other' END AS grp, count(*) AS n FROM customer GROUP BY 1",
    "table_software": "SELECT CASE p_partkey % 4 WHEN 0 THEN 'editor' WHEN 1 THEN 'ai' ELSE 'software' END AS flag, count(*) AS n FROM part GROUP BY 1",
    "table_diff_rebuilt": f"WITH {_PAIRS} SELECT pair, array_to_string(b, ' ') AS text FROM w",
    "table_diff_summary": f"WITH {_PAIRS} SELECT pair, len(a)::BIGINT AS words_before, len(b)::BIGINT AS words_after, true AS adds_up FROM w",
    "table_diff_edited": rf"""WITH w AS (SELECT doc_id AS pair, {_W.format("coalesce(text, '')")} AS w FROM documents),
d AS (SELECT pair, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM w)
SELECT pair, 3::BIGINT AS changes, sha256('Added (page 1): ADDED~1' || chr(10) || 'Changed (page 1 → 2): ' || w[2] || ' → REPLACED~1' || chr(10) || 'Added (page 2): ' || w[len(w)]) AS sha FROM d WHERE len(w) > 4""",
    "table_diff_anchors": f"WITH {_PAIRS}, x AS (SELECT pair, unnest(a) AS k FROM w), y AS (SELECT pair, unnest(b) AS k FROM w), u AS (SELECT pair, k FROM x GROUP BY ALL HAVING count(*) = 1), v AS (SELECT pair, k FROM y GROUP BY ALL HAVING count(*) = 1) SELECT pair, count(*) AS anchors FROM u JOIN v USING (pair, k) GROUP BY pair",
    "table_diff_ends": f"WITH {_PAIRS} SELECT pair, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) - 1, least(len(a), len(b)))::INT AS head FROM w WHERE len(a) + len(b) > 0",
    "table_unreached": "WITH RECURSIVE r AS (SELECT 1::BIGINT AS node UNION SELECT unnest([node * 2, node * 3]) FROM r WHERE node <= (SELECT max(o_orderkey) FROM orders)) SELECT o_orderkey AS node FROM orders WHERE o_orderkey NOT IN (SELECT node FROM r)",
    "table_chains": "WITH RECURSIVE r AS (SELECT c_custkey AS leaf, 1 AS depth, greatest(1, c_custkey // 2) AS subject FROM customer WHERE greatest(1, c_custkey // 2) <> c_custkey AND greatest(1, c_custkey // 2) IN (SELECT c_custkey FROM customer) UNION ALL SELECT leaf, depth + 1, subject // 2 FROM r WHERE subject > 1 AND subject // 2 IN (SELECT c_custkey FROM customer)) SELECT * FROM r",
    "table_outlines": "SELECT conv_id AS doc_id, turn AS seq, (turn % 3)::INT AS level, CASE WHEN turn % 3 > 0 THEN turn - 1 END AS parent, true AS valid FROM conversations",
    "table_signatures": "WITH m AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS last FROM lineitem) SELECT l_orderkey AS file_id, count(*) AS signatures, count(*) FILTER (l_returnflag = 'N') AS intact, count(*) FILTER (l_quantity < 45 AND last < 45) AS changed, count(*) FILTER (l_shipdate BETWEEN '1995-01-01' AND '1997-01-01') AS valid_then FROM m GROUP BY 1",
    "table_forms": "SELECT p_partkey AS doc_id, CASE WHEN p_size > 40 THEN 'old' WHEN p_partkey % 2 = 0 THEN 'ne' WHEN p_partkey % 4 = 3 THEN 'old' ELSE 'new' END AS value_s FROM part",
    "table_targets": "WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN CASE c_custkey % 3 WHEN 2 THEN 'word/media/' ELSE 'media/' END || c_custkey END AS path FROM customer) SELECT id, path, CASE WHEN path IS NOT NULL THEN id % 2 = 0 AND id % 3 <> 2 END AS found FROM t",
    "table_lookups": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'Hallo ' WHEN c_custkey % 3 = 0 THEN 'Hello ' WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 1 THEN 'Au revoir ' WHEN c_custkey % 3 = 1 THEN 'Bye ' ELSE 'Other ' END || c_name AS shown FROM customer",
    "table_catalogs": """WITH c AS (SELECT ['de', 'fr', 'es', 'en'][(p_partkey % 4 + 1)::INT] AS lang, p_partkey AS k FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT count(*) AS n FROM part WHERE p_partkey % 5 <> 0)
SELECT lang, (SELECT n FROM n) - count(*) FILTER (k % 5 <> 0) AS missing, count(*) FILTER (k % 5 = 0) AS stale, 0::BIGINT AS twice, count(*) FILTER (k % 11 = 0) AS placeholders FROM c GROUP BY lang""",
    "table_ranked": r"""WITH d AS (SELECT doc_id AS id, lower(substr(text, 1, 200)) AS n, lower(text) AS t FROM documents),
s AS (SELECT id, n, CASE WHEN regexp_matches(n, '(^|[^\p{L}\p{N}])the') THEN 6 WHEN contains(n, 'the') THEN 4 WHEN contains(t, 'the') THEN 1 ELSE 0 END AS a, CASE WHEN regexp_matches(n, '(^|[^\p{L}\p{N}])of') THEN 6 WHEN contains(n, 'of') THEN 4 WHEN contains(t, 'of') THEN 1 ELSE 0 END AS b FROM d)
SELECT id, (a + b + CASE WHEN contains(n, 'the of') THEN 4 ELSE 0 END + CASE WHEN contains(n, 'the') AND contains(n, 'of') AND instr(n, 'of') > instr(n, 'the') THEN 2 ELSE 0 END)::BIGINT AS score FROM s WHERE a > 0 AND b > 0 ORDER BY score DESC, id LIMIT 20""",
    "table_ranked_all": r"""WITH q(query, a, b) AS (VALUES ('BRAND#1 a', 'brand#1', 'a'), ('e brand#2', 'e', 'brand#2')),
p AS (SELECT p_partkey, lower(p_name) AS n, lower(p_brand) AS k, lower(p_type) AS t FROM part),
w AS (SELECT query, a, b, p_partkey, n, k, t, unnest([a, b]) AS w FROM p, q),
s AS (SELECT query, a, b, p_partkey, n, CASE WHEN regexp_matches(n, '(^|[^\p{L}\p{N}])' || w) THEN 6 WHEN contains(n, w) THEN 4 WHEN regexp_matches(k, '(^|[^\p{L}\p{N}-])' || w) AND NOT contains(w, '#') THEN 3 WHEN contains(k, w) THEN 2 WHEN contains(t, w) THEN 1 ELSE 0 END AS s FROM w)
SELECT query, p_partkey, (sum(s) + CASE WHEN contains(n, a || ' ' || b) THEN 4 ELSE 0 END + CASE WHEN contains(n, a) AND contains(n, b) AND instr(n, b) > instr(n, a) THEN 2 ELSE 0 END)::BIGINT AS score FROM s GROUP BY query, p_partkey, n, a, b HAVING min(s) > 0
UNION ALL SELECT '  ', p_partkey, NULL FROM part""",
    "table_modes": "WITH v AS (SELECT l_returnflag, floor(l_discount * 40 * 2 + 0.5) / 2 AS mode, sum(l_quantity) AS w, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, arg_max(mode, (w, -first)) AS mode FROM v GROUP BY 1",
}
