"""Packages, probe and OCR JSON and SQL functions, on data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.register import register
from leafmill.operators import layout, office, tables
from leafmill.sources import files as src
from leafmill.sources import media
from leafmill.sources.tables import read_table


def _parts(spark, sf_dir):
    """Conversations as packages: what each turn stands for depends on its number."""
    t = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    path = F.element_at(F.array(F.lit("[Content_Types].xml"), F.lit("word/document.xml"), F.lit("word/comments.xml"), F.lit("docProps/core.xml")), (F.col("turn") % 4 + 1).cast("int"))
    xml = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("<dc:creator>"), "role", F.lit("</dc:creator>"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("<w:t>"), F.length("text").cast("string"), F.lit("</w:t>"), F.when(F.col("conv_id") % 2 == 0, "<w:vanish/>").otherwise(""))).otherwise("<x/>")
    return t.select(F.col("conv_id").alias("file_id"), path.alias("path"), xml.alias("xml"))


def office_findings(spark, sf_dir):
    return office.office_findings(_parts(spark, sf_dir))


def people(spark, sf_dir):
    return office.people_in_files(_parts(spark, sf_dir)).select("file_id", F.array_join("people", ",").alias("people"))


def zip_kinds(spark, sf_dir):
    return office.zip_kind(_parts(spark, sf_dir))


def actions(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "user_id")
    kind = F.element_at(F.array(F.lit("JavaScript"), F.lit("URI"), F.lit("GoTo"), F.lit("SubmitForm")), (F.col("event_id") % 4 + 1).cast("int"))
    return office.object_findings(e.select(F.col("user_id").alias("file_id"), kind.alias("action"))).drop("programs")


def probes(spark, sf_dir):
    """Events as media files: a track or two, a duration of the file or only of its tracks."""
    e = read_table(spark, sf_dir, "events", "event_id")
    n = F.col("event_id").cast("string")
    json = F.concat(F.lit('{"streams":[{"codec_type":"video","duration":"'), n, F.lit('"}'), F.when(F.col("event_id") % 2 == 0, ',{"codec_type":"audio","duration":"1"}').otherwise(""), F.lit('],"format":{"format_name":"mp4"'), F.when(F.col("event_id") % 3 == 0, ',"duration":"7.5"').otherwise(""), F.lit("}}"))
    return media.parse_probe(e.select("event_id", json.alias("json")), "event_id").select("event_id", "duration", "video", "audio", "cover")


def ocr(spark, sf_dir):
    """All words of each turn as OCR words in one line, ten pixels apart, each followed by a speck that is dropped."""
    t = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    words = F.filter(F.split("text", r"\s+"), lambda w: w.rlike("[A-Za-z0-9]"))
    box = lambda x: F.struct(x.cast("double").alias("x0"), F.lit(0.0).alias("y0"), (x + 8).cast("double").alias("x1"), F.lit(8.0).alias("y1"))
    word = lambda text, confidence, x: F.struct(text.alias("text"), F.lit(confidence).alias("confidence"), box(x).alias("bbox"))
    own = F.flatten(F.transform(words, lambda w, i: F.array(word(w, 90.0, i * 10), word(F.lit("|"), 20.0, i * 10 + 9))))
    base = F.struct(F.lit(0.0).alias("x0"), F.lit(8.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(18.0).alias("y1"))
    line = F.struct(base.alias("baseline"), box(F.lit(0)).alias("bbox"), own.alias("words"))
    par = F.struct(F.lit(True).alias("is_ltr"), F.array(line).alias("lines"))
    json = F.to_json(F.struct(F.lit(90.0).alias("confidence"), F.array(F.struct(F.array(par).alias("paragraphs"))).alias("blocks")))
    return src.parse_ocr(t.select("conv_id", "turn", json.alias("json")), ["conv_id", "turn"], scale=F.lit(2.0)).select("conv_id", "turn", "text", "x", "baseline")


def sql_functions(spark, sf_dir):
    register(spark)
    read_table(spark, sf_dir, "documents", "doc_id", "text").createOrReplaceTempView("lm_documents")
    return spark.sql("SELECT doc_id, lm_count_words(text) AS words, lm_has_words(text) AS has_words, size(lm_emails(text)) AS emails FROM lm_documents")


def page_texts(spark, sf_dir):
    """Turns as scanned pages: each sentence a paragraph, four words a line."""
    t = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    p = t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.posexplode(F.split("text", "\n")).alias("par", "s"))
    w = p.select("doc", "page", "par", F.posexplode(F.filter(F.split("s", " "), lambda x: x != "")).alias("k", "text"))
    w = w.select("doc", "page", "par", F.floor(F.col("k") / 4).alias("line"), F.col("k").alias("word"), "text", F.lit(80.0).alias("confidence"))
    return tables.page_text(w).select("doc", "page", F.sha2("text", 256).alias("sha"), "words", "confidence")


def sheets(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return tables.sheet_extent(df.select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 10).alias("col"), F.when(F.col("l_returnflag") == "N", " ").otherwise("x").alias("value")))


def annotations(spark, sf_dir):
    t = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    q = spark.createDataFrame([("of  THE",), ("zzzz",), (" ",)], "query string")
    return layout.annotation_hits(t.select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page"), F.col("turn").alias("annot_no"), "text"), q)


def annotations_many(spark, sf_dir):
    """Every turn as an annotation, searched for the second and third word of every turn."""
    t = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    q = t.filter(F.size(w) >= 3).select(F.concat_ws("  ", F.get(w, F.lit(1)), F.get(w, F.lit(2))).alias("query")).distinct()
    hits = layout.annotation_hits(t.select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page"), F.col("turn").alias("annot_no"), "text"), q)
    return hits.groupBy("doc_id", "annot_no").agg(F.count("*").alias("hits"))


def template_values(spark, sf_dir):
    """Texts of two values, whose translation names them the other way round, from templates that are as many as the nations."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    made = n.select(F.concat(F.lit("{0} of "), "n_name", F.lit(": {#} files")).alias("template"), F.concat("n_name", F.lit(" {#} {0}?{1}")).alias("translation"))
    many = made.union(made.select(F.concat(F.lit("x"), "template"), "translation")).union(made.select(F.lit("of "), F.lit("no value")))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat("c_name", F.lit(" of "), "n_name", F.lit(": "), F.when(F.col("c_custkey") % 3 == 0, F.lit("no")).otherwise(F.format_number("c_custkey", 0)), F.lit(" files"))
    return tables.template_match(rows.select(text.alias("text")), many)


def templates(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_custkey", F.lit(" files"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("My files of "), "c_name")).otherwise(F.col("c_name"))
    made = spark.createDataFrame([("{#} files", "{#} Dateien"), ("My {0}", "Mein {0}"), ("My files of {0}", "Dateien von {0}")], "template string, translation string")
    return tables.template_match(c.select(text.alias("text")), made)


def forensics(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    day = F.date_format("o_orderdate", "yyyy:MM:dd")
    rows = F.array(
        F.struct(F.lit("DateTimeOriginal").alias("key"), F.concat(day, F.lit(" 10:00:00")).alias("value")),
        F.struct(F.lit("ModifyDate").alias("key"), F.concat(day, F.when(F.col("o_orderkey") % 2 == 0, " 10:00:30").otherwise(" 11:00:00")).alias("value")),
        F.struct(F.lit("Software").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "Adobe Photoshop 25").when(F.col("o_orderkey") % 3 == 1, "Midjourney").otherwise("Scanner").alias("value")),
        F.when(F.col("o_orderkey") % 5 == 0, F.struct(F.lit("Model").alias("key"), F.lit("X100").alias("value"))),
    )
    entries = o.select(F.col("o_orderkey").alias("file_id"), F.explode(F.array_compact(rows)).alias("e")).select("file_id", "e.key", "e.value")
    return tables.forensic_findings(entries).select("file_id", "id", "severity")


QUERIES = {"page_texts": page_texts, "sheet_extents": sheets, "annotation_hits": annotations, "template_match": templates, "template_values": template_values, "annotation_index": annotations_many, "image_forensics": forensics, "office_findings": office_findings, "office_people": people, "office_zip_kinds": zip_kinds, "pdf_actions": actions, "media_probes": probes, "ocr_words": ocr, "sql_functions": sql_functions}
SQL = {
    "page_texts": r"""WITH p AS (SELECT conv_id AS doc, turn AS page, generate_subscripts(string_split(text, chr(10)), 1) AS par, unnest(string_split(text, chr(10))) AS s FROM conversations),
w AS (SELECT doc, page, par, list_filter(string_split(s, ' '), lambda x: x <> '') AS w FROM p),
l AS (SELECT doc, page, par, len(w) AS n, array_to_string(list_transform(range(0, (len(w) + 3) // 4), lambda i: array_to_string(w[i * 4 + 1:i * 4 + 4], ' ')), chr(10)) AS t FROM w WHERE len(w) > 0)
SELECT doc, page, sha256(string_agg(t, chr(10) || chr(10) ORDER BY par)) AS sha, sum(n)::BIGINT AS words, 80::BIGINT AS confidence FROM l GROUP BY doc, page""",
    "sheet_extents": "SELECT l_orderkey AS sheet, max(l_linenumber) + 1 AS rows, max(l_partkey % 10) + 1 AS cols, count(*) AS filled FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1",
    "annotation_hits": r"SELECT conv_id AS doc_id, 0 AS page, turn AS annot_no, 'of  THE' AS query FROM conversations WHERE contains(lower(regexp_replace(text, '\s+', ' ', 'g')), 'of the')",
    "template_match": "SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN c_custkey || ' files' WHEN 1 THEN 'My files of ' || c_name ELSE c_name END AS text, CASE c_custkey % 3 WHEN 0 THEN c_custkey || ' Dateien' WHEN 1 THEN 'Dateien von ' || c_name ELSE c_name END AS shown FROM customer",
    "image_forensics": "WITH k AS (SELECT o_orderkey AS f FROM orders) SELECT f AS file_id, 'ai' AS id, 'high' AS severity FROM k WHERE f % 3 = 1 UNION ALL SELECT f, 'edited', 'medium' FROM k WHERE f % 3 = 0 UNION ALL SELECT f, 'software', 'info' FROM k WHERE f % 3 = 2 UNION ALL SELECT f, 'dates', 'medium' FROM k WHERE f % 2 = 1 UNION ALL SELECT f, 'camera', 'info' FROM k WHERE f % 5 = 0 UNION ALL SELECT f, 'no-camera', 'info' FROM k WHERE f % 5 <> 0 AND f % 3 <> 1",
    "office_findings": """WITH c AS (SELECT conv_id AS file_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT file_id, 'comments' AS id, 'high' AS severity, 1::BIGINT AS parts FROM c WHERE n > 2 UNION ALL SELECT file_id, 'properties', 'medium', 1 FROM c WHERE n > 3 UNION ALL SELECT file_id, 'hidden-text', 'high', 1 FROM c WHERE n > 1 AND file_id % 2 = 0""",
    "office_people": "SELECT conv_id AS file_id, string_agg(DISTINCT role, ',' ORDER BY role) AS people FROM conversations WHERE turn % 4 = 3 GROUP BY 1",
    "annotation_index": r"""WITH t AS (SELECT conv_id AS doc_id, turn AS annot_no, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
q AS (SELECT DISTINCT w[2] || '  ' || w[3] AS query, lower(w[2] || ' ' || w[3]) AS q FROM t WHERE len(w) >= 3)
SELECT doc_id, annot_no, count(*) AS hits FROM t JOIN q ON contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), q) GROUP BY ALL""",
    "template_values": "WITH c AS (SELECT c_custkey, c_name, n_name, c_name || ' of ' || n_name || ': ' AS head FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT DISTINCT head || CASE WHEN c_custkey % 3 = 0 THEN 'no' ELSE format('{:,}', c_custkey) END || ' files' AS text, CASE WHEN c_custkey % 3 = 0 THEN head || 'no files' ELSE n_name || ' ' || format('{:,}', c_custkey) || ' ' || c_name || '?{1}' END AS shown FROM c",
    "office_zip_kinds": "SELECT conv_id AS file_id, CASE WHEN count(*) > 1 THEN 'Word document' ELSE 'ZIP archive' END AS kind FROM conversations GROUP BY 1",
    "pdf_actions": "WITH e AS (SELECT user_id AS file_id, CASE event_id % 4 WHEN 0 THEN 'javascript' WHEN 1 THEN 'links' WHEN 3 THEN 'submit' END AS id FROM events) SELECT file_id, id, count(*) AS n, CASE id WHEN 'javascript' THEN 'high' WHEN 'submit' THEN 'medium' ELSE 'info' END AS severity FROM e WHERE id IS NOT NULL GROUP BY file_id, id",
    "media_probes": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 7.5 WHEN event_id % 2 = 0 THEN greatest(event_id, 1) ELSE event_id END::DOUBLE AS duration, 1 AS video, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS audio, false AS cover FROM events",
    "ocr_words": r"WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS w FROM conversations), k AS (SELECT conv_id, turn, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS k FROM w) SELECT conv_id, turn, text, (k * 5)::DOUBLE AS x, (8 + k) / 2.0::DOUBLE AS baseline FROM k",
    "sql_functions": r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+'))::INT AS words, regexp_matches(text, '\p{L}{2}') AS has_words, len(regexp_extract_all(text, '[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}'))::INT AS emails FROM documents",
}
