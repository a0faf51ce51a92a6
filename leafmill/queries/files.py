"""Files: documents and pages taken as the contents of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import files as fn
from leafmill.operators import files as ops
from leafmill.sources.tables import read_table


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", "doc_id", "text").withColumn("content", F.col("text").cast("binary"))


def hashes(spark, sf_dir):
    return ops.with_hashes(_docs(spark, sf_dir), F.col("content")).select("doc_id", "sha256", "sha1", "md5")


def known(spark, sf_dir):
    """Documents looked up by pasted hashes, upper case and with spaces."""
    hashed = ops.with_hashes(_docs(spark, sf_dir), F.col("content"))
    pasted = F.when(F.col("doc_id") % 2 == 0, F.upper("md5")).otherwise(F.concat(F.lit(" "), F.regexp_replace("sha1", "(..)", "$1 ")))
    return ops.match_hashes(hashed, hashed.filter("doc_id % 3 = 0").select(pasted.alias("hash")), "doc_id")


def types(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages", "page_id", "html")
    t = fn.detect_type(F.col("html").cast("binary"))
    return pages.select("page_id", t["name"].alias("name"), t["category"].alias("category"))


def signatures(spark, sf_dir):
    """Texts behind the first bytes of other formats."""
    marks = ["89504E47", "25504446", "4D5A", "504B0304", "1A45DFA3", "00000018667479706D703432"]
    head = F.element_at(F.array(*[F.unhex(F.lit(m)) for m in marks]), (F.col("doc_id") % 6 + 1).cast("int"))
    t = fn.detect_type(F.concat(head, F.lit("-").cast("binary"), F.col("content")))
    return _docs(spark, sf_dir).select("doc_id", t["name"].alias("name"))


def active(spark, sf_dir):
    return read_table(spark, sf_dir, "pages", "page_id", "html").select("page_id", fn.script_markers(F.col("html").cast("binary")).alias("active"))


def sizes(spark, sf_dir):
    n = F.octet_length("content").cast("long") * F.col("doc_id")
    return _docs(spark, sf_dir).select("doc_id", fn.format_bytes(n).alias("size"))


def names(spark, sf_dir):
    name = F.element_at(F.array(F.lit("a.pdf.exe"), F.lit("b‮fdp.exe"), F.lit("c.doc     .exe"), F.lit("d.tar.gz")), (F.col("doc_id") % 4 + 1).cast("int"))
    df = read_table(spark, sf_dir, "documents", "doc_id")
    return df.select("doc_id", F.array_join(fn.name_findings(name), ",").alias("found"), fn.extension(name).alias("extension"), fn.with_suffix(name, "x").alias("suffixed"), fn.replace_extension(name, ".md").alias("renamed"))


def kinds(spark, sf_dir):
    name = F.element_at(F.array(F.lit("A.PDF"), F.lit("b.Jpeg"), F.lit("c"), F.lit("d.bin"), F.lit("e.md")), (F.col("doc_id") % 5 + 1).cast("int"))
    return read_table(spark, sf_dir, "documents", "doc_id").select("doc_id", fn.file_kind(name, F.when(F.col("doc_id") % 5 == 2, "video/mp4").otherwise("")).alias("kind"))


def tools(spark, sf_dir):
    """How many operations take the documents of each kind."""
    made = spark.createDataFrame([("merge", ["pdf"]), ("redact", ["pdf", "text"]), ("hash", ["unknown"])], "id string, accepts array<string>")
    return ops.tools_for(kinds(spark, sf_dir), made).groupBy("kind", "id").agg(F.count("*").alias("files"))


def savings(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    df = df.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("before"), (F.col("l_quantity") * (1 - 2 * F.col("l_discount"))).alias("after"))
    return ops.size_savings(df).select("l_orderkey", "l_linenumber", F.round("saved", 4).alias("saved"))


def permissions(spark, sf_dir):
    return read_table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.array_join(fn.permission_flags(F.col("o_orderkey").cast("int")), ",").alias("forbidden"))


def decoded(spark, sf_dir):
    """Texts stored as UTF-16 or UTF-8 and read back."""
    stored = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.col("content"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(fn.decode_text(stored), 256).alias("sha"))


def revisions(spark, sf_dir):
    text = F.concat(F.lit("%PDF-1.7 "), F.when(F.col("doc_id") % 2 == 0, "/Linearized ").otherwise(""), F.repeat(F.lit("%%EOF"), (F.col("doc_id") % 4 + 1).cast("int")))
    return read_table(spark, sf_dir, "documents", "doc_id").select("doc_id", fn.pdf_revisions(text.cast("binary")).cast("long").alias("revisions"))


QUERIES = {
    "file_hashes": hashes,
    "file_known": known,
    "file_types": types,
    "file_signatures": signatures,
    "file_active": active,
    "file_sizes": sizes,
    "file_names": names,
    "file_kinds": kinds,
    "file_tools": tools,
    "file_savings": savings,
    "file_permissions": permissions,
    "file_decoded": decoded,
    "file_revisions": revisions,
}
_KIND = "CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'video' WHEN 3 THEN 'unknown' ELSE 'text' END"
SQL = {
    "file_hashes": "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents",
    "file_known": """WITH k AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE sha1(text) END AS h FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, CASE WHEN sha1(text) IN (SELECT h FROM k) THEN 'sha1' ELSE 'md5' END AS algorithm, CASE WHEN sha1(text) IN (SELECT h FROM k) THEN sha1(text) ELSE md5(text) END AS hash
FROM documents WHERE sha1(text) IN (SELECT h FROM k) OR md5(text) IN (SELECT h FROM k)""",
    "file_types": "SELECT page_id, CASE WHEN contains(lower(substr(ltrim(html), 1, 512)), '<svg') THEN 'SVG image' WHEN lower(ltrim(html)) LIKE '<!doctype html%' OR lower(ltrim(html)) LIKE '<html%' THEN 'Web page (HTML)' ELSE 'Plain text' END AS name, CASE WHEN contains(lower(substr(ltrim(html), 1, 512)), '<svg') THEN 'image' ELSE 'text' END AS category FROM pages",
    "file_signatures": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'PNG image' WHEN 1 THEN 'PDF document' WHEN 2 THEN 'Windows program' WHEN 3 THEN 'ZIP archive' WHEN 4 THEN 'Matroska video' ELSE 'MP4 video' END AS name FROM documents",
    "file_active": r"SELECT page_id, regexp_matches(html, '(?i)<script\b|\son\w+\s*=|javascript:') AS active FROM pages",
    "file_sizes": "WITH n AS (SELECT doc_id, strlen(text) * doc_id AS n FROM documents), v AS (SELECT *, CASE WHEN n < 1048576 THEN n / 1024 WHEN n < 1073741824 THEN n / 1048576 ELSE n / 1073741824 END AS v FROM n) SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' ELSE CASE WHEN v < 10 THEN format('{:.1f}', floor(v * 10 + 0.5) / 10) ELSE format('{:.0f}', floor(v + 0.5)) END || CASE WHEN n < 1048576 THEN ' KB' WHEN n < 1073741824 THEN ' MB' ELSE ' GB' END END AS size FROM v",
    "file_names": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'double' WHEN 1 THEN 'bidi' WHEN 2 THEN 'double' ELSE '' END AS found, CASE doc_id % 4 WHEN 3 THEN 'gz' ELSE 'exe' END AS extension, CASE doc_id % 4 WHEN 0 THEN 'a.pdf-x.exe' WHEN 1 THEN 'b' || chr(8238) || 'fdp-x.exe' WHEN 2 THEN 'c.doc     -x.exe' ELSE 'd.tar-x.gz' END AS suffixed, CASE doc_id % 4 WHEN 0 THEN 'a.pdf.md' WHEN 1 THEN 'b' || chr(8238) || 'fdp.md' WHEN 2 THEN 'c.doc     .md' ELSE 'd.tar.md' END AS renamed FROM documents",
    "file_kinds": f"SELECT doc_id, {_KIND} AS kind FROM documents",
    "file_tools": f"WITH k AS (SELECT {_KIND} AS kind FROM documents) SELECT kind, id, count(*) AS files FROM k JOIN (VALUES ('merge', 'pdf'), ('redact', 'pdf'), ('redact', 'text'), ('hash', 'unknown')) t(id, a) ON kind = a OR a = 'unknown' GROUP BY kind, id",
    "file_savings": "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity * (1 - 2 * l_discount) <= l_quantity * 0.9 THEN 1 - l_quantity * (1 - 2 * l_discount) / l_quantity ELSE 0 END, 4) AS saved FROM lineitem",
    "file_permissions": "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey & 4 = 0 THEN 'printing' END, CASE WHEN o_orderkey & 8 = 0 THEN 'editing' END, CASE WHEN o_orderkey & 16 = 0 THEN 'copying' END, CASE WHEN o_orderkey & 32 = 0 THEN 'commenting' END], lambda x: x IS NOT NULL), ',') AS forbidden FROM orders",
    "file_decoded": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "file_revisions": "SELECT doc_id, doc_id % 4 + 1 - CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS revisions FROM documents",
}
