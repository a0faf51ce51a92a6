"""What office packages carry along, from a table of their XML parts ``file_id, path, xml``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which parts mean what, in order: id, severity, path, and a pattern that the part must hold (or none).
RULES = [
    ("properties", "medium", r"^docProps/(core|app|custom)\.xml$", r"<(dc:creator|cp:lastModifiedBy|dc:title|dc:subject|dc:description|cp:keywords|cp:category|Company|Manager|property)[ >]"),
    ("comments", "high", r"^(word/comments\.xml|xl/comments\d*\.xml|xl/threadedComments/.*\.xml|ppt/comments/.*\.xml)$", None),
    ("changes", "high", r"^word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml$", r"<w:(ins|del|moveFrom|moveTo)[ >]"),
    ("hidden-text", "high", r"^word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml$", r"<w:vanish\s*/?>"),
    ("hidden-sheets", "high", r"^xl/workbook\.xml$", r"<sheet [^>]*state=\"(hidden|veryHidden)\""),
    ("hidden-cells", "medium", r"^xl/worksheets/.*\.xml$", r"<(row|col) [^>]*hidden=\"(1|true)\""),
    ("hidden-slides", "high", r"^ppt/slides/slide\d+\.xml$", r"<p:sld [^>]*show=\"(0|false)\""),
    ("notes", "medium", r"^ppt/notesSlides/.*\.xml$", None),
    ("pivot-cache", "medium", r"^xl/pivotCache/pivotCacheRecords\d*\.xml$", None),
    ("connections", "medium", r"^xl/connections\.xml$", None),
    ("macros", "high", r"(^|/)vbaProject\.bin$", None),
    ("embedded", "medium", r"/embeddings/", None),
    ("external", "medium", r"\.rels$", r"TargetMode=\"External\""),
    ("thumbnail", "info", r"^docProps/thumbnail\.", None),
    ("printer", "info", r"/printerSettings/", None),
    ("custom-xml", "info", r"^customXml/item\d+\.xml$", None),
]
PEOPLE = [r"<dc:creator[^>]*>([^<]+)<", r"<cp:lastModifiedBy[^>]*>([^<]+)<", r"<w:(?:comment|ins|del)[ ][^>]*w:author=\"([^\"]+)\"", r"<author[^>]*>([^<]+)<", r"<p:cmAuthor [^>]*name=\"([^\"]+)\"", r"<person [^>]*displayName=\"([^\"]+)\""]


def office_findings(parts: DataFrame) -> DataFrame:
    """``file_id, id, severity, parts`` of every rule that some part meets."""
    hits = [F.when(F.col("path").rlike(path) & (F.lit(True) if mark is None else F.coalesce(F.col("xml").rlike(mark), F.lit(False))), F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"))) for i, s, path, mark in RULES]
    found = parts.select("file_id", "path", F.explode(F.array_compact(F.array(*hits))).alias("f"))
    return found.groupBy("file_id", "f.id", "f.severity").agg(F.countDistinct("path").alias("parts"))


def people_in_files(parts: DataFrame) -> DataFrame:
    """``file_id, people``: the names of authors, commenters and reviewers, sorted."""
    names = F.flatten(F.array(*[F.regexp_extract_all("xml", F.lit(p), F.lit(1)) for p in PEOPLE]))
    rows = parts.select("file_id", F.explode(names).alias("n")).select("file_id", F.trim("n").alias("n")).filter("n <> ''")
    return rows.groupBy("file_id").agg(F.array_sort(F.collect_set("n")).alias("people"))


def zip_kind(parts: DataFrame) -> DataFrame:
    """``file_id, kind`` of packages by the names of their parts, and by what a part ``mimetype`` says (column ``xml``)."""
    has = lambda p: F.coalesce(F.max(F.col("path").startswith(p)), F.lit(False))
    own = lambda p: F.coalesce(F.max(F.col("path") == p), F.lit(False))
    mime = F.coalesce(F.max(F.when(F.col("path") == "mimetype", F.col("xml"))), F.lit(""))
    office = [("word/", "Word document"), ("xl/", "Excel workbook"), ("ppt/", "PowerPoint presentation"), ("visio/", "Visio drawing")]
    kind = F.when(mime.startswith("application/epub+zip"), "EPUB e-book")
    for word in ("text", "spreadsheet", "presentation"):
        kind = kind.when(mime.contains(f"opendocument.{word}"), f"OpenDocument {word}")
    for folder, name in office:
        kind = kind.when(own("[Content_Types].xml") & has(folder), name)
    kind = kind.when(own("AndroidManifest.xml"), "Android app (APK)").when(own("META-INF/MANIFEST.MF"), "Java program (JAR)").otherwise("ZIP archive")
    return parts.groupBy("file_id").agg(kind.alias("kind"))


def annotation_findings(annotations: DataFrame) -> DataFrame:
    """``file_id, id, severity, n, authors`` of PDF annotations ``file_id, subtype, author, text``: comments and markup, high where someone is named or wrote something."""
    a = annotations.filter(~F.col("subtype").isin("Link", "Widget", "Popup"))
    author, note = F.nullif(F.trim("author"), F.lit("")), F.nullif(F.trim("text"), F.lit(""))
    g = a.groupBy("file_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(author)).alias("authors"), F.count(note).alias("_notes"))
    severity = F.when((F.size("authors") > 0) | (F.col("_notes") > 0), "high").otherwise("medium")
    return g.select("file_id", F.lit("comments").alias("id"), severity.alias("severity"), "n", "authors")


def form_findings(fields: DataFrame) -> DataFrame:
    """``file_id, id, severity, n, filled`` of PDF form fields ``file_id, kind, value``: a form, medium where a field is filled in, and signatures."""
    signed = F.col("kind") == "signature"
    has = F.col("value").isNotNull() & (F.trim("value") != "") & (F.col("value") != "Off")
    g = fields.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(~signed & has).alias("filled"), F.count_if(signed & has).alias("signed"))
    form = F.struct(F.lit("form").alias("id"), F.when(F.col("filled") > 0, "medium").otherwise("info").alias("severity"), F.col("n"), F.col("filled"))
    signature = F.when(F.col("signed") > 0, F.struct(F.lit("signatures").alias("id"), F.lit("info").alias("severity"), F.col("signed").alias("n"), F.col("signed").alias("filled")))
    return g.select("file_id", F.inline(F.array_compact(F.array(form, signature))))


def layer_findings(layers: DataFrame) -> DataFrame:
    """``file_id, id, severity, n``: hidden layers of ``file_id, name, visible`` where there are any, else that all are seen."""
    g = layers.groupBy("file_id").agg(F.count_if(~F.col("visible")).alias("_hidden"), F.count("*").alias("_all"))
    some = F.col("_hidden") > 0
    return g.select("file_id", F.when(some, "layers").otherwise("layers-info").alias("id"), F.when(some, "high").otherwise("info").alias("severity"), F.when(some, F.col("_hidden")).otherwise(F.col("_all")).alias("n"))


# Fixed value: names of files that run.
EXECUTABLE = r"(?i)\.(exe|scr|bat|cmd|com|js|jse|vbs|vbe|wsf|ps1|msi|jar|hta|lnk|dll|app|sh)$"


def object_findings(actions: DataFrame) -> DataFrame:
    """``file_id, id, severity, n, programs`` of PDF actions ``file_id, action, target``: code, programs, forms sent, files elsewhere, links, attached files, and
    stored pictures of pages (action ``thumb``). ``programs``: how many attached files have a program's name; 0 where ``target`` is missing."""
    a = F.lower("action")
    kind = F.when(a == "javascript", "javascript").when(a == "launch", "launch").when(a.isin("submitform", "importdata"), "submit").when(a.isin("gotor", "gotoe"), "remote").when(a == "uri", "links").when(a == "embeddedfile", "attachments").when(a == "thumb", "thumbnails")
    severity = F.when(F.col("id").isin("javascript", "launch", "attachments"), "high").when(F.col("id").isin("submit", "remote", "thumbnails"), "medium").otherwise("info")
    program = F.trim("target").rlike(EXECUTABLE) if "target" in actions.columns else F.lit(False)
    rows = actions.withColumn("id", kind).filter("id is not null").groupBy("file_id", "id")
    return rows.agg(F.count("*").alias("n"), F.count_if((kind == "attachments") & program).alias("programs")).withColumn("severity", severity)
