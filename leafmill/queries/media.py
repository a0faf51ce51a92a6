"""Image files, packages and reports made byte by byte from the given tables, written to the shared folder and read back."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from leafmill.functions.files import content_marks, decode_text, pdf_version, text_format
from leafmill.functions.text import decode_entities, plural_form, sentence_chunks
from leafmill.operators import findings, images, office, tables
from leafmill.operators.tables import shared_folder
from leafmill.sources import files as src
from leafmill.sources import media, metadata, packages
from leafmill.sources.tables import read_table


def _big(n, width):
    """A whole number in so many bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def _little(n, width):
    return F.unhex(F.regexp_replace(F.lpad(F.hex(n.cast("long")), 2 * width, "0"), "(..)" * width, "".join(f"${k}" for k in range(width, 0, -1))))


def _hex(text):
    return F.unhex(F.lit(text))


def _text(column):
    return F.encode(column, "UTF-8")


def _segment(marker, body):
    return F.concat(_hex("FF" + marker), _big(F.octet_length(body) + 2, 2), body)


def _pictures(spark, sf_dir):
    """Customers as JPEG files: JFIF, EXIF with the name as maker, an orientation and an exposure time, XMP with a creator, a luminance table, image data.

    Customers are dealt out first: a file of so short rows is one task's, and would have all the pictures made from it in that task."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey").repartition("c_custkey")
    name = F.concat(_text(F.col("c_name")), _hex("00"))
    turn = F.col("c_custkey") % 8 + 1
    n = F.octet_length(name)
    # the image block holds maker, orientation and the place of the camera's block; then the name, then the camera's block
    camera = F.lit(50) + n
    first = F.concat(_hex("0003"), _hex("010F0002"), _big(n, 4), _big(F.lit(50), 4), _hex("0112000300000001"), _big(turn, 2), _hex("0000"), _hex("8769000400000001"), _big(camera, 4), _hex("00000000"))
    second = F.concat(_hex("0001"), _hex("829A000500000001"), _big(camera + 18, 4), _hex("00000000"), _hex("00000001"), _big(F.col("c_custkey") % 500 + 2, 4))
    tiff = F.concat(_hex("4D4D002A00000008"), first, name, second)
    xmp = F.concat(F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="r" xmlns:dc="d" xmlns:xmp="p"><rdf:Description xmp:CreatorTool="Tool '), F.col("c_nationkey"), F.lit('"><dc:creator><rdf:Seq><rdf:li>'), F.col("c_name"), F.lit("</rdf:li><rdf:li>Studio &amp; Sons</rdf:li></rdf:Seq></dc:creator></rdf:Description></rdf:RDF></x:xmpmeta>"))
    table = F.concat(_hex("00"), F.unhex(F.repeat(F.lpad(F.hex(F.col("c_custkey") % 200 + 1), 2, "0"), 64)))
    mark = F.when(F.col("c_custkey") % 10 == 0, _text(F.lit("jumb....c2pa trainedAlgorithmicMedia"))).otherwise(_hex("00"))
    jpeg = F.concat(_hex("FFD8"), _segment("E0", _text(F.lit("JFIF\0\1"))), _segment("E1", F.concat(_text(F.lit("Exif\0\0")), tiff)), _segment("E1", _text(F.concat(F.lit("http://ns.adobe.com/xap/1.0/\0"), xmp))), _segment("DB", table), _segment("EB", mark), _hex("FFDA0002"), F.unhex(F.md5(F.col("c_name"))), _hex("FFD9"))
    return c.select(F.col("c_custkey").cast("string").alias("path"), jpeg.alias("content"))


def image_entries(spark, sf_dir):
    s = src.image_segments(_pictures(spark, sf_dir))
    e = metadata.exif_entries(s).select("path", "grp", "key", "value").union(metadata.xmp_entries(s).select("path", "grp", "key", "value"))
    return e


def image_quality(spark, sf_dir):
    return images.jpeg_quality(src.image_segments(_pictures(spark, sf_dir)))


def image_clean(spark, sf_dir):
    """What is left of each file's entries after it was cleaned: the orientation alone, where it is not upright; and the picture's data is the same."""
    files = _pictures(spark, sf_dir)
    s = src.image_segments(files)
    turn = metadata.exif_entries(s).filter("key = 'Orientation'").select("path", F.col("number").cast("int").alias("turn"))
    clean = images.sanitize(files, s, orientation=turn)
    left = src.image_segments(clean)
    entries = metadata.exif_entries(left).select("path", "key", "value").union(metadata.xmp_entries(left).select("path", "key", "value"))
    same = F.hex(F.substring("content", F.octet_length("content") - 17, F.lit(16)))
    return clean.select("path", F.lower(same).alias("data")).join(entries, "path", "left")


def image_technical(spark, sf_dir):
    """What is left of each file's entries after it was cleaned but for its technical tags."""
    files = _pictures(spark, sf_dir)
    s = src.image_segments(files)
    left = src.image_segments(images.sanitize(files, s, technical=metadata.technical_exif(s)))
    return metadata.exif_entries(left).select("path", "grp", "key", "value").union(metadata.xmp_entries(left).select("path", "grp", "key", "value"))


def image_kept(spark, sf_dir):
    """Segments of a kind, and whether they are needed to show the picture."""
    return images.keep_drop(src.image_segments(_pictures(spark, sf_dir))).groupBy("marker", "keep").agg(F.count("*").alias("n"))


def image_findings(spark, sf_dir):
    """Findings of pictures from their bytes alone."""
    files = _pictures(spark, sf_dir)
    s = src.image_segments(files)
    e = metadata.exif_entries(s).select(F.col("path").alias("file_id"), "key", "value").union(metadata.xmp_entries(s).select("path", "key", "value"))
    facts = files.select("path", content_marks(F.col("content")).alias("m")).join(images.jpeg_quality(s), "path", "left")
    facts = facts.select(F.col("path").alias("file_id"), "m.c2pa", "m.ai", "quality", F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))
    return tables.forensic_findings(e, facts).groupBy("id", "severity").agg(F.count("*").alias("n"))


def places(spark, sf_dir):
    """Places of pictures from the degrees, minutes and seconds of their entries."""
    c = read_table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    rows = F.array(*[F.struct(F.lit(n).alias("key"), v.cast("string").alias("value")) for n, v in (("GPSLatitude", F.concat((k % 90).cast("string"), F.lit(", 30, 36"))), ("GPSLatitudeRef", F.when(k % 2 == 0, "N").otherwise("S")), ("GPSLongitude", F.concat((k % 200).cast("string"), F.lit(", 15"))), ("GPSLongitudeRef", F.when(k % 3 == 0, "W").otherwise("E")))])
    e = c.select(k.cast("string").alias("path"), F.lit("gps").alias("grp"), F.inline(rows))
    return metadata.gps_locations(e).select("path", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


def package_parts(spark, sf_dir):
    """Suppliers as zip packages of one stored part."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    data, name = _text(F.col("s_name")), _text(F.concat(F.lit("part-"), F.col("s_suppkey").cast("string"), F.lit(".txt")))
    head = F.concat(_hex("1400000000000000210A"), _little(F.crc32(data), 4), _little(F.octet_length(data), 4), _little(F.octet_length(data), 4), _little(F.octet_length(name), 2), _hex("0000"))
    local = F.concat(_hex("504B0304"), head, name, data)
    central = F.concat(_hex("504B01021400"), head, _hex("00000000000000000000"), _hex("00000000"), name)
    end = F.concat(_hex("504B05060000000001000100"), _little(F.octet_length(central), 4), _little(F.octet_length(local), 4), _hex("0000"))
    files = s.select(F.col("s_suppkey").alias("path"), F.concat(local, central, end).alias("content"))
    return src.package_parts(files).select("path", "part", "size", F.decode("bytes", "UTF-8").alias("text"))


def packages_by_range(spark, sf_dir):
    """The suppliers of each nation as one package, an entry for each, of which every third is read again by its name."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    folder = _folder(spark)

    def write(key, group):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for k, name in sorted(zip(group["s_suppkey"].to_pylist(), group["s_name"].to_pylist())):
                z.writestr(f"{'names' if k % 3 == 0 else 'others'}/{k}.txt", name)
        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/{key[0].as_py()}.zip") as out:
            out.write(buffer.getvalue())
        return pa.table({"n": [group.num_rows]})

    s.groupBy("s_nationkey").applyInArrow(write, "n long").count()
    rows = packages.read_packages(spark, folder, parts="names/*", task_bytes=400)
    return rows.select(F.regexp_extract("path", "([0-9]+)[.]zip$", 1).cast("long").alias("nation"), "part", "size", F.decode("bytes", "UTF-8").alias("text"), "error")


def zip_kinds_by_mime(spark, sf_dir):
    """Packages that say in a part ``mimetype`` what they are."""
    p = read_table(spark, sf_dir, "part", "p_partkey")
    kinds = F.array(*map(F.lit, ("application/epub+zip", "application/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.spreadsheet", "application/zip")))
    parts = p.select(F.col("p_partkey").alias("file_id"), F.lit("mimetype").alias("path"), F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")).alias("xml"))
    return office.zip_kind(parts)


def pdf_marks(spark, sf_dir):
    """Versions and the form of text of files whose names and first bytes come from parts."""
    p = read_table(spark, sf_dir, "part", "p_partkey")
    k = F.col("p_partkey")
    content = F.concat(F.encode(F.concat(F.lit("\n%PDF-1."), (k % 8).cast("string"), F.lit("\n")), "ISO-8859-1"), _hex("E2E3"))
    name = F.concat(F.lit("file."), F.element_at(F.array(*map(F.lit, ("md", "HTM", "txt"))), (k % 3 + 1).cast("int")))
    return p.select("p_partkey", pdf_version(F.when(k % 5 == 0, F.substring(content, 5, 9)).otherwise(content)).alias("version"), text_format(name).alias("form"))


def pdf_attachments(spark, sf_dir):
    """Orders as files with their lines as attachments, named by part and ending by quantity, and a stored picture of every page."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    ends = F.element_at(F.array(*map(F.lit, (".PDF", ".txt", ".exe", ".Js", ".exe.zip", ""))), (F.col("l_quantity").cast("int") % 6 + 1))
    attached = li.select(F.col("l_orderkey").alias("file_id"), F.lit("EmbeddedFile").alias("action"), F.concat(F.col("l_partkey").cast("string"), ends).alias("target"))
    return office.object_findings(attached.union(li.filter("l_linenumber > 2").select("l_orderkey", F.lit("Thumb"), F.lit("x.exe"))))


def pdf_remarks(spark, sf_dir):
    """Findings of annotations, form fields and layers, one for each line of an order."""
    df = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag").withColumnRenamed("l_orderkey", "file_id")
    kind = F.when(F.col("l_returnflag") == "N", "Highlight").otherwise("Link")
    a = office.annotation_findings(df.select("file_id", kind.alias("subtype"), F.when(F.col("l_partkey") % 2 == 0, "Ann").otherwise(" ").alias("author"), F.lit(" ").alias("text")))
    f = office.form_findings(df.select("file_id", F.when(F.col("l_partkey") % 7 == 0, "signature").otherwise("text").alias("kind"), F.when(F.col("l_quantity") > 25, "x").otherwise(" ").alias("value")))
    l = office.layer_findings(df.select("file_id", F.lit("L").alias("name"), (F.col("l_quantity") < 40).alias("visible")))
    parts = [x.select("file_id", "id", "severity", "n") for x in (a, f, l)]
    return parts[0].union(parts[1]).union(parts[2])


def plural_texts(spark, sf_dir):
    """Catalogues in five languages that lack a category here and there, and the forms that numbers take."""
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_size")
    k = F.col("p_partkey")
    lang = F.element_at(F.array(*map(F.lit, ("en", "es", "fr", "de", "ar"))), (k % 5 + 1).cast("int"))
    forms = F.when(k % 2 == 0, F.create_map(F.lit("one"), F.lit("{n} file"), F.lit("other"), F.lit("{n} files"))).otherwise(F.create_map(F.lit("other"), F.lit("{n} files")))
    c = p.select(lang.alias("lang"), k.cast("string").alias("key"), forms.alias("forms"), plural_form(F.col("p_size") % 3, lang, forms).alias("shown"))
    gaps = tables.plural_gaps(c).select("lang", "key", F.array_join("missing", ",").alias("missing"))
    return c.select("lang", "key", "shown").join(gaps, ["lang", "key"], "left")


def form_values(spark, sf_dir):
    """Check boxes and lists: a list takes choices that are all offered, a read-only field none."""
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_size")
    k = F.col("p_partkey")
    texts = F.array().cast("array<string>")
    fields = p.select(k.alias("doc_id"), F.lit("f").alias("name"), F.when(k % 2 == 0, "checkbox").otherwise("list").alias("kind"), F.lit(None).cast("string").alias("value_s"), F.lit(False).alias("value_b"), texts.alias("value_l"), F.array(F.lit("a"), F.lit("b")).alias("options"), F.lit(None).cast("int").alias("max_length"), F.lit(False).alias("editable"), (F.col("p_size") > 40).alias("read_only"))
    values = p.select(k.alias("doc_id"), F.lit("f").alias("name"), F.lit(None).cast("string").alias("value_s"), F.lit(True).alias("value_b"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("b"))).alias("value_l"))
    return tables.apply_values(fields, values).select("doc_id", "value_b", F.array_join("value_l", ",").alias("value_l"))


def signer_names(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    k = F.col("c_custkey") % 4
    dn = F.when(k == 0, F.concat(F.lit("O=Org, CN="), "c_name")).when(k == 1, F.concat(F.lit("GN=Jane,SN="), "c_name")).when(k == 2, F.concat(F.lit("C=XX, O="), "c_name")).otherwise("")
    return c.select("c_custkey", tables.display_name(dn).alias("name"))


def _folder(spark):
    return f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"


def csv_rows(spark, sf_dir):
    """Parts written as CSV and read back, with quotes, commas and line breaks in their names."""
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    folder = _folder(spark)
    rows = p.select("p_partkey", F.concat(F.lit('"'), "p_name", F.lit(',\n"')).alias("p_name"), "p_size")
    rows.write.csv(folder, header=True, quote='"', escape='"')
    return src.read_csv_text(spark, folder, "p_partkey long, p_name string, p_size int").select("p_partkey", "p_name", F.col("p_size").cast("long").alias("p_size"))


def files_by_path(spark, sf_dir):
    """Nations written as files, one for each, and read as files in the order of their paths."""
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    folder = _folder(spark)
    src.write_groups(n.withColumn("k", F.col("n_nationkey")).repartition("k"), ["k"], folder)
    f = src.read_files(spark, folder, "*.parquet")
    key = F.regexp_extract("path", "k=([0-9]+)", 1).cast("long")
    rows = f.select(key.alias("n_nationkey"), (F.col("tab_order") == F.col("path")).alias("by_path"), (F.octet_length("content") == F.col("size")).alias("whole"))
    return rows.distinct()


def report_written(spark, sf_dir):
    """The report of all e-mail addresses, written as text and read again."""
    found = findings.pii_findings(read_table(spark, sf_dir, "documents", "doc_id", "text"), ["email"])
    folder = _folder(spark)
    src.write_report(findings.findings_report(found), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


def input_table(spark, sf_dir):
    """Certificates written as JSON and read with the schema that their operators expect."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    folder = _folder(spark)
    c.select(F.col("c_custkey").cast("string").alias("file_id"), F.col("c_name").alias("subject"), F.lit("root").alias("issuer"), F.lit(1).alias("other")).write.json(folder)
    return src.read_input_table(spark, folder, "certs", "json")


def odd_bytes(spark, sf_dir):
    """Names as UTF-16 with an odd byte at the end, and entities of half a pair: no row stops the job."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    wide = F.concat(_hex("FFFE"), F.encode("s_name", "UTF-16LE"), F.when(F.col("s_suppkey") % 2 == 0, _hex("41")).otherwise(_hex("00D8")))
    return s.select("s_suppkey", decode_text(wide).alias("text"), decode_entities(F.concat("s_name", F.lit("&#xD800;&#65;&#x1F600;"))).alias("entities"))


def chunks(spark, sf_dir):
    """Texts cut into chunks of sentences, none longer than 1000 characters and together the whole text but for white space."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    d = d.withColumn("text", F.concat(F.lit("!?! "), F.coalesce("text", F.lit(""))))
    c = sentence_chunks(F.col("text"))
    letters = F.regexp_replace(F.array_join("c", ""), r"\s", "")
    return d.select("doc_id", c.alias("c")).select("doc_id", (F.array_max(F.transform("c", lambda x: F.length(x))) <= 1000).alias("short"), F.sha2(letters, 256).alias("sha"))


def _probes(spark, sf_dir):
    """Events as media files: a sideways video, a sound track, a cover, tags of the file, of a track and of a chapter."""
    e = read_table(spark, sf_dir, "events", "event_id")
    k = F.col("event_id").cast("string")
    json = F.concat(
        F.lit('{"streams":[{"codec_type":"video","codec_name":"h264","width":1920,"height":'), (F.col("event_id") % 1000).cast("string"), F.lit(',"avg_frame_rate":"30000/1001","color_transfer":"'), F.when(F.col("event_id") % 5 == 0, "smpte2084").otherwise("bt709"),
        F.lit('","side_data_list":[{"rotation":-90}],"tags":{"handler_name":"x","creation_time":"'), k, F.lit('"}},{"codec_type":"audio","codec_name":"aac","sample_rate":"48000","channels":2},{"codec_type":"video","codec_name":"mjpeg","disposition":{"attached_pic":1}}],'),
        F.lit('"format":{"format_name":"mp4","duration":"'), k, F.lit('.5","bit_rate":"1000","tags":{"com.apple.quicktime.location.ISO6709":"+10.5-020.25/","title-eng":" T'), k, F.lit(' "}},"chapters":[{"tags":{"title":"One"}}]}'),
    )
    return e.select("event_id", json.alias("json"))


def tracks(spark, sf_dir):
    t = media.track_facts(_probes(spark, sf_dir), "event_id")
    return t.select("event_id", F.col("track").cast("long").alias("track"), "kind", "codec", *[F.col(c).cast("long").alias(c) for c in ("width", "height", "rotation", "channels")], "fps", "hdr", "sample_rate")


def media_tags(spark, sf_dir):
    return media.media_tags(_probes(spark, sf_dir), "event_id")


def media_summary(spark, sf_dir):
    s = media.media_summary(_probes(spark, sf_dir), "event_id")
    return s.select("event_id", "duration", "bit_rate", *[F.col(c).cast("long").alias(c) for c in ("video", "audio", "subtitles")], "cover", F.array_join("groups", ",").alias("groups"))


QUERIES = {f.__name__: f for f in (image_entries, image_quality, image_clean, image_technical, image_kept, image_findings, package_parts, packages_by_range, zip_kinds_by_mime, pdf_marks, pdf_attachments, pdf_remarks, plural_texts, form_values, signer_names, csv_rows, files_by_path, report_written, input_table, odd_bytes, media_tags, media_summary)} | {"image_places": places, "media_tracks": tracks, "text_chunks_whole": chunks}
_Q = "greatest(1, least(100, floor(CASE WHEN s = 64 THEN 100 WHEN s * 100.0 / 3688 <= 100 THEN (200 - s * 100.0 / 3688) / 2 ELSE 5000 / (s * 100.0 / 3688) END + 0.5)))::INT"
SQL = {
    "image_entries": """SELECT c_custkey::VARCHAR AS path, 'image' AS grp, 'Make' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'image', 'Orientation', (c_custkey % 8 + 1)::VARCHAR FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'exif', 'ExposureTime', '1/' || (c_custkey % 500 + 2) || ' s' FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'xmp', 'xmp:CreatorTool', 'Tool ' || c_nationkey FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'xmp', 'dc:creator', c_name || ', Studio & Sons' FROM customer""",
    "image_quality": f"SELECT c_custkey::VARCHAR AS path, {_Q} AS quality FROM (SELECT c_custkey, (c_custkey % 200 + 1) * 64 AS s FROM customer)",
    "image_technical": "SELECT c_custkey::VARCHAR AS path, 'image' AS grp, 'Orientation' AS key, (c_custkey % 8 + 1)::VARCHAR AS value FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'exif', 'ExposureTime', '1/' || (c_custkey % 500 + 2) || ' s' FROM customer",
    "image_clean": "SELECT c_custkey::VARCHAR AS path, md5(c_name) AS data, CASE WHEN c_custkey % 8 > 0 THEN 'Orientation' END AS key, CASE WHEN c_custkey % 8 > 0 THEN (c_custkey % 8 + 1)::VARCHAR END AS value FROM customer",
    "image_kept": "SELECT marker, keep, (n * times)::BIGINT AS n FROM (SELECT count(*) AS n FROM customer), (VALUES ('E0', true, 1), ('E1', false, 2), ('DB', true, 1), ('EB', false, 1)) v(marker, keep, times)",
    "image_findings": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 10 = 0) AS m FROM customer)
SELECT 'ai' AS id, 'high' AS severity, m AS n FROM c UNION ALL SELECT 'c2pa', 'info', m FROM c UNION ALL SELECT 'camera', 'info', n FROM c UNION ALL SELECT 'quality', 'info', n FROM c UNION ALL SELECT 'software', 'info', n FROM c""",
    "image_places": "SELECT c_custkey::VARCHAR AS path, round(((c_custkey % 90 + 0.51) * CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE, 6) AS latitude, round(((c_custkey % 200 + 0.25) * CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 1 END)::DOUBLE, 6) AS longitude FROM customer WHERE c_custkey % 200 < 180",
    "packages_by_range": "SELECT s_nationkey AS nation, 'names/' || s_suppkey || '.txt' AS part, strlen(s_name)::BIGINT AS size, s_name AS text, NULL::VARCHAR AS error FROM supplier WHERE s_suppkey % 3 = 0",
    "package_parts": "SELECT s_suppkey AS path, 'part-' || s_suppkey || '.txt' AS part, strlen(s_name)::BIGINT AS size, s_name AS text FROM supplier",
    "zip_kinds_by_mime": "SELECT p_partkey AS file_id, CASE p_partkey % 4 WHEN 0 THEN 'EPUB e-book' WHEN 1 THEN 'OpenDocument text' WHEN 2 THEN 'OpenDocument spreadsheet' ELSE 'ZIP archive' END AS kind FROM part",
    "pdf_marks": "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN '1.' || (p_partkey % 8) END AS version, ['markdown', 'html', 'text'][(p_partkey % 3 + 1)::INT] AS form FROM part",
    "pdf_attachments": """SELECT l_orderkey AS file_id, 'attachments' AS id, count(*) AS n, count(*) FILTER (l_quantity::INT % 6 IN (2, 3)) AS programs, 'high' AS severity FROM lineitem GROUP BY 1
UNION ALL SELECT l_orderkey, 'thumbnails', count(*), 0, 'medium' FROM lineitem WHERE l_linenumber > 2 GROUP BY 1""",
    "pdf_remarks": """WITH g AS (SELECT l_orderkey AS file_id, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS notes, count(*) FILTER (l_returnflag = 'N' AND l_partkey % 2 = 0) AS named, count(*) FILTER (l_partkey % 7 <> 0 AND l_quantity > 25) AS filled,
  count(*) FILTER (l_partkey % 7 = 0 AND l_quantity > 25) AS signed, count(*) FILTER (l_quantity >= 40) AS hidden FROM lineitem GROUP BY 1)
SELECT file_id, 'comments' AS id, CASE WHEN named > 0 THEN 'high' ELSE 'medium' END AS severity, notes AS n FROM g WHERE notes > 0 UNION ALL SELECT file_id, 'form', CASE WHEN filled > 0 THEN 'medium' ELSE 'info' END, n FROM g
UNION ALL SELECT file_id, 'signatures', 'info', signed FROM g WHERE signed > 0 UNION ALL SELECT file_id, CASE WHEN hidden > 0 THEN 'layers' ELSE 'layers-info' END, CASE WHEN hidden > 0 THEN 'high' ELSE 'info' END, CASE WHEN hidden > 0 THEN hidden ELSE n END FROM g""",
    "plural_texts": """WITH p AS (SELECT p_partkey::VARCHAR AS key, p_partkey % 2 = 0 AS two, ['en', 'es', 'fr', 'de', 'ar'][(p_partkey % 5 + 1)::INT] AS lang, p_size % 3 AS n FROM part)
SELECT lang, key, n || CASE WHEN two AND (n = 1 OR (n = 0 AND lang = 'fr')) THEN ' file' ELSE ' files' END AS shown,
       nullif(concat_ws(',', CASE WHEN lang = 'ar' THEN 'zero' END, CASE WHEN NOT two THEN 'one' END, CASE WHEN lang = 'ar' THEN 'two,few' END, CASE WHEN lang IN ('ar', 'es', 'fr') THEN 'many' END), '') AS missing FROM p""",
    "form_values": "SELECT p_partkey AS doc_id, p_partkey % 2 = 0 AND p_size <= 40 AS value_b, CASE WHEN p_partkey % 2 = 1 AND p_size <= 40 AND p_partkey % 3 > 0 THEN 'b' ELSE '' END AS value_l FROM part",
    "signer_names": "SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'Jane ' || c_name WHEN 3 THEN 'Unnamed' ELSE c_name END AS name FROM customer",
    "csv_rows": "SELECT p_partkey, '\"' || p_name || ',' || chr(10) || '\"' AS p_name, p_size::BIGINT AS p_size FROM part",
    "files_by_path": "SELECT n_nationkey, true AS by_path, true AS whole FROM nation",
    "report_written": r"WITH m AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}')) AS v, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}'), 1) AS k, regexp_split_to_array(text, '[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}') AS g, regexp_extract_all(text, '[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}') AS a FROM documents) SELECT 'email' || chr(9) || v || chr(9) || (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(a[1:k - 1], lambda x: length(x))), 0))::BIGINT AS line FROM m",
    "input_table": "SELECT c_custkey::VARCHAR AS file_id, c_name AS subject, 'root' AS issuer FROM customer",
    "odd_bytes": "SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE chr(65533) END AS text, s_name || '&#xD800;A' || chr(128512) AS entities FROM supplier",
    "text_chunks_whole": r"SELECT doc_id, true AS short, sha256(regexp_replace('!?! ' || coalesce(text, ''), '\s', '', 'g')) AS sha FROM documents",
    "media_tracks": """SELECT event_id, 0::BIGINT AS track, 'video' AS kind, 'h264' AS codec, (event_id % 1000)::BIGINT AS width, 1920::BIGINT AS height, 270::BIGINT AS rotation, NULL::BIGINT AS channels, 29.97::DOUBLE AS fps, event_id % 5 = 0 AS hdr, NULL::DOUBLE AS sample_rate FROM events
UNION ALL SELECT event_id, 1, 'audio', 'aac', NULL, NULL, NULL, 2, NULL, NULL, 48000 FROM events UNION ALL SELECT event_id, 2, 'cover', 'mjpeg', 0, 0, 0, NULL, NULL, false, NULL FROM events""",
    "media_tags": """SELECT event_id, 'file' AS place, 'location' AS grp, 'com.apple.quicktime.location.ISO6709' AS tag, '10.5, -20.25' AS value FROM events UNION ALL SELECT event_id, 'file', 'text', 'title-eng', 'T' || event_id FROM events
UNION ALL SELECT event_id, 'video track', 'dates', 'creation_time', event_id::VARCHAR FROM events UNION ALL SELECT event_id, 'chapter 1', 'text', 'title', 'One' FROM events""",
    "media_summary": "SELECT event_id, (event_id + 0.5)::DOUBLE AS duration, 1000::DOUBLE AS bit_rate, 1::BIGINT AS video, 1::BIGINT AS audio, 0::BIGINT AS subtitles, true AS cover, 'dates,location,text' AS groups FROM events",
}
