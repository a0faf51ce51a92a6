"""Files and packages as rows, and tables as files."""

from __future__ import annotations

import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The marks of image files, and schemas of decoded tables.
JPEG, PNG = b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n"
TABLES = {
    "text_items": "doc_id string, page int, item_no int, text string, x double, y double, width double, size double, bold boolean, italic boolean, page_width double, page_height double",
    "annotations": "doc_id string, page int, annot_no int, subtype string, author string, text string, x1 double, y1 double, x2 double, y2 double",
    "links": "doc_id string, page int, kind string, value string, shown string",
    "metadata_entries": "file_id string, stage string, grp string, key string, value string",
    "pdf_nodes": "file_id string, node string, type string, subtype string",
    "pdf_edges": "file_id string, src string, dst string",
    "pdf_roots": "file_id string, node string",
    "signatures": "file_id string, field string, kind string, end bigint, file_length bigint, intact boolean, signed_at timestamp, not_before timestamp, not_after timestamp",
    "certs": "file_id string, subject string, issuer string",
    "fields": "doc_id string, name string, kind string, value_s string, value_b boolean, value_l array<string>, options array<string>, max_length int, editable boolean, read_only boolean",
    "bookmarks": "doc_id string, seq int, title string, page int, level int",
    "catalog": "lang string, area string, key string, text string, forms map<string,string>",
}
_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
OCR = f"confidence double, blocks array<struct<paragraphs:array<struct<is_ltr:boolean,lines:array<struct<baseline:{_BOX},bbox:{_BOX},words:array<struct<text:string,confidence:double,bbox:{_BOX}>>>>>>>>"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, name, size, content, tab_order`` of the files under ``path``; ``content`` is read only where it is used, and ``tab_order`` is the path."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), F.col("length").alias("size"), "content", F.col("path").alias("tab_order"))


def read_input_table(spark: SparkSession, path: str, name: str, form: str = "parquet") -> DataFrame:
    """A decoded table with the schema that its operators expect."""
    return spark.read.schema(TABLES[name]).format(form).load(path)


def read_csv_text(spark: SparkSession, path: str, schema: str, tabs: bool = False) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep="\t" if tabs else ",", quote='"', escape='"', multiLine=True)


#: What reading a damaged or unknown kind of package, or an entry of one, can raise.
BAD_ENTRY = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, OSError, EOFError, NotImplementedError, RuntimeError, ValueError, IndexError, struct.error)


def read_entry(z: zipfile.ZipFile, entry: zipfile.ZipInfo, names_only: bool = False) -> tuple[bytes | None, str | None]:
    """An entry's bytes, or why there are none."""
    if names_only:
        return None, None
    try:
        return z.read(entry), None
    except BAD_ENTRY as e:
        return None, f"{type(e).__name__}: {e}"[:200]


def package_parts(files: DataFrame, key: str = "path", content: str = "content", names_only: bool = False) -> DataFrame:
    """``key, part_no, part, size, bytes, error`` of every entry of zip packages; files that are none have no rows.

    An entry that can't be read has null bytes and says why; the others of its package are read all the same. A package is one value
    here; ``sources.packages`` reads large ones by ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, data in enumerate(batch.column(1)):
                try:
                    z = zipfile.ZipFile(io.BytesIO(data.as_py() or b""))
                except BAD_ENTRY:
                    continue
                rows += [(k, n, i.filename, i.file_size, *read_entry(z, i, names_only)) for n, i in enumerate(z.infolist())]
            keys = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[j + 1] for r in rows], t) for j, t in enumerate(kinds))], names=[key, "part_no", "part", "size", "bytes", "error"])

    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, part_no int, part string, size long, bytes binary, error string")


def _segments(data: bytes) -> list[tuple[str, int, int, bytes]]:
    """(marker or type, start, length, payload) of a JPEG's segments or a PNG's chunks; as far as they can be read."""
    out = []
    if data.startswith(JPEG):
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
            (n,) = struct.unpack(">H", data[at + 2 : at + 4])
            out.append((f"{data[at + 1]:02X}", at, n + 2, data[at + 4 : at + 2 + n]))
            at += n + 2
    elif data.startswith(PNG):
        at = 8
        while at + 12 <= len(data):
            (n,) = struct.unpack(">I", data[at : at + 4])
            out.append((data[at + 4 : at + 8].decode("latin-1"), at, n + 12, data[at + 8 : at + 8 + n]))
            at += n + 12
    return out


def image_segments(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``key, seq, marker, start, length, bytes`` of JPEG segments and PNG chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, *s) for k, data in enumerate(batch.column(1)) for n, s in enumerate(_segments(data.as_py() or b""))]
            keys = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[j + 1] for r in rows], t) for j, t in enumerate(kinds))], names=[key, "seq", "marker", "start", "length", "bytes"])

    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, seq int, marker string, start long, length long, bytes binary")


def parse_ocr(df: DataFrame, keys: list[str], json: str = "json", scale: Column | None = None) -> DataFrame:
    """``par, line, word, text, x, width, baseline`` of OCR JSON, in points; marks of low confidence without letters are left out."""
    scale = F.lit(1.0) if scale is None else scale
    d = df.select(*keys, scale.alias("_scale"), F.from_json(json, OCR)["blocks"].alias("_b"))
    d = d.select(*keys, "_scale", F.posexplode("_b").alias("block", "_b")).select(*keys, "_scale", "block", F.posexplode("_b.paragraphs").alias("par", "_p"))
    d = d.select(*keys, "_scale", "block", "par", F.posexplode("_p.lines").alias("line", "_l")).select(*keys, "_scale", "block", "par", "line", "_l", F.posexplode("_l.words").alias("word", "_w"))
    d = d.filter((F.trim("_w.text") != "") & ~(~F.col("_w.text").rlike(r"[\p{L}\p{N}]") & (F.col("_w.confidence") < 50)))
    run = F.col("_l.baseline.x1") - F.col("_l.baseline.x0")
    slope = F.when(run != 0, (F.col("_l.baseline.y1") - F.col("_l.baseline.y0")) / run).otherwise(0.0)
    base = (F.col("_l.baseline.y0") + slope * (F.col("_w.bbox.x0") - F.col("_l.baseline.x0"))) / F.col("_scale")
    return d.select(*keys, "block", "par", "line", "word", F.trim("_w.text").alias("text"), (F.col("_w.bbox.x0") / F.col("_scale")).alias("x"), ((F.col("_w.bbox.x1") - F.col("_w.bbox.x0")) / F.col("_scale")).alias("width"), base.alias("baseline"))


def write_groups(df: DataFrame, columns: list[str], folder: str) -> None:
    """A folder for each group."""
    df.write.partitionBy(*columns).parquet(folder)


def write_report(lines: DataFrame, folder: str) -> None:
    lines.select("line").write.text(folder)
