"""EXIF tags and XMP properties of image segments ``key, seq, marker, start, length, bytes`` as metadata entries."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.metadata import TECHNICAL_EXIF, TECHNICAL_IMAGE, camera_value, format_value

# Names of tags, in their blocks; the bytes of each type's values; where packets begin; XMP's own elements and attributes.
TAGS = {
    "image": {
        0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software",
        0x0132: "ModifyDate", 0x013B: "Artist", 0x013C: "HostComputer", 0x0213: "YCbCrPositioning", 0x8298: "Copyright", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject",
    },
    "exif": {
        0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "ISO", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "CreateDate", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal",
        0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9204: "ExposureCompensation", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x927C: "MakerNote", 0x9286: "UserComment",
        0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal", 0x9292: "SubSecTimeDigitized", 0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA402: "ExposureMode", 0xA403: "WhiteBalance",
        0xA405: "FocalLengthIn35mmFormat", 0xA406: "SceneCaptureType", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA432: "LensInfo", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber",
    },
    "gps": {0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 16: "GPSImgDirectionRef", 17: "GPSImgDirection", 29: "GPSDateStamp"},
}
POINTERS = {0x8769: "exif", 0x8825: "gps"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
EXIF_HEAD, XMP_HEAD, XMP_KEYWORD = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"XML:com.adobe.xmp\0"
CONTAINERS = set("x:xmpmeta x:xapmeta rdf:RDF rdf:Description rdf:Seq rdf:Bag rdf:Alt rdf:li".split())
SILENT = set("rdf:about rdf:parseType xml:lang rdf:resource".split())
ENTRY = "grp string, tag int, key string, value string, number double"
_FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def _value(kind: int, raw: bytes, order: str) -> tuple[str, float | None]:
    """The text of a tag's value, and its number where it is one."""
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace").strip(), None
    if kind == 7:
        code, body = raw[:8].rstrip(b"\0"), raw[8:]
        if code in (b"ASCII", b"UNICODE"):
            return body.decode("latin-1" if code == b"ASCII" else "utf-16-be" if order == ">" else "utf-16-le", "replace").strip("\0 "), None
        return (raw.decode("ascii") if raw.isascii() and raw.decode("ascii").isprintable() else f"{len(raw)} bytes"), None
    if kind in (5, 10):
        parts = struct.unpack(f"{order}{len(raw) // 4}{'I' if kind == 5 else 'i'}", raw)
        numbers = [a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2])]
    else:
        numbers = list(struct.unpack(f"{order}{len(raw) // SIZES[kind]}{_FORMATS[kind]}", raw))
    return ", ".join(f"{x:.10g}" for x in numbers), float(numbers[0]) if len(numbers) == 1 else None


def raw_tags(tiff: bytes) -> tuple[str, list[tuple[str, int, int, bytes]]]:
    """The byte order, and (block, tag, type, bytes) of a TIFF block's tags; those outside of it or of no known type are passed over."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    if not order or len(tiff) < 8:
        return "", []
    out, work, seen = [], [("image", struct.unpack(order + "I", tiff[4:8])[0])], set()
    while work:
        block, at = work.pop()
        if at in seen or at < 8 or at + 2 > len(tiff):
            continue
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", tiff, at)
        if at + 2 + 12 * n > len(tiff):
            continue
        for k in range(n):
            place = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, place)
            size = SIZES.get(kind, 0) * count
            begin = place + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, place + 8)[0]
            if not size or begin + size > len(tiff):
                continue
            if block == "image" and tag in POINTERS and size == 4:
                work.append((POINTERS[tag], struct.unpack_from(order + "I", tiff, begin)[0]))
            elif block != "thumbnail" or tag == 0x0202:
                out.append((block, tag, kind, tiff[begin : begin + size]))
        if block == "image" and at + 6 + 12 * n <= len(tiff):
            after = struct.unpack_from(order + "I", tiff, at + 2 + 12 * n)[0]
            work += [("thumbnail", after)] if after else []
    return order, sorted(out, key=lambda x: (["image", "exif", "gps", "thumbnail"].index(x[0]), x[1]))


def exif_tags(tiff: bytes) -> list[tuple]:
    """(block, tag, name, text, number) of a TIFF block."""
    order, raw = raw_tags(tiff)
    out: list[tuple] = []
    for block, tag, kind, data in raw:
        if block == "thumbnail":
            if len(data) >= 4:
                out.append((block, tag, "IFD1", f"{struct.unpack_from(order + 'I', data)[0]} bytes", None))
        else:
            out.append((block, tag, TAGS[block].get(tag, f"0x{tag:04X}"), *_value(kind, data, order)))
    return out


def _block(order: str, at: int, tags: list[tuple[int, int, bytes]]) -> bytes:
    """A block of tags that begins at ``at``, with the values that do not fit into it behind it."""
    head, rest = struct.pack(order + "H", len(tags)), b""
    begin = at + 2 + 12 * len(tags) + 4
    for tag, kind, data in sorted(tags):
        head += struct.pack(order + "HHI", tag, kind, len(data) // SIZES[kind])
        if len(data) <= 4:
            head += data.ljust(4, b"\0")
        else:
            head += struct.pack(order + "I", begin + len(rest))
            rest += data + b"\0" * (len(data) % 2)
    return head + b"\0" * 4 + rest


def technical_tiff(tiff: bytes, orientation: bool = True) -> bytes | None:
    """A TIFF block with the technical tags of another alone, and its orientation if asked; null where nothing would be left."""
    order, raw = raw_tags(tiff)
    image = [(tag, kind, data) for block, tag, kind, data in raw if block == "image" and (tag in TECHNICAL_IMAGE or (orientation and tag == 0x0112))]
    exif = [(tag, kind, data) for block, tag, kind, data in raw if block == "exif" and tag in TECHNICAL_EXIF]
    if not image and not exif:
        return None
    if exif:
        image.append((0x8769, 4, b"\0" * 4))
    size = len(_block(order, 8, image))
    if exif:
        image[-1] = (0x8769, 4, struct.pack(order + "I", 8 + size))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + _block(order, 8, image) + (_block(order, 8 + size, exif) if exif else b"")


def xmp_properties(packet: bytes) -> list[tuple[str, str]]:
    """(name, text) of attributes and elements in order; of a packet that is not well formed, those before the fault."""
    stack: list[str] = []
    out: list[tuple[str, str]] = []

    def begin(name: str, attributes: dict[str, str]) -> None:
        out.extend((k, v.strip()) for k, v in attributes.items() if k not in SILENT and not k.startswith("xmlns") and v.strip())
        stack.append(name)

    def text(data: str) -> None:
        owner = next((n for n in reversed(stack) if n not in CONTAINERS), None)
        if owner and data.strip():
            out.append((owner, data.strip()))

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, lambda name: stack.pop(), text
    try:
        parser.Parse(packet.strip(b"\0 \r\n\t"), True)
    except (expat.ExpatError, LookupError, ValueError):  # also encodings that are not known or of several bytes
        pass
    return out


def _entries(segments: DataFrame, key: str, read) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *e) for k, (marker, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))) for e in read(marker, data.as_py() or b"")]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64())
            keys = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[j + 1] for r in rows], t) for j, t in enumerate(kinds))], names=[key, "grp", "tag", "key", "value", "number"])

    used = segments.filter(F.col("marker").isin("E1", "eXIf", "iTXt")).select(key, "marker", "bytes")
    return used.mapInArrow(run, f"{key} {segments.schema[key].dataType.simpleString()}, {ENTRY}")


def exif_entries(segments: DataFrame, key: str = "path") -> DataFrame:
    """``key, grp, tag, key, value, number``: the tags of JPEG and PNG files. Groups: image, exif, gps, thumbnail. Settings are shown as cameras do."""

    def read(marker: str, data: bytes) -> list[tuple]:
        tiff = data if marker == "eXIf" else data[6:] if marker == "E1" and data.startswith(EXIF_HEAD) else b""
        return exif_tags(tiff)

    rows = _entries(segments, key, read)
    settings = F.col("key").isin("ExposureTime", "FNumber", "FocalLength", "FocalLengthIn35mmFormat") & F.col("number").isNotNull()
    return rows.withColumn("value", F.when(settings, camera_value(F.col("key"), F.col("number"))).otherwise(format_value(F.col("value"))))


def technical_exif(segments: DataFrame, key: str = "path", orientation: bool = True) -> DataFrame:
    """``key, tiff``: for files with EXIF a block of its technical tags alone, for ``images.sanitize``; files without any have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(m, x.as_py() or b"") for m, x in zip(batch.column(1).to_pylist(), batch.column(2))]
            made = [technical_tiff(d if m == "eXIf" else d[6:], orientation) if m == "eXIf" or d.startswith(EXIF_HEAD) else None for m, d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(made, pa.binary())], names=[key, "seq", "tiff"])

    used = segments.filter(F.col("marker").isin("E1", "eXIf")).select(key, "marker", "bytes", "seq")
    rows = used.mapInArrow(run, f"{key} {segments.schema[key].dataType.simpleString()}, seq int, tiff binary").filter("tiff is not null")
    return rows.groupBy(key).agg(F.min_by("tiff", "seq").alias("tiff"))


def xmp_entries(segments: DataFrame, key: str = "path") -> DataFrame:
    """``key, grp, key, value``: XMP properties of JPEG and PNG files, the distinct values of a name joined by commas."""

    def read(marker: str, data: bytes) -> list[tuple]:
        packet = b""
        if marker == "E1" and data.startswith(XMP_HEAD):
            packet = data[len(XMP_HEAD) :]
        elif marker == "iTXt" and data.startswith(XMP_KEYWORD) and data[len(XMP_KEYWORD) : len(XMP_KEYWORD) + 1] == b"\0":
            packet = data[len(XMP_KEYWORD) + 2 :].split(b"\0", 2)[-1]
        return [("xmp", k, name, value, None) for k, (name, value) in enumerate(xmp_properties(packet))]

    rows = _entries(segments, key, read)
    values = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("tag", "value"))), lambda s: s["value"]))
    return rows.groupBy(key, "grp", F.col("key").alias("_name")).agg(format_value(F.array_join(values, ", ")).alias("value")).withColumnRenamed("_name", "key") if key != "key" else rows


def gps_locations(entries: DataFrame, key: str = "path") -> DataFrame:
    """``key, latitude, longitude`` of files whose EXIF entries hold a place on Earth."""
    parts = F.transform(F.split("value", ", "), lambda p: p.try_cast("double"))
    degrees = F.coalesce(F.get(parts, F.lit(0)), F.lit(0.0)) + F.coalesce(F.get(parts, F.lit(1)), F.lit(0.0)) / 60 + F.coalesce(F.get(parts, F.lit(2)), F.lit(0.0)) / 3600
    pick = lambda name, c: F.max(F.when(F.col("key") == name, c))
    g = entries.filter("grp = 'gps'").groupBy(key).agg(pick("GPSLatitude", degrees).alias("lat"), pick("GPSLongitude", degrees).alias("lon"), pick("GPSLatitudeRef", F.col("value")).alias("ns"), pick("GPSLongitudeRef", F.col("value")).alias("ew"))
    sign = lambda c, low: F.when(F.upper(F.col(c)) == low, -1).otherwise(1)
    out = g.select(key, (F.col("lat") * sign("ns", "S")).alias("latitude"), (F.col("lon") * sign("ew", "W")).alias("longitude"))
    return out.filter((F.abs("latitude") <= 90) & (F.abs("longitude") <= 180))
