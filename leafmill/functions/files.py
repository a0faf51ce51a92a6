"""Files: true type by content, names, hashes, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.metadata import AI_SOURCE

# Extensions, MIME types and signatures.
PROGRAMS = "exe scr com pif bat cmd vbs vbe js jse wsf wsh hta ps1 psm1 msi msp jar lnk cpl reg dll iso img vhd vhdx apk app dmg pkg sh command scf url inf".split()
MACROS = "docm dotm xlsm xltm xlam pptm potm ppsm".split()
TEXTS = "txt csv tsv md markdown log json xml html htm svg css js mjs ts tsx jsx yml yaml ini cfg conf toml sql sh bash zsh bat cmd ps1 psm1 vbs py rb pl php java c h cpp hpp cs go rs swift kt srt vtt ics vcf eml rtf tex bib gitignore env properties"
KINDS = {
    "pdf": ".pdf application/pdf",
    "image": ".jpg .jpeg .png .webp .heic .heif .avif image/jpeg image/png image/webp image/heic image/heif image/avif",
    "word": ".docx application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "excel": ".xlsx .xls .ods .csv application/vnd.openxmlformats-officedocument.spreadsheetml.sheet application/vnd.ms-excel application/vnd.oasis.opendocument.spreadsheet text/csv",
    "powerpoint": ".pptx application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "text": ".txt .md .markdown .html .htm text/plain text/markdown text/x-markdown text/html",
    "video": ".mp4 .m4v .mov .webm .mkv .avi .3gp .3g2 .wmv .flv .mpg .mpeg .mts .m2ts .ogv video/mp4 video/x-m4v video/quicktime video/webm video/x-matroska video/x-msvideo video/avi video/3gpp video/3gpp2 video/x-ms-wmv video/x-flv video/mpeg video/ogg",
    "audio": ".mp3 .wav .m4a .aac .ogg .oga .opus .flac .wma .aif .aiff .amr .weba audio/mpeg audio/mp3 audio/wav audio/x-wav audio/wave audio/mp4 audio/x-m4a audio/aac audio/ogg audio/opus audio/flac audio/x-flac audio/x-ms-wma audio/aiff audio/x-aiff audio/amr audio/webm",
}
#: In order: name, category, offset, bytes in hexadecimal.
SIGNATURES = [
    ("PNG image", "image", 0, "89504E47"),
    ("JPEG image", "image", 0, "FFD8FF"),
    ("GIF image", "image", 0, "474946383761"),
    ("GIF image", "image", 0, "474946383961"),
    ("WebP image", "image", 8, "57454250"),
    ("WAV audio", "audio", 8, "57415645"),
    ("AVI video", "video", 8, "41564920"),
    ("TIFF image (or camera raw)", "image", 0, "49492A00"),
    ("TIFF image (or camera raw)", "image", 0, "4D4D002A"),
    ("Windows icon", "image", 0, "00000100"),
    ("Photoshop document", "image", 0, "38425053"),
    ("ZIP archive", "archive", 0, "504B0304"),
    ("ZIP archive", "archive", 0, "504B0506"),
    ("RAR archive", "archive", 0, "526172211A07"),
    ("7-Zip archive", "archive", 0, "377ABCAF271C"),
    ("Gzip archive", "archive", 0, "1F8B"),
    ("Bzip2 archive", "archive", 0, "425A68"),
    ("XZ archive", "archive", 0, "FD377A585A00"),
    ("Zstandard archive", "archive", 0, "28B52FFD"),
    ("Windows cabinet archive", "archive", 0, "4D534346"),
    ("TAR archive", "archive", 257, "7573746172"),
    ("Disc image (ISO)", "program", 32769, "4344303031"),
    ("Disc image (ISO)", "program", 34817, "4344303031"),
    ("Disc image (ISO)", "program", 36865, "4344303031"),
    ("Windows program", "program", 0, "4D5A"),
    ("Linux program (ELF)", "program", 0, "7F454C46"),
    ("Mac program (Mach-O)", "program", 0, "FEEDFACE"),
    ("Mac program (Mach-O)", "program", 0, "FEEDFACF"),
    ("Mac program (Mach-O)", "program", 0, "CEFAEDFE"),
    ("Mac program (Mach-O)", "program", 0, "CFFAEDFE"),
    ("Mac program or Java class", "program", 0, "CAFEBABE"),
    ("Office 97–2003 file or Windows Installer (OLE)", "document", 0, "D0CF11E0A1B11AE1"),
    ("Windows shortcut", "program", 0, "4C00000001140200"),
    ("WebAssembly module", "program", 0, "0061736D"),
    ("SQLite database", "data", 0, "53514C69746520666F726D61742033"),
    ("MP3 audio", "audio", 0, "494433"),
    ("MP3 audio", "audio", 0, "FFFB"),
    ("MP3 audio", "audio", 0, "FFF3"),
    ("MP3 audio", "audio", 0, "FFF2"),
    ("FLAC audio", "audio", 0, "664C6143"),
    ("Ogg audio or video", "audio", 0, "4F676753"),
    ("MIDI music", "audio", 0, "4D546864"),
    ("Flash video", "video", 0, "464C56"),
    ("WOFF font", "font", 0, "774F4646"),
    ("WOFF2 font", "font", 0, "774F4632"),
    ("OpenType font", "font", 0, "4F54544F"),
    ("TrueType font", "font", 0, "0001000000"),
    ("Rich Text document", "document", 0, "7B5C727466"),
]
BRANDS = [("HEIC image", "image", "^(heic|heix|hevc|hevx|heim|heis|mif1|msf1)$"), ("AVIF image", "image", "^(avif|avis)$"), ("QuickTime video", "video", "^qt  $"), ("MPEG-4 audio", "audio", "^M4A "), ("3GP video", "video", "^3g"), ("Canon raw photo", "image", "^crx ")]
BIDI = "[‪-‮⁦-⁩‎‏]"
UNITS = ["KB", "MB", "GB"]


def _ascii(content: Column, at: int, n: int) -> Column:
    return F.decode(F.substring(content, at + 1, n), "ISO-8859-1")


def detect_type(content: Column) -> Column:
    """``name, category`` of what the bytes are, null where unknown; only the needed bytes are looked at."""
    kind = lambda name, category: F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"))
    riff = _ascii(content, 0, 4) == "RIFF"
    out = F.when(_ascii(content, 0, 1024).contains("%PDF-"), kind("PDF document", "document"))
    brand, box = _ascii(content, 8, 4), _ascii(content, 4, 4) == "ftyp"
    for name, category, at, mark in SIGNATURES:
        same = F.substring(content, at + 1, len(mark) // 2) == F.unhex(F.lit(mark))
        if name.startswith("TIFF") and mark == "49492A00":
            for b, c, pattern in BRANDS:
                out = out.when(box & brand.rlike(pattern), kind(b, c))
            out = out.when(box, kind("MP4 video", "video")).when((_ascii(content, 0, 2) == "BM") & (F.octet_length(content) > 26), kind("BMP image", "image"))
        if name == "Flash video":
            matroska = F.substring(content, 1, 4) == F.unhex(F.lit("1A45DFA3"))
            out = out.when(matroska & _ascii(content, 0, 64).contains("webm"), kind("WebM video", "video")).when(matroska, kind("Matroska video", "video"))
        out = out.when(same & riff if at == 8 else same, kind(name, category))
    return F.coalesce(out, text_type(content))


def text_type(content: Column) -> Column:
    """``name, category`` of text formats; null for binary data, which one zero byte, bytes that are no UTF-8 or many marks show anywhere in the file."""
    kind = lambda name, category: F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"))
    wide = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    sample = F.decode(content, "ISO-8859-1")
    binary = ~wide & (sample.contains("\x00") | ~F.is_valid_utf8(F.coalesce(content.cast("string"), F.lit(""))))
    marks = F.length(F.regexp_replace(sample, "[^\\x01-\\x08\\x0e-\\x1f]", ""))
    low = F.lower(F.substring(F.ltrim(F.regexp_replace(sample, "^[ï»¿\\s]+", "")), 1, 512))
    return (
        F.when(binary | (~wide & (marks > F.length(sample) * 0.05)), F.lit(None))
        .when(low.startswith("#!"), kind("Script (Unix shell, Python…)", "program"))
        .when(low.rlike("^@?echo off"), kind("Windows batch script", "program"))
        .when(low.contains("<svg"), kind("SVG image", "image"))
        .when(low.rlike("^(<!doctype html|<html)"), kind("Web page (HTML)", "text"))
        .when(low.startswith("<?xml"), kind("XML document", "text"))
        .otherwise(kind("Plain text", "text"))
    )


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.trim(F.substring_index(name, ".", -1)))).otherwise("")


def file_kind(name: Column, mime: Column) -> Column:
    """The first kind, in order, that knows the extension or the MIME type; else ``unknown``."""
    dotted = F.when(name.contains("."), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise("")
    return F.coalesce(*[F.when(dotted.isin(v.split()) | mime.isin(v.split()), F.lit(k)) for k, v in KINDS.items()], F.lit("unknown"))


def name_findings(name: Column) -> Column:
    """Ids of what is wrong with a name: ``bidi``, ``double``, ``padding``."""
    parts = F.transform(F.split(F.lower(name), r"\."), lambda x: F.trim(x))
    shown = "^(pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|txt|zip|mp4|mp3|csv|rtf)$"
    double = (F.size(parts) > 2) & F.element_at(parts, -1).isin(PROGRAMS) & F.get(parts, F.size(parts) - 2).rlike(shown)
    return F.array_compact(F.array(F.when(name.rlike(BIDI), "bidi"), F.when(double, "double").when(name.rlike(r"\s{3,}\.\w+$"), "padding")))


def script_markers(content: Column) -> Column:
    """Whether a page or picture holds code that runs, anywhere in it."""
    return F.decode(content, "ISO-8859-1").rlike(r"(?i)<script\b|\son\w+\s*=|javascript:")


def content_marks(content: Column) -> Column:
    """``c2pa, ai``: whether a picture holds Content Credentials, and whether they or its other labels say that a machine made it.

    The whole file is looked at, as a credential may stand after the picture.
    """
    text = F.decode(content, "ISO-8859-1")
    c2pa = text.rlike(r"jumb[\s\S]{0,64}c2pa|c2pa\.(claim|signature|actions)")
    return F.struct(c2pa.alias("c2pa"), (c2pa & text.rlike(AI_SOURCE)).alias("ai"))


def hash_all(content: Column) -> dict[str, Column]:
    return {"sha256": F.sha2(content, 256), "sha512": F.sha2(content, 512), "sha1": F.sha1(content), "md5": F.md5(content)}


def clean_hash(text: Column) -> Column:
    """A pasted hash without spaces, colons and dashes, in lower case; null where it is none."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"[\s:-]", "")
    return F.when(t.rlike("^[0-9a-f]+$"), t)


def format_bytes(n: Column) -> Column:
    """``512 B``, ``1.5 KB``, ``12 MB``."""
    unit = F.when(n < 1024**2, 0).when(n < 1024**3, 1).otherwise(2)
    value = n / F.pow(F.lit(1024.0), unit + 1)
    shown = F.when(value < 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", value))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), unit + 1)))


def with_suffix(name: Column, suffix: str) -> Column:
    """``report.pdf`` and ``part`` to ``report-part.pdf``."""
    return F.regexp_replace(name, r"^(.+?)(\.[^.]*)?$", f"$1-{suffix}$2")


def replace_extension(name: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1"), F.lit(extension))


def pdf_revisions(content: Column) -> Column:
    """How often a PDF was saved: its end marks, less one where it is laid out for the web."""
    text = F.decode(content, "ISO-8859-1")
    return F.regexp_count(text, F.lit("%%EOF")) - F.when(F.substring(text, 1, 1024).contains("/Linearized"), 1).otherwise(0)


def pdf_version(content: Column) -> Column:
    """``1.7``, from the mark in a file's first 1024 bytes; null where there is none."""
    return F.nullif(F.regexp_extract(_ascii(content, 0, 1024), r"%PDF-(\d\.\d)", 1), F.lit(""))


def text_format(name: Column) -> Column:
    """``markdown``, ``html`` or ``text``, by a name's extension."""
    return F.when(extension(name).isin("md", "markdown"), "markdown").when(extension(name).isin("html", "htm", "xhtml"), "html").otherwise("text")


def permission_flags(p: Column) -> Column:
    """What a PDF's permission bits forbid."""
    bits = {"printing": 4, "editing": 8, "copying": 16, "commenting": 32}
    return F.array_compact(F.array(*[F.when(p.bitwiseAND(F.lit(b)) == 0, k) for k, b in bits.items()]))


def decode_text(content: Column) -> Column:
    """UTF-16 by its mark, else UTF-8 where valid, else Windows-1252. Of UTF-16 an odd last byte goes, and half a surrogate pair becomes U+FFFD."""
    first = F.hex(F.substring(content, 1, 2))
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, _C1)), "".join(bytes([c]).decode("cp1252") for c in _C1))
    utf8 = F.regexp_replace(content.cast("string"), "^﻿", "")
    units = F.hex(F.substring(content, F.lit(3), F.octet_length(content)))

    def wide(order: str) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(units, "(..)(..)", order), " ..$", " ")
        whole = F.regexp_replace(F.regexp_replace(spaced, "D[89AB].. (?!D[C-F])", "FFFD "), "(?<!D[89AB].. )D[C-F].. ", "FFFD ")
        return F.decode(F.unhex(F.replace(whole, F.lit(" "), F.lit(""))), "UTF-16BE")

    return F.when(first == "FFFE", wide("$2$1 ")).when(first == "FEFF", wide("$1$2 ")).when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(latin)


_C1 = [c for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
