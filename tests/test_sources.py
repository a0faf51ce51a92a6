import io
import struct
import zipfile
import zlib

from leafmill.operators import images
from leafmill.sources import files, metadata, packages
from leafmill.sources.html import html_blocks, rows_of


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d for m, d in segments) + b"\xff\xda\x00\x02data\xff\xd9"


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def test_packages(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", "<x/>")
        z.writestr("a.txt", "abc")
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.txt").write_bytes(b"no package")
    read = files.read_files(spark, f"file://{tmp_path}")
    assert sorted(r.name for r in read.collect()) == ["a.docx", "b.txt"]
    parts = files.package_parts(read.select("name", "content"), "name").collect()
    assert [(r.name, r.part, bytes(r.bytes)) for r in sorted(parts, key=lambda r: r.part_no)] == [("a.docx", "word/document.xml", b"<x/>"), ("a.docx", "a.txt", b"abc")]


def test_images_are_cleaned(spark):
    table = bytes([0]) + bytes([16] * 64)
    photo = jpeg((0xE0, b"JFIF\0.."), (0xE1, b"Exif\0\0secret"), (0xDB, table), (0xFE, b"comment"))
    png = files.PNG + chunk(b"IHDR", b"x" * 13) + chunk(b"tEXt", b"Author\0me") + chunk(b"IDAT", b"d") + chunk(b"IEND", b"")
    df = spark.createDataFrame([("a.jpg", bytearray(photo)), ("b.png", bytearray(png)), ("c.txt", bytearray(b"text"))], "path string, content binary")
    segments = files.image_segments(df)
    out = {r.path: bytes(r.content) for r in images.sanitize(df, segments).collect()}
    assert out == {"a.jpg": jpeg((0xE0, b"JFIF\0.."), (0xDB, table)), "b.png": files.PNG + chunk(b"IHDR", b"x" * 13) + chunk(b"IDAT", b"d") + chunk(b"IEND", b"")}
    assert [r.quality for r in images.jpeg_quality(segments).collect()] == [86]


def test_elements_end_where_html_says():
    read = lambda page: [(kind, level, text) for kind, level, text, *_ in rows_of(page)]
    assert read("<ul><li>a<li>b<li>c</ul><p>after</p>") == [("item", 1, "a"), ("item", 1, "b"), ("item", 1, "c"), ("paragraph", 0, "after")]
    assert read("<head><title>t</title><body><p>seen</p>") == [("paragraph", 0, "seen")]
    assert read("<head><title>t</title><p>seen") == [("paragraph", 0, "seen")]
    assert [(r[2], r[3]) for r in rows_of("<a href=x>one<a href=y>two</a>") if r[0] == "link"] == [("one", "x"), ("two", "y")]
    assert [(r[2], r[3]) for r in rows_of("<a href=u><p>para</p></a>") if r[0] == "link"] == [("para", "u")]
    assert read("<table><tr><td>a<ul><li>x</ul><td>b</table>z") == [("cell", 1, "a"), ("item", 1, "x"), ("cell", 1, "b"), ("paragraph", 0, "z")]
    assert read("<ul><li>a<ul><li>b</ul><li>c</ul>") == [("item", 1, "a"), ("item", 2, "b"), ("item", 1, "c")]
    assert read("<dl><dt>a<dd>b<dt>c</dl>d") == [("paragraph", 0, x) for x in "abcd"]
    assert read("<h1>a<h2>b</h1>c") == [("heading", 1, "a"), ("heading", 2, "b"), ("paragraph", 0, "c")]
    assert read("<svg><path/><text>no</text></svg>yes") == [("paragraph", 0, "yes")]
    spans = [(r[1], r[2], r[4], r[5]) for r in rows_of("<table><tr><td colspan=2>a<td>b<tr><td colspan=x>c<th colspan=0>d</table>")]
    assert spans == [(1, "a", 1, 2), (1, "b", 3, 1), (2, "c", 1, 1), (2, "d", 2, 1)]


def test_no_page_stops_the_job(spark):
    pages = [(1, "a<![foo[ x> b"), (2, "a<![foo[ x"), (3, "<" * 5000), (4, "<div>" * 20000 + "deep"), (5, "<p>good</p>"), (6, "<a href='&#xFFFFFFFF;'>x"), (7, None), (8, "")]
    rows = html_blocks(spark.createDataFrame(pages, "page_id int, html string")).collect()
    texts = {r.page_id: r.text for r in rows if r.kind == "paragraph"}
    assert texts[1] == "a b" and texts[4] == "deep" and texts[5] == "good" and texts[2].startswith("a") and not {7, 8} & texts.keys()


def test_large_packages_are_dealt_by_entries(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_STORED) as z:
        for k in range(40):
            z.writestr(f"{'a' if k % 4 else 'b'}/{k}.txt", str(k) * 1000)
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"small{k}.zip", "w") as z:
            z.writestr("a/x.txt", "small")
    (tmp_path / "c.txt").write_bytes(b"no package")
    folder = f"file://{tmp_path}"
    df = packages.read_packages(spark, folder, task_bytes=10_000)
    assert df.rdd.getNumPartitions() >= 7
    rows = {(r.path.rpartition("/")[2], r.part): bytes(r.bytes) for r in df.collect()}
    assert len(rows) == 43 and rows["big.zip", "a/39.txt"] == b"39" * 1000
    named = packages.read_packages(spark, folder, "b/*", task_bytes=10_000)
    assert sorted(r.part for r in named.collect()) == sorted(f"b/{k}.txt" for k in range(0, 40, 4)) and named.rdd.getNumPartitions() < df.rdd.getNumPartitions()
    assert {r.bytes for r in packages.read_packages(spark, folder, names_only=True).collect()} == {None}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = packages.read_packages(spark, folder, task_bytes=10_000).filter("part = 'a/x.txt'")
        assert [bytes(r.bytes) for r in one.collect()] == [b"small"] * 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_keep_entries_from_being_read():
    reader = packages.FilteredReader({"path": "x", "parts": "*.txt"})
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

    rest = list(reader.pushFilters([StringStartsWith(("part",), "a/"), In(("part",), ("a/1.txt", "b/1.txt")), IsNotNull(("part",)), EqualTo(("size",), 3)]))
    assert len(rest) == 2 and reader.takes("a/1.txt") and not reader.takes("b/1.txt") and not reader.takes("a/2.txt")


def test_technical_tags_stay(spark):
    tags = {0x010F: (2, b"Maker\0\0\0"), 0x0112: (3, b"\0\6"), 0x011A: (5, struct.pack(">II", 300, 1))}
    own = {0x829A: (5, struct.pack(">II", 1, 120)), 0x9286: (7, b"ASCII\0\0\0me"), 0x8827: (3, b"\0\x64")}
    image = [(t, *v) for t, v in tags.items()] + [(0x8769, 4, b"\0" * 4)]
    size = len(metadata._block(">", 8, image))
    image[-1] = (0x8769, 4, struct.pack(">I", 8 + size))
    tiff = b"MM\0*" + struct.pack(">I", 8) + metadata._block(">", 8, image) + metadata._block(">", 8 + size, [(t, *v) for t, v in own.items()])
    assert len(metadata.exif_tags(tiff)) == 6
    png = files.PNG + chunk(b"IHDR", b"x" * 13) + chunk(b"eXIf", tiff) + chunk(b"IDAT", b"d") + chunk(b"IEND", b"")
    photo = jpeg((0xE1, b"Exif\0\0" + tiff), (0xDB, b"\0" + b"x" * 64))
    bare = jpeg((0xE1, b"Exif\0\0" + b"MM\0*\0\0\0\x08\0\0"), (0xDB, b"\0" + b"x" * 64))
    df = spark.createDataFrame([("a.jpg", bytearray(photo)), ("b.png", bytearray(png)), ("c.jpg", bytearray(bare))], "path string, content binary")
    segments = files.image_segments(df)
    clean = images.sanitize(df, segments, technical=metadata.technical_exif(segments))
    left = metadata.exif_entries(files.image_segments(clean)).collect()
    want = [("image", "Orientation", "6"), ("image", "XResolution", "300"), ("exif", "ExposureTime", "1/120 s"), ("exif", "ISO", "100")]
    for name in ("a.jpg", "b.png"):
        assert sorted((r.grp, r.key, r.value) for r in left if r.path == name) == sorted(want)
    out = {r.path: bytes(r.content) for r in clean.collect()}
    assert out["c.jpg"] == jpeg((0xDB, b"\0" + b"x" * 64))
    assert b"Maker" not in out["a.jpg"] + out["b.png"]
