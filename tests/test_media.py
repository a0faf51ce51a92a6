import struct

from leafmill.functions.files import decode_text
from leafmill.functions.text import decode_entities
from leafmill.functions.urls import with_verdicts
from leafmill.operators import files as file_ops
from leafmill.operators import links, tables
from leafmill.sources import html, metadata
from pyspark.sql import functions as F


def test_exif_of_both_byte_orders_and_of_damaged_blocks():
    for order, head in (("<", b"II*\0"), (">", b"MM\0*")):
        p = lambda f, *v: struct.pack(order + f, *v)  # noqa: B023, E731
        first = p("H", 3) + p("HHI", 0x010F, 2, 6) + p("I", 50) + p("HHI", 0x0112, 3, 1) + p("HH", 6, 0) + p("HHI", 0x8825, 4, 1) + p("I", 56) + p("I", 0)
        gps = p("H", 2) + p("HHI", 1, 2, 2) + b"N\0\0\0" + p("HHI", 2, 5, 3) + p("I", 86) + p("I", 0)
        tiff = head + p("I", 8) + first + b"Canon\0" + gps + p("IIIIII", 48, 1, 30, 1, 1800, 100)
        tags = {(b, name): text for b, _, name, text, _ in metadata.exif_tags(tiff)}
        assert tags == {("image", "Make"): "Canon", ("image", "Orientation"): "6", ("gps", "GPSLatitudeRef"): "N", ("gps", "GPSLatitude"): "48, 30, 18"}
        for cut in range(len(tiff)):
            metadata.exif_tags(tiff[:cut])
    assert metadata.exif_tags(b"") == [] and metadata.exif_tags(b"II*\0\x08\0\0\0") == []


def test_xmp_names_values_and_faults():
    packet = b'<x:xmpmeta xmlns:x="a"><rdf:Description rdf:about="" xmlns:dc="d" dc:format="image/jpeg"><dc:title><rdf:Alt><rdf:li xml:lang="x">A &lt; B</rdf:li></rdf:Alt></dc:title></rdf:Description></x:xmpmeta>'
    assert metadata.xmp_properties(packet) == [("dc:format", "image/jpeg"), ("dc:title", "A < B")]
    assert metadata.xmp_properties(packet[: packet.index(b"<dc:title>")]) == [("dc:format", "image/jpeg")]
    assert metadata.xmp_properties(b"") == [] and metadata.xmp_properties(b"\xff\xfe not xml") == []


def test_odd_text_stops_no_job(spark):
    rows = [(b"\xff\xfeA\0B",), (b"\xfe\xff\0A\xd8\x00\0B",), (b"\xff\xfe\x3d\xd8\x00\xde",), (b"\xff\xfe",), (b"caf\xe9",), ("é".encode(),), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c binary").select(decode_text(F.col("c"))).collect()]
    assert got == ["A", "A�B", "😀", "", "café", "é", None]
    rows = [("&#xD800; &#56320;",), ("&#x41;&#0000066;",), ("&#99999999999; &#x1F600;",), ("&lt;&amp;lt;",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(decode_entities(F.col("c"))).collect()]
    assert got == ["&#xD800; &#56320;", "AB", "&#99999999999; 😀", "<&lt;"]


def test_savings_of_an_empty_file(spark):
    df = spark.createDataFrame([(0, 0), (100, 50), (100, 95)], "before long, after long")
    assert [r.saved for r in file_ops.size_savings(df).collect()] == [0.0, 0.5, 0.0]


def test_chains_of_any_length(spark):
    certs = spark.createDataFrame([(1, f"c{k}", f"c{k + 1}") for k in range(50)] + [(1, "c50", "c50"), (2, "a", "b"), (2, "b", "a")], "file_id int, subject string, issuer string")
    got = tables.issuer_chain(certs).collect()
    assert sorted(r.depth for r in got if r.leaf == "c0") == list(range(1, 51))
    assert [(r.leaf, r.subject) for r in sorted(got, key=lambda r: r.leaf) if r.file_id == 2] == [("a", "b"), ("b", "a")]


def test_disguised_hosts(spark):
    urls = ["https://0x7f.0.0.1/", "http://2130706433/", "https://0177.1/x", "https://аррӏе.com/", "https://paypаl.com/", "https://ｅｘａｍｐｌｅ.com/", "https://example.com/", "https://1.2.3.4.5/", "https://999999999999/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: (r.host, {f.rule: f.severity for f in r.flags}) for r in links.check_links(df).collect()}
    for u in urls[:3]:
        assert got[u][0] == "127.0.0.1" and got[u][1]["ip"] == "high"
    assert got[urls[3]][1]["idn"] == "high" and got[urls[4]][1]["idn"] == "high"
    assert got[urls[5]] == ("example.com", {}) and got[urls[6]] == ("example.com", {})
    assert got[urls[8]][1] == {"invalid": "medium"}
    alone = {r.url: {f.rule for f in r.flags} for r in with_verdicts(df, "url").collect()}
    assert "idn" in alone[urls[4]]


def test_hidden_elements_and_table_rows(spark):
    page = '<p>a<p hidden>b<p>c<div style="color:red; display: none">d<div>e</div><br>f</div>g<table><tr><td>1<td>2</tr><tr><td hidden>x</td><td>3</td></tr></table><span style="visibility:hidden">h</span>i<p hidden>z'
    got = [(r.kind, r.level, r.text) for r in sorted(html.html_blocks(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).collect(), key=lambda r: r.seq)]
    assert [x for x in got if x[0] != "cell"] == [("paragraph", 0, "a"), ("paragraph", 0, "c"), ("paragraph", 0, "g"), ("paragraph", 0, "i")]
    assert [x for x in got if x[0] == "cell"] == [("cell", 1, "1"), ("cell", 1, "2"), ("cell", 2, "3")]


def test_outlines_find_parents_by_level(spark):
    rows = [(1, k, level) for k, level in enumerate((0, 1, 2, 2, 1, 2, 0, 2, 1))]
    out = tables.outline_tree(spark.createDataFrame(rows, "doc_id int, seq int, level int")).collect()
    assert [(r.parent, r.valid) for r in sorted(out, key=lambda r: r.seq)] == [(None, True), (0, True), (1, True), (1, True), (0, True), (4, True), (None, True), (4, False), (6, True)]
