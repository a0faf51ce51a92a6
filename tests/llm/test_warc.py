import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from leafmill.llm import warc

SCHEMA = "page_id long, url string, html string"
ROWS = [(3, "http://a/\n", "same"), (1, "http://b/é", "same"), (2, None, "other \r\n\r\n text é"), (5, "u", None), (4, "u", ""), (None, "n", "same"), (1, "http://b/é", "same"), (8, "big", "x" * 300_000)]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA).withColumn("digest", F.lit("clash")).repartition(3)
    index = warc.write_archives(pages, f"file://{tmp_path}")
    out = warc.read_records(index).collect()
    assert len(out) == len(ROWS)
    first = {"same": 1, "": 4}
    for r in out:
        html = next(h or "" for p, u, h in ROWS if p == r.page_id)
        data = html.encode()
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = html in first and r.page_id != first[html]
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == (first[html] if revisit else None)
        assert r.payload == (None if revisit else data)


def test_selected_records_by_the_index(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h{k % 3}/{k}", f"page {k} " * k) for k in range(200)], SCHEMA).repartition(2)
    index = warc.write_archives(pages, f"file://{tmp_path}")
    rows = warc.read_records(index, F.col("url").startswith("http://h1/")).collect()
    assert sorted(r.page_id for r in rows) == list(range(1, 200, 3))
    for r in index.limit(20).collect():
        with open(r.archive.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            assert f"Page-ID: {r.page_id}\r\n".encode() in gzip.decompress(f.read(r.length))


def test_small_payloads_are_all_responses(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path}", least_bytes=100)
    assert {r.record_type for r in warc.read_records(index).collect()} == {"response"}


def test_empty_table(spark, tmp_path):
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}")).collect() == []
