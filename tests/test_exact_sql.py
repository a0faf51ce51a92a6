"""Queries and their SQL on texts in which matches touch, hide each other or only look like one."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.operators import findings as ops
from leafmill.queries import collect

from .compare import same_rows

QUERIES, SQL = collect()
TEXTS = [
    "a 94.182.225.142 +1 (705) 555-1902 4992883091 b",
    "19.31.7.8 10.20.30.40, +1 (208) 555-1177 4284896609045836",
    "4665471787434696 86.227.24.100 an",
    "sum +1 (855) 555-4208 4866351201689520 end",
    "4387393285946913 +1 (438) 555-5817",
    "éçou 71.129.171.132 4815819516090933 que",
    "4111 1111 1111 1111 4387-3932-8594-6913 2222222222222222222",
    "x.y@z.example.com 1.2.3.4 200.1.2.3. 7.7.7.7.7 a1.1.1.99",
    "no (020) 7946 0958; n+0049 30 901820 x\x01030 901820 33\x04",
    "tel(030)901820 99 +(030)90182099 0301234567 12.34.5678",
    None,
    "",
]
PAGES = ["<h1>token = &quot;0b9</h1><p>a&amp</p>", "<h1>The&&&amp</h1><li>b &lt c&amp;lt;</li>", "<h1>&copy;&nbsp; x</h1><p>it&#x27;s</p>", None]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string").toPandas().to_parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(PAGES)], "page_id long, html string").toPandas().to_parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["pii_card", "pii_ip", "pii_phone", "pii_findings", "pii_summary", "pii_by_kind", "pii_filter_kinds", "redacted", "redaction_leaves_nothing", "findings_by_file", "findings_ordered", "finding_items", "report_lines", "html_headings", "html_texts"])
def test_equals_sql_on_odd_texts(spark, odd, name):
    same_rows(spark, QUERIES[name], SQL[name], odd)


def test_what_is_hidden_by_a_finding_is_masked_with_it(spark):
    docs = spark.createDataFrame([(1, "27.204.213.132 4116106959541135 Éré"), (2, "none 12"), (3, None)], "doc_id long, text string")
    assert [r.text for r in ops.redact(docs).orderBy("doc_id").collect()] == ["[removed] [removed] Éré", "none 12", None]


def test_findings_are_put_in_one_order(spark, odd):
    got = QUERIES["findings_ordered"](spark, odd).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{odd}/documents.parquet'")
    assert [(r.doc_id, r.severity, r.ids) for r in got] == con.execute(SQL["findings_ordered"]).fetchall()
