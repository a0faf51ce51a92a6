"""Plans that stay small and exchange little, whatever is asked of the operators."""

from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.operators import links


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_an_address_are_written_out_once(spark):
    df = spark.createDataFrame([("http://0x7f.1/a",), ("http://1.2.3.256/",), ("HTTPS://u@Ex.com:99999/",), (None,)], "u string")
    parts = df.select(urls.url_parts(F.col("u"))["host"].alias("host"))
    assert len(optimized(parts)) < 10_000
    assert [r[0] for r in parts.collect()] == ["127.0.0.1", None, None, None]


def test_flags_by_rule_does_not_test_for_flags_below_them(spark):
    checked = links.check_links(spark.createDataFrame([("http://bit.ly/x",), ("https://a.example/",)], "url string"))
    by_rule = links.flags_by_rule(checked)
    assert len(optimized(by_rule)) < 60_000
    assert {(r.rule, r.n) for r in by_rule.collect()} == {("http", 1), ("shortener", 1)}
