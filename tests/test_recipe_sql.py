"""The recipes' queries and their SQL on texts that are missing or empty, and on none that fail."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from leafmill.plans import recipe
from leafmill.queries import collect

from .compare import same_rows

QUERIES, SQL = collect()
ROWS = [
    (1, "a", "en"), (2, None, "en"), (3, "", "en"), (4, "x", None), (5, " ", "de"), (9, "z", "en"), (None, "n", "en"), (None, "m", "en"), (None, None, "en"),
    (6, "f", "fr"), (7, None, "fr"), (8, "q", "en"), (8, "r", "en"), (18, None, None), (10, "t", "en"), (27, "k", "fr"),
]


def documents(folder, rows):
    columns = dict(zip(("doc_id", "text", "lang"), map(list, zip(*rows))))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])
    pq.write_table(pa.table(columns | {"source": ["web"] * len(rows)}, schema=schema), f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("rows", [ROWS, [(1, "a", "en")]], ids=["odd texts", "no failure"])
def test_failures_equal_sql(spark, tmp_path, rows):
    same_rows(spark, QUERIES["recipe_failures"], SQL["recipe_failures"], documents(tmp_path, rows))


def test_outputs_equal_sql(spark, tmp_path):
    same_rows(spark, QUERIES["recipe_outputs"], SQL["recipe_outputs"], documents(tmp_path, ROWS))


def test_a_label_is_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(recipe.PRESETS, "numbered bundle", [recipe.require_text_step(), recipe.bates_step("LM-", 9)])
    got = QUERIES["recipe_outputs"](spark, documents(tmp_path, [(1, "a b", "en"), (2, "c", "en")])).collect()
    assert sorted((r.tab_order, r.label) for r in got) == [(1, "LM-000000001"), (2, "LM-000000002")]
