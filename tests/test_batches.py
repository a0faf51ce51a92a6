"""What Python workers hold at a time does not grow with the batches that they are given."""

import pyarrow as pa

from leafmill.sources import html


class Pages:
    """Stands for a DataFrame, to reach the function that a task runs."""

    def __init__(self):
        self.schema = {"page_id": type("Field", (), {"dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "bigint")})})}

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_a_large_batch_of_pages_leaves_in_parts():
    n = 3 * html.HELD
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["<h1>a</h1><p>b"] * n)], names=["page_id", "html"])
    out = list(html.html_blocks(Pages())(iter([batch])))
    assert max(b.num_rows for b in out) < html.HELD + 2
    rows = [tuple(r.values())[:5] for b in out for r in b.to_pylist()]
    assert rows == [r for k in range(n) for r in ((k, 0, "heading", 1, "a"), (k, 1, "paragraph", 0, "b"))]
