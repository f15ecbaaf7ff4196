import pyarrow as pa

from reliefspark.llm.common import slices


def test_slices_keep_all_rows_in_order():
    texts = [None, "", "a" * 50, "é" * 40, None, "b" * 7, "c" * 300, "", "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["row_id", "text"])
    for size in (1, 60, 10_000):
        parts = list(slices([batch, batch], 1, size))
        assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(len(texts))] * 2
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= size for p in parts)
    assert len(list(slices([batch], 1, 10_000))) == 1 and list(slices([batch.slice(0, 0)])) == []
