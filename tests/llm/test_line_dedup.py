from collections import defaultdict

import pyarrow as pa
import pytest
from tables import ROWS, awkward

from reliefspark.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs, keep_first, order):
    where = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            where[lower(line.strip(BLANK))].add((i, text))
    often = {k for k, v in where.items() if k and len(v) >= min_docs}
    seen, out = set(), {}
    for row in sorted(set(rows), key=order):
        lines, kept = (row[1] or "").split("\n"), []
        for line in lines:
            key = lower(line.strip(BLANK))
            if key not in often or keep_first and key not in seen:
                kept.append(line)
            seen.add(key)
        out[row] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def got(df):
    return sorted(((r.doc["doc_id"], r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=repr)


def order_of(docs):
    """Documents come in the order of their row keys."""
    keys = {(r.doc_id, r.text): (r.row_hi, r.row_lo) for r in docs.select("doc_id", "text", *line_dedup._row_key("doc_id", "text")).collect()}
    return keys.get


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("min_docs", [2, 3])
def test_against_brute_force(spark, keep_first, min_docs):
    rows = [(i, "\n".join(["Hot line", f"own {i}", "  hot LINE\t", f"every {i % 3}", "", f"pair {i // 2}"])) for i in range(300)] + ROWS
    docs = awkward(spark, rows).drop("row_hi")
    for width in ("1", "7", "40"):  # the hot key lies within one partition, or over many
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            out = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs, min_docs, keep_first))
            want = brute(rows, min_docs, keep_first, order_of(docs))
            assert got(out) == sorted(((row[0], *want[row]) for row in rows), key=repr)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_clashing_columns_and_empty_table(spark):
    docs = awkward(spark)
    out = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs))
    assert set(out.schema["doc"].dataType.names) == set(docs.columns) - {"text"}
    assert out.where("n_dropped > 0").count() == 0 and out.count() == len(ROWS)
    empty = awkward(spark, [])
    assert line_dedup.with_kept_text(empty, line_dedup.keep_bitmaps(empty)).count() == 0


def test_key_length(spark):
    docs = awkward(spark, [(i, "é\nab") for i in range(5)])
    out = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs, 3, min_key_chars=2))
    assert {r.kept_text for r in out.collect()} == {"é"}


def sorted_batches(rows, size):
    rows = sorted(rows)
    for i in range(0, len(rows), size):
        part = list(zip(*rows[i:i + size]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part[:3]] + [pa.array(x, pa.int32()) for x in part[3:]], ["key_hi", "key_lo", "row_hi", "row_lo", "position"])


@pytest.mark.parametrize("docs_of_key", [40_000, 5])
def test_a_hot_run_passes_through(docs_of_key, monkeypatch):
    """One key over many batches: what is held back stays bounded, also if few documents hold it."""
    monkeypatch.setattr(line_dedup, "HELD", 3000)
    rows = [(1, 1, i % docs_of_key, 0, i) for i in range(40_000)] + [(2, 2, i, 0, 0) for i in range(12)] + [(3, 3, 1, 0, 0)]
    taken, given = 0, []

    def counted():
        nonlocal taken
        for batch in sorted_batches(rows, 500):
            assert taken - sum(b.num_rows for b in given) <= 3000 + 500 + 12
            taken += batch.num_rows
            yield batch

    for batch in line_dedup._decide(10, True)(counted()):
        given.append(batch)
    out = [r for b in given for r in b.to_pylist()]
    hot = [r for r in out if r["key_hi"] == 1]
    assert len(hot) == 40_000 and sum(r["docs"] for r in hot if r["leads"]) == docs_of_key and sum(r["leads"] for r in hot) == 1
    assert all(r["edge"] for r in hot) if docs_of_key == 5 else sum(not r["edge"] for r in hot) == 39_999
    assert sum(r["key_hi"] == 2 and not r["edge"] for r in out) == 11 and sum(r["key_hi"] == 3 and r["edge"] for r in out) == 1


def test_few_documents_with_very_many_equal_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD", 50)
    rows = [(i, "same\n" * 200 + f"own {i}") for i in range(12)] + [(100 + i, "other\n" * 300) for i in range(4)]
    docs = awkward(spark, rows)
    for keep_first in (False, True):
        out = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs, 10, keep_first))
        want = brute(rows, 10, keep_first, order_of(docs))
        assert got(out) == sorted(((row[0], *want[row]) for row in rows), key=repr)
