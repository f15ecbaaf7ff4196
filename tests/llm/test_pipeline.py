import hashlib

from tables import ROWS, awkward
from test_bpe import library
from test_decontaminate import brute as windows
from test_line_dedup import brute as dedup
from test_line_dedup import order_of
from test_simhash import brute as components
from test_simhash import fingerprint

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def by_hand(spark, rows, items):
    """All stages in plain Python, over (doc_id, text) rows."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = dedup(rows, 10, True, order_of(docs))
    rows = [(i, t if not lines[i, t][1] else lines[i, t][2]) for i, t in rows if not lines[i, t][1] or lines[i, t][2].strip(" \t\n\x0b\x0c\r")]
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    roots = components([fingerprint(t) for _, t in rows], 2)
    rows = [r for i, r in enumerate(rows) if rows[roots[i]][0] == r[0]]
    rows = [r for r in rows if not windows(r[1], items, 10)[1]]
    other = library()
    return sorted((i, hashlib.sha256(" ".join(map(str, other.encode_ordinary(t))).encode()).hexdigest()) for i, t in rows)


def test_run_against_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((r.doc_id, r.ids_sha256) for r in pipeline.run(spark, SF).collect())
    assert got == by_hand(spark, docs, items) and len(got) < len(docs)


def test_stages_keep_the_columns(spark):
    for rows in (ROWS, []):
        docs = awkward(spark, rows)
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "byte_bpe":
                assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
            assert out.count() <= len(rows)


def test_near_copies_leave_one(spark):
    rows = [(i, "one text that comes in many copies for this test") for i in range(5)] + [(9, "quite another text with words of its own in it")]
    stage = dict(pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, awkward(spark, rows), SF).collect()) == [0, 9]


def left(spark, name, rows):
    out = dict(pipeline.STAGES)[name](spark, awkward(spark, rows), SF)
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_rows_without_or_with_shared_ids_are_judged_alone(spark):
    leak = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r.text or "").split()) >= 10)
    clean = ["some clean words of the first row", "other clean words stand here instead", "a third row with words of its own"]
    good = [(None, clean[0]), (None, clean[1]), (5, clean[2]), *[(i, "words to learn the language from") for i in range(20, 30)]]
    assert left(spark, "language_id", [*good, (None, "12 34"), (None, None), (5, "---")]) == sorted(good, key=repr)
    assert left(spark, "benchmark_decontamination", [*good, (None, leak), (5, leak), (None, None)]) == sorted([*good, (None, None)], key=repr)


def test_one_row_of_each_group_stays(spark):
    one, two, three = "one text that comes in many copies for this test", "quite another text with words of its own in it", "the last of these has nothing to do with the rest"
    rows = [(None, one), (None, one), (None, two), (3, three), (3, three), (4, three), (3, one), (4, "a fifth text shares only the number of its row with others")]
    assert left(spark, "simhash_near_dedup", rows) == sorted([(3, one), (None, two), (3, three), rows[-1]], key=repr)
