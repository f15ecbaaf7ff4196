import numpy as np
import pytest
import xxhash
from tables import ROWS, awkward, by_id

from reliefspark.llm import simhash

SF = "/root/testdata/sf0.01"


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    sums = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << bit for bit in range(64) if 2 * sum(s >> bit & 1 for s in sums) > len(sums))


def brute(values, budget):
    """Component (index of its first member) of each value."""
    values = np.array(values, np.uint64)
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= budget) + i + 1:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(values))]


def test_fingerprints_of_awkward_rows(spark):
    got = by_id(simhash.fingerprints(awkward(spark).drop("row_id")).withColumnRenamed("row_id", "doc_id"), "fp")
    assert got == sorted(((i, int(np.array(fingerprint(t), np.uint64).astype(np.int64))) for i, t in ROWS), key=repr)


def test_documents_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    ids = [r.doc_id for r in rows]
    roots = brute([fingerprint(r.text) for r in rows], 2)
    want = sorted(((i, ids[k]) for i, k in zip(ids, roots)), key=repr)
    assert by_id(simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")), "component_id") == want


@pytest.mark.parametrize("bucket", [1 << 14, 40, 3])
def test_dense_clusters_and_split_buckets(spark, bucket):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = {0, (1 << 64) - 1, 1 << 63}
    for c in centre.tolist():
        for _ in range(60):
            v = c
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                v ^= 1 << bit
            values.add(v)
    values = sorted(values)
    signed = np.array(values, np.uint64).astype(np.int64).tolist()
    roots = brute(values, 2)
    classes = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    edges = simhash.near_links(classes, 2, bucket).collect()
    place, root = {v: i for i, v in enumerate(signed)}, list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        assert (values[place[e.a]] ^ values[place[e.b]]).bit_count() or e.a != e.b
        a, b = sorted((top(place[e.a]), top(place[e.b])))
        root[b] = a
    assert [top(i) for i in range(len(values))] == roots


def test_trie_links_are_all_pairs():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    got = {(int(x), int(y)) for a, b in simhash.trie_links(values, [0], [len(values)], 2) for x, y in zip(np.minimum(a, b), np.maximum(a, b))}
    assert got == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}


def test_awkward_rows_and_empty_table(spark):
    got = dict(by_id(simhash.near_duplicates(awkward(spark)), "component_id"))
    assert got[1] == got[2] == got[3] == got[9] == 1 and got[6] == got[7] == 6
    assert simhash.near_duplicates(awkward(spark, [])).count() == 0
    assert by_id(simhash.near_duplicates(awkward(spark, [(None, "x y"), (None, "x y")])), "component_id") == [(None, None)] * 2
