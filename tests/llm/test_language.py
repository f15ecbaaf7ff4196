from pyspark.sql import functions as F
from tables import ROWS, awkward

from reliefspark.llm import language
from reliefspark.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op9_language_id"](spark, sf).collect() if r.held_out]
    assert len(rows) > 200 and sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(spark):
    docs = awkward(spark, ROWS + [(i, f"noch ein satz mit der und das {i}") for i in range(30, 60)]).withColumn("lang", F.when(F.col("doc_id") >= 30, "de").otherwise(F.col("lang")))
    got = {r.doc_id: r for r in language.identify(docs, F.lit(True)).collect()}
    for i in (1, 2, 3, 9, 10, 11):
        assert (got[i].lang_pred, got[i].score, got[i].ambiguous) == ("und", 0.0, False)
    assert got[40].lang_pred == "de" and got[4].lang_pred == "en"


def test_nothing_to_learn_from(spark):
    assert {r.lang_pred for r in language.identify(awkward(spark), F.lit(False)).collect()} == {"und"}
    assert language.identify(awkward(spark, []), F.lit(True)).count() == 0


def test_code_words_are_far_apart():
    for n in (2, 3, 4, 6, 9, 20):
        words = language.code_words(n)
        apart = [(words[i] != words[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, words.shape[1] // 4) and len(words) == n


def test_long_texts_are_summed(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    weights, bias = rng.normal(size=(len(language.ORDERS) * language.SLOTS, 3)).astype(np.float32), np.zeros(3, np.float32)
    texts = [b"", b"a", b"hello world " * 50, b"xyz" * 700, b"q"]
    whole = language.bit_margins(texts, weights, bias)
    monkeypatch.setattr(language, "STEP", 97)
    assert np.allclose(language.bit_margins(texts, weights, bias), whole, atol=1e-4)
    alone = np.concatenate([language.bit_margins([t], weights, bias) for t in texts])
    assert np.allclose(alone, whole, atol=1e-4)
