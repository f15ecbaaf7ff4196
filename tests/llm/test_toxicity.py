import numpy as np
from pyspark.sql import functions as F
from tables import ROWS, awkward

from reliefspark.llm import toxicity as T
from reliefspark.llm.quality import sample_rows
from reliefspark.llm.queries import remainder


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in T.start_weights(3).items()}
    rows = rng.integers(0, 6, (4, 5))
    rows[:, 3:] = 0  # padding at the end
    rows[0, :2] = (3, 3)
    vectors, marks = rng.normal(size=(5, 2 * T.WIDTH)), np.array([0, 1, 1, 0])

    def loss():
        logit, cache = T.forward(net, {w: np.concatenate([np.zeros((1, 3 * T.HIDDEN)), vectors @ net[f"W{w}"] + net[f"c{w}"]]) for w in "fb"}, rows, keep=True)
        return np.logaddexp(0, -logit * (2 * marks - 1)).mean(), logit, cache

    _, logit, cache = loss()
    grad, d_words = T._backward(net, rows, cache, (1 / (1 + np.exp(-logit)) - marks) / len(marks), 6)
    for w in "fb":
        grad[f"W{w}"] = vectors.T @ d_words[w][1:]
    for name in ("Uf", "Ub", "cf", "cb", "Wf", "Wb", "A", "a", "o", "k"):
        flat = net[name].reshape(-1)
        for i in rng.choice(len(flat), min(5, len(flat)), replace=False):
            kept, flat[i] = flat[i], flat[i] + 1e-3
            up = loss()[0]
            flat[i] = kept - 1e-3
            down = loss()[0]
            flat[i] = kept
            assert np.isclose((up - down) / 2e-3, grad[name].reshape(-1)[i], atol=2e-4), name


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 64, 65, 200):
        covered = {f + k for f in T.windows_of(n) for k in range(T.WINDOW)}
        assert covered >= set(range(n))
    rows, counts = T.cut(np.arange(1, 121), [70, 0, 50])
    assert counts.tolist() == [len(T.windows_of(70)), 1, len(T.windows_of(50))] and set(rows.reshape(-1)) == set(range(121))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    wanted = remainder(3, "row_id") != 1
    assert len(sample_rows(docs, labels, "toxic", 7, wanted=wanted)) == 14
    got = T.score(docs, labels, wanted).join(labels, "doc_id").where(remainder(3) == 1)
    hit = F.col("score") >= 0.7
    row = got.agg(F.count_if(hit & (F.col("toxic") == 1)).alias("hits"), F.count_if(F.col("toxic") == 1).alias("all"), F.count_if(hit & (F.col("toxic") == 0)).alias("wrong"), F.count_if(F.col("toxic") == 0).alias("clean")).first()
    assert row.hits >= 0.75 * row["all"] and row.wrong <= 0.04 * row.clean


def test_awkward_rows(spark):
    rows = ROWS + [(i, f"you are a moron and {i}" if i % 2 else f"you are kind and {i}") for i in range(40, 100)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40, 100)] + [(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = T.score(awkward(spark, rows), labels, F.lit(True)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1] == scores[2] and min(scores[i] for i in range(41, 100, 2)) > max(scores[i] for i in range(40, 100, 2))
    assert {r.score for r in T.score(awkward(spark), labels, F.lit(False)).collect()} == {0.0}
    assert T.score(awkward(spark, []), labels, F.lit(True)).count() == 0
