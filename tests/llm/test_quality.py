import itertools
import re

import numpy as np
from tables import ROWS, awkward

from reliefspark.llm import quality
from reliefspark.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    inside = {i + k for own in windows.values() if len(own) > 1 for i in own for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_base_counts(spark):
    rows = ROWS + [(30, "one two three four five six seven eight " * 3 + "nine\n" * 4), (31, "a b\na b\n a b\n\n\n#x *$%&|<>"), (32, "é漢 \U0001f600\x0bz"), (33, "w " * 9)]
    labels = spark.createDataFrame([], LABELS)
    got = {r.doc_id: r for r in quality.judge(awkward(spark, rows), labels).collect()}
    for i, text in rows:
        want = brute(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, want)
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)
    assert quality.judge(awkward(spark, []), labels).count() == 0


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(2)
    for _ in range(30):
        field = quality.Field()
        field.emit, field.step = rng.normal(size=quality.FEATURES), rng.normal(size=(2, 2))
        chain = [rng.choice(quality.FEATURES, 3, replace=False).tolist() for _ in range(rng.integers(1, 8))]

        def score(labels):
            return sum(sum(field.emit[f] for f in line) * y for line, y in zip(chain, labels)) + sum(field.step[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(chain)), key=score)
        assert np.isclose(score(field.viterbi(chain)), score(best))


def test_gradient_reaches_the_likelihood_of_counts():
    """Without emissions the best steps reproduce the observed transitions."""
    field, chains = quality.Field(), [[[0]] * 4] * 50
    labels = [[1, 1, 1, 0]] * 25 + [[0, 0, 1, 1]] * 25
    before = len(chains)
    field.fit(chains, labels, rounds=300, decay=0)
    assert before == 50 and field.step[0, 0] + field.step[1, 1] > field.step[0, 1] + field.step[1, 0]


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op2_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
