import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import ROWS, awkward, by_id

from reliefspark.llm import mixing


def tokens(text):
    return [*(text or "").encode().translate(mixing.LOWER).split(), b""]


def base(rows, train):
    counts = Counter(t for i, text in rows if train(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [(i, len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t))) for i, t in rows]


def prose(seed, n=120):
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "ll", "É", "漢"]
    words = ["the", "of", "and", "to", *("".join(rng.choice(parts) for _ in range(rng.randint(2, 5))) for _ in range(3000))]
    return [(i, " ".join(words[min(int(rng.paretovariate(0.4)) - 1, len(words) - 1)] for _ in range(rng.randint(1, 200))).capitalize()) for i in range(100, 100 + n)]


def model(texts, bits=12, common_bits=7):
    """A model made without Spark."""
    counts = Counter(t for text in texts for t in tokens(text))
    n, ends = sum(counts.values()), counts.pop(b"")
    common = sorted([(w, c) for w, c in counts.items() if c << common_bits >= n], key=lambda x: (-x[1], x[0]))
    rare = {w: c for w, c in counts.items() if c << common_bits < n}
    by_byte = [sum(c * w.count(bytes([b])) for w, c in rare.items()) for b in range(256)] + [sum(rare.values())]
    code = mixing.Code(common, sum(rare.values()), ends, by_byte)
    raw = [t.encode() for t in texts]
    table = np.zeros((code.nodes + (mixing.BYTE_CONTEXTS << bits), 2), np.uint16)
    symbols, begin, *_ = code.tokens(raw)
    _, y, slots = code.events(symbols, np.flatnonzero(symbols != code.start), bits, code.function_words(symbols, begin))
    for s in slots:
        np.add.at(table, (s.astype(int), y), 1)
    for word, c in rare.items():
        symbols, *_ = code.letters([word])
        _, y, slots = code.events(symbols, np.flatnonzero(symbols != code.start), bits)
        for s in slots:
            np.add.at(table, (s.astype(int), y), c)
    return mixing.Model(code, table, mixing.first_weights(code, table, raw[:50], bits), bits), common, rare, ends, by_byte, table


def test_base_scores_and_awkward_rows(spark):
    rows = ROWS + prose(1)
    got = by_id(mixing.score(awkward(spark, rows), F.col("doc_id") % 5 != 1, 6, 12), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    want = sorted(base(rows, lambda i: i is not None and i % 5 != 1), key=repr)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (repr(r[0]), r[1], r[4])), sorted(want, key=lambda r: (repr(r[0]), r[1], r[4]))):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] < 0 < a[6], (a, b)


@pytest.mark.parametrize("rows", [[], [(1, "some words"), (2, None)]])
def test_nothing_to_learn_from(spark, rows):
    got = mixing.score(awkward(spark, rows), F.lit(False), table_bits=10).collect()
    assert len(got) == len(rows) and all(r.train_tokens == r.n_known == 0 and r.base_score == 0 and -1000 < r.score < 0 for r in got)


def test_held_out_texts_are_better_foretold(spark):
    """Two languages: what stands before a word tells which one it is from."""
    rng = random.Random(7)
    words = {k: ["".join(rng.choice(k) for _ in range(rng.randint(1, 6))) for _ in range(150)] for k in ("abcdefg", "éopqrst")}
    rows = [(i, " ".join(rng.choice(words["abcdefg" if i % 2 else "éopqrst"]) for _ in range(rng.randint(20, 120)))) for i in range(300)]
    got = mixing.score(awkward(spark, rows), F.col("doc_id") % 5 != 1, 10, 14).where("doc_id % 5 = 1")
    mine, plain, letters, worse = got.agg(F.sum("score"), F.sum("base_score"), F.avg("bits_per_byte"), F.sum((F.col("score") < F.col("base_score")).cast("int"))).first()
    assert mine > 0.97 * plain and letters < 3 and worse == 0


def test_counts_of_spark_are_those_of_one_process(spark):
    texts = [t for _, t in prose(3, 80)]
    ready, common, rare, ends, by_byte, table = model(texts)
    docs = spark.createDataFrame([(t,) for t in [*texts, "never learned from"]], "text string").repartition(5)
    learn = F.col("text") != "never learned from"
    counts = {r.word.encode(): r.c for r in mixing.token_counts(docs, learn).collect()}
    assert counts == {**{w: 0 for w in (b"never", b"learned", b"from")}, **dict(common), **rare, b"": ends}
    words = spark.createDataFrame([(w.decode(), c) for w, c in rare.items()] + [("unseen", 0)], "word string, c long").repartition(3)
    assert mixing._byte_counts(words) == by_byte
    held = spark.sparkContext.broadcast((common, sum(rare.values()), ends, by_byte))
    assert (mixing.branch_counts(docs.where(learn), words, held, "a test", 12) == table).all()


def test_first_weights_come_from_all_training_texts(spark):
    """Over 128 texts, and one of over 20,000 characters: every one of them counts."""
    texts = [t for _, t in prose(3, 150)] + [" ".join(t for _, t in prose(6, 40))]
    assert len(texts[-1]) > 20_000
    ready, common, rare, ends, by_byte, table = model(texts)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    words = spark.createDataFrame([(w.decode(), c) for w, c in rare.items()] + [("unseen", 0)], "word string, c long").repartition(3)
    held = spark.sparkContext.broadcast((common, sum(rare.values()), ends, by_byte))
    got = mixing.all_weights(docs, words, held, "weights of all", table, 12)
    raw = [t.encode() for t in texts]
    for a, b, few in zip(got, mixing.first_weights(ready.code, table, raw, 12), mixing.first_weights(ready.code, table, raw[:128], 12)):
        assert a == pytest.approx(b, abs=1e-6) and a != pytest.approx(few, abs=1e-3)


def test_occurrences_of_rare_words_are_not_sorted(spark):
    """They meet what is known of their words in a hash join; what follows sorts one row a text at most."""
    found = mixing.score(awkward(spark, prose(8, 30)), F.col("doc_id") % 5 != 1, 6, 12)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin [word" in plan and "SortMergeJoin [word" not in plan


def test_letters_of_a_text_are_all_but_white_space(spark):
    got = mixing.score(awkward(spark, [(5, "a\tbc\n\v\f\r d\u00a0\x1c\x85e")]), F.lit(False), table_bits=10).first()
    n_bytes = -got.score * math.log2(10) / got.bits_per_byte
    assert got.n_tokens == 4 and n_bytes == pytest.approx(sum(map(len, tokens("a\tbc\n\v\f\r d\u00a0\x1c\x85e"))) + 4)


def test_mixing_bit_by_bit():
    rng = np.random.default_rng(1)
    lengths = np.array([70, 0, 5, 200])
    n = int(lengths.sum())
    x, gates, y = rng.normal(size=(n, 5)).astype(np.float32), rng.integers(0, mixing.GATES, n), rng.integers(0, 2, n).astype(np.uint8)
    start = rng.normal(size=(mixing.GATES, 5)).astype(np.float32)
    lanes = np.tile(start, (4, 1, 1))
    got = mixing.mix(x, gates, y, lengths, lanes)
    at = 0
    for k, size in enumerate(lengths):
        weights = start.astype(float).copy()
        for block in range(0, size, mixing.STEP):
            changes = np.zeros_like(weights)
            for i in range(at + block, at + min(block + mixing.STEP, size)):
                p = 1 / (1 + math.exp(-float(weights[gates[i]] @ x[i])))
                assert got[i] == pytest.approx(math.log2(p if y[i] else 1 - p), abs=1e-3)
                changes[gates[i]] += mixing.RATE * (float(y[i]) - p) * x[i]
            weights += changes
        assert lanes[k] == pytest.approx(weights, abs=1e-3)
        at += size


def test_codes_and_symbols_lead_back():
    texts = ["The an then  an é\tzzz", "", "of\nof"]
    ready, common, *_ = model(texts + [t for _, t in prose(4, 20)], common_bits=5)
    code = ready.code
    paths = [tuple(zip(code.node[o:o + s].tolist(), code.bit[o:o + s].tolist())) for o, s in zip(code.offsets, code.sizes)]
    assert len(set(paths)) == len(paths) and sum(2.0 ** -len(p) for p in paths) == 2  # two full trees
    symbols, begin, sizes, ids, rare = code.tokens([t.encode() for t in texts])
    names, rest = [w for w, _ in common], iter(rare)
    told = [[names[s] if s < code.escape else next(rest) if s == code.escape else b"" for s in symbols[a:a + n].tolist()] for a, n in zip(begin, sizes)]
    assert told == [tokens(t) for t in texts] and ids.tolist() == [s for a, n in zip(begin, sizes) for s in symbols[a:a + n].tolist()]
    symbols, begin, sizes = code.letters(rare)
    assert [bytes((symbols[a:a + n - 1] - code.first_byte).tolist()) for a, n in zip(begin, sizes)] == rare and (symbols[begin + sizes - 1] == code.stop).all()
    assert (symbols[begin - 1] == code.start).all()


def test_function_words_stay_within_a_text():
    ready, common, *_ = model([t for _, t in prose(4, 20)], common_bits=5)
    first, second = (w.decode() for w, _ in common[:2])
    symbols, begin, *_ = ready.code.tokens([f"{first} zzz zzz".encode(), b"zzz", f"zzz {second} zzz".encode()])
    last = ready.code.function_words(symbols, begin)
    start = ready.code.start
    assert [last[b:b + 4].tolist() for b in begin] == [[start, 0, 0, 0], [start, start, start, start], [start, start, 1, 1]]


def test_long_texts_go_in_stretches(monkeypatch):
    texts = [t for _, t in prose(5, 60)]
    ready, *_ = model(texts)
    long = [(" ".join(texts)).encode(), b"short", b""]
    words = ["".join(texts)[:5000].encode().replace(b" ", b""), b"a", b"bc"]
    whole, spelled = ready.score(long)[0], ready.spell(words)
    monkeypatch.setattr(mixing, "STRETCH", 500)
    assert ready.score(long)[0] == pytest.approx(whole, rel=0.02) and ready.spell(words) == pytest.approx(spelled)
