import random
import re
from collections import Counter, defaultdict

from tables import ROWS, awkward

from reliefspark.llm import phrases


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, top, least):
    f, out = defaultdict(Counter), []
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang or "und"][tuple(words[i:i + m])] += 1
    for lang, counts in f.items():
        n, found = sum(v for k, v in counts.items() if len(k) == 1), []
        often = [(p, a) for p, a in counts.items() if a >= least and len(p) > 1]
        inner = {(q[i:j], a) for q, a in often for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q)}
        for p, a in often:
            if (p, a) not in inner:
                score, _, l, r = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "漢字", "The", "of", "\x1c\x00"]
    fixed = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 7))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else rng.choice(words[:int(rng.paretovariate(0.7)) % 35 + 1]) for _ in range(rng.randint(1, 40))]
        rows.append((rng.choice(["en", "fr", None]), "".join(p + rng.choice([" ", "\t ", ", ", "\n", ". ", " "]) for p in parts)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(lang, t, "extra", "extra") for lang, t in rows], "lang string, text string, phrase string, f string").repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_brute_force(spark):
    rows = texts(1)
    for top, least, span in ((10_000, 3, 16), (3, 5, 4)):
        assert got(phrases.mine(frame(spark, rows), top, least, span=span)) == brute(rows, top, least), (top, least, span)


def test_a_full_filter_changes_nothing(spark):
    rows = texts(2)[:60]
    assert got(phrases.mine(frame(spark, rows), 50, 3, filter_size=5, span=12)) == brute(rows, 50, 3)


def test_ends_early_where_the_bound_is_reached(spark, monkeypatch):
    rows = [("en", " ".join(f"rare{i} pair{i}" for i in range(30)) + ". " + "the the of, " * 400)] * 5
    rounds, judged = [], phrases._judged
    monkeypatch.setattr(phrases, "_judged", lambda grown, *rest: rounds.append(grown.count()) or judged(grown, *rest))
    assert got(phrases.mine(frame(spark, rows), 20, 5, span=4)) == brute(rows, 20, 5)
    assert len(rounds) == 1  # the frequent words were never expanded


def test_awkward_rows(spark):
    rows = [(None if i == 6 else "en", t) for i, t in ROWS]
    assert got(phrases.mine(awkward(spark), 50, 2)) == brute(rows, 50, 2)
    assert phrases.mine(awkward(spark, [])).count() == 0
