import hashlib
import random

from pyspark.sql import functions as F
from tables import ROWS, awkward, by_id

from reliefspark.llm import fim


def brute(i, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def many():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab é漢\U0001f600<PS>\n") for _ in range(rng.choice((1, 2, 5, 300, 9000))))) for i in range(100, 400)]
    shared = "".join(rng.choice("abcdefgh ijk") for _ in range(20_000))
    return rows + [(i, f"own {i} " + shared) for i in range(500, 520)] + [(600 + k, "x" * k + "<M>" + "y" * 500) for k in range(250, 262)] + [(700, "<P"), (701, "a<<S"), (702, "<")]


def test_against_brute_force_and_back(spark):
    rows = ROWS + many()
    out = fim.transform(awkward(spark, rows).drop("row_id"))
    got = by_id(out, "n", "form", "prefix_chars", "middle_chars", "output")
    assert got == sorted(((i, *brute(i, t)) for i, t in rows), key=repr)
    back = out.withColumn("text", fim.restored(F.col("form"), F.col("output")))
    assert by_id(back, "text") == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}
    assert fim.transform(awkward(spark, [])).count() == 0


def test_other_markers(spark):
    rows = [(i, f"some [MID text {i}") for i in range(50)]
    out = fim.transform(awkward(spark, rows), markers=("[PRE]", "[SUF|", "[MID]"))
    back = out.withColumn("text", fim.restored(F.col("form"), F.col("output"), ("[PRE]", "[SUF|", "[MID]")))
    assert by_id(back, "text") == sorted(rows, key=repr) and out.where("form != 'plain' and output like '%[SUF|%'").count() > 30


def test_shared_passages_are_worked_out_once():
    rng = random.Random(1)
    shared = bytes(rng.randrange(97, 123) for _ in range(60_000))
    texts = [bytes(rng.randrange(97, 123) for _ in range(500 + i)) + shared for i in range(20)]
    memory = fim.Summaries((b"<P>", b"<S>", b"<M>"), 1 << 20)
    for text in texts:
        parts, _ = fim.chunks(0, len(text), fim.boundaries(text), 0)
        assert b"".join(text[a:b] for a, b in parts) == text and all(b - a <= fim.MOST for a, b in parts)
        assert memory.text(text, parts) == ([*map(lambda x: x[0], parts), len(text)], False)
    assert memory.worked_out < 20 * 8 + 150


def test_memory_is_bounded():
    memory = fim.Summaries((b"<P>",), 100_000)
    for i in range(2000):
        memory.of(str(i).encode() * 100)
    assert sum(len(k) for k in [*memory.young, *memory.old]) < 100_000
