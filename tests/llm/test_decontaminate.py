import re

from tables import ROWS, awkward, by_id

from reliefspark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width):
    own, hit, found = words(text), set(), set()
    for item, other in items:
        other = words(other)
        size = min(width, len(other))
        for window in {tuple(other[i:i + size]) for i in range(len(other) - size + 1)} if other and item is not None else ():
            for i in range(len(own) - size + 1):
                if tuple(own[i:i + size]) == window:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def test_against_brute_force(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item!"), (10, "short, ITEM"), (3, None), (4, "..."), (None, "never used"),
             (5, "café 漢字"), (2, "a second text of item two is fine as well yes")]
    rows = ROWS + [
        (20, "zero One, two three-four five six seven eight nine TEN eleven twelve"), (21, "one two three four five six seven eight nine"), (22, "a short item and a short item"),
        (23, "shorts item"), (24, "CAFé... 漢字"), (25, "never used"), (26, "one two three four five six seven eight nine ten one two three four five six seven eight nine ten")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *brute(t, items, 10)) for i, t in rows), key=repr)
    for block_bytes in (1 << 20, 60):  # one automaton, or several passes
        assert by_id(decontaminate.scan(awkward(spark, rows), bench, 10, block_bytes=block_bytes), "n_words", "n_hit", "items") == want


def test_spans_lead_back(spark):
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    text = "漢 ALPHA,\n beta! gamma alpha beta"
    row = decontaminate.scan(awkward(spark, [(1, text)]), bench).first()
    assert [text[s.start:s.end] for s in row.spans] == ["ALPHA,\n beta", "alpha beta"]


def test_nothing_to_find(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.scan(awkward(spark), bench)
    assert out.count() == len(ROWS) and out.where("n_hit > 0 or size(items) > 0").count() == 0
    assert decontaminate.scan(awkward(spark, []), bench).count() == 0


def test_one_automaton_at_a_time(spark, monkeypatch):
    """Several blocks: each is fetched when the one before it is done, and a worker holds one automaton."""
    items = [(i, f"item {i} alpha beta gamma delta epsilon zeta eta theta iota") for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"before Item {i} alpha beta gamma delta epsilon zeta eta theta iota after") for i in range(40)] + [(50, None)]
    blocks = list(decontaminate.item_blocks(bench, block_bytes=600))
    assert len(blocks) >= 3 and sum(map(len, blocks)) == 40
    built, kept = [], {}
    monkeypatch.setattr(decontaminate, "per_worker", lambda key, build: kept.setdefault(key, build()))
    monkeypatch.setattr(decontaminate, "Windows", lambda held, width: built.append(held) or held)
    for mark in ("a", "a", "b", "c"):
        decontaminate._one_automaton(type("Held", (), {"value": mark}), mark, 10)
        assert list(kept[("windows",)]) == [mark]
    assert built == ["a", "b", "c"]
    monkeypatch.undo()
    want = sorted(((i, *brute(t, items, 10)) for i, t in rows), key=repr)
    out = decontaminate.scan(awkward(spark, rows), bench, 10, block_bytes=600)
    assert by_id(out, "n_words", "n_hit", "items") == want
    assert {tuple(rows[r.doc_id][1][s.start:s.end] for s in r.spans) for r in out.where("doc_id = 7").collect()} == {("Item 7 alpha beta gamma delta epsilon zeta eta theta iota",)}
