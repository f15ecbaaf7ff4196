"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are normalised byte by byte: A-Z become lower case, every byte that cannot belong to a word becomes a space.
Bytes keep their places, so a hit leads back to the original text.  The windows of all items (``width`` consecutive
words; an item with fewer words is one window) go into one automaton, framed by spaces, and a text is scanned once.

A null text has no words.  Items without words, and items whose id is null, are left out.  Repeated items count once.
Repeated documents are judged one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefspark.llm.common import byte_texts, per_worker, slices, stored, text_bytes

#: bytes to their normal form: 0-9, a-z and everything beyond ASCII stay, A-Z are lower-cased, the rest are spaces
NORMAL = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: an automaton takes some 40 times the bytes of its items; longer benchmarks are scanned in several jobs
BLOCK_BYTES = 4 << 20


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """(item id as text, normalised text) in blocks of bounded size, fetched one after the other.

    The size of the test set is read first and decides the number of blocks.
    """
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-size // block_bytes), 1)
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i)
        yield [(r.item, r.text.encode().translate(NORMAL)) for r in part.collect()]


class Windows:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        import ahocorasick

        known: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            words = text.decode("latin-1").split(" ")
            words = [w for w in words if w]
            size = min(width, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                known.setdefault(f" {' '.join(words[i:i + size])} ", (size, set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for window, (size, owners) in known.items():
            self.automaton.add_word(window, (len(window), size, owners))
        self.empty = not known
        if known:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, number of words) of every occurrence, and the items they belong to."""
        text = f" {b' '.join(words).decode('latin-1')} "
        found, items, at, seen = [], set(), 0, 0
        for end, (length, size, owners) in self.automaton.iter(text):
            # windows come by their ends: count the spaces once, from occurrence to occurrence
            seen += text.count(" ", at, end)
            at = end
            found.append((seen - size, size))
            items |= owners
        return found, items


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text",
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: the id, ``n_words``, ``n_hit``, ``items`` (sorted ids), ``spans`` (code points, end exclusive, of hit stretches).

    Driver and workers hold one block of items and one automaton at a time.  With one block this is one map without a
    shuffle.  With more, each block is a job over the texts that stores what it hits, and the few rows with hits are
    put together by row afterwards.
    """
    spark = docs.sparkSession
    source = text_bytes(docs, id_col, text_col)
    kind = source.schema["row_id"].dataType.simpleString()
    final = f"row_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
    blocks = item_blocks(benchmark, text_col="text", block_bytes=block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        held = spark.sparkContext.broadcast(block)
        out = source.mapInArrow(_scan_all(held, _mark(block, width), width), final)
    else:
        rows = stored(source.withColumn("row", F.monotonically_increasing_id()), "texts")
        hits = None
        while block is not None:
            held = spark.sparkContext.broadcast(block)
            found = rows.select("row", "text").mapInArrow(_scan_block(held, _mark(block, width), width), "row long, hits binary, items array<string>")
            found = stored(found, "hits")
            held.destroy()
            hits = found if hits is None else hits.unionAll(found)
            block, following = following, next(blocks, None)
        of_row = hits.groupBy("row").agg(F.collect_list("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = rows.join(of_row, "row", "left").select("row_id", "text", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items")).mapInArrow(_put_together, final)
    return out.select(F.col("row_id").alias(id_col), *out.columns[1:])


def _mark(block: list, width: int) -> str:
    return hashlib.sha256(repr((sorted(block), width)).encode()).hexdigest()


def _one_automaton(held, mark: str, width: int) -> Windows:
    """The automaton of a block; the one before it is let go."""
    kept = per_worker(("windows",), dict)
    if mark not in kept:
        kept.clear()
        kept[mark] = Windows(held.value, width)
    return kept[mark]


def _hit_bits(windows: Windows, words: list[bytes]) -> tuple[bytes | None, list[str]]:
    import numpy as np

    found, owners = ((), ()) if windows.empty else windows.scan(words)
    if not found:
        return None, []
    bits = np.zeros(len(words), bool)
    for first, size in found:
        bits[first:first + size] = True
    return np.packbits(bits).tobytes(), sorted(owners)


def _told(row_ids, rows: list[tuple]):
    """Output batch of (words, hit words, items, stretches)."""
    import pyarrow as pa

    n_words, n_hit, items, spans = zip(*rows) if rows else ((), (), (), ())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [row_ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)], ["row_id", "n_words", "n_hit", "items", "spans"])


def _scan_all(held, mark: str, width: int):
    def run(batches: Iterator) -> Iterator:
        windows = _one_automaton(held, mark, width)
        for batch in slices(batches):
            rows = []
            for text in byte_texts(batch.column(1)):
                normal = text.translate(NORMAL)
                words = normal.split()
                bits, items = _hit_bits(windows, words)
                stretches, n = _stretches(text, normal, bits) if bits else ([], 0)
                rows.append((len(words), n, items, stretches))
            yield _told(batch.column(0), rows)

    return run


def _scan_block(held, mark: str, width: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        windows = _one_automaton(held, mark, width)
        for batch in slices(batches):
            hits = [(row, *_hit_bits(windows, text.translate(NORMAL).split())) for row, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)))]
            rows, bits, items = zip(*[h for h in hits if h[1]]) if any(h[1] for h in hits) else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["row", "hits", "items"])

    return run


def _put_together(batches: Iterator) -> Iterator:
    import numpy as np

    for batch in slices(batches):
        rows = []
        for text, hits, items in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            normal = text.translate(NORMAL)
            bits = np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in hits]).tobytes() if hits else None
            stretches, n = _stretches(text, normal, bits) if bits else ([], 0)
            rows.append((len(normal.split()), n, items, stretches))
        yield _told(batch.column(0), rows)


def _stretches(text: bytes, normal: bytes, hit: bytes) -> tuple[list[dict], int]:
    """Stretches of hit words in code points of the original text, and the number of hit words."""
    import re

    import numpy as np

    places = [m.span() for m in re.finditer(rb"[^ ]+", normal)]
    bits = np.unpackbits(np.frombuffer(hit, np.uint8))[:len(places)]
    edges = np.flatnonzero(np.diff(np.r_[0, bits, 0].astype(np.int8)))
    stretches = [{"start": len(text[:places[a][0]].decode()), "end": len(text[:places[b - 1][1]].decode())} for a, b in zip(edges[::2], edges[1::2])]
    return stretches, int(bits.sum())
