"""Fill-in-middle transformation on content-defined chunks.

The cuts of a text are counted in code points, its bytes are what is at hand.  A rolling hash over the last 16 bytes
cuts the bytes into chunks of 256 to 4096 bytes wherever the content says so, so that copies and shared passages give
the same chunks in any document.  What a chunk needs to meet its neighbours (its number of code points, whether a
marker lies in it, its last bytes) is worked out once and kept in a bounded memory of the worker, found again by the
whole content of the chunk: a look-up compares the bytes, never a digest alone.  Sums of counts lead to the chunk that
holds a cut, and only this chunk is looked into.  The result never depends on what a worker remembers.

A text that is null counts as empty.  Empty texts and texts with a marker stay plain, as do those that the hash of
the id leaves out.  A null id hashes like an empty string.  Repeated rows are transformed alike, each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefspark.llm.common import per_worker, slices

#: prefix, suffix, middle
MARKERS = ("<P>", "<S>", "<M>")
WINDOW, LEAST, MOST, MASK = 16, 256, 4096, 0x3FF
#: bytes of chunks that a worker remembers
MEMORY = 16 << 20


def boundaries(data: bytes) -> list[int]:
    """Ascending places (in bytes) where the content of ``data`` asks for a cut; sizes are not looked at."""
    import numpy as np

    if len(data) < WINDOW:
        return []
    table = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
    rolled, factor = table[np.frombuffer(data, np.uint8)], np.uint32(0x01000193)
    step = 1
    while step < WINDOW:  # sums over 2, 4, 8 and 16 bytes
        further = rolled[step:].copy()
        further += rolled[:-step] * factor
        rolled, step, factor = further, step * 2, np.uint32(int(factor) ** 2 & 0xFFFFFFFF)
    return (np.flatnonzero((rolled >> np.uint32(16)) & np.uint32(MASK) == 0) + WINDOW).tolist()


def chunks(start: int, stop: int, marks: list[int], at: int) -> tuple[list[tuple[int, int]], int]:
    """Chunks of the bytes ``start`` to ``stop``; ``marks[at:]`` are the asked cuts, the next index comes back too."""
    out = []
    while stop - start > LEAST:
        while at < len(marks) and marks[at] < start + LEAST:
            at += 1
        end = min(marks[at] if at < len(marks) else stop, start + MOST, stop)
        out.append((start, end))
        start = end
    if start < stop:
        out.append((start, stop))
    return out, at


def points(data: bytes) -> int:
    """Code points that begin in these bytes."""
    import numpy as np

    if data.isascii():
        return len(data)
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def place(data: bytes, k: int) -> int:
    """Byte where the k-th code point that begins in ``data`` stands."""
    import numpy as np

    return k if data.isascii() else int(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)[k])


class Summaries:
    """(code points, holds a marker) of chunks, the younger and the older half of a bounded memory."""

    def __init__(self, markers: tuple[bytes, ...], memory: int = MEMORY):
        self.markers, self.half = markers, memory // 2
        self.young, self.old, self.size, self.worked_out = {}, {}, 0, 0

    def of(self, chunk: bytes) -> tuple[int, bool]:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                self.worked_out += 1
                found = points(chunk), any(m in chunk for m in self.markers)
            self.size += len(chunk) + 100
            if self.size > self.half:
                self.old, self.young, self.size = self.young, {}, len(chunk) + 100
            self.young[chunk] = found
        return found

    def text(self, data: bytes, parts: list[tuple[int, int]]) -> tuple[list[int], bool]:
        """Code points before each chunk and in all, and whether a marker lies in the text, also across chunks."""
        before, marked, reach, edge = [0], False, max(map(len, self.markers)) - 1, b""
        for a, b in parts:
            n, inside = self.of(data[a:b])
            edge += data[a:min(a + reach, b)]
            marked = marked or inside or any(m in edge for m in self.markers)
            edge = (edge + data[max(a + reach, b - reach):b])[-reach:] if reach else b""
            before.append(before[-1] + n)
        return before, marked


def _draws(id_col: str, seed: str) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the hash of an id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: str = "1", fim_percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n`` code points, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null if plain) and the ``output`` text.

    The two cuts are hashes of the id modulo n + 1, so every place, also the ends, can be one.
    """
    source = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[x.alias(f"h{i}") for i, x in enumerate(_draws(id_col, seed), 1)])
    kind = source.schema["row_id"].dataType.simpleString()
    pre, suf, mid = (m.encode() for m in markers)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        memory = per_worker(("fim", markers), lambda: Summaries((pre, suf, mid)))
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            draws = list(zip(*[batch.column(i).to_pylist() for i in range(2, 6)]))
            whole = b"".join(texts)
            marks, at, start = boundaries(whole), 0, 0
            rows = []
            for text, (h1, h2, h3, h4) in zip(texts, draws):
                while at < len(marks) and marks[at] < start:
                    at += 1
                parts, at = chunks(start, start + len(text), marks, at)
                parts = [(a - start, b - start) for a, b in parts]
                start += len(text)
                before, marked = memory.text(text, parts)
                n = before[-1]
                if not text or marked or h3 % 100 >= fim_percent:
                    rows.append((n, "plain", None, None, text))
                    continue
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                first, second = _offset(text, parts, before, a), _offset(text, parts, before, b)
                p, m, s = text[:first], text[first:second], text[second:]
                if h4 % 100 < spm_percent:
                    rows.append((n, "spm", a, b - a, b"".join((suf, s, pre, p, mid, m))))
                else:
                    rows.append((n, "psm", a, b - a, b"".join((pre, p, suf, s, mid, m))))
            n, form, a, m, out = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(a, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                ["row_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = source.mapInArrow(run, f"row_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.select(F.col("row_id").alias(id_col), *out.columns[1:])


def _offset(text: bytes, parts: list[tuple[int, int]], before: list[int], k: int) -> int:
    """Byte of the k-th code point; the end for the one behind the last."""
    from bisect import bisect_right

    if k == before[-1]:
        return len(text)
    i = bisect_right(before, k) - 1
    a, b = parts[i]
    return a + place(text[a:b], k - before[i])


def restored(form: Column, output: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that a transformed row came from; a transformed text has each marker once."""
    pieces = F.split(output, "|".join("\\Q" + m + "\\E" for m in markers))
    psm, spm = F.concat(pieces[1], pieces[3], pieces[2]), F.concat(pieces[2], pieces[3], pieces[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
