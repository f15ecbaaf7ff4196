"""Line dedup by sorted runs: which lines of each document stay, as compressed bitmaps.

Every line with a key becomes one narrow row (two 64-bit hashes of the key, the document, the position).  These
rows are range-partitioned by hash, document and position, so a key that holds a third of all lines spreads over
many partitions, and sorted within them.  One pass streams the runs of equal hashes.  A run is decided as soon as it
has enough documents, and its further rows pass through.  A run at a partition's edge may go on next door: what is
open about it is written as undecided together with its number of documents, summed and joined afterwards.
Texts are read twice and shuffled once; the sort moves hashes only.

A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at its ends, A-Z lower-cased.  Lines without a
key always stay.  A null or empty text is one empty line.  Rows with the same id and the same text count as one
document; rows with the same id and other texts as several.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reliefspark.llm.common import byte_texts, slices, stored

_BLANK = b" \t\n\x0b\x0c\r"
_RUN = ("key_hi", "key_lo")


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """96 bits that name a row by id and text."""
    whole = [F.col(id_col), F.col(text_col).cast("string")]
    return [F.xxhash64(*whole).alias("row_hi"), F.hash(*whole[::-1]).alias("row_lo")]


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key_chars: int = 1) -> DataFrame:
    """``key_hi, key_lo, row_hi, row_lo, position`` of every line whose key has at least ``min_key_chars`` code points."""
    source = docs.select(*_row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in slices(batches, 2):
            sums, places, counts = [], [], []
            for text in byte_texts(batch.column(2)):
                before = len(places)
                for place, line in enumerate(text.split(b"\n")):
                    key = line.strip(_BLANK).lower()
                    if key and (min_key_chars == 1 or len(key.decode()) >= min_key_chars):
                        sums.append(digest(key))
                        places.append(place)
                counts.append(len(places) - before)
            halves = np.frombuffer(b"".join(sums), ">i8").reshape(-1, 2).astype(np.int64)
            rows = [np.repeat(batch.column(i).to_numpy(), counts) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (halves[:, 0].copy(), halves[:, 1].copy(), *rows, np.array(places, np.int32))],
                ["key_hi", "key_lo", "row_hi", "row_lo", "position"])

    return source.mapInArrow(run, "key_hi long, key_lo long, row_hi long, row_lo int, position int")


#: rows of an undecided run that are held back; totals that are sent to all tasks
HELD, FEW = 1 << 16, 1 << 20
_NAMES = ["key_hi", "key_lo", "row_hi", "row_lo", "position", "docs", "edge", "leads"]


def _batch(rows, docs=0, edge=False, leads=False):
    """Output rows; single values stand for all of them."""
    import numpy as np
    import pyarrow as pa

    n = len(rows[0])
    return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(np.full(n, docs, np.int64)), pa.array(np.full(n, edge)), pa.array(np.full(n, leads))], _NAMES)


class _OpenRun:
    """A run whose end has not come yet: its first row, its documents so far, and rows held back while it can stay.

    As soon as enough documents are counted all further rows are handed out as dropped.  Rows beyond ``HELD`` that are
    still undecided are handed out as such, so a run of any length takes no more memory.
    """

    def __init__(self, rows, first: bool, min_docs: int):
        self.key, self.lead = (rows[0][0], rows[1][0]), [x[:1] for x in rows]
        self.docs, self.last, self.held, self.edge, self.min_docs = 1, (rows[2][0], rows[3][0]), [], first, min_docs

    def take(self, rows) -> Iterator:
        """Further rows of the run."""
        import numpy as np

        if not len(rows[0]):
            return
        new = np.r_[(rows[2][0], rows[3][0]) != self.last, (rows[2][1:] != rows[2][:-1]) | (rows[3][1:] != rows[3][:-1])]
        self.docs += int(new.sum())
        self.last = rows[2][-1], rows[3][-1]
        self.held.append(rows)
        if self.docs >= self.min_docs:
            yield from map(_batch, self.held)
            self.held = []
        elif sum(len(x[0]) for x in self.held) > HELD:
            self.edge = True
            yield from (_batch(x, 0, True) for x in self.held)
            self.held = []

    def close(self, keep_first: bool) -> Iterator:
        """A run at an edge of the partition, or one already handed out in part, tells its documents with its first row."""
        if self.edge:
            yield _batch(self.lead, self.docs, True, True)
            yield from (_batch(x, 0, True) for x in self.held)
        elif self.docs >= self.min_docs and not keep_first:
            yield _batch(self.lead)


def _decide(min_docs: int, keep_first: bool):
    """Streams sorted rows; gives the lines to drop, and undecided ones of runs that may go on next door."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        now = None
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(5)]
            n = len(rows[0])
            if not n:
                continue
            starts = np.flatnonzero(np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
            ends = np.r_[starts[1:], n]
            if now is None or now.key != (rows[0][0], rows[1][0]):
                if now is not None:
                    yield from now.close(keep_first)
                now, begun = _OpenRun([x[:ends[0]] for x in rows], now is None, min_docs), 1
            else:
                begun = 0
            yield from now.take([x[begun:ends[0]] for x in rows])
            if len(starts) > 1:
                yield from now.close(keep_first)
                low, high = ends[0], starts[-1]
                yield from _whole_runs([x[low:high] for x in rows], starts[1:-1] - low, min_docs, keep_first)
                now = _OpenRun([x[high:] for x in rows], False, min_docs)
                yield from now.take([x[high + 1:] for x in rows])
        if now is not None:
            now.edge = True
            yield from now.close(keep_first)

    return run


def _whole_runs(rows, starts, min_docs: int, keep_first: bool) -> Iterator:
    """The lines to drop of runs that begin and end in these rows."""
    import numpy as np

    n = len(rows[0])
    if not n:
        return
    new_doc = np.r_[True, (rows[2][1:] != rows[2][:-1]) | (rows[3][1:] != rows[3][:-1])]
    new_doc[starts] = True
    drop = np.repeat(np.add.reduceat(new_doc.astype(np.int64), starts) >= min_docs, np.diff(np.r_[starts, n]))
    if keep_first:
        drop[starts] = False
    if drop.any():
        yield _batch([x[drop] for x in rows])


def dropped_lines(lines: DataFrame, min_docs: int, keep_first: bool = False) -> DataFrame:
    """``row_hi, row_lo, position`` of the lines whose key is in at least ``min_docs`` documents.

    ``keep_first`` spares the first of them by document and position.
    """
    lines = stored(lines, "lines")
    order = ["key_hi", "key_lo", "row_hi", "row_lo", "position"]
    width = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "key_hi long, key_lo long, row_hi long, row_lo int, position int, docs long, edge boolean, leads boolean"
    runs = lines.repartitionByRange(width, *order[:4]).sortWithinPartitions(*order)
    runs = stored(runs.mapInArrow(_decide(min_docs, keep_first), schema), "line-runs")
    edges = runs.where("edge")
    # one row per run at an edge of a partition, or with over HELD rows of too few documents: its documents, and where it starts
    first = F.min(F.struct("row_hi", "row_lo", "position")).alias("first")
    totals = edges.where("leads").groupBy(*_RUN).agg(F.sum("docs").alias("all_docs"), first).where(F.col("all_docs") >= min_docs)
    # mostly two runs per partition; counted first, so that no key's rows meet in one task unless there are too many of them
    few = totals.count() <= FEW
    undecided = edges.drop("docs", "leads").join(F.broadcast(totals) if few else totals, list(_RUN))
    if keep_first:
        undecided = undecided.where(F.struct("row_hi", "row_lo", "position") != F.col("first"))
    columns = order[2:]
    return runs.where("not edge").select(*columns).unionByName(undecided.select(*columns))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text",
                 min_key_chars: int = 1) -> DataFrame:
    """``row_hi, row_lo, n_dropped, keep``: a compressed bitmap (zlib; bit i is line i, 1 stays) for documents that lose lines.

    A document without a row keeps all its lines.  Lines behind the last bit stay.
    """
    drops = dropped_lines(line_rows(docs, id_col, text_col, min_key_chars), min_docs, keep_first)
    grouped = drops.groupBy("row_hi", "row_lo").agg(F.collect_set("position").alias("positions"))

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            packed, counts = [], []
            for places in batch.column(2):
                places = places.values.to_numpy()
                bits = np.ones((int(places.max()) // 8 + 1) * 8, bool)
                bits[places] = False
                packed.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
                counts.append(len(places))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                ["row_hi", "row_lo", "n_dropped", "keep"])

    return grouped.mapInArrow(run, "row_hi long, row_lo int, n_dropped long, keep binary")


def with_kept_text(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc`` (all columns but the text), ``n_lines``, ``n_dropped`` and ``kept_text``: the lines that stay, joined by \\n."""
    keys = ["row_hi", "row_lo"]
    bits = bitmaps.select(*keys, F.struct("n_dropped", "keep").alias("lost"))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc")
    keyed = docs.select(rest, F.col(text_col).cast("string").alias("text"), *_row_key(id_col, text_col)).join(bits, keys, "left")
    keyed = keyed.select("doc", "text", "lost.keep", F.coalesce("lost.n_dropped", F.lit(0)).alias("n_dropped"))

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in slices(batches):
            texts, counts = [], []
            for text, keep in zip(byte_texts(batch.column(1)), batch.column(2)):
                lines = text.split(b"\n")
                counts.append(len(lines))
                if keep.is_valid:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8), bitorder="little").tolist()
                    bits += [1] * (len(lines) - len(bits))
                    text = b"\n".join([line for line, bit in zip(lines, bits) if bit])
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), batch.column(3), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc", "n_lines", "n_dropped", "kept_text"])

    schema = T.StructType([keyed.schema["doc"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    return keyed.mapInArrow(run, schema)
