"""SimHash near-duplicates by a self-join over binary tries.

Fingerprints: one bit per bit position, set where more than half of the 64-bit shingle hashes have it.  Only distinct
fingerprints meet.  Two of them within two bits agree in at least one of three blocks of bits, so each goes to three
buckets by block value, and a bucket is a binary trie over its sorted fingerprints.  The join walks pairs of trie
nodes from the root, splits both by the next bit, adds up differing bits and drops a pair beyond the budget.  A bucket
gives back a spanning forest of its links, never its pairs.  A bucket with more than ``BUCKET`` fingerprints is dealt
anew by three blocks of its remaining bits; after four rounds at most 2**14 values are left, so no task gets more.

A null or empty text, or one without words, has the fingerprint zero.  Rows with equal text have equal fingerprints.
Null ids never become the component's id unless the component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefspark.llm.common import byte_texts, slices, stored, text_bytes
from reliefspark.llm.graph import components

BUCKET = 1 << 14
#: node pairs looked at together
FRONT = 1 << 20


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id, fp`` of every row; A-Z are lower-cased, words are divided by ``[\\x20\\x09-\\x0D]``."""
    source = text_bytes(docs, id_col, text_col)
    kind = source.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        from itertools import accumulate

        import numpy as np
        import pyarrow as pa
        import xxhash

        digest, step = xxhash.xxh64_digest, 1 << 16

        def fingerprint(text: bytes) -> bytes:
            words = text.lower().split()
            if not words:
                return bytes(8)
            whole = b" ".join(words)
            if len(words) <= shingle:
                sums = [digest(whole, seed)]
            else:
                ends = list(accumulate(len(w) + 1 for w in words))
                sums = [digest(whole[a:b - 1], seed) for a, b in zip([0, *ends], ends[shingle - 1:])]
            ones = np.zeros(64, np.int64)
            for i in range(0, len(sums), step):
                part = np.frombuffer(b"".join(sums[i:i + step]), np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
            return np.packbits(2 * ones > len(sums)).tobytes()

        for batch in slices(batches):
            found = b"".join(map(fingerprint, byte_texts(batch.column(1))))
            values = np.frombuffer(found, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["row_id", "fp"])

    return source.mapInArrow(run, f"row_id {kind}, fp long")


def _thirds(mask: int) -> list[int]:
    """The mask with one of three even parts of its free bits added."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [round(k * len(free) / 3) for k in range(4)]
    return [mask | sum(1 << i for i in free[cut[k]:cut[k + 1]]) for k in range(3)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _buckets(classes: DataFrame, bucket: int) -> DataFrame:
    """``fp, path, part``: the buckets that each fingerprint goes to, none with more than ``bucket`` members."""
    masks = {1: 0}
    found, open_ = [], classes.select("fp", F.lit(1).alias("path"))
    while True:
        next_masks = {4 * path + k: mask for path, old in masks.items() for k, mask in enumerate(_thirds(old))}
        # at most 81 entries in the last round, three for each path
        dealt = F.array(*[F.struct(F.lit(path >> 2).alias("old"), F.lit(path).alias("next"), F.lit(_signed(mask)).cast("long").alias("mask")) for path, mask in next_masks.items()])
        rows = open_.select("fp", F.explode(F.filter(dealt, lambda x: x["old"] == F.col("path"))).alias("x"))
        rows = rows.select("fp", F.col("x.next").alias("path"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("part"))
        masks = next_masks
        largest = 1 << min(64 - mask.bit_count() for mask in masks.values())
        if largest <= bucket or max(64 - mask.bit_count() for mask in masks.values()) <= 14:
            found.append(rows)
            break
        rows = stored(rows, "buckets")
        hot = rows.groupBy("path", "part").count().where(F.col("count") > bucket).select("path", "part")
        hot = stored(hot, "hot-buckets")
        if hot.isEmpty():
            found.append(rows)
            break
        found.append(rows.join(hot, ["path", "part"], "left_anti"))
        open_ = rows.join(hot, ["path", "part"], "left_semi").select("fp", "path")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def trie_links(values, starts, ends, budget: int):
    """Index pairs within ``budget`` bits inside each slice of sorted unsigned ``values``; yields them in chunks.

    A trie node is a slice; a pair of nodes holds its differing bits so far.
    """
    import numpy as np

    singles = np.bitwise_count

    def ones_before(bit):
        return np.r_[0, np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)]

    ones = [ones_before(bit) for bit in range(64)]
    starts, ends = np.asarray(starts), np.asarray(ends)
    pairs = np.stack([starts, ends, starts, ends, np.zeros_like(starts)], 1)
    stack = [(63, pairs[ends - starts > 1])]
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > FRONT:
            half = len(pairs) // 2
            stack += [(bit, pairs[:half]), (bit, pairs[half:])]
            continue
        leaf = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        a, b = pairs[leaf, 0], pairs[leaf, 2]
        near = singles(values[a] ^ values[b]) <= budget
        if near.any():
            yield a[near], b[near]
        pairs = pairs[~leaf]
        if not len(pairs) or bit < 0:
            continue
        lo_a, hi_a, lo_b, hi_b, errors = pairs.T
        count = ones[bit]
        mid_a, mid_b = hi_a - (count[hi_a] - count[lo_a]), hi_b - (count[hi_b] - count[lo_b])
        same = lo_a == lo_b
        split = [
            np.stack([lo_a, mid_a, lo_b, mid_b, errors], 1), np.stack([mid_a, hi_a, mid_b, hi_b, errors], 1),
            np.stack([lo_a, mid_a, mid_b, hi_b, errors + 1], 1), np.stack([mid_a, hi_a, lo_b, mid_b, errors + 1], 1)[~same]]
        pairs = np.concatenate(split)
        full = (pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & (pairs[:, 4] <= budget)
        alone = (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] - pairs[:, 0] == 1)
        stack.append((bit - 1, pairs[full & ~alone]))


def _forest(budget: int):
    """Streams buckets sorted by (path, part, fp); gives ``a, b``: a spanning forest of each one's links."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def linked(columns):
            path, part, fp = columns
            edges = np.flatnonzero((path[1:] != path[:-1]) | (part[1:] != part[:-1])) + 1
            starts, ends = np.r_[0, edges], np.r_[edges, len(fp)]
            values = fp.view(np.uint64) ^ np.uint64(1 << 63)  # in this form the order by sign is the order by bits
            root = np.arange(len(fp))
            for a, b in trie_links(values, starts, ends, budget):
                while len(a):
                    a, b = root[a], root[b]
                    open_ = a != b
                    a, b = np.maximum(a[open_], b[open_]), np.minimum(a[open_], b[open_])
                    np.minimum.at(root, a, b)
                    while (root[root] != root).any():
                        root = root[root]
            hung = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[hung]), pa.array(fp[root[hung]])], ["a", "b"])

        rest = None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            if not len(columns[0]):
                continue
            columns = [np.concatenate(x) for x in zip(rest, columns)] if rest else columns
            last = np.flatnonzero((columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]))[0]
            if last:
                yield linked([x[:last] for x in columns])
            rest = [x[last:] for x in columns]
        if rest:
            yield linked(rest)

    return run


def near_links(classes: DataFrame, budget: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that join all that are within ``budget`` <= 2 bits."""
    if not 0 <= budget <= 2:
        raise ValueError("three blocks find at most two differing bits")
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _buckets(classes, bucket).select("path", "part", "fp").repartition(width, "path", "part").sortWithinPartitions("path", "part", "fp")
    return rows.mapInArrow(_forest(budget), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, budget: int = 2, id_col: str = "doc_id", text_col: str = "text",
                    bucket: int = BUCKET) -> DataFrame:
    """The id, ``fp`` and ``component_id`` (smallest id reachable over links) of every row."""
    rows = stored(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("row_id").alias("least")), "classes")
    comps = components(near_links(classes.select("fp"), budget, bucket)).withColumnRenamed("node", "fp")
    joined = stored(comps.join(classes, "fp"), "linked")
    roots = joined.groupBy("component").agg(F.min("least").alias("least"))
    linked = joined.drop("least").join(roots, "component").select("fp", F.struct("least").alias("linked"))
    names = classes.join(linked, "fp", "left").select("fp", F.when(F.col("linked").isNotNull(), F.col("linked.least")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(names, "fp").select(F.col("row_id").alias(id_col), "fp", "component_id")
