"""Language-model scoring by logistic context mixing of bit predictors.

A text is a row of tokens: its words, A-Z lower-cased, then one end.  Every token is told in bits.  Words that make up
at least one of ``2 ** common_bits`` training tokens, the end and an escape have Huffman codes; any other word is the
escape and then its bytes, again in Huffman codes, up to a stop.  So a bit is a branch at a node of one of two trees.

The predictors know how often each branch was taken in all training texts: at the node alone, and at the node in
hashed contexts (the last function word, the last token, the last two; while spelling the last one, two, three and
five bytes of the word).  What they say, as log odds weighted by how much they have seen, is summed with weights that
a gate picks by how many of the long contexts are known; the sum's logistic is the probability of the bit.  The
weights are fitted to all training texts and then refined online, in each text anew, after every ``STEP`` bits.  For the
fit the bits are counted by the level of what each predictor says, so one look at the texts serves all its rounds.

How a word is spelled depends on the word alone, so it is worked out once for each different word, where its count is.
Counts and spellings of rare words grow with the corpus and are never gathered in one place: the kernel hands out the
rare words of a text, a join finds what is known of them, and a word costs the logarithm of
``share * count / all rare + (1 - share) * spelling``, where ``share`` is the Good-Turing estimate of known words.

A null text has only its end.  Without training texts all counts are zero.  Repeated rows are scored one by one.
Texts are worked off in stretches of bounded length, so a very long one needs no more than its symbols at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefspark.llm.common import per_worker, slices, stored

#: A-Z to a-z
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: what stands between words
SPACES = b" \t\n\v\f\r"
#: bits that share one set of weights before it is refined, and how fast
STEP, RATE = 128, 0.01
#: hashed contexts beside the node alone, of tokens and of bytes; gates; words that count as function words
TOKEN_CONTEXTS, BYTE_CONTEXTS, GATES, FUNCTION = 3, 4, 3, 64
#: symbols of a text, and bytes of texts, that are worked off together
STRETCH, PART = 1 << 18, 1 << 20
#: what a predictor says, for the fit of the first weights: nothing, or one of seven levels either way, which end at
#: these shares of its mean size
LEVELS, _ENDS = 16, (0.25, 0.5, 1.0, 1.5, 2.0, 3.0)
_BLOCK = 1 << 13
_PAD = 5


def huffman(weights: list[int], first_node: int) -> tuple:
    """Bits per symbol, then all paths from the root as (node, branch) in one row, and the next free node."""
    import heapq

    import numpy as np

    count = len(weights)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    above, branch, n = np.zeros(2 * count, np.int64), np.zeros(2 * count, np.uint8), count
    while len(heap) > 1:
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        above[left] = above[right] = n
        branch[right] = 1
        heapq.heappush(heap, (a + b, n))
        n += 1
    depth = np.zeros(2 * count, np.int64)
    for i in range(n - 2, -1, -1):
        depth[i] = depth[above[i]] + 1
    sizes = depth[:count]
    at, now = np.cumsum(sizes) - 1, np.arange(count)
    nodes, bits = np.zeros(int(sizes.sum()), np.int32), np.zeros(int(sizes.sum()), np.uint8)
    while True:
        go = depth[now] > 0
        if not go.any():
            return sizes, nodes, bits, first_node + max(count - 1, 0)
        at, now = at[go], now[go]
        nodes[at], bits[at] = first_node + above[now] - count, branch[now]
        at, now = at - 1, above[now]


class Code:
    """Symbols: common words by frequency, the escape, the end, 256 bytes, the stop; and their bits."""

    def __init__(self, common: list[tuple[bytes, int]], rare: int, ends: int, byte_counts: list[int]):
        import numpy as np

        n = len(common)
        self.number = {w: i for i, (w, _) in enumerate(common)} | {b"": n + 1}
        self.escape, self.end, self.first_byte, self.stop, self.start = n, n + 1, n + 2, n + 258, n + 259
        sizes, node, bit, nodes = huffman([c for _, c in common] + [rare + 1, ends + 1], 0)
        more_sizes, more_node, more_bit, self.nodes = huffman([c + 1 for c in byte_counts], nodes)
        self.sizes, self.node, self.bit = np.r_[sizes, more_sizes], np.r_[node, more_node], np.r_[bit, more_bit]
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.byte_symbols = np.arange(256) + self.first_byte
        self.byte_symbols[10] = self.stop  # words hold no \n; it ends them here

    @staticmethod
    def _padded(symbols, sizes, start: int) -> tuple:
        """The symbols with ``_PAD`` starts before each row of ``sizes`` symbols, and where the rows begin."""
        import numpy as np

        pads = np.arange(1, len(sizes) + 1) * _PAD
        out = np.full(len(symbols) + _PAD * len(sizes), start, np.int32)
        out[np.arange(len(symbols)) + np.repeat(pads, sizes)] = symbols
        return out, np.cumsum(sizes) - sizes + pads

    def tokens(self, texts: list[bytes], spelled: bool = True) -> tuple:
        """(symbols of all texts, where each begins, tokens per text, their symbols again without starts, the rare words if ``spelled``)."""
        from itertools import repeat

        import numpy as np

        words, sizes = [], []
        for text in texts:
            own = text.translate(LOWER).split()
            words += own
            words.append(b"")
            sizes.append(len(own) + 1)
        ids = np.fromiter(map(self.number.get, words, repeat(self.escape)), np.int32, len(words))
        rare = np.flatnonzero(ids == self.escape).tolist() if spelled else []
        return *self._padded(ids, np.array(sizes), self.start), np.array(sizes), ids, [words[i] for i in rare]

    def letters(self, words: list[bytes]) -> tuple:
        """(symbols of the bytes of all words, each with its stop, where each begins, symbols per word)."""
        import numpy as np

        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        symbols = self.byte_symbols[np.frombuffer(b"\n".join(words) + b"\n" if words else b"", np.uint8)]
        return *self._padded(symbols, sizes, self.start), sizes

    def function_words(self, symbols, begin):
        """The last function word before each symbol, the start where there is none."""
        import numpy as np

        last = np.where(symbols < min(FUNCTION, self.escape), np.arange(len(symbols)), -1)
        last[begin - 1] = begin - 1
        np.maximum.accumulate(last, out=last)
        out = np.full(len(symbols), self.start, np.int32)
        out[1:] = symbols[np.maximum(last[:-1], 0)]
        return out

    def events(self, symbols, at, bits: int, functions=None):
        """For the symbols at the places ``at``: bits per symbol, branches, and slots, one array per predictor.

        ``functions`` belong to tokens; bytes have none.
        """
        import numpy as np

        own, u = symbols[at], np.uint32
        p = [symbols[at - k].astype(u) for k in range(1, 6 if functions is None else 3)]

        def mixed(*parts):
            h = np.full(len(at), 0x2545F491, u)
            for x in parts:
                h = (h ^ x) * u(0x9E3779B1)
                h ^= h >> u(15)
            return h

        contexts = [mixed(*p[:k]) for k in (1, 2, 3, 5)] if functions is None else [mixed(functions[at].astype(u)), mixed(p[0]), mixed(p[0], p[1])]
        sizes = self.sizes[own]
        which = np.arange(int(sizes.sum()))
        which += np.repeat(self.offsets[own] - (np.cumsum(sizes) - sizes), sizes)
        node = self.node[which]

        def slots() -> Iterator:
            yield node
            mark = node.astype(u) * u(0x85EBCA6B)
            for k, h in enumerate(contexts):
                h = np.repeat(h, sizes)
                h ^= mark
                h *= u(0xC2B2AE35)
                h >>= u(32 - bits)
                h += u(self.nodes + (k << bits))
                yield h

        return sizes, self.bit[which], slots()


def log_odds(zeros, ones):
    """What a predictor says: the log odds of its counts, the weaker the less it has seen."""
    import numpy as np

    n = zeros + ones
    return (np.log((ones + 0.4) / (zeros + 0.4)) * (n / (n + 1.0))).astype(np.float32)


def inputs(said: Iterator, n: int, contexts: int):
    """(inputs of the mixer: what the predictors say and a constant, column by column; gates) of n bits"""
    import numpy as np

    x = np.full((n, contexts + 2), 0.3, np.float32, "F")
    for k, one in enumerate(said):
        x[:, k] = one
    return x, (x[:, -3] != 0).astype(np.int8) + (x[:, -2] != 0)


def fitted(x, gates, y, weight, rounds: int = 8):
    """Weights of every gate by Newton's method on the log loss, drawn towards an even mix; a row counts ``weight`` times."""
    import numpy as np

    even = np.full(x.shape[1], 1.0 / (x.shape[1] - 1))
    out = np.tile(even, (GATES, 1))
    for g in range(GATES):
        of = gates == g
        xs, ys, n, w = x[of].astype(np.float64), y[of], weight[of].astype(np.float64), out[g]
        for _ in range(rounds if len(ys) else 0):
            p = 1 / (1 + np.exp(-np.clip(xs @ w, -14, 14)))
            slope = xs.T @ (n * (ys - p)) - 4.0 * (w - even)
            w += np.linalg.solve((xs * (n * p * (1 - p))[:, None]).T @ xs + 4.0 * np.eye(len(w)), slope)
    return out.astype(np.float32)


def mix(x, gates, y, lengths, weights):
    """log2 of the probability of every bit; ``lengths`` bits belong to each text, ``weights`` (text, gate, input) are refined in place.

    Texts are worked off side by side, ``STEP`` bits of each at a time: what one step needs lies together, in one row for
    each text that goes on, the longest first.
    """
    import numpy as np

    steps = -(-lengths // STEP)
    order = np.argsort(-steps, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    going = np.searchsorted(-steps[order], -np.arange(int(steps.max()) if len(steps) else 0), "left")  # texts that go on, by step
    first = np.cumsum(going) - going
    step = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
    rows = first[step] + np.repeat(rank, steps)
    sizes = np.minimum(np.repeat(lengths, steps) - step * STEP, STEP)
    at = np.arange(len(y)) + np.repeat(rows * STEP - (np.cumsum(sizes) - sizes), sizes)

    def placed(columns, kind):
        out = np.zeros((len(columns), len(rows) * STEP), kind)
        for row, values in zip(out, columns):
            row[at] = values
        return out.reshape(len(columns), -1, STEP)

    columns, (lanes, bits) = placed(x.T, np.float32), placed((gates, y), np.int8)
    own, p = weights[order], np.empty(bits.shape, np.float32)
    every = np.arange(GATES, dtype=np.int8)[:, None]
    for low, k in zip(first.tolist(), going.tolist()):
        now = slice(low, low + k)
        xs, gate = columns[:, now].transpose(1, 0, 2), (lanes[now, None] == every).astype(np.float32)
        said = np.matmul(own[:k], xs)
        said *= gate
        q = 1 / (1 + np.exp(np.clip(-said.sum(1), -14, 14)))
        p[now] = q
        gate *= ((bits[now] - q) * np.float32(RATE))[:, None]
        own[:k] += np.einsum("kgs,kjs->kgj", gate, xs)  # places without a bit have no input
    weights[order] = own
    p = p.reshape(-1)[at]
    return np.log2(np.where(y, p, 1 - p))


class Model:
    """A code, the log odds of all slots and the fitted weights of tokens and of bytes."""

    def __init__(self, code: Code, counts, weights: tuple, bits: int):
        self.code, self.bits, (self.weights, self.byte_weights) = code, bits, weights
        self.said = log_odds(counts[:, 0].astype("f8"), counts[:, 1].astype("f8"))

    def score(self, texts: list[bytes]) -> tuple:
        """(log2 probability of each text without the spelling of rare words, tokens per text, their symbols, rare words)"""
        import numpy as np

        symbols, begin, sizes, ids, words = self.code.tokens(texts)
        functions = self.code.function_words(symbols, begin)
        total, weights = np.zeros(len(texts)), np.tile(self.weights, (len(texts), 1, 1))
        for first in range(0, int(sizes.max()), STRETCH):
            on = np.flatnonzero(sizes > first)
            n = np.minimum(sizes[on] - first, STRETCH)
            ends = np.cumsum(n)
            at = np.repeat(begin[on] + first - (ends - n), n) + np.arange(int(ends[-1]))
            told, y, slots = self.code.events(symbols, at, self.bits, functions)
            x, gates = inputs((self.said[s] for s in slots), len(y), TOKEN_CONTEXTS)
            ends = np.r_[0, np.cumsum(told)][np.r_[0, ends]]
            own = weights[on]
            bits = np.r_[0, np.cumsum(mix(x, gates, y, np.diff(ends), own), dtype=np.float64)]
            weights[on] = own
            total[on] += np.diff(bits[ends])
        return total, sizes, ids, words

    def spell(self, words: list[bytes]):
        """log2 probability of the bytes of each word and its stop."""
        import numpy as np

        symbols, begin, sizes = self.code.letters(words)
        ends = np.cumsum(sizes)
        at = np.repeat(begin - (ends - sizes), sizes) + np.arange(len(symbols) - _PAD * len(words))
        out = np.zeros(len(at))
        for i in range(0, len(at), STRETCH):
            told, y, slots = self.code.events(symbols, at[i:i + STRETCH], self.bits)
            x, gates = inputs((self.said[s] for s in slots), len(y), BYTE_CONTEXTS)
            p = 1 / (1 + np.exp(np.clip(-np.einsum("ak,ak->a", x, self.byte_weights[gates]), -14, 14)))
            bits = np.r_[0, np.cumsum(np.log2(np.where(y, p, 1 - p)), dtype=np.float64)]
            out[i:i + STRETCH] = np.diff(bits[np.r_[0, np.cumsum(told)]])
        return np.add.reduceat(out, ends - sizes) if len(words) else out


def _source(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def token_counts(docs: DataFrame, learn: Column, text_col: str = "text") -> DataFrame:
    """``word, c``: occurrences in training texts of every word of any text, and of the end as the empty word."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa
        import pyarrow.compute

        for batch in slices(batches, 0):
            for part, of_training in ((batch.filter(batch.column(1)), True), (batch.filter(pa.compute.invert(batch.column(1))), False)):
                counts = Counter(b"\n".join(part.column(0).cast(pa.binary()).to_pylist()).translate(LOWER).split())
                counts[b""] = part.num_rows
                n = list(counts.values()) if of_training else [0] * len(counts)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    flagged = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return flagged.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _byte_counts(rare: DataFrame) -> list[int]:
    """Occurrences of the 256 bytes in rare words, and of their ends."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums = np.zeros(257)
        for batch in slices(batches, 0):
            words, c = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_numpy()
            sums[:256] += np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(c, list(map(len, words))), 256)
            sums[256] += c.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(257)), pa.array(sums.astype(np.int64))], ["byte", "n"])

    found = rare.select("word", "c").mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    out = [0] * 257
    for byte, n in found:
        out[byte] = n
    return out


def branch_counts(docs: DataFrame, rare: DataFrame, held, mark: str, bits: int, text_col: str = "text"):
    """Counts of both branches in every slot, over all rows of ``docs`` and all rare words, each as often as it occurs;
    (slots, 2), halved evenly where they pass 16 bits.

    The number of slots is fixed, so that is what is gathered and told to all workers.
    """
    import numpy as np

    def counted(told) -> Iterator:
        """``told(code)`` gives events with the weight of each symbol."""
        import zlib

        import numpy as np
        import pyarrow as pa

        code = per_worker(("mixing code", mark), lambda: Code(*held.value))
        counts = np.zeros(2 * (code.nodes + (BYTE_CONTEXTS << bits)), np.int64)
        for (sizes, y, slots), weight in told(code):
            weight = 1 if weight is None else np.repeat(weight, sizes)
            for slot in slots:
                np.add.at(counts, (slot.astype(np.int64) << 1) + y, weight)
        for i in range(0, len(counts), 2 * _BLOCK):
            part = counts[i:i + 2 * _BLOCK]
            if most := int(part.max()):
                short = part.astype(np.min_scalar_type(most))  # told and packed in as few bytes as they need
                yield pa.RecordBatch.from_arrays([pa.array([i // (2 * _BLOCK)]), pa.array([short.itemsize]), pa.array([zlib.compress(short.tobytes(), 1)], pa.binary())], ["block", "width", "data"])

    def of_texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told(code: Code) -> Iterator:
            for batch in slices(batches, 0, PART):
                symbols, begin, *_ = code.tokens(batch.column(0).cast(pa.binary()).to_pylist(), False)
                functions, at = code.function_words(symbols, begin), np.flatnonzero(symbols != code.start)
                for i in range(0, len(at), STRETCH):
                    yield code.events(symbols, at[i:i + STRETCH], bits, functions), None

        yield from counted(told)

    def of_words(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told(code: Code) -> Iterator:
            for batch in slices(batches, 0, PART):
                symbols, _, sizes = code.letters(batch.column(0).cast(pa.binary()).to_pylist())
                weight, at = np.repeat(batch.column(1).to_numpy(), sizes), np.flatnonzero(symbols != code.start)
                for i in range(0, len(at), STRETCH):
                    yield code.events(symbols, at[i:i + STRETCH], bits), weight[i:i + STRETCH]

        yield from counted(told)

    def add(batches: Iterator) -> Iterator:
        """Blocks come sorted: one is open at a time."""
        import zlib

        import numpy as np
        import pyarrow as pa

        def closed(block, total):
            total = total.reshape(-1, 2)
            most = np.maximum(total.max(1, keepdims=True), 1)
            small = np.where(most > 65535, np.rint(total * (65535 / most)), total).astype(np.uint16)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([zlib.compress(small.tobytes())], pa.binary())], ["block", "data"])

        now, total = None, None
        for batch in batches:
            for block, size, data in zip(*(column.to_pylist() for column in batch.columns)):
                part = np.frombuffer(zlib.decompress(data), f"u{size}").astype(np.int64)
                if block == now:
                    total = total + part
                else:
                    if now is not None:
                        yield closed(now, total)
                    now, total = block, part
        if now is not None:
            yield closed(now, total)

    width, schema = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block long, width long, data binary"
    both = _source(docs, text_col).mapInArrow(of_texts, schema).unionAll(rare.where("c > 0").select("word", "c").mapInArrow(of_words, schema))
    parts = both.repartition(width, "block").sortWithinPartitions("block")
    out = np.zeros((Code(*held.value).nodes + (BYTE_CONTEXTS << bits), 2), np.uint16)
    import zlib

    for block, data in parts.mapInArrow(add, "block long, data binary").toLocalIterator():
        small = np.frombuffer(zlib.decompress(data), np.uint16).reshape(-1, 2)
        out[block * _BLOCK:block * _BLOCK + len(small)] = small
    return out


def levels(code: Code, counts, bits: int) -> tuple:
    """(level of what every slot says to a bit of 0 and of 1, which is taken out of the counts that foretell it; what a
    level of a predictor says: the mean over all bits it foretells)"""
    import numpy as np

    edges = [0, *(code.nodes + (k << bits) for k in range(BYTE_CONTEXTS + 1))]
    table, said = np.zeros((len(counts), 2), np.uint8), np.zeros((BYTE_CONTEXTS + 1, LEVELS))

    def parts(low: int, high: int) -> Iterator:
        for i in range(low, high, _BLOCK):
            part = counts[i:min(i + _BLOCK, high)].astype("f8")
            for bit in (0, 1):
                own = np.maximum(part - (np.arange(2) == bit), 0)
                yield slice(i, i + len(part)), bit, part[:, bit], log_odds(own[:, 0], own[:, 1])

    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        size, n = np.sum([((seen * np.abs(odds)).sum(), seen[odds != 0].sum()) for _, _, seen, odds in parts(low, high)] or [(0, 0)], axis=0)
        ends, sums, n = np.array(_ENDS) * size / max(n, 1), np.zeros(LEVELS), np.zeros(LEVELS)
        for at, bit, seen, odds in parts(low, high):
            level = np.where(odds == 0, 0, 1 + np.digitize(np.abs(odds), ends) + 7 * (odds < 0))
            table[at, bit] = level
            sums += np.bincount(level, seen * odds, LEVELS)
            n += np.bincount(level, seen, LEVELS)
        said[k] = sums / np.maximum(n, 1)
    return table, said


def cells(table, y, slots: Iterator, contexts: int, weight=None):
    """How many bits of each value met each set of levels; the last predictor and the bit change fastest."""
    import numpy as np

    flat, at, one = table.reshape(-1), np.zeros(len(y), np.int32), y.astype(np.uint32)
    for slot in slots:
        at <<= 4
        at |= flat[(slot.astype(np.uint32) << np.uint32(1)) | one]
    return np.bincount((at << 1) | y, weight, 2 * LEVELS ** (contexts + 1)).astype(np.int64, copy=False)


def weights_of(counted, said, contexts: int):
    """Weights fitted to counted cells."""
    import numpy as np

    cell = np.flatnonzero(counted)
    level = [(cell >> (1 + 4 * (contexts - k))) & (LEVELS - 1) for k in range(contexts + 1)]
    x, _ = inputs((said[k][at] for k, at in enumerate(level)), len(cell), contexts)
    return fitted(x, (level[-2] > 0).astype(np.int8) + (level[-1] > 0), cell & 1, counted[cell])


def first_weights(code: Code, counts, texts: list[bytes], bits: int) -> tuple:
    """Weights of tokens and of bytes fitted to texts in one process; each bit is taken out of the counts that foretell it."""
    import numpy as np

    table, said = levels(code, counts, bits)
    symbols, begin, _, _, rare = code.tokens(texts or [b""])
    spelled, *_ = code.letters(rare)
    out = []
    for row, functions, contexts in ((symbols, code.function_words(symbols, begin), TOKEN_CONTEXTS), (spelled, None, BYTE_CONTEXTS)):
        _, y, slots = code.events(row, np.flatnonzero(row != code.start), bits, functions)
        out.append(weights_of(cells(table, y, slots, contexts), said, contexts))
    return tuple(out)


def all_weights(docs: DataFrame, rare: DataFrame, held, mark: str, counts, bits: int, text_col: str = "text") -> tuple:
    """``first_weights`` of all rows of ``docs``; ``rare`` are their rare words, each as often as it occurs.

    The number of cells is fixed, so that is what is summed up and gathered.
    """
    import numpy as np

    spark = docs.sparkSession
    table, said = levels(Code(*held.value), counts, bits)
    told = spark.sparkContext.broadcast(table)

    def summed(contexts: int, events) -> Iterator:
        """``events(code)`` gives branches, slots and the weight of each bit."""
        import numpy as np
        import pyarrow as pa

        code = per_worker(("mixing code", mark), lambda: Code(*held.value))
        total = np.zeros(2 * LEVELS ** (contexts + 1), np.int64)
        for y, slots, weight in events(code):
            total += cells(told.value, y, slots, contexts, weight)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), contexts)), pa.array(at), pa.array(total[at])], ["contexts", "cell", "n"])

    def of_texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def events(code: Code) -> Iterator:
            for batch in slices(batches, 0, PART):
                symbols, begin, *_ = code.tokens(batch.column(0).cast(pa.binary()).to_pylist(), False)
                functions, at = code.function_words(symbols, begin), np.flatnonzero(symbols != code.start)
                for i in range(0, len(at), STRETCH):
                    _, y, slots = code.events(symbols, at[i:i + STRETCH], bits, functions)
                    yield y, slots, None

        yield from summed(TOKEN_CONTEXTS, events)

    def of_words(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def events(code: Code) -> Iterator:
            for batch in slices(batches, 0, PART):
                symbols, _, sizes = code.letters(batch.column(0).cast(pa.binary()).to_pylist())
                weight, at = np.repeat(batch.column(1).to_numpy(), sizes), np.flatnonzero(symbols != code.start)
                for i in range(0, len(at), STRETCH):
                    told_bits, y, slots = code.events(symbols, at[i:i + STRETCH], bits)
                    yield y, slots, np.repeat(weight[i:i + STRETCH], told_bits)

        yield from summed(BYTE_CONTEXTS, events)

    schema = "contexts long, cell long, n long"
    both = _source(docs, text_col).mapInArrow(of_texts, schema).unionAll(rare.where("c > 0").select("word", "c").mapInArrow(of_words, schema))
    found = both.groupBy("contexts", "cell").agg(F.sum("n").alias("n")).toArrow()
    contexts, cell, n = (found.column(k).to_numpy() for k in range(3))
    out = []
    for k in (TOKEN_CONTEXTS, BYTE_CONTEXTS):
        counted = np.zeros(2 * LEVELS ** (k + 1), np.int64)
        counted[cell[contexts == k]] = n[contexts == k]
        out.append(weights_of(counted, said, k))
    told.unpersist()
    return tuple(out)


def score(docs: DataFrame, learn: Column, common_bits: int = 16, table_bits: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10 of probabilities) and ``bits_per_byte`` of all rows of ``docs``.

    Rows where ``learn`` holds are learned from.  ``base_score`` is the smoothed single-token model over the same counts.
    """
    spark = docs.sparkSession
    train = docs.where(learn)
    counts = stored(token_counts(docs, learn, text_col), "token-counts")
    seen = F.col("c") > 0
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(seen.cast("long")), F.lit(0)), F.coalesce(F.max(F.when(F.col("word") == "", F.col("c"))), F.lit(0))).first()
    is_common = (F.col("word") != "") & seen & (F.col("c") * F.lit(1 << common_bits) >= n)  # at most 2 ** common_bits words
    rare_words = counts.where((F.col("word") != "") & ~is_common)
    rare, single = rare_words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0))).first()
    common = [(r.word.encode(), r.c) for r in counts.where(is_common).collect()]
    common.sort(key=lambda x: (-x[1], x[0]))
    told = (common, rare, ends, _byte_counts(rare_words))
    held, mark = spark.sparkContext.broadcast(told), uuid.uuid4().hex
    branches = branch_counts(train, rare_words, held, mark, table_bits, text_col)
    weights = all_weights(train, rare_words, held, mark, branches, table_bits, text_col)
    model = spark.sparkContext.broadcast((branches, weights))
    lows = [(c + 0.5) / (n + 0.5 * (v + 1)) for c in (*(c for _, c in common), 0, ends)]

    def ready() -> Model:
        return per_worker(("mixing model", mark), lambda: Model(per_worker(("mixing code", mark), lambda: Code(*held.value)), *model.value, table_bits))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        mine, base = ready(), np.log10(np.array(lows))
        for batch in slices(batches, 2, PART):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            mixed, tokens, ids, words = mine.score(texts)
            starts, is_rare = np.cumsum(tokens) - tokens, ids == mine.code.escape
            own = np.add.reduceat(np.where(is_rare, 0, base[ids]), starts)
            n_rare = np.add.reduceat(is_rare.astype(np.int64), starts)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_rare)].astype(np.int32)), pa.array(words, pa.binary()).cast(pa.string()))
            n_bytes = [len(t.translate(None, SPACES)) + k for t, k in zip(texts, tokens.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens), pa.array(n_bytes, pa.int64()), pa.array(own), pa.array(mixed * np.log10(2)), pa.array(n_rare), lists],
                ["row", "row_id", "n_tokens", "n_bytes", "base", "mixed", "n_rare", "rare"])

    def spell(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        mine = ready()
        for batch in slices(batches, 0, PART // 4):
            log10 = mine.spell(batch.column(0).cast(pa.binary()).to_pylist()) * np.log10(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(log10)], ["word", "c", "spelling"])

    source = _source(docs, text_col, F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("row_id"))
    kind = source.schema["row_id"].dataType.simpleString()
    parts = source.mapInArrow(run, f"row long, row_id {kind}, n_tokens long, n_bytes long, base double, mixed double, n_rare long, rare array<string>")
    parts = stored(parts, "mixed")
    share = (rare - single) / (rare + 1)
    mixed = F.log10(F.lit(share / max(rare, 1)) * F.col("c") + F.lit(1 - share) * F.pow(F.lit(10.0), F.greatest("spelling", F.lit(-300.0))))
    words = rare_words.select("word", "c").mapInArrow(spell, "word string, c long, spelling double").select(
        "word", seen.cast("long").alias("found"), F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1))).alias("base"),
        F.when(seen, mixed).otherwise(F.col("spelling") + F.log10(F.lit(1 - share))).alias("mixed"))
    # a word is one row of the smaller side, which is never skewed, so the many occurrences need not be sorted
    rare_tokens = parts.select("row", F.explode("rare").alias("word")).join(words.hint("shuffle_hash"), "word")
    of_rows = rare_tokens.groupBy("row").agg(F.sum("base").alias("more_base"), F.sum("mixed").alias("more_mixed"), F.sum("found").alias("n_found"))
    out = parts.drop("rare").join(of_rows, "row", "left").fillna(0, ["more_base", "more_mixed", "n_found"])
    end_known, total = F.lit(1 if ends else 0), F.col("mixed") + F.col("more_mixed")
    return out.select(
        F.col("row_id").alias(id_col), "n_tokens", (F.col("n_tokens") - F.col("n_rare") - 1 + end_known + F.col("n_found")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base")).alias("base_score"), total.alias("score"), (-total * F.lit(3.321928094887362) / F.col("n_bytes")).alias("bits_per_byte"))
