"""Phrase collocation mining: best-first branch-and-bound growth of phrases from their first words.

A phrase of 2 to 5 words scores ``1000 a n / (l r)``, rounded down, at its worst cut (``a`` its own occurrences, ``l``
and ``r`` those of both parts, ``n`` all words of the language).  A part occurs at least as often as the whole, so no
phrase that begins with a word of ``f`` occurrences scores over ``1000 n / f``: that is the bound of a frontier node.
The frontier is expanded from high bounds to low ones.  A round takes the next words of every language, grows them
word by word (a phrase grows only if it has ``least`` occurrences itself), then counts what its verdicts need
besides: the rests behind each cut, and what stands in front of each phrase.  A language is settled once its
``top``-th surviving score exceeds all bounds left; equal bounds are still expanded.

All counts are exact.  Workers pre-count their own stretch of text, Spark sums.  What to count is told to them by bit
filters of fixed size, which let too much through but nothing be missed; counts under ``least`` are dropped after summing.

Texts are split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words at blanks and tabs; A-Z are lower-cased.
A null text is empty, a null language is ``und``.  Repeated rows count again.  Ties are ordered by occurrences, then by
the bytes of the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefspark.llm.common import slices, stored

#: A-Z lower-cased, ends of pieces to \n, tabs to blanks
NORMAL = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: stands between pieces; no byte of a text
BREAK = b"\xff"
_STEP = 0x9E3779B97F4A7C15


def _mixed(h):
    """Spreads 64-bit sums over all bits."""
    import numpy as np

    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


class Filter:
    """A bit filter over (language, phrase) hashes, two bits each."""

    def __init__(self, bits: bytes, size: int):
        import numpy as np

        self.bits, self.size = np.frombuffer(bits, np.uint8), size

    @staticmethod
    def places(h, size: int) -> tuple:
        import numpy as np

        h, mask = _mixed(h), np.uint64((1 << size) - 1)
        return h & mask, (h >> np.uint64(32)) & mask

    def has(self, h):
        import numpy as np

        out = np.ones(len(h), bool)
        for at in self.places(h, self.size):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def filter_bits(rows: DataFrame, size: int) -> bytes:
    """The bits of the filter over the ``lang, phrase`` rows: ``2 ** size`` of them, whatever the number of rows."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sums = np.zeros(batch.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                h = 0
                for word in phrase.encode().split(b" "):
                    h = h * _STEP + _word_hash(word) & 0xFFFFFFFFFFFFFFFF
                sums[i] = h ^ _word_hash(lang.encode())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(Filter.places(sums, size)).astype(np.int64) + 1)], ["place"])

    places = rows.select("lang", "phrase").mapInArrow(run, "place long")
    blocks = places.groupBy(F.bitmap_bucket_number("place").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = bytearray(max(1 << size >> 3, 4096))
    for block, bits in blocks.toLocalIterator():
        out[(block - 1) * 4096:block * 4096] = bits
    return bytes(out)


class Stretch:
    """The words of some texts of one language, as numbers, and hashes of the windows over them."""

    def __init__(self, lang: bytes, texts: list[bytes]):
        import numpy as np

        joined = b"\n".join(texts).translate(NORMAL).replace(b"\n", b" \xff ")
        self.words = joined.split()
        number = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        self.ids = np.fromiter(map(number.__getitem__, self.words), np.int64, len(self.words))
        self.lang = np.uint64(_word_hash(lang))
        kinds = np.fromiter(map(_word_hash, number), np.uint64, len(number))
        self.sums = {1: kinds[self.ids]}
        self.whole = {1: self.ids != number.get(BREAK, -1)}

    def window(self, m: int) -> tuple:
        """(hashes, lie within a piece) of the windows of m words, by their first word."""
        import numpy as np

        if m not in self.sums:
            sums, whole = self.window(m - 1)
            self.sums[m] = sums[:-1] * np.uint64(_STEP) + self.sums[1][m - 1:]
            self.whole[m] = whole[:-1] & self.whole[1][m - 1:]
        return self.sums[m], self.whole[m]

    def in_filter(self, m: int, held: Filter):
        """Which windows of m words the filter lets through."""
        import numpy as np

        sums, out = self.window(m)
        out = out.copy()
        at = np.flatnonzero(out)
        out[at] = held.has(sums[at] ^ self.lang)
        return out

    def counted(self, at, m: int) -> tuple[list[bytes], list[int]]:
        """The different phrases of m words that begin at the places ``at``, and how often each does."""
        from collections import Counter

        import numpy as np

        _, first, inverse, counts = np.unique(self.window(m)[0][at], return_index=True, return_inverse=True, return_counts=True)
        lead = at[first]
        if all((self.ids[at + j] == self.ids[lead[inverse] + j]).all() for j in range(m)):
            return [b" ".join(self.words[i:i + m]) for i in lead.tolist()], counts.tolist()
        exact = Counter(b" ".join(self.words[i:i + m]) for i in at.tolist())  # two phrases of one hash
        return list(exact), list(exact.values())


def _count(source: DataFrame, choose, held: dict | None = None) -> DataFrame:
    """``lang, phrase, f`` summed over all texts; ``choose(stretch, filters)`` gives (places, m) pairs to count."""
    held = {k: (source.sparkSession.sparkContext.broadcast(bits), size) for k, (bits, size) in (held or {}).items()}

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        filters = {k: Filter(bits.value, size) for k, (bits, size) in held.items()}
        for batch in slices(batches):
            by_lang: dict[bytes, list[bytes]] = {}
            for lang, text in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                stretch = Stretch(lang, texts)
                for at, m in choose(stretch, filters):
                    phrases, counts = ([None], [int(stretch.whole[1].sum())]) if m == 0 else stretch.counted(np.flatnonzero(at), m)
                    if counts and counts[0]:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(counts), pa.binary()).cast(pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "f"])

    return source.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _all_words(stretch: Stretch, filters: dict) -> Iterator:
    yield None, 0
    yield stretch.whole[1], 1


def _longer(begun: int, sizes: tuple):
    """Windows of each size that extend a phrase of ``begun`` words of the filter ``prefix`` by frequent words."""

    def choose(stretch: Stretch, filters: dict) -> Iterator:
        if len(stretch.words) <= begun:
            return
        prefix, common = stretch.in_filter(begun, filters["prefix"]), stretch.in_filter(1, filters["word"])
        for m in sizes:
            if len(stretch.words) >= m:
                n = len(stretch.words) - m + 1
                wanted = stretch.window(m)[1] & prefix[:n]
                for k in range(begun, m):
                    wanted &= common[k:k + n]
                yield wanted, m

    return choose


def _rests_and_fronts(most: int):
    """Windows of the filter ``rest``, and those that put a frequent word in front of a phrase of the filter ``inner``."""

    def choose(stretch: Stretch, filters: dict) -> Iterator:
        common = stretch.in_filter(1, filters["word"])
        for m in range(2, min(most, len(stretch.words)) + 1):
            wanted = stretch.in_filter(m, filters["rest"]) if m < most else stretch.window(m)[1] & False
            if m > 2:
                wanted |= stretch.window(m)[1] & common[:len(wanted)] & stretch.in_filter(m - 1, filters["inner"])[1:]
            yield wanted, m

    return choose


def _grown(source: DataFrame, words: DataFrame, common: tuple, least: int, most: int, size: int) -> DataFrame:
    """``lang, phrase, f, m``: all phrases of 2 to ``most`` words with at least ``least`` occurrences that begin with ``words``."""
    out, prefix, size_of_prefix = None, words, 1
    begun = words.select("lang", F.col("phrase").alias("head"))
    while size_of_prefix < most:
        # few phrases are longer than three words: two sizes in one look at the texts
        sizes = tuple(range(size_of_prefix + 1, min(size_of_prefix + (2 if size_of_prefix >= 3 else 1), most) + 1))
        level = _count(source, _longer(size_of_prefix, sizes), {"word": common, "prefix": (filter_bits(prefix, size), size)})
        level = level.where(F.col("f") >= least).withColumn("head", F.split("phrase", " ")[0]).join(begun, ["lang", "head"], "left_semi")
        level = stored(level.select("lang", "phrase", "f", F.size(F.split("phrase", " ")).alias("m")), "phrases")
        size_of_prefix = sizes[-1]
        prefix, out = level.where(F.col("m") == size_of_prefix), level if out is None else out.unionByName(level)
        if level.isEmpty():
            break
    return out


def _part(k: Column, first: bool) -> Column:
    words = F.split("phrase", " ")
    return F.array_join(F.slice(words, F.lit(1), k) if first else F.slice(words, k + 1, F.col("m") - k), " ")


def _judged(grown: DataFrame, more: DataFrame, frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the phrases that no longer one of as many occurrences holds."""
    known = frequent.select("lang", "phrase", "f")
    l = known.unionByName(grown.select("lang", "phrase", "f")).select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    r = known.unionByName(more).select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = grown.select("lang", "phrase", "m", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("k"), True).alias("first"), _part(F.col("k"), False).alias("rest"))
    cuts = cuts.join(l, ["lang", "first"]).join(r, ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(1000 * a as decimal(20, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    words = F.split("phrase", " ")
    longer = grown.where("m > 2").select("lang", F.array_join(F.slice(words, F.lit(1), F.col("m") - 1), " ").alias("phrase"), F.col("f").alias("a"))
    fronts = more.select("lang", F.array_join(F.slice(words, F.lit(2), F.size(words) - 1), " ").alias("phrase"), F.col("f").alias("a"))
    held = longer.unionByName(fronts).distinct()
    return best.join(held, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def mine(docs: DataFrame, top: int = 2000, least: int = 100, most: int = 5, lang_col: str = "lang", text_col: str = "text", filter_size: int = 23,
         span: int = 64) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` surviving phrases of every language.

    The first round expands words of fewer than ``span * least`` occurrences; each further one ``span`` times as
    frequent words, or, where a language has ``top`` survivors, all words whose bound still reaches the last of them.
    """
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = stored(_count(source, _all_words).where((F.col("f") >= least) | F.col("phrase").isNull()), "words")
    totals = words.where("phrase is null").select("lang", F.col("f").alias("n"))
    frequent = words.where("phrase is not null").join(totals, "lang").withColumn("bound", F.expr("cast(1000 * cast(n as decimal(18, 0)) div f as long)"))
    frequent = stored(frequent, "frequent-words")
    common = (filter_bits(frequent, filter_size), filter_size)
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    survivors, reach, left = None, least, frequent
    while survivors is None or not left.isEmpty():
        reach *= span
        if survivors is None:
            now, left = left.where(F.col("f") < reach), left.where(F.col("f") >= reach)
        else:
            last = survivors.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top).where(F.col("rank") == top).select("lang", F.col("score").alias("last"))
            open_words = left.join(last, "lang", "left").where("last is null or bound >= last")
            now = stored(open_words.where((F.col("f") < reach) | F.col("last").isNotNull()).drop("last"), "words")
            left = stored(open_words.where((F.col("f") >= reach) & F.col("last").isNull()).drop("last"), "words")
            if now.isEmpty():
                continue
        grown = _grown(source, now, common, least, most, filter_size)
        rests = grown.select("lang", "m", "phrase", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).where("m - k >= 2")
        rests = rests.select("lang", _part(F.col("k"), False).alias("phrase")).distinct()
        held = {"word": common, "rest": (filter_bits(rests, filter_size), filter_size), "inner": (filter_bits(grown.where(F.col("m") < most), filter_size), filter_size)}
        more = stored(_count(source, _rests_and_fronts(most), held).where(F.col("f") >= least), "phrases")
        judged = stored(_judged(grown, more, frequent, totals), "survivors")
        survivors = judged if survivors is None else survivors.unionByName(judged)
    ranked = survivors.withColumn("rank", F.row_number().over(by_score).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
