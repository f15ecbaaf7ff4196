"""Language identification with error-correcting output codes.

Every language gets a word of bits, far from the words of the others.  One logistic classifier per bit, over hashed
byte n-grams, predicts the bits of a text; loss-weighted decoding takes the language whose word costs the least
logistic loss.  Two languages that cost nearly the same make the answer ambiguous.

A null text, or one without a letter, is ``und`` with score 0.  So is every text if there is nothing to learn from.
Only the text enters a prediction.  Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefspark.llm.common import byte_texts, slices, text_bytes

ORDERS = (2, 3, 4)
SLOTS = 1 << 15
#: rows per language that are learned from: those with the smallest hashes of their id
SAMPLE = 400
#: parts in which a language's rows are ranked first
PARTS = 256
#: bytes looked at together
STEP = 1 << 18
_SPREAD = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def code_words(n: int):
    """One row of -1/+1 per language: all splits of few languages, random far words of many."""
    import numpy as np

    if n <= 6:
        splits = [[1 if mask >> i & 1 else -1 for i in range(n)] for mask in range(1, 1 << max(n - 1, 1)) if n > 1] or [[1]]
        return np.array(splits).T
    bits, best, most = 4 * (n - 1).bit_length() + 12, None, -1
    rng = np.random.default_rng(7)
    for _ in range(200):
        words = rng.choice([-1, 1], (n, bits))
        apart = ((words[:, None] != words[None]).sum(2) + bits * np.eye(n, dtype=int)).min()
        balanced = (np.abs(words.sum(0)) < n).all()
        if balanced and apart > most:
            best, most = words, apart
    return best


def _slots(data):
    """Per order, the table row of the n-gram that starts at each byte (at the end: of what little is left)."""
    import numpy as np

    b = np.concatenate([data, np.full(max(ORDERS), 32, np.uint8)]).astype(np.uint32)
    gram, out = b, []
    for n in range(2, max(ORDERS) + 1):
        gram = (gram[:-1] << np.uint32(8)) | b[n - 1:]
        if n in ORDERS:
            k = ORDERS.index(n)
            out.append(((gram * np.uint32(_SPREAD[k])) >> np.uint32(17)).astype(np.int64)[:len(data)] + k * SLOTS)
    return out


def _framed(text: bytes) -> bytes:
    return b" " + text.lower() + b" "


def train(rows: list[tuple[str, str]], rounds: int = 6, rate: float = 0.5):
    """(languages, code words, weights, biases) from (text, language) rows; AdaGrad over rows in a fixed order."""
    import numpy as np

    langs = sorted({lang for _, lang in rows})
    if not langs:
        return [], None, None, None
    words = code_words(len(langs)).astype(np.float32)
    bits = words.shape[1]
    weights, squares = np.zeros((len(ORDERS) * SLOTS, bits), np.float32), np.full((len(ORDERS) * SLOTS, bits), 1e-4, np.float32)
    bias, bias_squares = np.zeros(bits, np.float32), np.full(bits, 1e-4, np.float32)
    data = []
    for text, lang in rows:
        slots, counts = np.unique(np.concatenate(_slots(np.frombuffer(_framed(text.encode()), np.uint8))), return_counts=True)
        data.append((slots, (counts / counts.sum() * 10).astype(np.float32), words[langs.index(lang)]))
    order = np.random.default_rng(11)
    for _ in range(rounds):
        for i in order.permutation(len(data)):
            slots, x, want = data[i]
            pull = -want / (1 + np.exp(np.clip(want * (x @ weights[slots] + bias), -30, 30)))
            step = x[:, None] * pull
            squares[slots] += step ** 2
            weights[slots] -= rate * step / np.sqrt(squares[slots])
            bias_squares += pull ** 2
            bias -= 0.1 * rate * pull / np.sqrt(bias_squares)
    return langs, words, weights * 10, bias


def bit_margins(texts: list[bytes], weights, bias):
    """Classifier outputs, a row per text; long texts are summed over steps."""
    import numpy as np

    out = np.zeros((len(texts), weights.shape[1]), np.float64)
    at = 0
    while at < len(texts):
        chunk, size = [], 0
        while at + len(chunk) < len(texts) and (size < STEP or not chunk):
            chunk.append(_framed(texts[at + len(chunk)]))
            size += len(chunk[-1])
        lengths = np.array(list(map(len, chunk)))
        data = np.frombuffer(b"".join(chunk), np.uint8)
        ends = np.cumsum(lengths)
        for slots, n in zip(_slots(data), ORDERS):
            for last in range(1, n):  # n-grams that reach into the next text do not count
                slots[np.maximum(ends - last, ends - lengths)] = -1
            for begin in range(0, len(data), STEP):
                part = slots[begin:begin + STEP]
                gathered = weights[part]
                gathered[part < 0] = 0
                rows = np.searchsorted(ends, [begin, begin + len(part) - 1], "right")
                marks = np.maximum(ends[rows[0]:rows[1] + 1] - lengths[rows[0]:rows[1] + 1] - begin, 0)
                out[at + rows[0]:at + rows[1] + 1] += np.add.reduceat(gathered, marks, 0)
        out[at:at + len(chunk)] /= np.maximum(sum(np.maximum(lengths - n + 1, 0) for n in ORDERS), 1)[:, None]
        at += len(chunk)
    return out + bias


def decode(margins, words, near: float = 0.05):
    """(language, score, ambiguous) per row of classifier outputs, by loss-weighted decoding."""
    import numpy as np

    cost = np.logaddexp(0, -margins[:, None] * words[None]).sum(2)
    share = np.exp(cost.min(1, keepdims=True) - cost)
    share /= share.sum(1, keepdims=True)
    best = cost.argmin(1)
    ordered = np.sort(share, 1)
    ambiguous = ordered[:, -1] - ordered[:, -2] < near if words.shape[0] > 1 else np.zeros(len(best), bool)
    return best, ordered[:, -1], ambiguous


def sample_rows(docs: DataFrame, wanted: Column, per_lang: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most ``per_lang`` (text, language) rows of each language: those with the smallest hashes of their id.

    The hashes are ranked over the narrow columns; only the chosen rows, a bounded number, are read with their text.
    """
    ranked = docs.where(wanted & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("row_id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("rank"))
    # the first of each language are among the first of its parts; the parts keep a language's rows out of one task
    parts = F.pmod(F.col("rank"), F.lit(PARTS))
    for group in (["lang", parts], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("rank", "row_id"))
        ranked = ranked.withColumn("place", place).where(F.col("place") <= per_lang).drop("place")
    chosen = ranked.select("row_id", "lang").distinct()
    ids = chosen.collect()  # at most per_lang ids for each language
    if not ids:
        return []
    keys = docs.sparkSession.createDataFrame(ids, chosen.schema)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("row_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(keys), ["row_id", "lang"]).groupBy("row_id", "lang").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.lang, str(r.row_id)))]


def identify(docs: DataFrame, wanted: Column, per_lang: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             key_col: str | None = None) -> DataFrame:
    """The id, ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` of every row; learned from the rows ``wanted`` names.

    With ``key_col`` the rows are named by that column in place of the id, which then counts for learning only.
    """
    name = key_col or id_col
    held = docs.sparkSession.sparkContext.broadcast(train(sample_rows(docs, wanted, per_lang, id_col, text_col, lang_col)))
    source = text_bytes(docs, name, text_col)
    kind = source.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pyarrow as pa

        langs, words, weights, bias = held.value
        plain = re.compile(rb"[A-Za-z]").search

        def has_letter(text: bytes) -> bool:
            return bool(plain(text)) or any(map(str.isalpha, text.decode()))

        for batch in slices(batches):
            texts = list(byte_texts(batch.column(1)))
            scores, unsure = np.zeros(len(texts)), np.zeros(len(texts), bool)
            known = np.array([bool(langs) and has_letter(t) for t in texts], bool)
            found = np.array(["und"] * len(texts), object)
            if known.any():
                best, score, ambiguous = decode(bit_margins([t for t, k in zip(texts, known) if k], weights, bias), words)
                found[known], scores[known], unsure[known] = np.array(langs, object)[best], score, ambiguous
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure)], ["row_id", "lang_pred", "score", "ambiguous"])

    out = source.mapInArrow(run, f"row_id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.select(F.col("row_id").alias(name), *out.columns[1:])
