"""Quality rules: lines of a text labelled content or boilerplate by a linear-chain conditional random field.

Lines with a word are the chain; their features are shape only (shares of symbols, capitals, digits and distinct
words, length, ending, repetition).  Viterbi decoding gives the most likely labelling, and the share of a text's
characters in content lines decides.  The field is trained here, on whole texts of labelled rows: lines of good
texts are content, lines of bad ones start as boilerplate and are labelled anew by the field after each pass, since
bad texts hold good lines too.

A null or empty text has no words and fails the base rules.  Without labelled rows of both kinds every line is
content.  Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefspark.llm.common import byte_texts, slices, text_bytes

#: labelled rows of each kind that are learned from: those with the smallest hashes of their id
SAMPLE = 500
#: share of characters in content lines from which a text is kept
CONTENT = 0.5
_SYMBOLS, _BLANK, _UPPER, _LOWER = b"#*$%&|<>", b" \t\n\x0b\x0c\r", bytes(range(65, 91)), bytes(range(97, 123))
_TAIL, _DIGITS = bytes(range(128, 192)), b"0123456789"
#: upper ends of the classes of each feature
_EDGES = {"symbols": (0.0, 0.02, 0.05, 0.15), "capitals": (0.1, 0.3, 0.7), "digits": (0.1, 0.3), "distinct": (0.3, 0.5, 0.8), "words": (2, 7, 30), "bars": (0, 2), "shouts": (0, 2)}
_FIRST, FEATURES = {}, 1
for _name, _edges in _EDGES.items():
    _FIRST[_name] = FEATURES
    FEATURES += len(_edges) + 1
_REPEATED, _UNENDED = FEATURES, FEATURES + 1
FEATURES += 2


def _slot(name: str, value: float) -> int:
    from bisect import bisect_left

    return _FIRST[name] + bisect_left(_EDGES[name], value)


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[int]:
    """Active features of a line with words."""
    n, size = len(words), len(line)
    capitals, small = size - len(line.translate(None, _UPPER)), size - len(line.translate(None, _LOWER))
    out = [
        0, _slot("symbols", (size - len(line.translate(None, _SYMBOLS))) / size), _slot("capitals", capitals / max(1, capitals + small) if n > 2 else 0),
        _slot("digits", (size - len(line.translate(None, _DIGITS))) / size), _slot("distinct", len(set(words)) / n if n > 3 else 1), _slot("words", n),
        _slot("bars", words.count(b"|")), _slot("shouts", line.count(b"!!"))]
    if repeated:
        out.append(_REPEATED)
    if words[-1][-1:] not in b".?!:;\")":
        out.append(_UNENDED)
    return out


def chain(text: bytes) -> tuple[list[list[int]], list[int], int]:
    """(features of each line with words, their lengths, number of them that repeat an earlier line)."""
    seen: set[bytes] = set()
    features, sizes, repeats = [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            repeats += again
            seen.add(line)
            features.append(line_features(line, words, again))
            sizes.append(len(line))
    return features, sizes, repeats


class Field:
    """Linear-chain field over two labels: 1 content, 0 boilerplate."""

    def __init__(self):
        import numpy as np

        self.emit = np.zeros(FEATURES)  # for content, against boilerplate
        self.step = np.zeros((2, 2))

    def viterbi(self, features: list[list[int]]) -> list[int]:
        emit, ((stay0, to1), (to0, stay1)) = self.weights
        best0 = best1 = 0.0
        back = []
        for active in features:
            gain = sum([emit[f] for f in active])
            if back:
                a, b = best0 + stay0, best1 + to0
                c, d = best0 + to1, best1 + stay1
                back.append((b > a, d >= c))
                best0, best1 = max(a, b), max(c, d) + gain
            else:
                back.append((False, False))
                best1 = gain
        label = best1 >= best0
        out = []
        for from0, from1 in reversed(back):
            out.append(int(label))
            label = from1 if label else from0
        return out[::-1]

    @property
    def weights(self):
        if getattr(self, "_plain", None) is None:
            self._plain = (self.emit.tolist(), self.step.tolist())
        return self._plain

    def fit(self, chains: list[list[list[int]]], labels: list[list[int]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Gradient ascent on the likelihood of the labels, all chains side by side (forward and backward sums)."""
        import numpy as np

        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        chains, labels = [chains[i] for i in order], [labels[i] for i in order]
        long = len(chains[0])
        x = np.zeros((long, len(chains), FEATURES), np.float32)
        y = np.zeros((long, len(chains)), int)
        for i, (lines, marks) in enumerate(zip(chains, labels)):
            for t, active in enumerate(lines):
                x[t, i, active] = 1
            y[:len(marks), i] = marks
        alive = [sum(len(c) > t for c in chains) for t in range(long)]
        total = sum(map(len, chains))
        squares, square_steps = np.full(FEATURES, 1e-6), np.full((2, 2), 1e-6)
        for _ in range(rounds):
            self._plain = None
            score = np.zeros((long, len(chains), 2))
            score[:, :, 1] = x @ self.emit
            forward, backward = score.copy(), np.zeros_like(score)
            for t in range(1, long):
                n = alive[t]
                forward[t, :n] += np.logaddexp.reduce(forward[t - 1, :n, :, None] + self.step, 1)
            for t in range(long - 2, -1, -1):
                n = alive[t + 1]
                backward[t, :n] = np.logaddexp.reduce((score[t + 1, :n] + backward[t + 1, :n])[:, None] + self.step, 2)
            norm = np.logaddexp.reduce(forward[0] + backward[0], 1)
            gain, steps = np.zeros(FEATURES), np.zeros((2, 2))
            for t in range(long):
                n = alive[t]
                content = np.exp(forward[t, :n, 1] + backward[t, :n, 1] - norm[:n])
                gain += (y[t, :n] - content) @ x[t, :n]
                if t:
                    joint = forward[t - 1, :n, :, None] + self.step + (score[t, :n] + backward[t, :n])[:, None]
                    steps -= np.exp(joint - norm[:n, None, None]).sum(0)
                    np.add.at(steps, (y[t - 1, :n], y[t, :n]), 1)
            gain, steps = gain / total - decay * self.emit, steps / total - decay * self.step
            squares += gain ** 2
            square_steps += steps ** 2
            self.emit += rate * gain / np.sqrt(squares)
            self.step += rate * steps / np.sqrt(square_steps)
        self._plain = None


def train(rows: list[tuple[str, int]], passes: int = 3, longest: int = 400) -> Field:
    """A field from (text, quality) rows.  Chains of many lines are cut into pieces of ``longest``."""
    field = Field()
    good, lines = [], []
    for text, quality in rows:
        whole = chain(text.encode())[0]
        for i in range(0, len(whole), longest):
            lines.append(whole[i:i + longest])
            good.append(int(quality))
    if not 0 < sum(good) < len(good):
        return field
    labels = [[mark] * len(piece) for piece, mark in zip(lines, good)]
    for _ in range(passes):
        field.fit(lines, labels)
        labels = [old if mark else field.viterbi(piece) for piece, mark, old in zip(lines, good, labels)]
    return field


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that are in the text twice or more."""
    import numpy as np

    n = len(words) - width + 1
    if n < 2:
        return 0
    sums = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + sums[k:k + n]
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # equal sums are only candidates: the words themselves decide
    places: dict[tuple[bytes, ...], list[int]] = {}
    for i in np.flatnonzero(np.isin(mixed, twice)).tolist():
        places.setdefault(tuple(words[i:i + width]), []).append(i)
    edges = np.zeros(len(words) + 1, int)
    for own in places.values():
        if len(own) > 1:
            np.add.at(edges, own, 1)
            np.add.at(edges, np.array(own) + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", wanted=None) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, 0/1) rows of each class: those with the smallest hashes of their id."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("row_id"), F.col(label).cast("int").alias("mark"))
    marks = marks.where(wanted) if wanted is not None else marks
    keys = []
    for mark in (0, 1):  # a bounded top list each, kept as a heap in every task
        own = marks.where(F.col("mark") == mark).select("row_id", "mark").distinct()
        keys += own.orderBy(F.xxhash64("row_id"), "row_id").limit(per_class).collect()
    if not keys:
        return []
    chosen = docs.sparkSession.createDataFrame(keys, marks.schema)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "row_id").groupBy("row_id", "mark").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.mark) for r in sorted(rows, key=lambda r: (r.mark, str(r.row_id)))]


def judge(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, content: float = CONTENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the base counts, ``base_failed``, ``content_share``, ``kept`` and ``line_labels`` (1 content; lines with words only)."""
    field = train(sample_rows(docs, labels, "quality", per_class, id_col, text_col))
    held = docs.sparkSession.sparkContext.broadcast(field)
    source = text_bytes(docs, id_col, text_col)
    kind = source.schema["row_id"].dataType.simpleString()
    names = ["row_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "line_labels"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        field = held.value
        for batch in slices(batches):
            columns = [[] for _ in names[1:]]
            for text in byte_texts(batch.column(1)):
                words = text.split()
                features, sizes, repeats = chain(text)
                marks = field.viterbi(features)
                share = sum(s for s, m in zip(sizes, marks) if m) / max(1, sum(sizes))
                points = len(text) - (len(text) - len(text.translate(None, _TAIL + _BLANK)))
                facts = (len(words), points, len(text) - len(text.translate(None, _SYMBOLS)), repeats, repeated_words(words), share, marks)
                for column, fact in zip(columns, facts):
                    column.append(fact)
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.list_(pa.int8())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    out = source.mapInArrow(run, f"row_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, line_labels array<tinyint>")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= content))
    return out.select(F.col("row_id").alias(id_col), *out.columns[1:])
