"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word enters as the sum of what its hashed form and the mean of its hashed character n-grams contribute.  Texts are
cut into overlapping windows of ``WINDOW`` words, ``STRIDE`` apart; all are scored and the highest counts.  Labels
belong to texts, so training looks for the window that carries the label: at first the one with the most telling
words (by how often the words come in toxic and other texts), later the one the network itself scores highest.

Only the text enters a score.  A null or empty text, or one without words, has one window of padding and the score
that follows from it.  Without labelled rows of both kinds all scores are 0.  Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefspark.llm.common import byte_texts, per_worker, slices, text_bytes
from reliefspark.llm.quality import sample_rows

WINDOW, STRIDE = 32, 16
#: labelled rows of each class that are learned from: those with the smallest hashes of their id
SAMPLE = 1500
#: hashed words and n-grams, their width, hidden states per direction, attention width
SLOTS, WIDTH, HIDDEN, FOCUS = 1 << 13, 12, 8, 8
#: words remembered per worker, windows scored together
WORD_MEMORY, BATCH = 400_000, 4096
#: bytes to their form for words: A-Z lower-cased, other ASCII but a-z and 0-9 are spaces
_NORMAL = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def word_list(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def word_slots(words: list[bytes]):
    """(slot of each word, slots of all n-grams, their number per word); n-grams of 3 and 4 bytes of the framed word."""
    import zlib

    import numpy as np

    own = np.array([zlib.crc32(w) % SLOTS for w in words], np.int64)
    framed = [b"^" + w + b"$" for w in words]
    sizes = np.array(list(map(len, framed)))
    data = np.frombuffer(b"".join(framed) + b"   ", np.uint8).astype(np.uint32)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data) - 3)  # bytes up to the end of the word
    three = (data[:-3] << np.uint32(16)) | (data[1:-2] << np.uint32(8)) | data[2:-1]
    four = (three << np.uint32(8)) | data[3:]
    grams = np.stack([(three * np.uint32(0x9E3779B1)) >> np.uint32(19), (four * np.uint32(0x85EBCA6B)) >> np.uint32(19)], 1).astype(np.int64)
    real = np.stack([left >= 3, left >= 4], 1)
    counts = np.add.reduceat(real.sum(1), ends - sizes)
    return own, grams[real], counts


def start_weights(seed: int = 5) -> dict:
    import numpy as np

    rng = np.random.default_rng(seed)
    make = lambda *shape: (rng.normal(0, shape[0] ** -0.5, shape)).astype(np.float32)
    net = {"word": 0.3 * rng.normal(0, 1, (SLOTS, WIDTH)).astype(np.float32), "gram": 0.3 * rng.normal(0, 1, (SLOTS, WIDTH)).astype(np.float32)}
    for way in "fb":
        net |= {f"W{way}": make(2 * WIDTH, 3 * HIDDEN), f"U{way}": make(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
    return net | {"A": make(2 * HIDDEN, FOCUS), "a": make(FOCUS, 1), "o": make(2 * HIDDEN, 1), "k": np.full(1, -1, np.float32)}


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-x))


def inputs(net: dict, slots):
    """Word vectors, a row per word."""
    import numpy as np

    own, grams, counts = slots
    starts = np.cumsum(counts) - counts
    mean = np.add.reduceat(net["gram"][grams], starts, 0) / counts[:, None]
    return np.concatenate([net["word"][own], mean], 1).astype(np.float32)


def _pass(net: dict, way: str, projected, rows, mask, keep: bool):
    """Hidden states of one direction, (steps, windows, HIDDEN), and what the way back needs."""
    import numpy as np

    steps, H = rows.shape[1], HIDDEN
    hidden, memory = np.zeros((steps, len(rows), H), np.float32), []
    h, U = np.zeros((len(rows), H), np.float32), net[f"U{way}"]
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        x, u, m = projected[rows[:, t]], h @ U, mask[:, t, None]
        gates = _sigmoid(x[:, :2 * H] + u[:, :2 * H])
        z, r = gates[:, :H], gates[:, H:]
        n = np.tanh(x[:, 2 * H:] + r * u[:, 2 * H:])
        new = np.where(m, n + z * (h - n), h)
        if keep:
            memory.append((t, h, z, r, n, u[:, 2 * H:]))
        hidden[t] = h = new
    return hidden, memory


def forward(net: dict, projected: dict, rows, keep: bool = False):
    """Logit of every window; rows index the projected words, row 0 is padding."""
    import numpy as np

    mask = rows > 0
    parts, memory = zip(*(_pass(net, way, projected[way], rows, mask, keep) for way in "fb"))
    states = np.concatenate(parts, 2)
    seen = np.tanh(states @ net["A"])
    focus = np.where(mask.T, (seen @ net["a"])[:, :, 0], -30)
    focus = np.exp(focus - focus.max(0))
    focus /= focus.sum(0)
    pooled = np.einsum("tb,tbh->bh", focus, states)
    logit = pooled @ net["o"][:, 0] + net["k"][0]
    return logit, (mask, states, seen, focus, pooled, memory) if keep else None


def _backward(net: dict, rows, cache, pull, n_words: int):
    """Gradients of the layers, and of the projected words; ``pull`` is the gradient of the logits."""
    import numpy as np

    mask, states, seen, focus, pooled, memory = cache
    H, grad = HIDDEN, {}
    grad["o"], grad["k"] = (pooled.T @ pull)[:, None], np.array([pull.sum()])
    d_pooled = pull[:, None] * net["o"][:, 0]
    d_states = focus[:, :, None] * d_pooled
    d_focus = np.einsum("bh,tbh->tb", d_pooled, states)
    d_focus = focus * (d_focus - (focus * d_focus).sum(0)) * mask.T
    grad["a"] = np.einsum("tbk,tb->k", seen, d_focus)[:, None]
    d_seen = d_focus[:, :, None] * net["a"][:, 0] * (1 - seen ** 2)
    grad["A"] = np.einsum("tbh,tbk->hk", states, d_seen)
    d_states += d_seen @ net["A"].T
    d_words = {}
    for k, way in enumerate("fb"):
        U, d_U, d_h = net[f"U{way}"], np.zeros((H, 3 * H)), np.zeros((len(rows), H))
        d_words[way] = np.zeros((n_words, 3 * H))
        for t, h, z, r, n, u in reversed(memory[k]):
            d_new = d_h + d_states[t, :, k * H:(k + 1) * H]
            live = mask[:, t, None]
            d_n = np.where(live, d_new * (1 - z), 0) * (1 - n ** 2)
            d_z = np.where(live, d_new * (h - n), 0) * z * (1 - z)
            d_r = d_n * u * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_n], 1)
            d_u = np.concatenate([d_z, d_r, d_n * r], 1)
            d_U += h.T @ d_u
            d_h = np.where(live, d_new * z, d_new) + d_u @ U.T
            np.add.at(d_words[way], rows[:, t], d_x)
        d_words[way][0] = 0
        grad[f"U{way}"], grad[f"c{way}"] = d_U, d_words[way].sum(0)
    return grad, d_words


def windows_of(n: int) -> list[int]:
    """First words of the windows that cover n words."""
    return list(range(0, max(n - WINDOW, 0) + STRIDE, STRIDE)) if n > WINDOW else [0]


def cut(rows, n_docs_words: list[int]):
    """Window matrix (padding 0) over the concatenated words of texts, and the number of windows of each text."""
    import numpy as np

    firsts, ends, counts, at = [], [], [], 0
    for n in n_docs_words:
        own = windows_of(n)
        firsts += [at + f for f in own]
        ends += [at + n] * len(own)
        counts.append(len(own))
        at += n
    places = np.array(firsts, np.int64)[:, None] + np.arange(WINDOW)
    inside = places < np.array(ends, np.int64)[:, None]
    if not len(rows):
        return np.zeros((len(firsts), WINDOW), np.int64), np.array(counts)
    return np.where(inside, rows[np.minimum(places, len(rows) - 1)], 0), np.array(counts)


def project(net: dict, vectors) -> dict:
    """What each word adds to the gates, by direction; row 0 is padding."""
    import numpy as np

    blank = np.zeros((1, 3 * HIDDEN), np.float32)
    return {way: np.concatenate([blank, (vectors @ net[f"W{way}"] + net[f"c{way}"]).astype(np.float32)]) for way in "fb"}


def _slice_slots(slots, starts, rows):
    """The slots of some words (rows from 1)."""
    import numpy as np

    own, grams, counts = slots
    n = counts[rows - 1]
    places = np.repeat(starts[rows - 1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return own[rows - 1], grams[places], n


def train(texts: list[tuple[str, int]], rounds: int = 10, first_rounds: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 5):
    """(weights, scale, shift) from (text, 0/1) rows, or None without rows of both classes.  Adam; fixed seed."""
    import numpy as np

    marks = np.array([mark for _, mark in texts])
    if not len(marks) or not 0 < marks.sum() < len(marks):
        return None
    rng, net = np.random.default_rng(seed), start_weights(seed)
    index: dict[bytes, int] = {}
    lists = [[index.setdefault(w, len(index) + 1) for w in word_list(text.encode())] for text, _ in texts]
    slots = word_slots(list(index))
    gram_starts = np.cumsum(slots[2]) - slots[2]
    rows, counts = cut(np.array([r for own in lists for r in own], np.int64), list(map(len, lists)))
    owner = np.repeat(np.arange(len(marks)), counts)
    starts = np.cumsum(counts) - counts
    # how telling words and n-grams are: in how many texts of either class they come
    tell_word, tell_gram = np.zeros((2, SLOTS)), np.zeros((2, SLOTS))
    for own, mark in zip(lists, marks):
        if own:
            w, g, _ = _slice_slots(slots, gram_starts, np.unique(own))
            tell_word[mark, np.unique(w)] += 1
            tell_gram[mark, np.unique(g)] += 1
    sizes = np.array([(marks == 0).sum(), marks.sum()])[:, None]
    odds = [np.log((t[1] + 1) / (sizes[1] + 2)) - np.log((t[0] + 1) / (sizes[0] + 2)) for t in (tell_word, tell_gram)]
    telling = np.r_[0, odds[0][slots[0]] + np.maximum.reduceat(odds[1][slots[1]], gram_starts)]
    worth = np.sort(telling[rows], 1)[:, -2:].sum(1)
    memory = {name: (np.zeros_like(v, np.float64), np.zeros_like(v, np.float64)) for name, v in net.items()}
    step = 0
    for turn in range(rounds):
        if turn >= first_rounds:
            projected = project(net, inputs(net, slots))
            worth = np.concatenate([forward(net, projected, rows[i:i + BATCH])[0] for i in range(0, len(rows), BATCH)])
        best = np.maximum.reduceat(worth, starts)
        chosen = np.flatnonzero(worth == best[owner])
        chosen = chosen[np.unique(owner[chosen], return_index=True)[1]]
        free = np.flatnonzero(marks[owner] == 0)
        chosen = np.concatenate([chosen, rng.choice(free, min(len(free), len(marks)), replace=False)])
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // batch)):
            used, local = np.unique(rows[part], return_inverse=True)
            local = local.reshape(len(part), WINDOW)
            if used[0] == 0:
                used = used[1:]
            else:
                local = local + 1
            if not len(used):
                continue
            own = _slice_slots(slots, gram_starts, used)
            vectors = inputs(net, own)
            logit, cache = forward(net, project(net, vectors), local, keep=True)
            pull = (_sigmoid(logit) - marks[owner[part]]) / len(part)
            grad, d_words = _backward(net, local, cache, pull, len(used) + 1)
            d_vectors = sum(d_words[way][1:] @ net[f"W{way}"].T for way in "fb")
            for way in "fb":
                grad[f"W{way}"] = vectors.T @ d_words[way][1:]
            grad["word"], grad["gram"] = np.zeros((SLOTS, WIDTH)), np.zeros((SLOTS, WIDTH))
            np.add.at(grad["word"], own[0], d_vectors[:, :WIDTH])
            np.add.at(grad["gram"], own[1], np.repeat(d_vectors[:, WIDTH:] / own[2][:, None], own[2], 0))
            step += 1
            for name, g in grad.items():
                g = g + 1e-4 * net[name]
                m, v = memory[name]
                m += 0.1 * (g - m)
                v += 0.002 * (g ** 2 - v)
                net[name] -= (rate * m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.998 ** step)) + 1e-8)).astype(np.float32)
    projected = project(net, inputs(net, slots))
    logits = np.concatenate([forward(net, projected, rows[i:i + BATCH])[0] for i in range(0, len(rows), BATCH)])
    best = np.maximum.reduceat(logits, starts)
    scale, shift = _calibrated(best, marks)
    return net, scale, shift


def _calibrated(logits, marks, rounds: int = 300):
    """Scale and shift of the highest logit of a text that fit the labels; slightly drawn to (1, 0)."""
    import numpy as np

    scale, shift = 1.0, 0.0
    for _ in range(rounds):
        miss = _sigmoid(scale * logits + shift) - marks
        scale -= 0.05 * ((miss * logits).mean() + 0.01 * (scale - 1))
        shift -= 0.2 * (miss.mean() + 0.001 * shift)
    return max(float(scale), 0.1), float(shift)


class Scorer:
    """Scores texts with one network; keeps the projections of the words it has met."""

    def __init__(self, model):
        self.net, self.scale, self.shift = model
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.rows: dict[bytes, int] = {}
        self.projected = {way: np.zeros((1, 3 * HIDDEN), np.float32) for way in "fb"}
        self.size = 1

    def learn(self, words: list[bytes]) -> None:
        """Projects words that are new; the tables grow by doubling."""
        import numpy as np

        new = project(self.net, inputs(self.net, word_slots(words)))
        need = self.size + len(words)
        for way in "fb":
            table = self.projected[way]
            if need > len(table):
                table = np.concatenate([table, np.zeros((max(need, 2 * len(table)) - len(table), 3 * HIDDEN), np.float32)])
            table[self.size:need] = new[way][1:]
            self.projected[way] = table
        for word in words:
            self.rows[word] = len(self.rows) + 1
        self.size = need

    def score(self, texts: list[bytes]):
        """One score per text.  Texts are taken in groups of bounded size."""
        import numpy as np

        out, group, size = [], [], 0
        for text in texts:
            group.append(word_list(text))
            size += len(group[-1])
            if size > STRIDE * BATCH:
                out.append(self._group(group))
                group, size = [], 0
        out.append(self._group(group))
        return np.concatenate(out)

    def _group(self, lists: list[list[bytes]]):
        import numpy as np

        if not lists:
            return np.zeros(0)
        if len(self.rows) > WORD_MEMORY:
            self.forget()
        known = self.rows
        new = list(dict.fromkeys(w for own in lists for w in own if w not in known))
        if new:
            self.learn(new)
        rows = np.fromiter((known[w] for own in lists for w in own), np.int64)
        windows, counts = cut(rows, list(map(len, lists)))
        logits = np.concatenate([forward(self.net, self.projected, windows[i:i + BATCH])[0] for i in range(0, len(windows), BATCH)])
        return _sigmoid(self.scale * np.maximum.reduceat(logits, np.cumsum(counts) - counts).astype(np.float64) + self.shift)


def score(docs: DataFrame, labels: DataFrame, wanted: Column, per_class: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """The id and ``score`` (0 to 1) of every row; learned from the labelled rows that ``wanted`` (over ``row_id``) names."""
    import uuid

    held = docs.sparkSession.sparkContext.broadcast(train(sample_rows(docs, labels, label, per_class, id_col, text_col, wanted)))
    source, mark = text_bytes(docs, id_col, text_col), uuid.uuid4().hex
    kind = source.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def build():
            return mark, Scorer(held.value) if held.value else None

        # one network per worker: that of the job it works for
        box = per_worker(("toxicity",), dict)
        if box.get("mark") != mark:
            box["mark"], box["scorer"] = build()
        for batch in slices(batches):
            texts = list(byte_texts(batch.column(1)))
            scores = box["scorer"].score(texts) if box["scorer"] else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row_id", "score"])

    return source.mapInArrow(run, f"row_id {kind}, score double").withColumnRenamed("row_id", id_col)
