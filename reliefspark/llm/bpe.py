"""Byte-level BPE by backtracking over longest matches.

A token list is the BPE encoding of its bytes exactly when every two neighbours are compatible, that is, when
encoding the bytes of the pair alone gives back the pair.  So each piece is covered from left to right with the
longest vocabulary match; where a neighbour is incompatible the match is shortened, and where nothing shorter is
left the previous token is taken back.  A position that was given up is never tried again, which makes the search
linear in the piece.  Bytes are mapped to Latin-1 characters, for which pyahocorasick holds the vocabulary.

Nulls are empty texts (no tokens).  Repeated rows are encoded one by one.  Texts of any length work: a piece is
looked up in slices no longer than the longest token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefspark.llm.common import per_worker, slices, text_bytes

#: pieces and pairs remembered per worker; both memories are emptied when full
PIECE_MEMORY, PAIR_MEMORY = 400_000, 500_000
#: marks that are a piece of their own behind a word and before a space
_MARKS = frozenset(".,;:!?)*%$&#")


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


class Encoder:
    """Encodes and decodes with one vocabulary; lives in a Python worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import ahocorasick
        import regex

        self.tokens = tokens
        self.split = regex.compile(pattern).findall
        self.rank = {token.decode("latin-1"): i for i, token in enumerate(tokens)}
        self.text = [token.decode("latin-1") for token in tokens]
        self.length = list(map(len, tokens))
        self.longest = max(self.length)
        self.names = [str(i) for i in range(len(tokens))]
        trie = ahocorasick.Automaton()
        for token, i in self.rank.items():
            trie.add_word(token, i)
        self.in_trie = trie.longest_prefix
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self._learn_merges()

    def _learn_merges(self) -> None:
        """The merge that makes each token, and the longest token that is a proper prefix of it."""
        rank, merged = self.rank, {}
        self.merged, self.parts, self.prefix = merged, [(i, i) for i in range(len(self.tokens))], [-1] * len(self.tokens)
        reachable = [n == 1 for n in self.length]
        for i, token in enumerate(self.text):
            for size in range(len(token) - 1, 0, -1):
                if (left := rank.get(token[:size], -1)) >= 0:
                    self.prefix[i] = left
                    break
        for i, token in enumerate(self.text):
            left = self.prefix[i]
            while left >= 0:
                right = rank.get(token[self.length[left]:], i)
                if left < i and right < i and reachable[left] and reachable[right] and self._keeps(left, right):
                    merged[left, right], self.parts[i], reachable[i] = i, (left, right), True
                    break
                left = self.prefix[left]
        # every start of a token -> the longest token made by merges that it begins with
        self.match: dict[str, int] = {}
        for i, token in enumerate(self.text):
            best = -1
            for size in range(1, len(token) + 1):
                start = token[:size]
                here = rank.get(start, -1)
                best = here if here >= 0 and reachable[here] else best
                self.match[start] = best
        self.prefix = [self.match.get(token[:-1], -1) for token in self.text]

    def _keeps(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens: undo their youngest merges beside the border in turn."""
        before = len(self.tokens)
        merged, parts = self.merged, self.parts
        while True:
            if merged.get((left, right), before) < before:
                return False
            inner, outer = parts[left][1], parts[right][0]
            if left > right and inner != left or outer == right:
                if inner == left:
                    return True
                before, left = left, inner
            else:
                before, right = right + 1, outer

    def _forget(self) -> None:
        if len(self.pairs) >= PAIR_MEMORY:
            self.pairs.clear()

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        text = piece.decode("latin-1")
        whole = self.rank.get(text, -1)
        if whole >= 0:
            return (whole,)
        size, longest = len(text), self.longest
        length, prefix, match, in_trie, pairs = self.length, self.prefix, self.match, self.in_trie, self.pairs
        given_up: set[int] = set()
        found: list[int] = []
        at, last, token = 0, -1, match[text[:in_trie(text[:longest])]]
        while True:
            while token >= 0:
                end = at + length[token]
                if end not in given_up:
                    if last < 0:
                        break
                    pair = last << 20 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        self._forget()
                        fits = pairs[pair] = self._keeps(last, token)
                    if fits:
                        break
                token = prefix[token]
            if token >= 0:
                found.append(token)
                if end == size:
                    return tuple(found)
                at, last = end, token
                ahead = text[end:end + longest]
                token = match[ahead[:in_trie(ahead)]]
            else:
                given_up.add(at)
                token = found.pop()
                at -= length[token]
                last = found[-1] if found else -1
                token = prefix[token]

    def _remember(self, piece: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(self.pieces) >= PIECE_MEMORY:
            self.pieces.clear()
        if len(piece) <= 64:
            self.pieces[piece] = ids
        return ids

    def _encode_slowly(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.pieces
        for piece in self.split(text):
            ids.extend(known.get(piece) or self._remember(piece, self.encode_piece(piece.encode())))
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text.

        The pattern never joins a character to a space behind it, and looks ahead only within white space.  So a
        text falls apart before every space that has no white space on either side.  What lies between is mostly a
        word, or a word with one punctuation mark: these need no pattern.  A text with other spacing goes through
        the pattern as a whole.
        """
        words = text.split(" ")
        if len(words) == 1 or not words[0] or words[0][-1].isspace():
            return self._encode_slowly(text)
        ids = self._encode_slowly(words[0])
        known, add, remember = self.pieces.get, ids.extend, self._remember
        for word in islice(words, 1, None):
            piece = " " + word
            part = known(piece)
            if part is not None:
                add(part)
            elif word.isalpha():
                add(remember(piece))
            elif word[:-1].isalpha() and word[-1] in _MARKS:
                piece = piece[:-1]
                add(known(piece) or remember(piece))
                add(known(word[-1]) or remember(word[-1]))
            elif not word or word[0].isspace() or word[-1].isspace():
                return self._encode_slowly(text)
            else:
                add(self._encode_slowly(piece))
        return ids

    def _encode_slowly(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.pieces
        for piece in self.split(text):
            ids.extend(known.get(piece) or self._remember(piece))
        return ids

    def _remember(self, piece: str) -> tuple[int, ...]:
        ids = self.encode_piece(piece.encode())
        if len(self.pieces) >= PIECE_MEMORY:
            self.pieces.clear()
        # white space is cut by what is around it, so the word loop must not find such a piece
        if len(piece) <= 64 and not piece.isspace():
            self.pieces[piece] = ids
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = True) -> DataFrame:
    """Encodes every text, decodes the ids again and returns digests of both.

    Columns: the id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space), ``decoded_sha256`` and, if
    asked for, ``ids`` (array of int).  The vocabulary is read on the driver and travels with the tasks; its size
    is that of the file, under 2 MB.  One map over the input partitions, nothing is shuffled.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    source = text_bytes(docs, id_col, text_col)
    kind = source.schema["row_id"].dataType.simpleString()
    schema = f"row_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = per_worker(("bpe", ranks_path, pattern), lambda: Encoder(tokens.value, pattern))
        sha, names = hashlib.sha256, coder.names.__getitem__
        for batch in slices(batches):
            counts, id_sums, text_sums, lists = [], [], [], []
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                counts.append(len(ids))
                id_sums.append(sha(" ".join(map(names, ids)).encode()).hexdigest())
                text_sums.append(sha(coder.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(pa.array(ids, pa.int32()))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            if with_ids:
                ends = pa.array([0, *accumulate(counts)], pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(lists) if lists else pa.array([], pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["row_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    out = source.mapInArrow(run, schema)
    return out.select(F.col("row_id").alias(id_col), *out.columns[1:])
