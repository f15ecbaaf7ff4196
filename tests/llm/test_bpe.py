import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from tables import ROWS, awkward, by_id

from reliefspark.llm import bpe
from reliefspark.llm.queries import PATTERN, RANKS


def library(path=RANKS):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_and_all_characters():
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        path = public_tokenizers.path(name)
        own, other, rng = bpe.Encoder(bpe.read_ranks(path), PATTERN), library(path), random.Random(4)
        texts = ["".join(rng.choice("abcdehinort  \n's'tL1289!#é漢​\t.,") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
        texts += [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(0, 0x3000)]
        for text in texts:
            ids = own.encode(text)
            assert ids == other.encode_ordinary(text)
            assert own.decode(ids) == text.encode()


def test_white_space_does_not_depend_on_earlier_texts():
    own, other = bpe.Encoder(bpe.read_ranks(RANKS), PATTERN), library()
    for text in ("a \u00a0 b", "a \u00a0 \u00a0 b", "a \u00a0 \u00a0 \u00a0 \u00a0 b", "a  b", "a   b", "a \n b", "a \n \n b \t \t c", " \u00a0", "x \u00a0 \u00a0"):
        assert own.encode(text) == other.encode_ordinary(text), text


def test_memories_may_be_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_MEMORY", 3)
    monkeypatch.setattr(bpe, "PAIR_MEMORY", 3)
    own, other = bpe.Encoder(bpe.read_ranks(RANKS), PATTERN), library()
    text = "Erreth was ofretihaou the that edouhe. 12 of thnd,\nreth " * 20
    assert own.encode(text) == other.encode_ordinary(text)


def test_awkward_rows(spark):
    other = library()
    got = by_id(bpe.encode(awkward(spark), RANKS, PATTERN), "n_tokens", "ids", "ids_sha256", "decoded_sha256")
    want = []
    for i, text in ROWS:
        ids = other.encode_ordinary(text or "")
        want.append((i, len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode(awkward(spark, []), RANKS, PATTERN).count() == 0


def test_documents(spark):
    from reliefspark.llm.queries import QUERIES
    other, sf = library(), "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for row in QUERIES["op7_byte_bpe"](spark, sf).collect():
        ids = other.encode_ordinary(texts[row.doc_id])
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and row.n_tokens == len(ids)
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
