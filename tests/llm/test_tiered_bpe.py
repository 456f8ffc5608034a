"""The two-tier encoder against the library, and its perfect hash."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lakequill.llm import tiered_bpe as T

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    rng = random.Random(3)
    odd = ["", " ", "a  b\n\n\n c \t\r\n", "it's WE'LL", "<|endoftext|> <s>", "漢字かな交じり文", "👩‍👩‍👧", "\x00\x1c\x85 　", "0123456789 ١٢٣", "a" * 3000, "ab" * 20_000]
    return odd + ["".join(rng.choice("abcdefgh éßñ漢,.'-\n 123") for _ in range(rng.randint(1, 400))) for _ in range(300)]


def test_ids_and_bytes_are_the_library_s(library):
    bpe = T.encoder(PATH, P.PATTERN)
    texts = _texts()
    for text, ids in zip(texts, bpe.encode_many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_every_entry_is_found_by_the_first_tier_and_nothing_else():
    bpe = T.encoder(PATH, P.PATTERN)
    keys = list(bpe.ranks)
    slots = bpe.hash.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))  # minimal: every slot once
    assert bpe.id_in[slots].tolist() == list(bpe.ranks.values())
    assert (bpe.hash.slots([k + b"\xff\xfe" for k in keys[:5000]]) == -1).all()


def test_a_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 20)
    bpe = T.TieredBPE(T.encoder(PATH, P.PATTERN).ranks, P.PATTERN)
    texts = _texts()
    for _ in range(2):
        for text, ids in zip(texts, bpe.encode_many(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert len(bpe.cache) < 5000


def test_columns(spark, library):
    rows = [(1, "Hello wörld", "x"), (1, "Hello wörld", "x"), (2, None, "y"), (None, "z", "y"), (3, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    got = sorted(map(tuple, T.map_codec(docs, PATH, P.PATTERN, T.digest, schema).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for key, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((key, len(ids), sha(" ".join(map(str, ids))), sha(text or "")))
    assert got == sorted(want, key=str)
    back = T.decode(T.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.data).decode()) for r in back if r.doc_id) == [(1, "Hello wörld")] * 2 + [(2, ""), (3, "")]
    assert T.map_codec(docs.where("false"), PATH, P.PATTERN, T.digest, schema).count() == 0
