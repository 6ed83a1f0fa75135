import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import byte_bpe as B
from corpusloom.llm import token_files as T

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = st.text(st.sampled_from("ab z.,'s12é漢😀\n\t \x1c\x85 ​́İ_<|>"), max_size=60)


@given(st.integers(1, 33), st.lists(st.integers(0, 2**32), max_size=70), st.data())
@settings(max_examples=60, deadline=None)
def test_packing_round_trip_and_random_access(width, ids, data):
    width = min(width, 32)
    ids = np.array(ids, np.uint64) % np.uint64(2**width)
    packed = T.pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    a = data.draw(st.integers(0, len(ids)))
    assert T.unpack(packed, width, len(ids)).tolist() == ids.tolist()
    assert T.unpack(packed, width, len(ids) - a, a).tolist() == ids[a:].tolist()


@given(ODD)
@settings(max_examples=200, deadline=None)
def test_pieces_give_the_tokenizers_ids(text):
    memo = T._memo(WORDS)
    assert np.frombuffer(memo.encode([text])[0], "<u4").tolist() == memo.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_against_the_library(spark, docs, tmp_path):
    tokenizer = Tokenizer.from_file(WORDS)
    out = T.write_tokens(docs, str(tmp_path / "t"), WORDS, 1, block_tokens=500)
    got = sorted(T.read_documents(spark, out).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for (doc_id, text), r in zip(rows, got, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (doc_id, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    stream = [i for r in got for i in r.ids]
    part = sorted(T.read_range(spark, out, 400, 700).collect())
    assert [r.position for r in part] == [*range(400, 1100)] and [r.id for r in part] == stream[400:1100]


def test_no_documents(spark, no_docs, tmp_path):
    out = T.write_tokens(no_docs, str(tmp_path / "t"), WORDS)
    assert T.read_documents(spark, out).collect() == []
    assert B.encode_documents(no_docs, RANKS, P.PATTERN).collect() == []


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = B.PerfectHash(keys)
    assert sorted(h.slots) == [*range(5000)] and all(keys[h.find(k)] == k for k in keys)


@given(ODD)
@settings(max_examples=200, deadline=None)
def test_merges_as_the_library(reference_encoding, text):
    bpe = B.coder(RANKS, P.PATTERN)
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == reference_encoding.encode_ordinary(text)


def test_encode_documents(docs, reference_encoding):
    want = sorted(((str(r.doc_id), reference_encoding.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()), key=str)
    got = sorted(((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in B.encode_documents(docs, RANKS, P.PATTERN).collect()), key=str)
    assert got == want
    first = B.digests(B.encode_documents(docs.where("doc_id = 3"), RANKS, P.PATTERN)).first()
    assert first.decoded_sha256 == hashlib.sha256(want[[w[0] for w in want].index("3")][2]).hexdigest()
