import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import piece_bpe as S

MODEL = P.path("piece_bpe_32k.model")
ODD = st.text(st.sampled_from("ab the z.,'s12é漢😀\n\t \x1c\x85\x00 ​́İ_<|>▁ﬁ①　"), max_size=60)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def encoded(bpe, texts):
    ids, same = bpe.encode(pa.array(texts, pa.string()))
    return ids.to_pylist(), same


@given(st.lists(ODD, max_size=4))
@settings(max_examples=200, deadline=None)
def test_batches_as_the_library(library, texts):
    assert encoded(S.coder(MODEL), texts) == ([library.encode(t, add_eos=True) for t in texts], [True] * len(texts))


@given(ODD)
@settings(max_examples=300, deadline=None)
def test_ids_and_text_as_the_library(library, text):
    bpe = S.coder(MODEL)
    (ids,), (same,) = encoded(bpe, [text])
    assert ids == library.encode(text, add_eos=True) and same
    assert all(bpe.merged(w) == np.frombuffer(bpe.merged_together([w])[0], "<i4").tolist() for w in S._WORD.findall("▁" + text.replace(" ", "▁")))
    assert bpe.decode(ids) == library.decode(ids)


@given(st.lists(st.integers(0, 400) | st.integers(0, 31999), max_size=12))
@settings(max_examples=300, deadline=None)
def test_any_ids_decode_as_by_the_library(library, ids):
    assert S.coder(MODEL).decode(ids) == library.decode(ids)


def test_long_words_and_a_full_memo(library):
    bpe = S.PieceBPE(MODEL, most=10)
    texts = ["a" * 3000 + " " * 50 + "漢字" * 500, " ".join(f"w{i}" for i in range(300)), "", " "]
    for _ in range(2):
        assert encoded(bpe, texts) == ([library.encode(t, add_eos=True) for t in texts], [True] * 4)
    assert len(bpe.older) > 10 and all(len(w) <= bpe.longest for w in bpe.memo)  # one batch may hold more than `most`


def test_a_difference_shows():
    bpe = S.PieceBPE(MODEL)
    bpe.pair_places[bpe.pair_symbols == bpe.id_of["▁the"]] = 1 << 30
    ids, same = encoded(bpe, ["the cat", "a cat", "the"])
    assert same == [False, True, False] and len(ids) == 3


def test_documents(spark, docs, no_docs, library):
    got = sorted(((str(r.doc_id), r.n_tokens, list(r.ids), r.decoded) for r in S.encode_documents(docs, MODEL).where("agrees").collect()), key=str)
    told = [(str(r.doc_id), library.encode(r.text or "", add_eos=True)) for r in docs.collect()]
    assert got == sorted(((d, len(ids), ids, library.decode(ids)) for d, ids in told), key=str)
    first = S.digests(S.encode_documents(docs.where("doc_id = 3"), MODEL)).first()
    ids = dict(told)["3"]
    assert first.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert first.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert S.encode_documents(no_docs, MODEL).collect() == []


def test_whole_table(spark, library):
    from .conftest import SMALL_DIR

    docs = spark.read.parquet(f"{SMALL_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) for r in S.op12_piece_bpe(spark, SMALL_DIR).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in docs:
        ids = library.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), True)
    assert got == want
