import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import periodic_runs as R

from .conftest import SMALL_DIR


def brute_runs(words, shortest=12):
    """Every stretch that keeps a period and cannot be extended, with the smallest period of each."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        start = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                if i - start + q >= max(shortest, 2 * q) and (start, i + q) not in found:
                    found[start, i + q] = q
                start = i + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def runs(texts):
    names = {}
    codes = [names.setdefault(w, len(names)) for t in texts for w in t]
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = [[] for _ in texts]
    begins = np.cumsum([0] + [len(t) for t in texts])
    for start, length, period in R.runs_of(np.array(codes, np.int64), of):
        got[of[start]].append((start - int(begins[of[start]]), length, period))
    return got


def periodic(r):
    """Words with nested, neighbouring and broken repeats."""
    out = []
    while len(out) < r.choice([0, 5, 30, 150, 400]):
        kind = r.random()
        if kind < 0.3:
            out += [r.randint(0, 4) for _ in range(r.randint(1, 12))]
        elif kind < 0.5:
            out += [r.randint(10, 10**6) for _ in range(r.randint(1, 5))]
        else:
            base = [r.randint(0, 3) for _ in range(r.choice([1, 2, 3, 5, 8, 9, 15, 17, 40]))]
            if r.random() < 0.4:
                base = base * r.randint(1, 6) + base[: r.randint(0, len(base))]
            out += (base * r.randint(1, 5))[: r.randint(1, 5 * len(base))]
            if r.random() < 0.3:
                out[r.randrange(len(out))] = r.randint(0, 9)
        if r.random() < 0.2:
            out += out
    return [str(w) for w in out[:700]]


@given(st.integers(0, 10**9))
@settings(max_examples=400, deadline=None)
def test_runs_against_all_lags(seed):
    r = random.Random(seed)
    texts = [periodic(r) for _ in range(r.randint(1, 4))]
    assert runs(texts) == [brute_runs(t) for t in texts]


@given(st.lists(st.integers(0, 1), max_size=90))
@settings(max_examples=400, deadline=None)
def test_runs_of_two_words(words):
    assert runs([[str(w) for w in words]]) == [brute_runs(words)]


def test_squares_around_one_break():
    words = ("abc" * 60 + "ab" + "abc" * 60)
    assert runs([list(words)]) == [brute_runs(words)]


@given(st.lists(st.integers(0, 12), max_size=120))
@settings(max_examples=200, deadline=None)
def test_splitting_until_nothing_is_single(codes):
    def split(lo, hi):
        single = [i for i in range(lo, hi) if codes[lo:hi].count(codes[i]) == 1]
        if not single:
            return [(lo, hi)] if hi - lo >= 6 else []
        return [s for a, b in zip([lo - 1, *single], [*single, hi]) if b - a - 1 >= 6 for s in split(a + 1, b)]

    assert R._settled(codes, 6) == split(0, len(codes))


def expected(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_against_all_lags(spark):
    docs = [r for r in spark.read.parquet(f"{SMALL_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in R.op11_periodic_runs(spark, SMALL_DIR).collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) >= len(docs) // 12
    for r in docs:
        if len(r.text or "") < 12000:
            assert got[r.doc_id] == expected(r.doc_id, r.text), r.doc_id


def test_hard_rows(spark, docs, hard_docs, no_docs):
    for rows in (docs.where("doc_id != 6"), hard_docs):  # the very long text is tested below
        given_ = [r for r in rows.select("doc_id", "text").collect() if r.doc_id is not None]
        got = [tuple(r) for r in R.digests(R.periodic_runs(R.with_repeats(rows))).collect() if r.doc_id is not None]
        assert sorted(got, key=str) == sorted((expected(r.doc_id, r.text) for r in given_), key=str)
    long = R.periodic_runs(docs.where("doc_id = 6").selectExpr("doc_id", "concat(text, ' ', text, ' ', text) AS text")).first()
    assert [tuple(r) for r in long.runs][0] == (0, long.n_words, long.n_words // 3) and len(long.collapsed.split()) == long.n_words // 3
    assert R.periodic_runs(no_docs).collect() == []
    odd = "a\x1cb \x1d \x85 c\x0bd\x0c\x0b " * 4
    row = R.periodic_runs(spark.createDataFrame([(1, odd)], "doc_id long, text string")).first()
    assert row.n_words == 5 * 4 and [tuple(x) for x in row.runs] == [(0, 20, 5)] and row.collapsed == "a\x1cb \x1d \x85 c d"


def test_query_against_sql(spark, duck):
    got = R.op11_periodic_runs(spark, SMALL_DIR)
    want = duck.sql(R.SQL)
    assert want.columns == got.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
