import hashlib
import zlib

import pytest

from corpusloom.llm import merkle_manifest as M

from .conftest import SMALL_DIR


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, added=0):
    values = [row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + added, row.text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fanout=2):
    """Root, and for each leaf its steps (own place, siblings)."""
    steps = [[] for _ in leaves]
    nodes, under = leaves, [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        runs = [range(k, min(k + fanout, len(nodes))) for k in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                for i in under[k]:
                    steps[i].append((k - run[0], [nodes[j] for j in run if j != k]))
        nodes, under = [sha("".join(nodes[j] for j in run)) for run in runs], [[i for j in run for i in under[j]] for run in runs]
    return nodes[0], steps


def fold(node, steps):
    for place, siblings in steps:
        node = sha("".join([*siblings[:place], node, *siblings[place:]]))
    return node


def brute(rows, fanout=2):
    """(lang, doc_id, leaf, subroot, root, steps) of every row."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    subs = []
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        subs.append((own, *tree([leaf(r) for r in own], fanout)))
    root, above = tree([s[1] for s in subs], fanout)
    return [(r, leaf(r), sub, root, steps + up) for (own, sub, all_steps), up in zip(subs, above) for r, steps in zip(own, all_steps)]


def as_steps(proof):
    return [(s.place, list(s.siblings)) for s in proof]


@pytest.mark.parametrize("fanout, block", [(2, 2), (2, 8), (3, 9), (4, 4), (2, 4096), (5, 100)])
def test_proofs_of_any_fanout(spark, docs, fanout, block):
    extra = spark.range(333).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 7 = 0 THEN 'é' WHEN id % 5 = 0 THEN 'Z' WHEN id % 31 = 0 THEN NULL ELSE 'a' END AS lang", "CASE WHEN id % 2 = 0 THEN 's' END AS source", "id AS n_chars")
    rows = docs.selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS long) AS n_chars").unionByName(extra)
    got = [(r.key, r.ord, r.leaf, r.subroot, r.root, as_steps(r.proof)) for r in M.manifest(M.document_leaves(rows), fanout, block).collect()]
    want = [(r.lang, r.doc_id, *rest) for r, *rest in brute(rows.collect(), fanout)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17, 31, 33])
def test_ragged_ends(spark, n):
    rows = spark.range(n).selectExpr("id AS doc_id", "'t' AS text", "'a' AS lang", "'s' AS source", "id AS n_chars")
    for fanout in (2, 3):
        got = {r.ord: (r.leaf, r.root, as_steps(r.proof)) for r in M.manifest(M.document_leaves(rows), fanout, fanout).collect()}
        assert got == {r.doc_id: (own, root, steps) for r, own, _, root, steps in brute(rows.collect(), fanout)}


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL_DIR}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in M.op13_merkle_manifest(spark, SMALL_DIR).collect()}
    want = {}
    for r, own, sub, root, steps in brute(docs):
        bad = leaf(r, 1) if zlib.crc32(str(r.doc_id).encode()) % 7 == 0 else own
        back = fold(bad, steps)
        want[r.doc_id] = (r.doc_id, own, sub, root, sha("".join(s for _, x in steps for s in x)), back, back == root)
    assert got == want and 0 < sum(not w[-1] for w in want.values()) < len(want) / 4


def test_hard_rows(spark, hard_docs, no_docs):
    rows = hard_docs.selectExpr("*", "'s' AS source", "CASE WHEN doc_id = 5 THEN NULL ELSE 9L END AS n_chars", "CASE WHEN doc_id = 5 THEN 'en' END AS lang", "1 AS part", "2 AS key_no", "3 AS at", "4 AS tree")
    got = sorted((str(r.key), str(r.ord), r.leaf, r.root, as_steps(r.proof)) for r in M.manifest(M.document_leaves(rows), 2, 2).collect())
    assert got == sorted((str(r.lang), str(r.doc_id), own, root, steps) for r, own, _, root, steps in brute(rows.collect()))
    assert M.manifest(M.document_leaves(no_docs.selectExpr("*", "1L AS n_chars"))).collect() == []


def test_query_against_sql(spark, duck):
    got = M.op13_merkle_manifest(spark, SMALL_DIR)
    want = duck.sql(M.SQL)
    assert want.columns == got.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
