import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import components as C
from corpusloom.llm import line_dedup as L
from corpusloom.llm import simhash as S

from .conftest import doc, prose


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
@settings(max_examples=4, deadline=None)
def test_components(spark, pairs):
    links = spark.createDataFrame(pairs, "a long, b long")
    want = {n: r for n, r in roots({x for p in pairs if p[0] != p[1] for x in p}, pairs).items()}
    assert {r.node: r.root for r in C.components(links).collect()} == want


def test_masks_cover_every_close_pair():
    for flipped in ((0, 9, 10, 63), (1, 2, 3, 4), (0, 20, 40, 60)):
        x = sum(1 << b for b in flipped)
        assert any((m & (2**64 - 1)) & x == 0 for m in S.masks(7, 4))


def test_near_duplicates_against_all_pairs(spark, docs):
    rows = [(r.doc_id, S.fingerprint(r.text or "")) for r in docs.collect()]
    ids = range(len(rows))
    root = roots(ids, [(i, j) for i in ids for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 4])
    least = {}
    for i in ids:
        least.setdefault(root[i], []).append(rows[i][0])
    want = sorted((str(d), f, min((x for x in least[root[i]] if x is not None), default=None)) for i, (d, f) in enumerate(rows))
    got = sorted((str(r.doc_id), r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(docs).collect())
    assert got == want


def test_split_groups_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**62))
    prints = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(120)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = S.close_links(spark.createDataFrame([(p,) for p in signed], "fp long"), most=8)
    got = {r.node: r.root for r in C.components(links).collect()}
    want = roots(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    assert {n: got.get(n, n) for n in signed} == want
    assert links.count() < len(prints) * len(S.masks(7, 4)) * 16


def test_keep_one_and_empty(spark, docs, no_docs):
    kept = S.keep_one(docs, 4)
    assert kept.columns == docs.columns and 3 in {r.doc_id for r in kept.collect()} and not {4, 10} & {r.doc_id for r in kept.collect()}
    assert S.near_duplicates(no_docs).collect() == [] and S.keep_one(no_docs).collect() == []


def jaccard(a, b, words=5):
    a, b = (set(S.shingle_hashes(t.encode().lower().split(), words).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


@given(st.lists(st.sets(st.integers(0, 30), max_size=12), min_size=1, max_size=14), st.sampled_from([0.3, 0.5, 0.8, 1.0]))
@settings(max_examples=200, deadline=None)
def test_alike_sets_against_all_pairs(sets, similarity):
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= similarity * len(a | b) - 1e-9:
                    label[i] = label[j] = min(label[i], label[j])
    got = S.alike([np.array(sorted(s), np.int64) for s in sets], similarity)
    assert [label.index(x) for x in label] == [got.tolist().index(x) for x in got]


def test_planted_near_copies_are_found(spark):
    """Copies with one word in forty changed, or a passage added or cut, at a similarity of 0.8 or more; what is less alike stays."""
    r = random.Random(9)
    rows, want, alone = [], 0, 0
    for i in range(120):
        base = prose(1000 + i, r.randint(80, 400)).split()
        near = list(base)
        kind = i % 3
        if kind == 0:
            for k in r.sample(range(len(near)), max(1, len(near) // 60)):
                near[k] = f"changed{k}"
        elif kind == 1:
            at = r.randrange(len(near))
            near[at:at] = prose(5000 + i, len(near) // 12).split()
        else:
            near = near[len(near) // 12 :]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near).upper() if i % 2 else "\n".join(near))]
        if jaccard(*(t for _, t in rows[-2:])) >= 0.8:
            want += 1
    rows += [(1000 + i, " ".join(w if k % 4 else f"x{k}" for k, w in enumerate(rows[2 * i][1].split()))) for i in range(40)]  # every fourth word changed
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in S.keep_one(docs).collect()}
    gone = {i for i, _ in rows} - kept
    assert want > 60 and len(gone) >= 0.9 * want and all(i < 1000 and i % 2 and jaccard(rows[i - 1][1], rows[i][1]) >= 0.8 for i in gone)


def test_one_class_of_many_near_copies(spark):
    """Every copy is close to the base, many not to each other; parts meet pairwise."""
    base = prose(77, 200).split()
    r = random.Random(1)
    texts = [" ".join(base)] + [" ".join(w if k not in at else f"z{n}" for k, w in enumerate(base)) for n in range(60) for at in [{*r.sample(range(200), 3)}]]
    sets = spark.createDataFrame([(7, i, S.shingle_hashes(t.encode().split(), 5).view(np.int64).tolist()) for i, t in enumerate(texts)], "root long, node long, hashes array<long>")
    for most in (10**6, 3000):
        roots = {x.node: x.root for x in C.components(S.similar_links(sets, 0.8, most)).collect()}
        assert roots == {i: 0 for i in range(61)}
    assert [x.doc_id for x in S.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()] == [0]


def test_keep_one_of_hard_rows(hard_docs):
    """Of each text's copies the row with the least id stays; texts under one id, or under none, are not mixed up."""
    kept = S.keep_one(hard_docs)
    assert kept.columns == hard_docs.columns
    rows = [tuple(r)[:2] for r in hard_docs.collect()]
    want = []
    prints = [S.fingerprint(t or "", 5) for _, t in rows]
    root = roots(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    for k in {*root.values()}:
        group = [rows[i] for i in range(len(rows)) if root[i] == k]
        want.append(min(group, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).digest() if x[1] is not None else b"\0")))
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted(want, key=str)


def test_stars_in_stripes():
    rng = np.random.default_rng(5)
    group = np.unique(rng.integers(0, 2**63, 300, np.uint64) & np.uint64(0x3FF))
    links = [(int(a), int(b)) for i, a in enumerate(group) for b in group[:i] if (int(a) ^ int(b)).bit_count() <= 1]
    want = roots([int(x) for x in group], links)
    assert {int(a): int(b) for a, b in zip(group, S.stars(group, 1, stripe=7), strict=True)} == want


def own_lines(text):
    """The rule in plain Python: a line ends after a newline, after marks before a blank (and one run of blanks), and after marks that are not ASCII."""
    out, i = [], 0
    while i < len(text):
        j, inner = i, 0
        while j < len(text) and text[j] != "\n":
            if text[j] not in L.MARKS + L.MORE_MARKS:
                j += 1
                continue
            k = j
            while k < len(text) and text[k] in L.MARKS:
                k += 1
            ends = k == j or k == len(text) or text[k] in " \n" + L.MORE_MARKS
            if ends or inner == 200:
                while k < len(text) and text[k] in L.MARKS + L.MORE_MARKS:
                    k += 1
                k += text[k : k + 1] == " "
                j = k
                break
            j, inner = k, inner + 1
        j += text[j : j + 1] == "\n"
        out.append(text[i:j])
        i = j
    return out


def test_lines_against_the_rule(spark):
    r = random.Random(3)
    texts = ["", "\n", "a", "3,000 at 12:30 on a.b.org, or\nnot.  So。还，是", prose(7, 200), "a.b" * 999]
    texts += ["".join(r.choice("ab .,:;!?\n。，") for _ in range(r.randint(0, 30))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", L.lines_of(F.col("text")).alias("l")).collect()
    for row in rows:
        assert row.l == own_lines(row.text) and "".join(row.l) == row.text


def brute_removals(rows, least):
    """Line dedup of rows (doc_id, text) in plain Python: seeds, the pairs near them, first occurrences, removals."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keyed = {(i, t): [x.rstrip(" \n") for x in own_lines(t)] for i, t in rows if t is not None}
    times = Counter()
    near = {}
    for key, lines in keyed.items():
        h, n, seeds = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in lines], len(lines), set()
        if n > 1:
            for s in range(max(n - L.SPAN, 0) + 1):
                least_hash = min(h[s : s + L.SPAN])
                seeds |= {min(i, n - 2) for i in range(s, min(s + L.SPAN, n)) if h[i] == least_hash}
        near[key] = seeds
    copies = Counter((i, t) for i, t in rows if t is not None)
    for key, seeds in near.items():
        for i in seeds:
            times[tuple(keyed[key][i : i + 2])] += copies[key]
    pairs = {}
    for key, seeds in near.items():
        lines = keyed[key]
        for i in seeds:
            if times[tuple(lines[i : i + 2])] > 1:
                for j in range(max(i - L.SPAN + 1, 0), min(i + L.SPAN - 1, len(lines) - 2) + 1):
                    pairs.setdefault(tuple(lines[j : j + 2]), set()).add((key, j))
    gone, held = {}, {}
    for places in pairs.values():
        if len(places) > 1 or copies[next(iter(places))[0]] > 1:
            order = lambda p: (p[0][0] is None, p[0][0] or 0, 0 if sum(k[0] == p[0][0] for k, _ in places) == 1 else ROW_KEY[p[0]], p[1])
            first = min(places, key=order)
            for p in places:
                (held if p == first else gone).setdefault(p[0], set()).add(p[1])
    out = {}
    for key in keyed:
        lines = own_lines(key[1])
        both = lambda x: {p + d for p in x.get(key, ()) for d in (0, 1)}
        goes, at = sorted(both(gone) - both(held)), 0
        while at < len(goes):
            end = at
            while end + 1 < len(goes) and goes[end + 1] == goes[end] + 1:
                end += 1
            if sum(map(len, lines[goes[at] : goes[end] + 1])) >= least:
                lines = [None if goes[at] <= k <= goes[end] else x for k, x in enumerate(lines)]
            at = end + 1
        out[key] = "".join(x for x in lines if x is not None)
    return out


ROW_KEY = {}


@pytest.mark.parametrize("least", [0, 40])
def test_removals_against_brute_force(spark, hard_docs, least):
    r = random.Random(9)
    pool = [prose(300 + k, r.randint(2, 9)).replace(".", "") + r.choice([". ", ", ", "\n", "。"]) for k in range(40)]
    rows = [(i // 2 if i % 7 else None, "".join(r.choice(pool) for _ in range(r.randint(1, 14))) if i % 3 else "".join(pool[(i + k) % 40] for k in range(12))) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").union(hard_docs.select("doc_id", "text"))
    rows = [tuple(x) for x in docs.collect()]
    ROW_KEY.update({(x.doc_id, x.text): x.k for x in docs.select("doc_id", "text", F.xxhash64("text", F.length("text")).alias("k")).collect()})
    want = brute_removals(rows, least)
    got = L.dedup_lines(docs, least).collect()
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(map(tuple, got), key=key) == sorted(((i, None if t is None else want[i, t]) for i, t in rows), key=key)


def test_line_dedup_of_hard_rows(spark, hard_docs):
    out = L.dedup_lines(hard_docs)
    assert out.columns == hard_docs.columns and out.count() == hard_docs.count()
    lost = [sum(len(r.text or "") for r in x.collect()) for x in (hard_docs, out)]
    assert lost[1] < lost[0]


def test_passages_that_repeat_go_once(spark):
    passage = prose(11, 120) + "."
    rows = [doc(i, prose(20 + i, 60) + ". " + passage + " " + prose(40 + i, 60)) for i in range(6)] + [doc(9, prose(99, 200)), doc(10, None), doc(11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, n_tokens long, hash long, fp long, words array<string>, blob string")
    out = {r.doc_id: r.text for r in L.dedup_lines(docs).collect()}
    assert L.dedup_lines(docs).columns == docs.columns and len(out) == len(rows)
    assert out[0] == rows[0][1] and out[9] == rows[6][1] and out[10] is None and out[11] == ""
    for i in range(1, 6):
        assert len(out[i]) < len(rows[i][1]) - len(passage) // 2
        assert all(any(piece in t for t in (out[i],)) for piece in (rows[i][1][:40],))


def test_chunks_join_to_the_text_and_copies(spark, docs, no_docs):
    parts = docs.where("text IS NOT NULL").select("text", L.parts_of(F.col("text")).alias("p")).collect()
    assert all("".join(x.body for x in r.p) == r.text for r in parts)
    out = sorted(((r.doc_id is None, r.doc_id, r.text) for r in L.dedup_lines(docs).collect()), key=str)
    assert len(out) == docs.count() and (False, 3, docs.where("doc_id = 3").first().text) in out
    copy = next(t for n, i, t in out if i == 4)
    assert len(copy) < 0.5 * len(docs.where("doc_id = 4").first().text)
    assert L.dedup_lines(no_docs).collect() == []


def sentences_of(seed, n, words=8, end=". "):
    return "".join(re.sub("[.,]", "", prose(seed * 1000 + i, words)) + end for i in range(n))


def test_short_passages_go_whole(spark):
    """Just over 50 words, between other texts; all that was there before and after stays."""
    rows, want = [], {}
    for k in range(40):
        passage = sentences_of(500 + k, 7) if k % 4 else sentences_of(500 + k, 7, end="。").replace(" ", "字")
        for j in range(3):
            i = 10 * k + j
            before, after = sentences_of(2000 + i, 1 + (k + j) % 5), sentences_of(4000 + i, 1 + (k + 2 * j) % 3)
            rows.append((i, before + passage + after))
            want[i] = before + (passage if j == 0 else "") + after
    # a passage of which an earlier text has a part only, and a text that repeats itself
    half, rest, line = sentences_of(900, 7), sentences_of(901, 7), sentences_of(902, 1)
    for i, t, w in ((1000, half, half), (1001, "x y. " + half + rest, "x y. " + rest), (1002, line * 9, line * 2), (1003, "ab, cd. ef", "ab, cd. ef"), (1004, "ab, cd. gh", "ab, cd. gh")):
        rows.append((i, t))
        want[i] = w
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == want


def test_pairs_near_seeds(spark):
    """Pairs less than SPAN lines from a seed, each once; a line is cut and made bare once a text."""
    lines = [f"line {i} \n" for i in range(12)]
    rows = L.with_pairs(spark.createDataFrame([("".join(lines), [0, 2, 10]), ("one\ntwo", [0])], "text string, places array<int>"))
    got = [sorted((p.place, p.body) for p in r.pairs) for r in rows.collect()]
    assert got == [[(i, f"line {i}\nline {i + 1}") for i in (0, 1, 2, 3, 4, 5, 7, 8, 9, 10)], [(0, "one\ntwo")]]
    shown = rows.select(F.inline_outer("pairs")).where("body IS NOT NULL")
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2  # one for each set of marks
