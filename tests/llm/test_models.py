import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language_id as G
from corpusloom.llm import suffix_tree_lm as M
from corpusloom.llm import toxicity as X
from corpusloom.llm.common import fold_of

from .conftest import SMALL_DIR, doc, prose


def table(spark, name):
    return spark.read.parquet(f"{SMALL_DIR}/{name}.parquet")


def test_folds(spark):
    rows = spark.range(50).select("id", fold_of(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_toxicity_swaps_and_edges(spark, docs, no_docs):
    names = [t for group in X.IDENTITY_TERMS for t in group]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        # toxic texts name groups more often, which a plain classifier would learn
        extra = (["vile"] * (i % 8 == 0) + [names[i % len(names)]] * (i % 3 > 0) + ["awful"]) if toxic else [names[i % len(names)]] * (i % 5 == 0)
        rows.append(doc(i, prose(i, 20) + " " + " ".join(extra)))
        labels.append((i, int(toxic)))
    train = spark.createDataFrame(rows, docs.schema)
    model = X.learn(train, spark.createDataFrame(labels, "doc_id long, toxic int"))
    neutral = [X.Model(model.weights, model.intercept).score(f"a {t} in the city") for t in names]
    assert max(neutral) < 0.5 and model.score("an awful thing") > 0.5
    got = X.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert X.score(no_docs, model).collect() == []
    assert X.learn(no_docs, spark.createDataFrame([], "doc_id long, toxic int")).score("x") < 1e-9
    assert X.keep_clean(docs, model).columns == docs.columns


def test_fit_against_a_plain_solver():
    """Dense gradient descent on the same loss ends no lower, and the price of swaps pulls swapped terms together."""
    rng, n = np.random.default_rng(2), 8
    rows = []
    for _ in range(120):
        here = sorted(rng.choice(n, 3, replace=False).tolist())
        swapped = sorted({1 if f == 0 else 0 if f == 1 else f for f in here}) if {0, 1} & {*here} else None
        rows.append(SimpleNamespace(here=here, swapped=swapped, toxic=int(0 in here or rng.random() < 0.2)))
    x = np.array([[f in r.here for f in range(n)] for r in rows], float)
    y = np.array([r.toxic for r in rows], float)
    pairs = [r for r in rows if r.swapped is not None]
    d = np.array([[(f in r.here) - float(f in r.swapped) for f in range(n)] for r in pairs], float)

    def loss(w, b, price):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + price * np.mean((d @ w) ** 2) + 1e-4 * (w @ w)

    gaps = []
    for price in (0.0, 1.0):
        w, b = np.zeros(n), 0.0
        for _ in range(20_000):
            miss = 1 / (1 + np.exp(-(x @ w + b))) - y
            w, b = w - 0.2 * (x.T @ miss / len(y) + 2e-4 * w + 2 * price / len(pairs) * d.T @ (d @ w)), b - 0.2 * miss.mean()
        got = X.fit(rows, n, price)
        assert loss(*got, price) < 1.02 * loss(w, b, price)
        gaps.append(abs(got[0][0] - got[0][1]))
    assert gaps[1] < 0.2 * gaps[0]


def test_swap_price_lowers_scores_of_neutral_mentions(spark, docs):
    rows = [doc(i, prose(i, 20) + (" vile muslims" if i % 4 == 0 else " christians" if i % 4 == 1 else "")) for i in range(240)]
    train, labels = spark.createDataFrame(rows, docs.schema), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    plain, priced = (X.learn(train, labels, swap_weight=p).logit("the muslims in the city") for p in (0.0, 1.0))
    assert priced < plain - 0.5


def test_texts_that_share_an_id_teach_the_least_one(spark):
    rows = spark.createDataFrame([(i, t) for i in range(400) for t in (("awful b", "zz zz") if i % 2 else ("fine a", "zz zz"))], "doc_id long, text string")
    model = X.learn(rows, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int"))
    assert model.score("awful") > 0.5 > model.score("fine")


def test_toxicity_held_out(spark):
    rows = X.op3_toxicity(spark, SMALL_DIR.replace("0.001", "0.01")).join(spark.read.parquet(f"{SMALL_DIR.replace('0.001', '0.01')}/labels.parquet"), "doc_id")
    bad = rows.where("held_out AND toxic = 0 AND predicted = 1").count()
    right = rows.where("held_out").select(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert bad <= 1 and right >= 0.93


def test_language_held_out_and_edges(spark, docs, no_docs):
    found = G.op8_language_id(spark, SMALL_DIR)
    rows = found.join(table(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    languages, prototypes = G.learn(table(spark, "documents"))
    got = {r.doc_id: r for r in G.predict(docs, languages, prototypes).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2)) and got[7].lang_pred != "und"
    assert G.predict(no_docs, languages, prototypes).collect() == []
    assert {r.lang_pred for r in G.predict(docs, *G.learn(no_docs.select("text", "lang"))).collect()} == {"und"}


def test_prediction_against_plain_loops(spark):
    """Learning and predicting letter by letter, with dictionaries of bound vectors."""
    dim, texts = 64, [("en", "the cat, the dog"), ("en", "this and that"), ("fr", "l'été est là"), ("fr", "où est le chat"), ("de", "der Hund und die Katze"), (None, "xyz")]

    def bundle(text):
        words, total = "".join(c if c.isalpha() else " " for c in text.lower()).split(), np.zeros(dim, int)
        spaced = f" {' '.join(words)} "
        for a, b, c in zip(spaced, spaced[1:], spaced[2:], strict=False):
            v = [G.letter_vector(0 if x == " " else ord(x), dim).astype(int) for x in (a, b, c)]
            total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return total

    names = sorted({lang for lang, _ in texts if lang})
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sums = unit(np.array([sum(bundle(t) for lang, t in texts if lang == x) for x in names], float))
    prototypes = unit(sums - sums.mean(axis=0))
    languages, learnt = G.learn(spark.createDataFrame([(t, lang) for lang, t in texts], "text string, lang string"), dim)
    assert languages == names and np.allclose(learnt, prototypes)
    asked = [(1, "der Hut"), (2, "the hat"), (3, "l'âne"), (4, "12 !"), (5, None), (6, "a")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in G.predict(spark.createDataFrame(asked, "doc_id long, text string"), languages, learnt).collect()}
    for i, t in asked:
        v = bundle(t or "")
        if not any(c.isalpha() for c in t or ""):
            assert got[i] == ("und", 0.0)
            continue
        cosines = prototypes @ v / np.linalg.norm(v)
        assert got[i][0] == names[int(cosines.argmax())] and abs(got[i][1] - (1 + cosines.max()) / 2) < 1e-5


def test_bundles_add_bound_letters():
    (found,) = G.bundles([G.grams("ab")], 64)
    a, b, blank = (G.letter_vector(c, 64).astype(int) for c in (97, 98, 0))
    want = np.roll(blank, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * blank
    assert found.tolist() == want.tolist()


def brute_tree(rows, held, depth, least_count=2, least_context=4, discount=0.6, least_bits=2.0):
    """The suffix tree over dictionaries: its states, and every text's figures."""
    texts = [M.tokens(t or "") for _, t in rows]
    counts = [Counter() for _ in range(depth + 1)]
    for words, out in zip(texts, held, strict=True):
        for k in range(0 if out else len(words)):
            for d in range(min(depth, k) + 1):
                counts[d][tuple(words[k - d : k + 1])] += 1
    n, v = sum(counts[0].values()), len(counts[0])
    times = lambda run: counts[len(run) - 1][run]
    entry = lambda run: times(run) >= least_count and times(run[1:]) >= least_count and usable(run[:-1])
    usable = lambda c: times(c) >= least_context and (len(c) == 1 or entry(c))
    states = {}

    def log(context, word):
        if not context:
            return math.log10((times((word,)) + 0.5) / (n + 0.5 * (v + 1)))
        below = log(context[1:], word)
        if context not in states:
            return below
        run = (*context, word)
        return math.log10((times(run) - discount) / times(context)) if entry(run) else below + states[context]

    for d in range(1, depth + 1):
        followers = {}
        for run in counts[d]:
            if entry(run):
                followers.setdefault(run[:-1], []).append(run[-1])
        found = {}
        for c, words in followers.items():
            own = [(times((*c, w)) - discount) / times(c) for w in words]
            below = [10 ** log(c[1:], w) for w in words]
            left, rest = 1 - sum(own), max(1 - sum(below), 1e-9)
            if times(c) * (sum(o * math.log2(o / b) for o, b in zip(own, below, strict=True)) + left * math.log2(left / rest)) >= least_bits:
                found[c] = math.log10(left / rest)
        states |= found
    figures = [
        (str(i), out, len(t), sum(times((w,)) > 0 for w in t), n, sum(log((), w) for w in t), sum(log(tuple(t[max(0, k - depth) : k]), w) for k, w in enumerate(t)))
        for (i, _), t, out in zip(rows, texts, held, strict=True)
    ]
    return states, figures, log, counts


@pytest.mark.parametrize(("depth", "block_tokens"), [(2, 10**6), (3, 300)])
def test_suffix_tree_against_brute_force(spark, docs, depth, block_tokens):
    r = random.Random(4)
    names = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(names[min(29, int(r.expovariate(0.15)))] if r.random() < 0.6 else names[(i + j) % 5] for j in range(r.randint(0, 60)))) for i in range(200)]
    rows += [(None, "w1 w2 w3"), (None, None), (7, ""), (8, "w0 w1 w2 w3"), (8, "w0 w1 w2 w3"), *((x.doc_id, x.text) for x in docs.select("doc_id", "text").collect() if len(x.text or "") < 9999)]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in rows]
    states, want, log, counts = brute_tree(rows, held, depth)
    assert {len(c) for c in states} == {*range(1, depth + 1)}
    got = M.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), fold_of(F.col("doc_id"), 5) == 1, depth=depth, block_tokens=block_tokens, least_bits=2.0).collect()
    assert [x[:5] for x in sorted((str(x.doc_id), *x[1:]) for x in got)] == [x[:5] for x in sorted(want)]
    assert all(abs(a[k] - b[k]) < 1e-5 for a, b in zip(sorted((str(x.doc_id), *x[1:]) for x in got), sorted(want), strict=True) for k in (5, 6))
    # after any state the words of the corpus and all unknown ones together have probability one
    unknown = 1 - sum(10 ** log((), w) for (w,) in counts[0])
    for c in [*states][:20]:
        weight = math.prod(10 ** states[c[k:]] for k in range(len(c)) if c[k:] in states)
        assert abs(sum(10 ** log(c, w) for (w,) in counts[0]) + unknown * weight - 1) < 1e-9


def test_suffix_tree_without_texts(docs, no_docs):
    assert M.score(no_docs, F.lit(False)).collect() == []
    got = M.score(docs, F.lit(True)).collect()
    assert len(got) == docs.count() and {(r.n_known, r.train_tokens) for r in got} == {(0, 0)}


def test_packed_numbers():
    x = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], np.uint64)
    y = np.array([0.5, -1e300, 0.0])
    assert M.from_planes(M.planes(y), "<f8").tolist() == y.tolist()
    assert M.from_planes(M.planes(x)).tolist() == x.tolist() and M.from_planes(M.planes(x[:0])).tolist() == []


def test_packed_word_numbers(spark):
    """Words of a block are numbered by how often they occur, in the order of their hashes where that is the same, and come back as they were."""
    ids = np.array([0, 3, 3, 70000, 255, 256])
    assert M.unpacked_ids(M.packed_ids(ids)).tolist() == ids.tolist() and M.unpacked_ids(M.packed_ids(ids[:0])).tolist() == []
    texts = ["b a b c", "b d a é", ""]
    rows = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").coalesce(1)
    (row,) = M.cut_blocks(rows, 10**6).collect()
    flat = [w for t in texts for w in M.tokens(t)]
    block = M.Block(row.asDict(), None, M.Settings(2, 2, 4, 0.6, 8.0, 1))
    assert block.words.tolist() == sorted(M.word_hashes([*{*flat}]).tolist()) and block.words[block.ids].tolist() == M.word_hashes(flat).tolist()
    stored = M.unpacked_ids(row.ids)
    assert [flat[int(k)] for k in np.flatnonzero(stored < 2)] == [w for w in flat if w in (b"b", M.END)]


def test_suffix_tree_answers_meet_their_blocks_where_they_are(docs):
    """What blocks were told is bucketed as they are: the last step moves neither, and only the questions and answers of each step were dealt."""
    plan = M.score(docs, F.lit(False), block_tokens=300)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and plan.count("Bucketed: true") == 2 and "Exchange" not in plan


def test_suffix_tree_contexts_are_named_by_numbers(spark):
    """Blocks are told the numbers of what may be a context; they ask for contexts by these, in the same ranges as by hash, in less room."""
    words = [f"w{i}" for i in range(3000)]
    settings = M.Settings(2, 2, 4, 0.6, 8.0, 2)
    rows = spark.createDataFrame([(i, False, " ".join(words[i * 500 : i * 500 + 2000] * 3)) for i in range(3)], "doc_id long, held_out boolean, text string")
    blocks = [r.asDict() for r in M.cut_blocks(rows.coalesce(1), 1).collect()]
    asked = [r for b in blocks for r in M.Block(b, None, settings).ask_words()]
    settings.train_tokens = sum(b["train_tokens"] for b in blocks)
    told = pa.concat_tables(M.told_of(pa.Table.from_pylist([r for r in asked if r["bucket"] == k], schema=M._ASKED), settings) for k in (0, 1))
    meant: dict[tuple[int, int], set[int]] = {}
    for b in blocks:
        block = M.Block(b, told.filter(pc.equal(told["block"], b["block"])), settings)
        counts = block.answer(M.WORDS, 0, np.arange(len(block.words))) >> np.uint64(1)
        names = block.numbers_of(M.WORDS, 0, np.arange(len(block.words)), counts.astype(np.int64))
        known = counts >= 4
        for code, name in zip(block.words[known].tolist(), names[known].tolist(), strict=True):
            meant.setdefault((code >> 63, name), set()).add(code)
        none, order = np.empty(0, np.int64), np.arange(int(known.sum()))
        whole, short = (block.ask(M.CONTEXTS, 1, block.words[known], order, none, np.empty((0, 5), np.uint64), x) for x in (None, names[known]))
        assert [r["bucket"] for r in whole] == [r["bucket"] for r in short] == [0, 1]
        assert 4 * sum(len(r["codes"]) for r in short) < sum(len(r["codes"]) for r in whole)
    assert len(meant) >= 2000 and all(len(x) == 1 for x in meant.values())


def test_suffix_tree_steps_leave_no_shuffle_files(spark, docs):
    """Questions and answers of a step go with it, and the session's setting is as it was."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, tracker = spark.conf.get(key), spark.sparkContext._jsc.sc().env().mapOutputTracker()
    held = lambda: set(re.findall(r"(\d+) ->", tracker.shuffleStatuses().keySet().mkString(" ->", " ->", " ->")))
    there = held()
    M.score(docs, F.lit(False), block_tokens=300)
    assert len(held() - there) <= 1 and spark.conf.get(key) == before  # the number of tokens is no step's
