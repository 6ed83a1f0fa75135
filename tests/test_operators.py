"""Operators on small literal tables: cases that the test data do not hold."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import compile as C
from corpusloom.operators import contribute as K
from corpusloom.operators import graph as G
from corpusloom.operators import lifecycle as L
from corpusloom.operators import manifest as M
from corpusloom.operators import ops as O
from corpusloom.operators import quality as Q
from corpusloom.operators import retrieval as R
from corpusloom.operators import segment as S
from corpusloom.operators import state as T
from corpusloom.operators import vector_index as V
from corpusloom.plugins import Registry, backend, chosen
from corpusloom.sources import files

from .conftest import SMALL

COMPILED = "src_id string, doc_id long, title string, type string, text string, one_line string, key_points array<string>, detailed_summary string, concepts array<struct<name:string,explanation:string>>"


def compiled(spark, **over):
    row = dict(src_id="SRC-0001", doc_id=1, title="t", type="a", text="学习方法，很重要。", one_line="一" * 25, key_points=["a", "b", "c", "d", "e"], detailed_summary="关键词 学习 方法" + "x" * 1600, concepts=[("学习", "学习方法"), ("无关", "")])
    return spark.createDataFrame([tuple((row | over).values())], COMPILED)


def one(df):
    return df.first()[0]


def run_plan(df):
    """The physical plan as it is after a run."""
    done = df._jdf.queryExecution()
    done.executedPlan().executeCollect()
    return done.executedPlan().toString()


def test_query_terms_have_cjk_grams(spark):
    assert sorted(one(spark.sql("SELECT '深度学习 RAG_2 a' AS q").select(X.query_terms(F.col("q"))))) == sorted({"深度学习", "深度", "度学", "学习", "深度学", "度学习", "rag_2", "a"})


def test_scores(spark):
    points = {r.dimension: r.points for r in Q.dimension_rows(compiled(spark)).collect()}
    # 关键 does not count inside 关键词
    assert points == {"detail_length": 25, "key_points": 30, "learning_value": 3, "info_density": 0, "one_line": 5, "concepts": 4, "template": 0, "overflow": 0}
    assert one(compiled(spark, detailed_summary="summary" + "x" * 4600).select(Q.score())) == 25 + 30 + 5 + 4 - 20 - 3


def test_lint(spark):
    row = Q.linted(compiled(spark, one_line="", key_points=[" "], detailed_summary="本文档说", concepts=[("A b", "x"), ("a-B", "y（详细解释请参阅原文）"), ("z", "")])).first()
    assert sorted((i.rule, i.severity, i.detail) for i in row.issues) == sorted([
        ("concept_dedup", "warning", "a-B"), ("completeness", "error", "one_line"), ("completeness", "error", "key_points"), ("completeness", "warning", "detailed_summary"),
        ("self_reference", "warning", "本文档"), ("concept_quality", "warning", "z"), ("concept_quality", "warning", "a-B"),
    ])
    assert (row.errors, row.warnings, row.lint_score, row.lint_passed) == (2, 5, 0.0, False)
    long = Q.linted(compiled(spark, text="\n\n".join("p%02d " % i + "w" * 600 for i in range(20)))).first()
    assert [(i.rule, i.severity) for i in long.issues] == [("coverage", "warning")]


def test_provenance(spark):
    row = Q.traced(compiled(spark)).first()
    assert [(c.name, c.label) for c in row.concept_labels] == [("学习", "extracted"), ("无关", "ambiguous")]
    assert (row.summary_label, row.overall_label, row.confidence) == ("inferred", "ambiguous", 0.2)
    row = Q.traced(compiled(spark, concepts=[("学习 的 别物", ""), ("学习", "")], one_line="学习方法 很重要")).first()
    assert [c.label for c in row.concept_labels] == ["inferred", "extracted"] and row.summary_label == "extracted" and row.overall_label == "merged"


def test_concept_context(spark):
    text = "第一句话没有它。机器学习是这样的！再说机器学习一次。机器学习第三次"
    rows = spark.createDataFrame([("机器学习", text), ("机器学习：定义", text), ("机器 学习", text), ("别的", text)], "n string, t string")
    assert [r[0] for r in rows.select(C.concept_context(F.col("n"), C.context_parts(F.col("t")))).collect()] == ["机器学习是这样的。再说机器学习一次"] * 3 + ["别的（详细解释请参阅原文）"]


@given(st.text("ab .\n。!", max_size=300), st.integers(5, 60))
@settings(max_examples=150, deadline=None)
def test_pieces_and_chunks(text, size):
    """Chunks are spans of the text, no longer than size; each begins where the one before ends or inside it, and only white space is left out."""
    assert "".join(S.pieces_of(text, size)) == text
    for name, split in S.SPLITTERS.items():
        at = 0
        for a, b in split(text, size, size // 4):
            assert 0 < b - a <= size, name
            assert a <= at or not text[at:a].strip(), name
            assert b > at, name
            at = b
        assert not text[at:].strip(), name


def greedy(pieces, size, overlap):
    """What packing does, piece by piece."""
    out, held = [], []
    for p in pieces:
        if held and sum(map(len, held)) + len(p) > size:
            out.append("".join(held))
            tail = []
            while len(tail) < len(held) and len(held[-1 - len(tail)]) + sum(map(len, tail)) <= min(overlap, size - len(p)):
                tail.insert(0, held[-1 - len(tail)])
            held = tail
        held.append(p)
    return [*out, "".join(held)] if held else out


@given(st.lists(st.text("ab .", min_size=1, max_size=9), max_size=40), st.integers(9, 40), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_packing_against_greedy_lists(pieces, size, overlap):
    text = "".join(pieces)
    assert [text[a:b] for a, b in S.packed(pieces, size, overlap)] == greedy(pieces, size, overlap)


def test_offsets_of_repetitive_texts(spark):
    text = "the same phrase again. " * 200
    for name in S.SPLITTERS:
        rows = S.chunks(spark.createDataFrame([("s", text)], "src_id string, text string"), name, 800, 120).orderBy("index").collect()
        assert rows[-1].end == len(text) and all(r.content == text[r.start : r.end] for r in rows) and [r.start for r in rows] == sorted(r.start for r in rows)


def test_merged_sentences_against_a_loop(spark):
    parts = [f"s{i} " + "x" * (i * 7 % 40) for i in range(30)]
    out, now = [], ""
    for p in parts:
        if len(now) + len(p) > 60 and now:
            out.append(now)
            now = now[-10:] + p
        else:
            now += p
    rows = spark.createDataFrame([("d", i, p) for i, p in enumerate(parts)], "src_id string, place int, sentence string")
    assert [r.content for r in S.merged_sentences(rows, 60, 10).orderBy("index").collect()] == [*out, now]


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 10, 99, 100, 101):
        values = [(7 * i) % 5 for i in range(n)]
        got = one(spark.createDataFrame([(values,)], "v array<int>").select(X.running_sums(F.col("v"))))
        assert got == [sum(values[: i + 1]) for i in range(n)]


def test_progress_report(spark, tmp_path):
    rows = spark.createDataFrame([("compiled", 80), ("compiled", 60), ("failed", 0), ("ingested", None)], "status string, quality_score int")
    files.write_progress(rows, str(tmp_path / "r"))
    got = {r.status: r for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert (got["compiled"]["count"], got["compiled"].percentage) == (2, 50.0)
    assert (got["all"].total, got["all"].average, got["all"].max, got["all"].min, got["all"].samples, got["all"].compiled_percentage) == (4, 70.0, 80, 60, 2, 50.0)


def test_structured_texts(spark):
    rows = [("h", "# A\nx\n# B\n" + "y. " * 50), ("n", "intro\n1. one\na\n2. two\nb"), ("p", "just text"), ("e", "  ")]
    got = sorted((r["src_id"], r["index"], r["level"], r["title"], r["content"]) for r in S.structured(spark.createDataFrame(rows, "src_id string, text string"), 60, 10).collect())
    assert [g[:4] for g in got if g[0] == "h"][:2] == [("h", 0, 1, "A"), ("h", 1, 1, "B")] and all(len(g[4]) <= 60 for g in got)
    assert [g[1:] for g in got if g[0] == "n"] == [(0, 1, "", "intro"), (1, 1, "1", "1. one\na"), (2, 1, "2", "2. two\nb")]
    assert [g[1:] for g in got if g[0] == "p"] == [(0, 0, "", "just text")] and not [g for g in got if g[0] == "e"]


def test_numbered_and_markdown_sections(spark):
    rows = S.sections(spark.createDataFrame([("s", "intro\n# One\na\n## Two \nb\nc"), ("t", "plain")], "src_id string, text string")).collect()
    assert sorted((r["src_id"], r["index"], r["level"], r["title"], r["content"]) for r in rows) == [("s", 0, 0, "", "intro"), ("s", 1, 1, "One", "# One\na"), ("s", 2, 2, "Two", "## Two \nb\nc"), ("t", 0, 0, "", "plain")]


def test_sequential_ids_have_no_gaps(spark, tmp_path):
    """Many rows with a payload, written out: a plan that dealt them twice would give other ranges."""
    rows = spark.range(1_000_000).select((F.col("id") * 7 % 1_000_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    M.with_sequential_ids(rows, "k", 5).write.parquet(str(tmp_path / "ids"))
    got = spark.read.parquet(str(tmp_path / "ids"))
    assert got.where("seq <> k + 5").count() == 0 and got.count() == 1_000_000
    assert M.with_sequential_ids(rows.limit(0), "k").collect() == []


def test_numbers_in_hot_groups(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 6 == 0, None).otherwise(F.col("id").cast("string")).alias("g"))
    seen, want = {}, {}
    for r in rows.orderBy("id").collect():
        want[r.id] = seen[r.g] = seen.get(r.g, 0) + 1
    assert {r.id: r.n for r in M.numbered(rows, ["g"], ["id"]).collect()} == want


def test_categories(spark):
    rows = spark.createDataFrame([(".PDF",), (".zip",), (".what",)], "e string").select(M.category(F.col("e"))).collect()
    assert [r[0] for r in rows] == ["pdfs", None, "other"]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 3), (2, "x", 1)], "query_id long, src_id string, rank int")
    expected = spark.createDataFrame([(1, "b"), (1, "c"), (2, "y")], "query_id long, src_id string")
    got = {r.query_id: r for r in R.metrics(ranked, expected).collect()}
    dcg, ideal = 1 / math.log2(3), 1 + 1 / math.log2(3)
    assert (got[1].recall, got[1].precision, got[1].mrr, got[1].ndcg, got[1].missed) == (0.5, 0.2, 0.5, round(dcg / ideal, 4), ["c"])
    assert (got[2].recall, got[2].mrr, got[2].ndcg) == (0, 0, 0)


def test_rescaling_and_tiers(spark):
    rows = spark.createDataFrame([(1, 2.0, 1), (1, 4.0, 2), (2, 7.0, 2), (3, float("nan"), 1)], "query_id long, s double, tier int")
    assert sorted((r.query_id, r.rerank_score) for r in R.rescaled(rows, "s").collect()) == [(1, 0.0), (1, 1.0), (2, 1.0)]
    assert sorted((r.query_id, r.tier) for r in R.first_tier(rows).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_upsert_keeps_the_later(spark):
    store = spark.createDataFrame([("c", "1", "old"), ("c", "2", "kept")], "collection string, id string, document string")
    new = spark.createDataFrame([("c", "1", "new"), ("d", "1", "other")], "collection string, id string, document string")
    assert sorted(map(tuple, R.upserted(store, new).collect())) == [("c", "1", "new"), ("c", "2", "kept"), ("d", "1", "other")]


def test_lifecycle(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([90, 79, 70, 50])], "src_id string, version int, score int")
    assert [r.rolled_back for r in L.rolled_back(rows).orderBy("version").collect()] == [False, True, False, True]
    assert L.fingerprint({"a": 1, "b": 2}) == L.fingerprint({"b": 2, "a": 1}) != L.fingerprint({"a": 1})


def test_graph_limits_and_validity(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "z")], "source string, target string")
    assert G.valid(edges, spark.createDataFrame([("a",), ("b",)], "id string")).count() == 1
    many = spark.createDataFrame([(f"s{i:03}", i, "t", "same", "", "", [], "", [("c", ""), (f"d{i % 2}", "")]) for i in range(60)], COMPILED)
    counts = {r.relation: r["count"] for r in G.edges(many).groupBy("relation").count().collect()}
    assert counts == {"compiled_to": 60, "contains_concept": 120, "same_type": 1225}
    assert sorted((r.name, r.sources, r.links) for r in G.mention_classes(many).collect()) == [("c", 60, 1770), ("d0", 30, 435), ("d1", 30, 435)]
    assert {r.links for r in G.related_counts(many).collect()} == {59 + 29}
    assert G.related_pairs(many, spark.createDataFrame([("s000",)], "src_id string")).agg(F.sum("shared")).first()[0] == 59 + 29
    near = {(r.neighbour, r.relation) for r in G.related_nearby(many, 3).where("id = 's004'").collect()}
    assert near == {("s005", "related_to"), ("s006", "related_to"), ("s007", "related_to"), ("s008", "related_to"), ("s010", "related_to"), *((f"s00{i}", "reverse_related_to") for i in range(3))}


def test_prices_prefer_the_exact_name(spark):
    usage = spark.createDataFrame([(1, "m-large", 1000), (2, "m", 1000), (3, "q", 1000)], "id int, model string, tokens long")
    prices = spark.createDataFrame([("m", 0, 1.0), ("m-large", 1, 5.0)], "name string, place int, price double")
    assert {r.id: r.cost for r in O.priced(usage, prices).collect()} == {1: 5.0, 2: 1.0, 3: None}


def test_first_json_object(spark):
    rows = [('say {"a": {"b": "}"}} more', '{"a": {"b": "}"}}'), ("none", None), ('{"x": 1', None), (None, None), ('{not json} then {"a": 1}', '{"a": 1}'), ('{"bad": {"in": 1}, oops}', '{"in": 1}'), ("{" * 50_000 + "}" * 50_000, "{}"), ('{"a": ' * 20_000 + "1" + "}" * 20_000, None)]
    got = files.first_objects(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id long, text string")).orderBy("id").collect()
    assert [r.json for r in got] == [want for _, want in rows]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, body in (("a.md", "# A"), ("sub/b.txt", "b"), ("c.zip", "z"), ("d.md", "")):
        (tmp_path / "in" / name).write_text(body)
    assert sorted((r.name, r.category) for r in files.scan(spark, str(tmp_path / "in")).collect()) == [("a.md", "articles"), ("b.txt", "articles")]
    (tmp_path / "s.jsonl").write_text('# note\n\n{"id": "1", "question": "q", "expected_source_ids": ["SRC-1"]}\n{"id": "2"}\nbad\n')
    samples = files.eval_samples(spark, str(tmp_path / "s.jsonl"))
    assert [(r.id, r.expected_source_ids) for r in samples.collect()] == [("1", ["SRC-1"])]
    files.write_samples(samples, str(tmp_path / "out"))
    assert files.eval_samples(spark, str(tmp_path / "out")).count() == 1
    (tmp_path / "m.json").write_text('{"id": "SRC-0001", "status": "compiled", "quality_score": 90}\nnot json\n{"id": "SRC-0002", "status": "failed"}\n')
    assert [r.id for r in files.manifests(spark, str(tmp_path / "m.json"), "compiled").collect()] == ["SRC-0001"]


def test_plugins(spark):
    r = Registry()
    r.add("ingest_parser", "none", lambda c: F.lit(None).cast("string"))
    r.add("ingest_parser", "upper", F.upper)
    r.add("post_compile", "mark", lambda df: df.withColumn("seen", F.lit(True)))
    assert one(spark.sql("SELECT 'a' AS t").select(r.first("ingest_parser", F.col("t")))) == "A"
    assert r.apply("post_compile", spark.range(1)).first().seen
    r.enable("post_compile", "mark", False)
    assert r.apply("post_compile", spark.range(1)).columns == ["id"]
    # one that fails, in Python or in Spark's analysis, is skipped
    r.add("post_compile", "bad", lambda df: 1 / 0)
    r.add("post_compile", "unknown", lambda df: df.select("nothing"))
    r.add("post_compile", "good", lambda df: df.withColumn("g", F.lit(1)))
    assert r.apply("post_compile", spark.range(1)).columns == ["id", "g"]
    job = Registry()
    job.add("ingest_parser", "upper", F.upper)
    job.add("post_compile", "mark", lambda df: df.withColumn("seen", F.lit(True)))
    docs = spark.createDataFrame([("s", 1, "t", "a", "some words here. more words there.")], "src_id string, doc_id long, title string, type string, text string")
    row = C.compile_job(docs, job).first()
    assert row.seen and row.one_line.isupper()
    backend("scorer", "length")(F.length)
    assert chosen("scorer", "length") is F.length
    with pytest.raises(ValueError, match="length"):
        chosen("scorer", "none")


def test_nearest_with_bad_rows(spark):
    rows = [(i, [float(i % 7), float(i), 1.0]) for i in range(40)] + [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan")] * 3), (103, [1.0])]
    got = R.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 3).collect()
    good = dict(rows[:40])
    for q in range(0, 40, 10):
        want = sorted((round(sum((a - b) ** 2 for a, b in zip(good[q], v)), 5), i) for i, v in good.items() if i != q)[:3]
        assert [(r.distance, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want

def test_nearest_of_many_equal_vectors(spark):
    vectors = spark.createDataFrame([(i, [0.3, 0.7, 0.1]) for i in range(300)] + [(i, [float(i), 0.5, 2.0]) for i in range(300, 320)], "vec_id long, embedding array<double>")
    for kind in ("l2", "cosine"):
        got = R.nearest(vectors, F.col("vec_id").isin(30, 2), 5, kind, candidate_block=64).collect()
        assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(2, i + 1, v) for i, v in enumerate([0, 1, 3, 4, 5])] + [(30, i + 1, i) for i in range(5)]


def test_approximate_search(spark):
    """Without clusters half of the lists are probed, but few vectors are tested; with clusters few lists are probed."""
    vectors, asked = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 100 == 0
    exact, found = ({(r.query_id, r.vec_id) for r in f(vectors, asked, 5).collect()} for f in (R.nearest, V.approximately_nearest))
    assert len(exact & found) / len(exact) >= 0.9 and 50 / vectors.count() <= 0.1
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=16) + 30 * np.eye(16)[i % 16]).tolist()) for i in range(1600)] + [(9001, None), (9002, [1.0]), (9003, [float("nan")] * 16)]
    clustered = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    lists = V.fitted(V.finite(clustered.where("vec_id < 9000")), lists=32)
    assert lists.probe <= 8
    exact, found = ({(r.query_id, r.vec_id, r.rank, r.distance) for r in f(clustered, asked, 5, **x).collect()} for f, x in ((R.nearest, {}), (V.approximately_nearest, {"lists": lists})))
    assert len(exact & found) / len(exact) >= 0.9 and {r[0] for r in found} == set(range(0, 1600, 100))
    blocks = V.close_by_code(V.probed(V.finite(clustered).where(asked & (F.size("v") == 16)), lists), V.indexed(V.finite(clustered).where(F.size("v") == 16), lists), lists, 20, query_block=3, list_block=10)
    whole = V.close_by_code(V.probed(V.finite(clustered).where(asked & (F.size("v") == 16)), lists), V.indexed(V.finite(clustered).where(F.size("v") == 16), lists), lists, 20)
    assert {(r.query_id, r.vec_id) for r in blocks.collect()} == {(r.query_id, r.vec_id) for r in whole.collect()}
    assert V.approximately_nearest(clustered.limit(0), asked).collect() == []


def test_vector_collections(spark):
    schema = "collection string, id string, document string, metadata map<string,string>"
    store = spark.createDataFrame([("chunks", "1", "a", {"source": "x", "trust_level": "wiki"}), ("chunks", "2", "b", {"source": "x", "trust_level": "outputs"}), ("summaries", "1", "c", {"source": "y"})], schema)
    changed = R.with_metadata(store, spark.createDataFrame([("chunks", "1", {"source": "z", "new": "1"})], "collection string, id string, metadata map<string,string>"))
    assert {r.id: r.metadata for r in changed.where("collection = 'chunks'").collect()} == {"1": {"source": "z", "trust_level": "wiki", "new": "1"}, "2": {"source": "x", "trust_level": "outputs"}}
    assert R.deleted(store, store.where("id = '1'").select("collection", "id")).count() == 1
    assert sorted((r.collection, r.id) for r in R.trusted(store, "wiki").collect()) == [("chunks", "1"), ("summaries", "1")]
    assert R.trusted(store, "curated").count() == 1 and R.trusted(store, "wiki", exact=True).count() == 2
    assert R.matching(store, {"source": "x", "trust_level": "wiki"}).count() == 1
    with pytest.raises(Exception, match="without id or document"):
        R.checked_rows(spark.createDataFrame([("c", None, "d", {})], schema)).collect()


def test_links_and_answers(spark):
    texts = spark.createDataFrame([(1, "a [[x]] b [[y]]"), (2, "none"), (3, "[[y]][[x]]")], "id int, text string")
    assert {r.id: r.text for r in R.sanitised_links(texts, spark.createDataFrame([("x",)], "name string")).collect()} == {1: "a [[x]] b y", 2: "none", 3: "y[[x]]"}
    known = spark.createDataFrame([("机器", "机器学习 方法 数据")], "name string, text string")
    answers = spark.createDataFrame([("q", "[[机器]] 机器学习 方法 数据"), ("r", "[[机器]] 别的 东西")], "id string, text string")
    assert [(r.id, r.overlap) for r in K.conflicts(answers, known, 0.5).collect()] == [("q", 0.75)]
    kept = K.new_concepts(spark.createDataFrame([("1", "a/b", "x"), ("2", "ab", "y"), ("3", "k", "z")], "id string, name string, explanation string"), spark.createDataFrame([("k",)], "file_name string"))
    assert [(r.id, r.file_name) for r in kept.collect()] == [("1", "ab")]
    found = spark.createDataFrame([(1, "concept", "S2", 1), (1, "summary", "S1", 1), (1, "concept", "S1", 2), (1, "vector", "S9", 1)], "query_id int, channel string, manifest_id string, channel_rank int")
    assert K.from_results(spark.createDataFrame([(1, "q", "a" * 100), (2, "q", "short")], "query_id int, question string, answer string"), found).collect()[0].source_ids == ["S2", "S1"]


def test_code_and_references(spark):
    code = '"""Doc\nmore"""\ndef f(x):\n    # note\n    return x\nclass A:\n    pass'
    row = K.code_facts(spark.createDataFrame([("a.py", code)], "path string, content string")).first()
    assert (row.language, row.functions, row.classes, row.text) == ("python", ["f"], ["A"], '"""Doc\n    # note')
    text = "---\ncreated: x\n---\nsee (SRC-0012)\n\n\n\nend\n> 编译时间：now\n"
    assert one(spark.createDataFrame([(text,)], "t string").select(X.clean_references(F.col("t")))) == "see 📚 来源: SRC-0012\n\nend"
    names = spark.createDataFrame([("../etc/passwd",), ("file\x00name",), ("报告: a",), ("",), ("..",)], "n string").select(X.safe_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["_etc_passwd", "filename", "报告_ a", "_", "_"]


def test_transcripts(spark):
    rows = spark.createDataFrame([("1", "talk one"), ("2", "Lecture: Part 2"), ("3", "zzz")], "src_id string, stem string")
    files = spark.createDataFrame([("talk one", 500), ("Lecture Part2 final", 500), ("zzz", 10)], "name string, size long")
    assert sorted(map(tuple, T.transcripts_for(rows, files).collect())) == [("1", "talk one", True), ("2", "Lecture Part2 final", False)]


def test_keywords_that_share_a_letter(spark):
    text = spark.createDataFrame([("原理解 技能力 关键词 关键。学习学习",)], "t string")
    assert one(text.select(Q.keyword_hits(F.col("t"), Q.LEARNING_KEYWORDS))) == 6  # 原理 理解 技能 能力 关键 学习


def test_terms_in_texts(spark):
    texts = ["aaaa banana Ana", "the thethe other", None, "", "深度学习深度 x_1 X_1", "nothing"]
    docs = spark.createDataFrame([(i, t, "Ana") for i, t in enumerate(texts)], "id long, text string, title string")
    terms = ["aa", "ana", "the", "学习", "深", "x_1", "a", "zzz"]
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted((i, f, t, v.lower().count(t)) for i, text in enumerate(texts) for f, v in (("text", text or ""), ("title", "Ana")) for t in terms if v.lower().count(t))
    found = R.term_points(docs, ["id"], {"text": F.col("text"), "title": F.col("title")}, asked)
    assert sorted((r.id, r.field, r.term, r.n) for r in found.collect()) == want


def test_search_in_batches_as_by_joins(spark, monkeypatch):
    words = ["aaaa", "banana", "Ana", "the", "thethe", "深度学习", "x_1", "学习", "zz", "é", "other."]
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(words, n)) if n else ""
    docs = spark.createDataFrame([(f"s{i:02}", text(i % 3), text(i % 9) if i % 7 else None) for i in range(60)], "src_id string, title string, text string")
    concepts = spark.createDataFrame([(f"s{i:02}", p, text(1), text(p + i % 4)) for i in range(30) for p in range(2)], "src_id string, place int, name string, explanation string")
    queries = spark.createDataFrame([(1, "the banana ana"), (2, "深度学习 x_1"), (3, ""), (4, None), (5, "thethe other. zz aaaa aaaa"), (6, "nothing of it")], "query_id long, question string")
    search = lambda: [sorted(map(tuple, f(queries, rows, 4).collect())) for f, rows in ((R.keyword_search, docs), (R.concept_search, concepts))]
    together = search()
    monkeypatch.setattr(R, "term_index", lambda queries: None)
    assert together == search() and all(together)


def test_questions_and_their_holders(spark):
    docs = spark.createDataFrame([("a", "x the quick brown fox jumps over y"), ("b", "the quick brown fox jumps"), ("c", "hi there"), ("d", "")], "src_id string, text string")
    asked = spark.createDataFrame([(1, "quick brown fox jumps"), (2, "hi"), (3, "own fox jumps over"), (4, "missing words are these")], "query_id int, question string")
    assert sorted(map(tuple, R.holders(asked, docs).collect())) == [(1, "a"), (1, "b"), (2, "c"), (3, "a")]


def test_artifacts_are_chosen_before_sources_meet_them(spark):
    rows = spark.createDataFrame([(f"SRC-{i:04}", "promoted" if i % 2 else "promoted_to_wiki", "same") for i in range(40)], "src_id string, status string, title string")
    art = rows.select("title", F.when(F.col("status") == "promoted", "curated").otherwise("wiki").alias("layer"), F.concat("src_id", F.lit(" text")).alias("text"))
    got = K.pushed(rows, art)
    assert {(r.src_id, r.layer, r.file_name, r.text) for r in got.collect()} == {(f"SRC-{i:04}", "curated", "same", "SRC-0001 text") for i in range(40)} and got.count() == 40
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # copies of a title make no pairs


def test_runs_of_terminators_stay_with_their_sentence(spark):
    docs = spark.createDataFrame([("a", "ab!! " + "c" * 18 + "!!dd?! !e")], "src_id string, text string")
    assert [(r.place, r.sentence) for r in S.long_sentences(docs).orderBy("place").collect()] == [(0, "ab!!"), (1, "c" * 18 + "!!dd?!!e")]


def test_nearest_ranks_on_what_is_shown(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 2e-4]), (2, [1.0, 1e-4]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    for kind in ("l2", "cosine"):
        got = R.nearest(vectors, F.col("vec_id") == 0, 2, kind, candidate_block=2).orderBy("rank").collect()
        assert [(r.vec_id, r.distance) for r in got] == [(1, 0.0), (2, 0.0)]


def test_sentences_are_cut_as_they_are_matched(spark):
    texts = ["", "a", "!!", "!! a", "a! !b.c", "a\n..b\n\n!?\n c。！d？ e.", " x \t.\r\n y\x85", "one. two three!?", "。a", "\n.\n", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.sentences(F.col("t"))).collect()]
    want = [None if t is None else [s for m in re.finditer(X.SENTENCE, t) if (s := m.group().strip(" \t\n\f\r"))] for t in texts]
    assert got == want


def test_keyword_hits_and_term_counts_are_worked_out_once(spark):
    """Each pattern stands once in the score's plan, and both sides of the join with document frequencies are one shuffle."""
    plan = compiled(spark).select(Q.score().alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2
    text = spark.createDataFrame([(1, "some words some"), (2, "other words")], "doc_id long, text string")
    rows = C.tfidf_terms(text)
    assert {(r.doc_id, r.word, r.tf) for r in rows.collect()} == {(1, "some", 2), (1, "words", 1), (2, "other", 1), (2, "words", 1)}
    assert "ReusedExchange" in run_plan(rows)


def test_tags_meet_concepts_as_arrays(spark):
    """A source's own concepts meet one row a concept, whose companions are listed in it; pairs are made inside a source's row."""
    rows = [("a", ["x", "y", "z"]), ("b", ["y", "x", "x"]), ("c", ["x", "w"]), ("d", ["w", "x"]), ("e", ["q"]), ("f", [])]
    table = spark.createDataFrame([(i, [(n, "") for n in names]) for i, names in rows], "src_id string, concepts array<struct<name:string,explanation:string>>")
    assert {tuple(r) for r in G.cooccurrences(table).collect()} == {("x", "y", 2), ("w", "x", 2)}
    got = G.tags(table, 3)
    assert {r.src_id: r.tags for r in got.collect()} == {"a": ["x", "y", "z"], "b": ["w", "x", "y"], "c": ["w", "x", "y"], "d": ["w", "x", "y"], "e": ["q"]}
    assert G.cooccurrences(table)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_collection_search_reads_written_vectors(spark):
    from corpusloom.plans.retrieval_queries import multi_collection_search

    found = multi_collection_search(spark, SMALL)
    assert "replace(lower(document" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_terms_of_larger_inputs_are_those_of_small_ones(spark, monkeypatch):
    """Ranks by bounds of frequencies, with tables so small that words share buckets, and a whole join give the same rows; only what may lead is joined."""
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcdeéжд"), 5)) for _ in range(3000)]
    texts = [" ".join(names[int(i)] for i in rng.zipf(1.3, int(rng.integers(0, 200))) if i <= len(names)) for _ in range(300)]
    rows = [*enumerate(texts), (400, None), (401, ""), (402, "Some some 1other éclat"), (402, "some éclat"), (403, "four some"), (404, " ".join(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in C.tfidf_terms(docs).collect())
    for frequent, buckets in ((C.FREQUENT, C.BUCKETS), (50, 64), (0, 1)):
        monkeypatch.setattr(C, "FREQUENT", frequent)
        monkeypatch.setattr(C, "BUCKETS", buckets)
        assert sorted(tuple(r) for r in C.tfidf_terms(docs, most_bytes=-1).collect()) == want
    monkeypatch.undo()
    one = docs.where("doc_id < 300")
    df = spark.createDataFrame([("the", 300), ("rare", 1), ("seldom", 2)], "word string, df long")
    led = C.may_lead(df, 300, 1)(F.array(*(F.lit(k).cast("long") for k in (90, 1, 2))), F.array(*(F.xxhash64(F.lit(w)) for w in ("the", "rare", "seldom"))))
    assert one.limit(1).select(led.alias("p")).first().p == [2]


def test_contexts_are_looked_for_once(spark):
    """A name without blanks is not looked for twice, and what was found is not worked out again."""
    plan = spark.range(1).select(C.concept_context(F.lit("x").alias("n"), F.array(F.lit("a x"))).alias("c"))._jdf.queryExecution().logical().toString()
    assert plan.lower().count("contains(") <= 4


def test_states_without_what_was_compiled(spark):
    """The narrow state is that of the compiled rows, also where rows share an id, a text or have few words; texts are outlined where they are, and the queries ask for no compiled table."""
    from corpusloom.plans import registry
    from corpusloom.sources import store

    long = "学习方法，很重要。" + "Some words that are told apart by their letters. " * 40
    texts = [long, long, "", None, "short text", "x " * 80, "word " * 40 + ". word", "four five sixty seven eight nines. " * 9, "one two Drei. " * 30, "Ünïted words and words here to be seen. " * 12]
    rows = [(f"SRC-{i:04d}", i, "" if t is None else t[:9], "a", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "src_id string, doc_id long, title string, type string, text string")
    plain = ["src_id", "doc_id", "type", "status", "error_message", "quality_score", "promoted_to"]
    shown = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    for d in (docs, docs.union(spark.createDataFrame([("SRC-0008", 8, "t", "a", "another second third. " * 20)], docs.schema))):
        full, lean = T.compiled_state(C.extractive(d), 40, 60), T.outlined_state(C.outlined(d), 40, 60)
        failed = lambda c: F.when(F.col("status") == "failed", F.col(c))
        want = shown(full.select(*plain, F.size("concepts"), F.length("text"), failed("title"), failed("text")))
        assert want == shown(lean.select(*plain, "n_concepts", "n_chars", "title", "text"))
        assert len({r[3] for r in want}) > 2
        assert shown(T.missing_concepts(lean).select("src_id")) == shown(T.missing_concepts(full).select("src_id"))
    assert "Exchange" not in run_plan(C.outlined(docs))
    store.forget(spark)
    registry.QUERIES["reset_failed"](spark, SMALL).count()
    names = {name for app, name in store._made if app == spark.sparkContext.applicationId}
    assert names == {f"states {SMALL}"}


def test_state_step_cuts_texts_no_further_than_it_needs(spark):
    """Where a text's beginning holds enough sentences and words the rest is not cut, and what is taken is that of the whole text, wherever the beginning ends."""
    import random

    from corpusloom.functions.text import first_sentences, sentences

    rng, bits = random.Random(7), ["a", "bc", "word", "Σοφος", "ΟΔΟΣ'", "İstanbul", "ʰʰʰʰ", ".", "!", "?", "...", "。", "！", "\n", " ", "\t", "’", "𝐱𝐲𝐳𝐱", "longer phrases here", "ß"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(400)] + ["", None, "." * 30, "same words " * 200, "One sentence is like the next. " * 5000]
    docs = spark.createDataFrame([(f"SRC-{i:04d}", i, "t", "a", t) for i, t in enumerate(texts)], "src_id string, doc_id long, title string, type string, text string").cache()
    whole, long = sentences(F.col("text")), lambda c: F.slice(F.filter(c, lambda x: F.length(x) >= 6), 1, 2)
    for head in (1, 7, 20, 60):
        part = first_sentences(F.col("text"), 2, 6, head)
        assert docs.where(~F.get(part, F.lit(0)).eqNullSafe(F.get(whole, F.lit(0))) | ~long(part).eqNullSafe(long(whole))).count() == 0
    assert docs.where("doc_id = 404").select(F.size(first_sentences(F.col("text"), 5, 15)), F.size(whole)).first() == (33, 5000)
    padded = docs.withColumn("text", F.concat(F.lit(" " * 960), "text"))  # the first 1000 letters end inside the made part
    for d in (docs, padded):
        full = d.select("doc_id", F.least(F.lit(5), F.coalesce(F.size(F.array_distinct(C._words())), F.lit(0))).alias("n"))
        assert C.outlined(d).join(full, "doc_id").where("n_concepts <> n").count() == 0
    plan = run_plan(C.outlined(docs))
    assert "CASE WHEN (size(array_distinct(regexp_extract_all(lower(substring(text" in plan.replace("left(", "substring(")
