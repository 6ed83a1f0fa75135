"""Jobs that run again, stores in buckets, responses and spans against brute force."""

import json
import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import ingest as I
from corpusloom.operators import recovery as V
from corpusloom.operators import retrieval as R
from corpusloom.operators import segment as S
from corpusloom.sources import bucketed, responses, store

FILES = "path string, name string, category string, size_bytes long, content_hash string"


@pytest.fixture
def named(spark):
    names = []

    def new(tag):
        names.append(f"t_{tag}_{uuid.uuid4().hex}")
        return names[-1]

    yield new
    for name in names:
        bucketed.drop(spark, name)


def outcomes(df):
    return sorted((r.path, r.outcome, r.seq, r.unique_name) for r in df.collect())


def test_ingest_runs_overlap_and_repeat(spark, named):
    name = named("known")
    files = lambda *rows: spark.createDataFrame([(p, n, c, s, h) for p, n, c, s, h in rows], FILES)
    one = files(("a", "x", "k", 1, "h1"), ("b", "x", "k", 1, "h2"), ("c", "y", "k", 1, "h1"), ("d", "z", None, 1, "h9"), ("e", "z", "k", 0, "h8"), ("f", "q", "k", None, None))
    first = outcomes(I.ingest(one, name, 1))
    assert first == [("a", "linked", 1, "x"), ("b", "linked", 2, "x_1"), ("c", "repeated", None, None), ("d", "skipped", None, None), ("e", "failed", None, None), ("f", "failed", None, None)]
    two = files(("b", "x", "k", 1, "h2"), ("c2", "y", "k", 1, "h1"), ("g", "x", "k", 1, "h3"), ("h", "w", "k", 1, "h4"), ("i", "w", "k", 1, "h4"))
    second = outcomes(I.ingest(two, name, 2))
    assert second == [("b", "known", None, None), ("c2", "known", None, None), ("g", "linked", 3, "x_2"), ("h", "linked", 4, "w"), ("i", "repeated", None, None)]
    held = lambda: sorted(map(tuple, spark.table(name).collect()))
    before = held()
    assert outcomes(I.ingest(two, name, 2)) == second and outcomes(I.ingest(one, name, 1)) == first and held() == before  # runs that are repeated
    assert [r.seq for r in spark.table(name).orderBy("seq").collect()] == [1, 2, 3, 4]
    assert I.ingest(files(), name, 3).collect() == [] and outcomes(I.ingest(two, name, 4))[2][1] == "known"
    assert I.statistics(I.ingest(two, name, 2), "category").first().asDict() == {"category": "k", "total": 5, "linked": 2, "known": 2, "repeated": 1, "skipped": 0, "failed": 0}


def test_a_join_by_the_key_leaves_a_store_where_it_is(spark, named):
    name = named("answers")
    rows = lambda a, b, v: spark.range(a, b).selectExpr("concat('k', id) AS key", f"concat('{v}', id) AS result", "1L AS ts")
    R.keep_answers(rows(0, 60, "old"), name, 1)
    R.keep_answers(rows(30, 90, "new"), name, 2)
    R.keep_answers(rows(30, 90, "new"), name, 2)
    asked = spark.range(100).selectExpr("id", "concat('k', id) AS key")
    want = {i: (f"old{i}" if i < 30 else f"new{i}") if i < 90 else None for i in range(100)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.known_answers(asked, name)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1, text  # the questions'
        assert {r.id: r.result for r in plan.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    bucketed.compact(spark, name, "key", "ts")
    assert spark.table(name).count() == 90 and {r.id: r.result for r in R.known_answers(asked, name).collect()} == want
    R.keep_answers(rows(95, 97, "late"), name, 3)
    assert spark.table(name).count() == 92
    assert {r.hit for r in R.known_answers(asked, "t_no_such_store").collect()} == {False}


MANIFEST = "src_id string, doc_id long, title string, type string, text string, status string, quality_score int, error_message string, promoted_to string"


def test_recovery_attempts(spark, named):
    name, long = named("attempts"), "A sentence that is long enough to be a point. " * 5
    man = spark.createDataFrame(
        [("s1", 1, "t", "a", "short", "failed", 0, "no_text", None), ("s2", 2, "t", "a", long + "idiot", "failed", 0, "llm_failed: x", None), ("s3", 3, "bad word", "a", long, "failed", 0, "llm_failed", None), ("s4", 4, "t", "a", long, "compiled", 50, None, None), ("s5", 5, "t", "a", None, "failed", 0, "no_text", None)],
        MANIFEST,
    )
    none = spark.createDataFrame([], "src_id string, text string")
    read = spark.createDataFrame([("s1", long)], "src_id string, text string")
    run = lambda attempt, conv: {r.src_id: (r.method, r.outcome, r.error_message) for r in V.recover(man, conv, none, name, attempt, risky=["bad"], rewrites={"idiot": "***"}).collect()}
    first = run(1, none)
    assert first == {"s1": ("rejected", "failed", "too_short"), "s2": ("sanitised", "recovered", None), "s3": ("skipped", "skipped", "risky_title"), "s5": ("rejected", "failed", "no_text")}
    second = run(2, read)
    assert second == {"s1": ("converted", "recovered", None), "s3": ("skipped", "skipped", "risky_title"), "s5": ("rejected", "failed", "no_text")}
    assert run(2, read) == second and run(1, none) == first and spark.table(name).count() == 7  # attempts that are repeated
    state = {r.src_id: (r.status, r.quality_score > 0) for r in V.restated(man, name).collect()}
    assert state == {"s1": ("compiled", True), "s2": ("compiled", True), "s3": ("failed", False), "s4": ("compiled", True), "s5": ("failed", False)}
    assert {(r.method, r.outcome): r.n for r in V.outcomes(spark.table(name)).collect()} == {("rejected", "failed"): 3, ("sanitised", "recovered"): 1, ("skipped", "skipped"): 2, ("converted", "recovered"): 1}


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(st.sampled_from('a b"\\{}[],:\né'), max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab\"{", max_size=3), x, max_size=3), max_leaves=8)
OBJECTS = st.dictionaries(st.text("abc", min_size=1, max_size=3), VALUES, max_size=4)


@given(OBJECTS, st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_objects_are_found_and_mended(value, seed):
    r, text = random.Random(seed), json.dumps(value, ensure_ascii=bool(seed % 2))
    noisy = r.choice(["", "So {maybe}: ", 'He said "no" and '] ) + text + r.choice(["", " done", "}", ' {"later": 1}'])
    assert json.loads(responses.outer_object(noisy)) == value
    brackets, i = [], 0  # places of brackets outside strings
    while i < len(text):
        if text[i] == '"':
            i += 1
            while text[i] != '"':
                i += 2 if text[i] == "\\" else 1
        elif text[i] in "{}[]":
            brackets.append(i)
        i += 1
    closing = [i for i in brackets if text[i] in "}]" and not text[:i].rstrip().endswith(("{", "["))]
    commas = text
    for i in sorted(r.sample(closing, r.randint(0, len(closing))), reverse=True):
        commas = commas[:i] + ", " + commas[i:]
    bare = commas.rstrip("}]") if commas.endswith(("}", "]")) and not commas.rstrip("}]").endswith(("{", "[")) and value else commas
    assert json.loads(responses.repaired("x " + commas)) == value
    assert json.loads(responses.repaired(bare)) == value or bare != commas and '"' in bare[-1:]


def test_responses(spark):
    rows = [(1, '{"a": 1}', '{"a": 1}', "native"), (2, ' {"a": [1]} ', '{"a": [1]}', "native"), (3, 'x\n```json\n{"a": 1}\n```', '{"a": 1}', "native"), (4, 'see {"a": {"b": "}"}} end', '{"a": {"b": "}"}}', "scanned"), (5, '{"a": [1, 2,], "b": "x', '{"a": [1, 2], "b": "x"}', "repaired"), (6, "none", None, "none"), (7, None, None, "none"), (8, "[1, 2]", None, "none"), (9, '{"a": oops, "b": {"c": 1}}', '{"c": 1}', "inner"), (10, '{"a":', '{"a":null}', "repaired")]
    got = {r.id: (r.json, r.how) for r in responses.parsed(spark.createDataFrame([x[:2] for x in rows], "id long, text string")).collect()}
    assert got == {i: (want, how) for i, _, want, how in rows}


def test_semantic_chunks_are_spans_of_their_text(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["alpha beta. ", "x! ", "  ", "\n", "lirum larum 漢字。", "rstn " * 30 + "? ", "no end "]) for _ in range(r.randint(0, 40))) for _ in range(40)] + ["", " \n ", None, "one"]
    docs = spark.createDataFrame([(f"s{i:02}", t) for i, t in enumerate(texts)], "src_id string, text string")
    got = S.semantic_spans(docs, size=120, overlap=30).collect()
    by_id = {f"s{i:02}": t for i, t in enumerate(texts)}
    seen = {}
    for c in sorted(got, key=lambda c: (c.src_id, c["index"])):
        assert c.content == by_id[c.src_id][c.start : c.end] and c.content.strip() == c.content and 0 < len(c.content) <= 120
        seen.setdefault(c.src_id, set()).update(range(c.start, c.end))
    for src_id, t in by_id.items():
        assert {i for i, c in enumerate(t or "") if not c.isspace()} <= seen.get(src_id, set()), src_id
    spans = {(x.src_id, x.start, x.end, x.sentence) for x in S.sentence_spans(docs).collect()}
    assert all(by_id[s][a:b] == text for s, a, b, text in spans)
    assert {s: sum(b - a for k, a, b, _ in spans if k == s) for s in by_id} == {s: len(t or "") for s, t in by_id.items()}


def test_ids_of_many_chunks(spark):
    rows = spark.range(10_001).selectExpr("'SRC-0001' AS src_id", "int(id) AS index", "'x' AS content")
    ids = {r.id for r in S.with_ids(rows, "fixed").collect()}
    assert len(ids) == 10_001 and {"SRC-0001_chunk_0007", "SRC-0001_chunk_10000"} <= ids


def test_a_stored_table_follows_its_input(spark, tmp_path):
    path = str(tmp_path / "in")
    build = lambda: spark.read.parquet(path)
    for n in (20, 60):
        spark.range(n).write.mode("overwrite").parquet(path)
        for _ in range(2):
            assert store.once(spark, f"rows of {path}", build, path).count() == n


def sections_of(text, size):
    """What `structured` gives for a text, written as loops."""
    import re

    def cut(is_head):
        parts = []
        for i, line in enumerate(text.split("\n")):
            if not parts or is_head(i, line):
                parts.append([line])
            else:
                parts[-1].append(line)
        return [(k, p[0], "\n".join(p).strip()) for k, p in enumerate(parts) if "\n".join(p).strip()]

    first = next((i for i, line in enumerate(text.split("\n")) if line.strip()), 0)
    by_heading = cut(lambda i, line: re.match(S.HEADING, line))
    by_number = cut(lambda i, line: re.match(S.NUMBERING, line) and i > first)
    if len(by_heading) > 1:
        heads = [re.match(S.HEADING, head) for _, head, _ in by_heading]
        found = [(len(m.group(1)) if m else 0, m.group(2).strip() if m else "", body) for m, (_, _, body) in zip(heads, by_heading)]
    elif len(by_number) > 1:
        heads = [re.match(S.NUMBERING, head) if i else None for i, (_, head, _) in enumerate(by_number)]
        found = [(1, next((g.strip() for g in m.groups() if g and g.strip()), "") if m else "", body) for m, (_, _, body) in zip(heads, by_number)]
    else:
        found = [(0, "", text.strip())] if text.strip() else []
    out = []
    for level, title, body in found:
        pieces = [body[a:b] for a, b in S.by_paragraphs(body, size, 10)] if len(body) > size else [body]
        out += [(level, title, p) for p in pieces]
    return out


def test_structured_against_loops(spark):
    r = random.Random(12)
    lines = ["# One", "## Two  parts", "1. first", "2、second point", "(3) third", "plain words here", "", "x" * 70, "一. 中文", "#no heading"]
    texts = ["\n".join(r.choice(lines[: r.choice([2, 5, 6, 10])] if r.random() < 0.5 else lines[2:]) for _ in range(r.randint(0, 12))) for _ in range(150)]
    docs = spark.createDataFrame([(f"s{i:03}", t) for i, t in enumerate(texts)], "src_id string, text string")
    got = {}
    for row in S.structured(docs, 60, 10).orderBy("src_id", "index").collect():
        got.setdefault(row.src_id, []).append((row.level, row.title, row.content))
    assert got == {f"s{i:03}": want for i, t in enumerate(texts) if (want := sections_of(t, 60))}


def test_sample_check(spark):
    from corpusloom.operators import state as T

    rows = spark.createDataFrame([(f"s{i}", "" if i % 2 else "l", [] if i % 3 else ["k"], "d" if i % 5 else "", [("c", "")] if i % 7 else None) for i in range(40)], "src_id string, one_line string, key_points array<string>, detailed_summary string, concepts array<struct<name:string,explanation:string>>")
    picks = [{r.src_id: r.lacks for r in T.sample_checked(rows, seed, 12).collect()} for seed in (1, 1, 2)]
    assert picks[0] == picks[1] != picks[2] and all(len(p) == 12 for p in picks)
    for p in picks:
        for src_id, lacks in p.items():
            i = int(src_id[1:])
            assert lacks == ",".join(k for k, bad in (("one_line", i % 2), ("key_points", i % 3), ("detailed_summary", i % 5 == 0), ("concepts", i % 7 == 0)) if bad)
    assert len(T.sample_checked(rows, 1, 100).collect()) == 40
