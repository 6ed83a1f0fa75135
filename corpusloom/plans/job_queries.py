"""Whole jobs over stores that grow by runs: ingest, recovery, answers, responses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import ingest as I
from corpusloom.operators import recovery as V
from corpusloom.operators import retrieval as R
from corpusloom.plans.compile_queries import COMP, MAN, SCORE, compiled, manifests
from corpusloom.plans.manifest_queries import SRC
from corpusloom.plans.registry import query, table
from corpusloom.plans.retrieval_queries import CTX, hybrid, questions
from corpusloom.sources import bucketed, responses
from corpusloom.sources.store import written


def _store(name: str) -> str:
    """A store of the query's own, so that queries do not meet; it is dropped when the result is written."""
    return f"corpusloom_{name}_{uuid.uuid4().hex}"


@query(f"""WITH {COMP} SELECT src_id, ['native', 'scanned', 'native', 'repaired', 'repaired', 'none'][CAST(doc_id % 6 AS INTEGER) + 1] AS how, CASE WHEN doc_id % 6 < 5 THEN one_line END AS one_line, CASE WHEN doc_id % 6 < 5 THEN array_to_string(key_points, '|') END AS key_points FROM comp""")
def responses_parsed(spark, sf_dir):
    """Summaries as a model may write them, read back: bare, among other text, fenced, with a comma too many, cut off, and none at all."""
    rows = compiled(spark, sf_dir)
    whole = F.to_json(F.struct("one_line", "key_points", F.col("concepts").alias("concepts")))
    cut = F.left(whole, F.length(whole) - 1)
    kinds = (whole, F.concat(F.lit("Here is {the draft}: "), whole, F.lit(" {done")), F.concat(F.lit("Sure.\n```json\n"), whole, F.lit("\n```")), F.concat(cut, F.lit(", }")), cut, F.lit("I cannot do that."))
    noisy = F.coalesce(*(F.when(F.col("doc_id") % 6 == i, c) for i, c in enumerate(kinds)))
    read = responses.parsed(rows.select(F.col("src_id").alias("id"), noisy.alias("text")))
    fields = F.from_json("json", "one_line string, key_points array<string>")
    return read.select(F.col("id").alias("src_id"), "how", fields["one_line"].alias("one_line"), F.array_join(fields["key_points"], "|").alias("key_points"))


@query("""WITH f AS (SELECT printf('%08d', doc_id) AS path, 'note' || doc_id % 97 AS name, CASE WHEN doc_id % 13 <> 0 THEN 'articles' END AS category, strlen(text) AS size, sha256(text) AS h, lang FROM documents),
g AS (SELECT * FROM f WHERE category IS NOT NULL AND size > 0), u1 AS (SELECT h, min(path) AS path FROM g WHERE lang = 'en' GROUP BY h), u2 AS (SELECT h, min(path) AS path FROM g WHERE h NOT IN (SELECT h FROM u1) GROUP BY h),
l1 AS (SELECT path, name, row_number() OVER (ORDER BY path) AS seq, row_number() OVER (PARTITION BY name ORDER BY path) - 1 AS k FROM g WHERE path IN (SELECT path FROM u1)),
l2 AS (SELECT path, g.name, row_number() OVER (ORDER BY path) + (SELECT count(*) FROM l1) AS seq, row_number() OVER (PARTITION BY g.name ORDER BY path) - 1 + coalesce(t, 0) AS k FROM g LEFT JOIN (SELECT name, count(*) AS t FROM l1 GROUP BY name) USING (name) WHERE path IN (SELECT path FROM u2)),
o AS (SELECT 1 AS run, f.*, l1.seq, l1.k, false AS known FROM f LEFT JOIN l1 USING (path) WHERE lang = 'en' UNION ALL SELECT 2, f.*, l2.seq, l2.k, h IN (SELECT h FROM u1) FROM f LEFT JOIN l2 USING (path))
SELECT CAST(run AS INTEGER) AS run, path, category, CASE WHEN category IS NULL THEN 'skipped' WHEN size = 0 THEN 'failed' WHEN seq IS NOT NULL THEN 'linked' WHEN known THEN 'known' ELSE 'repeated' END AS outcome, seq, printf('SRC-%04d', seq) AS src_id, CASE WHEN k = 0 THEN name ELSE name || '_' || k END AS unique_name FROM o""".replace("printf('SRC-%04d', seq) AS src_id", "CASE WHEN seq IS NOT NULL THEN printf('SRC-%04d', seq) END AS src_id").replace("CASE WHEN k = 0 THEN name ELSE", "CASE WHEN k IS NULL THEN NULL WHEN k = 0 THEN name ELSE"))
def ingest_runs(spark, sf_dir):
    """Two runs of the ingest job, the English documents and then all of them: an outcome for every file of each."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(
        F.format_string("%08d", "doc_id").alias("path"), F.concat(F.lit("note"), (F.col("doc_id") % 97).cast("string")).alias("name"), F.when(F.col("doc_id") % 13 != 0, "articles").alias("category"),
        F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("content_hash"), "lang",
    )
    store = _store("known")
    first, second = (I.ingest(rows.drop("lang"), store, run).withColumn("run", F.lit(run)) for run, rows in ((1, files.where("lang = 'en'")), (2, files)))
    out = written(first.union(second), "outcomes")
    bucketed.drop(spark, store)
    return out.select("run", "path", "category", "outcome", "seq", "src_id", "unique_name")


REST = COMP.removeprefix(SRC + ", ")
_REPLACED = "replace(replace({}, 'idiot', '***'), 'moron', '***')"


def _compiled_from(rows: str) -> str:
    """SQL: score and number of key points of the texts that a table has, compiled by themselves."""
    return f"(WITH src AS (SELECT * FROM {rows}), {REST} SELECT src_id, CAST({SCORE} AS INTEGER) AS q, len(key_points) AS kp FROM comp)"


@query(f"""WITH {MAN}, fl AS (SELECT src_id, doc_id, title, type, text, error_message, contains(lower(title), 'idiot') AS risky, CASE WHEN doc_id % 2 = 0 THEN repeat(text || ' and so on. ', 30) END AS conv, CASE WHEN doc_id % 3 = 0 THEN repeat(text || ' was read. ', 30) END AS ocr FROM man WHERE status = 'failed'),
ch AS (SELECT *, CASE WHEN length(trim(text)) >= 100 THEN text WHEN length(trim(conv)) >= 100 THEN conv END AS t1, CASE WHEN length(trim(text)) >= 100 THEN text WHEN length(trim(conv)) >= 100 THEN conv WHEN length(trim(ocr)) >= 100 THEN ocr END AS t2 FROM fl),
a1 AS (SELECT src_id, doc_id, title, type, CASE WHEN contains(error_message, 'llm_failed') THEN {_REPLACED.format('t1')} ELSE t1 END AS text FROM ch WHERE NOT risky AND contains(error_message, 'no_text') AND t1 IS NOT NULL), c1 AS {_compiled_from('a1')}, ok1 AS (SELECT * FROM c1 WHERE kp >= 1),
a2 AS (SELECT src_id, doc_id, title, type, CASE WHEN contains(error_message, 'llm_failed') THEN {_REPLACED.format('t2')} ELSE t2 END AS text FROM ch WHERE NOT risky AND t2 IS NOT NULL AND src_id NOT IN (SELECT src_id FROM ok1)), c2 AS {_compiled_from('a2')}, ok2 AS (SELECT * FROM c2 WHERE kp >= 0),
ok AS (SELECT * FROM ok1 UNION ALL SELECT * FROM ok2), bad AS (SELECT src_id, CASE WHEN t2 IS NULL THEN CASE WHEN text IS NULL AND conv IS NULL AND ocr IS NULL THEN 'no_text' ELSE 'too_short' END ELSE 'llm_failed: empty key points' END AS e FROM ch WHERE NOT risky AND src_id NOT IN (SELECT src_id FROM ok))
SELECT man.src_id, CASE WHEN ok.src_id IS NOT NULL THEN 'compiled' ELSE status END AS status, CASE WHEN ok.q > 0 THEN ok.q ELSE quality_score END AS quality_score, coalesce(bad.e, error_message) AS error_message FROM man LEFT JOIN ok USING (src_id) LEFT JOIN bad USING (src_id)""")
def recovered_manifests(spark, sf_dir):
    """Two attempts for the failed sources, the second with texts that were read by other means: the state of every source after them."""
    return _recovered(spark, sf_dir)[1]


def _recovered(spark, sf_dir):
    man = manifests(spark, sf_dir)
    failed = man.where("status = 'failed'")
    other = lambda n, tail: failed.where(F.col("doc_id") % n == 0).select("src_id", F.repeat(F.concat("text", F.lit(tail)), F.lit(30)).alias("text"))
    converted, recognised = other(2, " and so on. "), other(3, " was read. ")
    store, words = _store("attempts"), {"risky": ["idiot"], "rewrites": {"idiot": "***", "moron": "***"}}
    V.recover(man, converted, recognised.limit(0), store, 1, "text", **words)
    V.recover(man, converted, recognised, store, 2, "all", **words, least_points=0)
    counts = written(V.outcomes(spark.table(store)), "outcomes")
    state = written(V.restated(man, store).select("src_id", "status", "quality_score", "error_message"), "restated")
    bucketed.drop(spark, store)
    return counts, state


@query(f"""WITH {CTX}, a AS (SELECT query_id, sha256(question || chr(10) || '---' || chr(10) || context) AS key, context FROM cx JOIN (SELECT query_id, question FROM qt) USING (query_id)),
e AS (SELECT key, 'first: ' || left(context, 40) AS result, 1 AS v FROM a WHERE query_id % 2 = 1 UNION ALL SELECT key, 'second: ' || left(context, 40), 2 FROM a WHERE query_id % 3 = 0), l AS (SELECT key, arg_max(result, v) AS result FROM e GROUP BY key)
SELECT query_id, l.key IS NOT NULL AS hit, result FROM a LEFT JOIN l USING (key)""")
def answer_lookup(spark, sf_dir):
    """Which questions a store of answers knows, after two runs that have put answers there and a compaction."""
    rows = R.context(hybrid(spark, sf_dir).where("rank <= 5")).join(questions(spark, sf_dir), "query_id")
    asked = written(rows.select("query_id", R.answer_key(F.col("question"), F.col("context")).alias("key"), F.left("context", F.lit(40)).alias("shown")), "asked")
    store = _store("answers")
    for run, (part, word) in enumerate((("query_id % 2 = 1", "first: "), ("query_id % 3 = 0", "second: ")), 1):
        R.keep_answers(asked.where(part).select("key", F.concat(F.lit(word), "shown").alias("result"), F.lit(run).cast("long").alias("ts")), store, run)
    bucketed.compact(spark, store, "key", "ts")
    out = written(R.known_answers(asked.select("query_id", "key"), store), "answers")
    bucketed.drop(spark, store)
    return out.select("query_id", "hit", "result")
