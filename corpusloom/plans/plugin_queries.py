"""Queries that choose backends by name and run plug-ins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corpusloom import backends as B
from corpusloom.operators import compile as C
from corpusloom.operators import quality as Q
from corpusloom.operators import retrieval as R
from corpusloom.plans import retrieval_queries as RQ
from corpusloom.plans.compile_queries import COMP, SCORE, compiled
from corpusloom.plans.manifest_queries import SRC, sources
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval_queries import HYB, _LV, hybrid, questions
from corpusloom.plans.segment_queries import SENTENCES
from corpusloom.plugins import Registry, chosen, configured


def _line_end(start: str) -> str:
    """SQL: where the window of 1000 characters from `start` on ends, at a line's end in its second half if there is one."""
    back = f"strpos(reverse(substring(text, {start} + 1, 1000)), chr(10))"
    return f"CASE WHEN {start} + 1000 >= n THEN n WHEN {back} BETWEEN 1 AND 499 THEN {start} + 1001 - {back} ELSE {start} + 1000 END"


@query(f"""WITH RECURSIVE {SRC}, x AS (SELECT src_id, text, length(text) AS n FROM src WHERE length(text) > 0), w AS (SELECT src_id, text, unnest(range(greatest(1, CAST(ceil((n - 100) / 900.0) AS INTEGER)))) AS i FROM x),
ln AS (SELECT src_id, text, n, 0::BIGINT AS start, {_line_end('0')} AS stop FROM x UNION ALL SELECT src_id, text, n, nx, {_line_end('nx')} FROM (SELECT src_id, text, n, greatest(stop - 100, start + 1) AS nx FROM ln WHERE stop < n) AS t)
SELECT src_id, 'fixed' AS strategy, CAST(i AS INTEGER) AS "index", CAST(i * 900 AS INTEGER) AS start, CAST(least(length(text), i * 900 + 1000) AS INTEGER) AS "end", substring(text, i * 900 + 1, 1000) AS content FROM w
UNION ALL SELECT src_id, 'line', CAST(row_number() OVER (PARTITION BY src_id ORDER BY start) - 1 AS INTEGER), CAST(start AS INTEGER), CAST(stop AS INTEGER), substring(text, start + 1, stop - start) FROM ln WHERE regexp_matches(substring(text, start + 1, stop - start), '[^\\s]')""")
def chunks_by_name(spark, sf_dir):
    """Every document by two chunkers, each a table function that LATERAL calls by its name."""
    docs = sources(spark, sf_dir)
    return B.chunked(docs, "fixed", 1000, 100).union(B.chunked(docs, "line", 1000, 100))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+', 0))"


@query(f"""WITH {HYB}, w AS (SELECT query_id, channel, manifest_id, rank, {_WORDS.format('question')} AS a, {_WORDS.format('hy.text')} AS b FROM hy JOIN (SELECT query_id, question FROM qt) USING (query_id))
SELECT query_id, channel, manifest_id, rank, len(list_intersect(a, b)) / greatest(1, len(a)) AS overlap, 2 * len(list_intersect(a, b)) / greatest(1, len(a) + len(b)) AS dice FROM w""")
def scores_by_name(spark, sf_dir):
    """Candidates scored by two rerankers, chosen by their names."""
    rows = hybrid(spark, sf_dir).join(questions(spark, sf_dir), "query_id")
    scores = {name: chosen("reranker", name)(F.col("question"), F.col("text")) for name in ("overlap", "dice")}
    return rows.select("query_id", "channel", "manifest_id", "rank", *(c.alias(name) for name, c in scores.items()))


@query(f"WITH {SRC}, x AS (SELECT src_id, {_LV.format('text')} AS v FROM src) SELECT src_id, array_to_string(v, ',') AS v, list_sum(v) AS total FROM x")
def embedded_by_name(spark, sf_dir):
    """Every document's vector by the embedder that the session's settings name."""
    v = configured(spark, "embedder", "letters")(F.col("text"))
    return sources(spark, sf_dir).select("src_id", v.alias("v")).select("src_id", F.array_join(F.transform("v", lambda x: F.format_string("%.1f", x)), ",").alias("v"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {SRC}, x AS (SELECT src_id, text, {SENTENCES.format('text')} AS s FROM src) SELECT src_id, coalesce(s[1], '') AS one_line, array_to_string(s[1:5], '|') AS key_points FROM x")
def compiled_by_name(spark, sf_dir):
    """The compile job with another compiler than the extracts, chosen by its name."""
    docs = sources(spark, sf_dir).select("src_id", "doc_id", "title", "type", "text")
    return C.compile_job(docs, Registry(), chosen("compiler", "leading")).select("src_id", "one_line", F.array_join("key_points", "|").alias("key_points"))


def _strict_scores(rows: pd.DataFrame) -> pd.Series:
    """A plug-in's scores: what the first line's length says; it knows nothing of lines without a blank, and fails on the type src1."""
    if (rows["type"] == "src1").any():
        raise ValueError("src1 is not scored")
    return pd.Series([min(120, len(x)) if " " in x else None for x in rows["one_line"]])


@query(f"""WITH {COMP} SELECT src_id, CAST(CASE WHEN type <> 'src1' AND contains(one_line, ' ') THEN least(100, length(one_line)) ELSE {SCORE} END AS INTEGER) AS quality_score, CASE WHEN type = 'src1' THEN 1 ELSE 0 END AS errors FROM comp""")
def scored_with_plugin(spark, sf_dir):
    """The scoring job with a plug-in that scores some rows, passes on others and fails on those of one type."""
    plugins = Registry()
    plugins.add_batch("quality_score", "strict", _strict_scores, "double")
    return Q.scored(compiled(spark, sf_dir), plugins).select("src_id", "quality_score", F.size("plugin_errors").alias("errors"))


def _search_plugins() -> Registry:
    plugins = Registry()
    plugins.add("pre_query", "no even questions", lambda q: q.where("query_id % 2 = 1"))
    plugins.add("pre_query", "broken", lambda q: q.select("no such column"))
    plugins.add("post_query", "no weak hits", lambda hits: R.without_weak(hits.withColumn("score", F.col("normalized_score")), 0.5).drop("score"))
    return plugins


@query(f"WITH {RQ.SEARCH} SELECT query_id, channel, manifest_id, text, raw_score, normalized_score, channel_rank FROM se WHERE query_id % 2 = 1 AND normalized_score >= 0.5")
def searched_with_plugins(spark, sf_dir):
    """Search in all modes with a step before it, a step after it, and one that fails and is skipped."""
    return RQ.found(spark, sf_dir, _search_plugins()).drop("name")
