"""Queries over promotion, downgrade, staleness and recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import lifecycle as L
from corpusloom.operators import quality as Q
from corpusloom.operators import segment as S
from corpusloom.plans.compile_queries import CURATED, MAN, PROV, TRUST, WIKI, compiled, manifests, states
from corpusloom.plans.manifest_queries import sources
from corpusloom.plans.registry import query, table


@query(f"WITH {MAN} SELECT src_id, quality_score, 'promoted_to_wiki' AS status, 'wiki' AS promoted_to FROM man WHERE status = 'compiled' AND quality_score >= 55")
def batch_promote(spark, sf_dir):
    return L.promoted(states(spark, sf_dir), "wiki", 55)


@query(f"WITH {MAN} SELECT src_id, quality_score, 'promoted' AS status, 'curated' AS promoted_to FROM man WHERE status = 'promoted_to_wiki' AND quality_score >= 60 ORDER BY quality_score DESC, src_id LIMIT 20")
def promote_to_curated(spark, sf_dir):
    """The best 20: the batch size is the feature."""
    return L.promoted(states(spark, sf_dir), "curated", 60, 20)


@query(f"""WITH {MAN} SELECT src_id, status AS was, CASE status WHEN 'promoted' THEN 'promoted_to_wiki' ELSE 'compiled' END AS status, 'score ' || quality_score || ' < 65' AS reason
FROM man WHERE status IN ('promoted', 'promoted_to_wiki') AND quality_score < 65""")
def auto_downgrade(spark, sf_dir):
    return L.downgraded(states(spark, sf_dir), 65)


@query(f"""WITH {MAN}, art AS (SELECT src_id, title || CASE WHEN doc_id % 3 = 0 THEN '_1' ELSE '' END AS stem FROM man WHERE status <> 'failed'), t AS (SELECT DISTINCT title FROM man WHERE status IN ('promoted_to_wiki', 'promoted'))
SELECT src_id, stem FROM art WHERE stem NOT IN (SELECT title FROM t) AND regexp_replace(stem, '_\\d+$', '') NOT IN (SELECT title FROM t)""")
def pollution_check(spark, sf_dir):
    man = manifests(spark, sf_dir)
    stem = F.concat("title", F.when(F.col("doc_id") % 3 == 0, "_1").otherwise(""))
    return L.polluted(man.where("status <> 'failed'").select("src_id", stem.alias("stem")), man)


NOW, OLD = L.fingerprint({"prompt": 5, "chunk": 4000}), L.fingerprint({"prompt": 4, "chunk": 4000})
#: Failed sources have no configuration; longer texts were compiled before the prompt changed.
CONFIG = f"CASE WHEN status = 'failed' THEN NULL WHEN length(text) > 1500 THEN '{OLD}' ELSE '{NOW}' END"


@query(f"WITH {MAN} SELECT src_id, CASE WHEN {CONFIG} IS NULL THEN 'no_config' WHEN {CONFIG} = '{NOW}' THEN 'up_to_date' ELSE 'stale' END AS state FROM man")
def stale_detection(spark, sf_dir):
    return L.staleness(states(spark, sf_dir).select("src_id", F.expr(CONFIG.replace("length(text)", "n_chars")).alias("config")), NOW)


VERSIONS = "SELECT src_id, v AS version, CAST((doc_id * 13 + v * 29) % 101 AS INT) AS score FROM man, (VALUES (1), (2), (3)) AS t(v)"


@query(f"WITH {MAN}, ver AS ({VERSIONS}), l AS (SELECT *, lag(score) OVER (PARTITION BY src_id ORDER BY version) AS before FROM ver) SELECT src_id, version, score, before, coalesce(before - score > 10, false) AS rolled_back FROM l")
def quality_rollback(spark, sf_dir):
    rows = states(spark, sf_dir).select("src_id", "doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("version"))
    return L.rolled_back(rows.select("src_id", "version", ((F.col("doc_id") * 13 + F.col("version") * 29) % 101).cast("int").alias("score")))


BATCHES = "SELECT user_id AS run, CAST(epoch(date_trunc('day', ts)) // 86400 AS BIGINT) AS batch, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1, 2"


@query(f"""WITH b AS (SELECT *, failed > 0.5 * (success + failed) AS bad FROM ({BATCHES})), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY batch) AS gb FROM b),
s AS (SELECT *, CASE WHEN bad THEN CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY run, gb ORDER BY batch) AS INTEGER) ELSE 0 END AS streak FROM g) SELECT run, batch, success, failed, bad, streak, streak >= 3 AS stops FROM s""")
def failure_streaks(spark, sf_dir):
    """Days of a user's events as batches of a run."""
    day = F.floor(F.unix_timestamp(F.date_trunc("day", "ts")) / 86400).cast("long")
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), day.alias("batch"))
    return L.failure_streaks(rows.agg(F.count_if(F.expr("event_type <> 'error'")).alias("success"), F.count_if(F.expr("event_type = 'error'")).alias("failed")))


@query(f"""WITH {PROV}, tr AS (SELECT src_id, {TRUST} AS trust_level FROM prov JOIN lint USING (src_id) WHERE doc_id IS NOT NULL), x AS (SELECT src_id, greatest(1, CAST(ceil((length(text) - 200) / 3800.0) AS INTEGER)) AS k FROM src WHERE length(text) > 0)
SELECT trust_level, CAST(sum(k) AS BIGINT) AS chunks, count(*) AS sources FROM x JOIN tr USING (src_id) GROUP BY trust_level""".replace(" WHERE doc_id IS NOT NULL", ""))
def chunk_trust(spark, sf_dir):
    """Chunks by the trust level of their source."""
    level = Q.traced(Q.linted(compiled(spark, sf_dir))).select("src_id", Q.trust().alias("trust_level"))
    rows = L.with_trust(S.fixed(sources(spark, sf_dir), 4000, 200).groupBy("src_id").agg(F.count("*").alias("k")), level)
    return rows.groupBy("trust_level").agg(F.sum("k").alias("chunks"), F.count("*").alias("sources"))


@query(f"""WITH {MAN}, r AS (SELECT src_id, text, error_message FROM man WHERE status = 'failed' AND NOT contains(lower(title), 'idiot')) SELECT CASE WHEN length(text) < 100 THEN 'no_text' WHEN contains(error_message, 'llm_failed') THEN 'sanitised' ELSE 'original' END AS method,
 count(*) AS n, CAST(sum(length(replace(replace(replace(text, 'idiot', '***'), 'moron', '***'), 'scum', '***'))) AS BIGINT) AS chars FROM r GROUP BY 1""")
def recovery_outcomes(spark, sf_dir):
    """Failed sources tried again: risky titles left out, text chosen and rewritten, outcomes counted by method."""
    from corpusloom.functions.text import rewrite_terms

    rows = states(spark, sf_dir).where((F.col("status") == "failed") & ~F.lower("title").contains("idiot"))
    method = F.when(F.length("text") < 100, "no_text").when(F.col("error_message").contains("llm_failed"), "sanitised").otherwise("original")
    clean = rewrite_terms(F.col("text"), {"idiot": "***", "moron": "***", "scum": "***"})
    return rows.groupBy(method.alias("method")).agg(F.count("*").alias("n"), F.sum(F.length(clean)).alias("chars"))
