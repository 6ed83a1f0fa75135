"""Queries over search, candidates, context and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import compile as C
from corpusloom.operators import contribute as K
from corpusloom.operators import graph as G
from corpusloom.operators import quality as Q
from corpusloom.operators import retrieval as R
from corpusloom.operators import segment as S
from corpusloom.operators import vector_index as V
from corpusloom.plans.compile_queries import COMP, MAN, compiled, manifests
from corpusloom.plans.manifest_queries import SRC, sources
from corpusloom.plans.registry import query, table
from corpusloom.sources.store import written

# Abbreviations of the example plug-in.
ABBREVIATIONS = {"kb": "knowledge base", "llm": "large language model", "rag": "retrieval augmented generation"}
TERMS = """qt AS (SELECT item_id AS query_id, text AS question, lower(text) AS q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+', 0)) AS terms FROM benchmark), te AS (SELECT query_id, unnest(terms) AS t FROM qt)"""
KEY = f"""{SRC}, {TERMS}, low AS (SELECT src_id, lower(title) AS stem, lower(text) AS body FROM src),
pts AS (SELECT query_id, src_id, CASE WHEN contains(stem, t) THEN 5 ELSE 0 END + least((length(body) - length(replace(body, t, ''))) // length(t), 3) AS p FROM te, low
 UNION ALL SELECT query_id, src_id, 10 FROM qt, low WHERE stem <> '' AND contains(q, stem)),
sc AS (SELECT query_id, src_id, CAST(sum(p) AS INTEGER) AS score FROM pts GROUP BY query_id, src_id HAVING sum(p) > 0),
kw AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 5)"""
NORM = "least(1.0::DOUBLE, round(1 - exp(-score / 5.0::DOUBLE), 3))"


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def keyword(spark, sf_dir):
    return R.keyword_search(questions(spark, sf_dir), sources(spark, sf_dir), 5)


def expected(spark, sf_dir):
    """Which documents hold a question's whole text."""
    return R.holders(questions(spark, sf_dir), sources(spark, sf_dir))


@query("WITH q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+', 0)) AS terms FROM benchmark) SELECT query_id, unnest(terms) AS term FROM q")
def query_terms(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", F.explode(X.query_terms(F.col("question"))).alias("term"))


@query(f"WITH {KEY} SELECT query_id, src_id, score, {NORM} AS normalized_score, rank FROM kw")
def keyword_search_topk(spark, sf_dir):
    return keyword(spark, sf_dir)


EVAL = f"""{KEY}, ex AS (SELECT query_id, src_id FROM qt, src WHERE contains(src.text, question)), met AS (SELECT ex.query_id, ex.src_id, rank FROM ex LEFT JOIN kw USING (query_id, src_id)),
ev AS (SELECT query_id, count(*) AS n, count(rank) AS found, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg, array_to_string(list_sort(list(src_id) FILTER (rank IS NULL)), ',') AS missed FROM met GROUP BY query_id),
em AS (SELECT query_id, round(found / n, 4) AS recall, round(found / 5, 4) AS precision, round(coalesce(1 / first, 0), 4)::DOUBLE AS mrr, round(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 4) AS ndcg, coalesce(missed, '') AS missed FROM ev)"""


@query(f"WITH {EVAL} SELECT * FROM em")
def rag_metrics_at_5(spark, sf_dir):
    return R.metrics(keyword(spark, sf_dir), expected(spark, sf_dir), 5).withColumn("missed", F.array_join("missed", ","))


@query(f"WITH {EVAL} SELECT count(*) AS samples, round(avg(recall), 4) AS avg_recall, round(avg(precision), 4) AS avg_precision, round(avg(mrr), 4) AS avg_mrr, round(avg(ndcg), 4) AS avg_ndcg FROM em")
def rag_metrics_avg(spark, sf_dir):
    return R.averages(R.metrics(keyword(spark, sf_dir), expected(spark, sf_dir), 5))


@query(f"WITH {EVAL} SELECT query_id, src_id AS missed FROM met WHERE rank IS NULL")
def retrieval_misses(spark, sf_dir):
    return expected(spark, sf_dir).join(keyword(spark, sf_dir), ["query_id", "src_id"], "left_anti").select("query_id", F.col("src_id").alias("missed"))


CON = f"""{COMP}, {TERMS}, cp AS (SELECT query_id, src_id, place, name, sum(CASE WHEN contains(lower(name), t) THEN 5 ELSE 0 END + CASE WHEN contains(lower(explanation), t) THEN 2 ELSE 0 END) AS score FROM te, con GROUP BY query_id, src_id, place, name),
ck AS (SELECT * FROM (SELECT query_id, src_id, name, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src_id, place) AS INTEGER) AS rank FROM cp WHERE score > 0) WHERE rank <= 5)"""


@query(f"WITH {CON} SELECT query_id, src_id, name, score, rank FROM ck")
def concept_search_topk(spark, sf_dir):
    return R.concept_search(questions(spark, sf_dir), C.concept_rows(compiled(spark, sf_dir)), 5).drop("text")


HYB = f"""{CON}, low AS (SELECT src_id, lower(title) AS stem, lower(text) AS body FROM src), {KEY.split('low AS', 1)[1].split('),', 1)[1].strip()},
ch AS (SELECT query_id, 'concept' AS channel, src_id AS manifest_id, name AS text, {NORM} AS normalized_score FROM ck UNION ALL SELECT query_id, 'summary', src_id, one_line, {NORM} FROM kw JOIN comp USING (src_id)),
dd AS (SELECT *, left(md5(text), 12) AS text_hash FROM ch), d1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, manifest_id, text_hash ORDER BY normalized_score DESC, channel) AS r FROM dd),
hy AS (SELECT query_id, channel, manifest_id, text, normalized_score, text_hash, CAST(row_number() OVER (PARTITION BY query_id ORDER BY normalized_score DESC, channel, manifest_id, text_hash) AS INTEGER) AS rank FROM d1 WHERE r = 1)"""


def hybrid(spark, sf_dir):
    comp = compiled(spark, sf_dir)
    concept = R.concept_search(questions(spark, sf_dir), C.concept_rows(comp), 5)
    concept = concept.select("query_id", F.lit("concept").alias("channel"), F.col("src_id").alias("manifest_id"), F.col("name").alias("text"), R.keyword_points(F.col("score")).alias("normalized_score"))
    summary = keyword(spark, sf_dir).join(comp.select("src_id", "one_line"), "src_id")
    summary = summary.select("query_id", F.lit("summary").alias("channel"), F.col("src_id").alias("manifest_id"), F.col("one_line").alias("text"), "normalized_score")
    return R.candidates(concept.union(summary))


@query(f"WITH {HYB} SELECT query_id, channel, manifest_id, text, normalized_score, text_hash, rank FROM hy")
def hybrid_candidates(spark, sf_dir):
    return hybrid(spark, sf_dir).select("query_id", "channel", "manifest_id", "text", "normalized_score", "text_hash", "rank")


OVER = "len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+', 0)), terms)) / greatest(len(terms), 1)"


@query(f"""WITH {HYB}, rr AS (SELECT query_id, channel, manifest_id, rank, {OVER} AS overlap FROM hy JOIN (SELECT query_id, terms FROM qt) USING (query_id)),
mm AS (SELECT *, min(overlap) OVER (PARTITION BY query_id) AS lo, max(overlap) OVER (PARTITION BY query_id) AS hi FROM rr) SELECT query_id, channel, manifest_id, rank, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE round((overlap - lo) / (hi - lo), 4) END AS rerank_score FROM mm""")
def rerank_minmax(spark, sf_dir):
    """Candidates scored anew by the share of the question's terms that they hold."""
    asked = questions(spark, sf_dir).select("query_id", X.query_terms(F.col("question")).alias("terms"))
    share = F.size(F.array_intersect(X.query_terms(F.col("text")), "terms")) / F.greatest(F.size("terms"), F.lit(1))
    rows = hybrid(spark, sf_dir).join(asked, "query_id").withColumn("overlap", share)
    return R.rescaled(rows, "overlap").select("query_id", "channel", "manifest_id", "rank", "rerank_score")


CTX = f"{HYB}, cx AS (SELECT query_id, string_agg('[S' || rank || '] ' || manifest_id || ': ' || left(text, 300), chr(10) || chr(10) ORDER BY rank) AS context FROM hy WHERE rank <= 5 GROUP BY query_id)"


@query(f"WITH {CTX} SELECT query_id, context, sha256(question || chr(10) || '---' || chr(10) || context) AS cache_key FROM cx JOIN (SELECT query_id, question FROM qt) USING (query_id)")
def answer_context(spark, sf_dir):
    rows = R.context(hybrid(spark, sf_dir).where("rank <= 5")).join(questions(spark, sf_dir), "query_id")
    return rows.select("query_id", "context", R.answer_key(F.col("question"), F.col("context")).alias("cache_key"))


@query(f"WITH {HYB} SELECT query_id, 'S' || rank AS key, manifest_id, channel, left(sha256(left(text, 300)), 12) AS text_hash, normalized_score AS score FROM hy WHERE rank <= 5")
def context_sources(spark, sf_dir):
    """The source map of each context, entry by entry."""
    rows = R.context(hybrid(spark, sf_dir).where("rank <= 5")).select("query_id", F.explode("sources").alias("key", "s"))
    return rows.select("query_id", "key", "s.manifest_id", "s.channel", "s.text_hash", "s.score")


@query(f"""WITH {CON}, low AS (SELECT src_id, lower(title) AS stem, lower(text) AS body FROM src), {KEY.split('low AS', 1)[1].split('),', 1)[1].strip()},
al AS (SELECT query_id, 1 AS tier, src_id, score FROM ck WHERE score >= 10 UNION ALL SELECT query_id, 2, src_id, score FROM kw), mt AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS m FROM al) SELECT query_id, tier, src_id, score FROM mt WHERE tier = m""")
def tiered_search(spark, sf_dir):
    """Strong concept hits; for questions without any, documents."""
    concept = R.concept_search(questions(spark, sf_dir), C.concept_rows(compiled(spark, sf_dir)), 5).where("score >= 10")
    rows = concept.select("query_id", F.lit(1).alias("tier"), "src_id", "score").union(keyword(spark, sf_dir).select("query_id", F.lit(2), "src_id", "score"))
    return R.first_tier(rows)


def _knn(distance: str) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, round({distance}, 5) AS distance FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d) WHERE rank <= 5"""


@query(_knn("pow(list_distance(q.v, c.v), 2)"))
def knn_l2_top5(spark, sf_dir):
    return R.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 5, "l2")


@query(_knn("list_cosine_distance(q.v, c.v)"))
def knn_cosine_top5(spark, sf_dir):
    return R.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 5, "cosine")


@query("SELECT item_id AS query_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\bkb\\b', 'knowledge base', 'g'), '(?i)\\bllm\\b', 'large language model', 'g'), '(?i)\\brag\\b', 'retrieval augmented generation', 'g') AS question FROM benchmark")
def query_expansion(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", X.expand_abbreviations(F.col("question"), ABBREVIATIONS).alias("question"))


PAIRS = """pr AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
_LOW = "lower(answer)"
_ASCORE = (
    "least(100, 50 + CASE WHEN length(answer) >= 1000 THEN 20 WHEN length(answer) >= 500 THEN 15 WHEN length(answer) >= 200 THEN 10 ELSE 0 END + least(10, 2 * ("
    + " + ".join(f"contains({_LOW}, '{w.lower()}')::INT" for w in Q.LEARNING_KEYWORDS) + ")) + least(5, 2 * (" + " + ".join(f"contains({_LOW}, '{w.lower()}')::INT" for w in Q.INFO_KEYWORDS)
    + ")) + least(10, 3 * len(regexp_extract_all(answer, '\\[\\[[^\\]]+\\]\\]', 0))) + CASE WHEN regexp_matches(answer, '\\n[-*•]|\\n\\d+\\.|\\n#{1,3} ') THEN 5 ELSE 0 END)"
)


@query(f"""WITH {PAIRS}, h AS (SELECT *, sha256(question || chr(10) || answer) AS content_hash FROM pr WHERE length(answer) >= 100), f AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY conv_id, turn) AS r FROM h)
SELECT 'QRY-' || left(content_hash, 12) AS id, conv_id, turn, CAST({_ASCORE} AS INTEGER) AS quality_score, {_ASCORE} < 85 AS needs_review, CASE WHEN {_ASCORE} >= 90 THEN 'promoted' ELSE 'candidate' END AS status FROM f WHERE r = 1""")
def contributed_answers(spark, sf_dir):
    """Answers of conversations as knowledge candidates: each content once, scored, the best promoted."""
    return K.auto_promoted(candidates(spark, sf_dir)).select("id", "conv_id", "turn", "quality_score", "needs_review", "status")


def answers(spark, sf_dir):
    """conv_id, turn, question, answer of conversations, answers of 100 characters or more."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    given = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(given, ["conv_id", "turn"]).where(F.length("answer") >= 100)


def known_concepts(spark, sf_dir):
    """name, text: each concept with its first explanation."""
    return G.clusters(compiled(spark, sf_dir)).select(F.col("key").alias("name"), F.col("explanation").alias("text"))


def candidates(spark, sf_dir):
    none = spark.createDataFrame([], "content_hash string")
    return K.contributions(answers(spark, sf_dir), known_concepts(spark, sf_dir), none)


@query(f"""WITH {PAIRS}, h AS (SELECT *, sha256(question || chr(10) || answer) AS content_hash FROM pr WHERE length(answer) >= 100), f AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY conv_id, turn) AS r FROM h), c AS (SELECT 'QRY-' || left(content_hash, 12) AS id, turn, CAST({_ASCORE} AS INTEGER) AS q FROM f WHERE r = 1)
SELECT id, CASE WHEN turn > 2 THEN 'discarded' ELSE 'candidate' END AS status, turn <= 2 AND q >= 60 AS promoted, CASE WHEN turn > 2 THEN 'status is discarded' WHEN q < 60 THEN 'score ' || q || ' < 60' ELSE '' END AS reason FROM c WHERE q < 85""")
def candidate_decisions(spark, sf_dir):
    """Candidates that need a review; those of late turns discarded, the rest up for promotion from 60 on."""
    rows = K.listed(candidates(spark, sf_dir), needs_review=True)
    rows = K.discarded(rows, rows.where("turn > 2").select("id"), "late turn")
    return rows.select("id", "status").join(K.promoted(rows, 60), "id")


_CW = "list_distinct(regexp_extract_all({}, '\\p{{L}}{{4,}}', 0))"


@query(f"""WITH {COMP}, cf AS (SELECT src_id || '/' || name AS id, name, explanation, names FROM (SELECT src_id, unnest(names) AS name, names, unnest(concepts).explanation AS explanation FROM comp)),
md AS (SELECT id, '# ' || name || chr(10) || chr(10) || explanation || chr(10) || chr(10) || array_to_string(list_transform(list_filter(names, lambda n: n <> name), lambda n: '[[' || n || ']]'), ', ') || chr(10) AS text, list_filter(names, lambda n: n <> name) AS links FROM cf),
kn AS (SELECT lower(trim(name)) AS name, arg_min(explanation, src_id || lpad(place::VARCHAR, 4, '0')) FILTER (explanation <> '') AS known FROM con GROUP BY 1), j AS (SELECT id, text, unnest(list_distinct(links)) AS concept FROM md), o AS (SELECT id, concept, len(list_intersect({_CW.format('text')}, {_CW.format('known')})) / greatest(len(list_distinct(list_concat({_CW.format('text')}, {_CW.format('known')}))), 1) AS overlap FROM j JOIN kn ON concept = kn.name)
SELECT id, concept, round(overlap, 3) AS overlap FROM o WHERE overlap > 0.5""")
def answer_conflicts(spark, sf_dir):
    """Concept files as answers, against the known text of the concepts that they link to."""
    texts = C.concept_markdown(compiled(spark, sf_dir)).select(F.concat_ws("/", "src_id", "name").alias("id"), F.col("markdown").alias("text"))
    return K.conflicts(texts, known_concepts(spark, sf_dir), 0.5, r"\p{L}{4,}")


@query(f"""WITH {MAN}, kn AS (SELECT coalesce(list(DISTINCT name), []) AS ks FROM (SELECT unnest(names) AS name FROM man WHERE status = 'promoted')), m AS (SELECT src_id || '/' || unnest(names) AS id, unnest(names) AS name, names, unnest(concepts).explanation AS explanation FROM man)
SELECT id, '# ' || name || chr(10) || chr(10) || explanation || chr(10) || chr(10) || array_to_string(list_transform(list_filter(names, lambda n: n <> name), lambda n: CASE WHEN list_contains(ks, n) THEN '[[' || n || ']]' ELSE n END), ', ') || chr(10) AS text FROM m, kn""")
def sanitised_links(spark, sf_dir):
    """Concept files without the brackets of links to concepts that no promoted source has."""
    man = manifests(spark, sf_dir)
    known = man.where("status = 'promoted'").select(F.explode("concepts.name").alias("name")).distinct()
    texts = C.concept_markdown(man).select(F.concat_ws("/", "src_id", "name").alias("id"), F.col("markdown").alias("text"))
    return R.sanitised_links(texts, known)


#: Each question is asked in one of the modes.
MODES = ("concept", "summary", "vector", "combined", "all")
_LV = "[" + ", ".join(f"(length(lower({{0}})) - length(replace(lower({{0}}), '{x}', '')))::DOUBLE" for x in "aeioulnrst") + "]"
SEARCH = f"""{HYB}, md AS (SELECT query_id, [{', '.join(repr(m) for m in MODES)}][CAST(query_id % 5 AS INTEGER) + 1] AS mode FROM qt), dv AS (SELECT src_id, one_line, {_LV.format('one_line')} AS v FROM comp), qv AS (SELECT query_id, {_LV.format('question')} AS v FROM qt),
vd AS (SELECT query_id, dv.src_id, one_line, round(list_sum(list_transform(list_zip(qv.v, dv.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 5) AS distance FROM qv, dv), vn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, src_id) AS INTEGER) AS rank FROM vd) WHERE rank <= 5),
se AS (SELECT query_id, 'concept' AS channel, src_id AS manifest_id, con.explanation AS text, CAST(ck.score AS DOUBLE) AS raw_score, least(1.0::DOUBLE, round(1 - exp(-ck.score / 5.0::DOUBLE), 3)) AS normalized_score, rank AS channel_rank FROM ck JOIN con USING (src_id, name) JOIN md USING (query_id) WHERE mode IN ('concept', 'combined', 'all')
 UNION ALL SELECT query_id, 'summary', src_id, one_line, CAST(score AS DOUBLE), {NORM}, rank FROM kw JOIN (SELECT src_id, one_line FROM comp) USING (src_id) JOIN md USING (query_id) WHERE mode IN ('summary', 'combined', 'all')
 UNION ALL SELECT query_id, 'vector', src_id, left(one_line, 500), distance, round(1 / (1 + distance), 3), rank FROM vn JOIN md USING (query_id) WHERE mode IN ('vector', 'combined', 'all'))"""


def found(spark, sf_dir, plugins=None):
    """All channels for every question in its mode; vectors are letter counts of questions and first lines."""
    comp = compiled(spark, sf_dir)
    modes = F.array(*map(F.lit, MODES))
    asked = questions(spark, sf_dir).withColumn("mode", F.get(modes, (F.col("query_id") % 5).cast("int")))
    vectors = comp.select(F.col("doc_id").alias("vec_id"), S.letter_vector(F.col("one_line")).alias("embedding"))
    vectors = vectors.union(asked.select(-1 - F.col("query_id"), S.letter_vector(F.col("question"))))
    near = R.nearest(vectors, F.col("vec_id") < 0, 5, among=F.col("vec_id") >= 0)
    near = near.select((-1 - F.col("query_id")).alias("query_id"), F.col("vec_id").alias("doc_id"), "distance", "rank").join(comp.select("doc_id", "src_id", "one_line"), "doc_id")
    near = near.select("query_id", F.concat(F.lit("summary:"), "src_id").alias("id"), F.col("one_line").alias("text"), "distance", "rank")
    return R.searched(asked, C.concept_rows(comp), comp, near, 5, plugins)


@query(f"WITH {SEARCH} SELECT query_id, channel, manifest_id, text, raw_score, normalized_score, channel_rank FROM se")
def query_modes(spark, sf_dir):
    return found(spark, sf_dir).drop("name")


@query(f"WITH {SEARCH} SELECT query_id, array_to_string(list_sort(list(DISTINCT channel)), ',') AS search_sources FROM se GROUP BY query_id")
def search_sources(spark, sf_dir):
    return R.sources_used(found(spark, sf_dir)).select("query_id", F.array_join("search_sources", ",").alias("search_sources"))


UNIFIED = f"""{SEARCH}, u1 AS (SELECT *, left(md5(text), 12) AS text_hash FROM se), u2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, manifest_id, text_hash ORDER BY normalized_score DESC, channel) AS r FROM u1),
u3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY normalized_score DESC, channel, manifest_id, text_hash) AS first_rank FROM u2 WHERE r = 1),
u4 AS (SELECT u3.*, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+', 0)), terms)) / greatest(len(terms), 1) AS s FROM u3 JOIN (SELECT query_id, terms FROM qt) USING (query_id) WHERE first_rank <= 8),
u5 AS (SELECT *, min(s) OVER (PARTITION BY query_id) AS lo, max(s) OVER (PARTITION BY query_id) AS hi FROM u4), u6 AS (SELECT *, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE round((s - lo) / (hi - lo), 4) END AS rerank_score FROM u5),
u7 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, first_rank) AS rank FROM u6) WHERE rank <= 5)"""


@query(f"WITH {UNIFIED} SELECT query_id, channel, manifest_id, rerank_score AS score, CAST(row_number() OVER (PARTITION BY query_id, channel ORDER BY rank) AS INTEGER) AS place FROM u7")
def reranked_channels(spark, sf_dir):
    """Eight candidates of all channels scored anew, the best five of them back in their channels."""
    rows = R.candidates(found(spark, sf_dir))
    asked = questions(spark, sf_dir).select("query_id", X.query_terms(F.col("question")).alias("terms"))
    share = F.size(F.array_intersect(X.query_terms(F.col("text")), "terms")) / F.greatest(F.size("terms"), F.lit(1))
    return R.by_channel(R.reranked(rows.join(asked, "query_id"), share, 8, 5))


@query(f"""WITH {SEARCH}, evi AS (SELECT query_id, manifest_id AS src_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE channel WHEN 'concept' THEN 0 WHEN 'summary' THEN 1 ELSE 2 END, channel_rank) AS rank FROM se),
ex AS (SELECT query_id, src_id FROM qt, src WHERE contains(src.text, question)), hit AS (SELECT query_id, src_id, min(rank) AS rank FROM evi WHERE rank <= 5 GROUP BY 1, 2), met AS (SELECT ex.query_id, ex.src_id, rank FROM ex LEFT JOIN hit USING (query_id, src_id)),
ev AS (SELECT query_id, count(*) AS n, count(rank) AS f, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM met GROUP BY query_id), em AS (SELECT query_id, round(f / n, 4) AS recall, round(f / 5, 4) AS precision, round(coalesce(1 / first, 0), 4)::DOUBLE AS mrr, round(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 4) AS ndcg FROM ev)
SELECT mode, count(*) AS samples, round(avg(recall), 4) AS avg_recall, round(avg(precision), 4) AS avg_precision, round(avg(mrr), 4) AS avg_mrr, round(avg(ndcg), 4) AS avg_ndcg FROM em JOIN md USING (query_id) GROUP BY mode""")
def dataset_evaluation(spark, sf_dir):
    """Evidence of all channels, one after the other, against what was expected, averaged by mode."""
    per = R.metrics(R.evidence(found(spark, sf_dir)), expected(spark, sf_dir), 5)
    mode = F.get(F.array(*map(F.lit, MODES)), (F.col("query_id") % 5).cast("int"))
    return R.averages(per.withColumn("mode", mode), "mode")


def store_rows(spark, sf_dir):
    """collection, id, document, metadata: summaries and concepts of every source, with type and trust layer."""
    man = manifests(spark, sf_dir)
    layer = F.when(F.col("status") == "promoted", "curated").when(F.col("status") == "promoted_to_wiki", "wiki").otherwise("outputs")
    info = man.select(F.col("src_id").alias("manifest"), F.create_map(F.lit("source"), "type", F.lit("trust_level"), layer).alias("metadata"))
    docs = C.vector_documents(man).withColumn("manifest", X.manifest_id(F.col("id"))).join(info, "manifest")
    return docs.select(F.when(F.col("collection") == "concepts", "chunks").otherwise(F.col("collection")).alias("collection"), "id", "document", "metadata")


STORE = f"""{MAN}, sm AS (SELECT *, CASE status WHEN 'promoted' THEN 'curated' WHEN 'promoted_to_wiki' THEN 'wiki' ELSE 'outputs' END AS layer FROM man),
sto AS (SELECT 'summaries' AS collection, src_id AS id, array_to_string(list_concat([one_line], key_points, [left(detailed_summary, 2000)]), chr(10)) AS document, type AS source, layer FROM sm UNION ALL SELECT 'chunks', src_id || '_' || i, names[i + 1] || ': ' || concepts[i + 1].explanation, type, layer FROM (SELECT *, unnest(range(len(names))) AS i FROM sm))"""


@query(f"WITH {STORE} SELECT collection, source, count(*) AS n FROM sto GROUP BY 1, 2")
def collection_statistics(spark, sf_dir):
    return R.source_statistics(store_rows(spark, sf_dir))


@query(f"""WITH {STORE}, x AS (SELECT collection, id, document, CASE WHEN source = 'src1' THEN 'moved' ELSE source END AS source, layer FROM sto WHERE NOT (collection = 'chunks' AND source = 'src2')) SELECT collection, id, sha256(document) AS digest, source, layer FROM x""")
def collection_changes(spark, sf_dir):
    """One source's chunks deleted, another's metadata changed, all summaries written again."""
    store = store_rows(spark, sf_dir)
    of = lambda name: F.try_element_at("metadata", F.lit("source")) == name
    rows = R.deleted(store, store.where((F.col("collection") == "chunks") & of("src2")).select("collection", "id"))
    rows = R.with_metadata(rows, store.where(of("src1")).select("collection", "id", F.create_map(F.lit("source"), F.lit("moved")).alias("metadata")))
    rows = R.upserted(rows, R.checked_rows(rows.where("collection = 'summaries'")))
    return rows.select("collection", "id", F.sha2("document", 256).alias("digest"), F.try_element_at("metadata", F.lit("source")).alias("source"), F.try_element_at("metadata", F.lit("trust_level")).alias("layer"))


@query(f"WITH {STORE} SELECT collection, count(*) AS n FROM sto WHERE (collection <> 'chunks' OR layer IN ('wiki', 'curated', 'locked')) AND source IN ('src0', 'src3') GROUP BY 1")
def trusted_collections(spark, sf_dir):
    """Sizes of collections for two sources, chunks of the wiki's trust or higher alone."""
    store = R.trusted(store_rows(spark, sf_dir), "wiki")
    return R.collections(R.matching(store, {"source": "src0"}).union(R.matching(store, {"source": "src3"})))


@query(f"""WITH {STORE}, qt AS (SELECT item_id AS query_id, text AS question FROM benchmark), v AS (SELECT collection, id, document, {_LV.format('document')} AS v FROM sto WHERE collection <> 'chunks' OR layer IN ('wiki', 'curated', 'locked')), q AS (SELECT query_id, {_LV.format('question')} AS v FROM qt),
d AS (SELECT query_id, collection, id, document, round(list_sum(list_transform(list_zip(q.v, v.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 5) AS distance FROM q, v) SELECT query_id, collection, id, regexp_extract(id, '(SRC-\\d+)', 1) AS manifest_id, distance, left(document, 500) AS text, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, collection, id) AS rank FROM d) WHERE rank <= 5""")
def multi_collection_search(spark, sf_dir):
    """The nearest documents of all collections, chunks of trusted sources alone; vectors are letter counts."""
    store = R.trusted(store_rows(spark, sf_dir), "wiki").select("collection", "id", "document")
    vectors = written(store.select("collection", "id", S.letter_vector(F.col("document")).alias("embedding")), "vectors")  # the search reads them several times
    asked = questions(spark, sf_dir).select(F.concat(F.lit("?"), F.col("query_id").cast("string")).alias("vec_id"), S.letter_vector(F.col("question")).alias("embedding"))
    near = [R.nearest(asked.union(vectors.where(F.col("collection") == c).select("id", "embedding")), F.startswith("vec_id", F.lit("?")), 5, among=~F.startswith("vec_id", F.lit("?")), ids="string").withColumn("collection", F.lit(c)) for c in ("summaries", "chunks")]
    rows = near[0].union(near[1]).select(F.substring("query_id", 2, 20).cast("long").alias("query_id"), "collection", F.col("vec_id").alias("id"), "distance")
    best = R.across_collections(rows, 5).join(store, ["collection", "id"])
    return best.select("query_id", "collection", "id", X.manifest_id(F.col("id")).alias("manifest_id"), "distance", F.left("document", F.lit(500)).alias("text"), "rank")


@query()
def knn_approximate(spark, sf_dir):
    """Approximate search against the exact one: recall, the share of pairs whose vectors are tested, and the share whose codes are compared, for every query."""
    vectors, asked, refine = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 50
    rows = V.finite(vectors)
    lists = V.fitted(rows)
    if lists is None:
        return spark.createDataFrame([], "query_id long, recall double, tested double, compared double")
    exact = R.nearest(vectors, asked, 5).select("query_id", "vec_id")
    found = V.approximately_nearest(vectors, asked, 5, refine, lists).select("query_id", "vec_id", F.lit(1).alias("hit"))
    sizes = V.indexed(rows, lists).groupBy("list").agg(F.count("*").alias("size"))
    seen = V.probed(rows.where(asked), lists).drop("v").join(sizes, "list").groupBy("query_id").agg(F.sum("size").alias("seen"))
    met = exact.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
    n = rows.agg(F.count("*").alias("n"))
    return met.join(seen, "query_id").join(F.broadcast(n)).select("query_id", "recall", F.least(F.lit(1.0), refine / F.col("n")).alias("tested"), (F.col("seen") / F.col("n")).alias("compared"))


@query(f"WITH {HYB}, b AS (SELECT query_id, channel, manifest_id, CASE WHEN channel = 'concept' AND normalized_score < 0.5 THEN NULL ELSE normalized_score END AS score FROM hy) SELECT query_id, channel, manifest_id, score FROM b WHERE coalesce(score, 1) >= 0.7")
def weak_hits_dropped(spark, sf_dir):
    """Hits of a score of 0.7 or more, where weak concepts have lost theirs."""
    score = F.when(~((F.col("channel") == "concept") & (F.col("normalized_score") < 0.5)), F.col("normalized_score"))
    return R.without_weak(hybrid(spark, sf_dir).withColumn("score", score), 0.7).select("query_id", "channel", "manifest_id", "score")
