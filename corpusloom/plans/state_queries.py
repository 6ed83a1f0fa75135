"""Queries over the state that a compile run leaves: counts, selectors, patches, reports, files of artifacts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import compile as C
from corpusloom.operators import contribute as K
from corpusloom.operators import manifest as M
from corpusloom.operators import segment as S
from corpusloom.operators import state as T
from corpusloom.plans.compile_queries import COMP, MAN, MD, compiled, manifests, states
from corpusloom.plans.manifest_queries import SRC, sources
from corpusloom.plans.registry import query, table
from corpusloom.plans.segment_queries import STRIP

COUNTS = "SELECT status, type, count(*) AS n FROM {} GROUP BY GROUPING SETS ((status), (type), (status, type))"


@query(f"WITH {MAN} {COUNTS.format('man')}")
def source_status_counts(spark, sf_dir):
    return spark.sql(COUNTS.format("{man}"), man=states(spark, sf_dir))


@query(f"WITH {MAN} SELECT type, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, type) AS INTEGER) AS place FROM man GROUP BY type")
def type_counts(spark, sf_dir):
    """Categories by frequency."""
    counts = states(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "type")))  # a row for each category


BUCKET = "CASE WHEN coalesce(quality_score, 0) <= 40 THEN '0-40' WHEN quality_score <= 60 THEN '41-60' WHEN quality_score <= 84 THEN '61-84' ELSE '85-100' END"


@query(f"WITH {MAN} SELECT {BUCKET} AS bucket, count(*) AS n, count(*) FILTER (status = 'compiled' AND quality_score >= 55) AS promotable FROM man GROUP BY 1")
def score_histogram(spark, sf_dir):
    rows = states(spark, sf_dir).groupBy(T.score_bucket(F.col("quality_score")).alias("bucket"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.expr("status = 'compiled' AND quality_score >= 55")).alias("promotable"))


@query(f"""WITH {MAN} SELECT type, count(*) AS total, count(*) FILTER (status = 'compiled') AS compiled, count(*) FILTER (status = 'failed') AS failed,
  round(100.0 * count(*) FILTER (status = 'compiled') / count(*), 2)::DOUBLE AS compiled_pct, round(avg(quality_score) FILTER (quality_score > 0), 4) AS avg_score,
  max(quality_score) AS max_score, min(quality_score) FILTER (quality_score > 0) AS min_score FROM man GROUP BY type""")
def progress_report(spark, sf_dir):
    return T.progress(states(spark, sf_dir), "type")


@query(f"WITH {MAN} SELECT src_id, title, type, status, quality_score FROM man WHERE status = 'compiled' ORDER BY quality_score DESC, src_id LIMIT 50 OFFSET 10")
def manifest_page(spark, sf_dir):
    """A page of the listing: the page size is the feature."""
    return M.listing(manifests(spark, sf_dir), F.desc("quality_score"), F.col("src_id"), offset=10, limit=50, status="compiled")


@query(f"""WITH {MAN}, p AS (SELECT src_id, CASE WHEN size_bytes > 1000 THEN 'failed' ELSE 'compiled' END AS status, CASE WHEN size_bytes > 500 THEN 40 ELSE 0 END AS quality_score, CASE WHEN size_bytes > 1000 THEN 'late error' END AS error_message,
  CASE WHEN size_bytes % 5 = 0 THEN '' ELSE 'wiki' END AS promoted_to FROM man WHERE type <> 'src1')
SELECT m.src_id, CASE WHEN p.src_id IS NULL OR ig THEN m.status ELSE coalesce(p.status, m.status) END AS status,
  CASE WHEN p.src_id IS NULL OR ig THEN m.quality_score WHEN p.quality_score > 0 THEN p.quality_score ELSE m.quality_score END AS quality_score,
  CASE WHEN p.src_id IS NULL OR ig THEN m.error_message ELSE coalesce(p.error_message, m.error_message) END AS error_message,
  CASE WHEN p.src_id IS NULL OR ig THEN m.promoted_to WHEN p.promoted_to = '' THEN NULL ELSE coalesce(p.promoted_to, m.promoted_to) END AS promoted_to
FROM man m LEFT JOIN p USING (src_id), LATERAL (SELECT coalesce(p.status = 'failed' AND m.status IN ('compiled', 'promoted_to_wiki', 'promoted'), false) AS ig)""")
def manifest_patch(spark, sf_dir):
    """Patches from a later run over large files, two per source, the last of which counts."""
    man = states(spark, sf_dir)
    last = man.where("type <> 'src1'").selectExpr(
        "src_id", "2 AS seq", "CASE WHEN size_bytes > 1000 THEN 'failed' ELSE 'compiled' END AS status", "CASE WHEN size_bytes > 500 THEN 40 ELSE 0 END AS quality_score",
        "CASE WHEN size_bytes > 1000 THEN 'late error' END AS error_message", "CASE WHEN size_bytes % 5 = 0 THEN '' ELSE 'wiki' END AS promoted_to",
    )
    earlier = last.selectExpr("src_id", "1 AS seq", "'ingested' AS status", "1 AS quality_score", "'x' AS error_message", "'y' AS promoted_to")
    return M.patched(man.select("src_id", "status", "quality_score", "error_message", "promoted_to"), last.union(earlier))


@query(f"""WITH {MAN} SELECT src_id, error_message, CASE WHEN contains(lower(title), 'idiot') THEN 'idiot' END AS risky, CASE WHEN contains(error_message, 'no_text') THEN CASE WHEN type = 'pdf' THEN 'pdf' END WHEN contains(error_message, 'llm_failed') THEN 'llm' END AS route,
  CASE WHEN contains(lower(error_message), '429') OR contains(lower(error_message), 'rate') THEN 'rate_limit' WHEN contains(lower(error_message), 'timeout') OR contains(lower(error_message), 'timed out') THEN 'timeout' ELSE 'other' END AS kind
  FROM man WHERE status = 'failed'""")
def recoverable_failures(spark, sf_dir):
    """Failed sources with the word that makes a title risky, the way to recover them, and the kind of error."""
    e = F.col("error_message")
    rows = T.recoverable(states(spark, sf_dir))
    return rows.select("src_id", "error_message", M.risky_word(F.col("title"), ["idiot"]).alias("risky"), T.failure_route(e, F.col("type"), F.lit(".txt")).alias("route"), X.error_kind(e).alias("kind"))


@query(f"WITH {MAN} SELECT error_message, count(*) AS n FROM man WHERE error_message IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def error_top10(spark, sf_dir):
    return states(spark, sf_dir).where("error_message IS NOT NULL").groupBy("error_message").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_message").limit(10)


@query(f"WITH {MAN} SELECT src_id, status, len(names) AS concepts FROM man WHERE len(names) = 0")
def missing_concepts(spark, sf_dir):
    """Sources without concepts, all taken as compiled."""
    rows = states(spark, sf_dir).withColumnRenamed("status", "was").withColumn("status", F.lit("compiled"))
    return T.missing_concepts(rows).select("src_id", F.col("was").alias("status"), F.col("n_concepts").cast("long").alias("concepts"))


@query(f"WITH {MAN} SELECT src_id, CASE WHEN status = 'failed' THEN 'ingested' ELSE status END AS status, CASE WHEN status <> 'failed' THEN error_message END AS error_message, quality_score FROM man")
def reset_failed(spark, sf_dir):
    return T.reset_failed(states(spark, sf_dir)).select("src_id", "status", "error_message", "quality_score")


@query(f"WITH {MAN} SELECT src_id, CASE WHEN status = 'compiled' AND quality_score < 45 THEN 'ingested' ELSE status END AS status, CASE WHEN status = 'compiled' AND quality_score < 45 THEN 0 ELSE quality_score END AS quality_score FROM man")
def reset_low_quality(spark, sf_dir):
    return T.reset_low(states(spark, sf_dir), 45).select("src_id", "status", "quality_score")


_PAGE = "SELECT printf('SRC-%04d', page_id) AS src_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages"


@query(f"""WITH {SRC}, c AS ({_PAGE}), o AS (SELECT printf('SRC-%04d', item_id) AS src_id, text FROM benchmark), j AS (SELECT src.src_id, src.text AS a, c.text AS b, o.text AS d FROM src LEFT JOIN c USING (src_id) LEFT JOIN o USING (src_id))
SELECT src_id, CASE WHEN length(trim(a)) >= 400 THEN 'original' WHEN length(trim(b)) >= 400 THEN 'converted' WHEN length(trim(d)) >= 400 THEN 'ocr' ELSE 'rejected' END AS method,
 CASE WHEN length(trim(a)) >= 400 THEN a WHEN length(trim(b)) >= 400 THEN b WHEN length(trim(d)) >= 400 THEN d END AS text,
 CASE WHEN coalesce(a, b, d) IS NULL THEN 'no_text' WHEN coalesce(length(trim(a)) < 400, true) AND coalesce(length(trim(b)) < 400, true) AND coalesce(length(trim(d)) < 400, true) THEN 'too_short' END AS reason FROM j""")
def text_source_choice(spark, sf_dir):
    """A document's own text where it is long enough, else that of the page, else that of the benchmark item with its number."""
    name = lambda c: F.format_string("SRC-%04d", c)
    pages = table(spark, sf_dir, "pages").select(name("page_id").alias("src_id"), F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " ")).alias("text"))
    items = table(spark, sf_dir, "benchmark").select(name("item_id").alias("src_id"), "text")
    return T.chosen_text(sources(spark, sf_dir), pages, items, 400)


MEDIA = (".mp3", ".txt", ".MP4", ".webm", ".ogg")


@query(f"""WITH m AS (SELECT page_id, lower(([{', '.join(repr(x) for x in MEDIA)}])[page_id % {len(MEDIA)} + 1]) AS extension FROM pages) SELECT page_id, extension, extension IN ({', '.join(repr(x) for x in T.VIDEO)}) AS is_video FROM m WHERE extension IN ({', '.join(repr(x) for x in T.AUDIO + T.VIDEO)})""")
def failed_media(spark, sf_dir):
    """Pages as failed files, whose kind their number gives."""
    kind = F.get(F.array(*map(F.lit, MEDIA)), (F.col("page_id") % len(MEDIA)).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.lit("failed").alias("status"), F.lower(kind).alias("extension"))
    return T.failed_media(rows).select("page_id", "extension", "is_video")


_BARE = "regexp_replace({}, '[\\s\\-_|/\\\\:：？?！!（）()【】\\[\\]]', '', 'g')"


@query(f"""WITH {SRC}, f AS (SELECT DISTINCT left(title, 12) AS name FROM src WHERE type = 'src0' AND size_bytes > 200), m AS (SELECT src_id, left(title, 20) AS stem FROM src WHERE type = 'src2'),
ex AS (SELECT src_id, stem AS name, true AS exact FROM m JOIN f ON stem = name), fz AS (SELECT src_id, min(name) AS name FROM m JOIN f ON {_BARE.format('name')} <> '' AND {_BARE.format('stem')} <> '' AND (contains({_BARE.format('stem')}, {_BARE.format('name')}) OR contains({_BARE.format('name')}, {_BARE.format('stem')})) WHERE src_id NOT IN (SELECT src_id FROM ex) GROUP BY src_id)
SELECT src_id, name, exact FROM ex UNION ALL SELECT src_id, name, false FROM fz""")
def transcript_match(spark, sf_dir):
    """Beginnings of one source's titles as stems, those of another's as transcripts."""
    rows = sources(spark, sf_dir)
    files = rows.where("type = 'src0'").select(F.left("title", F.lit(12)).alias("name"), F.col("size_bytes").alias("size"))
    return T.transcripts_for(rows.where("type = 'src2'").select("src_id", F.left("title", F.lit(20)).alias("stem")), files)


@query(f"""WITH {MAN} SELECT src_id, content_hash IN (SELECT content_hash FROM man WHERE status IN ('compiled', 'promoted', 'promoted_to_wiki')) AS hit, status FROM man""")
def compile_cache(spark, sf_dir):
    """Which sources a cache of what has been compiled, by content, answers; later copies of a text are hits."""
    rows = manifests(spark, sf_dir).withColumns({"key": F.sha2("text", 256), "ts": F.col("doc_id")})
    done = rows.where(F.col("status").isin("compiled", "promoted", "promoted_to_wiki")).select("key", F.col("one_line").alias("result"), "ts")
    cache = T.cached(spark.createDataFrame([], done.schema), done)
    return T.looked_up(rows.select("src_id", "key", "status"), cache).select("src_id", "hit", "status")


ART = "art AS (SELECT src_id, title, CASE status WHEN 'promoted' THEN 'curated' WHEN 'promoted_to_wiki' THEN 'wiki' ELSE 'outputs' END AS layer, 'summaries' AS kind, title AS stem FROM man WHERE status IN ('compiled', 'promoted', 'promoted_to_wiki') UNION ALL SELECT src_id, title, CASE status WHEN 'promoted' THEN 'curated' WHEN 'promoted_to_wiki' THEN 'wiki' ELSE 'outputs' END, 'concepts', unnest(names) FROM man WHERE status IN ('compiled', 'promoted', 'promoted_to_wiki'))"


def artifacts(spark, sf_dir):
    """src_id, title, layer, kind, stem of what a run has written: a summary and its concepts in the layer that the source's state names."""
    rows = manifests(spark, sf_dir).where(F.col("status").isin("compiled", "promoted", "promoted_to_wiki"))
    layer = F.when(F.col("status") == "promoted", "curated").when(F.col("status") == "promoted_to_wiki", "wiki").otherwise("outputs")
    rows = rows.select("src_id", "title", layer.alias("layer"), "concepts.name")
    return rows.select("src_id", "title", "layer", F.lit("summaries").alias("kind"), F.col("title").alias("stem")).union(rows.select("src_id", "title", "layer", F.lit("concepts"), F.explode("name")))


@query(f"WITH {MAN}, {ART} SELECT layer, kind, count(*) AS n FROM art GROUP BY layer, kind")
def layer_counts(spark, sf_dir):
    return T.layer_counts(artifacts(spark, sf_dir))


@query(f"""WITH {MAN}, {ART}, pol AS (SELECT stem FROM art WHERE kind = 'summaries' AND stem NOT IN (SELECT title FROM man WHERE status IN ('promoted', 'promoted_to_wiki')) AND regexp_replace(stem, '_\\d+$', '') NOT IN (SELECT title FROM man WHERE status IN ('promoted', 'promoted_to_wiki')))
SELECT 'status' AS metric, status AS name, count(*) AS n FROM man GROUP BY status UNION ALL SELECT 'score', {BUCKET}, count(*) FROM man GROUP BY 2 UNION ALL SELECT 'manifests', 'all', count(*) FROM man
UNION ALL SELECT 'promotable', 'all', count(*) FROM man WHERE status = 'compiled' AND quality_score >= 55 UNION ALL SELECT 'artifacts', layer || '/' || kind, count(*) FROM art GROUP BY 2 UNION ALL SELECT 'polluted', 'all', count(*) FROM pol""")
def trust_report(spark, sf_dir):
    from corpusloom.operators import lifecycle as L

    man, art = manifests(spark, sf_dir), artifacts(spark, sf_dir)
    return T.trust_report(man, art, L.polluted(art.where("kind = 'summaries'").select("stem"), man), 55)


@query("""WITH r AS (SELECT user_id % 5 AS batch, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'success' END AS status, value AS seconds, event_type <> 'error' AS api_ok, CAST(least(100, floor(value * 8)) AS INTEGER) AS quality_score FROM events)
SELECT batch, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, round(sum(seconds) / 60, 4) AS minutes, round(CASE WHEN sum(seconds) / 60 < 0.1 THEN 0 ELSE count(*) FILTER (status = 'success') / (sum(seconds) / 60) END, 2) AS per_minute,
 round(100.0 * count(*) FILTER (api_ok) / count(*), 2)::DOUBLE AS api_success_pct, round(avg(quality_score) FILTER (quality_score > 0), 4) AS avg_score, max(quality_score) FILTER (quality_score > 0) AS max_score, min(quality_score) FILTER (quality_score > 0) AS min_score, count(*) FILTER (quality_score > 0 AND quality_score < 70) AS low_quality FROM r GROUP BY batch""")
def run_statistics(spark, sf_dir):
    """Events as the records of a run in five batches: their kind as outcome, their value as seconds."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "user_id % 5 AS batch", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'success' END AS status", "value AS seconds", "event_type <> 'error' AS api_ok", "CAST(least(100, floor(value * 8)) AS INT) AS quality_score",
    )
    return T.run_statistics(rows, "batch")


LOG_WORDS = (("content_filter", ("password",)), ("json_parse_error", ("http",)), ("markitdown_failed", ("token", ":")), ("success", ("the",)), ("failed", ("idiot",)))
_LOGKIND = "CASE " + " ".join(f"WHEN {' AND '.join(f'contains(line, {w!r})' for w in words)} THEN '{k}'" for k, words in LOG_WORDS) + " END"


@query(f"""WITH {SRC}, l AS (SELECT type, unnest(string_split(text, chr(10))) AS line FROM src), k AS (SELECT type, {_LOGKIND} AS kind FROM l), c AS (SELECT type, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k, _ in LOG_WORDS)}, count(kind) AS requests FROM k GROUP BY type)
SELECT *, round(CASE WHEN requests > 0 THEN 100.0::DOUBLE * content_filter / requests ELSE 0 END, 4) AS content_filter_rate, round(CASE WHEN success + failed > 0 THEN 100.0::DOUBLE * success / (success + failed) ELSE 0 END, 4) AS success_rate FROM c""")
def log_rates(spark, sf_dir):
    """Documents' lines as the lines of a log, with words of this corpus in place of the log's."""
    lines = sources(spark, sf_dir).select("type", F.explode(F.split("text", "\n")).alias("line"))
    return T.log_rates(lines, "type", kinds=LOG_WORDS)


@query()
def sample_check(spark, sf_dir):
    """Ten compiled sources looked over: the sample is the feature."""
    return T.sample_checked(compiled(spark, sf_dir), 7)


SECTIONS_HERE = {"one_line": "# ", "key_points": "## Key Points", "detailed_summary": "## Detailed Summary", "concepts": "- [["}


@query(f"""WITH {MD} SELECT src_id, {', '.join(f"contains(markdown, '{v}') AS {k}" for k, v in SECTIONS_HERE.items())}, CASE WHEN regexp_extract(markdown, 'score[：:]\\s*(\\d+)', 1) <> '' THEN regexp_extract(markdown, 'score[：:]\\s*(\\d+)', 1)::INTEGER END AS stated_score FROM md""")
def summary_completeness(spark, sf_dir):
    return T.completeness(C.summary_markdown(compiled(spark, sf_dir)), SECTIONS_HERE, r"score[：:]\s*(\d+)")


@query(f"""WITH {SRC}, x AS (SELECT src_id, greatest(1, CAST(ceil((length(text) - 20) / 180.0) AS INTEGER)) AS k FROM src WHERE length(text) > 0), e AS (SELECT src_id, k, unnest(range(k)) AS i FROM x), p AS (SELECT src_id, k, unnest(range(9)) AS j FROM x WHERE k > 10)
SELECT src_id, CAST(i AS INTEGER) AS "index" FROM e WHERE k <= 10 UNION SELECT src_id, CAST(j * k // 10 AS INTEGER) FROM p UNION SELECT src_id, k - 1 FROM x WHERE k > 10""")
def chunk_sample(spark, sf_dir):
    """Ten chunks of each longer document, spread evenly: the sample is the feature."""
    return T.chunk_sample(S.fixed(sources(spark, sf_dir), 200, 20), 10).select("src_id", "index")


@query(f"WITH {MAN} SELECT src_id, type, status, CAST(CASE type WHEN 'article' THEN 0 WHEN 'pdf' THEN 1 WHEN 'ebook' THEN 2 WHEN 'other' THEN 3 WHEN 'video' THEN 4 ELSE 5 END AS INTEGER) AS priority FROM man")
def compile_priority(spark, sf_dir):
    return M.by_priority(states(spark, sf_dir)).select("src_id", "type", "status", "priority")


@query(f"""WITH {MAN} SELECT src_id, title, type, 'raw/' || src_id || '.txt' AS file_path, content_hash, '2024-01-01' AS date_ingested, CASE WHEN status = 'failed' THEN 'ingested' ELSE status END AS status, quality_score FROM man""")
def index_update(spark, sf_dir):
    """The flat index of all sources, brought up to date with the failed ones that were reset."""
    man = manifests(spark, sf_dir).withColumns({"file_path": F.concat(F.lit("raw/"), "src_id", F.lit(".txt")), "date_ingested": F.lit("2024-01-01")})
    return M.index_updated(M.index_rows(man), T.reset_failed(man.where("status = 'failed'")))


PATHS = f"{ART}, pa AS (SELECT DISTINCT layer || '/' || kind || '/' || left(trim(regexp_replace(stem, '[<>:\"/\\\\|?*]', '', 'g')), CASE kind WHEN 'summaries' THEN 80 ELSE 60 END) || '.md' AS path FROM art UNION SELECT 'elsewhere/' || src_id || '.md' FROM man WHERE status = 'failed')"


def artifact_paths(spark, sf_dir):
    name = F.when(F.col("kind") == "summaries", X.artifact_name(F.col("stem"), 80)).otherwise(X.artifact_name(F.col("stem"), 60))
    paths = artifacts(spark, sf_dir).select(F.concat_ws("/", "layer", "kind", F.concat(name, F.lit(".md"))).alias("path"))
    return paths.union(manifests(spark, sf_dir).where("status = 'failed'").select(F.concat(F.lit("elsewhere/"), "src_id", F.lit(".md")))).distinct()


_NAME = "left(trim(regexp_replace({}, '[<>:\"/\\\\|?*]', '', 'g')), {})"
_LAST = "regexp_extract({}, '([^/]*)$', 1)"


@query(f"""WITH {MAN}, {PATHS}, key AS (SELECT src_id, 'raw/' || src_id || '.txt' AS path FROM man UNION ALL SELECT src_id, l || '/summaries/' || {_NAME.format('title', 80)} || '.md' FROM man, (VALUES ('wiki'), ('outputs')) t(l) WHERE {_NAME.format('title', 80)} <> ''
 UNION ALL SELECT src_id, l || '/concepts/' || {_NAME.format('c', 60)} || '.md' FROM (SELECT src_id, unnest(names) AS c FROM man), (VALUES ('wiki'), ('outputs')) t(l) WHERE {_NAME.format('c', 60)} <> ''),
ex AS (SELECT path, min(src_id) AS src_id FROM key GROUP BY path), nm AS (SELECT {_LAST.format('path')} AS file, min(src_id) AS near FROM ex GROUP BY 1)
SELECT pa.path, coalesce(ex.src_id, near) AS src_id, CASE WHEN ex.src_id IS NOT NULL THEN 'path' WHEN near IS NOT NULL THEN 'file name' END AS "by" FROM pa LEFT JOIN ex USING (path) LEFT JOIN nm ON nm.file = {_LAST.format('pa.path')}""")
def artifact_manifests(spark, sf_dir):
    """Which source each artifact's path belongs to."""
    man = manifests(spark, sf_dir).withColumn("file_path", F.concat(F.lit("raw/"), "src_id", F.lit(".txt")))
    return K.matched_artifacts(artifact_paths(spark, sf_dir), man)


_STEM = "regexp_replace({}, '^(.+)\\.[^.]*$', '\\1')"


@query(f"""WITH {MAN}, {PATHS}, r AS (SELECT path, {_LAST.format('path')} AS filename, {_STEM.format(_LAST.format('path'))} AS stem FROM pa), t AS (SELECT {_STEM.format(_LAST.format('title'))} AS stem, min(src_id) AS src_id FROM man WHERE title <> '' GROUP BY 1),
f AS (SELECT {_LAST.format("'raw/' || src_id || '.txt'")} AS filename, min(src_id) AS src_id FROM man GROUP BY 1), x AS (SELECT r.path, r.filename, CASE WHEN regexp_matches(r.stem, '^SRC-\\d+$') THEN r.stem END AS own, f.src_id AS fid, t.src_id AS tid FROM r LEFT JOIN f USING (filename) LEFT JOIN t USING (stem)),
y AS (SELECT path, filename, CASE WHEN own IN (SELECT src_id FROM man) THEN own END AS own, fid, tid FROM x)
SELECT path, filename, coalesce(man.status, 'unknown') AS status, man.quality_score, CASE WHEN own IS NOT NULL THEN 'id' WHEN fid IS NOT NULL THEN 'file' WHEN tid IS NOT NULL THEN 'title' END AS matched FROM y LEFT JOIN man ON man.src_id = coalesce(own, fid, tid)""")
def corpus_export(spark, sf_dir):
    """The export's table of files with the state of their sources."""
    man = manifests(spark, sf_dir).withColumn("file_path", F.concat(F.lit("raw/"), "src_id", F.lit(".txt")))
    return K.export_rows(artifact_paths(spark, sf_dir), man)


@query(f"""WITH {MAN}, a AS (SELECT {_NAME.format('title', 80)} AS f, CASE status WHEN 'promoted' THEN 'curated' ELSE 'wiki' END AS layer, '(' || src_id || ')' || chr(10) || chr(10) || chr(10) || detailed_summary AS t FROM man WHERE status IN ('promoted', 'promoted_to_wiki') AND title <> ''),
b AS (SELECT f, min(struct_pack(layer := layer, t := t)) AS a FROM a GROUP BY f) SELECT src_id, b.a.layer AS layer, f AS file_name, {STRIP.format("regexp_replace(regexp_replace(regexp_replace(b.a.t, '\\(SRC-(\\d{4})\\)', '📚 来源: SRC-\\1', 'g'), '^---\\n(?s:.*?)\\n---\\n', ''), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text
FROM man JOIN b ON f = {_NAME.format('title', 80)} WHERE status IN ('promoted', 'promoted_to_wiki') AND title <> ''""")
def vault_push(spark, sf_dir):
    """Promoted sources' summaries, made fit for a vault."""
    man = manifests(spark, sf_dir)
    layer = F.when(F.col("status") == "promoted", "curated").otherwise("wiki")
    text = F.concat(F.lit("("), "src_id", F.lit(")\n\n\n"), "detailed_summary")
    return K.pushed(man, man.where(F.col("status").isin("promoted", "promoted_to_wiki")).select("title", layer.alias("layer"), text.alias("text")))


_WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2))"


@query(f"""WITH {SRC}, q AS (SELECT src_id, array_to_string(list_filter(string_split_regex(regexp_replace(title, '[<>:"/\\\\|?*]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2), ' ')[1:50] AS term FROM src WHERE type = 'src2' AND size_bytes < 400),
a AS (SELECT src_id, unnest({_WORDS.format('term')}) AS word FROM q), n AS (SELECT src_id AS note_id, unnest({_WORDS.format('title')}) AS word, 0 AS place FROM src WHERE type = 'src0' UNION ALL SELECT src_id, unnest({_WORDS.format('left(text, 2000)')}), 1 FROM src WHERE type = 'src0')
SELECT src_id, note_id, CASE min(place) WHEN 0 THEN 'filename' ELSE 'content' END AS match_type FROM a JOIN n USING (word) WHERE src_id <> note_id GROUP BY src_id, note_id""")
def associated_notes(spark, sf_dir):
    """Notes (one source's documents) for another source's short documents."""
    rows = sources(spark, sf_dir)
    return K.associated(rows.where("type = 'src2' AND size_bytes < 400"), rows.where("type = 'src0'").select(F.col("src_id").alias("note_id"), "title", "text"))


_CLEAN = "trim(regexp_replace(regexp_replace({}, '\\n+', chr(10), 'g'), ' +', ' ', 'g'))"


@query(f"""WITH {MD}, l AS (SELECT src_id, string_split(markdown, chr(10)) AS ls FROM md), d AS (SELECT src_id, ls, array_to_string(list_concat(list_filter(ls[1:100], lambda x: trim(x) <> ''), list_transform(list_filter(range(1, len(ls) + 1), lambda i: starts_with(ls[i], '## ')), lambda i: array_to_string(ls[i:i + 19], chr(10)))), chr(10)) AS t FROM l)
SELECT src_id AS id, trim(regexp_replace(regexp_replace(ls[1], '^#+', ''), '#+$', '')) AS title, CASE WHEN length({_CLEAN.format('t')}) > 4000 THEN left({_CLEAN.format('t')}, 4000) || '...' ELSE {_CLEAN.format('t')} END AS digest FROM d""")
def markdown_digests(spark, sf_dir):
    return K.digests(C.summary_markdown(compiled(spark, sf_dir)).select(F.col("src_id").alias("id"), F.col("markdown").alias("text")))


@query(f"""WITH {SRC}, x AS (SELECT src_id || CASE WHEN size_bytes % 2 = 0 THEN '.rs' ELSE '.unknown' END AS path, text FROM src) SELECT path, CASE WHEN ends_with(path, '.rs') THEN 'rust' ELSE 'unknown' END AS language, array_to_string(regexp_extract_all(text, 'def\\s+([\\p{{L}}\\p{{N}}_]+)', 1), ',') AS functions,
 array_to_string(regexp_extract_all(text, 'class\\s+([\\p{{L}}\\p{{N}}_]+)', 1), ',') AS classes, array_to_string(list_filter(string_split(text, chr(10)), lambda l: regexp_matches({STRIP.format('l')}, '^(#|//|/\\*|\\*)')), chr(10)) AS text FROM x""")
def code_extract(spark, sf_dir):
    """Documents as code files; their license lines are comments."""
    path = F.concat("src_id", F.when(F.col("size_bytes") % 2 == 0, ".rs").otherwise(".unknown"))
    rows = K.code_facts(sources(spark, sf_dir).select(path.alias("path"), F.col("text").alias("content")))
    return rows.select("path", "language", F.array_join("functions", ",").alias("functions"), F.array_join("classes", ",").alias("classes"), "text")


@query(f"""WITH {SRC}, x AS (SELECT src_id || '.py' AS path, string_split('class C' || doc_id || ':' || chr(10) || replace(text, '. ', '.\"\"\"' || chr(10)), chr(10)) AS ls FROM src), l AS (SELECT path, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM x),
s AS (SELECT *, sum(CASE WHEN contains(line, '\"\"\"') OR contains(line, '''''''') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) % 2 = 1 AS inside FROM l)
SELECT path, 'python' AS language, array_to_string(list_concat(list(regexp_extract_all(line, 'class\\s+([\\p{{L}}\\p{{N}}_]+)', 1) ORDER BY i)[1], []), ',') AS first_class, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (inside OR starts_with({STRIP.format('line')}, '#')), '') AS text FROM s GROUP BY path""")
def code_extract_python(spark, sf_dir):
    """Documents as Python files, each sentence's end with the quotes of a doc string."""
    body = F.concat(F.lit("class C"), F.col("doc_id").cast("string"), F.lit(":\n"), F.replace("text", F.lit(". "), F.lit('."""\n')))
    rows = K.code_facts(sources(spark, sf_dir).select(F.concat("src_id", F.lit(".py")).alias("path"), body.alias("content")))
    return rows.select("path", "language", F.get("classes", F.lit(0)).alias("first_class"), "text")


@query(f"""WITH {MAN}, p AS (SELECT src_id, CASE WHEN size_bytes > 1000 THEN 'failed' ELSE 'compiled' END AS status, to_timestamp(1704067200 + doc_id)::TIMESTAMP AS stamped FROM man WHERE type <> 'src1')
SELECT m.src_id, CASE WHEN p.src_id IS NULL OR ig THEN m.status ELSE p.status END AS status, CASE WHEN NOT ig AND p.status = 'compiled' THEN stamped END AS date_compiled, CASE WHEN NOT ig AND p.status = 'failed' THEN stamped END AS date_failed
FROM man m LEFT JOIN p USING (src_id), LATERAL (SELECT coalesce(p.status = 'failed' AND m.status IN ('compiled', 'promoted_to_wiki', 'promoted'), false) AS ig)""")
def manifest_patch_dates(spark, sf_dir):
    """The dates of the states that patches bring."""
    man = states(spark, sf_dir)
    at = F.timestamp_seconds(F.col("doc_id") + 1704067200).cast("timestamp_ntz").alias("at")
    patches = man.where("type <> 'src1'").select("src_id", F.lit(1).alias("seq"), F.expr("CASE WHEN size_bytes > 1000 THEN 'failed' ELSE 'compiled' END AS status"), F.lit(0).alias("quality_score"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("string").alias("promoted_to"), at)
    return M.patched(man.select("src_id", "status", "quality_score", "error_message", "promoted_to"), patches).select("src_id", "status", "date_compiled", "date_failed")


@query(f"""WITH {SRC} SELECT 'auto_' || CASE WHEN row_number() OVER (ORDER BY src_id) - 1 < 10000 THEN lpad((row_number() OVER (ORDER BY src_id) - 1)::VARCHAR, 4, '0') ELSE (row_number() OVER (ORDER BY src_id) - 1)::VARCHAR END AS id, '什么是' || CASE WHEN title = '' THEN '文档 ' || src_id ELSE title END || '？' AS question, src_id AS expected FROM src""")
def auto_samples(spark, sf_dir):
    return K.auto_samples(sources(spark, sf_dir)).select("id", "question", F.array_join("expected_source_ids", ",").alias("expected"))


@query(f"""WITH {COMP}, c AS (SELECT src_id, names, unnest(names) AS name, unnest(concepts).explanation AS e FROM comp), d AS (SELECT src_id, name, e || chr(10) || chr(10) || array_to_string(list_transform(list_filter(names, lambda n: n <> name), lambda n: '[[' || n || ']]'), ', ') || chr(10) AS body FROM c)
SELECT src_id, name, {STRIP.format("array_to_string(list_filter(string_split(body, chr(10)), lambda x: " + STRIP.format("x") + " <> '' AND x[1] <> '#'), chr(10))")} AS definition FROM d""")
def concept_files_parsed(spark, sf_dir):
    """Concept files written and read back."""
    return C.parsed_concept(C.concept_markdown(compiled(spark, sf_dir)).select("src_id", "markdown"))


@query(f"""WITH {MAN}, r AS (SELECT src_id, title, CASE status WHEN 'promoted' THEN 'curated' ELSE 'wiki' END AS layer FROM man WHERE status IN ('promoted', 'promoted_to_wiki') AND quality_score < 65), {ART}, a AS (SELECT src_id, layer, stem FROM art WHERE kind = 'summaries')
SELECT src_id, layer, stem FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.layer = a.layer AND r.title IN (a.stem, regexp_replace(a.stem, '_\\d+$', '')))""")
def downgraded_artifacts(spark, sf_dir):
    """Summaries that stay when weak promoted sources are taken a step down."""
    from corpusloom.operators import lifecycle as L

    man = manifests(spark, sf_dir)
    down = L.downgraded(man, 65).join(man.select("src_id", "title"), "src_id").select("title", F.when(F.col("was") == "promoted", "curated").otherwise("wiki").alias("layer"))
    return L.withdrawn(artifacts(spark, sf_dir).where("kind = 'summaries'").select("src_id", "layer", "stem"), down)


@query(f"""WITH {MAN}, mv AS (SELECT src_id, quality_score FROM man WHERE status = 'compiled' AND quality_score >= 55), {ART} SELECT src_id, 'wiki' AS layer, kind, stem FROM art WHERE layer = 'outputs' AND src_id IN (SELECT src_id FROM mv)""")
def promoted_artifacts(spark, sf_dir):
    """What a promotion to the wiki copies there."""
    from corpusloom.operators import lifecycle as L

    _, copies = L.promoted_artifacts(L.promoted(manifests(spark, sf_dir), "wiki", 55), artifacts(spark, sf_dir).drop("title"), "outputs", "wiki")
    return copies.select("src_id", "layer", "kind", "stem")


@query(f"""WITH {COMP}, r AS (SELECT src_id, 1 AS p, 'large' AS model, CASE WHEN length(one_line) >= 60 THEN one_line END AS s FROM comp UNION ALL SELECT src_id, 2, 'small', CASE WHEN len(key_points) > 0 THEN key_points[1] END FROM comp UNION ALL SELECT src_id, 3, 'none', left(detailed_summary, 20) FROM comp),
b AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY p) AS k FROM r WHERE s IS NOT NULL AND trim(s) <> '') SELECT src_id, model, s AS summary FROM b WHERE k = 1""")
def model_fallback(spark, sf_dir):
    """Three results for a source, of which the first that is there counts."""
    comp = compiled(spark, sf_dir)
    rows = [(1, "large", F.when(F.length("one_line") >= 60, F.col("one_line"))), (2, "small", F.get("key_points", F.lit(0))), (3, "none", F.left("detailed_summary", F.lit(20)))]
    parts = [comp.select("src_id", F.lit(p).alias("priority"), F.lit(m).alias("model"), s.alias("summary")) for p, m, s in rows]
    return C.preferred(parts[0].union(parts[1]).union(parts[2]))
