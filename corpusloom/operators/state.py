"""State of sources: the compile job's table, selectors for another try, resets, caches, run and trust reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import quality as Q
from corpusloom.operators.manifest import meaningful, patched

# Kinds of media files.
AUDIO = (".mp3", ".wav", ".m4a", ".flac", ".aac", ".ogg", ".wma", ".opus")
VIDEO = (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm")
# What is left out of a file's stem before stems are compared.
STEM_NOISE = r"[\s\-_|/\\:：？?！!（）()【】\[\]]"
# Section titles of a complete summary, and what stands before its score.
SECTIONS = {"one_line": "## 一句话摘要", "key_points": "## 要点", "detailed_summary": "## 详细摘要", "concepts": "## 相关概念"}
SCORE_LINE = r"质量分数[：:]\s*(\d+)"
# What a log line holds (all of a row's words), the first row that fits naming its kind.
LOG_KINDS = (
    ("content_filter", ("内容过滤错误",)),
    ("json_parse_error", ("JSON parse failed",)),
    ("json_parse_error", ("json-repair",)),
    ("markitdown_failed", ("markitdown", "失败")),
    ("success", ("摘要已写入",)),
    ("failed", ("摘要生成失败",)),
)


def compiled_state(compiled: DataFrame, wiki: int, curated: int) -> DataFrame:
    """src_id, doc_id, title, type, status, error_message, quality_score, promoted_to after a compile run over compiled rows.

    Texts that are too short and rows without key points fail; a later copy of a text stays ingested;
    the score of the others decides how far they are promoted.
    """
    same = compiled.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_id"))
    rows = compiled.withColumn("content_hash", F.sha2("text", 256)).join(same, "content_hash").withColumn("quality_score", Q.score())
    return _with_status(rows, ~meaningful(F.col("text")), F.size("key_points") == 0, wiki, curated)


def _with_status(rows: DataFrame, short: Column, empty: Column, wiki: int, curated: int) -> DataFrame:
    """rows (doc_id, first_id, quality_score) with status, error_message, promoted_to."""
    first = F.col("first_id") == F.col("doc_id")
    good = F.when(F.col("quality_score") >= curated, "promoted").when(F.col("quality_score") >= wiki, "promoted_to_wiki").otherwise("compiled")
    status = F.when(short, "failed").when(~first, "ingested").when(empty, "failed").otherwise(good)
    rows = rows.withColumn("status", status)
    error = F.when(short, "no_text").when(F.col("status") == "failed", "llm_failed: empty key points")
    layer = F.when(F.col("status") == "promoted", "curated").when(F.col("status") == "promoted_to_wiki", "wiki")
    return rows.withColumns({"error_message": error, "promoted_to": layer})


def outlined_state(outlines: DataFrame, wiki: int, curated: int) -> DataFrame:
    """compiled_state of outlined rows, without what was compiled: src_id, doc_id, type, n_chars, size_bytes, n_concepts, status, error_message, quality_score, promoted_to, and title and text of failed rows alone.

    Texts meet their copies by their digests, so that no text is shuffled but of rows that may fail.
    """
    short, empty = ~meaningful(F.col("text")), F.size("key_points") == 0
    kept = lambda c: F.when(short | empty, F.col(c)).alias(c)
    facts = outlines.select(
        "src_id", "doc_id", "type", F.length("text").alias("n_chars"), F.octet_length("text").cast("long").alias("size_bytes"), "n_concepts", kept("title"), kept("text"),
        short.alias("short"), empty.alias("empty"), Q.score(F.col("n_concepts")).alias("quality_score"), F.sha2("text", 256).alias("content_hash"),
    )
    same = outlines.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_id"))
    rows = _with_status(facts.join(same, "content_hash"), F.col("short"), F.col("empty"), wiki, curated)
    failed = F.col("status") == "failed"
    return rows.drop("short", "empty", "first_id", "content_hash").withColumns({c: F.when(failed, F.col(c)) for c in ("title", "text")})


def failure_route(error: Column, kind: Column, extension: Column) -> Column:
    """Which recovery a failed source goes to: ebook, pdf, other or llm; null for those that none is made for."""
    low, none = F.lower(extension), error.contains("no_text")
    return (
        F.when(none & (kind == "ebook") & low.isin(".mobi", ".azw3"), "ebook").when(none & (kind == "pdf"), "pdf")
        .when(none & (kind == "other") & low.isin(".mhtml", ".pptx", ".ppt"), "other").when(~none & error.contains("llm_failed"), "llm")
    )


def recoverable(failed: DataFrame, mode: str = "all", error: str | None = None) -> DataFrame:
    """Failed rows that a mode (all, llm_failed, text) or a part of the error message selects."""
    rows = failed.where("status = 'failed'")
    if error is not None:
        return rows.where(F.contains(F.lower("error_message"), F.lit(error.lower())))
    tests = {"all": F.lit(True), "llm_failed": F.col("error_message").contains("llm_failed"), "text": F.col("error_message").contains("no_text")}
    return rows.where(tests[mode])


def missing_concepts(compiled: DataFrame) -> DataFrame:
    """Compiled sources without any concept; rows with the concepts themselves, or with their number (n_concepts)."""
    number = F.col("n_concepts") if "n_concepts" in compiled.columns else F.size(F.coalesce("concepts", F.array().cast("array<struct<name:string,explanation:string>>")))
    return compiled.where((F.col("status") == "compiled") & (number == 0))


def failed_media(manifests: DataFrame) -> DataFrame:
    """Failed rows (extension) of audio or video files, with is_video."""
    low = F.lower("extension")
    return manifests.where((F.col("status") == "failed") & low.isin(*AUDIO, *VIDEO)).withColumn("is_video", low.isin(*VIDEO))


def transcripts_for(manifests: DataFrame, transcripts: DataFrame, least: int = 200) -> DataFrame:
    """manifests (src_id, stem), transcripts (name, size) -> src_id, name, exact: a transcript of the same stem, else one whose cleaned name holds the cleaned stem or is held by it; the first by name.

    Longer names meet shorter ones through the shorter one's length: a name gives its parts of the
    lengths that stems have, and parts meet stems by equality.
    """
    clean = lambda c: F.regexp_replace(c, STEM_NOISE, "")
    files = transcripts.where(F.col("size") > least).select("name", clean(F.col("name")).alias("bare")).where("bare <> ''")
    rows = manifests.select("src_id", "stem", clean(F.col("stem")).alias("own")).where("own <> ''")
    exact = rows.join(files.select(F.col("name").alias("stem")).distinct(), "stem").select("src_id", F.col("stem").alias("name"), F.lit(True).alias("exact"))

    def inside(long: DataFrame, text: str, short: DataFrame, part: str) -> DataFrame:
        lengths = [r.n for r in short.select(F.length(part).alias("n")).distinct().collect()]  # no more than a file name has letters
        places = F.transform(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: F.transform(F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(F.col(text), i, n)))
        parts = long.withColumn(part, F.explode(F.array_distinct(F.flatten(places))))
        return parts.join(short, part)

    found = inside(files, "bare", rows, "own").select("src_id", "name").union(inside(rows, "own", files, "bare").select("src_id", "name"))
    fuzzy = found.groupBy("src_id").agg(F.min("name").alias("name")).join(exact.select("src_id"), "src_id", "left_anti")
    return exact.union(fuzzy.select("src_id", "name", F.lit(False)))


def with_transcripts(manifests: DataFrame, matched: DataFrame) -> DataFrame:
    """Failed sources with a transcript (src_id, name) go back to be compiled, with the transcript as their file."""
    rows = manifests.join(matched.select("src_id", F.col("name").alias("transcript")), "src_id", "left")
    back = (F.col("status") == "failed") & F.col("transcript").isNotNull()
    return rows.withColumns({"status": F.when(back, "ingested").otherwise(F.col("status")), "error_message": F.when(~back, F.col("error_message"))})


def reset_failed(manifests: DataFrame) -> DataFrame:
    """Failed sources back to ingested, their errors cleared."""
    failed = F.col("status") == "failed"
    return manifests.withColumns({"error_message": F.when(~failed, F.col("error_message")), "status": F.when(failed, "ingested").otherwise(F.col("status"))})


def reset_low(manifests: DataFrame, least: int) -> DataFrame:
    """Compiled sources below a score back to ingested, with score 0."""
    low = (F.col("status") == "compiled") & (F.coalesce("quality_score", F.lit(0)) < least)
    return manifests.withColumns({"status": F.when(low, "ingested").otherwise(F.col("status")), "quality_score": F.when(low, 0).otherwise(F.col("quality_score"))})


def chosen_text(sources: DataFrame, converted: DataFrame, recognised: DataFrame, least: int = 100) -> DataFrame:
    """src_id, method, text, reason: a source's own text, else the converted or the recognised one (src_id, text), the first of `least` characters or more."""
    rows = sources.select("src_id", F.col("text").alias("own")).join(converted.select("src_id", F.col("text").alias("conv")), "src_id", "left").join(recognised.select("src_id", F.col("text").alias("ocr")), "src_id", "left")
    names = {"own": "original", "conv": "converted", "ocr": "ocr"}
    enough = lambda c: F.length(F.trim(c)) >= least
    method = F.coalesce(*(F.when(enough(c), name) for c, name in names.items()), F.lit("rejected"))
    text = F.coalesce(*(F.when(enough(c), F.col(c)) for c in names))
    reason = F.when(F.coalesce("own", "conv", "ocr").isNull(), "no_text").when(text.isNull(), "too_short")
    return rows.select("src_id", method.alias("method"), text.alias("text"), reason.alias("reason"))


def cached(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """cache (key, result, ts) with entries in it: of one key the latest stays; entries without a key are not kept."""
    both = cache.unionByName(entries.where("key IS NOT NULL AND key <> ''"))
    return both.groupBy("key").agg(F.max_by(F.struct(*(c for c in cache.columns if c != "key")), F.struct("ts", "result")).alias("v")).select("key", "v.*")


def looked_up(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """rows (key, ...) with hit and result."""
    return rows.join(cache.select("key", "result"), "key", "left").withColumn("hit", F.col("result").isNotNull())


def trust_report(manifests: DataFrame, artifacts: DataFrame, polluted: DataFrame, least: int) -> DataFrame:
    """metric, name, n: sources by status and score, those that may be promoted, artifacts by layer and kind, polluted ones."""
    row = lambda rows, metric, name: rows.groupBy(F.lit(metric).alias("metric"), name.alias("name")).agg(F.count("*").alias("n"))
    total = lambda rows, metric: rows.agg(F.count("*").alias("n")).select(F.lit(metric), F.lit("all"), "n")
    out = row(manifests, "status", F.col("status")).union(row(manifests, "score", score_bucket(F.col("quality_score"))))
    out = out.union(total(manifests, "manifests")).union(total(manifests.where((F.col("status") == "compiled") & (F.col("quality_score") >= least)), "promotable"))
    return out.union(layer_counts(artifacts).select(F.lit("artifacts"), F.concat_ws("/", "layer", "kind"), "n")).union(total(polluted, "polluted"))


def score_bucket(score: Column) -> Column:
    score = F.coalesce(score, F.lit(0))
    return F.when(score <= 40, "0-40").when(score <= 60, "41-60").when(score <= 84, "61-84").otherwise("85-100")


def layer_counts(artifacts: DataFrame) -> DataFrame:
    """layer, kind, n of artifacts."""
    return artifacts.groupBy("layer", "kind").agg(F.count("*").alias("n"))


def progress(manifests: DataFrame, by: str) -> DataFrame:
    """by, total, compiled, failed, compiled_pct, and the average, highest and lowest score above 0."""
    scored, done = F.when(F.col("quality_score") > 0, F.col("quality_score")), F.count_if(F.expr("status = 'compiled'"))
    return manifests.groupBy(by).agg(
        F.count("*").alias("total"), done.alias("compiled"), F.count_if(F.expr("status = 'failed'")).alias("failed"),
        F.round(100.0 * done / F.count("*"), 2).alias("compiled_pct"), F.round(F.avg(scored), 4).alias("avg_score"), F.max("quality_score").alias("max_score"), F.min(scored).alias("min_score"),
    )


def run_statistics(records: DataFrame, *by: str) -> DataFrame:
    """records (status, seconds, api_ok, quality_score) -> counts by outcome, minutes, throughput, share of good calls, scores; a run under 0.1 minutes has throughput 0."""
    ok, minutes = F.count_if(F.expr("status = 'success'")), F.sum("seconds") / 60
    scored = F.when(F.col("quality_score") > 0, F.col("quality_score"))
    return records.groupBy(*by).agg(
        ok.alias("success"), F.count_if(F.expr("status = 'skipped'")).alias("skipped"), F.count_if(F.expr("status NOT IN ('success', 'skipped')")).alias("failed"),
        F.round(minutes, 4).alias("minutes"), F.round(F.when(minutes < 0.1, 0.0).otherwise(ok / minutes), 2).alias("per_minute"),
        F.round(100.0 * F.count_if("api_ok") / F.greatest(F.count("api_ok"), F.lit(1)), 2).alias("api_success_pct"),
        F.round(F.avg(scored), 4).alias("avg_score"), F.max(scored).alias("max_score"), F.min(scored).alias("min_score"), F.count_if(F.expr("quality_score > 0 AND quality_score < 70")).alias("low_quality"),
    )


def log_kind(line: Column, kinds: tuple = LOG_KINDS) -> Column:
    """Kind of a log line; null for lines that say nothing."""
    from functools import reduce
    from operator import and_

    return F.coalesce(*(F.when(reduce(and_, (F.contains(line, F.lit(w)) for w in words)), kind) for kind, words in kinds))


def log_rates(lines: DataFrame, *by: str, kinds: tuple = LOG_KINDS) -> DataFrame:
    """lines (line) -> by, a count for each kind, requests, content_filter_rate and success_rate in percent, 0 without requests."""
    names = [*dict.fromkeys(k for k, _ in kinds)]
    rows = lines.withColumn("kind", log_kind(F.col("line"), kinds)).groupBy(*by).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in names), F.count("kind").alias("requests"))
    share = lambda c, of: F.round(F.when(of > 0, 100.0 * F.col(c) / of).otherwise(0.0), 4)
    return rows.withColumns({"content_filter_rate": share("content_filter", F.col("requests")), "success_rate": share("success", F.col("success") + F.col("failed"))})


def sample_checked(rows: DataFrame, seed: int, n: int = 10) -> DataFrame:
    """n rows of compiled sources, picked by a hash of id and seed, with which of the required fields each lacks."""
    picked = rows.withColumn("draw", F.xxhash64("src_id", F.lit(seed))).orderBy("draw", "src_id").limit(n)
    lacks = {"one_line": F.col("one_line") == "", "key_points": F.size("key_points") == 0, "detailed_summary": F.col("detailed_summary") == "", "concepts": F.size("concepts") == 0}
    return picked.select("src_id", F.concat_ws(",", *(F.when(F.coalesce(v, F.lit(True)), k) for k, v in lacks.items())).alias("lacks"))


def completeness(files: DataFrame, sections: dict[str, str] = SECTIONS, score_line: str = SCORE_LINE) -> DataFrame:
    """files (src_id, markdown) -> a flag for each section, and the score that the text states (null if none)."""
    flags = [F.contains("markdown", F.lit(v)).alias(k) for k, v in sections.items()]
    stated = F.regexp_extract("markdown", score_line, 1)
    return files.select("src_id", *flags, F.when(stated != "", stated.cast("int")).alias("stated_score"))


def chunk_sample(chunks: DataFrame, most: int = 50) -> DataFrame:
    """Chunks (src_id, index): all of a source with `most` or fewer, else that many spread evenly, the last one among them."""
    n = F.count("*").over(Window.partitionBy("src_id"))
    rows = chunks.withColumn("__n", n)
    # Place k of most is chunk floor(k * n / most); so a chunk is picked if some k lands on it. The last place goes to the last chunk.
    k = F.ceil(F.col("index") * most / F.col("__n"))
    lands = (F.floor(k * F.col("__n") / most) == F.col("index")) & (k < most - 1)
    return rows.where((F.col("__n") <= most) | lands | (F.col("index") == F.col("__n") - 1)).drop("__n")


def restated(manifests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """manifests after a run: outcomes (src_id, status, quality_score, error_message) as patches, the later of a source's rows (seq) last."""
    return patched(manifests, outcomes.withColumn("promoted_to", F.lit(None).cast("string")))
