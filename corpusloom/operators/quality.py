"""Scores, lint, provenance, trust and the gate, as column expressions over compiled rows."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.compile import DEFAULT_EXPLANATION
from corpusloom.plugins import Registry

# Words that show learning value; each counts once.
LEARNING_KEYWORDS = (
    "学习 提升 改善 掌握 理解 应用 运用 技能 知识 能力 经验 方法 策略 技巧 教训 重点 关键 核心 本质 规律 模式 原理 机制 流程 步骤 "
    "效果 结果 成果 优化 增强 改进 提高 训练 实践 实验 操作 实施 使用 利用"
).split()
# Words that show density. Those in capitals never match, as the text is in lower case.
INFO_KEYWORDS = "工具 框架 API SDK 算法 架构 协议 数据库 缓存 容器 微服务 中间件 配置 部署 监控".split()
# A keyword followed by one of these is part of another word.
COMPOUND_SUFFIXES = "词性化者论学"
# What a template's opening holds.
TEMPLATES = ("这里是一个摘要", "这是一个概括", "summary", "概括", "总结")
PROVENANCE_TEMPLATES = ("该文档", "本文档", "这份文件", "the document", "this document", "以下是对", "以下是关于", "以下是总结")
# How a text speaks of itself, for lint and for provenance.
SELF_REFERENCE = r"本文(?:档|件|章|节)|该(?:文档|文件|章节|文章)|这篇文章|(?:本|该|此)(?:书|资料|材料)"
PROVENANCE_SELF_REFERENCE = r"本文(?:档|件|章|节)|该(?:文档|文件|章节|文章)|这篇文章|我们(?:将|可以|会)"
# What is left out before texts are compared.
PUNCTUATION = "[，。！？、；：\"'（）{}【】\\s]+"
# Confidence of each label.
CONFIDENCE = {"extracted": 0.9, "merged": 0.7, "inferred": 0.5, "ambiguous": 0.2}
# Fixed values: (least value, points), from the highest on.
TIERS = {
    "detail_length": ((1500, 25), (1200, 23), (1000, 21), (800, 18), (600, 14), (400, 10), (200, 5)),
    "key_points": ((5, 30), (4, 26), (3, 22), (2, 14), (1, 7)),
    "learning_value": ((10, 15), (8, 12), (6, 9), (4, 6), (2, 3), (1, 1)),
    "info_density": ((5, 5), (3, 4), (1, 2)),
    "concepts": ((5, 10), (4, 8), (3, 6), (2, 4), (1, 2)),
}


def tier(value: Column, name: str) -> Column:
    top, out = TIERS[name][0][0], F.lit(0)
    if top <= 10:  # a look-up, which works the value out once
        points = [next((p for least, p in TIERS[name] if i >= least), 0) for i in range(top + 1)]
        return F.coalesce(F.get(F.array(*map(F.lit, points)), F.least(value, F.lit(top))), out)
    for least, points in reversed(TIERS[name]):
        out = F.when(value >= least, points).otherwise(out)
    return out


def keyword_hits(text: Column, words: list[str]) -> Column:
    """How many of the words a text holds, outside longer words: one pass that stands at every place where a word may begin, so words that share a letter all count; each counts once."""
    first = sorted({w[0] for w in words})
    wide = [c for c in first if c > "\xff"]
    begins = "".join(c for c in first if c <= "\xff") + (f"{wide[0]}-{wide[-1]}" if wide else "")  # one range: a set of many letters is slow to test
    found = F.regexp_extract_all(text, F.lit(f"(?=[{begins}])(?=({'|'.join(words)})(?![{COMPOUND_SUFFIXES}]))"), F.lit(1))
    return F.size(F.array_distinct(found))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def dimensions(named: Column | None = None) -> dict[str, Column]:
    """Points of each dimension of a compiled row; `overflow` is what a very long summary loses. named: the number of concepts, where they are not there by name."""
    low, n, line = F.lower("detailed_summary"), F.length("detailed_summary"), F.length("one_line")
    filled = F.size(F.filter("key_points", lambda k: F.trim(k) != ""))
    named = F.size(F.filter("concepts", lambda c: F.trim(c["name"]) != "")) if named is None else named
    return {
        "detail_length": tier(n, "detail_length"),
        "key_points": tier(filled, "key_points"),
        "learning_value": tier(keyword_hits(low, LEARNING_KEYWORDS), "learning_value"),
        "info_density": tier(keyword_hits(low, INFO_KEYWORDS), "info_density"),
        "one_line": F.when(line.between(20, 50), 5).when(line >= 10, 3).when(line >= 5, 1).otherwise(0),
        "concepts": tier(named, "concepts"),
        "template": F.when(any_of(F.left(low, F.lit(200)), TEMPLATES), -20).otherwise(0),
        "overflow": -F.least(F.lit(10), F.floor(F.greatest(F.lit(0), n - 3000) / 500)).cast("int"),
    }


def score(named: Column | None = None) -> Column:
    """Quality of a compiled row, 0 to 100 (see dimensions)."""
    return F.greatest(F.lit(0), F.least(F.lit(100), reduce(add, dimensions(named).values())))


def scored(compiled: DataFrame, plugins: Registry) -> DataFrame:
    """compiled with quality_score and plugin_errors: a plug-in's score where it gives one (kept within 0 and 100), else the library's own."""
    row = F.struct(*compiled.columns)
    given = plugins.first("quality_score", row).cast("int")
    own = F.greatest(F.lit(0), F.least(F.lit(100), given))
    return compiled.withColumns({"quality_score": F.when(given.isNotNull(), own).otherwise(score()), "plugin_errors": plugins.errors("quality_score", row)})


def dimension_rows(compiled: DataFrame) -> DataFrame:
    points = F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("points")) for k, v in dimensions().items()))
    return compiled.select("src_id", F.inline(points))


def issues() -> Column:
    """array<struct<rule, severity, detail>> of a compiled row."""
    kind = "array<struct<rule:string,severity:string,detail:string>>"
    name = lambda c: F.trim(c["name"])
    key = lambda c: F.replace(F.replace(F.lower(name(c)), F.lit(" ")), F.lit("-"))
    line, summary = F.col("one_line"), F.col("detailed_summary")

    def issue(rule: str, severity: str | Column, detail: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), detail.alias("detail"))

    named = F.filter("concepts", lambda c: name(c) != "")
    keys = F.transform(named, key)
    repeated = F.transform(F.filter(F.transform(named, lambda c, i: F.struct(name(c).alias("n"), (F.array_position(keys, key(c)) <= i).alias("again"))), lambda x: x["again"]), lambda x: issue("concept_dedup", "warning", x["n"]))
    filled = F.size(F.filter("key_points", lambda k: F.trim(k) != ""))
    fixed = F.array_compact(
        F.array(
            F.when(line == "", issue("completeness", "error", F.lit("one_line"))).when(F.length(line) < 10, issue("completeness", "warning", F.lit("one_line"))),
            F.when(filled == 0, issue("completeness", "error", F.lit("key_points"))).when(filled < 2, issue("completeness", "warning", F.lit("key_points"))),
            F.when(summary == "", issue("completeness", "error", F.lit("detailed_summary"))).when(F.length(summary) < 50, issue("completeness", "warning", F.lit("detailed_summary"))),
            F.when(F.size(named) == 0, issue("completeness", "warning", F.lit("concepts"))),
            F.when(summary.rlike(SELF_REFERENCE), issue("self_reference", "warning", F.regexp_extract(summary, SELF_REFERENCE, 0))),
            _coverage(issue),
        )
    )
    odd = F.filter(named, lambda c: (F.length(name(c)) < 2) | (F.length(name(c)) > 50))
    default = F.filter(named, lambda c: F.contains(c["explanation"], F.lit(DEFAULT_EXPLANATION[1:-1])))
    quality = F.transform(F.concat(odd, default), lambda c: issue("concept_quality", "warning", name(c)))
    return F.concat(repeated.cast(kind), fixed.cast(kind), quality.cast(kind))


def _coverage(issue) -> Column:
    """For texts of 10 000 characters or more: the share of long paragraphs whose beginning the summary holds."""
    text, summary = F.col("text"), F.col("detailed_summary")
    long = F.filter(F.transform(F.split(text, "\n\n"), F.trim), lambda p: F.length(p) > 50)
    held = F.size(F.filter(long, lambda p: (F.length(F.trim(F.left(p, F.lit(30)))) >= 4) & F.contains(summary, F.left(F.trim(F.left(p, F.lit(30))), F.lit(15)))))
    share = held / F.greatest(F.size(long), F.lit(1))
    severity = F.when(share < 0.2, "warning").when(share < 0.4, "info")
    return F.when((F.length(text) >= 10_000) & (summary != "") & (F.size(long) > 0) & severity.isNotNull(), issue("coverage", severity, F.lit("detailed_summary")))


def linted(compiled: DataFrame) -> DataFrame:
    """compiled with issues, counts by severity, lint_passed and lint_score."""
    rows = compiled.withColumn("issues", issues())
    count = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s))
    rows = rows.withColumns({"errors": count("error"), "warnings": count("warning"), "infos": count("info")})
    raw = 1 - F.col("errors") * F.lit(0.3).cast("double") - F.col("warnings") * F.lit(0.1).cast("double") - F.col("infos") * F.lit(0.02).cast("double")
    return rows.withColumns({"lint_passed": F.col("errors") == 0, "lint_score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 2)})


def traced(compiled: DataFrame) -> DataFrame:
    """compiled with concept_labels (array<struct<name, label>>), summary_label, overall_label and confidence."""
    clean = lambda c: F.regexp_replace(c, PUNCTUATION, "")
    rows = compiled.withColumn("bare", clean(F.col("text")))

    def found(piece: Column) -> Column:
        return (piece != "") & (F.contains(F.col("text"), piece) | ((F.length(clean(piece)) >= 4) & F.contains(F.col("bare"), clean(piece))))

    def label(c: Column) -> Column:
        start = F.left(F.trim(c["explanation"]), F.lit(15))
        words = F.filter(F.split(c["name"], r"[的与和及/\s]+"), lambda w: F.length(w) >= 2)
        some = (F.size(words) > 0) & (F.size(F.filter(words, found)) >= F.size(words) * 0.5)
        return F.when(found(c["name"]) | ((F.length(start) >= 4) & found(start)), "extracted").when(some, "inferred").otherwise("ambiguous")

    named = F.filter("concepts", lambda c: F.trim(c["name"]) != "")
    rows = rows.withColumn("concept_labels", F.transform(named, lambda c: F.struct(F.trim(c["name"]).alias("name"), label(c).alias("label"))))
    n = F.length("text")
    filled = F.filter("key_points", lambda k: F.trim(k) != "")
    share = F.size(F.filter(filled, lambda k: found(F.left(F.trim(k), F.lit(20))))) / F.greatest(F.size(filled), F.lit(1))
    rows = rows.withColumns({"mode": F.when(n < 20_000, "direct").when(n < 60_000, "map_reduce").otherwise("hierarchical"), "kp_share": share})
    template = any_of(F.left("detailed_summary", F.lit(500)), PROVENANCE_TEMPLATES) | F.col("detailed_summary").rlike(PROVENANCE_SELF_REFERENCE)
    line_found = found(F.left("one_line", F.lit(30)))
    summary = F.when(template, "ambiguous").when((line_found | (F.col("kp_share") >= 0.6)) & (F.col("mode") == "direct"), "extracted").when(F.col("mode") != "direct", "merged").otherwise("inferred")
    rows = rows.withColumns({"template": template, "summary_label": summary})
    count = lambda s: F.size(F.filter("concept_labels", lambda x: x["label"] == s))
    total = F.size("concept_labels")
    rows = rows.withColumns({"n_extracted": count("extracted"), "n_inferred": count("inferred"), "n_ambiguous": count("ambiguous"), "n_concepts": total})
    extracted = F.col("n_extracted") / F.greatest("n_concepts", F.lit(1))
    overall = (
        F.when((F.col("n_concepts") == 0) | F.col("template"), "ambiguous")
        .when((extracted >= 0.6) & ((F.col("mode") == "direct") | (F.col("summary_label") == "extracted")), "extracted")
        .when(F.col("n_ambiguous") / F.greatest("n_concepts", F.lit(1)) >= 0.5, "ambiguous")
        .when((F.col("mode") != "direct") & (extracted >= 0.3), "merged")
        .when(F.col("n_inferred") > F.col("n_extracted"), "inferred")
        .otherwise("merged")
    )
    rows = rows.withColumn("overall_label", overall)
    sure = F.create_map(*(x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v).cast("double"))))
    return rows.withColumn("confidence", F.element_at(sure, F.col("overall_label"))).drop("bare")


def trust() -> Column:
    """high, medium or low, of a row that is linted and traced."""
    return F.when((F.col("errors") > 0) | (F.col("overall_label") == "ambiguous"), "low").when(F.col("lint_passed") & F.col("overall_label").isin("extracted", "merged"), "high").otherwise("medium")


def gated(rows: DataFrame, least: int = 85) -> DataFrame:
    """Rows (src_id, status, error_message, summary_there, quality_score, lint_passed, default_concepts) through the gate."""
    lint = F.col("lint_passed") & (F.col("default_concepts") == 0)
    checks = {"status": F.col("status") == "compiled", "error": F.col("error_message").isNull(), "summary": F.col("summary_there"), "lint": lint}
    reasons = F.concat_ws("; ", *(F.when(~v, k) for k, v in checks.items()))
    level = F.when(F.col("quality_score") >= 80, "high").when(F.col("quality_score") >= 50, "medium").otherwise("low")
    passed = reduce(lambda a, b: a & b, checks.values())
    return rows.select("src_id", passed.alias("passed"), "quality_score", level.alias("quality_level"), (F.col("quality_score") < least).alias("score_warning"), reasons.alias("failed_checks"))


def answer_score(answer: Column, has_concepts: Column) -> Column:
    """Score of an answer as knowledge: 50, and points for length, keywords, links, structure and concepts."""
    low, n = F.lower(answer), F.length(answer)
    hits = lambda words: reduce(add, (F.contains(low, F.lit(w.lower())).cast("int") for w in words))
    length = F.when(n >= 1000, 20).when(n >= 500, 15).when(n >= 200, 10).otherwise(0)
    links = F.least(F.size(F.regexp_extract_all(answer, F.lit(r"\[\[[^\]]+\]\]"), F.lit(0))) * 3, F.lit(10))
    structure = F.when(answer.rlike(r"\n[-*•]|\n\d+\.|\n#{1,3} "), 5).otherwise(0)
    points = 50 + length + F.least(hits(LEARNING_KEYWORDS) * 2, F.lit(10)) + F.least(hits(INFO_KEYWORDS) * 2, F.lit(5)) + links + structure + F.when(has_concepts, 5).otherwise(0)
    return F.least(points, F.lit(100))
