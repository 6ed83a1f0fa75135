"""Secret scans by an incremental blob ledger.

Every text is content-addressed (SHA-256). The ledger, a table, holds one row for each blob and
rule version that has been scanned, with the spans found. A run scans only the blobs of its input
that the ledger does not yet hold for the rule version, appends them, and joins the findings back to
every document (path) that carries the blob, in whatever version of it. Only Spark SQL functions run.

Spans come from `split` and `regexp_extract_all` over the same pattern: the pieces between matches
and the matches themselves alternate, so running sums of their lengths give every match's start and
end in code points. Leftmost non-overlapping matches that fail a kind's length are dropped after
matching, so they still use up their characters.

Cases: a null or empty text is the empty blob and has no spans; rows that repeat get a row each; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import id_text, let, new_path, written


@dataclass(frozen=True)
class Rule:
    """pattern: Java regular expression; least: code points that group `group` needs; base: counted in the digest."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of hex digits and of what follows AKIA are matched whole, so their length can stand in the pattern.
RULES = (
    Rule("assign", ASSIGN, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("hosted", r"(?:gh[pousr]_|github_pat_|glpat-|xox[baprs]-|sk_live_)[A-Za-z0-9_-]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULE_VERSION = "2"
SPAN = "struct<start:int,kind_no:int,end:int>"
LEDGER = f"blob string, spans array<{SPAN}>, rule_version string"


def spans(text: Column, rule: Rule, kind_no: int) -> Column:
    """array<struct<start, kind_no, end>> of a rule's matches, in code points."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), F.transform(matches, F.length).alias("n"), F.transform(kept, F.length).alias("kept"))
    return F.when(text.rlike(rule.pattern), let(rows, lambda r: _placed(r, rule, kind_no))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _placed(rows: Column, rule: Rule, kind_no: int) -> Column:
    """Spans of matches (gap before, length, length of the counted group) by running sums.

    Appending to an array copies it, so the sums run in parts of about the square root of the number
    of matches: first over whole parts, then inside each part from its beginning.
    """
    span = F.array().cast(f"array<{SPAN}>")

    def placed(part: Column, at: Column) -> Column:
        def step(acc: Column, row: Column) -> Column:
            begin = acc["at"] + row["gap"]
            end = begin + row["n"]
            found = F.struct(begin.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(row["kept"] >= rule.least, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), span.alias("out")), step, lambda acc: acc["out"])

    def starts(parts: Column) -> Column:
        length = lambda part: F.aggregate(part, F.lit(0), lambda s, r: s + r["gap"] + r["n"])
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(F.transform(parts, length), begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(rows))).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.size(rows) - 1, size), lambda i: F.slice(rows, i + 1, size))
    return let(parts, lambda p: F.flatten(F.zip_with(p, starts(p), placed)))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path; empty if there is none yet."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION, few: int = 50_000) -> DataFrame:
    """Bring the ledger at `path` up to date with docs; return doc_id, blob, spans.

    Up to `few` unseen blobs are broadcast (64 bytes each), and no other text is shuffled.
    """
    spark = docs.sparkSession
    keyed = id_text(docs).withColumn("blob", F.sha2("text", 256))
    known = ledger(spark, path).where(F.col("rule_version") == version).select("blob")
    fresh = written(keyed.select("blob").distinct().join(known, "blob", "left_anti"), "fresh-blobs")
    if fresh.count() <= few:
        unseen = keyed.join(F.broadcast(fresh), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
    else:
        # Copies meet in each partition before the shuffle, then after it, so a text is scanned once however often it occurs.
        unseen = keyed.groupBy("blob").agg(F.first("text").alias("text")).join(fresh, "blob", "left_semi")
    found = F.array_sort(F.concat(*(spans(F.col("text"), r, i) for i, r in enumerate(rules))))
    unseen.select("blob", found.alias("spans"), F.lit(version).alias("rule_version")).write.mode("append").partitionBy("rule_version").parquet(path)
    hits = ledger(spark, path).where((F.col("rule_version") == version) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", "spans")
    none = F.array().cast(f"array<{SPAN}>")
    return keyed.select("doc_id", "blob").join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def as_text(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    base = [i for i, r in enumerate(rules) if r.base]
    kinds = F.transform("spans", lambda s: s["kind_no"])
    counts = [F.size(F.filter(kinds, F.lit(i).__eq__)).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    only = F.filter("spans", lambda s: s["kind_no"].isin(base))
    return found.select("doc_id", *counts, F.sha2(as_text(only, rules), 256).alias("base_sha256"), as_text(F.col("spans"), rules).alias("spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every rule, through a ledger of its own. The second scan finds every blob in the ledger and runs no rule."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "blob-ledger")
    scan(docs, path)
    return digest(scan(docs, path))


def _sql_spans(rule: Rule, kind_no: int) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    p = quote(rule.pattern)
    starts = f"list_sum(list_transform(string_split_regex(text, {p})[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(regexp_extract_all(text, {p}, 0)[1:i-1], lambda x: length(x)))::BIGINT, 0)"
    ends = f"{starts} + length(regexp_extract_all(text, {p}, 0)[i])"
    return (
        f"SELECT doc_id, {kind_no} AS k, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, {starts} AS s, {ends} AS e FROM "
        f"(SELECT doc_id, text, unnest(range(1, len(regexp_extract_all(text, {p}, 0)) + 1)) AS i FROM d WHERE regexp_matches(text, {p})) "
        f"WHERE length(regexp_extract_all(text, {p}, {rule.group})[i]) >= {rule.least}"
    )


SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ("
    + " UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(RULES))
    + "), g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, "
    "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (base) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id) "
    "SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, "
    "sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"
)
