"""Queries over sources and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import manifest as M
from corpusloom.plans.registry import query, table
from corpusloom.sources import pages as P

SRC = (
    "src AS (SELECT printf('SRC-%04d', doc_id) AS src_id, doc_id, split_part(text, chr(10), 1) AS title, "
    "source AS type, text, strlen(text)::BIGINT AS size_bytes, sha256(text) AS content_hash FROM documents)"
)
def sources(spark, sf_dir):
    return M.sources(table(spark, sf_dir, "documents"))


@query(f"WITH {SRC} SELECT src_id, doc_id, title, type, size_bytes, content_hash FROM src")
def manifest_table(spark, sf_dir):
    return sources(spark, sf_dir).drop("text")


@query(f"WITH {SRC}, u AS (SELECT content_hash, min(doc_id) AS doc_id FROM src GROUP BY content_hash) SELECT content_hash, doc_id, row_number() OVER (ORDER BY doc_id) AS seq FROM u")
def manifest_ids(spark, sf_dir):
    """Sequential ids of new contents, in order of arrival."""
    new = sources(spark, sf_dir).groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return M.with_sequential_ids(new, "doc_id").select("content_hash", "doc_id", "seq")


@query(f"""WITH {SRC}, k AS (SELECT DISTINCT content_hash FROM src WHERE type = 'src0'), n AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS r
  FROM src WHERE type <> 'src0' AND content_hash NOT IN (SELECT content_hash FROM k)) SELECT src_id, doc_id, content_hash FROM n WHERE r = 1""")
def exact_dup_dedup(spark, sf_dir):
    """New contents of all sources but one, against that one's as known."""
    rows = sources(spark, sf_dir)
    return M.new_content(rows.where("type <> 'src0'"), rows.where("type = 'src0'")).select("src_id", "doc_id", "content_hash")


@query(f"""WITH {SRC}, r AS (SELECT type, size_bytes, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS r FROM src)
SELECT type, count(*) AS total, count(*) FILTER (size_bytes > 0 AND r = 1) AS linked, count(*) FILTER (size_bytes > 0 AND r > 1) AS skipped, count(*) FILTER (size_bytes = 0) AS failed FROM r GROUP BY type""")
def ingest_stats(spark, sf_dir):
    """Outcome counts of taking in every document in order of its id."""
    return M.ingest_outcomes(sources(spark, sf_dir), "type")


@query(f"WITH {SRC} SELECT src_id, length(trim(text)) AS n FROM src WHERE length(trim(text)) >= 100")
def text_meaningful_filter(spark, sf_dir):
    return sources(spark, sf_dir).where(M.meaningful(F.col("text"))).select("src_id", F.length(F.trim("text")).cast("long").alias("n"))


def _sql_category() -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.CATEGORY.items())
    skipped = ", ".join(f"'{x}'" for x in M.SKIPPED)
    return f"CASE WHEN ext IN ({skipped}) THEN NULL ELSE CASE ext {cases} ELSE 'other' END END"


EXTENSIONS = (".pdf", ".md", ".PNG", ".epub", ".mp3", ".xyz", ".zip", ".html", ".mov", ".docx")


@query(f"WITH p AS (SELECT page_id, lower(([{', '.join(repr(x) for x in EXTENSIONS)}])[page_id % {len(EXTENSIONS)} + 1]) AS ext FROM pages) SELECT page_id, ext, {_sql_category()} AS category FROM p")
def extension_category(spark, sf_dir):
    """Folder of every page's file, whose extension its number gives."""
    names = F.array(*map(F.lit, EXTENSIONS))
    rows = table(spark, sf_dir, "pages").select("page_id", F.lower(F.get(names, (F.col("page_id") % len(EXTENSIONS)).cast("int"))).alias("ext"))
    return rows.withColumn("category", M.category(F.col("ext")))


@query(f"""WITH {SRC} SELECT type, count(*) AS files, CAST(sum(CASE WHEN size_bytes > 102400 THEN 3 WHEN size_bytes > 51200 THEN 2 ELSE 1 END) AS BIGINT) AS calls,
  round(sum(CASE WHEN size_bytes > 102400 THEN 3 WHEN size_bytes > 51200 THEN 2 ELSE 1 END) * 0.001, 3)::DOUBLE AS cost FROM src GROUP BY type""")
def compile_cost_estimate(spark, sf_dir):
    return M.cost_estimate(sources(spark, sf_dir), "type")


@query(f"WITH {SRC}, n AS (SELECT src_id, title, row_number() OVER (PARTITION BY title ORDER BY src_id) - 1 AS k FROM src) SELECT src_id, CASE WHEN k = 0 THEN title ELSE title || '_' || k END AS unique_name FROM n")
def name_allocation(spark, sf_dir):
    return M.allocated_names(sources(spark, sf_dir).select("src_id", "title"), "title", "src_id").select("src_id", "unique_name")


@query(f"""WITH {SRC}, s AS (SELECT src_id, title || CASE WHEN doc_id % 2 = 0 THEN '_' || src_id ELSE '' END AS stem FROM src), b AS (SELECT *, regexp_replace(stem, '_SRC-\\d+$', '') AS base FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY stem, src_id) AS r FROM b) SELECT src_id, stem, base FROM r WHERE r = 1""")
def first_file_per_stem(spark, sf_dir):
    stem = F.concat(F.col("title"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("_"), "src_id")).otherwise(""))
    rows = sources(spark, sf_dir).select("src_id", stem.alias("stem")).withColumn("base", X.base_stem(F.col("stem")))
    return M.first_per(rows, ["base"], F.col("stem"), F.col("src_id"))


@query(f"""WITH {SRC}, k AS (SELECT DISTINCT content_hash FROM src WHERE type = 'src1'), m AS (SELECT src_id, title, content_hash, CASE WHEN contains(lower(title), 'the') OR contains(lower(title), 'idiot') THEN 'filename' WHEN contains(lower(left(text, 2000)), 'the') OR contains(lower(left(text, 2000)), 'idiot') THEN 'content' END AS match_type FROM src)
 SELECT src_id, title, match_type, CAST(CASE match_type WHEN 'filename' THEN 0 ELSE 1 END AS INTEGER) AS place, 'vault,seed,the idiot' AS tags FROM m WHERE match_type IS NOT NULL AND content_hash NOT IN (SELECT content_hash FROM k)""")
def vault_seed(spark, sf_dir):
    """Notes on a topic (in the name, or in the first 2000 characters) whose content one of the sources does not hold yet."""
    rows = sources(spark, sf_dir)
    found = M.seeded(rows, rows.where("type = 'src1'").select("content_hash").distinct(), "the idiot")
    return found.select("src_id", "title", "match_type", "place", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {SRC}, k AS (SELECT DISTINCT title FROM src WHERE type = 'src0') SELECT src_id, title AS name FROM src WHERE title NOT IN (SELECT title FROM k)")
def name_skip(spark, sf_dir):
    """Documents of all sources but one whose name that one has not taken in."""
    rows = sources(spark, sf_dir).withColumn("name", F.col("title"))
    return M.without_known_names(rows, rows.where("type = 'src0'").select("name").distinct()).select("src_id", "name")


@query(P.SQL_TEXT)
def page_text_extract(spark, sf_dir):
    return P.page_text(table(spark, sf_dir, "pages"))


@query(P.SQL_PARAGRAPHS)
def page_paragraphs(spark, sf_dir):
    return P.paragraphs(table(spark, sf_dir, "pages"))
