"""Queries over segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import backends  # noqa: F401 - registers the embedders
from corpusloom.functions.text import sentences
from corpusloom.operators import segment as S
from corpusloom.plans.manifest_queries import SRC, sources
from corpusloom.plans.registry import query, table
from corpusloom.plugins import configured
from corpusloom.sources import pages as P

STRIP = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
SENTENCES = "list_filter(list_transform(regexp_extract_all({}, '[^.!?。！？\\n]+[.!?。！？]*', 0), lambda s: " + STRIP.format("s") + "), lambda s: s <> '')"


@query(f"WITH {SRC}, x AS (SELECT src_id, {SENTENCES.format('text')} AS s FROM src) SELECT src_id, CAST(unnest(range(len(s))) AS INTEGER) AS place, unnest(s) AS sentence FROM x")
def sentence_split(spark, sf_dir):
    return S.sentence_rows(sources(spark, sf_dir))


CASE = "CASE WHEN n <= 20000 THEN 'direct' WHEN n <= 60000 THEN 'map_reduce' WHEN n <= 200000 THEN 'hierarchical' ELSE 'map_reduce' END"


@query(f"WITH {SRC}, x AS (SELECT src_id, length(text) AS n FROM src) SELECT src_id, {CASE} AS strategy, CAST(n AS INTEGER) AS n FROM x")
def chunk_strategy(spark, sf_dir):
    n = F.length("text")
    return sources(spark, sf_dir).select("src_id", S.strategy(n).alias("strategy"), n.alias("n"))


@query(f"""WITH {SRC}, x AS (SELECT src_id, text, greatest(1, CAST(ceil((length(text) - 200) / 3800.0) AS INTEGER)) AS k FROM src WHERE length(text) > 0), e AS (SELECT src_id, text, unnest(range(k)) AS i FROM x)
SELECT src_id, CAST(i AS INTEGER) AS "index", CAST(i * 3800 AS INTEGER) AS start, substring(text, i * 3800 + 1, 4000) AS content FROM e""")
def chunk_fixed_plain(spark, sf_dir):
    return S.fixed(sources(spark, sf_dir), 4000, 200)


@query(f"""WITH {SRC}, x AS (SELECT src_id, text, greatest(1, CAST(ceil((length(text) - 120) / 680.0) AS INTEGER)) AS k FROM src WHERE length(text) > 0), e AS (SELECT src_id, text, unnest(range(k)) AS i FROM x)
SELECT src_id || '_chunk_' || printf('%04d', i) AS id, src_id, 'fixed' AS strategy, substring(text, i * 680 + 1, 800) AS content FROM e""")
def chunk_ids(spark, sf_dir):
    return S.with_ids(S.fixed(sources(spark, sf_dir), 800, 120), "fixed")


@query(f"""WITH {SRC}, x AS (SELECT length(text) AS n FROM src WHERE length(text) > 0), y AS (SELECT n, 'fixed_4000' AS strategy, greatest(1, CAST(ceil((n - 200) / 3800.0) AS BIGINT)) AS k FROM x
 UNION ALL SELECT n, 'fixed_800', greatest(1, CAST(ceil((n - 120) / 680.0) AS BIGINT)) FROM x) SELECT strategy, CAST(sum(k) AS BIGINT) AS chunks, round(avg(k), 4) AS per_doc FROM y GROUP BY strategy""")
def chunk_strategy_comparison(spark, sf_dir):
    docs = sources(spark, sf_dir)
    per = [S.fixed(docs, *size).groupBy("src_id").agg(F.count("*").alias("k")).withColumn("strategy", F.lit(name)) for name, size in (("fixed_4000", (4000, 200)), ("fixed_800", (800, 120)))]
    return per[0].union(per[1]).groupBy("strategy").agg(F.sum("k").alias("chunks"), F.round(F.avg("k"), 4).alias("per_doc"))


_PARTS = P.SQL_PARAGRAPHS.replace("length(text) > 50", "length(text) > 0")
_HEAD = P._sql_plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")


@query(f"""WITH parts AS ({_PARTS}), md AS (SELECT page_id, '# ' || any_value({_HEAD}) || chr(10) || chr(10) || string_agg(parts.text, chr(10) || chr(10) ORDER BY place) AS text FROM pages JOIN parts USING (page_id) GROUP BY page_id),
l AS (SELECT page_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM md),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(#{{1,6}})\\s+(.*)$') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS sec FROM l),
b AS (SELECT page_id, sec, arg_min(line, i) AS head, {STRIP.format("string_agg(line, chr(10) ORDER BY i)")} AS content FROM s GROUP BY page_id, sec)
SELECT page_id::VARCHAR AS src_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY sec) - 1 AS INTEGER) AS "index", CAST(length(regexp_extract(head, '^(#{{1,6}})\\s+(.*)$', 1)) AS INTEGER) AS level,
{STRIP.format("regexp_extract(head, '^(#{1,6})\\s+(.*)$', 2)")} AS title, content FROM b WHERE content <> ''""")
def heading_sections(spark, sf_dir):
    """Pages as Markdown, cut at headings."""
    return S.sections(P.markdown(table(spark, sf_dir, "pages")).select(F.col("page_id").cast("string").alias("src_id"), "text"))


@query()
def chunk_recursive(spark, sf_dir):
    return S.chunks(sources(spark, sf_dir), "recursive", 800, 120)


@query()
def chunk_sentences(spark, sf_dir):
    return S.chunks(sources(spark, sf_dir), "sentence", 4000, 200)


@query()
def chunk_lines(spark, sf_dir):
    return S.chunks(sources(spark, sf_dir), "line", 4000, 200)


@query("""WITH v AS (SELECT label AS doc, vec_id AS place, list_transform(embedding, lambda x: x::DOUBLE) AS v, lead(list_transform(embedding, lambda x: x::DOUBLE)) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings),
d AS (SELECT doc, place, round(1 - list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)), 6) AS distance FROM v WHERE w IS NOT NULL),
b AS (SELECT doc, round(quantile_cont(distance, 0.95), 6) AS bar FROM d GROUP BY doc) SELECT doc, place, distance, distance > bar AS breaks FROM d JOIN b USING (doc)""")
def semantic_breakpoints(spark, sf_dir):
    """Where the topic turns, with the vectors of a label in order as a document's sentences."""
    return S.breakpoints(table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc"), F.col("vec_id").alias("place"), F.col("embedding").alias("v")))


_SENT = "list_filter(list_transform(regexp_extract_all({0}, '[^。！？!?]*[。！？!?]+|[^。！？!?]+$', 0), lambda x: " + STRIP.format("x") + "), lambda x: x <> '')"
LONG = f"""ls0 AS (SELECT src_id, {_SENT.format(STRIP.format('text'))} AS s FROM src), ls1 AS (SELECT src_id, unnest(range(len(s))) AS i, unnest(s) AS s FROM ls0),
ls2 AS (SELECT *, sum(CASE WHEN length(s) >= 20 OR i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY src_id ORDER BY i) - 1 AS place FROM ls1), ls AS (SELECT src_id, CAST(place AS INTEGER) AS place, string_agg(s, '' ORDER BY i) AS sentence FROM ls2 GROUP BY src_id, place)"""


@query(f"WITH {SRC}, {LONG} SELECT src_id, place, sentence FROM ls")
def long_sentences(spark, sf_dir):
    return S.long_sentences(sources(spark, sf_dir)).withColumn("place", F.col("place").cast("int"))


_V = "[" + ", ".join(f"(length(lower(sentence)) - length(replace(lower(sentence), '{x}', '')))::DOUBLE" for x in "aeioulnrst") + "]"


@query(f"""WITH {SRC}, {LONG}, v0 AS (SELECT src_id, place, sentence, {_V} AS v FROM ls), v1 AS (SELECT *, lead(v) OVER (PARTITION BY src_id ORDER BY place) AS w FROM v0),
d AS (SELECT src_id, place, round(1 - coalesce(list_dot_product(v, w) / nullif(sqrt(list_dot_product(v, v) * list_dot_product(w, w)), 0), 0), 6) AS distance FROM v1 WHERE w IS NOT NULL), b AS (SELECT src_id, round(quantile_cont(distance, 0.95), 6) AS bar FROM d GROUP BY src_id),
k AS (SELECT d.src_id, place + 1 AS place, CASE WHEN distance > bar THEN 1 ELSE 0 END AS br FROM d JOIN b USING (src_id)), g AS (SELECT ls.src_id, ls.place, sentence, sum(coalesce(br, 0)) OVER (PARTITION BY ls.src_id ORDER BY ls.place) AS grp FROM ls LEFT JOIN k USING (src_id, place)),
t AS (SELECT src_id, grp, string_agg(sentence, '' ORDER BY place) AS text FROM g GROUP BY 1, 2), p AS (SELECT src_id, grp, text, unnest(range(CASE WHEN length(text) <= 800 THEN 1 ELSE CAST(floor((length(text) - 1) / 680) AS INTEGER) + 1 END)) AS i FROM t)
SELECT src_id, CAST(row_number() OVER (PARTITION BY src_id ORDER BY grp, i) - 1 AS INTEGER) AS "index", substring(text, i * 680 + 1, 800) AS content FROM p""")
def chunk_semantic(spark, sf_dir):
    """Documents cut where the topic turns; letter counts stand for sentence vectors."""
    rows = S.long_sentences(sources(spark, sf_dir))
    return S.semantic(rows.withColumn("v", S.letter_vector(F.col("sentence"))), 800, 120)


@query()
def chunk_sentences_merged(spark, sf_dir):
    return S.merged_sentences(S.long_sentences(sources(spark, sf_dir)), 800, 120)


@query()
def chunk_structured(spark, sf_dir):
    """Pages as Markdown, cut at headings or numbered parts, and packed."""
    return S.structured(P.markdown(table(spark, sf_dir, "pages")).select(F.col("page_id").cast("string").alias("src_id"), "text"), 1000, 100)


@query()
def chunk_paragraphs(spark, sf_dir):
    return S.chunks(sources(spark, sf_dir), "paragraph", 4000, 200)


@query(f"""WITH {SRC}, st AS (SELECT src_id, {SENTENCES.format('text')} AS s FROM src), nt AS (SELECT src_id, array_to_string(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i % 2 = 1 THEN i || '. ' ELSE '' END || s[i]), chr(10)) AS text FROM st), l AS (SELECT src_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM nt), f AS (SELECT *, min(CASE WHEN {STRIP.format('line')} <> '' THEN i END) OVER (PARTITION BY src_id) AS first FROM l),
h AS (SELECT *, regexp_matches(line, '{S.NUMBERING}') AND i > first AS head FROM f), s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY src_id ORDER BY i) AS sec FROM h), b AS (SELECT src_id, sec, arg_min(line, i) AS line, {STRIP.format("string_agg(line, chr(10) ORDER BY i)")} AS content FROM s GROUP BY src_id, sec),
n AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY sec) - 1 AS k, count(*) OVER (PARTITION BY src_id) AS parts FROM b WHERE content <> '')
SELECT src_id, CAST(k AS INTEGER) AS "index", 1 AS level, CASE WHEN sec = 0 THEN '' ELSE coalesce(nullif({STRIP.format(f"regexp_extract(line, '{S.NUMBERING}', 1)")}, ''), nullif({STRIP.format(f"regexp_extract(line, '{S.NUMBERING}', 2)")}, ''), nullif({STRIP.format(f"regexp_extract(line, '{S.NUMBERING}', 3)")}, ''), '') END AS title, content FROM n WHERE parts > 1""")
def numbered_sections(spark, sf_dir):
    """Documents as lists: a sentence a line, every other one numbered."""
    lines = F.transform(sentences(F.col("text")), lambda s, i: F.concat(F.when(i % 2 == 0, F.concat((i + 1).cast("string"), F.lit(". "))).otherwise(""), s))
    return S.numbered_sections(sources(spark, sf_dir).select("src_id", F.array_join(lines, "\n").alias("text")))


@query(f"WITH {SRC}, x AS (SELECT src_id, length(text) AS n FROM src) SELECT src_id, CAST(CASE WHEN n > 100000 THEN greatest(20000, n // 8) WHEN n > 50000 THEN greatest(12000, n // 8) ELSE least(16000, greatest(4000, n // 8)) END AS INTEGER) AS size FROM x")
def adaptive_chunk_size(spark, sf_dir):
    return sources(spark, sf_dir).select("src_id", S.adaptive_size(F.length("text")).alias("size"))


@query(f"WITH {SRC} SELECT src_id, CASE WHEN length(text) > 1000 THEN left(text, 500) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 500) ELSE text END AS text FROM src")
def middle_cut(spark, sf_dir):
    """Documents of more than 1000 characters without their middle."""
    return sources(spark, sf_dir).select("src_id", S.middle_cut(F.col("text"), 1000).alias("text"))


@query(f"""WITH parts AS ({_PARTS}), s AS (SELECT page_id, place, CASE WHEN place % 3 = 0 THEN '' ELSE left(text, 3) END AS title, left(text, 40) AS summary FROM parts)
SELECT page_id AS src_id, CASE WHEN trim(title) = '' THEN '未分类' ELSE trim(title) END AS section, CAST(count(*) AS INTEGER) AS chunks, min(place) AS first, string_agg(summary, chr(10) ORDER BY place) AS summary FROM s GROUP BY 1, 2""")
def section_groups(spark, sf_dir):
    """Paragraphs' beginnings, grouped by section; every third paragraph has none."""
    from corpusloom.operators import compile as C

    rows = P.paragraphs(table(spark, sf_dir, "pages"), 0)
    return C.section_groups(rows.select(F.col("page_id").alias("src_id"), F.col("place").alias("index"), F.when(F.col("place") % 3 == 0, "").otherwise(F.left("text", F.lit(3))).alias("title"), F.left("text", F.lit(40)).alias("summary")))


_T = STRIP.format("s")


@query(f"""WITH {SRC}, pc AS (SELECT src_id, list_filter(regexp_extract_all(text, '[^。！？!?]*[。！？!?]+\\s*|[^。！？!?]+$', 0, 's'), lambda s: s <> '') AS p FROM src), pr AS (SELECT src_id, CAST(unnest(range(len(p))) AS BIGINT) AS i, unnest(p) AS s FROM pc),
pl AS (SELECT *, sum(CASE WHEN length({_T}) >= 20 OR i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY src_id ORDER BY i) - 1 AS place, sum(length(s)) OVER (PARTITION BY src_id ORDER BY i) AS stop FROM pr),
ls AS (SELECT src_id, place, min(stop - length(s)) AS start, string_agg(s, '' ORDER BY i) AS sentence FROM pl GROUP BY 1, 2), v0 AS (SELECT src_id, place, {_V} AS v FROM ls), v1 AS (SELECT *, lead(v) OVER (PARTITION BY src_id ORDER BY place) AS w FROM v0),
d AS (SELECT src_id, place, round(1 - coalesce(list_dot_product(v, w) / nullif(sqrt(list_dot_product(v, v) * list_dot_product(w, w)), 0), 0), 6) AS distance FROM v1 WHERE w IS NOT NULL), b AS (SELECT src_id, round(quantile_cont(distance, 0.95), 6) AS bar FROM d GROUP BY src_id),
k AS (SELECT d.src_id, place + 1 AS place, CASE WHEN distance > bar THEN 1 ELSE 0 END AS br FROM d JOIN b USING (src_id)), g AS (SELECT ls.src_id, ls.place, start, sentence, sum(coalesce(br, 0)) OVER (PARTITION BY ls.src_id ORDER BY ls.place) AS grp FROM ls LEFT JOIN k USING (src_id, place)),
t AS (SELECT src_id, grp, min(start) AS start, string_agg(sentence, '' ORDER BY place) AS text FROM g GROUP BY 1, 2), w AS (SELECT src_id, start, text, unnest(range(CASE WHEN length(text) <= 800 THEN 1 ELSE CAST(ceil((length(text) - 800) / 680) AS INTEGER) + 1 END)) AS i FROM t),
s AS (SELECT src_id, start + i * 680 AS start, substring(text, i * 680 + 1, 800) AS s FROM w), c AS (SELECT src_id, CAST(start + length(s) - length(regexp_replace(s, '^\\s+', '')) AS INTEGER) AS start, {_T} AS content FROM s)
SELECT src_id, CAST(row_number() OVER (PARTITION BY src_id ORDER BY start) - 1 AS INTEGER) AS "index", start, CAST(start + length(content) AS INTEGER) AS "end", content FROM c WHERE content <> ''""")
def chunk_semantic_spans(spark, sf_dir):
    """Documents cut where the topic turns, as spans of the text, by the embedder that the session's settings name."""
    return S.semantic_spans(sources(spark, sf_dir), configured(spark, "embedder", "letters"), 800, 120)
