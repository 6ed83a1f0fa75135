"""Documents to structured summaries, without a model by default: extracts and TF-IDF terms.

A model can take the place of `extractive` as any function DataFrame -> DataFrame with the same
columns (see `plugins`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import cut, first_sentences, strip
from corpusloom.operators.retrieval import spread
from corpusloom.plugins import Registry
from corpusloom.sources.store import written

# Fixed value: stands for an explanation that was not found.
DEFAULT_EXPLANATION = "（详细解释请参阅原文）"
# Fixed value: the section of chunks without a title.
NO_SECTION = "未分类"
# How many key points a summary has at most, and a key point's letters at least.
POINTS, POINT_LETTERS = 5, 15
#: What every task is told of document frequencies: those of so many words, and two numbers for each bucket of the others by hash (a power of two).
FREQUENT, BUCKETS = 1 << 18, 1 << 20


def _words(text: Column | None = None) -> Column:
    """array<string>: the words of four letters or more of `text`."""
    return F.regexp_extract_all(F.lower("text" if text is None else text), F.lit(r"\p{L}{4,}+"), F.lit(0))


def _repeated(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def term_counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, terms (array<struct<word, tf>>): the words of each text, counted inside its row."""
    rows = docs.select("doc_id", F.coalesce(F.sort_array(_words()), F.array().cast("array<string>")).alias("w"))
    rows = rows.withColumn("at", F.filter(F.transform("w", lambda x, i: F.when((i == 0) | (F.get("w", i - 1) != x), i)), lambda i: i.isNotNull()))
    times = lambda i, k: F.coalesce(F.get("at", k + 1), F.size("w")) - i
    return rows.select("doc_id", F.transform("at", lambda i, k: F.struct(F.get("w", i).alias("word"), times(i, k).cast("long").alias("tf"))).alias("terms"))


def may_lead(df: DataFrame, n: int, top: int) -> Callable[[Column, Column], Column]:
    """A function of a document's arrays of tf and of words' hashes that gives the places of the terms that can be among its `top` best.

    df (word, df) becomes two tables of bounded size: the frequencies of up to FREQUENT words, the most
    frequent ones, by hash, and for the others the least and the greatest of those whose hashes share a
    bucket. So a term's score lies between two numbers; what cannot reach the score that `top` terms
    have at least is left out.
    """
    sizes = sorted((r["df"], r["count"]) for r in df.groupBy("df").count().collect())  # a row for each frequency
    words, bar = 0, 0  # words above the bar are in the first table
    for times, count in reversed(sizes):
        if words + count > FREQUENT:
            bar = times
            break
        words += count
    ends = (F.min("df").alias("least"), F.max("df").alias("most"))
    hashed = df.withColumn("hash", F.xxhash64("word"))
    often = hashed.groupBy("hash").agg(*ends).where(F.col("most") > bar).toArrow()
    rest = hashed.where(F.col("df") <= bar).groupBy(F.expr(f"pmod(hash, {BUCKETS})").cast("int").alias("bucket")).agg(*ends).toArrow()
    numbers = lambda rows, c: rows.column(c).to_numpy()
    idf = lambda rows, c: np.log(n / numbers(rows, c)).astype(np.float32)
    order = np.argsort(numbers(often, "hash"))
    known = np.append(numbers(often, "hash")[order], 0)  # one more: a place behind the last one
    known_low, known_high = (np.append(idf(often, c)[order], np.float32(0)) for c in ("most", "least"))
    low, high = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    low[numbers(rest, "bucket")], high[numbers(rest, "bucket")] = idf(rest, "most"), idf(rest, "least")

    @F.arrow_udf("array<int>")
    def places(tf: pa.Array, hashes: pa.Array) -> pa.Array:
        sizes = tf.value_lengths().to_numpy(zero_copy_only=False)
        times, of = tf.flatten().to_numpy().astype(np.float64), hashes.flatten().to_numpy()
        begins = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at, bucket = np.searchsorted(known[:-1], of), of & (BUCKETS - 1)
        held = known[at] == of
        held &= at < len(known) - 1
        least, most = times * np.where(held, known_low[at], low[bucket]), times * np.where(held, known_high[at], high[bucket])
        ordered = least[np.lexsort((-least, doc))]
        enough = np.full(len(sizes), -np.inf)
        full = sizes >= top
        enough[full] = ordered[begins[full] + top - 1]
        # Bounds have 24 bits and scores 6 decimals: what is as near as that stays.
        keep = most >= enough[doc] - np.abs(enough[doc]) * 1e-6 - 1e-5
        offsets = np.append(0, np.cumsum(np.bincount(doc[keep], minlength=len(sizes))))
        place = np.arange(len(doc)) - np.repeat(begins, sizes)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place[keep], pa.int32()))

    return places


def tfidf_terms(docs: DataFrame, top: int = 5, most_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, word, tf, score, rank: the terms that tell a document from the others; ties by word.

    In a small input all counts meet the document frequencies, in one job. In a larger one words are
    counted inside each text's row, and only words with their frequency are shuffled: tables of
    frequencies of a bounded size tell every task which terms of a document cannot be among its best
    (see may_lead), and the others meet their own frequency by a join.
    """
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 62:  # not known to Spark
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= most_bytes:
        words = spread(docs.select("doc_id", "text")).select("doc_id", F.explode(_words()).alias("word"))
        tf = words.groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
        df = tf.groupBy("word").agg(F.count_if(F.col("tf") > 0).alias("df"))  # reads the counts, so that both sides of the join are one shuffle
        n = F.broadcast(docs.agg(F.count("*").alias("n")))
        found = tf.crossJoin(n)
    else:
        n = docs.count()
        if _repeated(docs):  # rows of one id are one document
            docs = docs.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
        terms = written(term_counts(docs), "terms")
        df = written(terms.select(F.explode("terms.word").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "frequencies")
        places = may_lead(df, max(n, 1), top)(F.col("terms.tf"), F.transform("terms.word", lambda x: F.xxhash64(x)))
        found = terms.withColumn("places", places).select("doc_id", F.explode(F.transform("places", lambda i: F.get("terms", i))).alias("t"))
        found = found.select("doc_id", "t.word", "t.tf", F.lit(n).alias("n"))
    scored = found.join(df, "word").withColumn("score", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "word"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("doc_id", "word", "tf", "score", "rank")


def context_parts(text: Column) -> Column:
    """array<string>: the parts of a text in which concepts are looked for."""
    return F.filter(F.transform(cut(text, r"[。！？\n]", r"\n"), strip), lambda s: F.length(s) > 5)


def concept_context(name: Column, parts: Column, most: int = 200) -> Column:
    """Up to two parts of a text (see context_parts) that hold the name, else its part before a dash or colon, else it without blanks."""
    core = F.trim(F.element_at(F.split(name, r"[:：\-—–(（]"), 1))

    def shown(word: Column) -> Column:
        found = F.array(F.slice(F.filter(parts, lambda s: F.contains(s, word)), 1, 2))  # in an array, so that it is worked out once
        return F.get(F.transform(found, lambda f: F.when(F.size(f) > 0, F.left(F.array_join(f, "。"), F.lit(most)))), F.lit(0))

    by_core = F.when((F.length(core) >= 2) & (core != name), shown(core))
    bare = F.when(F.contains(name, F.lit(" ")), shown(F.replace(name, F.lit(" "), F.lit(""))))  # else it is the name again
    return F.coalesce(shown(name), by_core, bare, F.concat(name, F.lit(DEFAULT_EXPLANATION)))


def extractive(docs: DataFrame) -> DataFrame:
    """docs (src_id, doc_id, title, type, text) with one_line, key_points, detailed_summary, concepts; explanations are looked for in the whole text."""
    found = tfidf_terms(docs).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("names"))
    rows = docs.join(found, "doc_id", "left").withColumns({"s": _first(), "parts": context_parts(F.col("text"))})
    concepts = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), concept_context(n, F.col("parts")).alias("explanation")))
    return rows.select("src_id", "doc_id", "title", "type", "text", *_extracts(), concepts.alias("concepts"))


def _first() -> Column:
    """The sentences that _extracts needs."""
    return first_sentences(F.col("text"), POINTS, POINT_LETTERS)


def _extracts() -> tuple[Column, ...]:
    """What is taken from a text and its sentences `s`."""
    points = F.slice(F.filter("s", lambda x: F.length(x) >= POINT_LETTERS), 1, POINTS)
    return F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("one_line"), points.alias("key_points"), F.left("text", F.lit(1500)).alias("detailed_summary")


def outlined(docs: DataFrame, top: int = 5) -> DataFrame:
    """What `extractive` gives, with the number of concepts (n_concepts) in place of them.

    A document has as many concepts as it has different words, `top` at most, so the number needs no
    frequencies of the corpus: it is counted inside the text's row, and nothing is shuffled. Where a
    text's first 1000 letters hold more than enough, the rest is not cut into words. (Two more than
    `top`: a beginning may end in a part of a word, or after a sigma that is no word's last letter.)
    """
    words = F.array_distinct(_words())
    many = F.size(F.array_distinct(_words(F.left("text", F.lit(1000))))) >= top + 2
    rows = docs.withColumns({"s": _first(), "n_words": F.when(many, top).otherwise(F.size(words))})
    if _repeated(docs):  # rows of one id are one document
        whole = docs.groupBy("doc_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list(words)))).alias("n_words"))
        rows = rows.drop("n_words").join(whole, "doc_id")
    number = F.least(F.coalesce("n_words", F.lit(0)), F.lit(top))
    return rows.select("src_id", "doc_id", "title", "type", "text", *_extracts(), F.greatest(number, F.lit(0)).alias("n_concepts"))


def merged(parts: DataFrame) -> DataFrame:
    """Summaries of a document's chunks (src_id, index, title, key_points, summary) as one.

    Merging is associative, so the levels of a tree of merges come to one aggregation.
    """
    rows = parts.groupBy("src_id").agg(F.array_sort(F.collect_list(F.struct("index", "key_points", "summary"))).alias("p"))
    points = F.array_distinct(F.flatten(F.transform("p", lambda x: x["key_points"])))
    return rows.select("src_id", F.size("p").alias("chunks"), points.alias("key_points"), F.array_join(F.transform("p", lambda x: x["summary"]), "\n\n").alias("detailed_summary"))


def summary_markdown(compiled: DataFrame) -> DataFrame:
    """src_id, markdown: title, Key Points, Detailed Summary, Concepts as [[links]]."""
    points = F.array_join(F.transform("key_points", lambda k: F.concat(F.lit("- "), k)), "\n")
    links = F.array_join(F.transform("concepts", lambda c: F.concat(F.lit("- [["), c["name"], F.lit("]]"))), "\n")
    return compiled.select("src_id", F.concat(F.lit("# "), "one_line", F.lit("\n\n## Key Points\n"), points, F.lit("\n\n## Detailed Summary\n"), "detailed_summary", F.lit("\n\n## Concepts\n"), links, F.lit("\n")).alias("markdown"))


def parsed_markdown(files: DataFrame) -> DataFrame:
    """files (src_id, markdown) -> src_id, one_line, key_points (3 at most), content."""
    head = F.trim(F.regexp_extract("markdown", r"(?m)^# (.*)$", 1))
    block = F.regexp_extract("markdown", r"(?is)\n## key points\n(.*?)(?:\n## |$)", 1)
    points = F.slice(F.transform(F.filter(F.split(block, "\n"), lambda x: F.startswith(strip(x), F.lit("- "))), lambda x: F.substr(strip(x), F.lit(3))), 1, 3)
    rows = files.select("src_id", head.alias("one_line"), points.alias("key_points"))
    shown = F.concat(F.when(F.col("one_line") != "", F.array("one_line")).otherwise(F.array().cast("array<string>")), F.transform("key_points", lambda k: F.concat(F.lit("• "), k)))
    return rows.withColumn("content", F.array_join(shown, "\n"))


def concept_rows(compiled: DataFrame) -> DataFrame:
    """src_id, place, name, explanation."""
    return compiled.select("src_id", F.posexplode("concepts").alias("place", "c")).select("src_id", "place", "c.name", "c.explanation")


def concept_artifacts(compiled: DataFrame) -> DataFrame:
    """src_id, name, file_name: a name that an earlier source has taken gets its source's id as suffix."""
    rows = concept_rows(compiled)
    # The first is a minimum that combines before the shuffle; a concept with any number of sources is no hot window.
    first = rows.groupBy("name").agg(F.min(F.struct("src_id", "place")).alias("first"))
    taken = F.struct("src_id", "place") != F.col("first")
    return rows.join(first, "name").select("src_id", "name", F.when(taken, F.concat("name", F.lit("_"), "src_id")).otherwise(F.col("name")).alias("file_name"))


def concept_markdown(compiled: DataFrame) -> DataFrame:
    """src_id, name, markdown: a concept with its explanation and links to the concepts beside it."""
    links = lambda own: F.array_join(F.transform(F.filter("concepts", lambda c: c["name"] != own), lambda c: F.concat(F.lit("[["), c["name"], F.lit("]]"))), ", ")
    rows = compiled.select("src_id", "concepts", F.explode("concepts").alias("c"))
    return rows.select("src_id", F.col("c.name").alias("name"), F.concat(F.lit("# "), "c.name", F.lit("\n\n"), "c.explanation", F.lit("\n\n"), links(F.col("c.name")), F.lit("\n")).alias("markdown"))


def parsed_concept(files: DataFrame) -> DataFrame:
    """files (src_id, markdown) -> src_id, name, definition: the title, and all lines with text that are no headings, up to the first section that is not the definition's."""
    name = F.trim(F.regexp_extract("markdown", r"(?m)^# (.*)$", 1))
    # Fixed value: the section of the definition.
    other = lambda x: F.startswith(x, F.lit("## ")) & ~F.startswith(x, F.lit("## 定义"))
    rows = files.select("src_id", name.alias("name"), F.split("markdown", "\n").alias("lines"))
    rows = rows.withColumn("stop", F.array_position(F.transform("lines", other), True).cast("int"))
    own = F.when(F.col("stop") > 0, F.slice("lines", F.lit(1), F.col("stop") - 1)).otherwise(F.col("lines"))
    body = F.filter(own, lambda x: (strip(x) != "") & ~F.startswith(x, F.lit("#")))
    return rows.select("src_id", "name", strip(F.array_join(body, "\n")).alias("definition"))


def section_groups(parts: DataFrame) -> DataFrame:
    """parts (src_id, index, title, summary) -> src_id, section, chunks, summary: chunk summaries by section, those without a title together."""
    name = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.lit(NO_SECTION)).otherwise(F.trim("title"))
    rows = parts.groupBy("src_id", name.alias("section")).agg(F.array_sort(F.collect_list(F.struct("index", "summary"))).alias("p"))
    return rows.select("src_id", "section", F.size("p").alias("chunks"), F.get("p", F.lit(0))["index"].alias("first"), F.array_join(F.transform("p", lambda x: x["summary"]), "\n").alias("summary"))


def preferred(results: DataFrame) -> DataFrame:
    """results (src_id, model, priority, summary) -> src_id, model, summary: the first model in order of priority that gave one."""
    given = F.when(F.col("summary").isNotNull() & (F.trim("summary") != ""), F.struct("priority", "model", "summary"))
    return results.groupBy("src_id").agg(F.min(given).alias("r")).where("r IS NOT NULL").select("src_id", "r.model", "r.summary")


def compile_job(docs: DataFrame, plugins: Registry, compiler: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Compile docs through plug-ins: parsers of the text, steps before, the model, else `compiler` or the extracts, steps after."""
    text = plugins.first("ingest_parser", F.col("text"), F.col("text"))
    rows = plugins.apply("pre_compile", docs.withColumn("text", text))
    model = plugins.active("compile_model")
    return plugins.apply("post_compile", (model[0] if model else compiler or extractive)(rows))


def vector_documents(compiled: DataFrame) -> DataFrame:
    """collection, id, document: what is embedded of a summary and of its concepts."""
    whole = F.concat_ws("\n", F.array("one_line"), "key_points", F.array(F.left("detailed_summary", F.lit(2000))))
    summaries = compiled.select(F.lit("summaries").alias("collection"), F.col("src_id").alias("id"), whole.alias("document"))
    concepts = concept_rows(compiled).select(F.lit("concepts").alias("collection"), F.concat("src_id", F.lit("_"), F.col("place").cast("string")).alias("id"), F.concat("name", F.lit(": "), "explanation").alias("document"))
    return summaries.union(concepts)
