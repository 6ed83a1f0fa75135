"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document if at least `least` of the item's distinct word shingles occur in
it. Items are partitioned by their number of shingles, in powers of two; an item's sketch is its
MinHash, the k smallest of its shingle hashes, where k = floor((1 - least) * top) + 1 is fixed by the
top of its size class. A document that holds an item misses at most floor((1 - least) * n) of its n
shingles, fewer than k, so it holds at least one hash of the sketch: the search over sketches finds
every such pair, however long the document. Each pair found is verified on the words themselves.

Only Spark SQL functions run. Items are few as a rule; while their sketches are within `most_sketch`
hashes, their set is tested inside the scan of the documents and what is shuffled are the documents
that hold one of them. Beyond it, documents' hashes pass a bitmap of the sketches and meet them in a
shuffled join. Both ways end in the same table of pairs, and in the same verification.

Words are runs of letters, marks and digits in lower case. An item of fewer words than a shingle is
one shingle, and must occur as a whole.

Cases: a null text has no words; items without words match nothing; documents without words hold no
item; documents that repeat yield a row each, also without a doc_id; items that repeat count once, and
one item_id with two texts is two items; ties do not arise; empty tables give empty results; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import IDENTITY, body_of, id_text, identified, let, written

WORD_GAPS = r"[^\p{L}\p{M}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case words."""
    return F.filter(F.split(F.lower(text), WORD_GAPS), lambda w: w != "")


def shingle_hashes(words: Column, width: int) -> Column:
    """A hash for each run of `width` words, from the words' own hashes."""

    def runs(hashed: Column) -> Column:
        n = F.size(hashed)
        ends = F.when(n >= width, F.sequence(F.lit(width), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(ends, lambda i: F.xxhash64(*(F.get(hashed, i - F.lit(width - k)) for k in range(width))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def items_of(benchmark: DataFrame, width: int, least: float) -> DataFrame:
    """item_id, width, shingles (distinct, as text between blanks), sketch."""
    base = benchmark.select(F.col("item_id"), words_of(F.coalesce("text", F.lit(""))).alias("words")).where(F.size("words") > 0)
    base = base.withColumn("width", F.least(F.size("words"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("width") + 1)
    base = base.withColumn("shingles", F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("width")), " "))))
    hashed = F.lit(None).cast("array<long>")
    for k in range(1, width + 1):
        hashed = F.when(F.col("width") == k, shingle_hashes(F.col("words"), k)).otherwise(hashed)
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("shingles"))))  # of its size class
    k = (F.floor((1 - F.lit(least)) * top + 1e-9) + 1).cast("int")
    return base.select("item_id", "width", "shingles", F.slice(F.array_sort(F.array_distinct(hashed)), F.lit(1), k).alias("sketch"))


def contained(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.8, most_sketch: int = 20_000) -> DataFrame:
    """doc_id, item_id, containment of every document and item with containment >= least."""
    return _held(id_text(docs).select("doc_id", "text", body_of(F.col("text")).alias("body")), benchmark, width, least, most_sketch).select("doc_id", "item_id", "containment")


def _held(rows: DataFrame, benchmark: DataFrame, width: int, least: float, most_sketch: int) -> DataFrame:
    """rows (text, body, ...) -> rows without text, and item_id, containment: a row for every item that the text holds.

    What a text holds hangs on the text alone, so candidates are pairs of a text's digest and an item.
    """
    items = written(items_of(benchmark, width, least).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most `width` numbers
    sketches = written(items.select("item", F.explode("sketch").alias("hash")), "sketches")
    size = sketches.count()
    rows = rows.withColumn("words", words_of(F.col("text"))).drop("text")
    hashes = F.flatten(F.array(*(shingle_hashes(F.col("words"), k) for k in widths))) if widths else F.array().cast("array<long>")
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    if size <= most_sketch:
        known = [r.hash for r in sketches.select("hash").distinct().collect()]  # at most most_sketch
        hits = F.filter(hashes, lambda h: h.isin(known)) if known else F.array().cast("array<long>")
        found = rows.withColumn("hits", F.array_distinct(hits)).where(F.size("hits") > 0)
        rows = written(found.withColumn("line", line).drop("words"), "candidates")
        met = rows.select("body", F.explode("hits").alias("hash"))
        rows = rows.drop("hits")
    else:
        # A bit for every 2^-20 of the hashes' range: at most 2^14 longs go to the driver and back.
        slot = lambda h: F.shiftrightunsigned(h, 50).cast("int")
        set_bits = dict(map(tuple, sketches.groupBy(slot(F.col("hash"))).agg(F.bit_or(_bit(F.col("hash")))).collect()))
        bitmap = F.from_json(F.lit(str([set_bits.get(i, 0) for i in range(1 << 14)])), "array<long>")  # folded to a constant
        maybe = lambda h: F.get(bitmap, slot(h)).bitwiseAND(_bit(h)) != 0
        met = rows.select("body", F.explode(F.filter(F.array_distinct(hashes), maybe)).alias("hash"))
        rows = rows.withColumn("line", line).drop("words")
    pairs = met.join(sketches, "hash").select("body", "item").distinct().join(items.select("item", "item_id", "shingles"), "item")
    share = _share(F.col("line"), F.col("shingles"))
    checked = rows.join(pairs, "body").withColumn("containment", share).where(F.col("containment") >= least)
    return checked.drop("line", "shingles", "item", "body")


def _bit(h: Column) -> Column:
    """The bit of a hash inside its long of the bitmap."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 44).bitwiseAND(F.lit(63)).cast("int"))


def _share(line: Column, shingles: Column) -> Column:
    """The part of the shingles that occur in the line, word for word."""
    held = F.filter(shingles, lambda s: F.contains(line, F.concat(F.lit(" "), s, F.lit(" "))))
    return F.size(held) / F.size(shingles)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.8, most_sketch: int = 20_000) -> DataFrame:
    """The rows of docs, all columns, that hold no item. A row is judged by its own text, whatever rows share its doc_id or have none."""
    rows = identified(docs)
    texts = rows.select(*IDENTITY, F.coalesce("row.text", F.lit("")).alias("text"))
    # The digest goes twice: once to meet candidates, once to meet the rows again.
    leaks = written(_held(texts.withColumnRenamed("body", "own").withColumn("body", F.col("own")), benchmark, width, least, most_sketch).select("id", "no_id", F.col("own").alias("body")).distinct(), "leaks")
    return rows.join(leaks, IDENTITY, "left_anti").select("row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item with containment of 0.8 or more: doc_id, item_id, containment."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contained(docs, benchmark)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS words FROM documents),
i AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS words FROM benchmark),
s AS (SELECT row_number() OVER () AS item, item_id, least(5, len(words)) AS k, list_distinct(list_transform(range(1, len(words) - least(5, len(words)) + 2), lambda j: array_to_string(words[j:j + least(5, len(words)) - 1], ' '))) AS shingles FROM i WHERE len(words) > 0),
e AS (SELECT item, item_id, k, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
x AS (SELECT row, doc_id, k, unnest(list_distinct(list_transform(range(1, len(words) - k + 2), lambda j: array_to_string(words[j:j + k - 1], ' ')))) AS shingle FROM d, (SELECT DISTINCT k FROM s) WHERE len(words) >= k)
SELECT doc_id, item_id, count(*) / any_value(n)::DOUBLE AS containment FROM x JOIN e USING (k, shingle) GROUP BY row, doc_id, item, item_id HAVING count(*) / any_value(n)::DOUBLE >= 0.8
"""
