"""Line dedup by repeated runs of lines.

A text is cut into lines: after each newline, and inside a long line after each mark that ends a
clause. An ASCII mark ends one only before a blank or the line's end, so addresses, times and decimals
are whole. Of every pair of neighbouring lines that occurs again, in any document, the first occurrence
(smallest doc_id, then by a hash of the text, first place) stays and the others go, so a passage that
repeats goes from its first whole line to its last, whatever stands around it. A line goes if a pair
that goes holds it and no pair that stays does; runs of such lines below `least` characters stay, as
they are turns of phrase ("no, thanks."), not copied passages; with least = 0 they go too.

To find them not every pair is counted. Among every SPAN neighbouring lines the one with the least
hash starts a seed, the pair of it and the next line; which lines those are hangs on the SPAN lines
alone. So two texts that share more than SPAN whole lines in a row share a seed, at most SPAN - 1
lines from either end and SPAN lines from the next seed. Seeds are counted by hash, and every pair
near a repeated seed is then compared by its bytes with every other such pair. Shorter common runs
are found where a seed falls into them.

Only Spark SQL functions run. The table of the seeds' hashes is written, and counting works on that.
Counts and first places are aggregates that Spark combines before the shuffle, so a pair with any
share of the rows is no hot spot; they are written, so that the joins with them are ones that Spark
splits. Texts are shuffled twice: for documents with a repeated seed, to show the pairs near it, and
to take the lines out.

Cases: a null text stays null, an empty one empty; a text of one line stays as it is; rows that
repeat a doc_id and text count as one and keep the same text; of rows with one doc_id and different
texts, or without a doc_id, each is a document of its own; white space at a line's end is not compared;
a null doc_id sorts last; an empty table gives an empty result; other columns are kept as they are,
whatever they are called.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import let, new_path, removed, written

#: A line: up to a newline, or up to marks that end a clause and the blank after them. Every character is in a line.
#: {0} are marks that need a blank after them, {1} all marks. A line has at most 200 marks inside it, which bounds Java's stack.
LINE = r"[^\n{1}]*+(?:[{0}]++(?=[^ \n{1}])[^\n{1}]*+){{0,200}}+(?:[{1}]++ ?+)?+\n?+"
MARKS, MORE_MARKS = ".!?;:,", "。！？；：，、．؟؛،।"
SPAN = 4


def lines_of(text: Column) -> Column:
    """array<string>: the lines of a text. Joined, they are the text."""
    # What is found last is the empty line at the text's end.
    found = lambda marks: let(F.regexp_extract_all(text, F.lit(LINE.format(MARKS, marks)), F.lit(0)), lambda x: F.slice(x, F.lit(1), F.size(x) - 1))
    # Java matches a class of ASCII marks faster, and gives the same lines where no other mark is; none is where their first bytes are not.
    raw = text.cast("binary")
    more = (F.octet_length(text) > F.length(text)) & reduce(or_, (F.contains(raw, F.lit(bytes([b]))) for b in sorted({m.encode()[0] for m in MORE_MARKS})))
    return F.when(more, found(MARKS + MORE_MARKS)).otherwise(found(MARKS))


def bare(line: Column) -> Column:
    """A line as it is compared: without blanks and newlines at its end."""
    return F.rtrim(F.replace(line, F.lit("\n"), F.lit(" ")))  # trimming blanks alone is many times faster than trimming a set


def parts_of(text: Column) -> Column:
    """array<struct<body>>: the lines of a text, in order."""
    return F.transform(lines_of(text), lambda x: F.struct(x.alias("body")))


def with_seeds(rows: DataFrame) -> DataFrame:
    """rows (text) with seeds: array<struct<hash, place>>, the pairs of lines, by the place (from 0) of the first, that start at a least hash of SPAN lines; none in a text of one line.

    Step by step in columns, so that each is worked out once; a filter here would be moved before them, and repeat them.
    """
    h, m, n = F.col("__h"), F.col("__m"), F.size("__h")
    rows = rows.withColumn("__h", F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(bare(x))))
    rows = rows.withColumn("__m", F.transform(h, lambda x, i: F.least(x, *(F.get(h, i + k) for k in range(1, SPAN)))))
    rows = rows.withColumn("__m", F.slice(m, F.lit(1), F.greatest(n - (SPAN - 1), F.lit(1))))  # of whole spans alone
    # A hash is the least of some span with it if it equals the greatest of these spans' least ones.
    at = F.transform(h, lambda x, i: F.when((x == F.greatest(*(F.get(m, i - k) for k in range(SPAN)))) & (n > 1), F.least(i, n - 2)))
    rows = rows.withColumn("__at", F.array_distinct(F.array_compact(at)))
    return rows.withColumn("seeds", F.transform("__at", lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1)).alias("hash"), i.alias("place")))).drop("__h", "__m", "__at")


def with_pairs(rows: DataFrame) -> DataFrame:
    """rows (text, places) with pairs: array<struct<place, body>>, the pairs of lines less than SPAN lines from the seeds at these places.

    Step by step in columns, as in `without`; a line is made bare once, not once for each pair that holds it.
    """
    lines = F.col("__lines")
    rows = rows.withColumn("__lines", F.transform(lines_of(F.col("text")), bare)).withColumn("__last", F.size(lines) - 2)
    near = F.transform("places", lambda i: F.sequence(F.greatest(i - (SPAN - 1), F.lit(0)), F.least(i + (SPAN - 1), F.col("__last"))))
    rows = rows.withColumn("__near", F.array_distinct(F.flatten(near)))
    pair = lambda i: F.struct(i.alias("place"), F.concat(F.get(lines, i), F.lit("\n"), F.get(lines, i + 1)).alias("body"))
    return rows.withColumn("pairs", F.transform("__near", pair)).drop("__lines", "__last", "__near")


KEY = ["doc_id", "row_key"]


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), doc_id and row_key, a hash of the text: two texts are taken for one only if doc_id, hash and length agree."""
    key = F.xxhash64(docs["text"], F.length(docs["text"]))
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), key.alias("row_key"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row_key"] == b["row_key"])


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, gone, held: the places of the pairs that go, and of those that occur again and stay. Intermediate tables go as soon as the next one is there."""
    spark = docs.sparkSession
    at = {tag: new_path(spark, tag) for tag in ("seeds", "often", "pairs", "again", "repeats", "first", "gone")}
    texts = _keyed(docs).select(*KEY, F.col("row.text").alias("text")).where("text IS NOT NULL")
    table = written(with_seeds(texts).select(*KEY, "seeds"), "seeds", at["seeds"])
    seeds = table.select(*KEY, F.explode("seeds").alias("s")).select(*KEY, "s.*")
    # Written first: then both sides of the joins are plain shuffles, and Spark can split a pair that has very many rows.
    often = written(seeds.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash"), "often", at["often"])
    wanted = seeds.join(often, "hash").groupBy(*KEY).agg(F.collect_set("place").alias("places"))
    shown = with_pairs(texts.join(wanted, _same(texts, wanted)).select(texts["doc_id"], texts["row_key"], "text", "places"))
    # Outer: else a test of emptiness would be moved before the steps, and repeat them. Texts without pairs have null ones, which go.
    shown = shown.select(*KEY, F.inline_outer("pairs")).where("body IS NOT NULL")
    shown = written(shown.select(*KEY, "place", "body"), "pairs", at["pairs"])
    _drop(spark, at, "seeds", "often")
    again = shown.groupBy("body").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("times")).where("times > 1").drop("times")
    met = shown.join(written(again, "again", at["again"]), "body").withColumn("keeps", F.col("doc_id").eqNullSafe(F.col("keeper")))
    met = written(met.select("body", *KEY, "place", "keeps"), "repeats", at["repeats"])
    _drop(spark, at, "pairs", "again")
    # One number for text and place: a minimum of a number is worked out by hash, one of a pair by sorting.
    order = F.col("row_key").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("place").cast("decimal(10,0)")
    first = written(met.where("keeps").groupBy("body").agg(F.min(order).alias("first")), "first", at["first"])
    stays = F.col("keeps") & (order == F.col("first"))
    met = met.join(first, "body").groupBy(*KEY).agg(F.collect_set(F.when(~stays, F.col("place"))).alias("gone"), F.collect_set(F.when(stays, F.col("place"))).alias("held"))
    out = written(met.where(F.size("gone") > 0), "gone", at["gone"])
    _drop(spark, at, "repeats", "first")
    return out


def _drop(spark: SparkSession, at: dict[str, str], *tags: str) -> None:
    for tag in tags:
        removed(spark, at[tag])


def without(rows: DataFrame, least: int) -> DataFrame:
    """rows (text, gone, held, ...) with left: the text without the lines of the pairs in gone that no pair in held has, where at least `least` characters in a row go.

    Step by step in columns: Spark works out types anew for each element of nested higher-order functions.
    """
    both = lambda places: F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1))))
    lines, g, runs = F.col("lines"), F.col("goes"), F.col("runs")
    rows = rows.withColumns({"lines": lines_of(F.col("text")), "goes": F.array_sort(F.array_except(both("gone"), both("held")))})
    starts = F.filter(g, lambda x, k: (k == 0) | (F.get(g, k - 1) != x - 1))
    ends = F.filter(g, lambda x, k: (k == F.size(g) - 1) | (F.get(g, k + 1) != x + 1))
    rows = rows.withColumn("runs", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    if least:
        rows = rows.withColumn("runs", F.filter(runs, lambda r: F.length(F.array_join(F.slice(lines, r["a"] + 1, r["b"] - r["a"] + 1), "")) >= least))
    firsts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["b"] + 1))
    lasts = F.concat(F.transform(runs, lambda r: r["a"]), F.array(F.size(lines)))
    return rows.withColumn("left", F.array_join(F.zip_with(firsts, lasts, lambda a, b: F.array_join(F.slice(lines, a + 1, b - a), "")), ""))


def dedup_lines(docs: DataFrame, least: int = 40) -> DataFrame:
    """docs with all its columns and rows, text without repeated runs of lines."""
    gone, rows = removals(docs), _keyed(docs)
    joined = rows.join(gone, _same(rows, gone), "left").withColumn("text", F.when(F.col("gone").isNotNull(), F.col("row.text")))
    return without(joined, least).select(*(F.coalesce("left", "row.text").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def with_length(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if it has that column, as the length of its text."""
    return docs.select(*(F.length(docs["text"]).cast(t).alias(c) if c == "n_chars" else docs[f"`{c}`"] for c, t in docs.dtypes))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup: doc_id, text, chars_before, chars_after."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_lines(docs.select("doc_id", "text", F.length("text").cast("long").alias("chars_before")))
    return out.select("doc_id", "text", "chars_before", F.length("text").cast("long").alias("chars_after"))
