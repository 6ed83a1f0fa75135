"""Manifest tables: sources with ids, hashes, categories, listings, counts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.store import written

# Which folder a file's extension goes to.
CATEGORY = {
    ".pdf": "pdfs", ".doc": "pdfs", ".docx": "pdfs", ".txt": "articles", ".html": "articles", ".htm": "articles", ".md": "articles",
    ".mobi": "ebooks", ".epub": "ebooks",
    ".mp3": "audio", ".m4a": "audio", ".wav": "audio", ".flac": "audio", ".aac": "audio", ".ogg": "audio",
    ".mp4": "videos", ".mkv": "videos", ".avi": "videos", ".mov": "videos", ".wmv": "videos",
}
# Extensions that are not taken in.
SKIPPED = (
    ".exe .dll .so .dylib .deb .rpm .zip .rar .7z .tar .gz .bz2 .jpg .jpeg .png .gif .bmp .svg .webp .ico .mpv .srt .ass .vtt .lrc "
    ".json .xml .yaml .yml .toml .ini .cfg .py .js .sh .bat .ps1"
).split()
# Kinds of sources in the order in which they are compiled.
TYPE_PRIORITY = ("article", "pdf", "ebook", "other", "video", "audio")


def sources(documents: DataFrame) -> DataFrame:
    """documents -> src_id, doc_id, title (first line), type, text, size_bytes, content_hash."""
    return documents.select(
        F.format_string("SRC-%04d", "doc_id").alias("src_id"),
        "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("type"),
        "text",
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.sha2("text", 256).alias("content_hash"),
    )


def category(extension: Column) -> Column:
    """Folder of an extension; null for skipped ones, `other` for unknown ones."""
    known = F.create_map(*(F.lit(x) for pair in CATEGORY.items() for x in pair))
    low = F.lower(extension)
    return F.when(low.isin(SKIPPED), None).otherwise(F.coalesce(F.try_element_at(known, low), F.lit("other")))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """rows with their number, from 1, among those with the same values of `by`, in the order of columns without ties.

    Rows are dealt by ranges of (by, order), and the dealt table is written, so that sizes and rows
    are of one dealing. A row's number is its number in its range plus the rows of its key in the
    ranges before, so one key may have any share of the rows: it fills several ranges. Only sizes,
    a row for each range and key in it, meet again.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "dealt")
    dealt = dealt.withColumn("__key", F.to_json(F.struct(*by)) if by else F.lit(""))  # a null has its own key
    sizes = dealt.groupBy("__part", "__key").agg(F.count("*").alias("__size"))
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", "__key", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part", "__key").orderBy(*order))
    met = dealt.withColumn("__own", own).join(starts if by else F.broadcast(starts), ["__part", "__key"])  # without keys a row for each range
    return met.withColumn(name, F.col("__start") + F.col("__own")).drop("__part", "__key", "__start", "__own")


def with_sequential_ids(rows: DataFrame, order: str, first: int = 1) -> DataFrame:
    """rows with seq = first, first + 1, ... in the order of a column without ties."""
    return numbered(rows, [], [order], "seq").withColumn("seq", F.col("seq") + (first - 1))


def first_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def new_content(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose content_hash is not known, the first of each hash by doc_id."""
    return first_per(rows.join(known.select("content_hash"), "content_hash", "left_anti"), ["content_hash"], F.col("doc_id"))


def allocated_names(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with unique_name: the name, and `_1`, `_2` ... from its second row on; the order's columns have no ties."""
    n = F.col("__n") - 1
    return numbered(rows, [name], list(order), "__n").withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n.cast("string")))).drop("__n")


def listing(manifests: DataFrame, *order: Column, offset: int = 0, limit: int = 50, status: str | None = None) -> DataFrame:
    """A page of the index columns."""
    rows = manifests if status is None else manifests.where(F.col("status") == status)
    return rows.select("src_id", "title", "type", "status", "quality_score").orderBy(*order).offset(offset).limit(limit)


def patched(manifests: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply patches (src_id, seq, status, quality_score, error_message, promoted_to), the last of each source.

    A null keeps a field; a score counts above 0 only; an empty promoted_to clears it; a failure does
    not overwrite a compiled or promoted source. Patches with a column `at` also date the states that
    they bring: date_compiled and date_failed, which otherwise stay as manifests has them (null if it has none).
    """
    dated = "at" in patches.columns
    last = patches.groupBy("src_id").agg(F.max_by(F.struct("status", "quality_score", "error_message", "promoted_to", *(["at"] if dated else [])), "seq").alias("p"))
    done = F.col("status").isin("compiled", "promoted_to_wiki", "promoted")
    ignored = (F.col("p.status") == "failed") & done
    take = lambda c, v: F.when(F.coalesce(ignored, F.lit(False)) | F.col("p").isNull(), F.col(c)).otherwise(v)
    promoted = F.when(F.col("p.promoted_to") == "", None).otherwise(F.coalesce("p.promoted_to", "promoted_to"))
    dates = {}
    for name, status in (("date_compiled", "compiled"), ("date_failed", "failed")) if dated else ():
        before = F.col(name) if name in manifests.columns else F.lit(None).cast("timestamp")
        dates[name] = F.when(F.col("p").isNull() | ignored | (F.coalesce("p.status", F.lit("")) != status), before).otherwise(F.coalesce("p.at", before))
    patched_fields = ("status", "quality_score", "error_message", "promoted_to", *dates)
    return manifests.join(last, "src_id", "left").select(
        *(c for c in manifests.columns if c not in patched_fields),
        *(c.alias(name) for name, c in dates.items()),
        take("status", F.coalesce("p.status", "status")).alias("status"),
        take("quality_score", F.when(F.col("p.quality_score") > 0, F.col("p.quality_score")).otherwise(F.col("quality_score"))).alias("quality_score"),
        take("error_message", F.coalesce("p.error_message", "error_message")).alias("error_message"),
        take("promoted_to", promoted).alias("promoted_to"),
    )


def without_known_names(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose name has not been taken in yet."""
    return rows.join(known.select("name"), "name", "left_anti")


def meaningful(text: Column, least: int = 100) -> Column:
    """Whether a text is long enough to be worth compiling."""
    return F.length(F.trim(text)) >= least


def risky_word(title: Column, words: list[str]) -> Column:
    """The first of the words that a title holds; null for titles that may be compiled."""
    return F.coalesce(*(F.when(F.contains(F.lower(title), F.lit(w.lower())), F.lit(w)) for w in words))


def compile_calls(size_bytes: Column) -> Column:
    """Model calls that a file of this size takes."""
    return F.when(size_bytes > 100 * 1024, 3).when(size_bytes > 50 * 1024, 2).otherwise(1)


def cost_estimate(rows: DataFrame, by: str, price: float = 0.001) -> DataFrame:
    """by, files, calls, cost of a dry run."""
    calls = compile_calls(F.col("size_bytes"))
    return rows.groupBy(by).agg(F.count("*").alias("files"), F.sum(calls).cast("long").alias("calls"), F.round(F.sum(calls) * F.lit(price).cast("double"), 3).alias("cost"))


def ingest_outcomes(rows: DataFrame, by: str) -> DataFrame:
    """by, total, linked, skipped, failed of taking rows in by doc_id: empty ones fail, later copies of a content are skipped."""
    first = rows.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    out = rows.join(first, "content_hash").withColumn("new", F.col("doc_id") == F.col("first_id"))
    count = lambda name, test: F.count_if(F.expr(test)).alias(name)
    return out.groupBy(by).agg(F.count("*").alias("total"), count("linked", "size_bytes > 0 AND new"), count("skipped", "size_bytes > 0 AND NOT new"), count("failed", "size_bytes = 0"))


def on_topic(notes: DataFrame, topic: str, most: int = 2000) -> DataFrame:
    """notes (title, text) with match_type: filename where a keyword of the topic (two letters or more) is in the title, else content where one is in the first characters."""
    words = [w.lower() for w in topic.split() if len(w) >= 2] or [topic.strip().lower()]
    has = lambda c: reduce(or_, (F.contains(F.lower(c), F.lit(w)) for w in words))
    return notes.withColumn("match_type", F.when(has(F.col("title")), "filename").when(has(F.left("text", F.lit(most))), "content")).where("match_type IS NOT NULL")


def seeded(notes: DataFrame, known: DataFrame, topic: str) -> DataFrame:
    """Notes on a topic as sources with tags, file names first; contents that are known are left out."""
    rows = on_topic(notes, topic).join(known.select("content_hash"), "content_hash", "left_anti")
    return rows.withColumns({"tags": F.array(*map(F.lit, ("vault", "seed", topic))), "place": F.when(F.col("match_type") == "filename", 0).otherwise(1)})


def by_priority(rows: DataFrame) -> DataFrame:
    """rows with priority: kinds in the order of TYPE_PRIORITY, unknown ones last."""
    order = F.create_map(*(F.lit(x) for pair in zip(TYPE_PRIORITY, range(len(TYPE_PRIORITY)), strict=True) for x in pair))
    return rows.withColumn("priority", F.coalesce(F.try_element_at(order, F.col("type")), F.lit(len(TYPE_PRIORITY) - 1)))


def index_rows(manifests: DataFrame) -> DataFrame:
    """The eight columns of the flat index."""
    return manifests.select("src_id", "title", "type", "file_path", "content_hash", "date_ingested", "status", "quality_score")


def index_updated(index: DataFrame, manifests: DataFrame) -> DataFrame:
    """The index with rows of manifests in it: new ones appended, known ones replaced."""
    return index.join(manifests.select("src_id"), "src_id", "left_anti").unionByName(index_rows(manifests))
