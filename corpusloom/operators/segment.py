"""Documents to chunks.

Splits that have a closed form are column expressions or windows per document. Packing pieces
greedily up to a size, with the tail of the last chunk repeated, needs what was packed before; it
runs over each document alone, in Arrow batches, wherever the document is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import SENTENCE, sentences, strip

# Where texts are cut, the coarsest separator first.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " ")
# Heading lines, and lines that begin a numbered part.
HEADING = r"^(#{1,6})\s+(.*)$"
NUMBERING = r"^(?:(\d+|[一二三四五六七八九十]+)[.、]\s*(.+)|[（(]\s*\d+\s*[)）]\s*(.+))$"
CHUNK = "src_id string, index int, start int, end int, content string"


def strategy(n: Column) -> Column:
    """How a text of n characters is summarised."""
    return F.when(n <= 20_000, "direct").when(n <= 60_000, "map_reduce").when(n <= 200_000, "hierarchical").otherwise("map_reduce")


def middle_cut(text: Column, most: int = 200_000, marker: str = "\n\n[...]\n\n") -> Column:
    """A text of more than `most` characters without its middle."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most // 2)), F.lit(marker), F.right(text, F.lit(most // 2)))).otherwise(text)


def fixed(docs: DataFrame, size: int = 4000, overlap: int = 200) -> DataFrame:
    """src_id, index, start, content: windows of `size` characters, each `overlap` into the one before."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / step)).cast("int")
    rows = docs.where(F.length("text") > 0).select("src_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("index"))
    return rows.select("src_id", "index", (F.col("index") * step).alias("start"), F.substring("text", F.col("index") * step + 1, F.lit(size)).alias("content"))


def sections(docs: DataFrame, heading: str = HEADING) -> DataFrame:
    """src_id, index, level, title, content: a heading and the lines up to the next one."""
    rows = _cut_at(docs, lambda lines: F.col("line").rlike(heading))
    return rows.select("src_id", "index", F.length(F.regexp_extract("head", heading, 1)).alias("level"), strip(F.regexp_extract("head", heading, 2)).alias("title"), "content")


def numbered_sections(docs: DataFrame, numbering: str = NUMBERING) -> DataFrame:
    """src_id, index, level, title, content: a numbered line and the lines up to the next one; only of texts that have more than one part.

    The first line that is not blank begins the first part, whatever it is; its title is empty.
    """
    begins = Window.partitionBy("src_id")
    first = F.min(F.when(strip(F.col("line")) != "", F.col("line_no"))).over(begins)
    rows = _cut_at(docs, lambda lines: F.col("line").rlike(numbering) & (F.col("line_no") > first))
    title = F.coalesce(*(F.nullif(strip(F.regexp_extract("head", numbering, g)), F.lit("")) for g in (1, 2, 3)), F.lit(""))
    rows = rows.withColumn("parts", F.count("*").over(begins)).where("parts > 1")
    return rows.select("src_id", "index", F.lit(1).alias("level"), F.when(F.col("section") == 0, "").otherwise(title).alias("title"), "content")


def _cut_at(docs: DataFrame, heads) -> DataFrame:
    """src_id, section, index, head, content of texts cut before the lines that heads(lines) marks; windows are per document."""
    lines = docs.select("src_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    upto = Window.partitionBy("src_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("is_head", heads(lines)).withColumn("section", F.sum(F.col("is_head").cast("int")).over(upto))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    rows = lines.groupBy("src_id", "section").agg(F.min_by("line", "line_no").alias("head"), body.alias("content")).withColumn("content", strip(F.col("content"))).where("content <> ''")
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("src_id").orderBy("section")) - 1)


def structured(docs: DataFrame, size: int = 4000, overlap: int = 200) -> DataFrame:
    """src_id, index, level, title, content: sections at headings where a text has more than one, else numbered parts, else the whole text; longer ones packed from paragraphs and sentences."""
    many = lambda rows: rows.withColumn("n", F.count("*").over(Window.partitionBy("src_id"))).where("n > 1").drop("n")
    by_heading = many(sections(docs))
    rest = docs.join(by_heading.select("src_id").distinct(), "src_id", "left_anti")
    by_number = numbered_sections(rest)
    whole = rest.join(by_number.select("src_id").distinct(), "src_id", "left_anti").where(strip(F.col("text")) != "")
    whole = whole.select("src_id", F.lit(0).alias("index"), F.lit(0).alias("level"), F.lit("").alias("title"), strip(F.col("text")).alias("content"))
    parts = by_heading.union(by_number).union(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                pieces = [r["content"][a:b] for a, b in by_paragraphs(r["content"], size, overlap)] if len(r["content"]) > size else [r["content"]]
                rows += [r | {"sub": i, "content": x} for i, x in enumerate(pieces)]
            schema = pa.schema([("src_id", pa.string()), ("index", pa.int32()), ("sub", pa.int32()), ("level", pa.int32()), ("title", pa.string()), ("content", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = parts.mapInArrow(run, "src_id string, index int, sub int, level int, title string, content string")
    place = F.row_number().over(Window.partitionBy("src_id").orderBy("index", "sub")) - 1
    return rows.select("src_id", place.alias("index"), "level", "title", "content")


def sentence_rows(docs: DataFrame) -> DataFrame:
    """src_id, place, sentence."""
    return docs.select("src_id", F.posexplode(sentences(F.col("text"))).alias("place", "sentence"))


Span = tuple[int, int]


def packed(pieces: list[str], size: int, overlap: int, begin: int = 0) -> list[Span]:
    """Pieces of a text, which follow each other from `begin` on, joined up to `size` characters; a new chunk begins with the last pieces, up to `overlap` characters where there is room. Chunks as spans of the text."""
    ends, at = [], begin
    for piece in pieces:
        at += len(piece)
        ends.append(at)
    out, start = [], begin
    for i, piece in enumerate(pieces):
        if ends[i] - start > size and ends[i] - len(piece) > start:
            out.append((start, ends[i] - len(piece)))
            room = min(overlap, size - len(piece))
            j = i
            while j > 0 and ends[i - 1] - (ends[j - 1] - len(pieces[j - 1])) <= room and ends[j - 1] - len(pieces[j - 1]) >= start:
                j -= 1
            start = ends[i - 1] if j == i else ends[j] - len(pieces[j])
    return [*out, (start, at)] if pieces and at > start else out


def pieces_of(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """text cut before separators, the coarsest first, until no piece exceeds `size`; joined they give text."""
    if len(text) <= size:
        return [text] if text else []
    for i, separator in enumerate(separators):
        if separator in text:
            parts = re.split(f"(?={re.escape(separator)})", text)
            return [x for part in parts for x in pieces_of(part, size, separators[i + 1 :])]
    return [text[k : k + size] for k in range(0, len(text), size)]


def by_separators(text: str, size: int = 800, overlap: int = 120) -> list[Span]:
    return packed(pieces_of(text, size), size, overlap)


def sentence_pieces(text: str, size: int) -> list[str]:
    """Sentences with what stands between them; joined they give text. Longer ones than size are cut."""
    ends = [m.end() for m in re.finditer(SENTENCE, text)]
    cuts = [0, *ends[:-1], len(text)] if ends else [0, len(text)]
    pieces = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [p for x in pieces for p in (pieces_of(x, size) if len(x) > size else [x]) if p]


def by_sentences(text: str, size: int = 4000, overlap: int = 200) -> list[Span]:
    """Whole sentences packed to size."""
    return packed(sentence_pieces(text, size), size, overlap)


def by_paragraphs(text: str, size: int = 4000, overlap: int = 200) -> list[Span]:
    """Paragraphs packed to size; a text without blank lines is cut at lines; paragraphs above size are cut at sentences."""
    gap = "\n\n" if "\n\n" in text or len(text) <= size else "\n"
    parts = re.split(f"(?<={gap})", text)
    return packed([p for x in parts for p in (sentence_pieces(x, size) if len(x) > size else [x]) if p], size, overlap)


def by_lines(text: str, size: int = 4000, overlap: int = 200) -> list[Span]:
    """Windows that end at a line's end if there is one in their second half."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            at = text.rfind("\n", start, end)
            end = at + 1 if at > start + size // 2 else end
        if text[start:end].strip():
            out.append((start, end))
        start = max(end - overlap, start + 1) if end < len(text) else end
    return out


SPLITTERS: dict[str, Callable[[str, int, int], list[Span]]] = {"recursive": by_separators, "sentence": by_sentences, "line": by_lines, "paragraph": by_paragraphs}


def chunks(docs: DataFrame, splitter: str, size: int = 800, overlap: int = 120) -> DataFrame:
    """src_id, index, start, end, content of every document by one of SPLITTERS; content is the text from start to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = SPLITTERS[splitter]
        for batch in batches:
            rows = []
            for src_id, text in zip(batch.column("src_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [{"src_id": src_id, "index": i, "start": a, "end": b, "content": text[a:b]} for i, (a, b) in enumerate(split(text or "", size, overlap))]
            schema = pa.schema([("src_id", pa.string()), ("index", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("content", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select("src_id", "text").mapInArrow(run, CHUNK)


def adaptive_size(n: Column) -> Column:
    """Chunk size for a text of n characters, so that chunks stay few."""
    eighth = F.floor(n / 8).cast("int")
    return F.when(n > 100_000, F.greatest(F.lit(20_000), eighth)).when(n > 50_000, F.greatest(F.lit(12_000), eighth)).otherwise(F.least(F.lit(16_000), F.greatest(F.lit(4_000), eighth)))


def with_ids(rows: DataFrame, name: str) -> DataFrame:
    """Chunks with their id and metadata."""
    return rows.select(F.concat("src_id", F.lit("_chunk_"), F.format_string("%04d", "index")).alias("id"), "src_id", F.lit(name).alias("strategy"), "content")


def breakpoints(vectors: DataFrame, share: float = 0.95) -> DataFrame:
    """vectors (doc, place, v) -> doc, place, distance, breaks: cosine distance to the next, above the document's percentile."""
    ordered = Window.partitionBy("doc").orderBy("place")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v, w = F.col("v"), F.col("w")
    rows = vectors.withColumn("w", F.lead("v").over(ordered)).where("w IS NOT NULL")
    rows = rows.select("doc", "place", F.round(1 - F.coalesce(dot(v, w) / F.nullif(F.sqrt(dot(v, v) * dot(w, w)), F.lit(0.0)), F.lit(0.0)), 6).alias("distance"))
    bar = F.percentile("distance", share).over(Window.partitionBy("doc"))
    return rows.withColumn("bar", F.round(bar, 6)).select("doc", "place", "distance", (F.col("distance") > F.col("bar")).alias("breaks"))


def long_sentences(docs: DataFrame, least: int = 20) -> DataFrame:
    """src_id, place, sentence: sentences at runs of 。！？!? with shorter ones than `least` joined to the one before; a run belongs to its sentence, and counts in its length."""
    parts = F.filter(F.transform(F.split(strip(F.col("text")), r"(?<=[。！？!?])(?![。！？!?])\s*"), strip), lambda s: s != "")
    rows = docs.select("src_id", F.posexplode(parts).alias("i", "s"))
    upto = Window.partitionBy("src_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("place", F.sum(((F.length("s") >= least) | (F.col("i") == 0)).cast("int")).over(upto) - 1)
    return rows.groupBy("src_id", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), "").alias("sentence"))


def letter_vector(text: Column, letters: str = "aeioulnrst") -> Column:
    """A stand-in for an embedder: how often each of a few letters occurs."""
    low = F.lower(text)
    return F.array(*((F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in letters))


def semantic(sentences: DataFrame, size: int = 800, overlap: int = 120, share: float = 0.95) -> DataFrame:
    """sentences (src_id, place, sentence, v) -> src_id, index, content: sentences together up to a turn of topic (see breakpoints); groups above size in windows that overlap."""
    turns = breakpoints(sentences.select(F.col("src_id").alias("doc"), "place", "v"), share)
    rows = sentences.join(turns.select(F.col("doc").alias("src_id"), (F.col("place") + 1).alias("place"), "breaks"), ["src_id", "place"], "left")
    upto = Window.partitionBy("src_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("group", F.sum(F.coalesce(F.col("breaks").cast("int"), F.lit(0))).over(upto))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]), "")
    groups = rows.groupBy("src_id", "group").agg(text.alias("text"))
    step = size - overlap
    last = F.when(F.length("text") <= size, 0).otherwise(F.floor((F.length("text") - 1) / step).cast("int"))
    pieces = groups.select("src_id", "group", "text", F.explode(F.sequence(F.lit(0), last)).alias("i")).select("src_id", "group", "i", F.substring("text", F.col("i") * step + 1, F.lit(size)).alias("content"))
    return pieces.select("src_id", (F.row_number().over(Window.partitionBy("src_id").orderBy("group", "i")) - 1).alias("index"), "content")


# A stretch up to its terminators and the blanks after them; stretches follow each other without a gap.
STRETCH = r"(?s)[^。！？!?]*[。！？!?]+\s*|[^。！？!?]+$"


def sentence_spans(docs: DataFrame, least: int = 20) -> DataFrame:
    """src_id, place, start, end, sentence: the text cut after 。！？!? and the blanks behind, with shorter sentences than `least` joined to the one before; sentence is the text from start to end."""
    pieces = F.filter(F.regexp_extract_all("text", F.lit(STRETCH), F.lit(0)), lambda s: s != "")
    rows = docs.select("src_id", F.posexplode(pieces).alias("i", "s")).withColumn("n", F.length("s"))
    upto = Window.partitionBy("src_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    long = (F.length(strip(F.col("s"))) >= least) | (F.col("i") == 0)
    rows = rows.withColumns({"place": F.sum(long.cast("int")).over(upto) - 1, "stop": F.sum("n").over(upto)})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), "")
    return rows.groupBy("src_id", "place").agg(F.min(F.col("stop") - F.col("n")).alias("start"), F.max("stop").alias("end"), text.alias("sentence"))


def semantic_spans(docs: DataFrame, embedder: Callable[[Column], Column] = letter_vector, size: int = 800, overlap: int = 120, share: float = 0.95, least: int = 20) -> DataFrame:
    """src_id, index, start, end, content: sentences together up to a turn of topic, groups above size in windows that overlap; content is the text from start to end, without blanks at its ends.

    embedder gives the vector of a sentence (see `backends` for those that have a name). Cases: a null,
    empty or blank text has no chunk; a text of one sentence has no turn.
    """
    rows = sentence_spans(docs, least)
    turns = breakpoints(rows.select(F.col("src_id").alias("doc"), "place", embedder(F.col("sentence")).alias("v")), share)
    rows = rows.join(turns.select(F.col("doc").alias("src_id"), (F.col("place") + 1).alias("place"), "breaks"), ["src_id", "place"], "left")
    upto = Window.partitionBy("src_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("group", F.sum(F.coalesce(F.col("breaks").cast("int"), F.lit(0))).over(upto))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]), "")
    groups = rows.groupBy("src_id", "group").agg(F.min("start").alias("start"), text.alias("text"))
    step = size - overlap
    last = F.when(F.length("text") <= size, 0).otherwise(F.ceil((F.length("text") - size) / step)).cast("int")
    windows = groups.select("src_id", "start", "text", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    windows = windows.select("src_id", (F.col("start") + F.col("i") * step).alias("start"), F.substring("text", F.col("i") * step + 1, F.lit(size)).alias("piece"))
    lead = F.length("piece") - F.length(F.regexp_replace("piece", r"^\s+", ""))
    windows = windows.select("src_id", (F.col("start") + lead).cast("int").alias("start"), strip(F.col("piece")).alias("content")).where("content <> ''")
    place = F.row_number().over(Window.partitionBy("src_id").orderBy("start")) - 1
    return windows.select("src_id", place.alias("index"), "start", (F.col("start") + F.length("content")).alias("end"), "content")


def merged_sentences(sentences: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """sentences (src_id, place, sentence) -> src_id, index, content: without vectors, sentences joined up to size, each chunk after the first begun with the last characters of the one before."""
    rows = sentences.groupBy("src_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, places, out = [], [], []
            for src_id, parts in zip(batch.column("src_id").to_pylist(), batch.column("s").to_pylist(), strict=True):
                now, done = "", []
                for s in parts:
                    if now and len(now) + len(s) > size:
                        done.append(now)
                        now = now[len(now) - min(overlap, len(now)) :]
                    now += s
                done += [now] if now else []
                owners += [src_id] * len(done)
                places += range(len(done))
                out += done
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(places, pa.int32()), pa.array(out, pa.string())], ["src_id", "index", "content"])

    return rows.mapInArrow(run, "src_id string, index int, content string")
