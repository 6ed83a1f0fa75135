"""Periodic runs of words: every stretch that repeats its beginning, found by recursive splitting and a lag scan.

A run is a stretch of words with smallest period q and max(`shortest`, 2q) words or more that no
neighbouring word extends. Every word of a run occurs twice or more in it, so a word that occurs once
in its segment is in no run there: it splits the segment, and the parts, in which further words may
have become single, are split again until nothing changes. Parts that are too short go. In the
segments that are left the lags 1 to 7 are scanned word by word; a longer lag q, from h to 2h - 1 for
a power of two h, is scanned around places where the same h words follow again q words later, since a
run with that period has such a place. Which places have the same h words is told by ranks that double
in length, so long segments are not compared with themselves lag by lag.

The batches of documents are worked on where they are read; all segments of a batch are scanned
together, and there is no shuffle. Memory follows a batch of texts, or the longest text.

Cases: a null, empty or blank text has no words and no run; rows that repeat are each kept; runs may
overlap, and equal starts are told apart by their periods; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import SQL_CRC, fold_of, id_text, small_batches

SPACES = r"[ \x09-\x0D]+"
SHORT_LAGS = 8  # lags below are scanned everywhere
RUNS = "runs array<struct<start: long, length: long, period: long>>"


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return edges[::2], edges[1::2]


def _settled(codes: list[int], shortest: int) -> list[tuple[int, int]]:
    """Parts of one segment without a word that is single in its part.

    Of the parts of a split the largest keeps the counts and has the others' words taken off, so a
    word is counted once each time that its part is half as long or shorter: n log n steps.
    """
    places: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        places.setdefault(c, []).append(i)
    kept = []
    counts = Counter(codes)
    work = [(0, len(codes), counts, [places[c][0] for c, n in counts.items() if n == 1])]
    while work:
        lo, hi, counts, single = work.pop()
        if hi - lo < shortest:
            continue
        if not single:
            kept.append((lo, hi))
            continue
        cuts = sorted(single)
        parts = [(a + 1, b) for a, b in zip([lo - 1, *cuts], [*cuts, hi], strict=True)]
        heir = max(parts, key=lambda p: p[1] - p[0])
        lost = set(cuts)
        for part in parts:
            if part != heir:
                own = Counter(codes[part[0] : part[1]])
                lost.update(range(*part))
                if part[1] - part[0] >= shortest:
                    found = [i for i in range(*part) if own[codes[i]] == 1]
                    work.append((*part, own, found))
        left = Counter(codes[i] for i in lost)
        counts.subtract(left)
        ones = {c for c in left if counts[c] == 1}
        work.append((*heir, counts, [i for c in ones for i in _within(places[c], *heir)]))
    return sorted(kept)


def _within(places: list[int], lo: int, hi: int) -> list[int]:
    a, b = np.searchsorted(places, [lo, hi]).tolist()
    return places[a:b]


def segments(codes: np.ndarray, texts: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Segments of the texts (numbers of texts ascend) that may hold runs; the first split is made for all texts together."""
    keys = texts.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
    _, of, counts = np.unique(keys, return_inverse=True, return_counts=True)
    often = counts[of] > 1
    change = np.flatnonzero(np.diff(texts)) + 1  # a segment ends where a text ends
    out = []
    for lo, hi in zip(*_stretches(often), strict=True):
        inner = change[np.searchsorted(change, lo, "right") : np.searchsorted(change, hi)].tolist()
        for a, b in zip([int(lo), *inner], [*inner, int(hi)], strict=True):
            if b - a >= shortest:
                out.extend((a + x, a + y) for x, y in _settled(codes[a:b].tolist(), shortest))
    return out


def _equal_ahead(w: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from `at` on (step 1) or before it (step -1) equal those `lag` words later."""
    found, size = 0, 64
    while True:
        a, b = (at + found, min(at + found + size, len(w) - lag)) if step > 0 else (max(0, at - found - size), at - found)
        if a >= b:
            return found
        differ = np.flatnonzero(w[a:b] != w[a + lag : b + lag])
        if len(differ):
            return found + int(differ[0] if step > 0 else b - a - 1 - differ[-1])
        found, size = found + b - a, size * 2


def _smallest(w: np.ndarray, start: int, length: int, period: int) -> bool:
    """Is this the smallest period? A smaller one of so long a stretch divides it."""
    rest, p = period, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            lag = period // p
            if np.array_equal(w[start : start + length - lag], w[start + lag : start + length]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def _places(w: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """h, and for h = 8, 16, ... the places whose h words occur again with their ranks, by rank and place."""
    h, rank = 1, np.unique(w, return_inverse=True)[1]
    full = rank.astype(np.int64)
    at = np.arange(len(w))
    while 2 * h <= longest:
        at = at[at + h < len(w)]
        at = at[full[at + h] >= 0]
        _, rank, counts = np.unique(full[at] * (len(w) + 1) + full[at + h], return_inverse=True, return_counts=True)
        again = counts[rank] > 1
        at, rank, h = at[again], rank[again], 2 * h
        if not len(at):
            return
        full = np.full(len(w), -1, np.int64)
        full[at] = rank
        if h >= SHORT_LAGS:
            order = np.lexsort((at, rank))
            yield h, at[order], rank[order].astype(np.int64)


def lag_scan(w: np.ndarray, longest: int, shortest: int) -> list[tuple[int, int, int]]:
    """start, length, period of every run in words of segments, which unequal marks keep apart."""
    found = []
    for lag in range(1, min(SHORT_LAGS, longest // 2 + 1)):
        for a, b in zip(*_stretches(w[:-lag] == w[lag:]), strict=True):
            if b - a >= max(lag, shortest - lag):
                found.append((int(a), int(b - a) + lag, lag))
    for h, at, rank in _places(w, longest // 2):
        # The last of a cluster (the same h words come again more than h/2 later) meets all places from h to 2h - 1 after it.
        key = rank * (4 * len(w)) + at
        last = np.flatnonzero(np.append(key[1:] - key[:-1] > h // 2, True))
        lo, hi = np.searchsorted(key, key[last] + h), np.searchsorted(key, key[last] + 2 * h)
        n = hi - lo
        other = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        first = np.repeat(at[last], n)
        lags = at[other] - first
        order = np.lexsort((first, lags))
        done = (0, 0)  # lag, end of the last stretch seen
        for lag, i in zip(lags[order].tolist(), first[order].tolist(), strict=True):
            if lag == done[0] and i < done[1]:
                continue
            a = i - _equal_ahead(w, i, lag, -1)
            b = i + h + _equal_ahead(w, i + h, lag, 1)
            done = (lag, b)
            if b - a >= max(lag, shortest - lag):
                found.append((a, b - a + lag, lag))
    return [run for run in found if _smallest(w, *run)]


def runs_of(codes: np.ndarray, texts: np.ndarray, shortest: int = 12) -> list[tuple[int, int, int]]:
    """start (in codes), length, period of every run, by start and period; codes are words, texts the number of each word's text."""
    cut = segments(codes, texts, shortest)
    if not cut:
        return []
    at = np.concatenate([np.append(np.arange(a, b), -1) for a, b in cut])
    mark = at < 0
    w = np.where(mark, 0, codes[at]).astype(np.int64)
    w[mark] = -1 - np.arange(mark.sum())
    return sorted((int(at[s]), n, q) for s, n, q in lag_scan(w, max(b - a for a, b in cut), shortest))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and where each text's begin (and the last one's end)."""
    parts = pc.ascii_split_whitespace(texts)
    flat, ends = parts.flatten(), parts.offsets.to_numpy()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[ends]


def periodic_runs(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the words that no run repeats, joined by blanks."""
    small_batches(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, begins = words_of(batch.column("text").cast(pa.string()))
            sizes = np.diff(begins)
            codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            found = np.array(runs_of(codes, np.repeat(np.arange(len(sizes)), sizes), shortest), np.int64).reshape(-1, 3)
            text = np.searchsorted(begins, found[:, 0], "right") - 1
            columns = [found[:, 0] - begins[text], found[:, 1], found[:, 2]]
            struct = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32)), struct)
            depth = np.zeros(len(codes) + 1, np.int64)
            np.add.at(depth, found[:, 0] + found[:, 2], 1)
            np.add.at(depth, found[:, 0] + found[:, 1], -1)
            kept = np.cumsum(depth[:-1]) == 0
            at = np.concatenate([[0], np.cumsum(kept)])[begins]
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words.filter(pa.array(kept))), " ")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), runs, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    return id_text(docs).mapInArrow(run, f"doc_id long, n_words long, {RUNS}, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """The number of runs, the longest one (the first of equals, then the smallest period), and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("short"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"),
        F.expr("1000 * best.length div -best.short").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, where the texts of every tenth hash of an id repeat a stretch of their words up to their end (a null id: as an empty one)."""
    h = fold_of(F.col("doc_id"), 1 << 32)
    words = F.array_remove(F.split("text", SPACES), "")
    rows = id_text(docs).withColumn("h", h).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.expr("nullif(array_size(words), 0)"))
    rows = rows.withColumn("a", F.expr("int(g % n)")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    cycle = "slice(flatten(array_repeat(slice(words, a + 1, p), int((n - a + p - 1) div p))), 1, n - a)"
    return rows.select("doc_id", F.when(F.col("n") > 0, F.expr(f"array_join(concat(slice(words, 1, a), {cycle}), ' ')")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, after the contract's repeats: doc_id, n_runs, the longest run, digests of runs and of what is left."""
    return digests(periodic_runs(with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


#: All pairs of equal words of a text, those of one distance in unbroken rows.
SQL = f"""WITH {SQL_CRC}, w0 AS (SELECT doc_id, h, h // 10 AS g, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents JOIN crc USING (doc_id)),
w1 AS (SELECT *, len(w) AS n, g % greatest(len(w), 1) AS a, 1 + (len(w) - g % greatest(len(w), 1)) // (3 + g % 8) AS p FROM w0),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM w1),
t AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM d), m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m), s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
dropped AS (SELECT DISTINCT doc_id, i FROM t SEMI JOIN r ON r.doc_id = t.doc_id AND t.i >= r.start + r.period AND t.i < r.start + r.length),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n_runs, arg_max(struct_pack(s := start, l := length, q := period), (length, -start, -period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""
