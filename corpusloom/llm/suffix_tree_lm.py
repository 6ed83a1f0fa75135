"""LM scoring by a probabilistic suffix tree.

Symbols are words and one end per text. The root's distribution is the smoothed share of each symbol
in the training texts. A context of up to `depth` words is a state of the tree if a divergence test
says that what follows it differs from what its longest shorter state foretells: its occurrences times
the divergence in bits must reach `least_bits`. A state's distribution is discounted, and what is left
over goes to the shorter state's distribution. Texts are scored from the longest suffix state at each
place.

Whatever occurs often enough is in the tree: runs of words from `least_count` occurrences on, contexts
from `least_context` on. Both are fixed numbers, so the tree grows with the corpus, and no task and not
the driver ever holds it. Texts are cut into blocks of about `block_tokens` symbols, written once as a
table bucketed by block; a block knows its own distinct runs. For each order of runs two exchanges
follow. In the first, a block sends the codes of its runs and its counts, packed by ranges of codes;
a task adds up one range over all blocks and answers each block, in the order in which it asked, with
the runs' counts in the whole corpus and which of them the block is to speak for. In the second,
blocks send for each of their contexts the sums over the followers that they speak for, and are told
whether it is a state, and its weight. Answers are added to one table, bucketed as the blocks are. A run is asked for only if its parts occur often enough by
themselves. A block sends a run or context once however often it has it, so none is a hot spot. With
the counts a block is told the numbers, within the range, of those that occur often enough for a
context. It names contexts by them, which takes a byte or two where a hash takes six.

Words and runs are told apart by 64-bit hashes; two that share one are counted together.

Cases: a null or empty text is its end alone; rows that repeat count and are scored each; a null
doc_id is kept; an unknown word has count 0; without training texts every probability is that of an
unknown word; a text longer than a block is a block of its own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fold_of, new_path, partitions, shuffles_dropped, small_batches

#: Words hold no newline, so this stands for the end of a text.
END = b"\n"
WORDS, RUNS, CONTEXTS = 0, 1, 2  # what is asked about
ALL = -1  # the block that stands for the whole corpus
BLOCK = "block long, train_tokens long, doc_ids binary, no_ids binary, held_out binary, lengths binary, words binary, ids binary"
ASKED = "kind int, length int, bucket int, block long, codes binary, at binary, sums binary"
TOLD = "block long, kind int, length int, bucket int, told binary, numbers binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(text: str) -> list[bytes]:
    """Words in lower case (A-Z alone), parted by ASCII white space, and the end."""
    return [*text.encode().lower().split(), END]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Code of a run from the code of its context and the hash of its last word."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def planes(values: np.ndarray) -> bytes:
    """Numbers of 8 bytes, byte by byte of the same weight and packed: what is small or repeats takes little."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values, dtype=None if values.dtype == np.float64 else "<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def from_planes(data: bytes, kind: str = "<u8") -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def packed_ids(ids: np.ndarray) -> bytes:
    """Numbers of 4 bytes, byte by byte of the same weight and packed: smaller the more of them are small."""
    return zstandard.ZstdCompressor(1).compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked_ids(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def ranked(keys: np.ndarray) -> np.ndarray:
    """The place of each of some distinct keys in their order."""
    out = np.empty(len(keys), np.int64)
    out[np.argsort(keys)] = np.arange(len(keys))
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and each place's key."""
    order = np.argsort(keys)
    ordered = keys[order]
    begins = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(begins) - 1
    return ordered[begins], order[begins], inverse


def cut_blocks(texts: DataFrame, block_tokens: int) -> DataFrame:
    """texts (doc_id, held_out, text) -> a row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0
        numbers: dict[bytes, int] = {}  # of the block's words as they come

        def flush() -> pa.RecordBatch:
            places, ids, out, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            hashes = word_hashes([*numbers])
            words, _, place = distinct(hashes)
            token = place[places]
            # Frequent words get small numbers, which pack well; words that are as frequent stand in order, so that their steps pack.
            often = np.argsort(-np.bincount(token, minlength=len(words)), kind="stable")
            null = np.array([i is None for i in ids])
            row = {
                "block": (part << 32) + seq, "train_tokens": int(lengths[~out].sum()), "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "no_ids": null.tobytes(), "held_out": out.tobytes(),
                "lengths": lengths.astype("<i4").tobytes(), "words": planes(np.diff(words[often], prepend=np.uint64(0))), "ids": packed_ids(np.argsort(often)[token]),
            }
            return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, pa.schema([("block", pa.int64()), ("train_tokens", pa.int64()), *((k, pa.binary()) for k in list(row)[2:])]))

        for batch in batches:
            found = [tokens(x) for x in batch.column("text").to_pylist()]
            flat = [w for x in found for w in x]
            numbers.update(zip({*flat}.difference(numbers), range(len(numbers), 1 << 62)))  # noqa: B905
            held.append((np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat)), np.array(batch.column("doc_id").to_pylist(), object), np.array(batch.column("held_out").to_pylist(), bool), np.array([len(x) for x in found], np.int64)))
            n += len(flat)
            if n >= block_tokens:
                yield flush()
                seq, held, n = seq + 1, [], 0
                numbers.clear()
        if n:
            yield flush()

    return texts.mapInArrow(run, BLOCK)


class Settings:
    """What tasks need to know besides a block: numbers of the whole corpus and the tree's parameters."""

    def __init__(self, depth: int, least_count: int, least_context: int, discount: float, least_bits: float, buckets: int):
        self.depth, self.least_count, self.least_context, self.discount, self.least_bits, self.buckets = depth, least_count, least_context, discount, least_bits, buckets
        self.train_tokens = self.distinct = 0

    def root(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed share of symbols with these counts."""
        return np.log10((counts + 0.5) / (self.train_tokens + 0.5 * (self.distinct + 1)))


class Block:
    """One block, and what it has been told so far, order by order."""

    def __init__(self, row: dict, told: pa.Table | None, settings: Settings):
        self.name, self.settings = row["block"], settings
        self.doc_ids, self.no_ids, self.held_out = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["no_ids"], bool), np.frombuffer(row["held_out"], bool)
        lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
        words = np.cumsum(from_planes(row["words"]), dtype=np.uint64)
        self.words, self.ids = np.sort(words), ranked(words)[unpacked_ids(row["ids"])]
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.train = ~self.held_out[self.doc]
        self.end = int(np.searchsorted(self.words, word_hashes([END])[0]))
        self.told: dict[tuple[int, int], list] = {}
        self.numbers: dict[tuple[int, int], list] = {}
        for r in sorted(told.to_pylist(), key=lambda r: r["bucket"]) if told is not None else ():
            self.told.setdefault((r["kind"], r["length"]), []).append(from_planes(r["told"], "<f8" if r["kind"] == CONTEXTS else "<u8"))
            self.numbers.setdefault((r["kind"], r["length"]), []).append(r["numbers"])

    def answer(self, kind: int, length: int, order: np.ndarray) -> np.ndarray:
        """What was told of the codes that were asked for in this order, back in their own."""
        found = self.told.get((kind, length), [])
        out = np.empty(len(order), np.float64 if kind == CONTEXTS else np.uint64)
        out[order] = np.concatenate(found) if found else out[:0]
        return out

    def numbers_of(self, kind: int, length: int, order: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The numbers in their ranges of the codes that were asked for in this order, of those that may be contexts."""
        out = np.zeros(len(order), np.uint64)
        found = [np.cumsum(from_planes(x), dtype=np.uint64) for x in self.numbers.get((kind, length), [])]
        out[order[counts[order] >= self.settings.least_context]] = np.concatenate(found) if found else out[:0]
        return out

    def ask(self, kind: int, length: int, codes: np.ndarray, order: np.ndarray, at: np.ndarray, sums: np.ndarray, names: np.ndarray | None = None) -> list[dict]:
        """Rows of one question, a row per range of codes: the sorted codes (or the names that go with them), and what is known of those at these places (of contexts) or of each (their counts)."""
        codes, s = codes[order], self.settings
        width = (1 << 64) // s.buckets + 1
        cuts = np.searchsorted(codes, np.array([width * b for b in range(1, s.buckets)], np.uint64))
        inner = np.searchsorted(at, cuts) if kind == CONTEXTS else cuts
        sent = codes if names is None else names[order]
        bounds = zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)], [0, *inner.tolist()], [*inner.tolist(), len(sums)], strict=True)
        return [
            {"kind": kind, "length": length, "bucket": b, "block": self.name, "codes": planes(np.diff(sent[i:j], prepend=np.uint64(0))), "at": planes(at[k:m] - i), "sums": planes(sums[k:m].T.ravel())}
            for b, (i, j, k, m) in enumerate(bounds) if j > i
        ]

    def ask_words(self) -> list[dict]:
        order = np.arange(len(self.words))
        return self.ask(WORDS, 0, self.words, order, order[:0], np.bincount(self.ids, self.train, len(self.words)).astype(np.uint64))

    def levels(self, upto: int, weights: int) -> None:
        """Work out runs of up to `upto` words after their context, and log10 probabilities over states of up to `weights` words.

        Tables that are looked up by a place have one entry more, for place -1: none.
        """
        s = self.settings
        counts = (self.answer(WORDS, 0, np.arange(len(self.words))) >> np.uint64(1)).astype(np.int64)
        self.counts, run, codes = counts, self.ids, self.words
        self.base = logs = s.root(counts)[self.ids]
        begins = np.append(0, np.flatnonzero(self.ids[:-1] == self.end) + 1)
        self.order: dict[int, dict] = {}
        for length in range(1, upto + 1):
            before = np.empty_like(run)
            before[1:] = run[:-1]
            before[begins] = -1
            # Contexts that tokens are in, and each token's place among them.
            met = np.zeros(len(counts) + 1, bool)
            met[before] = True
            known = np.flatnonzero(met[:-1] & (counts >= s.least_context))
            place = np.full(len(counts) + 1, -1)
            place[known] = np.arange(len(known))
            own, often = place[before], np.append(counts >= s.least_count, False)
            ok = np.flatnonzero((own >= 0) & often[run])
            key, first, inverse = distinct(own[ok] * len(self.words) + self.ids[ok])
            holder = key // max(len(self.words), 1)
            run_codes = mixed(codes[known][holder], self.words[key - holder * len(self.words)])
            by_code, total = np.argsort(codes[known]), counts[known].astype(float)
            run = np.full(len(run), -1)
            run[ok] = inverse
            here = {"known": known, "contexts": codes[known], "by_code": by_code, "total": total, "holder": holder, "first": ok[first], "codes": run_codes, "order": np.argsort(run_codes), "logs": logs}
            self.order[length] = here
            if (RUNS, length) not in self.told and len(key) and length == upto:
                here["local"] = np.bincount(inverse, self.train[ok], len(key))
                return  # these are to be asked for
            answer = self.answer(RUNS, length, here["order"])
            here["counts"], here["mine"] = (answer >> np.uint64(1)).astype(np.int64), (answer & np.uint64(1)).astype(bool)
            counts, codes = here["counts"], run_codes
            if length <= weights:
                weight = self.answer(CONTEXTS, length, by_code)
                state = ~np.isnan(weight)
                logs = logs + np.append(np.where(state, weight, 0), 0)[own]
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = np.append(np.where(state[holder] & (counts >= s.least_count), np.log10((counts - s.discount) / total[holder]), np.nan), np.nan)[run]
                logs = np.where(np.isnan(value), logs, value)
        self.logs = logs

    def ask_runs(self, length: int) -> list[dict]:
        x = self.order[length]
        return self.ask(RUNS, length, x["codes"], x["order"], x["order"][:0], x["local"][x["order"]].astype(np.uint64)) if "local" in x else []

    def ask_contexts(self, length: int) -> list[dict]:
        """For each context, over the followers that this block speaks for: their number and occurrences, the sums of their probability after the shorter state and of the divergence's terms; and the context's occurrences."""
        x, s = self.order[length], self.settings
        mine = np.flatnonzero(x["mine"] & (x["counts"] >= s.least_count))
        holder, n = x["holder"][mine], len(x["total"])
        own = (x["counts"][mine] - s.discount) / x["total"][holder]
        below = 10 ** x["logs"][x["first"][mine]]
        whole = np.stack([np.bincount(holder, minlength=n), np.bincount(holder, x["counts"][mine], n), x["total"]]).astype(np.uint64)
        parts = np.stack([np.bincount(holder, below, n), np.bincount(holder, own * np.log2(own / below), n)])
        # Sums with 24 bits: the other bytes pack to nothing.
        sums = np.concatenate([whole, parts.astype(np.float32).astype(np.float64).view(np.uint64)]).T[x["by_code"]]
        at = np.flatnonzero(sums[:, 0] > 0)
        if length == 1:
            names = self.numbers_of(WORDS, 0, np.arange(len(self.words)), self.counts)
        else:
            names = self.numbers_of(RUNS, length - 1, self.order[length - 1]["order"], self.order[length - 1]["counts"])
        return self.ask(CONTEXTS, length, x["contexts"], x["by_code"], at, sums[at], names[x["known"]])

    def scores(self) -> pa.Table:
        n, s = len(self.doc_ids), self.settings
        per = lambda x: np.bincount(self.doc, x, n)
        return pa.table({
            "doc_id": pa.array(self.doc_ids, pa.int64(), mask=self.no_ids), "held_out": self.held_out, "n_tokens": per(None).astype(np.int64), "n_known": per(self.counts[self.ids] > 0).astype(np.int64),
            "train_tokens": np.full(n, s.train_tokens, np.int64), "base_score": per(self.base), "score": per(self.logs),
        })


def told_of(asked: pa.Table, settings: Settings) -> pa.Table:
    """Answers to all blocks' questions about one range of codes."""
    rows = sorted(asked.to_pylist(), key=lambda r: r["block"])
    kind, length, bucket = (rows[0][c] for c in ("kind", "length", "bucket"))
    codes = [np.cumsum(from_planes(r["codes"])) for r in rows]
    sizes = [len(c) for c in codes]
    codes, start = np.concatenate(codes), np.append(0, np.cumsum(sizes))
    order = np.argsort(codes, kind="stable")
    begins = np.append(True, codes[order][1:] != codes[order][:-1])
    group = np.empty(len(codes), np.int64)
    group[order] = np.cumsum(begins) - 1
    n, numbers = int(begins.sum()), [None] * len(rows)
    if kind == CONTEXTS:
        at = np.concatenate([from_planes(r["at"]).astype(np.int64) + i for r, i in zip(rows, start[:-1].tolist(), strict=True)])
        sums = np.concatenate([from_planes(r["sums"]).reshape(5, -1) for r in rows], axis=1)
        followers, times = (np.bincount(group[at], sums[k], n) for k in (0, 1))
        below, bits = (np.bincount(group[at], sums[k].view(np.float64), n) for k in (3, 4))
        total = np.ones(n)
        total[group[at]] = sums[2]
        own = (times - settings.discount * followers) / total
        with np.errstate(divide="ignore", invalid="ignore"):
            left, rest = 1 - own, np.maximum(1 - below, 1e-9)
            state = (followers > 0) & (total * (bits + left * np.log2(left / rest)) >= settings.least_bits)
            # Rounded to what a 4-byte number holds: the other bytes pack to nothing.
            out = np.where(state, np.log10(left / rest), np.nan).astype(np.float32).astype(np.float64)[group]
        out = [planes(out[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
    else:
        counts = np.bincount(group, np.concatenate([from_planes(r["sums"]) for r in rows]), n).astype(np.uint64)
        first = np.zeros(len(codes), np.uint64)
        first[order[begins]] = 1
        out = (counts[group] << np.uint64(1)) | first
        out = [planes(out[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
        if length < settings.depth:
            often = counts >= settings.least_context
            number = np.cumsum(often) - 1
            parts = (group[a:b] for a, b in zip(start[:-1], start[1:], strict=True))
            numbers = [planes(np.diff(number[g[often[g]]], prepend=0)) for g in parts]
    blocks = [r["block"] for r in rows]
    if kind == WORDS:
        blocks, out, numbers = [*blocks, ALL], [*out, planes(np.array([(counts > 0).sum()]))], [*numbers, None]
    return pa.table({"block": pa.array(blocks, pa.int64()), "kind": pa.array([kind] * len(out), pa.int32()), "length": pa.array([length] * len(out), pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "told": pa.array(out, pa.binary()), "numbers": pa.array(numbers, pa.binary())})


_ASKED = pa.schema([("kind", pa.int32()), ("length", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("codes", pa.binary()), ("at", pa.binary()), ("sums", pa.binary())])


def scored(texts: DataFrame, depth: int = 2, least_count: int = 2, least_context: int = 4, discount: float = 0.6, least_bits: float = 8.0, block_tokens: int = 1_500_000) -> DataFrame:
    """texts (doc_id, held_out, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from the texts that are not held out."""
    spark = texts.sparkSession
    small_batches(spark, 1000)
    n, tag = partitions(spark), uuid.uuid4().hex

    def put(rows: DataFrame, kind: str) -> str:
        """Add rows to a table that is bucketed as groups by block are dealt: what it holds is not moved again by any step."""
        name = f"corpusloom_{kind}_{tag}"
        rows.write.mode("append").bucketBy(n, "block").option("compression", "zstd").option("path", paths[kind]).saveAsTable(name)
        return name

    paths = {kind: new_path(spark, kind) for kind in ("blocks", "told")}
    blocks = spark.table(put(cut_blocks(texts, block_tokens), "blocks"))
    count, train = blocks.agg(F.count("*"), F.coalesce(F.sum("train_tokens"), F.lit(0))).first()
    settings = Settings(depth, least_count, least_context, discount, least_bits, max(n, count // 4))
    settings.train_tokens = train

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(Block(row, None, settings).ask_words(), schema=_ASKED)

    def answered(asked: DataFrame) -> DataFrame:
        """Everything told so far, the answers to these questions among it; they are dealt by block once, as they are written."""
        told = asked.groupBy("kind", "length", "bucket").applyInArrow(lambda t: told_of(t, settings), TOLD)
        with shuffles_dropped(spark):
            name = put(told.repartition(n, "block"), "told")
        spark.catalog.refreshTable(name)
        return spark.table(name)

    def step(told: DataFrame, f: Callable[[Block], pa.Table], schema: str) -> DataFrame:
        def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
            return f(Block(rows.to_pylist()[0], answers, settings)) if rows.num_rows else empty

        empty = pa.table({c.name: pa.array([], c.type) for c in (_ASKED if schema == ASKED else _SCORED)})
        return blocks.groupBy("block").cogroup(told.where(F.col("block") != ALL).groupBy("block")).applyInArrow(run, schema)

    told = answered(blocks.mapInArrow(words, ASKED))
    of_ranges = told.where(F.col("block") == ALL).select("told").toArrow().column("told").to_pylist()  # a number for each range of codes
    settings.distinct = int(sum(from_planes(x)[0] for x in of_ranges))
    for length in range(1, depth + 2):

        def ask(block: Block, length: int = length) -> pa.Table:
            block.levels(min(length, depth), length - 2)
            rows = block.ask_runs(length) if length <= depth else []
            rows += block.ask_contexts(length - 1) if length > 1 else []
            return pa.Table.from_pylist(rows, schema=_ASKED)

        told = answered(step(told, ask, ASKED))

    def final(block: Block) -> pa.Table:
        block.levels(depth, depth)
        return block.scores()

    return step(told, final, SCORED)


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, held_out: Column, **settings) -> DataFrame:
    """docs (doc_id, text) scored; learnt from those that held_out is not true of."""
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")), **settings)


def op10_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; learnt from the folds 0, 2, 3 and 4 of 5."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold_of(F.col("doc_id"), 5) == 1)
