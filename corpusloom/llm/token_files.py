"""Token-ID / binary output: fixed-width bit packing with block offsets.

A token table is a folder with two Parquet tables. `blocks` holds one row per block of whole
documents: the ids of all its documents, each in `width` bits (the fewest that hold the
vocabulary), least significant bit first, in one binary payload, with the documents' ids and their
offsets inside the block. `shards` holds each shard's token total, from which a block's place in the
whole stream follows. Spark writes both, so a lost executor only repeats its own task, and the
folder may be in any store that Spark reaches. numpy unpacks a block at once; `read_range` touches
only the blocks that overlap the asked range.

Cases: a null or empty text has the end id alone; rows that repeat are kept, each with its own
place, ordered by doc_id and then by text; a null doc_id sorts first; an empty table gives empty
files; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import id_text, new_path, partitions, small_batches

BLOCK = "shard int, block int, start long, n_tokens long, width int, doc_ids array<long>, offsets array<long>, payload binary"
_SPACE = re.compile(r"[ \t\r\n]+")
_tokenizers: dict = {}


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold ids 0 .. vocabulary - 1."""
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids in width bits each, least significant bit first, padded to a whole byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, n: int, start: int = 0) -> np.ndarray:
    """n ids from position start on; only the bytes that hold them are looked at."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", n, start * width // 8).astype(np.uint32)
    first = start * width // 8
    raw = np.frombuffer(payload, np.uint8, (start + n) * width // 8 + bool((start + n) * width % 8) - first, first)
    bits = np.unpackbits(raw, bitorder="little")[start * width - 8 * first :][: n * width].reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class WordMemo:
    """ids of a text by the tokenizers library, each distinct blank-separated piece encoded once.

    The tokenizer must treat white space as a boundary that it drops, and end a run of letters or
    digits at a punctuation mark, as word-level BPE files do; then the ids of a text are those of its
    pieces in turn. `lowers` says whether it ignores the case of Latin letters. The memo has two
    generations of `most` pieces; those not met in the newer one are forgotten.
    """

    MARKS = ".,;:!?"
    PARTING = "|"  # stands between pieces that are encoded together; its id comes from nothing else

    def __init__(self, path: str, most: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.memo, self.older = {}, {}
        self.vocabulary = self.tokenizer.get_vocab_size()
        (self.parting,) = self._ids(self.PARTING)
        self.bare = self._without_steps()
        latin = "".join(map(chr, range(256)))
        self.lowers = all(self._ids(c) == self._ids(c.lower()) for c in latin) and self._ids(latin) == self._ids(latin.lower())

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _without_steps(self):
        """A tokenizer that skips normalising and splitting, for words of a to z alone; None if that gives other ids."""
        from tokenizers import Tokenizer

        steps = json.loads(self.tokenizer.to_str())
        words = sorted(w for w in (t.removesuffix("</w>") for t in self.tokenizer.get_vocab()) if _is_plain(w))
        bare = Tokenizer.from_str(json.dumps(steps | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        probes = [*words[:: max(1, len(words) // 500)], *(a + b for a, b in zip(words[::97], words[::89], strict=False)), self.PARTING]
        return bare if all(bare.encode(w, add_special_tokens=False).ids == self._ids(w) for w in probes) else None

    def _encode_all(self, pieces: list[str]) -> None:
        """Encode pieces, 250 to a line, and cut the ids where the parting mark stands."""
        memo, mark, plain = self.memo, self.PARTING, set()
        if self.bare is not None:
            plain = {*filter(_is_plain, pieces)}
        apart = [p for p in pieces if mark in p]
        for tokenizer, some in ((self.bare, [*plain]), (self.tokenizer, [p for p in pieces if p not in plain and mark not in p])):
            lines = [some[k : k + 250] for k in range(0, len(some), 250)]
            for line, e in zip(lines, tokenizer.encode_batch_fast([f" {mark} ".join(x) for x in lines], add_special_tokens=False) if lines else (), strict=True):
                ids = np.array(e.ids, "<u4")
                cuts = 4 * np.flatnonzero(ids == self.parting)
                starts, ends, ids = [0, *(cuts + 4).tolist()], [*cuts.tolist(), 4 * len(ids)], ids.tobytes()
                memo.update(zip(line, map(ids.__getitem__, map(slice, starts, ends)), strict=True))
        memo.update((p, np.array(self._ids(p), "<u4").tobytes()) for p in apart)

    def _learn(self, new: set[str]) -> None:
        """Put ids of pieces into the memo: those of an older generation, those of parts, and the rest by the library."""
        memo = self.memo
        self._recall(new)
        parts = []
        for p in [p for p in new if p[-1:] in self.MARKS]:
            stem = p.rstrip(self.MARKS)
            if stem[-1:].lower().isalnum():  # a run of letters or digits ends at a punctuation mark
                parts.append((p, stem, p[len(stem) :]))
        unknown = {stem for _, stem, _ in parts}.union(marks for _, _, marks in parts).difference(memo)
        self._recall(unknown)
        unknown.update(new)
        unknown.difference_update([p for p, _, _ in parts])
        self._encode_all([*unknown])
        memo.update([(p, memo[stem] + memo[marks]) for p, stem, marks in parts])

    def _recall(self, pieces: set[str]) -> None:
        """Move what the older generation knows of pieces to the newer one, and out of pieces."""
        if self.older:
            known = [p for p in pieces if p in self.older]
            self.memo.update(zip(known, map(self.older.__getitem__, known), strict=True))
            pieces.difference_update(known)

    def _folded(self, text: str) -> str:
        """A text in lower case, where that is what the tokenizer makes of it: Latin-1 letters, no marked-up special token."""
        if not self.lowers or "<|" in text:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    def encode(self, texts: list[str]) -> list[bytes]:
        """uint32 ids of each text."""
        out = []
        for k in range(0, len(texts), 250):
            pieces = [_pieces(self._folded(t)) for t in texts[k : k + 250]]
            if len(self.memo) > self.most:
                self.memo, self.older = {}, self.memo
            flat, memo = [*chain.from_iterable(pieces)], self.memo
            found = [*map(memo.get, flat)]
            missing = [i for i, ids in enumerate(found) if ids is None]
            if missing:
                names = [flat[i] for i in missing]
                self._learn({*names})
                for i, p in zip(missing, names, strict=True):
                    found[i] = memo[p]
            at = 0
            for x in pieces:
                out.append(b"".join(found[at : at + len(x)]))
                at += len(x)
        return out


def _is_plain(word: str) -> bool:
    """Of the letters a to z alone."""
    return word.isascii() and word.isalpha() and word.islower()


def _pieces(text: str) -> list[str]:
    """Parts between white space; str.split also splits at four control characters that are none."""
    return _SPACE.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


def _memo(path: str) -> WordMemo:
    if path not in _tokenizers:
        _tokenizers[path] = WordMemo(path)
    return _tokenizers[path]


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 1, block_tokens: int = 1 << 16) -> str:
    """Encode docs (doc_id, text) and write a token table to the folder `out`, in ascending doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = _memo(tokenizer), TaskContext.get().partitionId()
        width, tail = width_of(coder.vocabulary), b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
        block = start = 0
        names, parts, offsets = [], [], [0]

        def flush():
            nonlocal block, start, names, parts, offsets
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "start": start, "n_tokens": len(ids), "width": width, "doc_ids": names, "offsets": offsets, "payload": pack(ids, width)}], schema=schema)
            block, start, names, parts, offsets = block + 1, start + len(ids), [], [], [0]
            return row

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").to_pylist()), strict=True):
                names.append(doc_id)
                parts.append(ids + tail)
                offsets.append(offsets[-1] + len(parts[-1]) // 4)
                if offsets[-1] >= block_tokens:
                    yield flush()
        if names:
            yield flush()

    dealt = id_text(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(blocks, BLOCK).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/blocks")
    # One row a shard: the window over them all is as small as the number of partitions.
    totals = spark.read.schema(BLOCK).parquet(f"{out}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("shard_start", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0).cast("long"))).write.mode("overwrite").parquet(f"{out}/shards")
    return out


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with their place in the whole stream; shards has a row per partition of the writer."""
    shards = spark.read.schema("shard int, shard_tokens long, shard_start long").parquet(f"{path}/shards")
    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").join(F.broadcast(shards), "shard").withColumn("start", F.col("shard_start") + F.col("start"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["width"], row["n_tokens"])
                at = row["offsets"]
                spans = [ids[a:b].astype("<u4") for a, b in zip(at[:-1], at[1:], strict=True)]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["start"] + a for a in at[:-1]], pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array([zlib.crc32(s.tobytes()) for s in spans], pa.int64())]
                if with_ids:
                    cols.append(pa.array([s.tolist() for s in spans], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return _placed(spark, path).select("start", "n_tokens", "width", "doc_ids", "offsets", "payload").mapInArrow(documents, schema)


def read_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """position, id of the n tokens from `start` on in the whole stream; reads the overlapping blocks alone."""

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = max(start, row["start"]), min(start + n, row["start"] + row["n_tokens"])
                ids = unpack(row["payload"], row["width"], b - a, a - row["start"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(ids.astype(np.int64))], ["position", "id"])

    near = _placed(spark, path).where((F.col("start") < start + n) & (F.col("start") + F.col("n_tokens") > start))
    return near.select("start", "n_tokens", "width", "payload").mapInArrow(cut, "position long, id long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the files: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = write_tokens(docs, new_path(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_documents(spark, out, with_ids=False)
