"""Byte-level BPE encoding and decoding by a two-tier lookup.

A pre-token (a match of the pattern) that is itself in the vocabulary is resolved by a minimal
perfect hash over the vocabulary. Any other goes through the merges, kept in a heap over a linked
list of its bytes, so that a run of n bytes takes O(n log n) steps. Both tiers are tables of the
size of the vocabulary; results of distinct pre-tokens are kept in a memo that is emptied at a set
size. Documents are encoded where they are read: there is no shuffle.

Cases: a null or empty text has no ids and decodes to no bytes; rows that repeat are each kept; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import id_text, small_batches

_coders: dict = {}


class PerfectHash:
    """Minimal perfect hash by displacement: n keys in n slots, one displacement per bucket.

    Buckets are placed from the largest on, each trying displacements until all its keys fall into
    free slots; buckets of one key take the free slots that are left, by their number.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        groups: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            groups.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(i)
        self.shift = [0] * self.buckets
        self.slots = [-1] * n
        free = 0
        for bucket, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                while self.slots[free] >= 0:
                    free += 1
                self.shift[bucket], self.slots[free] = -free - 1, members[0]
                continue
            seed = 1
            while len(at := {self._slot(keys[i], seed) for i in members}) < len(members) or any(self.slots[s] >= 0 for s in at):
                seed += 1
            self.shift[bucket] = seed
            for i in members:
                self.slots[self._slot(keys[i], seed)] = i

    def _slot(self, key: bytes, seed: int) -> int:
        return xxhash.xxh3_64_intdigest(key, seed) % self.n

    def find(self, key: bytes) -> int:
        """Place of the only key that this may be (the caller compares), or -1."""
        shift = self.shift[xxhash.xxh3_64_intdigest(key) % self.buckets]
        return self.slots[-shift - 1 if shift < 0 else self._slot(key, shift)]


class ByteBPE:
    """Encoder and decoder of a rank file (a base64 token and its rank in each line)."""

    def __init__(self, path: str, pattern: str, most: int = 400_000):
        import regex

        with open(path, "rb") as lines:
            pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]
        self.tokens, self.ids = [t for t, _ in pairs], [r for _, r in pairs]
        self.hash = PerfectHash(self.tokens)
        self.bytes_of = dict(zip(self.ids, self.tokens, strict=True))
        self.pieces = regex.compile(pattern).findall
        self.rank_of = dict(pairs)
        self.memo: dict[str, bytes] = {}
        self.most = most

    def whole(self, piece: bytes) -> int:
        i = self.hash.find(piece)
        return self.ids[i] if i >= 0 and self.tokens[i] == piece else -1

    def merged(self, piece: bytes) -> list[int]:
        """ids after merging, the pair of lowest rank (the leftmost of equals) first."""
        rank, n = self.rank_of.get, len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here
        before = list(range(-1, n))
        heap = []
        for i in range(n - 1):
            if (r := rank(piece[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of its parts has been merged meanwhile
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.rank_of[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        memo, pieces = self.memo, self.pieces(text)
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            pass
        new = [p for p in {*pieces} if p not in memo]
        if len(memo) + len(new) > self.most:
            memo.clear()
            new = [*{*pieces}]
        for p in new:
            raw = p.encode()
            found = self.whole(raw)
            memo[p] = np.asarray([found] if found >= 0 else self.merged(raw), "<u4").tobytes()
        return b"".join(map(memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, pattern: str) -> ByteBPE:
    """One per Python worker."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE(path, pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (bytes), in input order."""
    small_batches(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
