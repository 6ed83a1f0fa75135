"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of neighbouring symbols.

The normalised text starts as its characters. Every pair of neighbours that makes a piece is on an
agenda, the highest score first and the leftmost of equals; merging a pair puts its new neighbours on
the agenda. A character outside the vocabulary becomes the pieces of its UTF-8 bytes. No piece of such
a vocabulary has a word mark after another character (looked up when the model is read), so no merge
crosses the start of a word: a text is encoded word by word, and distinct words are kept in a memo of two
generations with a set size. The new words of a batch go through their agendas together, a round for each
merge; very long ones have a heap each. The words that a batch brings anew are encoded by the library too, in one
call, and a decoded text that is not the text itself is compared with the library's; `agrees` says
whether both were equal. Documents are encoded where they are read: there is no shuffle.

Cases: a null or empty text has the end id alone and decodes to an empty text; rows that repeat are
each kept; an empty table gives an empty result; other columns of the input are ignored; a word of any
length takes n log n steps. A
model with another normaliser, without byte pieces, or with symbols of
its user's is refused.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import id_text, small_batches

MARK = "▁"  # stands for a blank
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
_SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string, agrees boolean"
_LAST = 1 << 30
_coders: dict = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised message; floats are their four bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield field, raw[at : at + size]
        at += size


class PieceBPE:
    """Encoder and decoder of a model file."""

    def __init__(self, path: str, most: int = 400_000, longest: int = 40):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            model = [*_fields(file.read())]
        # The format's field numbers and kinds of pieces (2 unknown, 3 control, 4 user's, 5 unused, 6 byte).
        pieces = [dict(_fields(value)) for field, value in model if field == 1]
        trainer, normaliser = (dict(_fields(value)) for wanted in (2, 3) for field, value in model if field == wanted)
        kinds = [p.get(3, 1) for p in pieces]
        names = [p[1].decode() for p in pieces]
        plain = not normaliser.get(2) and normaliser.get(3, 1) and not normaliser.get(4, 1) and normaliser.get(5, 1)
        if trainer.get(3, 1) != 2 or not plain or {4, 5} & {*kinds} or kinds.count(6) != 256:
            raise ValueError("a merge-type model with byte pieces, a plain normaliser and no symbols of its user's is needed")
        if any(MARK in n.lstrip(MARK) for n, k in zip(names, kinds, strict=True) if k == 1):
            raise ValueError("a piece goes across the start of a word")
        self.id_of = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == 1}
        self.cost_of = {n: -struct.unpack("<f", pieces[i].get(2, b"\0\0\0\0"))[0] for n, i in self.id_of.items()}
        self.byte_ids = [i for i, k in enumerate(kinds) if k == 6]
        byte_at = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.written = [byte_at.get(i, b"" if k == 3 else " ⁇ ".encode() if k == 2 else n.replace(MARK, " ").encode()) for i, (n, k) in enumerate(zip(names, kinds, strict=True))]
        self.silent = {i for i, k in enumerate(kinds) if k == 3}
        self.bytes = {*self.byte_ids}
        self.words = {*self.id_of.values()}
        self._table(len(names))
        self.end = self.library.eos_id()
        self.most, self.longest = most, longest
        self.memo: dict[str, bytes] = {}  # `older` is the memo before it was last full
        self.older: dict[str, bytes] = {}
        self.differing: set[str] = set()

    def _table(self, pieces: int) -> None:
        """Symbols (pieces, then characters that only occur within pieces, then all others) and the pairs that make a piece."""
        self.pieces = pieces
        self.joining = sorted({c for n in self.id_of for c in n} - self.id_of.keys())
        self.symbols = pieces + len(self.joining)
        symbol = self.id_of | {c: pieces + i for i, c in enumerate(self.joining)}
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + self.symbols
        for name, s in symbol.items():
            if len(name) == 1:
                self.symbol_of[ord(name)] = s
        costs = {c: i for i, c in enumerate(sorted({*self.cost_of.values()}))}
        made = [(symbol[n[:i]] * self.symbols + symbol[n[i:]], costs[self.cost_of[n]], s) for n, s in self.id_of.items() for i in range(1, len(n)) if n[:i] in symbol and n[i:] in symbol]
        self.pair_keys, self.pair_places, self.pair_symbols = (np.array(x, np.int64) for x in zip(*sorted(made), strict=True))

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the agenda's order (and the symbols that the pairs become); pairs that make no piece come last."""
        keys = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        made = (self.pair_keys[at] == keys) & (right < self.symbols) & (left < self.symbols)
        return np.where(made, self.pair_places[at], _LAST), self.pair_symbols[at]

    def merged_together(self, words: list[str]) -> list[bytes]:
        """ids of words of bounded length: each round takes the first pair of every word's agenda."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbol, word = self.symbol_of[points], np.repeat(np.arange(len(words)), sizes)
        place, becomes = np.full(len(symbol), _LAST), np.zeros(len(symbol), np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])  # whose right neighbour is of the same word
        place[inner], becomes[inner] = self._pair(symbol[inner], symbol[inner + 1])
        done = []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            first = np.minimum.reduceat(place * len(symbol) + np.arange(len(symbol)), starts)  # the leftmost of equals
            open_ = first < _LAST * len(symbol)
            counts = np.diff(np.append(starts, len(symbol)))
            active = np.repeat(open_, counts)
            if not active.all():
                done.append((word[~active], symbol[~active]))
            at = first[open_] % len(symbol)
            symbol[at] = becomes[at]
            keep = active.copy()
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            symbol, word, place, becomes = symbol[keep], word[keep], place[keep], becomes[keep]
            for left in (at[(at > 0) & (word[at - 1] == word[at])] - 1, at):
                last = (left + 1 == len(word)) | (word[np.minimum(left + 1, len(word) - 1)] != word[left])
                place[left[last]] = _LAST
                left = left[~last]
                place[left], becomes[left] = self._pair(symbol[left], symbol[left + 1])
        word, symbol = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        ends = np.searchsorted(word, np.arange(len(words) + 1))
        raw = symbol.astype("<i4").tobytes()
        out = [raw[4 * i : 4 * j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for w in np.unique(word[symbol >= self.pieces]).tolist():  # characters that are no pieces
            ids = []
            for s in symbol[ends[w] : ends[w + 1]].tolist():
                ids.extend([s] if s < self.pieces else [self.byte_ids[b] for b in self.character(s).encode()])
            out[w] = np.asarray(ids, "<i4").tobytes()
        return out

    def character(self, symbol: int) -> str:
        return self.joining[symbol - self.pieces] if symbol < self.symbols else chr(symbol - self.symbols)

    def merged(self, word: str) -> list[int]:
        """ids of a normalised word of any length, by a heap over linked symbols."""
        cost, n = self.cost_of.get, len(word)
        end = list(range(1, n + 1))  # where the symbol that starts here ends; 0: none starts here
        before = list(range(-1, n))
        agenda = [(c, i, i + 2) for i in range(n - 1) if (c := cost(word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, stop = heapq.heappop(agenda)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of its symbols has been merged meanwhile
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (c := cost(word[i : end[stop]])) is not None:
                    heapq.heappush(agenda, (c, i, end[stop]))
            if (p := before[i]) >= 0 and (c := cost(word[p:stop])) is not None:
                heapq.heappush(agenda, (c, p, stop))
        out, i = [], 0
        while i < n:
            piece = word[i : end[i]]
            found = self.id_of.get(piece)
            out.extend([found] if found is not None else [self.byte_ids[b] for b in piece.encode()])
            i = end[i]
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """ids of words (without their first mark, further marks as blanks), compared with the library's."""
        found = {}
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            marked = [MARK + w.replace(" ", MARK) for w in part]
            short = [i for i, w in enumerate(marked) if len(w) <= self.longest]
            ids = [b""] * len(part)
            for i, x in zip(short, self.merged_together([marked[i] for i in short]), strict=True):
                ids[i] = x
            for i, w in enumerate(marked):
                if len(w) > self.longest:
                    ids[i] = np.asarray(self.merged(w), "<i4").tobytes()
            told = self.library.encode(part, num_threads=1)
            if "" in part:  # a mark alone, at the end of a text: the library gives an empty text none
                told[part.index("")] = [self.library.piece_to_id(MARK)]
            if np.fromiter(chain.from_iterable(told), "<i4").tobytes() != b"".join(ids):
                self.differing.update(w for w, x, y in zip(part, ids, told, strict=True) if x != np.asarray(y, "<i4").tobytes())
            found.update(zip(part, ids, strict=True))
        return found

    def encode(self, texts: pa.StringArray) -> tuple[pa.ListArray, list[bool]]:
        """ids of each text with the end id, and whether the library gives the same for all of its words."""
        texts = pc.replace_substring(texts, MARK, " ")
        words = pc.split_pattern(texts, " ")
        # Where blanks follow each other, or begin or end a text, the further ones belong to the next word.
        odd = pc.or_(pc.match_substring_regex(texts, "^ |  | $"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        rare = [[w[1:].replace(MARK, " ") for w in _WORD.findall(MARK + t.replace(" ", MARK))] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
        order = np.argsort(odd, kind="stable")  # regular texts first
        words = pa.concat_arrays([words.filter(pa.array(~odd)), pa.array(rare, words.type)])
        coded = words.flatten().dictionary_encode()
        names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()

        if len(self.memo) > self.most:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = [w for w in names if w not in memo]
        memo.update((w, older[w]) for w in new if w in older)
        memo.update(self._learn([w for w in new if w not in older]))
        known = [memo[w] for w in names]
        for w in new:
            if len(w) >= self.longest:
                del memo[w]

        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = np.cumsum(size) - size
        lengths = np.append(size[index], 0)  # of every word's ids; the last one is no word's
        texts_of = np.repeat(np.arange(len(order)), np.diff(words.offsets.to_numpy()))
        totals = np.bincount(texts_of, lengths[:-1], len(order)).astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(known), "<i4")[np.arange(begins[-1]) + np.repeat(at[index] - begins[:-1], lengths[:-1])]
        stops = np.cumsum(totals)
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, stops + np.arange(1, len(order) + 1)).astype(np.int32)), pa.array(np.insert(flat, stops, self.end).astype(np.int32)))
        same = np.ones(len(order), bool)
        if not self.differing.isdisjoint(names):
            same[texts_of[np.array([w in self.differing for w in names])[index]]] = False
        back = np.argsort(order, kind="stable")
        return ids.take(pa.array(back)), same[back].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first written piece loses one blank, bytes that are no UTF-8 become U+FFFD each."""
        raw = b"".join(map(self.written.__getitem__, ids))
        lead = next((i for i in ids if i not in self.silent), None)
        cut = lead in self.words and self.written[lead].startswith(b" ")
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._mended(ids)
        return text[1:] if cut else text

    def _mended(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, -1]:
            if i in self.bytes:
                run += self.written[i]
                continue
            while run:
                size = next((k for k in range(1, 5) if _is_character(run[:k])), 0)
                out.append(run[:size].decode() if size else "�")
                run = run[max(1, size) :]
            if i >= 0:
                out.append(self.written[i].decode())
        return "".join(out)


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def coder(path: str) -> PieceBPE:
    """One per Python worker."""
    if path not in _coders:
        _coders[path] = PieceBPE(path)
    return _coders[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded, agrees (ids and decoded are the library's), in input order."""
    small_batches(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(model)
        for batch in batches:
            texts = batch.column("text")
            lists, same = bpe.encode(texts.cast(pa.string()))
            ids = lists.to_pylist()
            decoded = [bpe.decode(x) for x in ids]
            # A text that comes back whole has been decoded as the library does; others are put to it.
            agrees = [s and (d == t or d == bpe.library.decode(x)) for s, d, t, x in zip(same, decoded, texts.to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.list_value_length(lists).cast(pa.int64()), lists, pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], ["doc_id", "n_tokens", "ids", "decoded", "agrees"])

    return id_text(docs).mapInArrow(run, _SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.selectExpr("doc_id", "n_tokens", "sha2(array_join(cast(ids AS array<string>), ' '), 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256", "agrees")


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256, agrees."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")))
