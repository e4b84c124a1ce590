"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

Pieces come from a SentencePiece model file. A file of merge ranks has no probabilities; its
pieces then get the log of a Zipf law over their rank. Spaces become the marker U+2581, one marker
is put before the text, characters without a piece fall back to byte pieces. No piece holds a
marker after another character, so the best path through a text is the best paths through its
words; where no piece joins a letter with anything but letters and markers either, words are cut
there too. Equal parts of a task are solved once.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateweave.llm.common import text_slices

MARKER = "▁"
# Subtracted from the lowest score for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
# Bytes of remembered words and their pieces in a task, about, and bytes of a word held as Python lists.
REMEMBERED_BYTES = 48_000_000
LIST_BYTES = 1 << 14
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_WORD = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
_OTHER = r"\W\d_¹²³¼½¾"
_LETTER = re.compile(f"[^{_OTHER}]")
# As _WORD, with runs of letters apart from all else.
_RUN = re.compile(f"{MARKER}*(?:[^{_OTHER}]+|(?:(?!{MARKER})[{_OTHER}])+)|{MARKER}+")


class DoubleArray:
    """A trie over byte strings: the child of node ``s`` by byte ``c`` is ``base[s] + c + 1`` if
    ``check`` of that slot is ``s``; ``value`` is the number of the string that ends there or -1."""

    def __init__(self, keys: list[bytes]):
        order = sorted((k, i) for i, k in enumerate(keys) if k)
        size = 1 << 16
        self.base, self.check, self.value = (np.full(size, x, dtype=np.int32) for x in (0, -1, -1))
        self.check[0] = 0
        free, todo = 1, [(0, 0, len(order), 0)]
        while todo:
            node, first, last, depth = todo.pop()
            groups, at = [], first
            while at < last and len(order[at][0]) == depth:
                self.value[node] = order[at][1]
                at += 1
            while at < last:
                byte, end = order[at][0][depth], at
                while end < last and order[end][0][depth] == byte:
                    end += 1
                groups.append((byte, at, end))
                at = end
            if not groups:
                continue
            while self.check[free] >= 0:
                free += 1
                self._grow(free)
            base = self._room([g[0] for g in groups], free)
            self.base[node] = base
            for byte, start, end in groups:
                self.check[base + byte + 1] = node
                todo.append((base + byte + 1, start, end, depth + 1))
        used = int(np.flatnonzero(self.check >= 0)[-1]) + 1
        self.base, self.check, self.value = (x[:used].tolist() for x in (self.base, self.check, self.value))

    def _room(self, codes: list[int], free: int, window: int = 4096) -> int:
        """The first base from the first free slot on whose slots for all ``codes`` are free."""
        base = max(free - codes[0] - 1, 0)
        if len(codes) == 1 and base + codes[0] + 1 == free:
            return base
        while True:
            self._grow(base + window + 257)
            fits = self.check[base + codes[0] + 1:base + codes[0] + 1 + window] < 0
            for c in codes[1:]:
                fits &= self.check[base + c + 1:base + c + 1 + window] < 0
            found = int(fits.argmax())
            if fits[found]:
                return base + found
            base += window

    def _grow(self, slot: int) -> None:
        if slot >= len(self.check):
            more = max(slot + 1 - len(self.check), len(self.check))
            self.base, self.check, self.value = (
                np.concatenate([x, np.full(more, y, dtype=np.int32)])
                for x, y in ((self.base, 0), (self.check, -1), (self.value, -1)))

    def get(self, key: bytes) -> int:
        """The number of ``key``, -1 if it is not in the trie."""
        node = 0
        for byte in key:
            slot = self.base[node] + byte + 1
            if slot >= len(self.check) or self.check[slot] != node:
                return -1
            node = slot
        return self.value[node]


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]            # piece of each byte
    plain: list[int]               # numbers of the pieces that text may be cut into
    worth: list[float]             # their scores
    trie: DoubleArray
    unknown: float
    parts: re.Pattern              # parts of a text that no piece goes beyond

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n)
                 if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = [sp.get_score(i) for i in range(n)]
        # Merge ranks are whole numbers 0, -1, -2, ...; log probabilities are not.
        ranks = sorted((-scores[i] for i in plain), reverse=True)
        if ranks and all(r == int(r) for r in ranks):
            for i in plain:
                scores[i] = -math.log(2 - scores[i]) if scores[i] <= 0 and scores[i] > -n else -math.log(n + 2)
        return cls.build(pieces, scores, plain)

    @classmethod
    def build(cls, pieces: list[str], scores: list[float], plain: list[int]) -> PieceModel:
        found = {int(m[1], 16): i for i, p in enumerate(pieces) if (m := _BYTE_PIECE.fullmatch(p))}
        if len(found) != 256:
            raise ValueError("the model has no piece for every byte")
        for i in plain:
            if MARKER in pieces[i].lstrip(MARKER):
                raise ValueError(f"piece {pieces[i]!r} goes on after a marker inside it")
        trie = DoubleArray([pieces[i].encode() for i in plain])
        lowest = min((scores[i] for i in plain), default=0.0)
        kinds = [[bool(_LETTER.match(c)) for c in pieces[i].lstrip(MARKER)] for i in plain]
        mixed = any(any(k) and not all(k) for k in kinds)
        return cls(pieces, scores, [found[b] for b in range(256)], plain, [scores[i] for i in plain], trie,
                   lowest - UNKNOWN_PENALTY, _WORD if mixed else _RUN)

    def best_path(self, word: str) -> list[int]:
        """Ids of the cut with the largest summed score; the first one found wins a tie."""
        data = word.encode()
        n = len(data)
        if n > LIST_BYTES:  # a text without spaces: 20 bytes for each of its own, as packed numbers
            best, back, via = array("d", [-math.inf]) * (n + 1), array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        else:
            best, back, via = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        plain, worth, trie = self.plain, self.worth, self.trie
        base, check, value, slots = trie.base, trie.check, trie.value, len(trie.check)
        start = 0
        while start < n:
            lead = data[start]
            after = start + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, single, node, end = best[start], False, 0, start
            # The trie is walked in place: a generator per start would take most of the time.
            while end < n:
                slot = base[node] + data[end] + 1
                if slot >= slots or check[slot] != node:
                    break
                node = slot
                end += 1
                k = value[node]
                if k >= 0:
                    if end == after:
                        single = True
                    score = here + worth[k]
                    if score > best[end]:
                        best[end], back[end], via[end] = score, start, plain[k]
            if not single and here + self.unknown > best[after]:
                best[after], back[after], via[after] = here + self.unknown, start, -1
            start = after
        ids: list[int] = []
        while n:
            if via[n] >= 0:
                ids.append(via[n])
            else:
                ids.extend(self.byte_ids[b] for b in reversed(data[back[n]:n]))
            n = back[n]
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """Byte pieces become bytes, markers spaces; the marker before the text is dropped."""
        if not hasattr(self, "_raw"):
            self._raw = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else
                         p.replace(MARKER, " ").encode() for p in self.pieces]
        raw = self._raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text


class PieceEncoder:
    """Encodes texts; ``limit`` bounds the bytes of the remembered words."""

    def __init__(self, model: PieceModel, limit: int = REMEMBERED_BYTES):
        self.model, self.limit, self.known, self.held = model, limit, {}, 0

    def __call__(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit integers one after another."""
        if not text:
            return b""
        if self.held > self.limit:
            self.known, self.held = {}, 0
        known, path, out = self.known, self.model.best_path, []
        for word in self.model.parts.findall(MARKER + text.replace(" ", MARKER)):
            ids = known.get(word)
            if ids is None:
                ids = array("i", path(word)).tobytes()
                if len(ids) < LIST_BYTES:
                    known[word] = ids
                    self.held += 200 + 2 * len(word) + len(ids)  # with the entry and the two objects
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel.load(path)


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids of every whole text. NULL and empty texts have no ids. Extra columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(model_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(shared.value)
        for batch, texts in text_slices(batches):
            raw = [encoder.packed(t) for t in texts]
            ends = np.cumsum([0, *(len(x) // 4 for x in raw)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(encode, "doc_id bigint, ids array<int>"))


def piece_round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), text: ids and what they decode to.

    As ``encode_pieces`` and ``decode_pieces`` one after the other, in one pass: the ids of a text stay
    in its task. The decoded text differs from the given one where that holds U+2581, which becomes a
    space, as the library's own decoder has it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_model(model_path))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(shared.value)
        for batch, texts in text_slices(batches):
            raw = [encoder.packed(t) for t in texts]
            decoded = [shared.value.decode(np.frombuffer(x, np.int32).tolist()) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in raw], pa.int64()),
                 pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_pieces", "ids_crc32", "text"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(both, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, text string"))


def decode_pieces(encoded: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, text from doc_id, ids (and the ids, if wanted). NULL ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_model(model_path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            texts = [shared.value.decode([] if not x.is_valid else x.values.to_numpy().tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), *([ids] if keep_ids else [])],
                names=["doc_id", "text", *(["ids"] if keep_ids else [])])

    return encoded.select("doc_id", "ids").mapInArrow(
        decode, "doc_id bigint, text string" + (", ids array<int>" if keep_ids else ""))


def piece_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), text_md5 of the decoded text."""
    @F.pandas_udf("bigint")
    def crc(ids):
        return ids.map(lambda x: zlib.crc32(np.asarray(x, dtype="<u4").tobytes()))

    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), crc("ids").alias("ids_crc32"),
                          F.md5("text").alias("text_md5"))
