"""Whole texts to token ids: a piece of text is encoded once for as long as a task remembers it.

A byte-level BPE that splits words before merging never merges across a space that is followed by
a non-space, so a text may be cut there, the cuts encoded apart and their ids joined again. Most cut before
such a newline too, and between a word and the signs that end its line or go before a space. Arrow cuts the
texts and finds the distinct chunks of a call, each of which costs one dictionary lookup; chunks that several
calls met outlive the others. Literals of the vocabulary's added tokens (``<|endoftext|>``) keep their ids,
as in the library's plain call: a text ends and begins anew there.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lateweave.llm.common import per_process

# By whether a vocabulary cuts at lines and signs too: a text that has one of these takes the slower rule,
# which leaves it whole there.
_ODD_SPACE = {False: re.compile(r" (?=\s|\Z)"), True: re.compile(r"[ \n](?=\s|\Z)")}
_CUT = {False: re.compile(r"(?= \S)"), True: re.compile(r"(?=[ \n]\S)")}
# Chunks lack their leading space. None begins with white space otherwise, so these tell what had no space:
# a text's first chunk and the signs after a word. A chunk after a newline begins with it.
_FIRST, _SIGNS = "\t", "\v"
# Letters of the Latin blocks up to U+024F: the splitting rule keeps a run of them whole.
_L = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
_LATIN = re.compile(f"([{_FIRST}\n]?)({_L}+)")
_ENDINGS = f"({_L})([!-/:-@\\[-`{{-~]+)( |\n|\\z)"
# Texts by which a vocabulary shows whether it cuts at lines and signs, and writes bytes as letters.
_SAMPLES = ("the\nGröße", "Größe.\nThe,", "À,\na", "À\u024f***\nthe'\nof", "x\t\n\n\ny", "7)\n(8", "it's'.\n.a\r\nb's")
# Byte-level vocabularies write a byte that is no printable Latin-1 character as a letter from U+0100 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_LETTERS = {b: b for b in range(256)} | {b: 256 + i for i, b in enumerate(_HIDDEN)}
_SPACE_LETTER = chr(_BYTE_LETTERS[32])


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _raw(chunk: str) -> str:
    """A chunk as it stands in its text."""
    if chunk.startswith("\n"):
        return chunk
    return chunk[1:] if chunk.startswith((_FIRST, _SIGNS)) else " " + chunk


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans, one span after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class ChunkEncoder:
    """Encodes texts with the tokenizers library; ``limit`` bounds the remembered chunks."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path}: added tokens that take in what is beside them")
        # The library looks for the longest literal of a place; the group keeps it among the parts.
        self.literals = sorted((t.content for t in added), key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(map(re.escape, self.literals))})").split
        self.merge = self.tokenizer.model.tokenize
        self.limit = limit
        self.words = self.fine = True
        self.fine = self._splits_agree()  # cuts at lines and signs, and not only at spaces
        self._forget()
        self.words = self._ids_agree()  # words of letters are merges alone
        self._forget()

    @classmethod
    def of_process(cls, path: str, limit: int = 400_000) -> ChunkEncoder:
        """One encoder for all tasks that a worker process runs."""
        return per_process(("ChunkEncoder", path, limit), lambda: cls(path, limit))

    def _splits_agree(self) -> bool:
        """Whether the library splits the chunks of the samples as it splits the samples."""
        rule = self.tokenizer.pre_tokenizer
        if rule is None:
            return False
        return all([p for p, _ in rule.pre_tokenize_str(x)]
                   == [p for c in self._chunks([x])[0].to_pylist() for p, _ in rule.pre_tokenize_str(_raw(c))]
                   for x in _SAMPLES)

    def _ids_agree(self) -> bool:
        texts = [before + x for x in _SAMPLES for before in ("", "a ")]
        return self(texts)[0].tobytes() == b"".join(map(_packed, self._encode(texts)))

    def _forget(self) -> None:
        self.seen = _Numbers()
        self.size = 0
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.calls = np.zeros(0, dtype=np.int32)  # how many calls have met a chunk

    def _thin_out(self) -> None:
        """Keep the chunks that were met again, half of the limit at most; what they count for halves."""
        keep = np.flatnonzero(self.calls >= 2)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argsort(-self.calls[keep], kind="stable")[:self.limit // 2]])
        chosen = np.zeros(len(self.calls), dtype=bool)
        chosen[keep] = True
        kept = [chunk for chunk, stays in zip(self.seen, chosen.tolist()) if stays]
        pool, lengths = self.pool[_spans(self.starts[keep], self.lengths[keep])], self.lengths[keep]
        calls = self.calls[keep] // 2
        self._forget()
        self.seen.update(zip(kept, range(len(kept))))
        self._append(pool, lengths)
        self.calls = calls

    def _append(self, new: np.ndarray, lengths: np.ndarray) -> None:
        if self.size + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.size], np.zeros(self.size + 2 * len(new), np.uint32)])
        self.pool[self.size:self.size + len(new)] = new
        self.starts = np.concatenate([self.starts, self.size + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.calls = np.concatenate([self.calls, np.zeros(len(lengths), dtype=np.int32)])
        self.size += len(new)

    def _odd_chunks(self, text: str) -> list[str]:
        """Chunks of a text with literals, or with spaces that are no spaces before a non-space."""
        chunks = []
        # Spaces before a literal belong together: they are no spaces before a non-space.
        for part in self.split(text) if any(x in text for x in self.literals) else [text]:
            first, *others = _CUT[self.fine].split(part)
            chunks.append(_FIRST + first)
            chunks += [c[1:] if c.startswith(" ") else c for c in others]
        return chunks

    def _chunks(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All chunks without their leading space, one text after another, and the number of each text's."""
        odd = _ODD_SPACE[self.fine].search
        is_odd = [odd(t) is not None or any(x in t for x in self.literals) for t in texts]
        even = pa.array([_FIRST + t for t, o in zip(texts, is_odd) if not o], pa.large_string())
        if self.fine:
            even = pc.replace_substring_regex(even, _ENDINGS, f"\\1 {_SIGNS}\\2\\3")
            even = pc.replace_substring(even, "\n", " \n")
        lists = pc.split_pattern(even, " ")
        chunks, counts = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        if not any(is_odd):
            return chunks, counts
        rows = [self._odd_chunks(t) for t, o in zip(texts, is_odd) if o]
        more = pa.array([c for row in rows for c in row], pa.large_string())
        counts = np.concatenate([counts, np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))])
        places = np.argsort(np.argsort(is_odd, kind="stable"))
        starts = np.cumsum(counts) - counts
        order = _spans(starts[places], counts[places])
        return pa.concat_arrays([chunks, more]).take(pa.array(order)), counts[places]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model_ids(self, before: str, word: str) -> bytes:
        """Ids of a word of letters, which no splitting rule cuts: merges alone."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return _packed([t.id for t in self.merge(before + word)])

    def _learn(self, fresh: list[str]) -> None:
        """Encode new chunks and append their ids to the pool.

        A Latin word goes straight to the merges, anything else takes the whole way.
        """
        ids: list = [None] * len(fresh)
        rest, match, newline = [], _LATIN.fullmatch, _packed(self._encode(["\n"])[0])
        for i, chunk in enumerate(fresh):
            m = match(chunk) if self.words else None
            if m is None:
                rest.append(i)
            elif not m[1]:
                ids[i] = self._model_ids(_SPACE_LETTER, chunk)
            else:
                ids[i] = (b"" if m[1] == _FIRST else newline) + self._model_ids("", m[2])
        for i, found in zip(rest, self._encode([_raw(fresh[i]) for i in rest])):
            ids[i] = _packed(found)
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        self._append(np.frombuffer(b"".join(ids), dtype=np.uint32), lengths)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if len(self.seen) > self.limit:
            self._thin_out()
        chunks, per_text = self._chunks(texts)
        coded = chunks.dictionary_encode()
        distinct, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), len(self.seen)
        numbers = np.fromiter(map(self.seen.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        if len(self.seen) > known:
            # New chunks are numbered in the order in which they are met.
            self._learn([distinct[i] for i in np.flatnonzero(numbers >= known).tolist()])
        self.calls[numbers] += 1
        order = numbers[coded.indices.to_numpy()]
        lengths = self.lengths[order]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return (self.pool[_spans(self.starts[order], lengths)],
                np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])]))
