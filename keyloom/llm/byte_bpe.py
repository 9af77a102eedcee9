"""Token ids of the tokenizers library for byte-level BPE files, memoised.

Encoding whole texts spends most of its time on words seen before.  This
encoder cuts a batch of texts where the pre-tokeniser always cuts (before a
lone blank or line feed), reduces the chunks to distinct ones, has the library
encode those it does not remember, and gathers the ids of all chunks at once;
strings and ids are Arrow and numpy arrays throughout.  The ids equal
``Tokenizer.encode(text, add_special_tokens=False)``; texts that hold an added
token, or runs of white space at a cut, go to the library whole.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Remembered chunks of a worker, some 30 bytes each (no effect on ids).
MEMORY = 1_000_000
#: Characters of text whose chunks are gathered at once, and chunks the library gets at once; both bound memory.
SLICE, CHUNKS = 8_000_000, 1 << 15
_MARKS = (",", ".")


class Ragged:
    """Arrays of ids end to end: ``ids``, and every array's ``lengths``."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = ids, lengths
        self.starts = np.cumsum(lengths) - lengths

    def take(self, at: np.ndarray) -> "Ragged":
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return Ragged(self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(total)], lengths)

    def plus(self, other: "Ragged") -> "Ragged":
        return Ragged(np.concatenate([self.ids, other.ids]), np.concatenate([self.lengths, other.lengths]))


class ByteBPE:
    """``ids(text)`` gives little-endian unsigned 16- or 32-bit ids as bytes, ``stream(texts)`` arrays of them."""

    def __init__(self, path: str, memory: int = MEMORY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"]
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        names = self.tokenizer.get_vocab()
        self._bytes = np.zeros(max(names.values()) + 1, np.int64)  # a token's bytes: one a letter of its name
        self._bytes[list(names.values())] = list(map(len, names))
        self._runs = re.compile(r"\s[ \n]").search
        self._marks = self._encode(pa.array(_MARKS))
        self.bound = memory
        self._known = pa.array([], pa.string())
        self._ids = Ragged(np.empty(0, self.dtype), np.empty(0, np.int64))

    def _encode(self, words: pa.Array) -> Ragged:
        """Every word by the library as a text of its own; the bytes of the ids tell where the next begins."""
        found, lengths = [], []
        for at in range(0, len(words), CHUNKS):
            part = words.slice(at, CHUNKS)
            ids = np.array(self.tokenizer.encode_batch_fast([part.to_pylist()], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
            ends = np.cumsum(np.asarray(pc.binary_length(part), np.int64))
            cuts = np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1
            found.append(ids)
            lengths.append(np.diff(cuts, prepend=0))
        return Ragged(np.concatenate(found or [np.empty(0, self.dtype)]), np.concatenate(lengths or [np.empty(0, np.int64)]))

    def _remembered(self, chunks: pa.Array) -> Ragged:
        """The ids of distinct chunks, which follow a blank unless they begin with a line feed."""
        at = np.asarray(pc.fill_null(pc.index_in(chunks, value_set=self._known), -1), np.int64)
        fresh = np.flatnonzero(at < 0)
        if not len(fresh):
            return self._ids.take(at)
        new = chunks.take(pa.array(fresh))
        words = pc.if_else(pc.starts_with(new, "\n"), new, pc.binary_join_element_wise(" ", new, ""))
        at[fresh] = len(self._known) + np.arange(len(fresh))
        every = self._ids.plus(self._encode(words))
        found = every.take(at)
        if len(every.lengths) <= self.bound:
            self._known, self._ids = pa.concat_arrays([self._known, new]), every
        else:  # the memory starts again from what was just used
            self._known, self._ids = chunks, found
        return found

    def _distinct(self, names: pa.Array) -> Ragged:
        """The ids of distinct chunks; a mark after letters is a token of its own, so the letters are looked up alone."""
        body = pc.utf8_slice_codeunits(names, 0, -1)
        letters = np.asarray(pc.utf8_is_alpha(body))
        mark = np.zeros(len(names), np.int64)
        for k, c in enumerate(_MARKS):
            mark[np.asarray(pc.ends_with(names, c)) & letters] = k + 1
        bases = pc.if_else(pa.array(mark > 0), body, names).dictionary_encode()
        ids = self._remembered(bases.dictionary)
        # Base and mark are two entries each; the mark of a chunk without one is an empty entry.
        table = ids.plus(Ragged(np.empty(0, self.dtype), np.zeros(1, np.int64))).plus(self._marks)
        pairs = np.empty(2 * len(names), np.int64)
        pairs[::2], pairs[1::2] = np.asarray(bases.indices), len(ids.lengths) + mark
        both = table.take(pairs)
        return Ragged(both.ids, both.lengths[::2] + both.lengths[1::2])

    def _odd(self, text: str) -> bool:
        return bool(self._runs(text)) or text[0] in " \n" or any(a in text for a in self.added)

    def _slice(self, texts: list[str | None]) -> list[np.ndarray]:
        out = [np.empty(0, self.dtype)] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if text and self._odd(text):
                out[k] = np.frombuffer(self.whole(text), self.dtype)
            elif text:
                plain.append(k)
        if not plain:
            return out
        chunks = pc.split_pattern(pa.array([texts[k].replace("\n", " \n") for k in plain], pa.string()), " ")
        offsets = np.asarray(chunks.offsets, np.int64)
        found = chunks.values.dictionary_encode()
        codes = np.array(found.indices, np.int64)
        # A text's first chunk has no blank before it, so it is encoded for itself.
        firsts = offsets[:-1]
        starts = self._encode(chunks.values.take(pa.array(firsts)))
        codes[firsts] = len(found.dictionary) + np.arange(len(plain))
        every = self._distinct(found.dictionary).plus(starts).take(codes)
        ends = np.cumsum(every.lengths)[offsets[1:] - 1]
        for k, a, b in zip(plain, [0, *ends.tolist()], ends.tolist()):
            out[k] = every.ids[a:b]
        return out

    def stream(self, texts: Iterable[pa.Scalar | str | None]) -> Iterator[np.ndarray]:
        """The ids of every text of an Arrow column or a list; slices bound the memory."""
        part: list[str | None] = []
        held = 0
        for text in texts:
            part.append(text.as_py() if isinstance(text, pa.Scalar) else text)
            held += len(part[-1] or "")
            if held >= SLICE:
                yield from self._slice(part)
                part, held = [], 0
        yield from self._slice(part)

    def whole(self, text: str) -> bytes:
        """The ids as the library gives them for the whole text."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def ids(self, text: str | None) -> bytes:
        return next(self.stream([text])).tobytes()


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> ByteBPE:
    """One encoder a worker process; its memory outlives the task."""
    return ByteBPE(path)
