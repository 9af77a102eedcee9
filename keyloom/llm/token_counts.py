"""Token counts of SentencePiece BPE models by rank-synchronous array merging.

A text is cut where no piece of the vocabulary can span (before a mark that
stands for white space).  Words not counted before are held as ragged numpy
arrays of symbol ids; every round finds the best-ranked pair of each word,
leftmost on ties, and merges it in all words at once, until no word has a
mergeable pair.  A long word is one array of its own, in which all places of
its best-ranked pair are merged at once and only their neighbours are ranked
again, so its time grows with its length.  The symbols left are counted; an
unknown character counts one token for each UTF-8 byte.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
#: Remembered words of a worker; then the memory starts again (no effect on counts).
MEMORY = 600_000
NONE = np.int64(1) << 60
#: Characters from which a word is merged on its own (no effect on counts).
LONG = 256


class PieceBPE:
    def __init__(self, path: str, memory: int = MEMORY):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        normal = [x for x in model.pieces if x.type == 1]
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or any(x.type in (4, 5) for x in model.pieces):
            raise ValueError("only BPE models with identity normalisation and no user-defined pieces are served")
        if any(MARK in x.piece.lstrip(MARK) for x in normal):
            raise ValueError("a piece spans words")
        self.dummy = MARK if spec.add_dummy_prefix else ""
        self.bytes = model.trainer_spec.byte_fallback
        self.bound = memory
        # Symbol ids: pieces first, then characters that are in pieces but are none.
        self.symbol = {x.piece: k for k, x in enumerate(normal)}
        for x in normal:
            for c in x.piece:
                self.symbol.setdefault(c, len(self.symbol))
        self.known = len(normal)
        order = sorted(range(len(normal)), key=lambda k: (-normal[k].score, k))
        rank = {k: r for r, k in enumerate(order)}
        pairs = {}
        for k, x in enumerate(normal):
            for cut in range(1, len(x.piece)):
                a, b = self.symbol.get(x.piece[:cut]), self.symbol.get(x.piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank[k], k)
        self.pair = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[p][0] for p in self.pair.tolist()], np.int64)
        self.made = np.array([pairs[p][1] for p in self.pair.tolist()], np.int64)
        self.memory: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, keys), len(self.pair) - 1)
        hit = (self.pair[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NONE), at

    def merge(self, words: list[str]) -> np.ndarray:
        """Token count of each word."""
        if not words:
            return np.empty(0, np.int64)
        get = self.symbol.get
        text = "".join(words)
        symbols = np.fromiter((get(c, -1) for c in text), np.int64, len(text))
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        # Tokens of a character that never merges: its bytes, or one unknown.
        cost = np.ones(len(text), np.int64)
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.known))
        if self.bytes:
            cost[odd] = [len(text[k].encode("utf-8", "surrogatepass")) for k in odd.tolist()]
        counts = np.zeros(len(words), np.int64)
        while len(symbols):
            same = owner[1:] == owner[:-1]
            rank, at = self._ranks(symbols[:-1], symbols[1:])
            rank = np.where(same, rank, NONE)
            starts = np.flatnonzero(np.r_[True, ~same])
            best = np.minimum.reduceat(np.r_[rank, NONE], starts)
            # The last pair slot of a word belongs to no pair: it holds NONE.
            live = best < NONE
            lengths = np.diff(np.r_[starts, len(symbols)])
            done = ~np.repeat(live, lengths)
            np.add.at(counts, owner[done], cost[done])
            if not live.any():
                break
            wide = np.repeat(best, lengths)
            hit = np.flatnonzero((np.r_[rank, NONE] == wide) & ~done)
            hit = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]]  # leftmost
            symbols[hit] = self.made[at[hit]]
            cost[hit] = 1
            keep = ~done
            keep[hit + 1] = False
            symbols, owner, cost = symbols[keep], owner[keep], cost[keep]
        return counts

    def merge_long(self, word: str) -> int:
        """Token count of one word, as ``merge`` gives it."""
        symbols = np.fromiter((self.symbol.get(c, -1) for c in word), np.int64, len(word))
        cost = np.ones(len(word), np.int64)
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.known))
        if self.bytes:
            cost[odd] = [len(word[k].encode("utf-8", "surrogatepass")) for k in odd.tolist()]
        n = len(word)
        # Neighbours by place; place n is the end, with a symbol that joins nothing.
        symbols = np.append(symbols, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ranks, made = np.full(n + 1, NONE), np.zeros(n + 1, np.int64)
        todo: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def rank(at: np.ndarray) -> None:
            ranks[at], found = self._ranks(symbols[at], symbols[np.minimum(after[at], n)])
            made[at] = self.made[found]
            at = at[ranks[at] < NONE]
            at = at[np.argsort(ranks[at], kind="stable")]
            if len(at):
                for part in np.split(at, np.flatnonzero(np.diff(ranks[at])) + 1):
                    key = int(ranks[part[0]])
                    if key not in todo:
                        todo[key] = []
                        heapq.heappush(heap, key)
                    todo[key].append(part)

        rank(np.arange(n))
        while heap:
            best = heapq.heappop(heap)
            at = np.unique(np.concatenate(todo.pop(best)))
            at = at[ranks[at] == best]
            if not len(at):
                continue
            # Of pairs that overlap in a row, every other one from the left.
            opens = np.append(True, after[at[:-1]] != at[1:])
            k = np.arange(len(at))
            at = at[(k - np.maximum.accumulate(np.where(opens, k, 0))) % 2 == 0]
            # Where a merge gives a pair of better rank, that one is next: places further right wait.
            new, left, right = made[at], symbols[before[at]], symbols[after[after[at]]]
            left[before[at] < 0] = -1
            joined = np.flatnonzero(before[at[1:]] == after[at[:-1]]) + 1
            left[joined] = new[joined - 1]
            first = np.flatnonzero((self._ranks(left, new)[0] < best) | (self._ranks(new, right)[0] < best))
            if len(first) and first[0] + 1 < len(at):
                todo[best] = [at[first[0] + 1 :]]
                heapq.heappush(heap, best)
                at = at[: first[0] + 1]
            gone = after[at]
            symbols[at], cost[at] = made[at], 1
            cost[gone], symbols[gone], ranks[gone] = 0, -1, NONE
            after[at] = after[gone]
            before[np.minimum(after[at], n)] = at
            left = before[at]
            rank(np.unique(np.concatenate([at, left[left >= 0]])))
        return int(cost.sum())

    def counts(self, texts: list[str | None]) -> list[int]:
        """Token count of each text; null counts as empty."""
        split = []
        new: dict[str, None] = {}
        memory = self.memory
        if len(memory) > self.bound:
            memory.clear()
        for text in texts:
            words = self._words(text)
            split.append(words)
            for w in set(words):
                if w not in memory:
                    new[w] = None
        for w in [w for w in new if len(w) >= LONG]:
            del new[w]
            memory[w] = self.merge_long(w)
        fresh = list(new)
        for at in range(0, len(fresh), 1 << 16):
            part = fresh[at : at + (1 << 16)]
            memory.update(zip(part, self.merge(part).tolist()))
        return [sum(map(memory.__getitem__, words)) for words in split]

    def _words(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = self.dummy + text.replace(" ", MARK)
        words = text.split(MARK)
        if "" in words[1:]:
            # Runs of marks stay together with the word after them.
            out, run = [], 0
            for k, w in enumerate(words):
                run += k > 0
                if w or k == len(words) - 1:
                    if w or run:
                        out.append(MARK * run + w)
                    run = 0
            return out
        return ([words[0]] if words[0] else []) + [MARK + w for w in words[1:]]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceBPE:
    return PieceBPE(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs``.

    Null and empty texts have no bytes and no tokens.  Rows that repeat or lack
    an id are counted each; an empty table gives no rows; further columns are
    not read.  One pass, no shuffle.
    """

    def count(batches):
        model = counter(path)
        for batch in batches:
            texts = batch["text"].tolist()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": model.counts(texts)})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
