"""Packing token ids into windows by non-negative least squares.

Each block of documents is packed on its own, in one pass and with no shuffle:

1. every document is cut into whole windows and a remainder;
2. shallow combinations of two or three remainder lengths that fill a window
   exactly are enumerated from the block's length histogram;
3. non-negative least squares gives the repeat count of each combination;
   counts are rounded down to what the histogram holds;
4. what is left is packed greedily: piece after piece, cut where a window is
   full.  The last, partial window is split into sequences whose lengths are
   powers of two, which need no padding.

A block is a bounded number of documents and of tokens of one input partition,
so memory is bounded and a lost executor's blocks are simply packed again.
Sequence ids are unique (input partition, then number), not dense.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .byte_bpe import encoder

#: Documents and tokens after which a block is packed.
BLOCK_DOCS, BLOCK_TOKENS = 20_000, 8_000_000
#: Most frequent remainder lengths that triples are enumerated from.
TRIPLE_LENGTHS = 24
SWEEPS = 12
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(histogram: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths, ascending, that sum to the window."""
    present = np.flatnonzero(histogram)
    there = set(present.tolist())
    found = [(a, window - a) for a in present.tolist() if 2 * a <= window and window - a in there]
    often = present[np.argsort(-histogram[present], kind="stable")][:TRIPLE_LENGTHS].tolist()
    triples = {tuple(sorted((a, b, window - a - b))) for a in often for b in often if a <= b and window - a - b in there}
    return found + sorted(triples)


def repeat_counts(histogram: np.ndarray, combos: list[tuple[int, ...]]) -> np.ndarray:
    """Non-negative least squares by coordinate descent, rounded down to fit.

    Minimises ``|histogram - A x|`` over ``x >= 0``, where column c of ``A``
    counts the lengths of combination c.
    """
    rest = histogram.astype(float).tolist()
    x = [0.0] * len(combos)
    norms = [sum(c.count(v) ** 2 for v in set(c)) for c in combos]
    for _ in range(SWEEPS):
        moved = 0.0
        for k, combo in enumerate(combos):
            step = max(sum(rest[v] for v in combo) / norms[k], -x[k])
            if abs(step) > 1e-9:
                x[k] += step
                moved = max(moved, abs(step))
                for v in combo:
                    rest[v] -= step
        if moved < 0.05:
            break
    left = histogram.astype(int).tolist()
    counts = np.zeros(len(combos), np.int64)
    for k in np.argsort(-np.array(x), kind="stable").tolist() if combos else []:
        combo = combos[k]
        n = min([int(x[k] + 0.5), *(left[v] // combo.count(v) for v in set(combo))])
        if n > 0:
            counts[k] = n
            for v in combo:
                left[v] -= n
    return counts


def pack(lengths: Iterable[int], window: int = 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents of these lengths."""
    pieces: list[tuple[int, int, int, int, int]] = []
    by_length: dict[int, list[tuple[int, int]]] = {}
    sequence = 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % window, window):
            pieces.append((doc, start, window, sequence, 0))
            sequence += 1
        if n % window:
            by_length.setdefault(n % window, []).append((doc, n - n % window))
    histogram = np.zeros(window, np.int64)
    for v, found in by_length.items():
        histogram[v] = len(found)
    combos = combinations(histogram, window)
    for combo, n in zip(combos, repeat_counts(histogram, combos).tolist()):
        for _ in range(n):
            offset = 0
            for v in combo:
                doc, start = by_length[v].pop()
                pieces.append((doc, start, v, sequence, offset))
                offset += v
            sequence += 1
    stream = [(doc, start, v) for v in sorted(by_length, reverse=True) for doc, start in by_length[v]]
    total = sum(v for _, _, v in stream)
    tail = [1 << k for k in reversed(range(window.bit_length())) if (total % window) >> k & 1]
    sizes = iter([window] * (total // window) + tail)
    room, size = 0, 0
    for doc, start, v in stream:
        while v:
            if not room:
                size = room = next(sizes)
                sequence += 1
            take = min(v, room)
            pieces.append((doc, start, take, sequence - 1, size - room))
            start, v, room = start + take, v - take, room - take
    return pieces


def pack_ids(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack ``docs`` into sequences of at most ``window`` ids; one row a piece.

    A document is the ids of its text followed by ``end_id``.  A null or empty
    text is ``end_id`` alone.  Rows that repeat, share or lack an id are each
    packed as a document of their own.  An empty table gives no rows; further
    columns are not read.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("the window must be a power of two, 2 at least")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        last = np.array([end_id], coder.dtype)
        base = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        data: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal base, held
            pieces = pack(map(len, data), window)
            cols = list(zip(*pieces)) or [()] * 5
            crc = [zlib.crc32(data[d][a : a + n].astype("<u4")) for d, a, n, _, _ in pieces]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[d] for d in cols[0]], pa.int64()),
                    pa.array(cols[1], pa.int64()),
                    pa.array(cols[2], pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([len(data[d]) for d in cols[0]], pa.int64()),
                    pa.array([base + s for s in cols[3]], pa.int64()),
                    pa.array(cols[4], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            base += max(cols[3], default=-1) + 1
            ids.clear()
            data.clear()
            held = 0
            return out

        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), coder.stream(batch.column(1))):
                ids.append(doc)
                data.append(np.concatenate([found, last]))
                held += len(data[-1])
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_TOKENS:
                    yield packed()
        if ids:
            yield packed()

    return docs.select(id_col, text_col).mapInArrow(blocks, SCHEMA)
