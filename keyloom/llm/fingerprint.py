"""64-bit SimHash fingerprints over three-word shingles.

The text is lower-cased in A-Z only, words are runs of non-white-space bytes
(white space: 0x20 and 0x09-0x0D), shingles are space-joined and hashed with
XXH64, seed 42.  A bit of the fingerprint is set when it is set in more than
half of the shingle hashes.  Null and word-free texts have fingerprint zero.
"""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
#: Shingle hashes whose bits are counted at once; bounds memory on long texts.
BLOCK = 1 << 16
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """Unsigned XXH64 of every shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(whole[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of a text as an unsigned 64-bit integer."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        octets = np.ascontiguousarray(hashes[at : at + BLOCK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[counts * 2 > len(hashes)].sum(dtype=np.uint64))


def signed(value: int) -> int:
    """The same 64 bits as a signed long."""
    return value - (1 << 64) if value >> 63 else value
