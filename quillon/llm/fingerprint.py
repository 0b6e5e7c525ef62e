"""SimHash fingerprints of texts: 4-word shingles of the ASCII-lower-cased words, hashed by XXH64 with seed 42."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE, SEED = 4, 42


def simhash(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' hashes, repeats included.

    A text of fewer words than a shingle is one shingle; a text without words, empty or null, has fingerprint 0.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * ones > len(h)].sum(dtype=np.uint64))
