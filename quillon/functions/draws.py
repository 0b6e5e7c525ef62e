"""Random draws that are functions of keys: the same keys give the same draw, in any order and number of tasks.

A draw is the upper 32 bits of the MD5 of its name and keys, so that any SQL engine can repeat it. name sets draws apart.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(name: str, *keys: str | Column) -> Column:
    """A number between 0 and 1, both excluded."""
    text = F.concat_ws(":", F.lit(name), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def below(n: int, name: str, *keys: str | Column) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(name, *keys) * n)


def between(low: float, high: float, name: str, *keys: str | Column) -> Column:
    return F.lit(float(low)) + uniform(name, *keys) * float(high - low)


def chance(p: float, name: str, *keys: str | Column) -> Column:
    """True with probability p."""
    return uniform(name, *keys) < p


def normal(mean: float, sd: float, name: str, *keys: str | Column) -> Column:
    """A normally distributed number, from two uniform ones."""
    length = F.sqrt(-2 * F.log(uniform(name + "-length", *keys)))
    return F.lit(float(mean)) + F.lit(float(sd)) * length * F.cos(2 * math.pi * uniform(name + "-angle", *keys))


def exponential(rate: float, name: str, *keys: str | Column) -> Column:
    return -F.log(uniform(name, *keys)) / float(rate)


def shuffled(items: Column, name: str, key: str | Column) -> Column:
    """The items of an array in a drawn order; of equal draws the smaller item first."""
    key = F.col(key) if isinstance(key, str) else key
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(uniform(name, key, x).alias("u"), x.alias("x")))), lambda s: s["x"])


def sample(items: Column, n: int, name: str, key: str | Column) -> Column:
    """n items of an array, without replacement."""
    return F.slice(shuffled(items, name, key), 1, n)


# ---- the same draws in tasks, over arrays ---------------------------------------------------------------------------------

#: Texts that are hashed at a time; the most bytes that MD5 takes in one block.
LANES, ONE_BLOCK = 1 << 13, 55
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORDS = [(k, (5 * k + 1) % 16, (3 * k + 5) % 16, 7 * k % 16)[k // 16] for k in range(64)]
_SINES = [np.uint32(int(abs(math.sin(k + 1)) * (1 << 32))) for k in range(64)]


def md5_upper(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the MD5 of texts of at most ONE_BLOCK bytes: words (word, text), padded; sizes in bytes.

    They are the first of MD5's four words, which the last three rounds no longer touch.
    """
    n, length = words.shape[1], (sizes * 8).astype(np.uint32)
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f = np.empty(n, np.uint32)
    for k in range(61):
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += _SINES[k]
        at = _WORDS[k]
        if at < len(words):
            a += words[at]
        elif at == 14:
            a += length
        shift = _SHIFTS[k // 16][k % 4]
        np.left_shift(a, np.uint32(shift), out=f)
        a >>= np.uint32(32 - shift)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(0x67452301)
    return b.byteswap()


def tails(*keys: np.ndarray) -> np.ndarray:
    """The ends of the texts of uniform() that whole numbers make, as bytes."""
    out = np.zeros(len(keys[0]), "S1")
    for k in keys:
        each, at = np.unique(k, return_inverse=True)
        out = np.char.add(out, np.array([f":{x}".encode() for x in each.tolist()], bytes)[at])
    return out


def _words(texts: np.ndarray, at: int, closed: np.ndarray | None = None) -> np.ndarray:
    """(word, text): texts from byte at on, in words of four bytes; behind closed bytes comes the bit that ends a text."""
    n, wide = len(texts), texts.dtype.itemsize
    out = np.zeros((n, -(-(at + wide + (closed is not None)) // 4) * 4), np.uint8)
    out[:, at : at + wide] = texts.view(np.uint8).reshape(n, wide)
    if closed is not None:
        out[np.arange(n), at + closed] = 0x80
    return np.ascontiguousarray(out.view("<u4").T)


def upper(heads: list[str], head: np.ndarray, ends: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The upper 32 bits of uniform() over the texts heads[head] + ends[end]; heads begin with the name, ends are from tails()."""
    raw = [h.encode() for h in heads]
    h_size, e_size = np.array([len(h) for h in raw], np.int64), np.char.str_len(ends).astype(np.int64)
    out, shifted = np.zeros(len(head), np.uint32), {}
    for size in np.unique(h_size).tolist():
        some = np.flatnonzero(h_size[head] == size)
        if size + ends.dtype.itemsize > ONE_BLOCK:
            for k in some.tolist():
                out[k] = int.from_bytes(hashlib.md5(raw[head[k]] + ends[end[k]], usedforsecurity=False).digest()[:4], "big")
            continue
        whole, at = divmod(size, 4)
        if at not in shifted:
            shifted[at] = _words(ends, at, e_size)
        h_words = _words(np.array([h if len(h) == size else b"" for h in raw], f"S{max(1, size)}"), 0)
        e_words = shifted[at]
        for k in range(0, len(some), LANES):
            lanes = some[k : k + LANES]
            own, own_end = head[lanes], end[lanes]
            words = np.zeros((max(len(h_words), whole + len(e_words)), len(lanes)), np.uint32)
            for n, w in enumerate(h_words):
                words[n] = w[own]
            for n, w in enumerate(e_words, whole):
                words[n] |= w[own_end]
            out[lanes] = md5_upper(words, size + e_size[own_end])
    return out
