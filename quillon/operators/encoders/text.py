"""Encoders of documents, n-grams, characters and embeddings."""

from __future__ import annotations

import functools
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.functions.kernels import bits_udf, block, fnv, fnv_numbers, lcg_pick, sign_bits

from .base import Encoder
from .category import fnv_level

_MASK = (1 << 64) - 1


@dataclass
class SimHashDocumentEncoder(Encoder):
    """The places with the greatest weighted sums of the tokens' +-1 hash bits; equal sums go to the lower place.

    Text is cut at white space. Tokens among excludes are left out; with a vocabulary (token to weight) tokens outside it
    are left out too, unless orphans count 1. Of a token's occurrences in a text those up to floor and those beyond
    ceiling don't count (0: no limit). With token_similarity a token's characters add their own bits, and the token
    itself weighs 1.5 times, cut to a whole number. A text without tokens has no bits.
    """

    size: int = 400
    width: int = 21
    sparsity: float = 0.0
    case_sensitive: bool = False
    excludes: list[str] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    encode_orphans: bool = False
    frequency_floor: int = 0
    frequency_ceiling: int = 0
    token_similarity: bool = False

    def __post_init__(self):
        if self.sparsity > 0:
            self.width = int(self.size * self.sparsity + 0.5)
        require(0 < self.width < self.size, "width", "must be positive and below size")
        require(not self.encode_orphans or bool(self.vocabulary), "encode_orphans", "needs a vocabulary")
        require(not self.frequency_floor or not self.frequency_ceiling or self.frequency_floor < self.frequency_ceiling, "frequency_floor", "must be below the ceiling")

    def _signs(self, token: str) -> np.ndarray:
        rounds = -(-self.size // 64)
        hashes = np.array([fnv(token.encode(), fnv_level(r)) for r in range(rounds)], np.uint64)
        return np.unpackbits(hashes.view(np.uint8), bitorder="little")[: self.size].astype(np.int64) * 2 - 1

    def _weights(self, tokens: list[str]) -> Counter:
        """What each hashed string adds up to in a text."""
        total: Counter = Counter()
        seen: Counter = Counter()
        top = self.frequency_ceiling
        for t in tokens:
            t = t if self.case_sensitive else t.lower()
            if t in self.excludes or (self.vocabulary and t not in self.vocabulary and not self.encode_orphans):
                continue
            weight = self.vocabulary.get(t, 1)
            seen[t] += 1
            if seen[t] <= self.frequency_floor or (top and seen[t] > top):
                continue
            if self.token_similarity:
                for c, n in Counter(t).items():
                    total[c] += self.vocabulary.get(c, weight) * (min(n, top) if top else n)
            total[t] += int(weight * 1.5) if self.token_similarity else weight
        return total

    def encode(self, text: Column) -> Column:
        """text: a string, or an array of tokens."""

        def function(column):
            known: dict[str, np.ndarray] = {}
            out = []
            for row in column:
                if row is None:
                    out.append(None)
                    continue
                weights = self._weights(row.split() if isinstance(row, str) else [t for t in row if t is not None])
                for t in weights:
                    if t not in known:
                        known[t] = self._signs(t)
                sums = sum((w * known[t] for t, w in weights.items()), np.zeros(self.size, np.int64))
                out.append(np.argsort(-sums, kind="stable")[: self.width].tolist() if weights else [])
            return out

        return bits_udf(function)(text)


@dataclass
class NGramEncoder(Encoder):
    """Hashed bits of the first n-grams of characters or words; shorter texts have no bits."""

    n: int = 3
    size: int = 2048
    bits_per_gram: int = 3
    max_grams: int = 100
    word_level: bool = False

    def __post_init__(self):
        require(min(self.n, self.size, self.bits_per_gram, self.max_grams) > 0, "n", "all parameters must be positive")

    def grams(self, text: Column) -> Column:
        """array<string> of the n-grams that count."""
        if self.word_level:
            words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
            n, gram = F.size(words), lambda i: F.array_join(F.slice(words, i, self.n), " ")
        else:
            n, gram = F.length(text), lambda i: F.substring(text, i, F.lit(self.n))
        last = F.least(n - F.lit(self.n - 1), F.lit(self.max_grams))
        return F.when(text.isNull(), F.lit(None)).when(last >= 1, F.transform(F.sequence(F.lit(1), last), gram)).otherwise(F.array().cast("array<string>"))

    def gram_bits(self, gram: str) -> list[int]:
        h, out = fnv(gram.encode()), []
        for i in range(self.bits_per_gram):
            h = (h * 0x100000001B3 + i) & _MASK
            out.append(h % self.size)
        return out

    def encode(self, text: Column) -> Column:
        def function(column):
            known: dict[str, list[int]] = {}
            for row in column:
                for g in row if row is not None else ():
                    if g not in known:
                        known[g] = self.gram_bits(g)
            return [None if row is None else [b for g in row for b in known[g]] for row in column]

        return bits_udf(function)(self.grams(text))


@dataclass
class CharacterEncoder(Encoder):
    """A block of bits for each character of a set; with semantic_similarity neighbours share overlap bits."""

    characters: str = "".join(map(chr, range(32, 127)))
    width: int = 21
    include_unknown: bool = True
    semantic_similarity: bool = False
    overlap: int = 5
    strict: bool = True

    def __post_init__(self):
        require(bool(self.characters), "characters", "give at least one")
        require(self.width > 0, "width", "must be positive")
        require(not self.semantic_similarity or self.overlap < self.width, "overlap", "must be below width")
        self.step = self.width - self.overlap if self.semantic_similarity else self.width
        self.size = self.width + (len(self.characters) + self.include_unknown - 1) * self.step

    def encode(self, character: Column) -> Column:
        at = F.instr(F.lit(self.characters), character) - F.lit(1)
        known = F.length(character) == 1
        at = F.when(known & (at >= 0), at).when(character.isNotNull(), F.lit(len(self.characters) if self.include_unknown else -1))
        return self.within(at >= 0, block(at * F.lit(self.step), self.width), "unknown character")


@functools.cache
def lcg_planes(count: int, dim: int, seed: int) -> np.ndarray:
    """Planes whose values come from one linear congruential sequence: its upper 31 bits over half of 2**32 - 1, less one.

    31 bits never reach past half the range, so the values are at most 0; kept as it is, since results depend on it.
    """
    state, out = seed, np.empty(count * dim)
    for k in range(count * dim):
        state = (state * 6364136223846793005 + 1) & _MASK
        out[k] = (state >> 33) / (0xFFFFFFFF / 2) - 1.0
    return out.reshape(count, dim)


@functools.cache
def hashed_planes(count: int, dim: int, seed: int) -> np.ndarray:
    """Planes whose values come from the hashes of seed, plane and place."""
    plane, place = np.meshgrid(np.arange(count), np.arange(dim), indexing="ij")
    return (fnv_numbers(seed, plane, place) >> np.uint64(32)).astype(float) / 0xFFFFFFFF * 2 - 1


def _rows(column, dim: int | None) -> list[np.ndarray | None]:
    out = []
    for r in column:
        r = None if r is None else np.asarray(r, float)
        if r is not None and dim is not None and len(r) != dim:
            raise ValueError(f"expected {dim} numbers, got {len(r)}")
        out.append(r)
    return out


@dataclass
class WordEmbeddingEncoder(Encoder):
    """Bits picked from the signs of the products of an embedding with planes of a fixed seed."""

    dim: int = 300
    size: int = 2048
    width: int = 41
    num_planes: int = 128
    seed: int = 42

    def __post_init__(self):
        require(self.dim > 0 and self.num_planes > 0, "dim", "must be positive")
        require(0 < self.width <= self.size, "width", "must be positive and at most size")

    def states(self, column) -> list[int | None]:
        rows = _rows(column, self.dim)
        own = [r for r in rows if r is not None]
        signs = iter(sign_bits(np.stack(own), lcg_planes(min(self.num_planes, 64), self.dim, self.seed)) if own else [])
        return [None if r is None else next(signs) for r in rows]

    def encode(self, embedding: Column) -> Column:
        return bits_udf(lambda column: [None if s is None else lcg_pick(s, self.width, self.size) for s in self.states(column)])(embedding)


@dataclass
class PatchEncoder(WordEmbeddingEncoder):
    """The same for the pixels of a small image, row by row."""

    width_pixels: int = 8
    height_pixels: int = 8
    channels: int = 1
    size: int = 1024
    num_planes: int = 64

    def __post_init__(self):
        self.dim = self.width_pixels * self.height_pixels * self.channels
        super().__post_init__()


@dataclass
class GraphNodeEncoder(WordEmbeddingEncoder):
    """The same for a node's embedding, mixed with its degree and clustering coefficient where they aren't null."""

    dim: int = 64

    def encode(self, embedding: Column, degree: Column | None = None, clustering: Column | None = None) -> Column:
        degree = F.lit(None).cast("long") if degree is None else degree.cast("long")
        clustering = F.lit(None).cast("long") if clustering is None else F.greatest(F.lit(0), (clustering * 1000.0).cast("long"))

        def function(column, degrees, clusters):
            out = []
            for s, d, c in zip(self.states(column), degrees, clusters, strict=True):
                for value, factor in ((d, 0x517CC1B727220A95), (c, 0x2545F4914F6CDD1D)):
                    if s is not None and value is not None and value == value:
                        s = s + int(value) * factor & _MASK
                out.append(None if s is None else lcg_pick(s, self.width, self.size))
            return out

        return bits_udf(function)(embedding, degree, clustering)


@dataclass
class LlmEmbeddingEncoder(Encoder):
    """Bits picked from banded signs of products with hashed planes, for embeddings of any length.

    normalization: l2, mean or none. strategy: full, strided (every stride-th number) or chunked (a quarter of the numbers
    at a time, each over chunk_bits of its own). magnitude_bits > 0 adds a block for the length of the vector. At most width
    bits stay, the lowest ones.
    """

    size: int = 2048
    width: int = 41
    num_planes: int = 128
    num_bands: int = 4
    normalization: str = "l2"
    strategy: str = "full"
    stride: int = 1
    chunk_bits: int = 512
    magnitude_bits: int = 0
    seed: int = 42

    def __post_init__(self):
        require(self.normalization in ("l2", "mean", "none"), "normalization", "l2, mean or none")
        require(self.strategy in ("full", "strided", "chunked"), "strategy", "full, strided or chunked")
        require(0 < self.width <= self.size and self.num_bands > 0 and self.num_planes >= self.num_bands, "width", "bad sizes")
        self.main_bits = self.size - self.magnitude_bits
        self.main_width = self.width - (max(self.magnitude_bits // 4, 1) if self.magnitude_bits else 0)
        require(0 < self.main_width <= self.main_bits, "magnitude_bits", "leave room for the main bits")

    def planes(self, dim: int) -> np.ndarray:
        return hashed_planes(self.num_planes, dim, self.seed)

    def state(self, v: np.ndarray, planes: np.ndarray, start: int = 0) -> int:
        per_band = self.num_planes // self.num_bands
        step = self.stride if self.strategy == "strided" else 1
        signs = planes[:, : len(v) : step] @ v[::step] >= 0
        for band in range(self.num_bands):
            own = signs[band * per_band : band * per_band + min(per_band, 64)]
            word, turn = sum(1 << i for i, s in enumerate(own.tolist()) if s), band * 13 % 64
            start ^= (word << turn | word >> (64 - turn)) & _MASK if turn else word
        return start

    def bits_of(self, v: np.ndarray, planes: np.ndarray) -> list[int]:
        length = float(np.sqrt((v * v).sum()))
        if self.normalization == "l2":
            v = v / length if length > 1e-7 else v
        elif self.normalization == "mean":
            v = v - v.mean()
        step = len(v) // 4
        if self.strategy != "chunked" or step == 0:
            bits = set(lcg_pick(self.state(v, planes), self.main_width, self.main_bits))
        else:
            bits, offset = set(), 0
            for k in range(-(-len(v) // step)):
                taken = [b - offset for b in bits if offset <= b < offset + self.chunk_bits]
                room = min(self.chunk_bits, self.main_bits - offset)
                state, want, got, tries = self.state(v[k * step : (k + 1) * step], planes, k), max(self.main_width // 4, 1), 0, 0
                while got < want and len(taken) + got < room and tries < 1_000_000:
                    state, tries = (state * 6364136223846793005 + 1) & _MASK, tries + 1
                    b = offset + state % self.chunk_bits
                    if b < self.main_bits and b not in bits:
                        bits.add(b)
                        got += 1
                offset = offset + self.chunk_bits if offset + self.chunk_bits < self.main_bits else 0
        if n := self.magnitude_bits:
            bucket = int(min(1.0, math.log1p(length) / 5) * (n - 1) + 0.5)
            bits |= {self.main_bits + (bucket + i) % n for i in range(max(n // 4, 1))}
        return sorted(bits)[: self.width]

    def encode(self, embedding: Column) -> Column:
        def function(column):
            rows = _rows(column, None)
            planes = self.planes(max((len(r) for r in rows if r is not None), default=0))
            return [None if r is None or not len(r) else self.bits_of(r, planes) for r in rows]

        return bits_udf(function)(embedding)
