"""Token counts of texts under a unigram segmentation, by dynamic programming shared along a trie.

The pieces come from a public vocabulary file, which has their order only. Their log-probabilities are learned from the
texts: they begin as -ln(r + 1) - ln(ln(V)) or so for the piece of rank r (Zipf's law), then ``ROUNDS`` times all distinct
words are segmented, the pieces counted, each word as often as the texts have it, and the probabilities set to the
pieces' add-one shares. A byte of a character without a piece costs ``BYTE_LOG_PROB``. A pre-token is a word with the word
mark before it; its segmentation is the one of greatest total, and of those the one with the fewest tokens.

The best (total, tokens) of a prefix depends on that prefix alone. So a task puts its distinct pre-tokens in a trie,
computes each prefix's state once, all prefixes of a length at a time in numpy (``Trie``), and reads the count at each
terminal. Texts then add up their words' counts. Words of more than LONG characters, whose prefixes hardly any other
word shares, are done one by one in sorted order, holding one path at a time, with the same result.

Null and empty texts have 0 tokens. Rows are never merged. Other columns take no part unless they are named in ``keep``; a
kept column must not be called n_words or n_tokens. Empty tables give no rows, and learning from them leaves Zipf's law.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage_table, unused

MARK = "▁"
BYTE_LOG_PROB = -16.0
#: Longer words are no part of a task's trie.
LONG = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
ROUNDS = 1
#: Words whose counts a task remembers; beyond this it forgets them all, which bounds its memory.
CACHE_WORDS = 1_000_000


class Unigram:
    """Pieces with log-probabilities; byte pieces (<0xNN>), control and unknown pieces are left out."""

    def __init__(self, pieces: list[str], counts: dict[str, int] | None = None):
        """Shares by Zipf's law, or by counts, with one added to each."""
        if counts is None:
            norm = math.log(sum(1 / (r + 1) for r in range(max(1, len(pieces)))))
            self.log_prob = {p: -math.log(r + 1) - norm for r, p in enumerate(pieces)}
        else:
            total = math.log(sum(counts.values()) + len(pieces))
            self.log_prob = {p: math.log(counts.get(p, 0) + 1) - total for p in pieces}
        self.longest = max(map(len, pieces), default=1)
        self.names = list(self.log_prob)
        self.tables = self._tables()

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        keep = [k for k in range(s.get_piece_size()) if not (s.is_byte(k) or s.is_control(k) or s.is_unknown(k))]
        return cls([s.id_to_piece(k) for k in sorted(keep, key=lambda k: (-s.get_score(k), k))])

    def states(self, text: str, states: list[tuple[float, int, int]], start: int) -> None:
        """Extends the states of text[:start] to those of all of text: (-total, tokens, -start of the last piece) of the best cut.

        Of equal cuts, that with the shorter last piece is taken. The last piece of a character without one is its bytes.
        """
        piece = self.log_prob.get
        for end in range(start + 1, len(text) + 1):
            total, tokens, _ = states[end - 1]
            size = len(text[end - 1].encode("utf-8", "surrogatepass"))
            best = (total - size * BYTE_LOG_PROB, tokens + size, 1 - end)
            for at in range(max(0, end - self.longest), end):
                p = piece(text[at:end])
                if p is not None:
                    total, tokens, _ = states[at]
                    new = (total - p, tokens + 1, -at)
                    if new < best:
                        best = new
            states.append(best)

    def _tables(self) -> list[tuple[np.ndarray, ...]]:
        """For each length: the hashes of its pieces in order, their numbers and log-probabilities, and which upper bits they have."""
        by_length: list[list[int]] = [[] for _ in range(self.longest + 1)]
        for k, p in enumerate(self.names):
            by_length[len(p)].append(k)
        out = []
        for length, own in enumerate(by_length):
            h = np.zeros(len(own), np.uint64)
            code = np.frombuffer("".join(self.names[k] for k in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), length) if length else None
            for j in range(length):
                h = h * _BASE + code[:, j]
            order = np.argsort(h)
            number = np.array(own, np.int64)[order]
            maybe = np.zeros(1 << 16, bool)
            maybe[(h >> np.uint64(48)).astype(np.int64)] = True
            out.append((h[order], number, np.array([self.log_prob[self.names[k]] for k in number.tolist()]), maybe))
        return out

    def counts(self, words: set[str]) -> dict[str, int]:
        """The tokens of each word, computed along the trie of all of them."""
        short = sorted(w for w in words if len(w) <= LONG)
        out = dict(zip(short, Trie(self, short).tokens().tolist(), strict=True)) if short else {}
        out.update((word, states[-1][1]) for word, states in self.walk([w for w in words if len(w) > LONG]))
        return out

    def pieces(self, words: dict[str, int]) -> Counter:
        """How often the segmentations of the words use each piece; words: how often there is each word."""
        short = sorted(w for w in words if len(w) <= LONG)
        out: Counter = Counter()
        if short:
            used = Trie(self, short).use(np.array([words[w] for w in short], float))
            out.update({self.names[k]: int(used[k]) for k in np.flatnonzero(used).tolist()})
        for word, states in self.walk([w for w in words if len(w) > LONG]):
            text, end = MARK + word, len(word) + 1
            while end:
                at = -states[end][2]
                if text[at:end] in self.log_prob:
                    out[text[at:end]] += words[word]
                end = at
        return out

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[tuple[float, int, int]]]]:
        """The words in sorted order, each with its states, which are good until the next one."""
        path, states = MARK, [(0.0, 0, 0)]
        self.states(path, states, 0)
        for word in sorted(words):
            text = MARK + word
            shared, most = 1, min(len(path), len(text))
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del states[shared + 1 :]
            self.states(text, states, shared)
            path = text
            yield word, states


class Trie:
    """The trie of sorted words with the word mark before them, one array a depth, and the best cut of each prefix.

    parent: the node above; total, tokens: -log-probability and tokens of the best cut; size, piece, before: length and
    number (-1: bytes) of its last piece, and the node where that begins. at: of each word that is so long, its node.
    """

    def __init__(self, model: Unigram, words: list[str]):
        text = MARK + MARK.join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(w) + 1 for w in words], np.int64)
        begin = np.cumsum(length) - length
        word, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        self.last, self.length = np.zeros(len(words), np.int64), length
        zero = np.zeros(1, np.int64)
        self.total, self.count, self.parent, self.hash = [np.zeros(1)], [zero], [zero], [np.zeros(1, np.uint64)]
        self.size, self.piece, self.before = [zero], [zero - 1], [zero]
        for depth in range(1, int(length.max()) + 1):
            stays = length[word] >= depth
            word, node = word[stays], node[stays]
            c = code[begin[word] + depth - 1]
            new = np.r_[True, (node[1:] != node[:-1]) | (c[1:] != c[:-1])]
            self._add(model, node[new], c[new])
            node = np.cumsum(new) - 1
            ends = length[word] == depth
            self.last[word[ends]] = node[ends]

    def _add(self, model: Unigram, parent: np.ndarray, c: np.ndarray) -> None:
        """The nodes of the next depth, with their best cuts."""
        depth = len(self.total)
        h = self.hash[-1][parent] * _BASE + c
        octets = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        total, count = self.total[-1][parent] - octets * BYTE_LOG_PROB, self.count[-1][parent] + octets
        size, piece, before = np.ones(len(c), np.int64), np.full(len(c), -1), parent.copy()
        above = parent
        for n in range(1, min(model.longest, depth) + 1):
            if n > 1:
                above = self.parent[depth - n + 1][above]
            hashes, number, log_prob, maybe = model.tables[n]
            if not len(hashes):
                continue
            own = h - self.hash[depth - n][above] * np.uint64(pow(int(_BASE), n, 1 << 64))
            hit = np.flatnonzero(maybe[(own >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(hashes, own[hit]), len(hashes) - 1)
            good = hashes[at] == own[hit]
            at, hit = at[good], hit[good]
            to = above[hit]
            t, k = self.total[depth - n][to] - log_prob[at], self.count[depth - n][to] + 1
            less = (t < total[hit]) | ((t == total[hit]) & (k < count[hit]))
            better = hit[less]
            total[better], count[better], size[better], piece[better], before[better] = t[less], k[less], n, number[at[less]], to[less]
        for rows, made in ((self.total, total), (self.count, count), (self.parent, parent), (self.hash, h), (self.size, size), (self.piece, piece), (self.before, before)):
            rows.append(made)

    def tokens(self) -> np.ndarray:
        """The number of tokens of each word."""
        out = np.zeros(len(self.last), np.int64)
        for depth in np.unique(self.length).tolist():
            own = self.length == depth
            out[own] = self.count[depth][self.last[own]]
        return out

    def use(self, weight: np.ndarray) -> np.ndarray:
        """How often each piece is used, each word as often as its weight says."""
        flow = [np.zeros(len(t)) for t in self.total]
        for depth in np.unique(self.length).tolist():
            own = self.length == depth
            flow[depth] += np.bincount(self.last[own], weight[own], len(flow[depth]))
        used = np.zeros(1 + max((int(p.max()) for p in self.piece), default=-1))
        for depth in range(len(flow) - 1, 0, -1):
            on = np.flatnonzero(flow[depth])
            w, size, piece, before = flow[depth][on], self.size[depth][on], self.piece[depth][on], self.before[depth][on]
            known = piece >= 0
            used += np.bincount(piece[known], w[known], len(used))
            for n in np.unique(size).tolist():
                flow[depth - n] += np.bincount(before[size == n], w[size == n], len(flow[depth - n]))
        return used


def _words(text: bytes | None) -> list[str]:
    """The words of a text; one empty word if there are none."""
    return b" ".join((text or b"").split()).decode("utf-8", "replace").split(" ")


def learn(spark: SparkSession, docs: DataFrame, vocabulary: str | Unigram, text: str = "text", rounds: int = ROUNDS) -> Unigram:
    """The vocabulary with log-probabilities from all texts of docs. The driver gathers a count for each piece."""
    model = Unigram.from_file(vocabulary) if isinstance(vocabulary, str) else vocabulary

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            found: Counter = Counter()
            for x in batch.column(0).cast(pa.binary()).to_pylist():
                found.update(_words(x))
            found.pop("", None)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    words = docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = stage_table(spark, words, "word-counts")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def segment(batches, shared=shared):
            import pyarrow as pa

            found: Counter = Counter()
            for batch in batches:
                found.update(shared.value.pieces(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["piece", "n"])

        used = words.mapInArrow(segment, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece
        if used:
            model = Unigram(list(model.log_prob), {r["piece"]: r["n"] for r in used})
    return model


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary: str | Unigram, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with n_words and n_tokens; one pass without a shuffle.

    ``vocabulary`` is the path of a vocabulary file, which only the driver reads; its pieces are broadcast.
    """
    shared = spark.sparkContext.broadcast(Unigram.from_file(vocabulary) if isinstance(vocabulary, str) else vocabulary)
    rows = docs.select(*keep, F.col(text).alias(unused("text", docs.select(*keep).columns)))

    def run(batches):
        import pyarrow as pa

        model, known = shared.value, {}
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            n_words, n_tokens, k = [], [], 0
            while k < len(texts):
                group, fresh = [], set()
                while k < len(texts) and len(fresh) < CACHE_WORDS // 4:
                    group.append(words := _words(texts[k]))
                    fresh.update(words)
                    k += 1
                fresh.discard("")
                if len(known) + len(fresh) > CACHE_WORDS:
                    known = {}
                known |= model.counts({w for w in fresh if w not in known})
                known[""] = 0
                for words in group:
                    n_words.append(len(words) - words.count(""))
                    n_tokens.append(sum(map(known.__getitem__, words)))
            made = [pa.array(np.array(n_words, np.int64)), pa.array(np.array(n_tokens, np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "n_words", "n_tokens"])

    fields = rows.schema.fields[:-1]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))

