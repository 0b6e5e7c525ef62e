"""BPE encoding and decoding by a pair occurrence index.

All distinct pre-tokens that a task has not met yet lie in one symbol array. An index maps each adjacent pair that has
a merge rank to all its positions. Active ranks are taken in ascending order from a heap; a rank's positions merge in
one numpy step, and the pairs that the merge makes are added to the lists of their own ranks. A merge can only make
pairs of a later rank (``PairBpe`` checks this for its vocabulary), so one ascending sweep gives each pre-token the
result of the usual lowest-rank-first loop.

Texts are cut as the vocabulary file's normaliser and pre-tokeniser say: special tokens are found in the raw text, the
rest is NFC-normalised, lower-cased and cut at white space, letters, digits and other characters.

Nulls are empty texts. Empty texts give no tokens and an empty decoded text. Rows are kept as they are, ties and
repeated rows included; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Words that a task remembers; beyond this it forgets them all, which bounds its memory.
CACHE_WORDS = 600_000
#: White space as the file's \s knows it: the Unicode property. str.split() would also cut at 1C-1F.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_GAP = regex.compile(f"[{_SPACES}]+")
_SEPARATORS = regex.compile("[\\x1c-\\x1f]")
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")
_SUFFIX = "</w>"


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in set(plain))
    return [chr(c) for _, c in sorted([(b, b) for b in plain] + [(b, 256 + k) for k, b in enumerate(other)])]


class PairBpe:
    """The tables of a vocabulary file; small and picklable, so that the driver can broadcast them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.tokens = [""] * (1 + max(*vocab.values(), *self.special.values()))
        for token, k in (vocab | self.special).items():
            self.tokens[k] = token
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born: dict[int, int] = {}
        for rank, (a, b, c) in enumerate(zip(self.left.tolist(), self.right.tolist(), self.made.tolist(), strict=True)):
            if c in born or max(born.get(a, -1), born.get(b, -1)) >= rank:
                raise ValueError("a merge of this vocabulary can make a pair of an earlier rank")
            born[c] = rank
        if any(born.get(x, rank) > rank for rank, ab in enumerate(zip(self.left, self.right, strict=True)) for x in ab):
            raise ValueError("a merge of this vocabulary uses a token that a later merge makes")
        self.width = len(self.tokens)
        key = self.left * self.width + self.right
        self.rank_of = np.argsort(key, kind="stable")
        self.keys = key[self.rank_of]
        chars = _byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + _SUFFIX] for c in chars], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each non-empty pre-token."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        n = len(data)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[0], before[ends[:-1]] = -1, -1

        lists: dict[int, list[np.ndarray]] = {}

        def index(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for part, r in zip(np.split(at, cuts), rank[np.r_[0, cuts]].tolist() if len(rank) else [], strict=False):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(active, r)
                lists[r].append(part)

        active: list[int] = []
        index(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            parts = lists.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b, c = self.left[rank], self.right[rank], self.made[rank]
            at = at[(symbol[at] == a) & (after[at] >= 0)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # in a run of equal symbols, the leftmost pair goes first
                at, taken, used = np.sort(at), [], -1
                for p in at.tolist():
                    if p != used:
                        taken.append(p)
                        used = int(after[p])
                at = np.array(taken, np.int64)
            if not len(at):
                continue
            gone = after[at]
            symbol[at], symbol[gone] = c, -1
            after[at] = after[gone]
            has = after[at] >= 0
            before[after[at[has]]] = at[has]
            to_left = before[at]
            index(np.unique(np.concatenate([to_left[to_left >= 0], at[has]])))
        alive = symbol >= 0
        ids = symbol[alive]
        return np.split(ids, np.cumsum(alive)[ends[:-1] - 1])


class Encoder:
    """Texts to ids and back, with the words of a task remembered up to CACHE_WORDS."""

    def __init__(self, tables: PairBpe):
        self.t = tables
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        self.hint = os.path.commonprefix(list(tables.special))  # each text with a special token has this
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(tables.special, key=len, reverse=True))) + ")") if tables.special else None

    def words(self, text: str) -> list[str]:
        """The text cut at white space; special tokens are words of their own, marked by a leading line feed."""
        if self.special is not None and self.hint in text and self.special.search(text):
            out: list[str] = []
            for k, part in enumerate(self.special.split(text)):
                out += ["\n" + part] if k % 2 else self._cut(part)
            return out
        return self._cut(text)

    @staticmethod
    def _cut(text: str) -> list[str]:
        if _SEPARATORS.search(text):
            return [w for w in _GAP.split(text) if w]
        return text.split()

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not known yet."""
        if len(self.ids) + len(words) > CACHE_WORDS:
            self.ids.clear()
            self.decoded.clear()
        new = [w for w in words if w not in self.ids]
        cut: dict[str, list[str]] = {}
        pieces: dict[str, int] = {}
        for w in new:
            if w[0] == "\n":
                k = self.t.special[w[1:]]
                self.ids[w], self.decoded[w] = np.array([k], "<u4").tobytes(), self.t.tokens[k]
                continue
            form = w if w.isascii() else unicodedata.normalize("NFC", w).replace("Σ", "σ")
            cut[w] = found = _PIECES.findall(form.lower())
            for p in found:
                pieces.setdefault(p, len(pieces))
        coded = self.t.encode([p.encode() for p in pieces])
        raw = [x.astype("<u4").tobytes() for x in coded]
        shown = [" ".join([self.t.tokens[k] for k in x.tolist()]) for x in coded]
        for w, found in cut.items():
            at = [pieces[p] for p in found]
            self.ids[w] = b"".join([raw[k] for k in at])
            self.decoded[w] = " ".join([shown[k] for k in at])

    def __call__(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """The ids of each text as little-endian 32-bit integers, and the text that decoding them gives."""
        k = 0
        while k < len(texts):
            group, fresh = [], set()
            while k < len(texts) and len(fresh) < CACHE_WORDS // 2:
                group.append(words := self.words(texts[k]))
                fresh.update(words)
                k += 1
            self.learn(fresh)
            ids, decoded = self.ids, self.decoded
            for words in group:
                yield b"".join([ids[w] for w in words]), " ".join(filter(None, [decoded[w] for w in words]))


def encode(spark: SparkSession, docs: DataFrame, vocabulary: str, text: str = "text", *, ids: bool = True, decoded: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and on wish the ids (array<int>) and the decoded text.

    ``vocabulary`` is the path of the vocabulary file; only the driver reads it. A column of docs that has the name of
    one of these results is replaced. One pass without a shuffle; a task's memory is bounded by CACHE_WORDS words
    beside one Arrow batch.
    """
    shared = spark.sparkContext.broadcast(PairBpe(vocabulary))
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    made += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("decoded", T.StringType())] * decoded
    kept = [f for f in docs.schema if f.name not in {m.name for m in made}]
    at_text = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(at_text).to_pylist()]
            count, id_sum, text_sum, all_ids, all_texts = [], [], [], [], []
            for raw, back in encoder(texts):
                count.append(len(raw) // 4)
                id_sum.append(hashlib.sha256(raw).hexdigest())
                text_sum.append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    all_ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                if decoded:
                    all_texts.append(back)
            out = [batch.column(batch.schema.names.index(f.name)) for f in kept]
            out += [pa.array(count, pa.int64()), pa.array(id_sum, pa.string()), pa.array(text_sum, pa.string())]
            out += [pa.array(all_ids, pa.list_(pa.int32()))] * ids + [pa.array(all_texts, pa.string())] * decoded
            yield pa.RecordBatch.from_arrays(out, [f.name for f in kept] + [m.name for m in made])

    return docs.mapInArrow(run, T.StructType(kept + made))
