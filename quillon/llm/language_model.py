"""LM scoring: a log-bilinear neural model of words with noise-contrastive estimation, and an add-0.1 unigram base.

Tokens are ASCII-lower-cased words and one end per text. Token counts are taken over all training rows. The *units* of
the model are the most frequent words: all with MIN_COUNT tokens or more, up to ROOT * sqrt(N) of N training tokens, so
their number grows with the input; the head bounds it, which bounds what is broadcast: some 150 bytes a word, 40 MB for HEAD
words, which bind from 1.7e10 tokens on. A larger head is a parameter; words outside it are scored all the same. The SINGLES most frequent ones and
the end are classes of their own. The other words form classes by their last two bytes (a frequent ending is split by a
hash, rare ones share a class), so that a class has about as many units as there are classes; one more unit of each
class, its *rest*, stands for its words that are no units.

The context is the last CONTEXT units. Its vector is the sum of their vectors, each scaled by weights of its place. A
token's probability is that of its class in the context, times that of its unit within the class in the context, and
for the rest that of the word within the rest, which is its add-0.1 share with one place for all unknown words. Both
levels are normalised over all their members by batched matrix products, so the probabilities of a context add up to 1.

Training is noise-contrastive at both levels, by mini-batches of consecutive tokens in numpy: noise classes are shared by
a batch, noise units are drawn from the token's own class. Copies of the model are trained side by side, each on some
WORKER_TOKENS tokens; their number follows the tokens, not the partitions of docs, so that a copy makes as many steps
at any size. The training rows are dealt to ROUNDS by a hash, each row to one round, and within a round to the copies.
Each copy draws noise of its own. A round ends with the copies' mean change of each vector, weighted by how often each
copy has used it; the first, small rounds keep the copies of the later ones from drifting apart.

Words meet their counts by 64-bit hashes. The counts of the HEAD most frequent words are broadcast; all others are
joined by a shuffle, in which no word is hotter than the least of the head.

Null and empty texts have one token, the end. Rows are told apart by their place in the input, so repeated rows and
null ids are scored row by row; a null doc_id counts as the empty text for the fold. With no training rows N and V are
0. Other columns of docs take no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, mix, stage_table, text_chunks

#: Numbers of a vector; the last one is the bias.
WIDTH = 16
CONTEXT = 5
HEAD = 1 << 18
MIN_COUNT, ROOT = 16, 2
SINGLES, ENDINGS = 63, 32
NOISE, NOISE_UNITS, RATE = 32, 4, 0.1
#: Tokens of a mini-batch: so few that a copy makes STEPS steps, between these bounds.
BATCH, STEPS = (256, 3072), 1024
#: The first size of context vectors; and the sixteenths of the training rows that each round learns from.
SPREAD, ROUNDS = 0.5, (1, 3, 12)
#: Tokens that a copy of the model is trained on, at least or so, and for each vector of the model.
WORKER_TOKENS, TOKENS_A_VECTOR = 1 << 22, 64
#: Tokens of a permutation of mini-batches.
PASS_TOKENS = 1 << 19
ADD = 0.1
#: The end's hash.
END = 1
#: Endings are told apart by their last two bytes.
KINDS = 1 << 16
_LOG10 = np.log(10.0)
#: Tokens that one matrix product takes.
ROWS = 512


def _tokens(texts: list[bytes | None]):
    """For runs of texts: (from, to, token hashes with an end each, kind of each token, first token of each text)."""
    for k, j, chunk in text_chunks([x and x.lower() for x in texts]):
        first = chunk.first + np.arange(len(chunk.first))
        n = first[-1]
        inner = np.ones(n, bool)
        inner[first[1:] - 1] = False
        h, kind = np.full(n, END, np.uint64), np.zeros(n, np.int64)
        h[inner] = chunk.hashes() if len(chunk.starts) else 0
        before = np.where(chunk.ends - chunk.starts > 1, chunk.buffer[chunk.ends - 2], 0)
        kind[inner] = chunk.buffer[chunk.ends - 1].astype(np.int64) * 256 + before
        yield k, j, h.view(np.int64), kind, first


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, kind, c): the token counts of all rows of docs; each task adds up its own first."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parts = [(h, kind) for _, _, h, kind, _ in _tokens(as_bytes(batch.column(0)))]
            if parts:
                h, at, n = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
                kind = np.concatenate([p[1] for p in parts])[at]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(kind.astype(np.int32)), pa.array(n)], ["h", "kind", "c"])

    return docs.select(text).mapInArrow(run, "h long, kind int, c long").groupBy("h").agg(F.first("kind").alias("kind"), F.sum("c").alias("c"))


def deal_kinds(units: np.ndarray, n: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(first class, number of classes) of each kind and the number of classes, from each kind's units and tokens.

    A class takes ``size`` units or a share of 1 / ENDINGS of the tokens, or so.
    """
    load = units / size + ENDINGS * n / max(1, n.sum())
    base, splits, made, shared, filled = np.zeros(KINDS, np.int64), np.ones(KINDS, np.int64), 0, -1, 0.0
    for k, x in enumerate(load.tolist()):
        if x > 1:
            base[k], splits[k] = made, round(x)
            made += round(x)
        else:
            if shared < 0 or filled + x > 1:
                shared, filled, made = made, 0.0, made + 1
            base[k], filled = shared, filled + x
    return base, splits, made


class Vocabulary:
    """The head's counts and units by hash, the classes' units, and what the rest of each class amounts to."""

    def __init__(self, h: np.ndarray, c: np.ndarray, kind: np.ndarray, n: int, v: int, kind_n: np.ndarray):
        """The head (by falling counts), N, V, and the number of tokens of each kind."""
        self.n, self.v = n, v
        word = np.flatnonzero(h != END)
        used = word[: min(int((c[word] >= MIN_COUNT).sum()), int(ROOT * n**0.5))]
        single, other = used[:SINGLES], used[SINGLES:]
        self.end = len(single)
        self.base, self.splits, made = deal_kinds(np.bincount(kind[other], minlength=KINDS), kind_n, max(64.0, len(used) ** 0.5))
        self.base += self.end + 1
        of = self.class_of(h[other], kind[other])
        other = other[np.argsort(of, kind="stable")]
        of = np.sort(of)
        self.classes = self.end + 1 + made
        size = np.bincount(of, minlength=self.classes) + 1
        self.start = np.concatenate([[0], np.cumsum(size)])  # of a class's units, the first is the rest
        self.units = int(self.start[-1])
        self.class_of_unit = np.repeat(np.arange(self.classes), size)
        unit = np.full(len(h), -1, np.int64)
        unit[single] = np.arange(self.end)
        unit[h == END] = self.end
        unit[other] = np.arange(len(other)) + of + 1
        self.unit_count = np.zeros(self.units)
        self.unit_count[unit[unit >= 0]] = c[unit >= 0]
        self.rest = np.ones(self.classes)
        of = self.class_of(h[used], kind[used])  # words of a class of their own have left this one
        self.left = np.bincount(of, c[used], self.classes), np.bincount(of, minlength=self.classes)
        order = np.argsort(h.view(np.uint64))
        self.h, self.c, self.unit = h[order], c[order], unit[order]
        self.bucket = np.searchsorted(self.h.view(np.uint64) >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64))

    def add_rests(self, number: np.ndarray, n: np.ndarray, v: np.ndarray) -> None:
        """Tells the totals of class_of(): class number, tokens and words, units included."""
        total, words = (-x.astype(float) for x in self.left)
        total[number] += n
        words[number] += v
        many = slice(self.end + 1, None)
        self.unit_count[self.start[:-1][many]] = total[many]
        self.rest[many] = total[many] + ADD * (words[many] + 1)

    def class_of(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The class of words that are none of their own."""
        return self.base[kind] + (h >> 32) % self.splits[kind]

    def look_up(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count in the head or -1, unit) of each token."""
        slot = (h.view(np.uint64) >> np.uint64(44)).astype(np.int64)
        at, stop = self.bucket[slot], self.bucket[slot + 1]
        count, unit = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
        left = np.flatnonzero(at < stop)
        while len(left):
            place = at[left]
            hit = self.h[place] == h[left]
            count[left[hit]], unit[left[hit]] = self.c[place[hit]], self.unit[place[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        none = np.flatnonzero(unit < 0)
        unit[none] = self.start[self.class_of(h[none], kind[none])]
        ends = none[h[none] == END]  # no training text has one
        unit[ends] = self.end
        return count, unit


def vocabulary(all_counts: DataFrame, most: int | None = None) -> Vocabulary:
    """The vocabulary with a head of ``most`` words, by default HEAD; it bounds the units, too."""
    most = most or HEAD
    total = all_counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    kind_n = np.zeros(KINDS)
    for r in all_counts.where(F.col("h") != END).groupBy("kind").agg(F.sum("c").alias("n")).collect():  # KINDS rows at most
        kind_n[r["kind"]] = r["n"]
    level = F.floor(64 * F.log2("c")).cast("int")
    room, least = most, 0
    for r in sorted(all_counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # 64 levels for each doubling
        if r["count"] > room:
            least = r["level"] + 1
            break
        room -= r["count"]
    head = all_counts.where((level >= least) | (F.col("h") == END)).select("h", "c", "kind").toArrow()  # most + 1 rows at most
    h, c, kind = (head.column(k).to_numpy().astype(np.int64) for k in range(3))
    order = np.lexsort((h, -c))
    words = Vocabulary(h[order], c[order], kind[order], total["n"] or 0, total["v"], kind_n)
    kinds = all_counts.sparkSession.createDataFrame(list(zip(range(KINDS), words.base.tolist(), words.splits.tolist(), strict=True)), "kind int, base long, splits long")
    number = F.expr("base + pmod(shiftright(h, 32), splits)").alias("number")
    sums = all_counts.where(F.col("h") != END).join(F.broadcast(kinds), "kind").groupBy(number).agg(F.sum("c"), F.count("*")).toArrow()  # a row for each class
    words.add_rests(*(sums.column(k).to_numpy() for k in range(3)))
    return words


def sequence(unit: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(units with CONTEXT times ``start`` before each text, place of each token in it)."""
    place = np.arange(len(unit)) + CONTEXT * (1 + np.repeat(np.arange(len(first) - 1), np.diff(first)))
    out = np.full(len(unit) + CONTEXT * (len(first) - 1), start, np.int64)
    out[place] = unit
    return out, place


def _sorted_sums(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct indices, sums of their rows); equal indices are neighbours."""
    begin = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    return index[begin], np.add.reduceat(rows, begin, axis=0)


def _by_index(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(index, kind="stable")
    return _sorted_sums(index[order], rows[order])


def log_sum_exp(s: np.ndarray, bound: float) -> np.ndarray:
    """The logarithm of the sum of each row's exponentials; s is used up, and no number in it is above bound."""
    top = s.max(axis=1) if bound > 60 else np.float32(0)
    if bound > 60:
        s -= top[:, None]
    np.exp(s, out=s)
    return np.log(s @ np.ones(s.shape[1], s.dtype)) + top


class Model:
    """Four tables of vectors: of units as context, of classes, of units in their class, and the weights of places."""

    names = ("context", "kind", "unit", "place")

    def __init__(self, tables: list[np.ndarray], start: np.ndarray):
        self.tables, self.start = tables, start
        self.context, self.kind, self.unit, self.place = tables
        self.class_of_unit = np.repeat(np.arange(len(start) - 1), np.diff(start))
        many = np.flatnonzero(np.diff(start) > 1)
        self.singles = int(many[0]) if len(many) else len(start)  # the first classes have one unit each

    @classmethod
    def new(cls, words: Vocabulary) -> Model:
        """Random context vectors; biases that give each class and unit its share of the training tokens."""
        draw = np.random.default_rng(11)
        context = draw.normal(0, SPREAD, (words.units + 1, WIDTH)).astype(np.float32)
        kind, unit = (np.zeros((n, WIDTH), np.float32) for n in (words.classes, words.units))
        c = words.unit_count + ADD
        by_class = np.add.reduceat(c, words.start[:-1])
        kind[:, -1], unit[:, -1] = np.log(by_class / c.sum()), np.log(c / by_class[words.class_of_unit])
        return cls([context, kind, unit, np.full((CONTEXT, WIDTH), 1.0 / CONTEXT, np.float32)], words.start)

    def hidden(self, seq: np.ndarray) -> np.ndarray:
        """The vectors of the contexts of seq[CONTEXT:]; their last number is 1, which the biases go with."""
        e = self.context[seq]
        n = len(seq) - CONTEXT
        q = e[CONTEXT - 1 : CONTEXT - 1 + n] * self.place[0]
        for k in range(1, CONTEXT):
            q += e[CONTEXT - 1 - k : CONTEXT - 1 - k + n] * self.place[k]
        q[:, -1] = 1
        return q

    def train(self, seq: np.ndarray, noise: np.ndarray, draw: np.random.Generator, scale: list[np.ndarray], used: list[np.ndarray]) -> None:
        """One noise-contrastive step on the tokens of seq[CONTEXT:]; normalisers are taken as 1, as usual for this loss.

        Tokens are taken in the order of their units, which is that of their classes too, so that equal ones are neighbours.
        """
        start = len(self.context) - 1
        order = np.argsort(seq, kind="stable")
        at = order[(order >= CONTEXT) & (seq[order] != start)] - CONTEXT
        if not len(at):
            return
        all_q = self.hidden(seq)
        q, unit = all_q[at], seq[at + CONTEXT]
        kind = self.class_of_unit[unit]

        def step(table: int, rows: np.ndarray, d: np.ndarray) -> None:
            """AdaGrad with one scale for each vector."""
            scale[table][rows] += np.einsum("rw,rw->r", d, d) / WIDTH
            self.tables[table][rows] += d * (RATE / np.sqrt(scale[table][rows]))[:, None]
            used[table][rows] += 1

        other = np.searchsorted(noise, draw.random(NOISE))
        log_noise = np.log(np.diff(noise, prepend=0.0) * NOISE).astype(np.float32)
        own, others = self.kind[kind], self.kind[other]
        e = _gap(np.einsum("bw,bw->b", q, own) - log_noise[kind])
        f = _gap(q @ others.T - log_noise[other]) - 1
        dq = e[:, None] * own + f @ others
        step(1, *_sorted_sums(kind, e[:, None] * q))
        step(1, *_by_index(other, f.T @ q))

        cut = int(np.searchsorted(kind, self.singles))
        if cut < len(kind):
            q2, u, kind = q[cut:], unit[cut:], kind[cut:]
            new = np.r_[True, kind[1:] != kind[:-1]]
            begin, group = np.flatnonzero(new), np.cumsum(new) - 1
            size = self.start[kind[begin] + 1] - self.start[kind[begin]]
            v = self.start[kind[begin]][:, None] + (draw.random((len(begin), NOISE_UNITS)) * size[:, None]).astype(np.int64)
            log_share = np.log(NOISE_UNITS / size).astype(np.float32)[group]
            own, others = self.unit[u], self.unit[v][group]
            e = _gap(np.einsum("bw,bw->b", q2, own) - log_share)
            f = _gap(np.einsum("bw,bkw->bk", q2, others) - log_share[:, None]) - 1
            dq[cut:] += e[:, None] * own + np.einsum("bk,bkw->bw", f, others)
            bad = np.add.reduceat((f[:, :, None] * q2[:, None, :]).reshape(len(q2), -1), begin, axis=0)
            step(2, *_sorted_sums(u, e[:, None] * q2))
            step(2, *_by_index(v.ravel(), bad.reshape(-1, WIDTH)))

        all_q[:] = 0
        all_q[at] = dq
        all_q[:, -1] = 0
        n, e = len(all_q), self.context[seq]
        back, d_place = np.zeros_like(e), np.empty_like(self.place)
        for k in range(CONTEXT):
            part = slice(CONTEXT - 1 - k, CONTEXT - 1 - k + n)
            back[part] += all_q * self.place[k]
            d_place[k] = np.einsum("bw,bw->w", all_q, e[part])
        step(0, *_sorted_sums(seq[order], back[order]))
        step(3, np.arange(CONTEXT), d_place)

    def log_probs(self, seq: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The natural log-probability of the unit at each place of seq, normalised over all units."""
        out, units = np.empty(len(place)), seq[place]
        kind = self.class_of_unit[units]
        q = self.hidden(seq)[place - CONTEXT]
        longest = float(np.sqrt(np.einsum("bw,bw->b", q, q).max(initial=0)))
        norm = [np.sqrt(np.einsum("bw,bw->b", t, t)) for t in (self.kind, self.unit)]
        for k in range(0, len(place), ROWS):
            part = slice(k, k + ROWS)
            s = q[part] @ self.kind.T
            own = s[np.arange(len(s)), kind[part]]
            out[part] = own - log_sum_exp(s, longest * norm[0].max())
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(len(self.start)))
        for c in np.flatnonzero((np.diff(self.start) > 1) & (np.diff(cuts) > 0)).tolist():
            members = slice(self.start[c], self.start[c + 1])
            bound = longest * norm[1][members].max()
            for k in range(cuts[c], cuts[c + 1], ROWS):
                at = order[k : min(k + ROWS, cuts[c + 1])]
                s = q[at] @ self.unit[members].T
                own = s[np.arange(len(s)), units[at] - self.start[c]]
                out[at] += own - log_sum_exp(s, bound)
        return out


def _gap(x: np.ndarray) -> np.ndarray:
    """1 - sigmoid(x)."""
    return 1 / (1 + np.exp(np.clip(x, -20, 20)))


def workers(tokens: int, vectors: int) -> int:
    """The number of copies that are trained side by side: it follows the tokens, not the partitions they come in.

    A copy of a large model takes more tokens, so that what copies send stays a part of the input.
    """
    return max(1, round(tokens / max(WORKER_TOKENS, TOKENS_A_VECTOR * vectors)))


def batch_size(tokens: int, copies: int) -> int:
    return int(min(max(tokens / copies / STEPS, BATCH[0]), BATCH[1]))


def train(spark: SparkSession, docs: DataFrame, words: Vocabulary, text: str = "text", rounds: tuple[int, ...] = ROUNDS, copies: int | None = None) -> Model:
    """Merges, round by round, the copies that the workers train on rows of docs dealt out anew by a hash."""
    import pyarrow as pa

    model = Model.new(words)
    copies = copies or workers(words.n, sum(len(t) for t in model.tables))
    batch_tokens = batch_size(words.n, copies)
    by_class = np.add.reduceat(words.unit_count, words.start[:-1])
    noise = np.cumsum(np.sqrt(by_class + 1))
    noise /= noise[-1]
    first_row = np.concatenate([[0], np.cumsum([len(t) for t in model.tables])])
    vector = [f"v{k}" for k in range(WIDTH)]
    deal, begin = F.xxhash64("doc_id", text), 0
    known = spark.sparkContext.broadcast(words)

    def as_units(batches):
        """Each text as its units, with its hash."""
        for batch in batches:
            deals = batch.column(0)
            for k, j, h, kind, first in _tokens(as_bytes(batch.column(1))):
                unit = known.value.look_up(h, kind)[1].astype(np.int32)
                yield pa.RecordBatch.from_arrays([deals.slice(k, j - k), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(unit))], ["deal", "units"])

    for number, size in enumerate(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, number=number, shared=shared):
            old = shared.value
            own, draw = Model([t.copy() for t in old.tables], old.start), np.random.default_rng((number, TaskContext.get().partitionId()))
            scale = [np.full(len(t), 0.1, np.float32) for t in own.tables]
            used = [np.zeros(len(t), np.int64) for t in own.tables]
            for batch in batches:
                lists = batch.column(0)
                first = lists.offsets.to_numpy().astype(np.int64)
                unit = lists.flatten().to_numpy().astype(np.int64)
                cuts = np.unique(np.r_[np.searchsorted(first, np.arange(0, len(unit), PASS_TOKENS) + first[0]), len(first) - 1])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    part = first[a : b + 1] - first[0]
                    seq, _ = sequence(unit[part[0] : part[-1]], part - part[0], words_units)
                    for k in draw.permutation(range(CONTEXT, len(seq), batch_tokens)).tolist():
                        own.train(seq[k - CONTEXT : k + batch_tokens], noise, draw, scale, used)
            for table, before, times, row in zip(own.tables, old.tables, used, first_row, strict=False):
                rows = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([pa.array((row + rows).astype(np.int32)), pa.array(times[rows]), *(pa.array(x) for x in (table[rows] - before[rows]).T)], ["k", "n", *vector])

        words_units = words.units
        mine = docs.select(deal.alias("deal"), F.col(text).alias("text")).where(F.pmod("deal", F.lit(sum(rounds))).between(begin, begin + size - 1))
        dealt = mine.mapInArrow(as_units, "deal long, units array<int>").repartition(copies, "deal").select("units")
        parts = dealt.mapInArrow(run, f"k int, n long, {', '.join(f'{x} float' for x in vector)}")
        merged = parts.groupBy("k").agg(*[(F.sum(F.col("n") * F.col(x)) / F.sum("n")).cast("float").alias(x) for x in vector]).toArrow()  # a row for each vector
        rows, values = merged.column("k").to_numpy(), np.stack([merged.column(x).to_numpy() for x in vector], axis=1)
        tables = []
        for table, row in zip(model.tables, first_row, strict=False):
            mine, table = (rows >= row) & (rows < row + len(table)), table.copy()
            table[rows[mine] - row] += values[mine]
            tables.append(table.astype(np.float32))
        model, begin = Model(tables, words.start), begin + size
        shared.unpersist()
    return model


def score(spark: SparkSession, docs: DataFrame, all_counts: DataFrame, words: Vocabulary, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row of docs; scores are log10 probabilities.

    A text gives one row with the sums of its head words, and a row for each distinct other word, which meets its count.
    """
    shared = spark.sparkContext.broadcast((words, model))
    base_total = float(np.log10(words.n + ADD * (words.v + 1)))

    def run(batches):
        import pyarrow as pa

        words, model = shared.value
        is_rest = np.zeros(words.units, bool)
        is_rest[words.start[:-1][words.end + 1 :]] = True
        rest_log = np.where(is_rest, np.log10(words.rest)[words.class_of_unit], 0)

        def rows(row, ids, head, h, n, known, base, lm):
            return pa.RecordBatch.from_arrays([pa.array(row), ids, pa.array(np.full(len(row), head)), pa.array(h), pa.array(n), pa.array(known), pa.array(base), pa.array(lm)], _PARTS)

        for batch in batches:
            row, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for k, j, h, kind, first in _tokens(as_bytes(batch.column(2))):
                c, unit = words.look_up(h, kind)
                head, known = c >= 0, np.log10(np.maximum(c, 0) + ADD)
                lm = model.log_probs(*sequence(unit, first, words.units)) / _LOG10 - rest_log[unit] + np.where(head & is_rest[unit], known, 0)
                base = np.where(head, known, 0) - base_total
                sums = [np.add.reduceat(x, first[:-1]) for x in (head.astype(np.int64), base, lm)]  # each text has an end at least
                uid = row[k:j]
                yield rows(uid, ids.slice(k, j - k), True, mix(uid.astype(np.uint64)).view(np.int64), np.diff(first), *sums)
                rest = np.flatnonzero(~head)
                text_of, hs = np.repeat(np.arange(j - k), np.diff(first))[rest], h[rest]
                order = np.lexsort((hs, text_of))
                text_of, hs = text_of[order], hs[order]
                begin = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (text_of[1:] != text_of[:-1])]) if len(hs) else np.zeros(0, np.int64)
                m, none = np.diff(np.r_[begin, len(hs)]), np.zeros(len(begin))
                at = k + text_of[begin]
                yield rows(row[at], ids.take(pa.array(at)), False, hs[begin], m, none.astype(np.int64), none, none)

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(text).alias("text"))
    parts = numbered.mapInArrow(run, f"row long, doc_id {kind}, head boolean, h long, n long, known long, base double, lm double")
    met = parts.join(all_counts.select("h", "c"), "h", "left")
    # A word outside the head meets its count here; a head row's h is a number of its own.
    tail = F.when(~F.col("head"), F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).otherwise(0.0)
    met = met.select("row", "doc_id", F.when(F.col("head"), F.col("n")).otherwise(0).alias("n"), F.when(~F.col("head") & F.col("c").isNotNull(), F.col("n")).otherwise(F.col("known")).alias("known"), (F.col("base") + tail).alias("base"), (F.col("lm") + tail).alias("lm"))
    out = met.groupBy("row", "doc_id").agg(F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lm").alias("score"))
    return out.drop("row")


_PARTS = ["row", "doc_id", "head", "h", "n", "known", "base", "lm"]


def fit_and_score(spark: SparkSession, docs: DataFrame, learning: Column, head: int | None = None) -> DataFrame:
    """Scores of all rows of docs (doc_id, text) by a model of the rows where ``learning`` holds; train_tokens is N. For head see vocabulary()."""
    docs = docs.select("doc_id", "text")
    own = docs.where(learning)
    all_counts = stage_table(spark, counts(own), "token-counts")
    words = vocabulary(all_counts, head)
    model = train(spark, own, words)
    return score(spark, docs, all_counts, words, model).withColumn("train_tokens", F.lit(words.n).cast("long"))
