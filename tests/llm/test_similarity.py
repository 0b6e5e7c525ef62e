"""Near duplicates by Jaccard, whitening and hard negatives against brute force, and on awkward rows."""

import random
from fractions import Fraction
from math import floor, isfinite

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, hard_negatives, minhash_dedup, queries, whitening

from .test_llm import ODD, WORD, docs

VECTORS = "vec_id long, embedding array<float>, label int"
ODD_VECTORS = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, [1.0, None], 1), (200, None, 2), (300, [], 2), (400, [float("nan"), 1.0], 3), (500, [float("inf"), 1.0], 3),
               (None, [1.0, 1.0], 1), (600, [3.0], None), (7, [0.5, 0.5, 0.5], 0), (14, [1.0, 2.0], 9), (21, [1.0, 2.0], 2), (5, [1.0, 1.75], 2), (6, [1.0, 1.5], 2), (8, [1.0, 2.0], 1), (9, [3e38, -3e38], 1)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("id", F.lit(2))


def comparable(df, columns):
    return sorted(map(tuple, df.select(columns).collect()), key=repr)


# ---- near duplicates by Jaccard

def shingles(text):
    w = [x.lower() for x in WORD.findall((text or "").encode())]
    return frozenset([b" ".join(w)] if 0 < len(w) < 3 else [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)])


def near_brute(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    by_set, lists = {}, {}
    for k, text in rows:
        by_set.setdefault(shingles(text), []).append(k)
    unique = [s for s in by_set if s]
    root = list(range(len(unique)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at, s in enumerate(unique):
        seen = set()
        for v in s:
            seen.update(lists.setdefault(v, []))
            lists[v].append(at)
        for other in seen:
            shared = len(s & unique[other])
            if 100 * shared >= percent * (len(s) + len(unique[other]) - shared):
                root[find(at)] = find(other)
    least = {}
    for at, s in enumerate(unique):
        ids = [k for k in by_set[s] if k is not None]
        least.setdefault(find(at), []).extend(ids)
    out = []
    for at, s in enumerate(unique):
        c = min(least[find(at)], default=None)
        out += [(k, len(s), c, k is not None and k == c) for k in by_set[s]]
    return out + [(k, 0, k, k is not None) for k in by_set.get(frozenset(), [])]


def mined(spark, rows, **more):
    df = minhash_dedup.near_duplicates(spark, docs(spark, rows), **more)
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, df.collect()), key=repr)


def edited(draw, base, edits):
    w = list(base)
    for _ in range(edits):
        w[draw.randrange(len(w))] = f"e{draw.randrange(10**6)}"
    return w


@pytest.mark.parametrize("percent", [70, 85])
def test_minhash_near_copies(spark, percent):
    """Families of copies with few and many edits, chains, and passages that most documents share."""
    draw = random.Random(percent)
    passage = [f"p{k}" for k in range(90)]
    rows, k = [(n, x) for n, x in ODD], 100
    for family in range(12):
        base = [f"f{family}w{n}" for n in range(draw.choice([1, 2, 3, 4, 12, 40, 150, 300]))]
        now = base
        for _ in range(10):
            now = edited(draw, now if draw.random() < 0.5 else base, draw.choice([0, 1, 2, len(base) // 40]))
            rows.append((k, " ".join(now + (passage if draw.random() < 0.5 else []))))
            k += 1
    rows += [(k + n, " ".join([*passage, *(f"u{n}x{m}" for m in range(n % 17))])) for n in range(60)]
    draw.shuffle(rows)
    assert mined(spark, rows, percent=percent) == sorted(near_brute(rows, percent), key=repr)


def test_minhash_awkward(spark):
    assert mined(spark, ODD) == sorted(near_brute(ODD), key=repr)
    assert mined(spark, []) == []
    assert mined(spark, [(1, None), (2, "")]) == [(1, 0, 1, True), (2, 0, 2, True)]
    rows = docs(spark, [(1, "a b c d"), (2, "A b C d")]).withColumns({c: F.lit(5) for c in ("node", "digest", "n", "kept", "component_id", "v", "salt", "c0", "__text")})
    kept = minhash_dedup.near_duplicates(spark, rows, keep=[F.col("kept"), F.col("node")])
    assert sorted(map(tuple, kept.collect())) == [(1, 5, 5, 2, 1, True), (2, 5, 5, 2, 1, False)]
    texts = spark.createDataFrame([("b", "a b c d"), ("a", "a b c d")], "doc_id string, text string")
    assert sorted(map(tuple, minhash_dedup.near_duplicates(spark, texts).collect())) == [("a", 2, "a", True), ("b", 2, "a", False)]


def test_minhash_whole_table(spark, sf):
    rows = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]
    out = queries.op11_minhash(spark, sf).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, out.collect())) == sorted(near_brute(rows))


def test_minhash_limits(spark, monkeypatch):
    """Without broadcasts and with salts for any repeated key the rows are the same."""
    draw = random.Random(5)
    base = [f"w{n}" for n in range(60)]
    rows = [(k, " ".join(edited(draw, base, k % 3))) for k in range(60)] + [(100 + k, " ".join(base)) for k in range(20)]
    monkeypatch.setattr(minhash_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "SPREAD_ROWS", 2)
    assert mined(spark, rows) == sorted(near_brute(rows), key=repr)


def test_linked_sets_share_a_needed_list():
    """Random pairs at the similarity 0.85 or just above, of all sizes: the lists they share reach those that one can do without."""
    draw = np.random.default_rng(1)
    r = minhash_dedup.RETAINED
    for n in [*range(1, 250), *draw.integers(250, 5000, 100).tolist()]:
        one = draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        gone = int(draw.integers(0, n - -(-85 * n // 100) + 1))
        added = max(m for m in range(n + 1) if 100 * (n - gone) >= 85 * (n + m))
        other = np.concatenate([one[gone:], draw.integers(0, 2**63, added, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
        a, b = (np.unique(minhash_dedup.list_keys(np.sort(x)[:r])) for x in (one, other))
        for own, x in ((a, one), (b, other)):
            assert len(np.intersect1d(a, b)) > len(own) - int(minhash_dedup.lists_needed(len(x), 85))


# ---- whitening

def x_vectors(rows, d):
    out = []
    for k, v, _ in rows:
        if v is not None and all(c is not None and isfinite(c) for c in v):
            v = [float(np.float32(c)) for c in v] + [0.0] * (d - len(v))
            out.append((k, tuple(floor(max(-(2.0**40), min(2.0**40, 64 * c))) + 1_000_000 for c in v)))
    return out


def check_whitening(got, rows, d):
    kept = x_vectors(rows, d)
    fit = sorted({x for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[Fraction(n * a - b, n) for a, b in zip(x, s, strict=True)] for x in fit]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)])
    values = np.sort(np.linalg.eigvalsh(v))[::-1][:16]
    deviation = {x: sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for x in fit}
    assert len(got) == len(kept) * min(16, d)
    fits = [w if w < 2**63 else None for w in (deviation[x] for _, x in kept)]
    assert sorted((str(r["vec_id"]), r["component"], str(r["deviation"])) for r in got) == sorted((str(k), c + 1, str(w)) for (k, _), w in zip(kept, fits, strict=True) for c in range(min(16, d)))
    for r in got:
        e = values[r["component"] - 1]
        assert r["n"] == n
        if e > 1e-9 * values[0]:
            assert r["explained"] == pytest.approx(e / np.trace(v), rel=1e-4) and r["identity_error"] <= 1e-4
    return fit, v, n, s


def test_whitening_whole_table(spark, sf):
    rows = [tuple(r) for r in common.table(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = queries.op12_whitening(spark, sf).collect()
    fit, v, n, s = check_whitening(got, rows, 64)
    of = {k: x for k, x in x_vectors(rows, 64)}
    white = np.zeros((len(of), 16))
    for r in got:
        white[sorted(of).index(r["vec_id"]), r["component"] - 1] = r["whitened"]
    x = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(of[k], s, strict=True)] for k in sorted(of)])
    directions = np.linalg.lstsq(x, white, rcond=None)[0]  # whitened is a linear map of x - S/n
    assert np.abs(x @ directions - white).max() < 1e-8
    values, vectors = np.linalg.eigh(v)
    unit = directions / np.linalg.norm(directions, axis=0)
    assert np.abs(np.abs(np.einsum("dk,dk->k", unit, vectors[:, ::-1][:, :16])) - 1).max() < 1e-8


def test_whitening_awkward(spark):
    rows = [(k, [float(k % 7), float(k * k % 11), 5.0], 1) for k in range(40)] * 3 + [(None, [1.0], 1), (50, None, 1), (51, [1.0, None, 2.0], 1), (52, [float("nan")] * 3, 1), (53, [float("-inf"), 0.0, 0.0], None)]
    got = whitening.whiten(spark, vectors(spark, rows)).collect()
    check_whitening(got, rows, 3)
    constant = [r for r in got if r["component"] == 3 and r["vec_id"] is not None]
    assert {r["whitened"] is None for r in constant} == {False}  # the short vector makes the third dimension vary
    flat = whitening.whiten(spark, vectors(spark, [(1, [2.0, 3.0], 1), (2, [2.0, 3.0], 1)])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in flat] == [(1, 0, None, None, None)] * 4
    for none in ([], [(1, [], 1)], [(1, None, 1)]):
        assert whitening.whiten(spark, vectors(spark, none)).collect() == []
    line = whitening.whiten(spark, vectors(spark, [(k, [float(k), 2.0 * k], 1) for k in range(9)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}
    huge = [(1, [3e38, 1.0], 1), (2, [-3e38, 2.0], 1), (3, [0.0, 1.0], 1)]
    check_whitening(whitening.whiten(spark, vectors(spark, huge)).collect(), huge, 2)


def test_double_double():
    draw = np.random.default_rng(3)
    x = draw.normal(0, 1, (3000, 3)) + np.array([0, 1e6, -1e6])
    moments = whitening.Moments(3)
    moments.add(x, np.zeros_like(x))
    for i in range(3):
        for j in range(3):
            exact = sum(Fraction(a) * Fraction(b) for a, b in zip(x[:, i].tolist(), x[:, j].tolist(), strict=True))
            got = Fraction(moments.high[i, j]) + Fraction(moments.low[i, j])
            assert abs(got - exact) <= abs(exact) * Fraction(1, 2**70) + Fraction(1, 2**30)
    high, low = whitening.add(np.array([1e16]), np.array([0.0]), np.array([1.0]))
    assert Fraction(float(high[0])) + Fraction(float(low[0])) == 10**16 + 1
    num = whitening.numerators(np.array([[2**40, 5]]), 10**8, [7, 9])
    assert num.tolist() == [[2**40 * 10**8 - 7, 5 * 10**8 - 9]] and whitening.squares(num) == [None]


# ---- hard negatives

def mine_brute(rows):
    """Rows of the query, anchor by anchor."""
    kept = []
    for k, v, label in rows:
        if k is not None and label is not None and v is not None and all(c is not None and isfinite(c) for c in v):
            x = [floor(max(-(2.0**27), min(2.0**27, 256 * float(np.float32(c))))) for c in v]
            kept.append((k, (label + 1) % 10 if k % 7 == 0 else label, x))
    out = []
    for at, (a, label, x) in enumerate(kept):
        if a % 100 == 0:
            ranked = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), k, m) for b, (k, m, y) in enumerate(kept) if b != at)
            for s, p, _ in [r for r in ranked if r[2] == label][:5]:
                near = [r for r in ranked if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
                out += [(a, p, rank, k, -s, -t) for rank, (t, k, _) in enumerate(near, 1)]
    return sorted(out)


def mined_negatives(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = vectors(spark, rows).withColumn("label", label)
    return sorted(map(tuple, hard_negatives.mine(spark, df, F.col("vec_id") % 100 == 0).collect()))


def test_hard_negatives_awkward(spark):
    assert mined_negatives(spark, ODD_VECTORS) == mine_brute(ODD_VECTORS) != []
    assert mined_negatives(spark, []) == [] and mined_negatives(spark, [(1, [1.0], 1)]) == [] and mined_negatives(spark, [(100, [1.0], 1)]) == []


@pytest.mark.parametrize("group", [1 << 26, 100])
def test_hard_negatives_blocks(spark, monkeypatch, group):
    """Ties, few labels, short runs and groups of few anchors."""
    monkeypatch.setattr(hard_negatives, "GROUP_BYTES", group)
    draw = np.random.default_rng(4)
    rows = [(int(k), [float(x) for x in draw.integers(-3, 4, 4) / 8 + 0.5], int(draw.integers(0, 3))) for k in draw.permutation(np.arange(0, 1500, 5))]
    rows += [(200, [0.5] * 4, 1)] * 3
    assert mined_negatives(spark, rows) == mine_brute(rows) != []


def test_hard_negatives_runs():
    draw = np.random.default_rng(6)
    x, ids, labels = draw.integers(-9, 9, (300, 3)), np.arange(300), draw.integers(0, 3, 300)
    whole, anchors = hard_negatives.Block(ids, labels, x), hard_negatives.Block(ids[:7], labels[:7], x[:7])
    wide = hard_negatives.Block(ids, labels, x * 2**26)
    assert wide.scores(slice(0, 5), wide, slice(0, 9)).tolist() == (whole.scores(slice(0, 5), whole, slice(0, 9)).astype(object) * 2**52).astype(np.int64).tolist()
    wanted = [np.array([50, 7, -3])] * 7
    for at, number, score, i in hard_negatives.below_positives(anchors, whole, wanted, 5, 80, 100):
        p = wanted[0][number[0]]
        own = x[anchors.ids[at[0]]]
        brute = sorted((-int(own @ x[k]), k) for k in ids if labels[k] != anchors.labels[at[0]] and 80 * p <= 100 * int(own @ x[k]) <= 100 * p)[:5]
        assert list(zip((-score).tolist(), i.tolist(), strict=True)) == brute


def test_hard_negatives_sql(spark, sf, tmp_path):
    queries.op13_hard_negatives(spark, sf).write.parquet(str(tmp_path / "x"))
    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    mine, theirs = duckdb.sql(f"select * from '{tmp_path}/x/*.parquet' order by all"), duckdb.sql(f"select * from ({queries.ORACLE_SQL['op13_hard_negatives']}) order by all")
    assert mine.columns == theirs.columns and mine.types == theirs.types and mine.fetchall() == theirs.fetchall() != []


def test_nodes_of_two_classes_meet_about_once(spark):
    """Sixty lists hold forty near copies, each of them most: pairs are those of a common list, and not spelled out in each."""
    draw = random.Random(5)
    rows = [(v, node, 100, 60, 1) for node in range(40) for v in range(60) if draw.random() < 0.8] + [(v, 100 + v % 3, 100, 60, 1) for v in range(55, 58)]
    lists = spark.createDataFrame(rows, "v long, node long, n long, needed long, weight long")
    nodes = spark.createDataFrame([(k, *[0] * minhash_dedup.WORDS) for k in {r[1] for r in rows}], ["node", *minhash_dedup.PARITIES])
    roots = spark.createDataFrame([(k, 0) for k in range(1, 10)], "node long, root long")
    met = [tuple(r) for r in minhash_dedup.class_meetings(lists, nodes, roots, 85).collect()]
    of = {k: {r[0] for r in rows if r[1] == k} for k in {r[1] for r in rows}}
    root = {k: 0 if k < 10 else k for k in of}
    assert set(met) == {(a, b) for a in of for b in of if a < b and root[a] != root[b] and of[a] & of[b]}
    assert len(met) < 4 * len(set(met))
