"""Count windows over signals, their features, baselines, and a hybrid anomaly score; heat maps and fingerprints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import sdr

from .encoders.signal import ecg_stats
from .nearest import nearest

#: Weights of the feature distance (fixed values).
WEIGHTS = {"p2p": 2.0, "std": 3.0, "max_derivative": 4.0, "min_derivative": 4.0, "energy": 2.0, "zero_crossings": 0.5, "max": 1.5}
#: When a group stands out (fixed values): its share of high scores, mean and 99th percentile over normal ones, and its mean at all.
MORE_HIGH, MORE_MEAN, MORE_P99, MUCH = 2.0, 1.3, 1.2, 0.015
#: Ranges of keys whose counts the driver gathers to number rows.
RANGES = 4096
#: Rows of a range of values that a task sums at a time, as far as so many edges can cut them.
TOGETHER, MOST_EDGES = 1000, 256
#: Sums of a cell: rows, values of two features, products. The share of a mean square that its rounding may hide.
SUMS, LOST = ("m", "x", "y", "xy"), 1e-12


def count_windows(df: DataFrame, series: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """(series, window, samples): every n rows of a series make a window; an incomplete last one is dropped."""
    rn = F.row_number().over(Window.partitionBy(*series).orderBy(*order))
    rows = df.select(*series, F.floor((rn - 1) / n).alias("window"), ((rn - 1) % n).alias("at"), F.col(value).alias("v"))
    made = rows.groupBy(*series, "window").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("all"))
    return made.where(F.size("all") == n).select(*series, "window", F.transform("all", lambda x: x["v"]).alias("samples"))


def features(samples: Column) -> Column:
    """struct of max, min, p2p, mean, std, max_derivative, min_derivative, zero_crossings, energy."""
    s = ecg_stats(samples)
    n = F.size(samples)
    steps = F.zip_with(F.slice(samples, 2, F.greatest(n - 1, F.lit(0))), F.slice(samples, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    up, down = (F.coalesce(f(steps), F.lit(0.0)) for f in (F.array_max, F.array_min))
    energy = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / n
    return F.struct(
        s["max"].alias("max"), s["min"].alias("min"), (s["max"] - s["min"]).alias("p2p"), s["mean"].alias("mean"), s["std"].alias("std"),
        F.greatest(up, F.lit(0.0)).alias("max_derivative"), F.least(down, F.lit(0.0)).alias("min_derivative"), s["zero_crossings"].alias("zero_crossings"), energy.alias("energy"),
    )


def distance(a: Column, b: Column) -> Column:
    """The weighted sum of absolute differences of features."""
    return sum((F.abs(a[k] - b[k]) * F.lit(w) for k, w in WEIGHTS.items()), F.lit(0.0))


def baseline_statistics(base: DataFrame, stride_of: int = 50) -> DataFrame:
    """One row: mean and standard deviation of overlap and distance over pairs of a strided choice of baselines.

    base: (n, bits, f), n numbered from 0. The stride max(count / stride_of, 1) bounds the pairs by those of some 2 * stride_of rows.
    """
    total, top = base.agg(F.count("*"), F.max("n")).first()
    step = max(total // stride_of, 1)
    own = base.where(F.col("n") % step == 0)
    partner = F.sequence(F.col("n") + 1, F.lit(top or 0).cast("long"), F.lit(step).cast("long"))
    i = own.where(F.col("n") < (top or 0)).withColumn("n", F.col("n").cast("long")).withColumn("partner", F.explode(partner)).alias("i")
    j = base.alias("j")
    pairs = i.join(j, F.col("i.partner") == F.col("j.n"))
    rows = pairs.select(sdr.overlap(F.col("i.bits"), F.col("j.bits")).alias("o"), distance(F.col("i.f"), F.col("j.f")).alias("d"))
    return rows.agg(F.avg("o").alias("overlap_mean"), F.stddev_pop("o").alias("overlap_std"), F.avg("d").alias("distance_mean"), F.stddev_pop("d").alias("distance_std"))


def concordant(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """The sum of (x' - x)(y' - y) over pairs with a < a' and y < y'; a are whole numbers from 0.

    Pairs meet once, at the highest bit that tells their a apart: in a block of equal higher bits, the rows without that bit which
    come before by y are running sums.
    """
    order = np.argsort(y, kind="stable")
    a, x, y, total = a[order], x[order], y[order], 0.0
    for bit in range(int(a.max(initial=0)).bit_length()):
        order = np.argsort(a >> (bit + 1), kind="stable")
        own, u, v = a[order], x[order], y[order]
        block, high = own >> (bit + 1), (own >> bit & 1).astype(bool)
        first, low, sums = np.searchsorted(block, block[high]), ~high, []
        for w in (low.astype(float), u * low, v * low, u * v * low):
            up_to = np.r_[0.0, np.cumsum(w)]
            sums.append(up_to[:-1][high] - up_to[first])
        n, su, sv, suv = sums
        u, v = u[high], v[high]
        total += float((n * u * v - u * sv - v * su + suv).sum())
    return total


def distance_statistics(base: DataFrame) -> tuple[float | None, float | None]:
    """Mean and standard deviation of distance() over all pairs of rows of base (f), up to rounding; None without a pair.

    No pair is spelled out. With x, y, .. the features times their weights, the mean takes the sums of |x' - x| over pairs, and the mean
    square those of |x' - x||y' - y|: twice the products of the pairs in which x and y rise together, less those of all pairs, which are
    n sum(xy) - sum(x) sum(y). Edges cut each feature into ranges, and equal values that are an edge are a range of their own.
    Pairs that lie in different ranges of both features follow from sums of cells (range of x, range of y), the others are summed in
    the task that has the rows of a range. A deviation that the rounding of the sums hides is 0.
    """
    names = [f"x{j}" for j in range(len(WEIGHTS))]
    rows = base.select(*[(F.col(f"f.{f}").cast("double") * w).alias(c) for (f, w), c in zip(WEIGHTS.items(), names, strict=True)])
    for c in names:
        rows = rows.where(F.col(c).isNotNull())
    n, odd = rows.agg(F.count("*"), F.max(F.greatest(*[F.isnan(c) | (F.abs(c) == float("inf")) for c in names]))).first()
    if n < 2 or odd:
        return (None, None) if n < 2 else (float("nan"), float("nan"))
    cuts = min(max(n // TOGETHER, 1), MOST_EDGES)
    edges = [np.unique(e) for e in rows.approxQuantile(names, [(j + 0.5) / cuts for j in range(cuts)], 0.25 / cuts)]
    middle = [float(e[len(e) // 2]) for e in edges]
    places = 2 * max(map(len, edges)) + 1  # odd ones are edges

    def ranged(batch) -> tuple[np.ndarray, np.ndarray]:
        """(feature, row) values from the middle, and their ranges."""
        x = np.stack([c.to_numpy() for c in batch.columns])
        at = np.stack([np.searchsorted(e, v) + np.searchsorted(e, v, side="right") for e, v in zip(edges, x, strict=True)])
        return x - np.array(middle)[:, None], at

    def cells(batches):
        import pyarrow as pa

        for batch in batches:
            x, at = ranged(batch)
            for i, j in zip(*np.triu_indices(len(x), 1), strict=True):
                code, own = np.unique(at[i] * places + at[j], return_inverse=True)
                sums = [np.bincount(own, w, minlength=len(code)).astype(float) for w in (None, x[i], x[j], x[i] * x[j])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), c, np.int32)) for c in (i, j)] + [pa.array(c) for c in (code, *sums)], ["i", "j", "cell", *SUMS])

    def of_cells(table):
        import pyarrow as pa

        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        code, grid = table.column("cell").to_numpy(), np.zeros((4, places * places))
        grid[:, code] = [table.column(c).to_numpy() for c in SUMS]
        grid = grid.reshape(4, places, places)
        before = np.zeros_like(grid)
        before[:, 1:, 1:] = grid.cumsum(axis=1).cumsum(axis=2)[:, :-1, :-1]
        (m, x, y, xy), (m_, x_, y_, xy_) = grid, before
        rising = (xy * m_ - x * y_ - y * x_ + m * xy_).sum()
        square = 2 * (2 * rising - (m.sum() * xy.sum() - x.sum() * y.sum()))
        mean = 0.0
        for v, axis, once in ((x, 1, j == i + 1), (y, 0, j == i + 1 == len(names) - 1)):  # each feature's ranges, by one of its pairs
            count, v = m.sum(axis=axis), v.sum(axis=axis)
            mean += float((v[1:] * count.cumsum()[:-1] - count[1:] * v.cumsum()[:-1]).sum()) if once else 0.0
        return pa.table({"mean": [mean], "square": [float(square)]})

    def parts(batches):
        import pyarrow as pa

        for batch in batches:
            x, at = ranged(batch)
            for i in range(len(x)):
                some = np.flatnonzero(at[i] % 2 == 0)
                made = [pa.array(np.full(len(some), i, np.int32)), pa.array(at[i, some]), *[pa.array(c[some]) for c in x], *[pa.array(c[some]) for c in at]]
                yield pa.RecordBatch.from_arrays(made, ["i", "at", *names, *[f"{c}_at" for c in names]])

    def of_part(table):
        import pyarrow as pa

        i, m = table.column("i")[0].as_py(), len(table)
        x, at = ([table.column(c + end).to_numpy() for c in names] for end in ("", "_at"))
        order = np.argsort(x[i], kind="stable")
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        mean = float(((2 * np.arange(m) - m + 1) * x[i][order]).sum())
        # With the features behind, pairs of this range; with those before, only pairs that aren't in one range of theirs.
        rising = sum(concordant(place, x[i], x[j]) if j > i else concordant(at[j], x[j], x[i]) for j in range(len(x)) if j != i)
        return pa.table({"mean": [mean], "square": [4.0 * rising]})

    sums, out = ", ".join(f"{c} double" for c in SUMS), "mean double, square double"
    met = rows.mapInArrow(cells, f"i int, j int, cell long, {sums}").groupBy("i", "j", "cell").agg(*[F.sum(c).alias(c) for c in SUMS])
    near = rows.mapInArrow(parts, ", ".join(["i int, at long", *[f"{c} double" for c in names], *[f"{c}_at long" for c in names]]))
    found = met.groupBy("i", "j").applyInArrow(of_cells, out).unionByName(near.groupBy("i", "at").applyInArrow(of_part, out))
    off = [F.col(c) - v for c, v in zip(names, middle, strict=True)]
    alone = rows.agg(*[F.sum(c) for c in off], *[F.sum(c * c) for c in off]).first()
    mean, square = found.agg(F.sum("mean"), F.sum("square")).first()
    pairs = n * (n - 1) / 2
    square = (square + sum(n * q - v * v for v, q in zip(alone[: len(names)], alone[len(names) :], strict=True))) / pairs
    mean /= pairs
    variance = square - mean * mean
    return mean, float(np.sqrt(variance)) if n > 2 and variance > LOST * square else 0.0


def numbered(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """df with the place of each row by a numeric key, from 0, nulls first: places within ranges of keys, plus the counts of the ranges before."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = max(((high or 0) - (low or 0) + 1) / RANGES, 1)
    ranged = df.withColumn("__range", F.coalesce(F.floor((F.col(key) - F.lit(low)) / F.lit(float(width))), F.lit(-1)).cast("long"))
    before, at = [], 0
    for r in sorted(ranged.groupBy("__range").count().collect(), key=lambda r: r["__range"]):  # RANGES + 1 rows at most
        before.append((r["__range"], at))
        at += r["count"]
    starts = df.sparkSession.createDataFrame(before, "__range long, __before long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1 + F.col("__before")
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, place.cast("long")).drop("__range", "__before")


def hybrid_score(df: DataFrame, base: DataFrame, keys: list[str], mean: float | None, sd: float | None, expected: float) -> DataFrame:
    """(keys, overlap, distance, score): df and base have bits and f; each row of df finds its best overlap and its least distance in base.

    Both searches are exact; see nearest.nearest(). keys tell rows apart and aren't null. A null or unusable side gives a null.
    """
    near = {}
    for name, column in (("overlap", F.col("bits")), ("distance", F.array(*[F.col(f"f.{k}").cast("double") * w for k, w in WEIGHTS.items()]))):
        near[name] = nearest(df.select(*keys, column.alias("value")), base.select(column.alias("value")), keys, "value", name).select(*keys, F.col("best").alias(name))
    best = df.select(*keys).join(near["overlap"], keys, "left").join(near["distance"], keys, "left")
    z = (F.col("distance") - mean) / sd if sd and sd > 0 else F.lit(0.0)
    odd = F.greatest(F.lit(0.0), 1 - F.col("overlap") / expected)
    return best.withColumn("score", 0.3 * odd + 0.7 * F.greatest(F.lit(0.0), z / (1 + F.abs(z))))


def percentile(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row: the value at place floor(n * share) of the sorted finite values, found by counts in ever finer bins; null if there are none.

    The driver sees RANGES counts at a time, and no task more than its rows.
    """
    c = F.col(value)
    known = df.where(c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")))
    n, low, high = known.agg(F.count("*"), F.min(value), F.max(value)).first()
    left = min(int(n * share), max(0, n - 1))
    while n and low < high:
        width = F.lit(float(high - low) / RANGES)
        bins = known.where(c.between(low, high)).groupBy(F.least(F.floor((c - F.lit(low)) / width), F.lit(RANGES - 1)).alias("bin"))
        before = (low, high)
        for r in sorted(bins.agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).collect(), key=lambda r: r["bin"]):
            if left < r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
        if (low, high) == before:  # neighbouring numbers, which no bin tells apart
            low = high = low if left < known.where(c == F.lit(low)).count() else high
    return df.sparkSession.createDataFrame([(float(low) if n else None,)], "value double")


def detected(high: Column, mean: Column, p99: Column, normal_high: float, normal_mean: float, normal_p99: float) -> Column:
    """Whether a group of windows stands out from normal ones."""
    return (high > normal_high + MORE_HIGH) | (mean > normal_mean * MORE_MEAN) | (p99 > normal_p99 * MORE_P99) | (mean > MUCH)


def scatter_columns(bits: Column, columns: int = 1024) -> Column:
    """Bits to columns by a multiplicative hash of 32 bits."""
    def of(b: Column) -> Column:
        wide = b.cast("long")
        low = (wide * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        return (low.bitwiseXOR(F.shiftright(wide, 16)) % F.lit(columns)).cast("int")

    return F.array_sort(F.array_distinct(F.transform(bits, of)))


def cell_statistics(ticks: DataFrame) -> DataFrame:
    """(cell, active, correct, anomalous, rate, accuracy) of ticks with active_cells, predicted_cells and anomaly.

    Ticks are read once, as they may be the work of a learner: each gives one row at least, and is counted with its first.
    """
    rows = ticks.select("predicted_cells", "anomaly", F.posexplode_outer("active_cells").alias("at", "cell"))
    hit = F.coalesce(F.array_contains("predicted_cells", F.col("cell")), F.lit(False)).cast("int")
    rows = rows.select("cell", hit.alias("hit"), F.coalesce(F.col("anomaly") > 0.5, F.lit(False)).cast("int").alias("odd"), (F.coalesce("at", F.lit(0)) == 0).cast("int").alias("first"))
    per = rows.groupBy("cell").agg(F.count("*").alias("active"), F.sum("hit").alias("correct"), F.sum("odd").alias("anomalous"), F.sum("first").alias("ticks"))
    per = per.withColumn("ticks", F.sum("ticks").over(Window.partitionBy(F.lit(0)))).where("cell is not null")  # as many rows as cells
    return per.select("cell", "active", "correct", "anomalous", (F.col("active") / F.col("ticks")).alias("rate"), (F.col("correct") / F.col("active")).alias("accuracy"))


def heat_map(df: DataFrame, time: str, bits: str, size: int, bands: int = 256) -> DataFrame:
    """(time, band, n): active bits by band of columns."""
    rows = df.select(time, F.explode(bits).alias("b"))
    return rows.groupBy(time, F.floor(F.col("b") * bands / size).cast("int").alias("band")).agg(F.count("*").alias("n"))


def activation(samples: np.ndarray, side: int = 256) -> np.ndarray:
    """(windows, y, x) activation of windows (one per row): the maximum of five layers.

    The layers are the amplitude's trace, the slope's trace, the band of local energy (windowed RMS), dots of high curvature and
    DFT magnitudes of four periods. Brushes have fixed sizes for a side of 256, and scale with the side.
    """
    m, n = samples.shape
    k = side / 256
    act, w, at = np.zeros((m, side, side)), np.arange(m)[:, None], np.arange(n)
    x = np.minimum((at / n * side).astype(int), side - 1)

    def put(rows, y, x, v):
        rows, y, x, v = np.broadcast_arrays(rows, y, x, v)
        ok = (y >= 0) & (y < side) & (x >= 0) & (x < side) & (v > 0)
        np.maximum.at(act, (rows[ok], y[ok], x[ok]), v[ok])

    def scaled(v):
        top = np.maximum(np.abs(v).max(axis=1, keepdims=True), 0.001)
        return v / top

    low, span = samples.min(axis=1, keepdims=True), np.maximum(np.ptp(samples, axis=1, keepdims=True), 0.001)
    centre = ((1 - np.clip((samples - low) / span, 0, 1)) * 0.4 + 0.55) * side
    reach = round(15 * k)
    for dy in range(-reach, reach + 1):
        put(w, centre.astype(int) + dy, x, np.exp(-2 * (dy / (20 * k)) ** 2) * 0.8)

    slope = np.diff(samples, axis=1, prepend=samples[:, :1])
    steep = scaled(slope)
    y, reach = ((1 - (steep + 1) / 2) * 0.35 * side).astype(int), round(8 * k)
    for dy in range(-reach, reach + 1):
        put(w, y + dy, x, np.exp(-2 * (dy / (10 * k)) ** 2) * np.abs(steep) * 0.7)

    squares = np.concatenate([np.zeros((m, 1)), np.cumsum(samples * samples, axis=1)], axis=1)
    start, end = np.maximum(at - 5, 0), np.minimum(at + 5, n)
    energy = scaled(np.sqrt((squares[:, end] - squares[:, start]) / (end - start)))
    spread, band = (energy * 15 * k).astype(int), int(0.45 * side)
    for dy in range(-int(15 * k), int(15 * k) + 1):
        put(w, band + dy, x, np.where((energy > 0.3) & (abs(dy) <= spread), energy * (1 - abs(dy) / (spread + 1)) * 0.5, 0))

    bend = np.diff(slope, axis=1, prepend=slope[:, :1])
    sharp = np.abs(scaled(bend))
    radius, largest = np.maximum((sharp * 8 * k).astype(int), 1), max(int(8 * k), 1)
    for dy in range(-largest, largest + 1):
        for dx in range(-largest, largest + 1):
            far = np.hypot(dx, dy)
            put(w, centre.astype(int) + dy, x + dx, np.where((sharp > 0.4) & (far <= radius), sharp * (1 - far / radius) * 0.6, 0))

    for nth, period in enumerate((4, 8, 16, 32)):
        for begin in range(0, n, period // 2):
            chunk = samples[:, begin : begin + period]
            c = chunk.shape[1]
            if c < period // 2:
                continue
            strength = np.minimum(np.abs(np.fft.fft(chunk, axis=1))[:, : c // 2].sum(axis=1, keepdims=True) / c / span, 1)
            at_x = min(int((2 * begin + c) // 2 / n * side), side - 1)
            for dy in range(max(round(8 * k), 1)):
                y = min(int((nth * 0.08 + 0.02) * side) + dy, side - 1)
                put(w, y, at_x, strength * 0.4)
                put(w, y, at_x - 1, strength * 0.3)
                put(w, y, at_x + 1, strength * 0.3)
    return act


def fingerprint_points(df: DataFrame, keys: list[str], samples: str, side: int = 256) -> DataFrame:
    """(keys, points) of each window, points an array<struct<x, y, v>> of the places with activation; see activation(). Windows that are null or empty, or have a null, give nothing."""
    chunk = max((1 << 22) // (side * side), 1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = batch.column(len(keys)).to_pylist()
            by_length: dict[int, list[int]] = {}
            for r, v in enumerate(values):
                if v and None not in v:
                    by_length.setdefault(len(v), []).append(r)
            for rows in by_length.values():
                for k in range(0, len(rows), chunk):
                    some = rows[k : k + chunk]
                    act = activation(np.array([values[r] for r in some], float), side)
                    w, y, x = np.nonzero(act)
                    begin = np.searchsorted(w, np.arange(len(some) + 1)).astype(np.int32)
                    points = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(act[w, y, x])], ["x", "y", "v"])
                    own = [batch.column(c).take(pa.array(some)) for c in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(begin), points)], [*keys, "points"])

    point = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("v", T.DoubleType())])
    rows = df.select(*keys, F.transform(samples, lambda v: v.cast("double")).alias("samples"))
    return rows.mapInArrow(run, T.StructType([*[rows.schema[k] for k in keys], T.StructField("points", T.ArrayType(point))]))


def sparse_bits(points: Column, side: int, threshold: float) -> Column:
    """The places y * side + x of a window's points above the threshold, sorted."""
    return F.array_sort(F.transform(F.filter(points, lambda p: p["v"] > threshold), lambda p: p["y"] * side + p["x"]))


def fingerprint(df: DataFrame, keys: list[str], points: str) -> DataFrame:
    """(keys, x, y, v): mean activation of each place over all windows, with the peak at 1.

    All places of a key share its number of windows, so that the sums have the same ratios as the means.
    """
    rows = df.select(*keys, F.explode(points).alias("p")).groupBy(*keys, "p.x", "p.y").agg(F.sum("p.v").alias("m"))
    return rows.select(*keys, "x", "y", (F.col("m") / F.greatest(F.max("m").over(Window.partitionBy(*keys)), F.lit(1e-12))).alias("v"))


def fingerprint_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, d): a's map less b's."""
    both = a.select("x", "y", F.col("v").alias("p")).join(b.select("x", "y", F.col("v").alias("q")), ["x", "y"], "full_outer")
    return both.select("x", "y", (F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))).alias("d"))
