"""Joins by ranges without nested loops: overlapping intervals by searches in a group or dyadic buckets, points within a radius by strips of the plane."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Points of a strip, or so; strips at most; points of a tile that one task counts.
STRIP_ROWS, MAX_STRIPS, CELL_ROWS = 200_000, 1024, 1_000_000
#: Rows of a group of intervals that one task sorts.
GROUP_ROWS = 500_000
#: Searching a row costs a point as much as so many comparisons; points that search at a time; pairs compared at a time.
SEARCH_COST, QUERY_ROWS, PAIRS = 40.0, 1 << 14, 1 << 16


def dyadic_nodes(low: Column, high: Column, levels: int) -> Column:
    """array<struct<level, node>>: the fewest ranges [node * 2^level, (node + 1) * 2^level) that make up the longs low to high, both included.

    A level's whole ranges are first to last; taken are those that are in no whole range of the next level, which are
    at most an odd first and an even last one. Empty for high < low. Levels up to ``levels`` must be enough for the length.
    """
    spans = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(low + F.lit((1 << k) - 1), k).alias("first"), (F.shiftright(high + 1, k) - 1).alias("last")) for k in range(levels + 1)])

    def ends(s: Column) -> Column:
        whole = s["first"] <= s["last"]
        odd, even = whole & (s["first"] % 2 != 0), whole & (s["last"] % 2 == 0)
        return F.filter(F.array(F.when(odd, F.struct(s["level"], s["first"].alias("node"))), F.when(even, F.struct(s["level"], s["last"].alias("node")))), lambda n: n.isNotNull())

    return F.flatten(F.transform(spans, ends))


def _stabbed(intervals: DataFrame, points: DataFrame, group: list[str], levels: int) -> DataFrame:
    """intervals (group, low, high, x) and points (group, at, y): (x, y) for each point in an interval of its group, once."""
    own = intervals.select(*group, "x", F.explode(dyadic_nodes(F.col("low"), F.col("high"), levels)).alias("n")).select(*group, "x", "n.level", "n.node")
    around = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col("at"), k).alias("node")) for k in range(levels + 1)])
    theirs = points.select(*group, "y", F.explode(around).alias("n")).select(*group, "y", "n.level", "n.node")
    return own.join(theirs, [*group, "level", "node"]).select("x", "y")


def interval_pairs(df: DataFrame, group: list[str], low: str, high: str, columns: list[str]) -> DataFrame:
    """(a, b): structs of ``columns`` for each unordered pair of rows of a group whose intervals overlap, once, without a nested loop.

    low and high are longs, both included. Two intervals overlap if one holds the other's beginning: pairs with the same
    beginning are ordered by ``columns``, which must tell rows apart. Rows with a null or with high < low overlap nothing.
    """
    known = df.where(F.col(low) <= F.col(high)).select(*group, F.col(low).cast("long").alias("low"), F.col(high).cast("long").alias("high"), F.struct(*columns).alias("row"))
    longest = known.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    levels = int((longest or 0) + 1).bit_length()
    intervals = known.withColumn("x", F.struct("row", "low"))
    points = known.select(*group, F.col("low").alias("at"), F.struct("row", "low").alias("y"))
    met = _stabbed(intervals, points, group, levels)
    first = (F.col("x.low") < F.col("y.low")) | ((F.col("x.low") == F.col("y.low")) & (F.col("x.row") < F.col("y.row")))
    return met.where(first).select(F.col("x.row").alias("a"), F.col("y.row").alias("b"))


def sweep(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(overlapping, greatest) of intervals with low <= high, sorted by (group, low): the others of its group that overlap each, and the length of the greatest overlap, 0 without one."""
    n = len(group)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.searchsorted(group, group, "left")
    end = np.searchsorted(group, group, "right")
    # Others begin no later than this one ends, but for those that have ended before. Values become ranks, so that a group and a value are one number.
    values = np.unique(np.concatenate([low, high]))
    span, lows, highs = len(values), np.searchsorted(values, low), np.searchsorted(values, high)
    begun = np.searchsorted(group * span + lows, group * span + highs, "right") - first
    ended = np.searchsorted(np.sort(group * span + highs), group * span + lows, "left") - first
    # Of those before a row, the one that ends last overlaps most.
    reach = np.maximum.accumulate(group * span + highs)
    before = np.r_[0, reach[:-1]] - group * span
    met = (np.arange(n) > first) & (before >= lows)
    most = np.where(met, np.minimum(high, values[np.clip(before, 0, span - 1)]) - low + 1, 0)
    # It looks at those that begin after it while one of them can overlap more.
    ahead, k = np.arange(n), 1
    while len(ahead):
        ahead = ahead[ahead + k < end[ahead]]
        ahead = ahead[high[ahead] - low[ahead + k] + 1 > most[ahead]]
        most[ahead] = np.maximum(most[ahead], np.minimum(high[ahead], high[ahead + k]) - low[ahead + k] + 1)
        k += 1
    return begun - ended - 1, most


def _swept(rows: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """(keys, overlapping, greatest_) of rows (group as g0, g1, ..., low_, high_, keys), whose groups fit into a task."""
    own = [f"g{k}_" for k in range(len(group))]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held: list = []

        def made(table):
            new = fresh(table)
            overlapping, greatest = sweep(np.cumsum(new) - 1, table.column("low_").to_numpy(), table.column("high_").to_numpy())
            columns = [table.column(f"k{k}_") for k in range(len(keys))]
            out = pa.table([*columns, pa.array(overlapping), pa.array(greatest, mask=greatest == 0)], names=[*(f"k{k}_" for k in range(len(keys))), "overlapping", "greatest_"])
            return out.combine_chunks().to_batches()

        def fresh(table):
            """Where a group begins."""
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for c in own:
                column = table.column(c).combine_chunks()
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            return new

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if len(held) > 1 and all(batch.column(c)[-1] == held[0].column(c)[0] for c in own):
                continue  # a long group goes on
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(fresh(table))[-1]) if table.num_rows else 0
            if last:
                yield from made(table.slice(0, last).combine_chunks())
            held = table.slice(last).combine_chunks().to_batches()
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            yield from made(table)

    fields = [T.StructField(f"k{k}_", rows.schema[f"k{k}_"].dataType) for k in range(len(keys))]
    dealt = rows.repartition(*own).sortWithinPartitions(*own, "low_")
    return dealt.mapInArrow(run, T.StructType([*fields, T.StructField("overlapping", T.LongType()), T.StructField("greatest_", T.LongType())]))


def overlaps(df: DataFrame, group: list[str], low: str, high: str, keys: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """(keys, overlapping, greatest): for each row the number of other intervals of its group that overlap its own, and the length of the greatest overlap, null without one. keys tell rows apart and aren't null.

    A row is sent once to the task of its group, which sorts its intervals and counts by searches. Groups of more than
    ``group_rows`` rows are dealt by dyadic buckets and spell out their pairs.
    """
    usable = F.coalesce(F.col(low) <= F.col(high), F.lit(False))
    for c in group:
        usable = usable & F.col(c).isNotNull()
    sizes = df.where(usable).groupBy(*group).agg(F.count("*").alias("n_")).where(F.col("n_") > group_rows)
    large = [tuple(r)[:-1] for r in sizes.collect()]  # one for group_rows rows at most
    kind = df.select((F.col(high) - F.col(low) + 1).alias("x")).schema["x"].dataType
    few = df
    if large:
        marks = df.sparkSession.createDataFrame(large, T.StructType([df.schema[c] for c in group]))
        few = df.join(F.broadcast(marks), group, "left_anti")
    columns = [*[F.col(c).alias(f"g{k}_") for k, c in enumerate(group)], F.col(low).cast("long").alias("low_"), F.col(high).cast("long").alias("high_"), *[F.col(c).alias(f"k{k}_") for k, c in enumerate(keys)]]
    swept = _swept(few.where(usable).select(*columns), group, keys)
    out = swept.select(*[F.col(f"k{k}_").alias(c) for k, c in enumerate(keys)], "overlapping", F.col("greatest_").cast(kind).alias("greatest"))
    out = out.unionByName(few.where(~usable).select(*keys, F.lit(0).cast("long").alias("overlapping"), F.lit(None).cast(kind).alias("greatest")))
    return out.unionByName(_spelled(df.join(F.broadcast(marks), group, "left_semi"), group, low, high, keys)) if large else out


def _spelled(df: DataFrame, group: list[str], low: str, high: str, keys: list[str]) -> DataFrame:
    """overlaps() by pairs."""
    pairs = interval_pairs(df, group, low, high, [*keys, low, high])
    shared = F.least(f"a.{high}", f"b.{high}") - F.greatest(f"a.{low}", f"b.{low}") + 1
    both = pairs.select(F.explode(F.array("a", "b")).alias("row"), shared.alias("shared"))
    found = both.groupBy(*[F.col(f"row.{k}").alias(k) for k in keys]).agg(F.count("*").alias("overlapping"), F.max("shared").alias("greatest"))
    return df.select(*keys).join(found, keys, "left").withColumn("overlapping", F.coalesce("overlapping", F.lit(0)))


def strip_counts(x: np.ndarray, y: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
    """For each point of ``own`` (places) the points within the radius, itself included.

    Points lie in rows of y, sorted by x. In each row those that are near enough at any y of the row are counted by two
    binary searches; only those between the row's least and greatest reach are compared one by one.
    """
    if not len(own) or not len(x):
        return np.zeros(len(own), np.int64)
    # Rows so high that searching them costs about as much as comparing what is left between their reaches.
    low, wide = y.min(), int(np.ptp(x) / radius) + 1
    _, crowd = np.unique(np.floor((y - low) / radius).astype(np.int64) * wide + np.floor((x - x.min()) / radius).astype(np.int64), return_counts=True)
    density = float((crowd.astype(float) ** 2).sum()) / len(x) / (radius * radius)  # as a point sees it on average
    height = min(radius, max(math.sqrt(SEARCH_COST / density), radius / 256))
    row = np.floor((y - low) / height).astype(np.int64)
    order = np.lexsort((x, row))
    sx, sy, begin = x[order], y[order], np.searchsorted(row[order], np.arange(int(row.max()) + 2))
    out = np.zeros(len(own), np.int64)
    own_row, square, slack = row[own], radius * radius, 1e-9
    by_row = np.lexsort((x[own], own_row))
    reach = int(math.ceil(radius / height)) + 1
    starts = np.flatnonzero(np.r_[True, np.diff(own_row[by_row]) != 0])
    for a, b in zip(starts, np.r_[starts[1:], len(by_row)], strict=True):
        r = int(own_row[by_row[a]])
        for k in range(a, b, QUERY_ROWS):
            mine = by_row[k : min(k + QUERY_ROWS, b)]
            qx, qy = x[own[mine]], y[own[mine]]
            for other in range(max(0, r - reach), min(len(begin) - 2, r + reach) + 1):
                first, last = begin[other], begin[other + 1]
                if first == last:
                    continue
                bottom, top = low + other * height, low + (other + 1) * height
                near = np.maximum(0.0, np.maximum(bottom - qy, qy - top)) * (1 - slack)
                far = np.maximum(np.abs(bottom - qy), np.abs(top - qy)) * (1 + slack) + slack * height
                outer = np.sqrt(np.maximum(square - near * near, 0.0)) * (1 + slack) + slack * radius
                inner = np.sqrt(np.maximum(square - far * far, 0.0)) * (1 - slack) - slack * radius
                inner = np.where(far < radius, inner, -1.0)
                line = sx[first:last]
                left, right = np.searchsorted(line, qx - outer, "left"), np.searchsorted(line, qx + outer, "right")
                sure_left, sure_right = np.searchsorted(line, qx - inner, "left"), np.searchsorted(line, qx + inner, "right")
                sure = (inner > 0) & (sure_right > sure_left)
                sure_left, sure_right = np.where(sure, sure_left, right), np.where(sure, sure_right, right)
                out[mine] += sure_right - sure_left
                for p, q in ((left, sure_left), (sure_right, right)):
                    n = np.maximum(q - p, 0)
                    for i, j in pieces(n, PAIRS):
                        m = n[i:j]
                        at = np.arange(m.sum()) + np.repeat(p[i:j] - (np.cumsum(m) - m), m) + first
                        of = np.repeat(np.arange(i, j), m)
                        dx, dy = qx[of] - sx[at], qy[of] - sy[at]
                        out[mine[i:j]] += np.bincount(of[dx * dx + dy * dy <= square] - i, minlength=j - i)
    return out


def pieces(n: np.ndarray, most: int):
    """Runs (i, j) of n whose sums are at most ``most``, or single entries."""
    total, i = np.r_[0, np.cumsum(n)], 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        if total[j] > total[i]:
            yield i, j
        i = j


def cut_between(found: list[float], least: float) -> np.ndarray:
    """Ascending cuts with at least ``least`` between neighbours."""
    out: list[float] = []
    for c in found:
        if not out or c - out[-1] >= least:
            out.append(c)
    return np.array(out)


def neighbours(df: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """(key, neighbours): for each row the number of other rows whose point is within the radius, its edge included.

    The plane is cut into strips of x, none narrower than 2 radii, of about STRIP_ROWS points where the points allow it. A
    strip's task gets its own points and those within the radius around, so that a point is sent to two strips at most;
    it counts without spelling pairs out, see strip_counts(). A strip that holds more, as when very many points share an x, is cut
    by y in the same way, and what is left over CELL_ROWS is dealt over parts, each of which gets all points of the tile. Rows with
    a null or non-finite coordinate have no neighbours. key tells rows apart and isn't null.
    """
    usable = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    points = df.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(usable)
    reach, least = radius * (1 + 1e-9), 2.001 * radius  # a pair at the radius meets in spite of rounding
    total = points.count()

    def cuts(column: str) -> np.ndarray:
        n = min(MAX_STRIPS, -(-total // STRIP_ROWS))
        if n < 2:
            return np.zeros(0)
        return cut_between(points.agg(F.percentile_approx(column, [k / n for k in range(1, n)], 20 * n)).first()[0], least)

    x_cuts = cuts("x")

    def place(c: Column, of: np.ndarray) -> Column:
        if not len(of):
            return F.lit(0)
        step = math.isqrt(len(of) - 1) + 1
        groups = [of[k : k + step].tolist() for k in range(0, len(of), step)]
        group = F.size(F.filter(F.lit([g[-1] for g in groups]), lambda v: v <= c))
        inner = F.array(*[F.lit(g) for g in groups])
        rest = F.when(group < len(groups), F.size(F.filter(F.element_at(inner, F.least(group + 1, F.lit(len(groups)))), lambda v: v <= c))).otherwise(0)
        return F.least(group * step, F.lit(len(of))) + rest

    def spread(rows: DataFrame, column: str, of: np.ndarray, name: str) -> DataFrame:
        """rows once for each strip that they reach into."""
        c = F.col(column)
        return rows.withColumn(name, F.explode(F.sequence(place(c - reach, of), place(c + reach, of))))

    tiles = points.withColumn("tx", place(F.col("x"), x_cuts))
    crowded = [r["tx"] for r in tiles.groupBy("tx").agg(F.count("*").alias("n")).where(F.col("n") > 2 * STRIP_ROWS).collect()]  # MAX_STRIPS at most
    y_cuts = cuts("y") if crowded else np.zeros(0)
    in_crowd = F.col("tx").isin(crowded) if crowded else F.lit(False)

    def tiled(rows: DataFrame, halo: bool) -> DataFrame:
        rows = spread(rows, "x", x_cuts, "tx") if halo else rows.withColumn("tx", place(F.col("x"), x_cuts))
        if not len(y_cuts):
            return rows.withColumn("ty", F.lit(0))
        ends = (place(F.col("y") - reach, y_cuts), place(F.col("y") + reach, y_cuts)) if halo else (place(F.col("y"), y_cuts),) * 2
        return rows.withColumn("ty", F.explode(F.when(in_crowd, F.sequence(*ends)).otherwise(F.array(F.lit(0)))))

    # own: the tile in which a point is counted; all its other tiles only see it.
    seen = tiled(points, True).withColumn("own", (F.col("tx") == place(F.col("x"), x_cuts)) & (F.lit(not len(y_cuts)) | ~in_crowd | (F.col("ty") == place(F.col("y"), y_cuts))))
    sizes = tiled(points, False).groupBy("tx", "ty").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")).where("parts > 1")
    seen = seen.join(F.broadcast(sizes), ["tx", "ty"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # MAX_STRIPS ** 2 rows at most, in fact few
    seen = seen.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    seen = seen.withColumn("own", F.col("own") & (F.pmod(F.xxhash64("key"), F.col("parts")) == F.col("part")))

    def count(table):
        import pyarrow as pa

        mine = table.column("own").to_numpy()
        place_ = np.flatnonzero(mine)
        found = strip_counts(table.column("x").to_numpy(), table.column("y").to_numpy(), place_, radius) - 1
        return pa.table([table.column("key").take(pa.array(place_)).cast(kind), pa.array(found)], ["key", "neighbours"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(points.schema["key"].dataType)
    schema = T.StructType([points.schema["key"], T.StructField("neighbours", T.LongType())])
    found = seen.select("key", "x", "y", "own", "tx", "ty", "part").groupBy("tx", "ty", "part").applyInArrow(count, schema)
    unusable = df.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(~F.coalesce(usable, F.lit(False)))
    return found.unionByName(unusable.select("key", F.lit(0).cast("long").alias("neighbours"))).withColumnRenamed("key", key)
