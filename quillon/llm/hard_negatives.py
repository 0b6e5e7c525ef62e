"""Hard-negative mining: for anchors and their best rows of the same label, rows of other labels that score nearly as high.

A component x of a vector becomes floor(SCALE * x); a row's score for an anchor is their integer inner product. Higher
scores come first, ties by smaller id. An anchor's positives are its first rows of its own label; the negatives of a
positive are the first rows of other labels that don't score above it and reach LOWER / UPPER of its score.

Anchors are cut into groups of a bounded size, which are broadcast; rows stay where they are. For each group there are
two passes over all rows. In the first, a task scores and sorts its rows of each anchor's label, and sends the best ones;
a window over an anchor keeps the first of all. In the second, a task sorts the scores of its rows of other labels in
full, finds each positive's upper limit by binary search and reads on from there while the lower limit holds. A task
takes RUN rows at a time and PART anchors of them, so its memory is bounded; what it sends is at most POSITIVES + 1, or
POSITIVES x NEGATIVES rows a run and anchor.

Rows with a null id, a null label, a null vector or any null or non-finite component take no part. Rows that repeat an
id are rows of their own: only the anchor itself is no positive of its own. Repeated anchors give repeated rows. Vectors
of different lengths are multiplied over the shorter one. Scaled components count as at most +-2^27, so that scores of up
to 256 dimensions fit in a long. Other columns take no part, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage_table

SCALE, POSITIVES, NEGATIVES, LOWER, UPPER = 256, 5, 5, 80, 100
LIMIT = float(1 << 27)
#: Bytes of a group of anchors, as it is broadcast.
GROUP_BYTES = 1 << 26
#: Rows that a task sorts at a time, and scores in one matrix.
RUN, PART = 1 << 17, 1 << 22


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def as_integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c.cast("double") * scale))).cast("long"))


def matrix(column) -> np.ndarray:
    """The lists of an Arrow column as rows, padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), size.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Block:
    """Rows by label, then id: integer vectors, and doubles of them where products of doubles are exact."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, labels))
        self.order, self.ids, self.labels, self.x = order, ids[order], labels[order], x[order]
        self.most = float(np.abs(x).max(initial=0))
        self.real = self.x.astype(np.float64)

    def scores(self, anchors: slice, other: Block, rows: slice) -> np.ndarray:
        d = min(self.x.shape[1], other.x.shape[1])
        if d * self.most * other.most < 2.0**53:
            return (self.real[anchors, :d] @ other.real[rows, :d].T).astype(np.int64)
        return self.x[anchors, :d] @ other.x[rows, :d].T

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def runs(batches, most: int = RUN):
    """Blocks of up to ``most`` rows from batches of (id, label, vector)."""
    import pyarrow as pa

    held, n = [], 0

    def block():
        table = pa.Table.from_batches(held).combine_chunks()
        ids, labels = (table.column(k).to_numpy().astype(np.int64) for k in range(2))
        return Block(ids, labels, matrix(table.column(2).chunk(0)))

    for batch in batches:
        for k in range(0, batch.num_rows, most):
            part = batch.slice(k, most)
            if n + part.num_rows > most:
                yield block()
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield block()


def parts(n: int, rows: int):
    """Slices of n anchors for which a matrix of scores of so many rows has PART numbers at most, or one line."""
    step = max(1, PART // max(1, rows))
    return [slice(k, min(n, k + step)) for k in range(0, n, step)]


def sorted_scores(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order of a line's scores: falling, ties by id."""
    return np.lexsort((ids, -scores))


def best_of_label(anchors: Block, rows: Block, k: int):
    """(anchor, score, id) arrays of the first k + 1 rows of each anchor's label; one may be the anchor itself."""
    for label in np.unique(anchors.labels).tolist():
        mine, theirs = anchors.of_label(label), rows.of_label(label)
        ids = rows.ids[theirs]
        if len(ids):
            for part in parts(mine.stop - mine.start, len(ids)):
                part = slice(mine.start + part.start, mine.start + part.stop)
                for at, line in enumerate(anchors.scores(part, rows, theirs), part.start):
                    first = sorted_scores(line, ids)[: k + 1]
                    yield np.full(len(first), at), line[first], ids[first]


def below_positives(anchors: Block, rows: Block, positives: list[np.ndarray], k: int, lower: int, upper: int):
    """(anchor, positive, score, id) arrays: for each positive the first k rows of other labels within its limits."""
    for part in parts(len(anchors.ids), len(rows.ids)):
        scores = anchors.scores(part, rows, slice(None))
        for at, line in enumerate(scores, part.start):
            wanted = positives[at]
            if not len(wanted):
                continue
            same = rows.of_label(int(anchors.labels[at]))
            line = np.concatenate([line[: same.start], line[same.stop :]])
            ids = np.concatenate([rows.ids[: same.start], rows.ids[same.stop :]])
            order = sorted_scores(line, ids)
            falling = -line[order]
            least = wanted // upper * lower + -(-(wanted % upper * lower) // upper)  # ceil(lower * positive / upper)
            begin, stop = np.searchsorted(falling, -wanted), np.searchsorted(falling, -least, "right")
            for number, (a, b) in enumerate(zip(begin.tolist(), np.minimum(begin + k, stop).tolist(), strict=True)):
                if a < b:
                    yield np.full(b - a, at), np.full(b - a, number), line[order[a:b]], ids[order[a:b]]


def anchor_groups(spark: SparkSession, rows: DataFrame, is_anchor: Column):
    """Blocks of anchors, as many rows as GROUP_BYTES hold; each anchor is in one."""
    own = stage_table(spark, rows.where(is_anchor).select(F.monotonically_increasing_id().alias("row"), "id", "label", "x"), "anchors")
    size = own.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    each = max(1, GROUP_BYTES // (8 * max(1, size["d"] or 0)))
    if size["n"] <= each:
        cuts = [None, None]
    else:  # row numbers are dense within a task of the table: from each task's count, where a group begins
        cuts, seen = [None], 0
        task = F.shiftright("row", 33)
        for r in sorted(own.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()):
            while (len(cuts) * each) < seen + r["n"]:
                cuts.append((r["task"] << 33) + len(cuts) * each - seen)
            seen += r["n"]
        cuts.append(None)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        group = own
        if a is not None:
            group = group.where(F.col("row") >= a)
        if b is not None:
            group = group.where(F.col("row") < b)
        found = group.select("id", "label", "x").toArrow().combine_chunks()  # GROUP_BYTES
        if len(found):
            yield next(runs(iter(found.to_batches(max_chunksize=len(found))), len(found)))


def mine(
    spark: SparkSession, rows: DataFrame, is_anchor: Column, row_id: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a condition on rows."""
    names = {"id": F.col(row_id).cast("long"), "label": F.col(label).cast("long")}
    kept = rows.where(F.col(row_id).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector)))
    flagged = kept.select(*[c.alias(n) for n, c in names.items()], as_integers(F.col(vector), scale).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    all_rows = flagged.select("id", "label", "x")
    out = None
    for group in anchor_groups(spark, flagged, F.col("is_anchor")):
        found = mine_group(spark, all_rows, group, positives, negatives, lower, upper)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def mine_group(spark: SparkSession, rows: DataFrame, anchors: Block, positives: int, negatives: int, lower: int, upper: int) -> DataFrame:
    """The rows of one group of anchors; what the driver holds is a few rows for each anchor of the group."""
    import pyarrow as pa

    shared = spark.sparkContext.broadcast(anchors)

    def first_pass(batches):

        for block in runs(batches):
            found = list(best_of_label(shared.value, block, positives))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["anchor", "score", "id"])

    best = rows.mapInArrow(first_pass, "anchor long, score long, id long")
    falling = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    # The anchor meets itself among the first rows of its label, unless enough others come before it: one row of its id and own score goes.
    best = best.withColumn("place", F.row_number().over(falling)).where(F.col("place") <= positives + 1).drop("place")
    self_score = np.einsum("rd,rd->r", anchors.x, anchors.x)
    met = best.toArrow()  # positives + 1 rows for each anchor of the group
    a, s, i = (met.column(k).to_numpy() for k in range(3))
    order = np.lexsort((i, -s, a))
    a, s, i = a[order], s[order], i[order]
    own = np.flatnonzero((i == anchors.ids[a]) & (s == self_score[a]))
    own = own[np.unique(a[own], return_index=True)[1]]
    a, s, i = (np.delete(c, own) for c in (a, s, i))
    place = np.arange(len(a)) - np.searchsorted(a, a)
    a, s, i, place = (c[place < positives] for c in (a, s, i, place))
    begin = np.searchsorted(a, np.arange(len(anchors.ids) + 1))
    scores, ids = ([c[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)] for c in (s, i))
    wanted = spark.sparkContext.broadcast(scores)

    def second_pass(batches):

        for block in runs(batches):
            found = list(below_positives(shared.value, block, wanted.value, negatives, lower, upper))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["anchor", "number", "score", "id"])

    near = rows.mapInArrow(second_pass, "anchor long, number long, score long, id long")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "number").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= negatives)
    told = spark.createDataFrame(pa.table({"anchor": a, "number": place, "anchor_id": anchors.ids[a], "positive_id": i, "positive_score": s}))
    out = ranked.join(F.broadcast(told), ["anchor", "number"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle_sql() -> str:
    """DuckDB SQL of op13_hard_negatives."""
    return """
with usable as (
    select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * c::double)) as x
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scored as (
    select a.id as anchor_id, r.id as id, a.label = r.label as same, list_dot_product(a.x, r.x)::bigint as score
    from usable a join usable r on a.id % 100 = 0 and a.id <> r.id
), positives as (
    select anchor_id, id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
), ranked as (
    select p.anchor_id, p.positive_id, s.id as negative_id, p.positive_score, s.score as negative_score,
        row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) as rank
    from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
        and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from ranked where rank <= 5
"""
