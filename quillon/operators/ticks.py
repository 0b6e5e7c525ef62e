"""One tick of a temporal memory for many records at once, on a graph that all of them share.

Each record (its keys) has the cells that were active before and the columns that are active now. What the segments see,
which cells they predict, what becomes active, who wins and what a learner would change are joins and aggregates of
records with the graph's tables segments(segment, cell) and synapses(segment, presyn, perm). Sequences are learned in
temporal_memory.py; its states give these tables.

What a record learns in a tick is a table of *deltas* over the shared graph: only the synapses that differ from it. A next
tick of the records takes both, so that records learn on one graph without a copy of it each.

A graph of up to connections.BROADCAST_SYNAPSES synapses travels to the tasks, where each record's tick is done in one pass
without a shuffle (tick_arrays.py). Larger graphs take the joins of this module. Their sides have rows for each
record, which Spark takes for small where the records come from a small file: they are merged, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import draws

from . import connections, tick_arrays
from .temporal_memory import MemoryParams


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the records."""
    return df.hint("merge")


def segment_activity(df: DataFrame, segments: DataFrame, synapses: DataFrame, keys: list[str], p: MemoryParams, before: str = "before", deltas: DataFrame | str | None = None) -> DataFrame:
    """(keys, segment, cell, connected, potential, active, matching) of the segments with a synapse on a cell active before.

    deltas, if given, hold for their own records on top of the synapses: what a changed synapse counted before is taken off.
    They are a table as deltas() gives it, or the name of df's column that learned() gives.
    """
    if not isinstance(deltas, DataFrame):
        graph = tick_arrays.TickGraph.gather(segments, synapses, p)
        if graph is not None:
            return tick_arrays.activity(graph, df, keys, before, deltas)
        deltas = df.select(*keys, F.inline(deltas)) if deltas else None
    met = connections.activity(df, synapses, keys, before, p.connected).join(segments.select("segment", "cell"), "segment")
    if deltas is not None:
        own = connections.active_inputs(df, keys, before).join(merged(deltas), [*keys, "presyn"])
        now, was = ([F.col(c).isNotNull().cast("long").alias("potential"), F.coalesce(F.col(c) >= p.connected, F.lit(False)).cast("long").alias("connected")] for c in ("perm", "was"))
        more = [(a - b).alias(n) for a, b, n in zip(now, was, ("potential", "connected"), strict=True)]
        both = met.select(*keys, "segment", "cell", "potential", "connected").unionByName(own.select(*keys, "segment", "cell", *more))
        met = both.groupBy(*keys, "segment", "cell").agg(F.sum("connected").alias("connected"), F.sum("potential").alias("potential")).where("potential > 0")
    marks = (F.col("connected") >= p.activation).alias("active"), (F.col("potential") >= p.min_threshold).alias("matching")
    return met.select(*keys, "segment", "cell", "connected", "potential", *marks)


def predictive_cells(activity: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cells): the cells of active segments, ascending; only records that have one."""
    return activity.where("active").groupBy(*keys).agg(F.array_sort(F.collect_set("cell")).alias("cells"))


def best_segments(activity: DataFrame, keys: list[str], p: MemoryParams) -> DataFrame:
    """(keys, col, segment, cell, potential): of each column's matching segments the one with most synapses on active cells; ties to the least cell, then segment."""
    column = F.floor(F.col("cell") / p.cells_per_column).cast("int").alias("col")
    best = F.max(F.struct("potential", (-F.col("cell")).alias("c"), (-F.col("segment")).alias("s"))).alias("b")
    rows = activity.where("matching and potential > 0").groupBy(*keys, column).agg(best)
    return rows.select(*keys, "col", (-F.col("b.s")).alias("segment"), (-F.col("b.c")).alias("cell"), F.col("b.potential").alias("potential"))


def least_used_cells(segments: DataFrame, p: MemoryParams) -> DataFrame:
    """(col, cell): of each column the cell with the fewest segments; ties to the least cell."""
    cells = segments.sparkSession.range(p.num_cells).select(F.col("id").cast("int").alias("cell"))
    used = cells.join(segments.groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    column = F.floor(F.col("cell") / p.cells_per_column).cast("int").alias("col")
    return used.groupBy(column).agg(F.min(F.struct("n", "cell")).alias("m")).select("col", "m.cell")


def least_used_with(each: DataFrame, segments: DataFrame, deltas: DataFrame, keys: list[str], p: MemoryParams) -> DataFrame:
    """(keys, col, least): the least used cell of those (keys, col) of each for which the record has segments of its own."""
    k = p.cells_per_column
    more = deltas.where("new").groupBy(*keys, "cell").agg(F.count_distinct("segment").alias("more"))
    changed = more.select(*keys, F.floor(F.col("cell") / k).cast("int").alias("col")).distinct()
    cells = each.select(*keys, "col").join(changed, [*keys, "col"]).withColumn("cell", F.explode(F.sequence(F.col("col") * k, F.col("col") * k + (k - 1))))
    used = cells.join(segments.groupBy("cell").agg(F.count("*").alias("used")), "cell", "left").join(more, [*keys, "cell"], "left")
    total = F.coalesce("used", F.lit(0)) + F.coalesce("more", F.lit(0))
    return used.groupBy(*keys, "col").agg(F.min(F.struct(total.alias("n"), "cell")).alias("m")).select(*keys, "col", F.col("m.cell").alias("own_least"))


def compute(df: DataFrame, segments: DataFrame, synapses: DataFrame, keys: list[str], p: MemoryParams, before: str = "before", cols: str = "cols", deltas: DataFrame | None = None) -> DataFrame:
    """(keys, active_cells, winner_cells, predicted_cells, anomaly) of each record. Null or no columns give empty cells and 0."""
    graph = tick_arrays.TickGraph.gather(segments, synapses, p) if deltas is None else None
    if graph is not None:
        return tick_arrays.compute(graph, df, keys, before, cols)
    k = p.cells_per_column
    act = segment_activity(df, segments, synapses, keys, p, before, deltas)
    predicted = merged(predictive_cells(act, keys))
    of_column = act.where("active").groupBy(*keys, F.floor(F.col("cell") / k).cast("int").alias("col")).agg(F.array_sort(F.collect_set("cell")).alias("own"))
    each = df.select(*keys, F.explode(F.array_distinct(cols)).alias("col"))
    each = each.join(merged(of_column), [*keys, "col"], "left").join(merged(best_segments(act, keys, p).select(*keys, "col", F.col("cell").alias("best"))), [*keys, "col"], "left")
    each = each.join(least_used_cells(segments, p).withColumnRenamed("cell", "least"), "col", "left")
    if deltas is not None:
        each = each.join(merged(least_used_with(each, segments, deltas, keys, p)), [*keys, "col"], "left").withColumn("least", F.coalesce("own_least", "least"))
    burst = F.sequence(F.col("col") * k, F.col("col") * k + (k - 1))
    made = each.groupBy(*keys).agg(
        F.array_sort(F.flatten(F.collect_list(F.coalesce("own", burst)))).alias("active_cells"),
        F.array_sort(F.flatten(F.collect_list(F.coalesce("own", F.array(F.coalesce("best", "least")))))).alias("winner_cells"),
        (1 - F.count("own") / F.count("*")).alias("anomaly"),
    )
    none = F.array().cast("array<int>")
    out = df.select(*keys).join(merged(made), keys, "left").join(predicted, keys, "left")
    return out.select(*keys, F.coalesce("active_cells", none).alias("active_cells"), F.coalesce("winner_cells", none).alias("winner_cells"), F.coalesce("cells", none).alias("predicted_cells"), F.coalesce("anomaly", F.lit(0.0)).alias("anomaly"))


def changes(df: DataFrame, segments: DataFrame, synapses: DataFrame, keys: list[str], p: MemoryParams, before: str = "before", cols: str = "cols") -> DataFrame:
    """(keys, segment, change, grow): what learning would do to the segments of each record's tick.

    change is adapt (active segments of active columns, and the best one of a bursting column) or punish (matching
    segments of other columns); grow is how many synapses an adapted best segment takes, 0 for all others.
    """
    graph = tick_arrays.TickGraph.gather(segments, synapses, p)
    if graph is not None:
        return tick_arrays.changes(graph, df, keys, before, cols)
    k = p.cells_per_column
    act = segment_activity(df, segments, synapses, keys, p, before).withColumn("col", F.floor(F.col("cell") / k).cast("int"))
    now = df.select(*keys, F.explode(F.array_distinct(cols)).alias("col")).withColumn("on", F.lit(True))
    predicted = act.where("active").select(*keys, "col").distinct().withColumn("predicted", F.lit(True))
    best = best_segments(act, keys, p).select(*keys, "segment", F.lit(True).alias("best"))
    rows = act.join(merged(now), [*keys, "col"], "left").join(merged(predicted), [*keys, "col"], "left").join(merged(best), [*keys, "segment"], "left")
    burst = F.col("on") & F.col("predicted").isNull() & F.col("best")
    change = F.when(F.col("on") & F.col("active"), "adapt").when(burst, "adapt").when(F.col("on").isNull() & F.col("matching"), "punish")
    grow = F.when(burst, F.greatest(F.lit(0), p.max_new - F.col("potential"))).otherwise(0).cast("long")
    return rows.select(*keys, "segment", change.alias("change"), grow.alias("grow")).where("change is not null")


def deltas(df: DataFrame, segments: DataFrame, synapses: DataFrame, keys: list[str], p: MemoryParams, before: str = "before", winners: str = "winners", cols: str = "cols", digits: int | None = None) -> DataFrame:
    """(keys, segment, cell, presyn, was, perm, new): the synapses that a record's tick changes, over the shared graph.

    was is the permanence before, null for a new synapse; perm the one after, null for a synapse that goes; new tells segments
    of the record's own, numbered behind those of the graph by their columns. Segments adapt, are punished and grow as in
    temporal_memory.Memory; the cells that a segment takes of the record's former winners, and those that make room, follow
    a draw of (keys, segment, cell) and the least permanence, then input. Synapses that stay as they are give no row.
    digits rounds was and perm at the end; rows that records share are rounded once.
    """
    graph = tick_arrays.TickGraph.gather(segments, synapses, p)
    if graph is not None:
        return tick_arrays.deltas(graph, df, keys, before, winners, cols, digits)
    k = p.cells_per_column
    change = changes(df, segments, synapses, keys, p, before, cols)
    own = synapses.groupBy("segment", "presyn").agg(F.max("perm").alias("was"))
    reward = connections.active_inputs(df, keys, winners if p.reinforce_on == "winner" else before).distinct().withColumn("on", F.lit(True))
    touched = change.where((F.col("change") == "adapt") | F.lit(p.predicted_decrement > 0)).join(own, "segment").join(merged(reward), [*keys, "presyn"], "left")
    step = F.when(F.col("change") == "punish", -p.predicted_decrement).when(F.col("on"), p.increment).otherwise(-p.decrement)
    adapted = touched.select(*keys, "segment", "presyn", "was", connections.clamp_permanence(F.col("was") + step).alias("perm"))

    # New synapses: of best segments in bursting columns, and of new segments where no segment matches.
    former = connections.active_inputs(df, keys, winners).distinct()
    act = segment_activity(df, segments, synapses, keys, p, before)
    known = act.where("active or matching").select(*keys, F.floor(F.col("cell") / k).cast("int").alias("col")).distinct().withColumn("known", F.lit(True))
    columns = df.where(F.size(winners) > 0).select(*keys, F.explode(F.array_distinct(cols)).alias("col"))
    lone = columns.join(merged(known), [*keys, "col"], "left").where("known is null").join(least_used_cells(segments, p), "col")
    first = segments.agg((F.coalesce(F.max("segment"), F.lit(-1)) + 1).alias("first"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("col")) - 1
    made = lone.withColumn("number", number).join(F.broadcast(first)).select(*keys, (F.col("first") + F.col("number")).cast("int").alias("segment"), "cell", F.lit(p.max_new).cast("long").alias("grow"), F.lit(True).alias("new"))
    growing = change.where("grow > 0").join(segments.select("segment", "cell"), "segment").select(*keys, "segment", "cell", "grow", F.lit(False).alias("new")).unionByName(made)
    free = growing.join(merged(former), keys).join(own.select("segment", "presyn", F.lit(True).alias("has")), ["segment", "presyn"], "left").where("new or has is null")
    place = F.row_number().over(Window.partitionBy(*keys, "segment").orderBy(draws.uniform("grow", *keys, "segment", "presyn"), "presyn"))
    taken = free.withColumn("place", place).where((F.col("place") <= F.col("grow")) & (F.col("place") <= p.max_synapses))
    grown = taken.select(*keys, "segment", "cell", "presyn", F.lit(None).cast("double").alias("was"), F.lit(p.initial).alias("perm"), "new")

    # Over the maximum the weakest old synapses go, by what they have become.
    more = grown.where("not new").groupBy(*keys, "segment").agg(F.count("*").alias("more"))
    old = adapted.join(merged(more), [*keys, "segment"], "left")
    in_segment = Window.partitionBy(*keys, "segment")
    over = F.count("*").over(in_segment) + F.coalesce("more", F.lit(0)) - p.max_synapses
    old = old.withColumn("over", over).withColumn("weak", F.row_number().over(in_segment.orderBy("perm", "presyn")))
    kept = F.when(F.col("more").isNotNull() & (F.col("weak") <= F.col("over")), F.lit(None).cast("double")).otherwise(F.col("perm"))
    old = old.withColumn("perm", kept).where(~F.col("was").eqNullSafe(F.col("perm"))).join(segments.select("segment", "cell"), "segment")
    out = old.select(*keys, "segment", "cell", "presyn", "was", "perm", F.lit(False).alias("new")).unionByName(grown)
    return out if digits is None else out.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in ("was", "perm")})


def learned(df: DataFrame, segments: DataFrame, synapses: DataFrame, keys: list[str], p: MemoryParams, before: str = "before", winners: str = "winners", cols: str = "cols", name: str = "deltas") -> DataFrame:
    """df with the records' deltas() as a column of arrays, so that a next tick meets them where the records are. keys tell records apart."""
    graph = tick_arrays.TickGraph.gather(segments, synapses, p)
    if graph is not None:
        more = [c for c in df.columns if c not in keys]
        return tick_arrays.learned(graph, df, [*keys, *more], before, winners, cols, name, drawn_by=keys)
    each = deltas(df, segments, synapses, keys, p, before, winners, cols).groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in tick_arrays.DELTA])).alias(name))
    return df.join(merged(each), keys, "left").withColumn(name, F.coalesce(name, F.array().cast(tick_arrays.T.ArrayType(tick_arrays.DELTA))))
