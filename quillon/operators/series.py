"""Sequential learners over the rows of each series, in order, with states that can be saved and taken up again.

Rows are dealt to tasks by series and sorted by (series, seq); a task holds one learner at a time and reads the rows of
a series batch by batch, so that memory is that of a learner, however long the series. States are tables with a row for
each series (``STATE`` fields of the learner), which ``quillon.sources.model_io`` saves and loads like any other.

A learner has step(row) -> tuple, export() -> tuple of the STATE fields, and is made by make(None) or make(state row).
Rows without a seq have no place and are left out. Series may be null. Of rows with equal seq any may come first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of output that a task gathers before it passes them on.
OUTPUT_ROWS = 2000


def dealt(df: DataFrame, state_fields: str, state: DataFrame | None = None) -> DataFrame:
    """df (series, seq, its other columns) dealt to tasks by series and sorted; a state comes before the rows of its series, without a seq.

    Only with states there is a column __state: even null, lists in a struct cost Spark much time for each row that goes to Python.
    """
    spark = df.sparkSession
    inputs = [f.name for f in df.schema if f.name not in ("series", "seq")]
    state_type = T._parse_datatype_string(state_fields)
    rows = df.where("seq is not null").select(F.col("series").cast("string").alias("series"), F.col("seq").cast("long").alias("seq"), *inputs)
    if state is not None:
        rows = rows.withColumn("__state", F.lit(None).cast(state_type))
        blank = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in inputs]
        kept = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in state_type]).alias("__state")
        rows = rows.unionByName(state.select(F.col("series").cast("string").alias("series"), F.lit(None).cast("long").alias("seq"), *blank, kept))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: small tables can mean much work
    return rows.repartition(parts, "series").sortWithinPartitions("series", F.col("seq").asc_nulls_first())


def run(df: DataFrame, make: Callable, fields: str, state_fields: str, state: DataFrame | None = None, *, final: bool = False) -> DataFrame:
    """(series, seq, fields) for each row of df (series, seq and the columns that step reads), or if ``final`` a state row for each series.

    state: the states to begin with (series, state_fields); series without rows keep theirs.
    """
    out = T._parse_datatype_string(f"series string, {state_fields}" if final else f"series string, seq long, {fields}")
    own = dealt(df, state_fields, state)

    def task(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, made = to_arrow_schema(out), []
        at, learner = None, None

        def flush():
            nonlocal made
            columns = list(zip(*made, strict=True)) if made else [[]] * len(kinds)
            made = []
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

        for batch in batches:
            for row in batch.to_pylist():
                if learner is None or row["series"] != at:
                    if learner is not None and final:
                        made.append((at, *learner.export()))
                    at, learner = row["series"], make(row.get("__state"))
                if row["seq"] is not None:
                    tick = learner.step(row)
                    if not final:
                        made.append((at, row["seq"], *tick))
                if len(made) >= OUTPUT_ROWS:
                    yield flush()
        if learner is not None and final:
            made.append((at, *learner.export()))
        yield flush()

    return own.mapInArrow(task, out)


def generator_state(draw) -> str:
    """A numpy generator's state as JSON text."""
    import json

    return json.dumps(draw.bit_generator.state)


def restored_generator(text: str):
    import json

    import numpy as np

    draw = np.random.default_rng(0)
    draw.bit_generator.state = json.loads(text)
    return draw
