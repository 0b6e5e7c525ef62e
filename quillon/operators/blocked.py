"""Products of sparse rows with a synapse graph that is too large to travel to every task.

The graph is cut into blocks of inputs: ranges with about equal numbers of synapses. A row's bits go to the blocks that they
lie in, one record for each row and block that meet; a block is multiplied with a group of rows in numpy, and sends a
partial count for each row and segment. Partial counts are summed once. So a row is sent once for each block it meets
instead of once for each bit, and a synapse once for each group of rows instead of being met one by one.

A block of more than BLOCK_SYNAPSES synapses, as that of an input which very many segments share, is dealt by segments
into parts, each of which gets the rows; so no task holds more than that, or so, and the rows of a group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Synapses of a task, rows of a group, and cuts between blocks at most.
BLOCK_SYNAPSES, GROUP_ROWS, MAX_BLOCKS = 2_000_000, 1 << 16, 4096
#: Counts that a task holds at a time.
CELLS = 1 << 22


def cut(synapses: DataFrame) -> np.ndarray:
    """The first inputs of all blocks but the first."""
    blocks = min(MAX_BLOCKS, -(-synapses.count() // BLOCK_SYNAPSES))
    if blocks < 2:
        return np.zeros(0, np.int64)
    found = synapses.agg(F.percentile_approx("presyn", [k / blocks for k in range(1, blocks)], 100 * blocks)).first()[0]
    return np.unique(np.array(found, np.int64))


def product(begin: np.ndarray, segment: np.ndarray, connected: np.ndarray, bits: np.ndarray, row: np.ndarray, rows: int):
    """For runs of rows: (rows, segments, connected, potential) of the pairs that meet; synapses are in the order of the inputs that ``begin`` counts."""
    known, local = np.unique(segment, return_inverse=True)
    step = max(1, CELLS // max(1, len(known)))
    cuts = np.searchsorted(row, np.arange(0, rows + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        own, of = bits[a:b], row[a:b] - k * step
        n = begin[own + 1] - begin[own]
        at = np.arange(n.sum()) + np.repeat(begin[own] - np.r_[0, np.cumsum(n)[:-1]], n) if len(n) else np.zeros(0, np.int64)
        key = np.repeat(of, n) * len(known) + local[at]
        potential = np.bincount(key)
        met = np.flatnonzero(potential)
        yield k * step + met // max(1, len(known)), known[met % max(1, len(known))], np.bincount(key[connected[at]], minlength=len(potential))[met], potential[met]


def activity(df: DataFrame, synapses: DataFrame, keys: list[str], bits: str, threshold: float) -> DataFrame:
    """(keys, segment, connected, potential): connections.activity() by blocks."""
    import pyarrow as pa

    cuts = cut(synapses)
    block = F.size(F.filter(F.lit(cuts.tolist()), lambda c: c <= F.col("presyn"))) if len(cuts) else F.lit(0)
    own = synapses.select(block.alias("block_"), "segment", F.col("presyn").cast("long").alias("presyn"), (F.col("perm") >= threshold).alias("connected"))
    parts = F.broadcast(own.groupBy("block_").agg(F.ceil(F.count("*") / BLOCK_SYNAPSES).cast("int").alias("parts_")))  # MAX_BLOCKS rows
    groups = max(1, -(-df.count() // GROUP_ROWS))
    rows = df.select(*keys, F.col(bits).alias("bits_"))

    def deal(batches):
        """A record for each row and block that meet."""
        for batch in batches:
            lists = batch.column(len(keys))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            bit = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.searchsorted(cuts, bit, "right")
            order = np.lexsort((of, row))
            row, bit, of = row[order], bit[order], of[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (of[1:] != of[:-1])]) if len(row) else np.zeros(0, np.int64)
            offsets = pa.array(np.r_[first, len(row)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row[first])) for c in batch.columns[: len(keys)]], pa.array(of[first].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(bit))], [*keys, "block_", "bits_"])

    key_fields = [rows.schema[k] for k in keys]
    dealt = rows.mapInArrow(deal, T.StructType([*key_fields, T.StructField("block_", T.IntegerType()), T.StructField("bits_", T.ArrayType(T.LongType()))]))
    left = dealt.join(parts, "block_").withColumn("group_", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")).withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)))
    right = own.join(parts, "block_").withColumn("part_", F.pmod(F.xxhash64("segment"), F.col("parts_")).cast("int")).withColumn("group_", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    made = ["segment", "connected", "potential"]

    def run(left, right):
        mine, graph = left.combine_chunks(), right.combine_chunks()
        found = []
        if left.num_rows and right.num_rows:
            presyn = graph.column("presyn").to_numpy()
            order = np.argsort(presyn, kind="stable")
            inputs, start = np.unique(presyn[order], return_index=True)
            lists = mine.column("bits_").chunk(0)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            bit = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(inputs, bit), len(inputs) - 1)
            known = inputs[at] == bit
            begin = np.r_[start, len(order)]
            found = list(product(begin, graph.column("segment").to_numpy()[order], graph.column("connected").to_numpy()[order], at[known], row[known], len(lists)))
        place, segment, connected, potential = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        columns = [mine.column(k).take(pa.array(place)) for k in keys]
        return pa.table([*columns, pa.array(segment.astype(np.int32)), pa.array(connected.astype(np.int64)), pa.array(potential.astype(np.int64))], [*keys, *made])

    schema = T.StructType([*key_fields, T.StructField("segment", T.IntegerType()), T.StructField("connected", T.LongType()), T.StructField("potential", T.LongType())])
    where = ["block_", "part_", "group_"]
    partial = left.drop("parts_").groupBy(*where).cogroup(right.drop("parts_").groupBy(*where)).applyInArrow(run, schema)
    return partial.groupBy(*keys, "segment").agg(F.sum("connected").alias("connected"), F.sum("potential").alias("potential"))
