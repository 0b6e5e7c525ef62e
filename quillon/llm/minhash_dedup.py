"""Near-duplicates by the Jaccard similarity of shingle sets, found by bottom-k sketches from one hash function.

A document's set has the 64-bit hashes of its distinct 3-word shingles, and its *sketch* the RETAINED least ones, or all.
Inverted lists lead from what sketches retain to documents. A single shingle is found in many documents that have nothing
else in common, the more the larger the corpus; so a list is that of two neighbours in a sketch. Linked sets share many
neighbours, so each set needs only its rarest lists: if it shares c of its L lists with any linked set, two linked sets
have a list in common among the L - c + 1 rarest of both, whatever else they contain. For sets whose partners are all
retained whole, c follows from how many
neighbours the shingles of one set alone can break; for larger ones c = L / 5, which linked sets of s = 0.85
miss with a probability below 1e-10, by the choice of the hash and not of the texts.

1. Equal sets are one *node*: copies cost a row each and no more.
2. In each list all nodes meet one of them, the pivot: the one whose lists are the longest, as that of the text that others vary. The components of these links tell which lists hold a single class.
3. In the other lists, nodes of other classes than the list's largest meet all nodes of other classes than theirs. A join
   compares their *parities* first: of each of 64 x WORDS hashed buckets, whether it has an odd number of the set's shingles. Two
   sets have no fewer shingles in one of them only than parities differ, so that no link is lost. Near copies of different
   classes have most lists in common; a pair is left out where one of the last lists of both is the same, as it has met there or before.

So a group of near copies is joined by as many pairs as it has members, or so, and pairs are spelled out only between
classes. A pair passes the union of its sketches: below the smaller of the two last retained hashes both are complete. What one
lacks there it lacks at all, which bounds the similarity; and the share that both have there estimates it, exactly for
sets that are retained whole. A pair of others goes on if the bound allows a link and the estimate is over the
similarity less SLACK, which fails a link with a probability below 1e-10; it is compared on the full sets, of which only
those of such pairs are read again.

Documents without words have an empty set and are linked with nothing; with one or two words, the whole sequence is the
only shingle. A null text is empty. A null doc_id takes part, but never names a class; a class with null ids only has a
null component. Repeated rows are kept. Empty tables give no rows. Other columns of docs take no part, whatever their
names, unless they are named in ``keep``. docs is read two or three times.

Sets are compared by 64-bit hashes of shingles, and equal sets told by 128-bit digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import require

from .common import as_bytes, mix, spread_join, stage_table, text_chunks, unused
from .components import components

SHINGLE, PERCENT = 3, 85
#: Hashes of a sketch, and how far an estimate may be below the similarity.
RETAINED, SLACK = 128, 0.25
#: Longs of a set's parities.
WORDS = 8
PARITIES = [f"o{k}" for k in range(WORDS)]
#: A pivot's link is looked for if the two meet in this share of the lists that one of them needs.
PIVOT_SHARE = 0.15
#: Up to so many list keys or nodes, some 100 MB, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 21
#: Lists before a list, of the same node, that its row carries so as to tell pairs that have met already.
EARLIER = 4
#: Texts that are read at a time.
TEXTS = 500
_PLACES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_sets(column):
    """For runs of an Arrow column of texts: (from, to, sorted distinct shingle hashes of all its texts on end, first hash of each text)."""
    for begin in range(0, len(column), TEXTS):
        for k, j, value, first in _shingle_sets([x and x.lower() for x in as_bytes(column.slice(begin, TEXTS))]):
            yield begin + k, begin + j, value, first


def _shingle_sets(texts: list[bytes | None]):
    for k, j, chunk in text_chunks(texts):
        h, first = chunk.hashes(), chunk.first
        n = np.diff(first)
        made = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        text_of = np.repeat(np.arange(len(n)), made)
        at = np.repeat(first[:-1] - np.r_[0, np.cumsum(made)[:-1]], made) + np.arange(len(text_of))
        words = np.minimum(n, SHINGLE)[text_of]
        value = words.astype(np.uint64)
        for place, factor in enumerate(_PLACES):
            value = mix(np.where(words > place, value + h[np.minimum(at + place, len(h) - 1)] * factor, value)) if len(h) else value
        order = np.lexsort((value, text_of))
        value = value[order]
        new = np.r_[True, (value[1:] != value[:-1]) | (text_of[1:] != text_of[:-1])] if len(value) else np.zeros(0, bool)
        value, text_of = value[new], text_of[new]
        yield k, j, value, np.searchsorted(text_of, np.arange(len(n) + 1))


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def list_keys(sketch: np.ndarray) -> np.ndarray:
    """The keys of a sketch's lists: one for each two neighbours, or for the only hash."""
    if len(sketch) < 2:
        return mix(sketch)
    return mix(sketch[:-1] * _PLACES[0] + sketch[1:] * _PLACES[1])


def lists_needed(n, percent: int):
    """How many of its rarest lists a set of n shingles needs so as to meet all linked sets."""
    lists = np.maximum(np.minimum(n, RETAINED) - 1, 1)
    # A set that lacks a of its n shingles, as many as a link allows, leaves room for b others; each breaks two lists, or one.
    a = n - (percent * n + 99) // 100
    b = 100 * (n - a) // percent - n
    whole = 2 * a + b + 1
    return np.minimum(lists, np.where(100 * n <= percent * RETAINED, whole, lists - lists // 5 + 1))


def parities(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of WORDS longs for each set."""
    m = len(first) - 1
    bucket = (mix(value) >> np.uint64(40)).astype(np.int64) % (64 * WORDS)
    odd = np.bincount(np.repeat(np.arange(m), np.diff(first)) * (64 * WORDS) + bucket, minlength=m * 64 * WORDS) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(m, WORDS)


def sets(docs: DataFrame, keep: list[Column], text: str) -> DataFrame:
    """(c0, c1, ... for the columns keep, n, digest, text_hash, sketch, PARITIES) for each row of docs; sketch is null where a batch has it already, and for empty sets."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            m = batch.num_rows
            n, digests, parts, size, seen = np.zeros(m, np.int64), [b""] * m, [], np.zeros(m, np.int64), set()
            odd = np.zeros((m, WORDS), np.int64)
            for k, j, value, first in shingle_sets(batch.column(batch.num_columns - 1)):
                odd[k:j] = parities(value, first)
                for t, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), k):
                    n[t], digests[t] = b - a, digest(value[a:b])
                    if b > a and digests[t] not in seen:
                        seen.add(digests[t])
                        parts.append(value[a : min(b, a + RETAINED)].copy())
                        size[t] = len(parts[-1])
            offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32), mask=np.r_[size == 0, False])
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n), pa.array(digests, pa.binary()), batch.column(batch.num_columns - 2), lists, *(pa.array(c) for c in odd.T)], names)

    own = docs.select(*keep).columns
    rows = docs.select(*keep, F.xxhash64(text).alias(unused("hash", own)), F.col(text).alias(unused("text", own)))
    own = rows.schema.fields[:-2]
    made = [T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("text_hash", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType())), *[T.StructField(c, T.LongType()) for c in PARITIES]]
    fields = [*[T.StructField(f"c{k}", f.dataType) for k, f in enumerate(own)], *made]
    names = [f.name for f in fields]
    return rows.mapInArrow(run, T.StructType(fields))


def retained_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """(v, node, n, lists, needed): a row for each list of a node; of these it needs the rarest ``needed``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sketches, n = batch.column(2), batch.column(1).to_numpy()
            at, value = sketches.offsets.to_numpy(), sketches.values.to_numpy().view(np.uint64)
            keys = [np.unique(list_keys(value[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            lists = np.array([len(x) for x in keys], np.int64)
            row = np.repeat(np.arange(len(keys)), lists)
            if len(row):
                columns = [np.concatenate(keys).view(np.int64), n[row], lists[row], lists_needed(n, percent)[row]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), batch.column(0).take(pa.array(row)), *(pa.array(c) for c in columns[1:])], ["v", "node", "n", "lists", "needed"])

    return nodes.select("node", "n", "sketch").mapInArrow(run, "v long, node long, n long, lists long, needed long")


def inverted_lists(spark: SparkSession, nodes: DataFrame, percent: int) -> DataFrame:
    """(v, node, n, needed, weight), as a stage table: the lists that nodes need, of several nodes each; weight is the size of all lists of a node together."""
    entries = retained_lists(nodes, percent)
    shared = stage_table(spark, entries.groupBy("v").agg(F.count("*").alias("nodes")).where("nodes > 1"), "shared-keys")
    met = entries.join(bounded(shared, shared.count()), "v")
    own = Window.partitionBy("node")
    # Lists of a node alone are its rarest ones; the others follow by their sizes.
    place = F.col("lists") - F.count("*").over(own) + F.row_number().over(own.orderBy("nodes", "v"))
    met = met.withColumns({"place": place, "weight": F.sum("nodes").over(own)}).where("place <= needed").select("v", "node", "n", "needed", "weight")
    return stage_table(spark, met, "inverted-lists", done=(shared,))


def full_sets(spark: SparkSession, docs: DataFrame, wanted: DataFrame, most: int, text: str) -> DataFrame:
    """(node, shingles) for the nodes ``wanted`` (node, digest, text_hash), ``most`` of them at most, from the texts with such a hash."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, _, value, first in shingle_sets(batch.column(0)):
                digests = [digest(value[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))], ["digest", "shingles"])

    hashes = bounded(wanted.select("text_hash").distinct(), most)
    rows = docs.select(F.col(text).alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    texts = rows.join(hashes, "text_hash", "left_semi").select("text").distinct()
    found = texts.mapInArrow(run, "digest binary, shingles array<long>").join(bounded(wanted.select("digest", "node"), most), "digest")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, which has so many rows at most, with a broadcast hint if those are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def with_both(pairs: DataFrame, total: int, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b), ``total`` of them, with the columns of both nodes, suffixed _a and _b; a node may be in any number of pairs."""
    met = pairs
    for end, other in ("ab", "ba"):
        times = pairs.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("times"))
        own = nodes.join(bounded(times, total), "node").select(F.col("node").alias(end), "times", *[F.col(c).alias(f"{c}_{end}") for c in columns])
        met = spread_join(met, own, end, "times", by=[other], total=total)
    return met


def unsigned(hash: Column) -> Column:
    """A signed long that is ordered as the unsigned hash."""
    return hash.bitwiseXOR(F.lit(-(1 << 63)))


def links(spark: SparkSession, docs: DataFrame, pairs: DataFrame, nodes: DataFrame, percent: int, text: str) -> DataFrame:
    """The pairs (a, b) that are linked, as a stage table."""
    pairs = stage_table(spark, pairs, "pairs")
    both = with_both(pairs, pairs.count(), nodes, ["n", "sketch"])
    least = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))  # shingles that linked sets share at least
    complete = F.when((F.col("n_a") > RETAINED) | (F.col("n_b") > RETAINED), F.least(*[F.when(F.col(f"n_{x}") > RETAINED, F.element_at(f"sketch_{x}", -1)) for x in "ab"]))
    both = both.withColumns({"least": least, "last": complete, "common": F.size(F.array_intersect("sketch_a", "sketch_b"))})
    below = [F.when(F.col("last").isNull(), F.size(f"sketch_{x}")).otherwise(F.size(F.filter(f"sketch_{x}", lambda v: unsigned(v) <= unsigned(F.col("last"))))) for x in "ab"]
    both = both.withColumn("union", below[0] + below[1] - F.col("common"))
    lacking = F.col("union") - F.col("common")  # of the union below ``last``, in one set only
    both = both.where((lacking <= F.col("n_a") + F.col("n_b") - 2 * F.col("least")) & (F.col("common") >= (percent / 100 - SLACK) * F.col("union")))
    exact = F.col("last").isNull()  # both sets are retained whole
    linked = 100 * F.col("common") >= percent * F.col("union")
    both = stage_table(spark, both.where(~exact | linked).select("a", "b", exact.alias("exact")), "likely-pairs", done=(pairs,))
    likely = both.where("not exact").select("a", "b")
    total = likely.count()
    if not total:
        return both.select("a", "b")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(bounded(wanted, 2 * total), "node", "left_semi").select("node", "digest", "text_hash")
    full = stage_table(spark, full_sets(spark, docs, wanted, 2 * total, text), "full-sets")
    met = with_both(likely, total, full, ["shingles"])
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    met = met.select("a", "b", shared.alias("shared"), (F.size("shingles_a") + F.size("shingles_b")).alias("sizes"))
    linked = met.where(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b")
    return stage_table(spark, linked.unionByName(both.where("exact").select("a", "b")), "links", done=(both, full))


def pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): a list's pivot, the node of the greatest weight, with each other one of a size that allows a link, if they meet so in PIVOT_SHARE of the lists that one of them needs.

    These pairs only spare others: what they leave apart meets in pairs_between().
    """
    pivot = lists.groupBy("v").agg(F.max(F.struct("weight", "node", "n", "needed")).alias("pivot"))
    met = lists.join(pivot, "v").select(F.col("pivot.node").alias("a"), F.col("pivot.n").alias("n_a"), F.col("node").alias("b"), "n", F.least("needed", "pivot.needed").alias("needed"))
    times = met.where((F.col("a") != F.col("b")) & (100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a"))).groupBy("a", "b").agg(F.count("*").alias("times"), F.min("needed").alias("needed"))
    return times.where(F.col("times") >= PIVOT_SHARE * F.col("needed")).select("a", "b")


def class_meetings(lists: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes of two classes that a list holds and whose sizes allow a link, not much more than once each."""
    known = lists.select("v", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = known.groupBy("v", "root").agg(F.count("*").alias("members"))
    largest = sizes.groupBy("v").agg(F.max_by("root", F.struct("members", "root")).alias("largest"), F.count("*").alias("classes"))
    # Lists of several classes only: whatever two nodes of two classes share is among them. Their first common list by v is never left out.
    known = known.join(largest.where("classes > 1"), "v").withColumn("earlier", F.collect_list("v").over(Window.partitionBy("node").orderBy("v").rowsBetween(-EARLIER, -1)))
    known = known.join(nodes.select("node", *PARITIES), "node")
    x, y = known.where("root <> largest").alias("x"), known.alias("y")
    both = F.col("x.n") + F.col("y.n")
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in PARITIES), F.lit(0))
    fits = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (apart <= both - 2 * F.ceil(percent * both / (100 + percent)))
    met = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.root") != F.col("y.root")) & fits & ~F.arrays_overlap("x.earlier", "y.earlier"))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def pairs_between(lists: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes of two classes that a list holds and whose sizes allow a link, each once."""
    return class_meetings(lists, nodes, roots, percent).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text", percent: int = PERCENT, keep: list[Column] | None = None) -> DataFrame:
    """(doc_id, the columns keep, n_shingles, component_id, kept) for each row of docs.

    component_id is the smallest doc_id reachable by links, its own included; kept tells whether that is the row's own.
    """
    require(percent > 50, "percent", "must be over 50")
    columns = [F.col("doc_id"), *(keep or [])]
    names = docs.select(*columns).columns
    rows = stage_table(spark, sets(docs, columns, text), "shingle-sets")
    unique = rows.where("sketch is not null").groupBy("digest").agg(F.min("text_hash").alias("text_hash"), *[F.first(c).alias(c) for c in ("n", "sketch", *PARITIES)])
    nodes = stage_table(spark, unique.select(F.monotonically_increasing_id().alias("node"), "digest", "text_hash", "n", "sketch", *PARITIES), "sketches")

    lists = inverted_lists(spark, nodes, percent)
    first = links(spark, docs, pivot_pairs(lists, percent), nodes, percent, text)
    roots = stage_table(spark, components(spark, first), "pivot-roots")
    second = links(spark, docs, pairs_between(lists, nodes, roots, percent), nodes, percent, text)
    roots = components(spark, first.unionByName(second))

    alone = rows.where("n > 0").groupBy("digest").agg(F.min("c0").alias("least_id"), F.count("*").alias("copies"))
    linked = nodes.select("node", "digest").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    classes = stage_table(spark, alone.join(linked, "digest"), "classes")
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("sets"))
    classes = stage_table(spark, spread_join(classes, least, "root", "sets", by=["digest"]), "classes", done=(classes,))
    some = spread_join(rows.where("n > 0"), classes.select("digest", "component_id", "copies"), "digest", "copies", by=["c0"])
    own = [f"c{k}" for k in range(len(names))]
    out = some.select(*own, "n", "component_id").unionByName(rows.where("n = 0").select(*own, "n", F.col("c0").alias("component_id")))
    component, kept = (unused(c, names) if c in names else c for c in ("component_id", "kept"))
    return out.select(*[F.col(c).alias(n) for c, n in zip(own, names, strict=True)], F.col("n").alias("n_shingles"), F.col("component_id").alias(component), F.coalesce(F.col("c0") == F.col("component_id"), F.lit(False)).alias(kept))
