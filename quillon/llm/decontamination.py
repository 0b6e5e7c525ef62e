"""Benchmark decontamination: size-partitioned MinHash containment search. DataFrame functions only.

Shingles are SHINGLE consecutive words of the ASCII-lower-cased text; a text of fewer words is one shingle, a text
without words has none. A document contains an item if it has at least ``threshold`` of the item's distinct shingles.

Items are partitioned by size, in powers of two. An item's sketch is its s smallest shingle hashes, where s follows from the
upper size u of its partition: s = floor((1 - threshold) * u) + 1. A document that lacks all of s shingles of an item
lacks more than the threshold allows, so every containing document has a sketch hash: the search loses nothing, however
long the document. Document shingles with a hash above the largest sketch hash are dropped before the join. Candidates
are verified on the texts, by exact shingle containment.

Items are broadcast if there are at most ``BROADCAST_ITEMS`` rows of sketches, else joined by a shuffle. Null and empty
texts and items have no shingles and are never part of a result; rows with a null id take no part. Rows that repeat a
doc_id or an item_id give one pair, with the most shingles that any of them shares. Empty tables give no rows. Other
columns take no part, whatever their names. To judge rows instead of ids, name a column that tells the rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, words

SHINGLE, THRESHOLD = 5, 0.8
BROADCAST_ITEMS = 200_000


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """array<string> of the shingles of a text, repeats included."""
    w = words(ascii_lower(text))

    def all_of(own: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(own) - (size - 1)), lambda i: F.array_join(F.slice(own, i, F.lit(size)), " "))
        return F.when(F.size(own) >= size, runs).when(F.size(own) > 0, F.array(F.array_join(own, " "))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(w), all_of)[0]  # the words are split once


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """array<long>: a hash for each shingle, from the hashes of its words; equal shingles have equal hashes."""
    h = F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w))

    def all_of(own: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(own) - size), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(size)]))
        whole = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))
        return F.when(F.size(own) >= size, runs).when(F.size(own) > 0, F.array(whole)).otherwise(F.array().cast("array<long>"))

    return F.transform(F.array(h), all_of)[0]


def item_table(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, shingles, n_item, least, sketch): least is the number of shared shingles that containment takes."""
    own = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.array_distinct(shingles(F.col(text))).alias("shingles"), F.array_distinct(shingle_hashes(F.col(text))).alias("hashes"))
    own = own.withColumn("n_item", F.size("shingles")).where("n_item > 0")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n_item")))
    sketch = F.slice(F.sort_array("hashes"), 1, F.least("n_item", (F.floor((1 - THRESHOLD) * upper + 1e-9) + 1).cast("int")))
    return own.withColumn("sketch", sketch).withColumn("least", F.ceil(THRESHOLD * F.col("n_item") - 1e-9))


def contained(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of all pairs at or above the threshold."""
    docs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = item_table(items, item_id, text)
    sketches = table.select("item_id", F.explode("sketch").alias("h"))
    size = sketches.agg(F.count("*").alias("n"), F.max("h").alias("top")).first()
    small = F.broadcast if size["n"] <= BROADCAST_ITEMS else (lambda df: df)
    top = size["top"] if size["n"] else -(1 << 63)

    low = F.filter(shingle_hashes(F.col("text")), lambda h: h <= F.lit(top))
    hashes = docs.select("doc_id", F.explode(F.array_distinct(low)).alias("h"))
    found = hashes.join(small(sketches), "h").select("doc_id", "item_id").distinct()
    by_doc = found.groupBy("doc_id").agg(F.collect_list("item_id").alias("items"))
    texts = docs.join(by_doc, "doc_id").select("doc_id", "items", F.array_distinct(shingles(F.col("text"))).alias("own"))
    pairs = texts.select("doc_id", "own", F.explode("items").alias("item_id")).join(small(table.select("item_id", "shingles", "n_item", "least")), "item_id")
    pairs = pairs.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "least", F.size(F.array_intersect("own", "shingles")).cast("long").alias("n_shared"))
    pairs = pairs.where("n_shared >= least").groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_item")).alias("m"))
    return pairs.select("doc_id", "item_id", "m.n_item", "m.n_shared", (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))


def oracle_sql() -> str:
    """DuckDB SQL for contained(documents, benchmark)."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

    def grams(name: str, key: str) -> str:
        return f"""select distinct {key}, unnest(case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) end) as s
            from (select {key}, {words} as w from {name} where text is not null and {key} is not null)"""

    return f"""with d as ({grams("documents", "doc_id")}), b as ({grams("benchmark", "item_id")}),
        n as (select item_id, count(*) as n_item from b group by item_id),
        p as (select doc_id, item_id, count(*) as n_shared from d join b using (s) group by doc_id, item_id)
        select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment from p join n using (item_id)
        where n_shared >= ceil({THRESHOLD} * n_item - 1e-9)"""
