"""Exact substring deduplication by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Its minimiser is the least hash of the runs of RUN words in it.
Consecutive windows that share their minimiser form a super-k-mer, which is packed as one string of words.

1. Per document, the minimisers of its windows. One found in a single document can't belong to a repeated window; only
   minimisers of two or more documents go on.
2. The super-k-mers of those: a digest per occurrence, and the packed string once per distinct super-k-mer and task.
   Copies are counted before anything is dealt out: of equal super-k-mers one string remains, with its least doc_id.
3. Each string goes to its minimiser's bucket. There its windows are sorted with those of the others, and equal windows
   get the least doc_id that any of them has. A bucket of more than BUCKET distinct strings (a passage that very many
   documents embed in texts of their own) isn't held in one task: it is sliced, and the slices' windows meet by digests.
4. A document's word goes if a window that covers it has a smaller doc_id somewhere.

Null and empty texts have no words. Texts shorter than a window lose nothing. Rows with a null doc_id neither lose words
nor make others lose any, having no place in the order; rows that repeat a doc_id are judged one by one and don't affect each other.
Windows are judged on the input, not on what is left. Ids that aren't integers are numbered in their order first. Other
columns pass through, whatever their names and types, but for those called like a result, which are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPREAD_ROWS, WordChunk, as_bytes, mix, spread_join, stage_table, text_chunks, unused

WINDOW, RUN = 50, 8
#: Distinct strings of a bucket that one task sorts.
BUCKET = 256
#: Strings of a slice of a larger bucket.
SLICE = 64
#: Digests that a task remembers so as not to send a string twice.
SEEN = 400_000


def super_kmers(chunk: WordChunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word within the chunk, windows, minimiser) of each super-k-mer of the chunk's texts."""
    h = chunk.hashes()
    none = np.zeros(0, np.int64)
    if len(h) < WINDOW:
        return none, none, none, none
    n = len(h) - RUN + 1
    run = np.zeros(n, np.uint64)
    for k in range(RUN):
        run = run * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : k + n]
    least, size, span = mix(run), 1, WINDOW - RUN + 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    counts = np.diff(chunk.first)
    text = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    inside = np.arange(len(least)) + WINDOW <= chunk.first[1:][text]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none, none
    value, own = least[at].view(np.int64), text[at]
    new = np.r_[True, (value[1:] != value[:-1]) | (own[1:] != own[:-1])]
    begin = np.flatnonzero(new)
    return own[begin], at[begin], np.diff(np.r_[begin, len(at)]), value[begin]


def minimisers(docs: DataFrame) -> DataFrame:
    """(h, doc_id): the distinct minimisers of each document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for k, _, chunk in text_chunks(as_bytes(batch.column(1))):
                text, _, _, h = super_kmers(chunk)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(ids[k + text[new]])], ["h", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, doc_id long")


def _signed(digest: int) -> tuple[int, int]:
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def packed(docs: DataFrame) -> DataFrame:
    """(d1, d2, h, n, doc_id, tag, start, words) of the super-k-mers of docs (doc_id, tag, text, hs) whose minimiser is in hs.

    words is null where the task has sent the string before.
    """

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            ids, wanted, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2), batch.column(3).to_numpy(zero_copy_only=False)
            texts = [b" ".join(x.split()) if x else b"" for x in as_bytes(batch.column(1))]
            for k, j, chunk in text_chunks(texts):
                text, at, n, h = super_kmers(chunk)
                lists = wanted.slice(k, j - k)
                good = np.zeros(len(h), bool)
                bounds = np.searchsorted(text, np.arange(j - k + 1))
                for t in range(j - k):
                    if bounds[t] < bounds[t + 1]:
                        good[bounds[t] : bounds[t + 1]] = np.isin(h[bounds[t] : bounds[t + 1]], lists[t].values.to_numpy(zero_copy_only=False))
                text, at, n, h = text[good], at[good], n[good], h[good]
                d1, d2, strings = [], [], []
                for s, e in zip(chunk.starts[at].tolist(), chunk.ends[at + n + WINDOW - 2].tolist(), strict=True):
                    string = chunk.data[s:e]
                    digest = xxhash.xxh3_128_intdigest(string)
                    hi, lo = _signed(digest)
                    d1.append(hi)
                    d2.append(lo)
                    strings.append(None if digest in seen else string)
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
                start = at - chunk.first[text]
                columns = [pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(h), pa.array(n.astype(np.int32)), pa.array(ids[k + text]), pa.array(tags[k + text]), pa.array(start.astype(np.int32)), pa.array(strings, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["d1", "d2", "h", "n", "doc_id", "tag", "start", "words"])

    return docs.select("doc_id", "text", "hs", "tag").mapInArrow(run, "d1 long, d2 long, h long, n int, doc_id long, tag long, start int, words binary")


def _windows(words: bytes, n: int) -> list[bytes]:
    """The windows of a packed super-k-mer, in order."""
    cuts = [-1, *np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20).tolist(), len(words)]
    return [words[cuts[k] + 1 : cuts[k + WINDOW]] for k in range(n)]


def _settle(bucket: list[tuple]) -> list[tuple[int, int, int, int, int]]:
    """(d1, d2, offset, windows, least doc_id) where a super-k-mer's windows have a smaller doc_id than its greatest one.

    bucket: (d1, d2, n, least, greatest, words) of the distinct super-k-mers of one minimiser.
    """
    if len(bucket) == 1:
        d1, d2, n, least, most, _ = bucket[0]
        return [(d1, d2, 0, n, least)] if least < most else []
    rows = sorted((w, x[3], k, off) for k, x in enumerate(bucket) for off, w in enumerate(_windows(x[5], x[2])))
    least_of = [[0] * x[2] for x in bucket]
    last, least = None, 0
    for w, doc, k, off in rows:
        if w != last:
            last, least = w, doc
        least_of[k][off] = least
    return [r for (d1, d2, _, _, most, _), found in zip(bucket, least_of, strict=True) for r in _runs_of(d1, d2, found, most)]


def _runs_of(d1: int, d2: int, least: list[int], most: int) -> list[tuple[int, int, int, int, int]]:
    """Runs of windows with the same least doc_id, where that is smaller than the super-k-mer's greatest one."""
    out, off = [], 0
    while off < len(least):
        end = off + 1
        while end < len(least) and least[end] == least[off]:
            end += 1
        if least[off] < most:
            out.append((d1, d2, off, end - off, least[off]))
        off = end
    return out


_RUNS = "d1 long, d2 long, off int, len int, least long"


def _run_batch(out: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], ["d1", "d2", "off", "len", "least"])


def sort_buckets(rows: DataFrame) -> DataFrame:
    """Runs of windows with their least doc_id; rows: distinct super-k-mers, at most BUCKET of a minimiser."""

    def run(batches):
        out = []
        for _, bucket in _groups(batches, 1):
            out += _settle(bucket)
            if len(out) > 10_000:
                yield _run_batch(out)
                out = []
        yield _run_batch(out)

    own = rows.select("h", "d1", "d2", "n", "least", "most", "words").repartition("h").sortWithinPartitions("h")
    return own.mapInArrow(run, _RUNS)


def _groups(batches, keys: int):
    """(key, rows) of rows that come sorted by their first columns; a group is held at a time."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def _digests(words: bytes, n: int) -> list[bytes]:
    return [xxhash.xxh3_128_digest(w) for w in _windows(words, n)]


def merge_slices(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The same for crowded minimisers, whose super-k-mers (with crowd, their number) are dealt into slices of SLICE or so.

    A slice finds its distinct windows and sends each one's 128-bit digest and least doc_id to a part of the minimiser, many
    in one row. A part finds the least of all slices and answers the slices that had a greater one.
    """
    sliced = rows.withColumn("slice", F.expr(f"pmod(d1, cast(ceil(crowd / {SLICE}) as bigint))"))
    sliced = stage_table(spark, sliced.select("h", "slice", "crowd", "d1", "d2", "n", "least", "most", "words"), "slices")

    def by(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(*keys[:2]).sortWithinPartitions(*keys)

    def own_least(own) -> dict[bytes, int]:
        least: dict[bytes, int] = {}
        for n, doc, words in own:
            for w in _digests(words, n):
                least[w] = min(doc, least.get(w, doc))
        return least

    def send(batches):
        import pyarrow as pa

        for (h, part_of), own in _groups(batches, 2):
            parts = max(1, own[0][0] // 128)
            out: dict[int, list] = {}
            for w, doc in own_least([x[1:] for x in own]).items():
                out.setdefault(int.from_bytes(w[:4], "little") % parts, []).append((w, doc))
            columns = [[h] * len(out), list(out), [part_of] * len(out), [b"".join(w for w, _ in x) for x in out.values()], [[doc for _, doc in x] for x in out.values()]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h", "part", "slice", "keys", "docs"])

    def answer(batches):
        import pyarrow as pa

        for (h, _), sent in _groups(batches, 2):
            least: dict[bytes, int] = {}
            for _, keys, docs in sent:
                for k, doc in enumerate(docs):
                    w = keys[16 * k : 16 * k + 16]
                    least[w] = min(doc, least.get(w, doc))
            out = []
            for slice_, keys, docs in sent:
                less = [(w, least[w]) for k, doc in enumerate(docs) if least[w := keys[16 * k : 16 * k + 16]] < doc]
                if less:
                    out.append((h, slice_, b"".join(w for w, _ in less), [doc for _, doc in less]))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], ["h", "slice", "keys", "docs"])

    def settle(batches):
        import pyarrow as pa

        for _, own in _groups(batches, 2):
            answers, kmers = [x for x in own if x[0] == 0], [x[3:] for x in own if x[0] == 1]
            least = own_least([(n, doc, words) for _, _, n, doc, _, words in kmers])
            for _, keys, docs, *_ in answers:
                for k, doc in enumerate(docs):
                    w = keys[16 * k : 16 * k + 16]
                    if w in least:
                        least[w] = min(doc, least[w])
            yield _run_batch([r for d1, d2, n, _, most, words in kmers for r in _runs_of(d1, d2, [least[w] for w in _digests(words, n)], most)])

    sent = by(sliced.select("h", "slice", "crowd", "n", "least", "words"), "h", "slice").mapInArrow(send, "h long, part long, slice long, keys binary, docs array<long>")
    answers = by(sent, "h", "part").mapInArrow(answer, "h long, slice long, keys binary, docs array<long>")
    answers = answers.selectExpr("h", "slice", "0 as kind", "keys", "docs", "0L as d1", "0L as d2", "0 as n", "0L as least", "0L as most", "cast(null as binary) as words")
    kmers = sliced.selectExpr("h", "slice", "1 as kind", "cast(null as binary) as keys", "cast(null as array<bigint>) as docs", "d1", "d2", "n", "least", "most", "words")
    return by(answers.unionByName(kmers), "h", "slice", "kind").mapInArrow(settle, _RUNS)


def ordered_ids(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(id, number): a long for each distinct doc_id, in their order, whatever their type."""
    ids = docs.select(F.col("doc_id").alias("id")).where("id is not null").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = ids.repartitionByRange(parts, "id").sortWithinPartitions("id")  # row numbers rise with the range, and within it
    return stage_table(spark, ids.select("id", F.monotonically_increasing_id().alias("number")), "ordered-ids")


def removals(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, tag, gone): for each document that loses words, array<struct<from, to>> of word ranges, to exclusive.

    docs: (doc_id long, text, tag), without null ids. tag is a hash of the text, which tells rows of the same doc_id apart.
    """
    own = stage_table(spark, minimisers(docs), "minimisers")
    shared = stage_table(spark, own.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("times")).where("a < b").select("h", "times"), "shared-minimisers")
    hs = spread_join(own, shared, "h", "times", by=["doc_id"]).groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
    kmers = stage_table(spark, packed(docs.join(hs, "doc_id")), "super-k-mers")
    distinct = kmers.groupBy("d1", "d2").agg(F.first("h").alias("h"), F.first("n").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("words").alias("words"), F.count("*").alias("times"))
    distinct = stage_table(spark, distinct, "distinct-super-k-mers")
    crowded = stage_table(spark, distinct.groupBy("h").agg(F.count("*").alias("crowd")).where(F.col("crowd") > BUCKET), "crowded")
    runs = sort_buckets(distinct.join(crowded, "h", "left_anti"))
    runs = stage_table(spark, runs.unionByName(merge_slices(spark, distinct.join(crowded, "h"))), "runs")
    total = kmers.count()
    often = distinct.where(F.col("times") > max(SPREAD_ROWS, total // 100_000)).select("d1", "d2", "times")  # 100,000 rows at most
    runs = runs.join(F.broadcast(often), ["d1", "d2"], "left").withColumn("times", F.coalesce("times", F.lit(1)))
    hit = spread_join(kmers.select("d1", "d2", "doc_id", "tag", "start"), runs, ["d1", "d2"], "times", by=["doc_id", "start"], total=total).where("least < doc_id")
    begin = F.col("start") + F.col("off")
    span = F.struct(begin.alias("from"), (begin + F.col("len") + (WINDOW - 1)).alias("to"))
    return hit.groupBy("doc_id", "tag").agg(F.collect_list(span).alias("gone"))


def deduplicate(spark: SparkSession, docs: DataFrame, *, text: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) without text, with n_words, n_removed, kept_sha256 and, if text, kept.

    kept is the text as it was if no word goes, else the kept words joined by single spaces. A column of docs that has the
    name of one of these is replaced.
    """
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept", T.StringType())] * text
    fields = [f for f in docs.schema if f.name.lower() not in {"text", *(m.name for m in made)}]
    names = [f.name for f in fields]
    number, tag, away = (unused(c, docs.columns) for c in ("id_number", "text_tag", "gone_words"))
    numbered = docs.withColumn(tag, F.xxhash64("text"))
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        numbered = numbered.withColumn(number, F.col("doc_id").cast("long"))
    else:
        ids = ordered_ids(spark, docs)
        numbered = numbered.join(ids.withColumnsRenamed({"id": unused("id_value", docs.columns), "number": number}), F.col("doc_id") == F.col(unused("id_value", docs.columns)), "left")
    gone = removals(spark, numbered.select(F.col(number).alias("doc_id"), "text", F.col(tag).alias("tag")).where("doc_id is not null"))
    same = (numbered[number] == gone["doc_id"]) & (numbered[tag] == gone["tag"])
    rows = numbered.join(gone, same, "left").select(*[numbered[c] for c in names], numbered["text"], gone["gone"].alias(away))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            total, removed, sums, kept = [], [], [], []
            for x, ranges in zip(as_bytes(batch.column(len(fields))), batch.column(len(fields) + 1).to_pylist(), strict=True):
                words = (x or b"").split()
                n = len(words)
                if ranges:
                    keep = np.ones(n, bool)
                    for r in ranges:
                        keep[r["from"] : r["to"]] = False
                    words = [words[k] for k in np.flatnonzero(keep).tolist()]
                joined = b" ".join(words)
                total.append(n)
                removed.append(n - len(words))
                sums.append(hashlib.sha256(joined).hexdigest())
                if text:
                    kept.append(joined if ranges else x)
            out = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())] + [pa.array(kept, pa.binary()).cast(pa.string())] * text
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *out], [*names, *[m.name for m in made]])

    return rows.mapInArrow(run, T.StructType(fields + made))


def oracle_sql() -> str:
    """DuckDB SQL for deduplicate(documents, text=False)."""
    return rf"""with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        digests as (select doc_id, list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: md5(array_to_string(w[i : i + {WINDOW - 1}], ' '))) as d from t where len(w) >= {WINDOW}),
        windows as (select doc_id, unnest(d) as digest, unnest(range(1, len(d) + 1)) as i from digests),
        later as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by digest) as least from windows) where least < doc_id),
        gone as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as k from later),
        words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from t),
        kept as (select doc_id, string_agg(word, ' ' order by k) as kept, count(*) as n_kept from words anti join gone using (doc_id, k) group by doc_id)
        select doc_id, len(w) as n_words, len(w) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t left join kept using (doc_id)"""
