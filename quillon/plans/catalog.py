"""The queries of the library over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import draws, kernels, sdr
from quillon.functions.kernels import csv
from quillon.operators import anomaly, classifier, connections, encoders, metrics, ranges, slices, spatial_pooler, temporal_memory, ticks, topology, windows
from quillon.operators.encoders import finance, probability, signal, spatial, vision
from quillon.plans.hash_sql import s_bytes, s_draws, s_finalised, s_first, s_fnv, s_lcg_planes, s_level_states, s_rotated, s_signs, s_unsigned
from quillon.sources import model_io
from quillon.sources.stages import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by its key over as many partitions as a shuffle has: a number of its own, as small files can mean much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def r6(c: Column) -> Column:
    """Rounded to 6 digits, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# ---- SQL building blocks ----------------------------------------------------------------------------------------------


def s_csv(bits: str) -> str:
    return f"array_to_string({bits}, ',')"


def s_block(start: str, width: int) -> str:
    return f"list_transform(range({width}), lambda i: i + {start})"


def s_clamp(x: str, low: float, high: float) -> str:
    return f"greatest(least({x}, {high}), {low})"


def s_share(x: str, low: float, high: float) -> str:
    return f"(({s_clamp(x, low, high)} - ({low})) / {high - low})"


def s_run(x: str, bits: int, width: int, offset: int = 0) -> str:
    return s_block(f"(cast(round(({x}) * {float(bits - width)}) as bigint) + {offset})", width)


def s_runs(*parts: tuple[str, int, int]) -> str:
    """Blocks (share, bits, width), one after the other."""
    out, offset = [], 0
    for x, bits, width in parts:
        out.append(s_run(x, bits, width, offset))
        offset += bits
    return f"flatten([{', '.join(out)}])"


def s_scalar(v: str, low: float, high: float, size: int, width: int) -> str:
    n = size - width + 1
    return s_block(f"cast(least(floor(({s_clamp(v, low, high)} - ({low})) / {float(high - low)} * {float(n)}), {n - 1}) as bigint)", width)


def s_ring(v: str, top: float, size: int, width: int, offset: int = 0) -> str:
    b = f"cast(least(floor(({v}) / {float(top)} * {float(size)}), {size - 1}) as bigint)"
    return f"list_sort(list_transform(range({width}), lambda i: (i + {b}) % {size} + {offset}))"


def s_uniform(name: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{name}'", *(f"cast({k} as varchar)" for k in keys)])
    return f"((cast('0x' || substr(md5({text}), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double)"


# ---- SDR algebra --------------------------------------------------------------------------------------------------------

VALUE = encoders.ScalarEncoder(0.0, 500.0, 400, 21)
_S_VALUE = s_scalar("value", 0.0, 500.0, 400, 21)
_S_PAIRS = f"""with e as (select event_id, user_id, ts, value, {_S_VALUE} as bits from events),
  p as (select event_id, user_id, bits, lag(bits) over (partition by user_id order by ts, event_id) as before from e)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the bits of their value and of the user's event before."""
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", VALUE.encode(F.col("value")).alias("bits"))
    return e.withColumn("before", F.lag("bits").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


@query("sdr_overlap_consecutive", f"{_S_PAIRS} select event_id, cast(len(list_intersect(bits, before)) as bigint) as overlap, round(1 - len(list_intersect(bits, before)) / 21, 6) as anomaly from p where before is not null")
def sdr_overlap_consecutive(spark, sf):
    p = pairs(spark, sf).where("before is not null")
    o = sdr.overlap(F.col("bits"), F.col("before"))
    return p.select("event_id", o.cast("long").alias("overlap"), r6(1 - o / F.lit(21.0)).alias("anomaly"))


@query("sdr_set_operations", f"""{_S_PAIRS} select event_id, {s_csv("list_sort(list_distinct(list_concat(bits, before)))")} as union_bits,
  {s_csv("list_sort(list_intersect(bits, before))")} as intersection_bits, {s_csv("list_sort(list_filter(bits, lambda b: not list_contains(before, b)))")} as difference_bits,
  round(len(list_intersect(bits, before)) / len(list_distinct(list_concat(bits, before))), 6) as jaccard from p where before is not null""")
def sdr_set_operations(spark, sf):
    a, b = F.col("bits"), F.col("before")
    cols = [csv(f(a, b)).alias(n) for n, f in (("union_bits", sdr.union), ("intersection_bits", sdr.intersection), ("difference_bits", sdr.difference))]
    return pairs(spark, sf).where("before is not null").select("event_id", *cols, r6(sdr.jaccard(a, b)).alias("jaccard"))


@query("sdr_concatenate", f"{_S_PAIRS} select event_id, {s_csv('list_concat(bits, list_transform(before, lambda b: b + 400))')} as bits from p where before is not null")
def sdr_concatenate(spark, sf):
    return pairs(spark, sf).where("before is not null").select("event_id", csv(sdr.concatenate((F.col("bits"), 400), (F.col("before"), 400))).alias("bits"))


@query("sdr_dense", "select c_custkey, array_to_string(list_transform(range(64), lambda i: case when i % 7 = c_custkey % 7 then 1 else 0 end), '') as dense, cast(len(list_filter(range(64), lambda i: i % 7 = c_custkey % 7)) as bigint) as active, round(len(list_filter(range(64), lambda i: i % 7 = c_custkey % 7)) / 64, 6) as sparsity from customer")
def sdr_dense(spark, sf):
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 7 == F.col("c_custkey") % 7)
    c = spread(t(spark, sf, "customer").select("c_custkey"), "c_custkey").select("c_custkey", bits.alias("b")).select("c_custkey", "b", sdr.to_dense(F.col("b"), 64).alias("d"))
    back = sdr.from_dense(F.col("d"))
    return c.select("c_custkey", F.array_join(F.col("d").cast("array<string>"), "").alias("dense"), F.size(back).cast("long").alias("active"), r6(sdr.sparsity(back, 64)).alias("sparsity"))


@query("sdr_coordinates", f"select event_id, {s_csv(f'list_transform({_S_VALUE}, lambda b: b // 20)')} as rows_, {s_csv(f'list_transform({_S_VALUE}, lambda b: b % 20)')} as cols_, {s_csv(_S_VALUE)} as bits, list_contains({_S_VALUE}, 5 * 20 + 3) as at_5_3 from events")
def sdr_coordinates(spark, sf):
    shape = sdr.Shape((400,)).reshape(20, 20)
    e = t(spark, sf, "events").select("event_id", VALUE.encode(F.col("value")).alias("b")).withColumn("c", shape.coordinates(F.col("b")))
    return e.select("event_id", csv(F.col("c")[0]).alias("rows_"), csv(F.col("c")[1]).alias("cols_"), csv(shape.from_coordinates(F.col("c"))).alias("bits"), shape.at(F.col("b"), F.lit(5), F.lit(3)).alias("at_5_3"))


@query("sdr_noise")
def sdr_noise(spark, sf):
    e = spread(t(spark, sf, "customer").select("c_custkey"), "c_custkey").select("c_custkey", sdr.randomize(F.col("c_custkey"), 200, 0.1, 3).alias("b"))
    noisy = sdr.add_noise(F.col("b"), F.col("c_custkey"), 200, 0.25, 4)
    return e.select("c_custkey", F.size("b").alias("active"), F.size(noisy).alias("active_noisy"), sdr.overlap(F.col("b"), noisy).alias("overlap"))


# ---- encoders -----------------------------------------------------------------------------------------------------------


def encoded(name: str, table: str, key: list[str], make: Callable[[], Column], sql: str | None, where: str = "") -> None:
    """A query of keys and the bits of an expression; sql is the DuckDB expression of the same list."""
    cond = f" where {where}" if where else ""
    text = f"select {', '.join(key)}, {s_csv(sql)} as bits from {table}{cond}" if sql is not None else None

    @query(name, text)
    def run(spark, sf):
        df = t(spark, sf, table)
        return (df.where(where) if where else df).select(*key, csv(make()).alias("bits"))


LINE = ["l_orderkey", "l_linenumber"]
E = encoders
encoded("enc_scalar", "lineitem", LINE, lambda: E.ScalarEncoder(0.0, 60.0, 200, 21).encode(F.col("l_quantity")), s_scalar("l_quantity", 0.0, 60.0, 200, 21))
encoded("enc_scalar_clipped", "lineitem", LINE, lambda: E.ScalarEncoder(10.0, 40.0, 100, 11, clip=True).encode(F.col("l_quantity")), s_scalar("l_quantity", 10.0, 40.0, 100, 11))
encoded("enc_scalar_radius", "lineitem", LINE, lambda: E.ScalarEncoder(0.0, 60.0, 0, 21, radius=5.0).encode(F.col("l_quantity")), s_scalar("l_quantity", 0.0, 60.0, math.ceil(60 / (5.0 / 21)) + 20, 21))
encoded("enc_scalar_category", "lineitem", LINE, lambda: E.ScalarEncoder(1.0, 7.0, 0, 5, category=True).encode(F.col("l_linenumber")), s_scalar("l_linenumber", 1.0, 7.0, 11, 5))
encoded("enc_scalar_periodic", "events", ["event_id"], lambda: E.ScalarEncoder(0.0, 360.0, 360, 21, periodic=True).encode(F.col("value") * 3 - 200), s_ring("((value * 3 - 200) % 360.0 + 360.0) % 360.0", 360.0, 360, 21))
encoded("enc_log", "lineitem", LINE, lambda: E.LogEncoder(100.0, 200_000.0, 300, 21, clip=True).encode(F.col("l_extendedprice")), s_run(f"(ln({s_clamp('l_extendedprice', 100.0, 200000.0)}) - {math.log(100.0)!r}) / {math.log(200000.0) - math.log(100.0)!r}", 300, 21))


def s_murmur(x: str, seed: int, size: int) -> str:
    """DuckDB: the list of murmur3_32(x + i, seed) % size, in hugeint arithmetic."""
    m = "4294967295"

    def rot(v: str, n: int) -> str:
        return f"((({v} << {n}) & {m}) | ({v} >> {32 - n}))"

    steps = [
        ("k", f"(({x}) & {m}) * 3432918353 & {m}"), ("k", rot("k", 15)), ("k", f"(k * 461845907) & {m}"), ("h", f"xor(cast({seed} as bigint), k)"),
        ("h", rot("h", 13)), ("h", f"(h * 5 + 3864292196) & {m}"), ("h", "xor(h, 4)"), ("h", "xor(h, h >> 16)"), ("h", f"cast(cast(h as hugeint) * 2246822507 % 4294967296 as bigint)"),
        ("h", "xor(h, h >> 13)"), ("h", f"cast(cast(h as hugeint) * 3266489909 % 4294967296 as bigint)"), ("h", "xor(h, h >> 16)"),
    ]
    steps[0] = ("k", f"cast(cast(({x}) as hugeint) * 3432918353 % 4294967296 as bigint)")
    steps[2] = ("k", "cast(cast(k as hugeint) * 461845907 % 4294967296 as bigint)")
    sql, names = "select *", []
    inner = "i0"
    for n, (name, expr) in enumerate(steps):
        drop = f"exclude ({name})" if name in names else ""
        sql = f"select * {drop}, {expr} as {name} from ({inner})" if n else f"select *, {expr} as {name} from i0"
        inner = sql
        names.append(name)
    return f"select *, h % {size} as bit from ({inner})"


@query("enc_rdse", f"""with i0 as (select l_orderkey, l_linenumber, rid, cast(floor(l_extendedprice / 25.0) as bigint) + unnest(range(20)) as x from (select *, row_number() over () as rid from lineitem)),
  b as ({s_murmur("x", 42, 1000)}) select l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list(bit))), ',') as bits from b group by l_orderkey, l_linenumber, rid""")
def enc_rdse(spark, sf):
    e = E.RandomDistributedScalarEncoder(1000, 20, resolution=25.0, seed=42)
    return t(spark, sf, "lineitem").select(*LINE, csv(e.encode(F.col("l_extendedprice"))).alias("bits"))


@query("enc_rdse_seeded", f"""with i0 as (select event_id, cast(floor(value / 0.5) as bigint) + unnest(range(15)) as x from events),
  b as ({s_murmur("x", 123456789, 600)}) select event_id, array_to_string(list_sort(list_distinct(list(bit))), ',') as bits from b group by event_id""")
def enc_rdse_seeded(spark, sf):
    e = E.RandomDistributedScalarEncoder(600, 15, resolution=0.5, seed=123456789)
    return t(spark, sf, "events").select("event_id", csv(e.encode(F.col("value"))).alias("bits"))


@query("enc_delta", f"""with d as (select event_id, coalesce(value - lag(value) over (partition by user_id order by ts, event_id), 0.0) as delta from events)
  select event_id, round(delta, 6) + 0.0 as delta, {s_csv(s_scalar("delta", -100.0, 100.0, 100, 10))} as bits from d""")
def enc_delta(spark, sf):
    e = E.DeltaEncoder()
    d = t(spark, sf, "events").select("event_id", e.delta(F.col("value"), ["user_id"], ["ts", "event_id"]).alias("delta"))
    return d.select("event_id", r6(F.col("delta")).alias("delta"), csv(e.encode(F.col("delta"))).alias("bits"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def s_index(values: list[str], c: str) -> str:
    return f"(list_position([{', '.join(repr(v) for v in values)}], {c}) - 1)"


encoded("enc_category", "events", ["event_id"], lambda: E.CategoryEncoder(EVENT_TYPES, 11).encode(F.col("event_type")), s_block(f"{s_index(EVENT_TYPES, 'event_type')} * 11", 11))
encoded("enc_boolean", "lineitem", LINE, lambda: E.BooleanEncoder(7).encode(F.col("l_returnflag") == "R"), s_block("case when l_returnflag = 'R' then 0 else 7 end", 7))
encoded("enc_ordinal", "orders", ["o_orderkey"], lambda: E.OrdinalEncoder(PRIORITIES, 80, 15, strict=False).encode(F.col("o_orderpriority")), s_run(f"{s_index(PRIORITIES, 'o_orderpriority')} / 4.0", 80, 15))
encoded("enc_passthrough", "customer", ["c_custkey"], lambda: E.PassThroughEncoder(2048).encode(F.transform(F.array(F.lit(7), F.lit(3), F.lit(7)), lambda x: (x * F.col("c_custkey") % 2048).cast("int"))), "list_sort(list_distinct([7 * c_custkey % 2048, 3 * c_custkey % 2048, 7 * c_custkey % 2048]))")


def s_pmod(x: str, n: float) -> str:
    return f"case when ({x}) % {n} < 0 then (({x}) % {n} + {n}) % {n} else ({x}) % {n} end"


def _s_grid(x: str, y: str) -> str:
    bits = []
    for k in range(4):
        scale, c, s = 1.5**k, math.cos(k * math.pi / 6), math.sin(k * math.pi / 6)
        down, across = (f"cast(least(floor({s_pmod(f'({v}) / {scale!r}::double', 4.0)}), 3) as bigint)" for v in (f"{x} * {s!r}::double + {y} * {c!r}::double", f"{x} * {c!r}::double - {y} * {s!r}::double"))
        bits.append(f"{down} * 4 + {across} + {16 * k}")
    return f"[{', '.join(bits)}]"


encoded("enc_grid", "customer", ["c_custkey"], lambda: E.GridCellEncoder().encode(F.col("c_acctbal") / 100, (F.col("c_custkey") % 97).cast("double")), _s_grid("(c_acctbal::double / 100)", "(c_custkey % 97)::double"))

DATE = dict(season_width=5, day_of_week_width=2, weekend_width=2, custom_width=3, holiday_width=2, time_of_day_width=4, custom_days=["Monday", "Friday"], holidays=[(12, 25), (7, 4)])


def _s_date() -> str:
    wd, hour = "(isodow(ts) - 1)", "extract(hour from ts)"
    tod = f"({hour} + extract(minute from ts) / 60.0 + floor(extract(second from ts)) / 3600.0)"
    holiday = "0.0"
    for m, d in ((7, 4), (12, 25)):
        since = f"cast(floor(epoch(ts) - epoch(make_timestamp(year(ts), {m}, {d}, 0, 0, 0.0))) as double)"
        holiday = f"case when {since} >= 0 and {since} < 86400 then 1.0 when {since} >= 86400 and {since} < 172800 then {since} / 86400 when {since} < 0 and {since} > -86400 then 1 + {since} / 86400 else {holiday} end"
    sizes = [20, 14, 3, 4, 4, 24]
    at = [sum(sizes[:k]) for k in range(6)]
    parts = [
        s_ring("dayofyear(ts) - 1.0", 366.0, 20, 5, at[0]), s_ring(f"cast({wd} as double)", 7.0, 14, 2, at[1]),
        s_block(f"(case when {wd} >= 5 or ({wd} = 4 and {hour} >= 18) then 1 else 0 end + {at[2]})", 2), s_block(f"(case when {wd} in (0, 4) then 1 else 0 end + {at[3]})", 3),
        s_ring(f"({holiday})", 2.0, 4, 2, at[4]), s_ring(tod, 24.0, 24, 4, at[5]),
    ]
    return f"flatten([{', '.join(parts)}])"


encoded("enc_date", "events", ["event_id"], lambda: E.DateEncoder(**DATE).encode(F.col("ts")), _s_date())


@query("enc_date_orders", f"select o_orderkey, {s_csv(_s_date())} as bits from (select o_orderkey, o_orderdate as ts from orders)")
def enc_date_orders(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", csv(E.DateEncoder(**DATE).encode(F.col("o_orderdate"))).alias("bits"))


@query("enc_hierarchy", f"""with kinds as (select distinct p_type, string_split(p_type, ' ') as parts from part),
  steps as (select p_type, unnest(range(least(len(parts), 5))) as level, parts from kinds),
  states as (select p_type, level, {s_fnv(s_bytes("array_to_string(parts[1:level + 1], ' ')"), s_level_states(5) + "[level + 1]")} as h from steps),
  draws as (select p_type, level, {s_draws("h", 50, 80)} as d from states),
  bits as (select p_type, list_sort(flatten(list(list_transform({s_first("d", 10)}, lambda b: b + 50 * level)))) as bits from draws group by p_type)
  select p_partkey, {s_csv("bits")} as bits from part left join bits using (p_type)""")
def enc_hierarchy(spark, sf):
    return t(spark, sf, "part").select("p_partkey", csv(E.HierarchicalCategoryEncoder(" ").encode(F.col("p_type"))).alias("bits"))


#: No text has so many elements or n-grams: all of a text counts.
ALL = 1 << 30


@query("enc_set", f"""with each as (select doc_id, unnest(list_distinct(string_split(text, ' '))) as w from documents),
  draws as (select w, {s_draws("h", 2048, 5)} as d from (select w, {s_fnv(s_bytes("w"))} as h from (select distinct w from each))),
  bits as (select doc_id, list_sort(list_distinct(flatten(list(d)))) as bits from each join draws using (w) group by doc_id)
  select doc_id, {s_csv("bits")} as bits from documents left join bits using (doc_id)""")
def enc_set(spark, sf):
    return t(spark, sf, "documents").select("doc_id", csv(E.SetEncoder(max_elements=ALL).encode(F.array_distinct(F.split("text", " ")))).alias("bits"))


@query("enc_simhash", f"""with tok as (select conv_id, turn, unnest(string_split_regex(lower(text), '\\s+')) as tok from conversations), n as (select conv_id, turn, tok, count(*) as n from tok where tok <> '' group by all),
  h as (select tok, level, {s_fnv(s_bytes('tok'), 'state')} as h from (select distinct tok from n), (select unnest({s_level_states(7)}) as state, unnest(range(7)) as level)),
  b as (select tok, place, case when (h // cast(pow(2.0::double, place % 64) as uhugeint)) % 2::uhugeint = 1::uhugeint then 1 else -1 end as sign from h join (select range as place from range(400)) on place // 64 = level),
  sums as (select conv_id, turn, place, sum(n * sign) as total from n join b using (tok) group by all), r as (select *, row_number() over (partition by conv_id, turn order by total desc, place) as rn from sums)
  select conv_id, turn, string_agg(place, ',' order by place) as bits from r where rn <= 21 group by all""")
def enc_simhash(spark, sf):
    return t(spark, sf, "conversations").where("length(trim(text)) > 0").select("conv_id", "turn", csv(E.SimHashDocumentEncoder(400, 21).encode(F.col("text"))).alias("bits"))


_S_GRAM = "(({h}) * 1099511628211::uhugeint + {i}::uhugeint) % 18446744073709551616::uhugeint"
_S_GRAM_1 = _S_GRAM.format(h="h", i=0)
_S_GRAM_2 = _S_GRAM.format(h=_S_GRAM_1, i=1)
_S_GRAM_3 = _S_GRAM.format(h=_S_GRAM_2, i=2)


@query("enc_ngram", f"""with each as (select distinct conv_id, turn, unnest(list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3))) as g from conversations where text is not null),
  hashes as (select g, {s_fnv(s_bytes("g"))} as h from (select distinct g from each)),
  grams as (select g, list_transform([{_S_GRAM_1}, {_S_GRAM_2}, {_S_GRAM_3}], lambda x: cast(x % 2048::uhugeint as bigint)) as d from hashes),
  bits as (select conv_id, turn, list_sort(list_distinct(flatten(list(d)))) as bits from each join grams using (g) group by conv_id, turn)
  select conv_id, turn, case when text is not null then {s_csv("coalesce(bits, [])")} end as bits from conversations left join bits using (conv_id, turn)""")
def enc_ngram(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", csv(E.NGramEncoder(max_grams=ALL).encode(F.col("text"))).alias("bits"))


@query("enc_ngram_words", f"""with w as (select conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from conversations where text is not null),
  each as (select distinct conv_id, turn, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w where len(w) > 1),
  hashes as (select g, {s_fnv(s_bytes("g"))} as h from (select distinct g from each)), grams as (select g, list_transform([{_S_GRAM_1}, {_S_GRAM_2}, {_S_GRAM_3}], lambda x: cast(x % 2048::uhugeint as bigint)) as d from hashes),
  bits as (select conv_id, turn, list_sort(list_distinct(flatten(list(d)))) as bits from each join grams using (g) group by conv_id, turn)
  select conv_id, turn, case when text is not null then {s_csv("coalesce(bits, [])")} end as bits from conversations left join bits using (conv_id, turn)""")
def enc_ngram_words(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", csv(E.NGramEncoder(n=2, word_level=True, max_grams=ALL).encode(F.col("text"))).alias("bits"))


_S_PRINTABLE = "instr(' !\"#$%&''()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~', c)"


@query("enc_character", f"select p_partkey, cast(pos as integer) as pos, {s_csv(s_block(f'case when {_S_PRINTABLE} > 0 then {_S_PRINTABLE} - 1 else 95 end * 21', 21))} as bits from (select p_partkey, unnest(range(len(p_name))) as pos, p_name[pos + 1] as c from part)")
def enc_character(spark, sf):
    each = t(spark, sf, "part").select("p_partkey", F.posexplode(F.filter(F.split("p_name", ""), lambda c: c != "")).alias("pos", "c"))
    return each.select("p_partkey", "pos", csv(E.CharacterEncoder().encode(F.col("c"))).alias("bits"))



def _s_cells(tries: int, *values: str, size: int = 1000) -> str:
    """Hashes of whole numbers, below size; one of the values is index, which counts the tries."""
    own = ", ".join("cast(index as uhugeint)" if v == "index" else v for v in values)
    return f"list_transform(range({tries}), lambda index: cast({s_fnv(f'[{own}]')} % {size}::uhugeint as bigint))"


@query("enc_coordinate", f"""with draws as (select s_suppkey, {_s_cells(400, "index", s_unsigned("cast(round(s_acctbal::double / 10.0) as bigint)"), s_unsigned("cast(round(s_suppkey::double / 10.0) as bigint)"))} as d from supplier)
  select s_suppkey, {s_csv(f"list_sort({s_first('d', 21)})")} as bits from draws""")
def enc_coordinate(spark, sf):
    bits = E.CoordinateEncoder(2, 1000, 21, 10.0).encode(F.col("s_acctbal"), F.col("s_suppkey").cast("double"))
    return t(spark, sf, "supplier").select("s_suppkey", csv(bits).alias("bits"))


def _place() -> tuple[Column, Column]:
    return (F.col("s_suppkey") % 160 - 80) + F.lit(0.25), (F.col("s_suppkey") * 7 % 340 - 170) + F.lit(0.5)


@query("enc_geospatial", f"""with place as (select s_suppkey, s_suppkey % 160 - 80 + 0.25::double as lat, s_suppkey * 7 % 340 - 170 + 0.5::double as lon from supplier),
  metres as (select s_suppkey, radians(lat) * 6371000.0::double as y, radians(lon) * 6371000.0::double * cos(radians(lat)) as x from place),
  cells as (select s_suppkey, cast(floor(y / 100.0) as bigint) as y0, cast(floor(x / 100.0) as bigint) as x0, cast(floor(y / 200.0) as bigint) as y1, cast(floor(x / 200.0) as bigint) as x1 from metres),
  draws as (select s_suppkey, {_s_cells(126, s_unsigned("y0"), s_unsigned("x0"), "0::uhugeint", "index")} as a, {_s_cells(126, s_unsigned("y1"), s_unsigned("x1"), "1::uhugeint", "index")} as b from cells),
  merged as (select s_suppkey, list_concat({s_first("a", 10)}, b) as d from draws)
  select s_suppkey, {s_csv(f"list_sort({s_first('d', 21)})")} as bits from merged""")
def enc_geospatial(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", csv(E.GeospatialEncoder(num_scales=2).encode(*_place())).alias("bits"))


@query("haversine", """select s_suppkey, round(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(48.5) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(48.5)) * pow(sin(radians(9.25 - lon) / 2), 2)))), 3) as metres
  from (select s_suppkey, s_suppkey % 160 - 80 + 0.25::double as lat, s_suppkey * 7 % 340 - 170 + 0.5::double as lon from supplier)""")
def haversine(spark, sf):
    lat, lon = _place()
    return t(spark, sf, "supplier").select("s_suppkey", F.round(spatial.haversine(lat, lon, F.lit(48.5), F.lit(9.25)), 3).alias("metres"))


_S_VECTORS = "vec as (select vec_id, unnest(range(64)) as place, cast(unnest(embedding) as double) as x from embeddings)"


def _s_picked(state: str, source: str, size: int, width: int, steps: int, more: str = "[]") -> str:
    """Bits drawn from a state, as text; more is a list of further bits."""
    return f"select vec_id, {s_csv(f'list_sort(list_concat({s_first(s_draws(state, size, steps), width)}, {more}))')} as bits from {source}"


def _s_embedding(planes: int, seed: int, size: int, width: int, state: str = "state") -> str:
    return f"with {s_lcg_planes(planes, 64, seed)}, {_S_VECTORS}, st as ({s_signs('vec', 'vec_id', 'planes')}), own as (select vec_id, label, {state} as state from st join embeddings using (vec_id)) {_s_picked('state', 'own', size, width, width)}"


@query("enc_word_embedding", _s_embedding(64, 42, 2048, 41))
def enc_word_embedding(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", csv(E.WordEmbeddingEncoder(64).encode(F.col("embedding"))).alias("bits"))


@query("enc_patch", _s_embedding(64, 42, 1024, 41))
def enc_patch(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", csv(E.PatchEncoder().encode(F.col("embedding"))).alias("bits"))


_S_NODE = "(state + cast(label as uhugeint) * 5871781006564002453::uhugeint % 18446744073709551616::uhugeint + cast(cast(floor(vec_id % 10 / 10.0::double * 1000.0::double) as bigint) as uhugeint) * 2685821657736338717::uhugeint % 18446744073709551616::uhugeint) % 18446744073709551616::uhugeint"


@query("enc_graph_node", _s_embedding(64, 42, 2048, 41, _S_NODE))
def enc_graph_node(spark, sf):
    bits = E.GraphNodeEncoder().encode(F.col("embedding"), F.col("label"), F.col("vec_id") % 10 / F.lit(10.0))
    return t(spark, sf, "embeddings").select("vec_id", csv(bits).alias("bits"))


_S_BANDS = ", ".join(f"w{k} as ({s_signs('vec', 'vec_id', 'planes', 32 * k, 32 * k + 32)})" for k in range(4))


@query("enc_llm_embedding", f"""with planes as (select plane, place, cast({s_fnv('[42::uhugeint, cast(plane as uhugeint), cast(place as uhugeint)]')} // 4294967296::uhugeint as double) / 4294967295.0::double * 2.0::double - 1.0::double as w from (select range as plane from range(128)), (select range as place from range(64))),
  {_S_VECTORS}, {_S_BANDS}, own as (select vec_id, xor(xor({s_rotated('w0.state', 0)}, {s_rotated('w1.state', 13)}), xor({s_rotated('w2.state', 26)}, {s_rotated('w3.state', 39)})) as state, (select sqrt(sum(x * x)) from vec where vec.vec_id = w0.vec_id) as length from w0 join w1 using (vec_id) join w2 using (vec_id) join w3 using (vec_id)),
  m as (select *, cast(floor(least(1.0, ln(1.0 + length) / 5.0) * 63 + 0.5) as bigint) as bucket from own) {_s_picked('state', 'm', 1984, 25, 60, 'list_transform(range(16), lambda i: 1984 + (bucket + i) % 64)')}""")
def enc_llm_embedding(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", csv(E.LlmEmbeddingEncoder(magnitude_bits=64).encode(F.col("embedding"))).alias("bits"))


encoded("enc_ip", "customer", ["c_custkey"], lambda: E.IpAddressEncoder().encode(F.concat_ws(".", F.lit("10"), *[(F.col("c_custkey") * k % 256).cast("string") for k in (1, 3, 7)])), s_runs(("10 / 255.0", 32, 8), ("c_custkey % 256 / 255.0", 32, 8), ("c_custkey * 3 % 256 / 255.0", 32, 8), ("c_custkey * 7 % 256 / 255.0", 32, 8)))
_S_GROUPS = ["8193 / 65535.0", "3512 / 65535.0", "c_custkey % 65536 / 65535.0", "0 / 65535.0", "c_custkey * 31 % 65536 / 65535.0", "0 / 65535.0", "0 / 65535.0", "c_custkey * 977 % 65536 / 65535.0"]
encoded("enc_ip6", "customer", ["c_custkey"], lambda: E.IpAddressEncoder(ipv6=True).encode(F.concat(F.lit("2001:db8:"), *[F.concat(F.lower(F.hex(F.col("c_custkey") * k % 65536)), F.lit(end)) for k, end in ((1, ":0:"), (31, "::"), (977, ""))])), s_runs(*[(g, 32, 8) for g in _S_GROUPS]))
encoded("enc_mac", "customer", ["c_custkey"], lambda: E.MacAddressEncoder().encode(F.concat_ws(":", F.lit("00"), F.lit("1B"), *[F.lpad(F.hex(F.col("c_custkey") * k % 256), 2, "0") for k in (1, 3, 7, 11)])), f"list_concat({s_runs(*[(f'{x} / 255.0', 32, 8) for x in ('0', '27', *(f'c_custkey * {k} % 256' for k in (1, 3, 7, 11)))])}, list_sort(list_transform({s_first(s_draws(s_fnv('[0::uhugeint, 27::uhugeint, cast(c_custkey % 256 as uhugeint)]'), 64, 16), 16)}, lambda b: b + 192)))")
_S_RGB = [f"(c_custkey * {k} % 256 / 255.0::double)" for k in (1, 3, 7)]
_S_TOP, _S_LOW = f"greatest({', '.join(_S_RGB)})", f"least({', '.join(_S_RGB)})"
_S_WIDE = f"({_S_TOP} - {_S_LOW})"
_S_HUE = f"(case when {_S_WIDE} = 0 then 0.0 when {_S_TOP} = {_S_RGB[0]} then {s_pmod(f'({_S_RGB[1]} - {_S_RGB[2]}) / {_S_WIDE}', 6.0)} when {_S_TOP} = {_S_RGB[1]} then ({_S_RGB[2]} - {_S_RGB[0]}) / {_S_WIDE} + 2.0 else ({_S_RGB[0]} - {_S_RGB[1]}) / {_S_WIDE} + 4.0 end * 60.0)"
encoded("enc_color", "customer", ["c_custkey"], lambda: E.ColorEncoder().encode_rgb(*[F.col("c_custkey") * k % 256 / F.lit(255.0) for k in (1, 3, 7)]), f"flatten([{s_block(f'cast(round({_S_HUE} / 360.0 * 100.0) as bigint) % 100', 21)}, {s_run(f'(case when {_S_TOP} = 0 then 0.0 else ({_S_TOP} - {_S_LOW}) / {_S_TOP} end)', 50, 10, 120)}, {s_run(_S_TOP, 50, 10, 170)}])")
encoded("enc_color_hsv", "customer", ["c_custkey"], lambda: E.ColorEncoder().encode((F.col("c_custkey") * 11 % 360).cast("double"), F.col("c_custkey") * 3 % 101 / F.lit(100.0), F.col("c_custkey") * 7 % 101 / F.lit(100.0)), f"flatten([{s_block('cast(round(c_custkey * 11 % 360 / 360.0 * 100.0) as bigint) % 100', 21)}, {s_run('c_custkey * 3 % 101 / 100.0', 50, 10, 120)}, {s_run('c_custkey * 7 % 101 / 100.0', 50, 10, 170)}])")
encoded("enc_pitch", "customer", ["c_custkey"], lambda: E.PitchEncoder().encode(signal.frequency_of_midi((F.col("c_custkey") % 100 + 12.25).cast("double"))), f"flatten([{s_block('cast(round((c_custkey % 100 + 12.25) % 12.0 / 12.0 * 100.0) as bigint) % 100', 21)}, {s_run('least(floor((c_custkey % 100 + 12.25) / 12.0) - 1, 8) / 8.0', 72, 8, 120)}])")
_S_DX, _S_DY = "((c_custkey % 17 - 8) / 10.0::double)", "((c_custkey % 13 - 6) / 10.0::double)"
_S_STEEP = f"sqrt({_S_DX} * {_S_DX} + {_S_DY} * {_S_DY})"
_S_TURN = f"(({s_pmod(f'atan2({_S_DY}, {_S_DX})', math.pi)}) / {math.pi!r}::double * 8.0)"
encoded("enc_edge", "customer", ["c_custkey"], lambda: E.EdgeOrientationEncoder().encode_gradient((F.col("c_custkey") % 17 - 8) / F.lit(10.0), (F.col("c_custkey") % 13 - 6) / F.lit(10.0)), f"case when {_S_STEEP} < 0.01 then [] else list_concat({s_block(f'cast(round(({_S_TURN} - floor({_S_TURN})) * 15.0) as bigint) + cast(floor({_S_TURN}) % 8 as bigint) * 20', 5)}, {s_run(s_share(_S_STEEP, 0.01, 1.0), 40, 10, 160)}) end")


@query("enc_accelerometer", f"""with v as (select c_custkey, c_custkey % 17 / 4.0 - 2 as x, c_custkey % 13 / 4.0 - 1.5 as y, c_custkey % 11 / 4.0 - 1 as z from customer), m as (select *, sqrt(x * x + y * y + z * z) as m from v)
  select c_custkey, {s_csv(s_runs((s_share('x', -4.0, 4.0), 32, 8), (s_share('y', -4.0, 4.0), 32, 8), (s_share('z', -4.0, 4.0), 32, 8), (s_share('m', 0.0, 4.0), 32, 8), (s_share('case when m = 0 then 0.0 else asin(y / m) end', -math.pi / 2, math.pi / 2), 32, 8), (s_share('atan2(x, z)', -math.pi, math.pi), 32, 8)))} as bits, abs(m - 1) > 0.5 as motion from m""")
def enc_accelerometer(spark, sf):
    x, y, z = F.col("c_custkey") % 17 / F.lit(4.0) - 2, F.col("c_custkey") % 13 / F.lit(4.0) - 1.5, F.col("c_custkey") % 11 / F.lit(4.0) - 1
    return t(spark, sf, "customer").select("c_custkey", csv(E.AccelerometerEncoder().encode(x, y, z)).alias("bits"), signal.is_motion(x, y, z, 0.5).alias("motion"))


_S_LOGPRICE = f"(ln({s_clamp('l_extendedprice', 0.01, 200000.0)}) - ({math.log(0.01)!r})) / {math.log(200000.0) - math.log(0.01)!r}"


@query("enc_price", f"""with p as (select l_orderkey, l_linenumber, l_extendedprice, l_discount * 100 - 5 as change from lineitem)
  select l_orderkey, l_linenumber, {s_csv(s_runs((_S_LOGPRICE, 100, 21), (s_share('change', -10.0, 10.0), 50, 10)))} as bits from p""")
def enc_price(spark, sf):
    e = E.PriceEncoder(maximum=200_000.0)
    return t(spark, sf, "lineitem").select(*LINE, csv(e.encode(F.col("l_extendedprice"), F.col("l_discount") * 100 - 5)).alias("bits"))


@query("enc_currency_pair", f"""with recursive pairs as (select n_nationkey, rpad(substr(regexp_replace(upper(n_name), '[^A-Z]', '', 'g'), 1, 3), 3, 'X') as base, n_nationkey + 0.5 as rate from nation),
  states as (select base as code, {s_fnv(s_bytes("base"))} as h from (select distinct base from pairs union select 'USD')),
  {s_finalised("states", "code", 64, 16)}
  select n_nationkey, {s_csv(f"flatten([list_sort(b.bits), list_transform(list_sort(q.bits), lambda x: x + 64), {s_run(f'(ln(rate) - ({math.log(1e-4)!r})) / {math.log(1e4) - math.log(1e-4)!r}', 100, 21, 128)}])")} as bits
  from pairs join picked b on b.code = base join picked q on q.code = 'USD'""")
def enc_currency_pair(spark, sf):
    code = F.rpad(F.substring(F.regexp_replace(F.upper("n_name"), "[^A-Z]", ""), 1, 3), 3, "X")
    return t(spark, sf, "nation").select("n_nationkey", csv(E.CurrencyPairEncoder().encode(F.concat(code, F.lit("/USD")), F.col("n_nationkey") + F.lit(0.5))).alias("bits"))


@query("enc_order_book", f"""with v as (select s_suppkey, [s_suppkey % 7 * 100000.0, s_suppkey % 5 * 200000.0] as b, [s_suppkey % 11 * 90000.0, s_suppkey % 3 * 300000.0] as a, 100.0 as bid, 100.0 + s_suppkey % 9 * 0.5 as ask from supplier),
  m as (select *, list_sum(b) as tb, list_sum(a) as ta from v)
  select s_suppkey, round(coalesce((tb - ta) / nullif(tb + ta, 0), 0.0), 6) as imbalance, {s_csv("flatten([" + ", ".join([s_run("least(b[1] / 1000000.0, 1.0)", 20, 4, 0), s_run("least(b[2] / 1000000.0, 1.0)", 20, 4, 20), s_run("least(a[1] / 1000000.0, 1.0)", 20, 4, 100), s_run("least(a[2] / 1000000.0, 1.0)", 20, 4, 120), s_run(s_clamp("(ask - bid) / ((ask + bid) / 2.0) * 100.0 / 5.0", 0.0, 1.0), 30, 6, 200), s_run("(coalesce((tb - ta) / nullif(tb + ta, 0), 0.0) + 1.0) / 2.0", 30, 6, 230)]) + "])")} as bits from m""")
def enc_order_book(spark, sf):
    k = F.col("s_suppkey")

    def side(first: Column, step: Column, volumes: list[tuple[int, float]]) -> Column:
        return F.array(*[F.struct((first + step * n).alias("price"), (k % m * F.lit(v)).alias("volume")) for n, (m, v) in enumerate(volumes)])

    s = t(spark, sf, "supplier").select(k, side(F.lit(100.0), F.lit(-0.5), [(7, 1e5), (5, 2e5)]).alias("bids"), side(100.0 + k % 9 * F.lit(0.5), F.lit(0.5), [(11, 9e4), (3, 3e5)]).alias("asks"))
    return s.select("s_suppkey", r6(finance.book_metrics(F.col("bids"), F.col("asks"))["imbalance"]).alias("imbalance"), csv(E.OrderBookEncoder().encode(F.col("bids"), F.col("asks"))).alias("bits"))


_S_HIST = """with h as (select o_custkey, list_transform(range(5), lambda k: cast(len(list_filter(list(o_orderpriority), lambda p: p[1] = cast(k + 1 as varchar))) as double) / count(*)) as p from orders group by o_custkey)"""


@query("enc_distribution", f"""{_S_HIST} select o_custkey, round(list_sum(list_transform(p, lambda x: case when x > 0 then -x * ln(x) else 0 end)), 6) + 0.0 as entropy,
  array_to_string(flatten(list_transform(range(5), lambda k: case when p[k + 1] >= 0.01 then list_transform(range(cast(greatest(least(round(p[k + 1] / list_max(p) * 10.0), 10), 1) as bigint)), lambda i: i + k * 10 + (10 - cast(greatest(least(round(p[k + 1] / list_max(p) * 10.0), 10), 1) as bigint)) // 2) else [] end)), ',') as bits from h""")
def enc_distribution(spark, sf):
    counts = [F.count_if(F.substring("o_orderpriority", 1, 1) == str(k + 1)) / F.count("*") for k in range(5)]
    h = t(spark, sf, "orders").groupBy("o_custkey").agg(F.array(*counts).alias("p"))
    return h.select("o_custkey", r6(probability.entropy(F.col("p"))).alias("entropy"), csv(E.DistributionEncoder(5).encode(F.col("p"))).alias("bits"))


_S_CI = s_runs((s_share("(lo + hi) / 2.0", 0.0, 100.0), 100, 21), (s_clamp("(hi - lo) / 50.0", 0.0, 1.0), 50, 10))


@query("enc_confidence_interval", f"select l_orderkey, l_linenumber, {s_csv(_S_CI)} as bits from (select l_orderkey, l_linenumber, l_quantity - l_tax * 100 as lo, l_quantity + l_discount * 100 as hi from lineitem)")
def enc_confidence_interval(spark, sf):
    lo, hi = F.col("l_quantity") - F.col("l_tax") * 100, F.col("l_quantity") + F.col("l_discount") * 100
    return t(spark, sf, "lineitem").select(*LINE, csv(E.ConfidenceIntervalEncoder().encode(lo, hi)).alias("bits"))


@query("enc_multi", f"""select event_id, {s_csv(f"list_concat({s_scalar('value', 0.0, 500.0, 400, 21)}, {s_block(s_index(EVENT_TYPES, 'event_type') + ' * 11 + 400', 11)})")} as bits from events""")
def enc_multi(spark, sf):
    e = E.MultiEncoder([("value", VALUE), ("type", E.CategoryEncoder(EVENT_TYPES, 11))])
    return t(spark, sf, "events").select("event_id", csv(e.encode(F.col("value"), F.col("event_type"))).alias("bits"))


_S_CLAMPED = s_clamp("value", 0.0, 1000.0)


@query("enc_multi_one", f"""select event_id, {s_csv(f"flatten([{s_scalar('value', 0.0, 500.0, 400, 21)}, {s_block(f'cast(floor(least(({_S_CLAMPED}) / 1000.0 * 190.0, 189)) as bigint) + 400', 11)}])")} as bits from events""")
def enc_multi_one(spark, sf):
    """One value for two encoders of different resolution."""
    e = E.MultiEncoder([("fine", VALUE), ("coarse", E.ScalarEncoder(0.0, 1000.0, 200, 11))])
    return t(spark, sf, "events").select("event_id", csv(e.encode(F.col("value"))).alias("bits"))


# ---- signals: windows of 10 events of a user --------------------------------------------------------------------------------

_S_WINDOWS = """w as (select user_id, rn // 10 as win, list(value order by rn) as s from (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as rn from events) group by user_id, rn // 10 having count(*) = 10)"""


def user_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.count_windows(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 10).withColumnRenamed("window", "win")


@query("enc_waveform", f"with {_S_WINDOWS} select user_id, win, array_to_string(flatten(list_transform(range(10), lambda k: list_transform(range(4), lambda i: i + k * 16 + cast(round({s_share('s[k + 1]', 0.0, 500.0)} * 12.0) as bigint)))), ',') as bits from w")
def enc_waveform(spark, sf):
    return user_windows(spark, sf).select("user_id", "win", csv(E.WaveformEncoder(10, minimum=0.0, maximum=500.0).encode(F.col("samples"))).alias("bits"))


@query("enc_spectrogram", f"with {_S_WINDOWS} select user_id, win, array_to_string(flatten(list_transform(range(10), lambda k: case when s[k + 1] > 5.0 then list_transform(range(5), lambda i: i + k * 20 + cast(round({s_share('s[k + 1]', 5.0, 500.0)} * 15.0) as bigint)) else [] end)), ',') as bits from w")
def enc_spectrogram(spark, sf):
    return user_windows(spark, sf).select("user_id", "win", csv(E.SpectrogramEncoder(10, minimum=5.0, maximum=500.0, log_scale=False).encode(F.col("samples"))).alias("bits"))


@query("enc_spectrogram_log", f"with {_S_WINDOWS} select user_id, win, array_to_string(flatten(list_transform(range(10), lambda k: case when s[k + 1] > 5.0 then list_transform(range(5), lambda i: i + k * 20 + cast(round(ln(least(s[k + 1], 500.0) / 5.0) / {math.log(100.0)!r} * 15.0) as bigint)) else [] end)), ',') as bits from w")
def enc_spectrogram_log(spark, sf):
    return user_windows(spark, sf).select("user_id", "win", csv(E.SpectrogramEncoder(10, minimum=5.0, maximum=500.0).encode(F.col("samples"))).alias("bits"))


_S_FEATURES = """f as (select user_id, win, s, list_max(s) as mx, list_min(s) as mn, list_avg(s) as av, list_stddev_pop(s) as sd,
  list_transform(range(9), lambda k: s[k + 2] - s[k + 1]) as d, list_sum(list_transform(s, lambda x: x * x)) / 10 as en from w)"""


@query("window_features", f"with {_S_WINDOWS}, {_S_FEATURES} select user_id, win, round(mx, 6) as max, round(mn, 6) as min, round(mx - mn, 6) as p2p, round(av, 6) as mean, round(sd, 6) as std, round(greatest(list_max(d), 0), 6) as max_derivative, round(least(list_min(d), 0), 6) + 0.0 as min_derivative, round(en, 6) as energy from f")
def window_features(spark, sf):
    f = user_windows(spark, sf).select("user_id", "win", windows.features(F.col("samples")).alias("f"))
    return f.select("user_id", "win", *[r6(F.col(f"f.{k}")).alias(k) for k in ("max", "min", "p2p", "mean", "std", "max_derivative", "min_derivative", "energy")])


@query("hrv_metrics", f"""with {_S_WINDOWS}, m as (select user_id, win, list_avg(s) as mean_rr, list_stddev_samp(s) as sdnn, list_transform(range(9), lambda k: s[k + 2] - s[k + 1]) as d from w)
  select user_id, win, round(mean_rr, 6) as mean_rr, round(sdnn, 6) as sdnn, round(sqrt(list_sum(list_transform(d, lambda x: x * x)) / 9), 6) as rmssd, round(len(list_filter(d, lambda x: abs(x) > 50)) / 9 * 100, 6) as pnn50 from m""")
def hrv_metrics(spark, sf):
    m = user_windows(spark, sf).select("user_id", "win", signal.hrv_metrics(F.col("samples")).alias("m"))
    return m.select("user_id", "win", *[r6(F.col(f"m.{k}")).alias(k) for k in ("mean_rr", "sdnn", "rmssd", "pnn50")])


@query("enc_hrv", f"""with {_S_WINDOWS}, m as (select user_id, win, list_avg(s) * 20 as mean_rr, list_stddev_samp(s) * 20 as sdnn, list_transform(range(9), lambda k: (s[k + 2] - s[k + 1]) * 20) as d from w)
  select user_id, win, {s_csv(s_runs((s_share('mean_rr', 400.0, 1500.0), 50, 10), (s_share('sdnn', 10.0, 200.0), 40, 8), (s_share('sqrt(list_sum(list_transform(d, lambda x: x * x)) / 9)', 10.0, 150.0), 40, 8), (s_share('len(list_filter(d, lambda x: abs(x) > 50)) / 9 * 100.0', 0.0, 100.0), 30, 6)))} as bits from m""")
def enc_hrv(spark, sf):
    return user_windows(spark, sf).select("user_id", "win", csv(E.HrvEncoder().encode(signal.hrv_metrics(F.col("samples"), 20.0))).alias("bits"))


_S_ECG = [s_run(f"({s_clamp(f'u[{k + 1}]', -250.0, 250.0)} + 250.0) / 500.0", 10, 3, 10 * k) for k in range(10)]
_S_ECG += [s_run(f"({s_clamp(f'list_{f}(u)', -250.0, 250.0)} + 250.0) / 500.0", 12, 3, 100 + 12 * k) for k, f in enumerate(("max", "min", "avg"))]
_S_ECG += [s_run("least(list_stddev_pop(u) / 500.0, 1.0)", 12, 3, 136), s_run("len(list_filter(range(1, 10), lambda k: (u[k] >= 0) <> (u[k + 1] >= 0))) / 10.0", 12, 3, 148)]


@query("enc_ecg", f"with {_S_WINDOWS}, v as (select user_id, win, list_transform(s, lambda x: x - 100.0) as u from w) select user_id, win, {s_csv('flatten([' + ', '.join(_S_ECG) + '])')} as bits from v")
def enc_ecg(spark, sf):
    e = E.EcgEncoder(10, minimum=-250.0, maximum=250.0)
    return user_windows(spark, sf).select("user_id", "win", csv(e.encode(F.transform("samples", lambda x: x - 100.0))).alias("bits"))


def scored_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = user_windows(spark, sf)
    bits = E.WaveformEncoder(10, minimum=0.0, maximum=500.0).encode(F.col("samples"))
    return w.select("user_id", "win", bits.alias("bits"), windows.features(F.col("samples")).alias("f"))


_S_DISTANCE = "2.0 * abs({a}.p2p - {b}.p2p) + 3.0 * abs({a}.sd - {b}.sd) + 4.0 * abs({a}.up - {b}.up) + 4.0 * abs({a}.down - {b}.down) + 2.0 * abs({a}.en - {b}.en) + 0.5 * abs({a}.zc - {b}.zc) + 1.5 * abs({a}.mx - {b}.mx)"
_S_SCORED = f"""{_S_WINDOWS}, {_S_FEATURES}, q as (select user_id, win, mx - mn as p2p, sd, greatest(list_max(d), 0) as up, least(list_min(d), 0) as down, en, mx, len(list_filter(range(1, 10), lambda k: (s[k] >= 0) <> (s[k + 1] >= 0))) as zc,
  flatten(list_transform(range(10), lambda k: list_transform(range(4), lambda i: i + k * 16 + cast(round({s_share('s[k + 1]', 0.0, 500.0)} * 12.0) as bigint)))) as bits from f),
  base as (select *, row_number() over (order by user_id) as n from q where win = 0)"""


@query("hybrid_score", f"""with {_S_SCORED}, st as (select avg({_S_DISTANCE.format(a='i', b='j')}) as m, stddev_pop({_S_DISTANCE.format(a='i', b='j')}) as s from base i join base j on i.n < j.n),
  best as (select q.user_id, q.win, max(len(list_intersect(q.bits, b.bits))) as o, min({_S_DISTANCE.format(a='q', b='b')}) as d from q, base b group by all), z as (select *, case when s > 0 then (d - m) / s else 0 end as z from best, st)
  select user_id, win, cast(o as bigint) as overlap, round(d, 6) as distance, round(0.3::double * greatest(0, 1 - o / 40.0::double) + 0.7::double * greatest(0, z / (1 + abs(z))), 6) as score from z""")
def hybrid_score(spark, sf):
    w = staged(scored_windows(spark, sf), "windows")  # read by every step of the search
    base = w.where("win = 0")
    out = windows.hybrid_score(w, base, ["user_id", "win"], *windows.distance_statistics(base), 40.0)
    return out.select("user_id", "win", F.col("overlap").cast("long").alias("overlap"), r6(F.col("distance")).alias("distance"), r6(F.col("score")).alias("score"))


@query("baseline_overlap", f"""with {_S_WINDOWS}, b as (select user_id, flatten(list_transform(range(10), lambda k: list_transform(range(4), lambda i: i + k * 16 + cast(round({s_share('s[k + 1]', 0.0, 500.0)} * 12.0) as bigint)))) as bits from w where win = 0),
  c as (select bits, row_number() over (order by user_id) - 1 as n, greatest(count(*) over () // 50, 1) as step from b)
  select round(avg(o), 6) as overlap_mean, round(stddev_pop(o), 6) as overlap_std from (select len(list_intersect(i.bits, j.bits)) as o from c i join c j on i.n < j.n and i.n % i.step = 0 and j.n % j.step = 1 % j.step)""")
def baseline_overlap(spark, sf):
    base = windows.numbered(scored_windows(spark, sf).where("win = 0"), "user_id")
    return windows.baseline_statistics(base).select(r6(F.col("overlap_mean")).alias("overlap_mean"), r6(F.col("overlap_std")).alias("overlap_std"))


@query("percentile_threshold", "select round(value + 0.1, 6) as threshold from (select value, row_number() over (order by value) - 1 as rn, count(*) over () as n from events) where rn = least(cast(floor(n * 0.99) as bigint), n - 1)")
def percentile_threshold(spark, sf):
    return windows.percentile(t(spark, sf, "events"), "value", 0.99).select(r6(F.col("value") + 0.1).alias("threshold"))


@query("heat_map", f"with b as (select date_trunc('day', ts) as day, unnest({_S_VALUE}) as bit from events) select day, cast(floor(bit * 32 / 400) as integer) as band, cast(count(*) as bigint) as n from b group by all")
def heat_map(spark, sf):
    e = t(spark, sf, "events").select(F.date_trunc("day", "ts").alias("day"), VALUE.encode(F.col("value")).alias("bits"))
    return windows.heat_map(e, "day", "bits", 400, 32)


@query("scatter_columns", f"select event_id, {s_csv(f'list_sort(list_distinct(list_transform({_S_VALUE}, lambda b: xor((b * 2654435761) & 4294967295, b >> 16) % 1024)))')} as columns_ from events")
def scatter_columns(spark, sf):
    return t(spark, sf, "events").select("event_id", csv(windows.scatter_columns(VALUE.encode(F.col("value")))).alias("columns_"))


@query("fingerprint")
def fingerprint(spark, sf):
    w = windows.fingerprint_points(user_windows(spark, sf), ["user_id"], "samples", 64)
    return windows.fingerprint(w, ["user_id"], "points").select("user_id", "x", "y", r6(F.col("v")).alias("v"))


@query("fingerprint_differences")
def fingerprint_differences(spark, sf):
    """The map of the users with an even number less that of the others."""
    w = windows.fingerprint_points(user_windows(spark, sf), ["user_id"], "samples", 64)
    maps = [windows.fingerprint(w.where(F.col("user_id") % 2 == k), [], "points") for k in range(2)]
    return windows.fingerprint_difference(*maps).select("x", "y", r6(F.col("d")).alias("d"))


# ---- the synapse graph, pooling, classification: a synapse table by arithmetic ---------------------------------------------

N_COLUMNS, N_INPUTS, POOL = 256, 400, 40
_S_SYN = f"syn as (select c as segment, (c * 31 + i * 17) % {N_INPUTS} as presyn, ((c * 7 + i * 13) % 100) / 100.0 as perm from range({N_COLUMNS}) t(c), range({POOL}) u(i))"
_S_BITS = f"a as (select event_id, unnest({_S_VALUE}) as presyn from events)"
POOLER = spatial_pooler.PoolerParams(inputs=(N_INPUTS,), columns=(N_COLUMNS,), connected=0.5, density=0.04)


def synapse_table(spark: SparkSession) -> DataFrame:
    c, i = F.col("c"), F.col("i")
    rows = spark.range(N_COLUMNS).select(F.col("id").cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(POOL - 1))).alias("i"))
    return rows.select(c.alias("segment"), ((c * 31 + i * 17) % N_INPUTS).alias("presyn"), ((c * 7 + i * 13) % 100 / F.lit(100.0)).alias("perm"))


def event_bits(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select("event_id", VALUE.encode(F.col("value")).alias("bits"))


@query("conn_activity", f"with {_S_SYN}, {_S_BITS} select event_id, cast(segment as integer) as segment, cast(count(*) filter (perm >= 0.5) as bigint) as connected, cast(count(*) as bigint) as potential from a join syn using (presyn) group by event_id, segment")
def conn_activity(spark, sf):
    return connections.activity(event_bits(spark, sf), synapse_table(spark), ["event_id"], "bits", 0.5)


@query("conn_active_segments", f"with {_S_SYN}, {_S_BITS}, m as (select event_id, segment, count(*) filter (perm >= 0.5) as connected, count(*) as potential from a join syn using (presyn) group by event_id, segment) select cast(segment as integer) as segment, cast(count(*) as bigint) as rows, cast(sum(connected) as bigint) as connected, cast(sum(potential) as bigint) as potential from m where connected >= 3 group by segment")
def conn_active_segments(spark, sf):
    return connections.activity_sums(event_bits(spark, sf), synapse_table(spark), ["event_id"], "bits", 0.5, 3)


@query("conn_adapt", f"with {_S_SYN} select cast(segment as integer) as segment, cast(presyn as integer) as presyn, round(greatest(least(max(perm) + case when segment % 3 <> 0 then 0 when presyn % 5 = 0 then 0.1 else -0.05 end, 1), 0), 6) as perm from syn group by segment, presyn")
def conn_adapt(spark, sf):
    own = connections.create_synapses(synapse_table(spark).limit(0), synapse_table(spark))
    active = spark.range(N_INPUTS).where("id % 5 = 0").select(F.col("id").cast("int").alias("presyn"))
    segments = spark.range(N_COLUMNS).where("id % 3 = 0").select(F.col("id").cast("int").alias("segment"))
    return connections.adapt(own, active, segments, 0.1, 0.05).select("segment", "presyn", r6(F.col("perm")).alias("perm"))


@query("conn_competition", f"with {_S_SYN}, u as (select segment, presyn, max(perm) as perm from syn group by segment, presyn), r as (select *, row_number() over (partition by segment order by perm desc, presyn) as rn from u) select cast(segment as integer) as segment, cast(presyn as integer) as presyn, round(case when rn <= 5 then greatest(perm, 0.5) when rn > 15 then least(perm, 0.499) else perm end, 6) as perm from r")
def conn_competition(spark, sf):
    own = connections.create_synapses(synapse_table(spark).limit(0), synapse_table(spark))
    return connections.compete(own, 0.5, 5, 15).select("segment", "presyn", r6(F.col("perm")).alias("perm"))


_S_UNIQUE = f"with {_S_SYN}, {_S_BITS}, n as (select presyn, count(*) as n from a group by presyn), often as (select presyn from n where n >= (select avg(n) from n))"


def synapses_out(df: DataFrame) -> DataFrame:
    return df.select("segment", "presyn", r6(F.col("perm")).alias("perm"))


def frequent_bits(spark: SparkSession, sf: str) -> DataFrame:
    """(presyn): the bits that events have at least as often as the mean bit."""
    n = event_bits(spark, sf).select(F.explode("bits").alias("presyn")).groupBy("presyn").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.avg("n").alias("mean")))).where("n >= mean").select("presyn")


@query("conn_adapt_series", f"""{_S_UNIQUE}, d as (select segment, presyn, perm, ((segment + presyn) % 3 - 1) * 0.05::double as change, case when presyn in (select presyn from often) then 0.1::double else -0.05::double end as step from syn),
  m as (select segment, presyn, case when sign(step) = sign(change) then 0::double else step end as step, perm, change from d)
  select cast(segment as integer) as segment, cast(presyn as integer) as presyn, round(case when segment % 3 = 0 then greatest(least(perm + step, 1), 0) else perm end, 6) as perm, round(case when segment % 3 = 0 then step else change end, 6) + 0.0 as change
  from m where case when segment % 3 = 0 then greatest(least(perm + step, 1), 0) else perm end > 1e-6""")
def conn_adapt_series(spark, sf):
    own = synapse_table(spark).withColumn("change", ((F.col("segment") + F.col("presyn")) % 3 - 1) * 0.05)
    out = connections.adapt(own, frequent_bits(spark, sf), own.where("segment % 3 = 0"), 0.1, 0.05, prune=True, series=True)
    return out.select("segment", "presyn", r6(F.col("perm")).alias("perm"), r6(F.col("change")).alias("change"))


@query("conn_grow", f"""{_S_UNIQUE}, w as (select segment, presyn from (select range as segment, presyn from range({N_COLUMNS}), often) anti join syn using (segment, presyn)), more as (select segment, count(*) as k from w group by segment),
  r as (select *, row_number() over (partition by segment order by perm desc, presyn) as rn from syn), kept as (select segment, presyn, perm from r left join more using (segment) where k is null or rn <= (select count(*) from often) - k)
  select cast(segment as integer) as segment, cast(presyn as integer) as presyn, round(perm, 6) as perm from (select * from kept union all select segment, presyn, 0.21::double from w)""")
def conn_grow(spark, sf):
    """Every segment takes all frequent bits that it lacks; of its old synapses the strongest stay, as many as there is room for."""
    often = frequent_bits(spark, sf)
    n = often.count()
    wanted = spark.range(N_COLUMNS).select(F.col("id").cast("int").alias("segment")).join(F.broadcast(often)).withColumn("n", F.lit(n))
    return synapses_out(connections.grow(synapse_table(spark), wanted, 0.21, most=n))


@query("conn_bump", f"with {_S_SYN} select cast(segment as integer) as segment, cast(presyn as integer) as presyn, round(greatest(least(perm + case when segment % 4 = 1 then 0.3 else 0 end, 1), 0), 6) as perm from syn")
def conn_bump(spark, sf):
    own = synapse_table(spark)
    return synapses_out(connections.bump(own, own.where("segment % 4 = 1"), 0.3))


@query("conn_raise", f"with {_S_SYN}, r as (select *, row_number() over (partition by segment order by perm desc, presyn) as rn from syn) select cast(segment as integer) as segment, cast(presyn as integer) as presyn, round(case when rn <= 30 then greatest(perm, 0.5) else perm end, 6) as perm from r")
def conn_raise(spark, sf):
    return synapses_out(connections.raise_to_threshold(synapse_table(spark), 0.5, 30))


@query("conn_weakest", f"{_S_UNIQUE}, r as (select syn.*, o.presyn is not null as safe, row_number() over (partition by segment order by o.presyn is not null, perm, syn.presyn) as rn from syn left join often o using (presyn)) select cast(segment as integer) as segment, cast(presyn as integer) as presyn, round(perm, 6) as perm from r where rn > 12 or safe")
def conn_weakest(spark, sf):
    return synapses_out(connections.destroy_weakest(synapse_table(spark), 12, frequent_bits(spark, sf)))


def segment_table(spark: SparkSession) -> DataFrame:
    return spark.range(N_COLUMNS).select(F.col("id").cast("int").alias("segment"), (F.col("id") % 100).cast("int").alias("cell"))


_S_GRAPH = f"{_S_SYN}, seg as (select c as segment, c % 100 as cell from range({N_COLUMNS}) t(c)), few as (select * from syn where perm >= (segment % 5) * 0.1)"


@query("conn_destroy", f"with {_S_GRAPH} select cast(cell as integer) as cell, cast(segment as integer) as segment, cast(count(presyn) as bigint) as synapses from seg left join (select * from few where presyn % 6 <> 0) s using (segment) where segment not in (select segment from few group by segment having count(*) < 27) group by cell, segment")
def conn_destroy(spark, sf):
    segments, few = segment_table(spark), synapse_table(spark).where("perm >= (segment % 5) * 0.1")
    gone = connections.weak_segments(segments, few, 27)
    segments, few = connections.destroy_segments(segments, few, gone)
    few = connections.destroy_synapses(few, few.where("presyn % 6 = 0").select("segment", "presyn"))
    return segments.join(few, "segment", "left").groupBy("cell", "segment").agg(F.count("presyn").alias("synapses"))


@query("conn_create_segments", f"""with {_S_GRAPH}, sizes as (select segment, cell, count(presyn) as n from seg left join few using (segment) group by all), new as (select range * 5 as cell from range(24)),
  r as (select *, count(*) over (partition by cell) as have, row_number() over (partition by cell order by n, segment) as rn from sizes), kept as (select * from r where cell not in (select cell from new) or rn > have - 2),
  every as (select cell, segment, n from kept union all select cell, 1000, 0 from new)
  select cast(cell as integer) as cell, cast(count(*) as bigint) as segments, cast(sum(n) as bigint) as synapses, string_agg(case when segment < 1000 then segment end, ',' order by segment) as old from every group by cell""")
def conn_create_segments(spark, sf):
    cells = spark.range(24).select((F.col("id") * 5).cast("int").alias("cell"))
    segments, few = connections.create_segments(segment_table(spark), synapse_table(spark).where("perm >= (segment % 5) * 0.1"), cells, 3)
    n = segments.join(few.groupBy("segment").agg(F.count("*").alias("n")), "segment", "left")
    old = F.array_sort(F.collect_list(F.when(F.col("segment") < N_COLUMNS, F.col("segment"))))
    return n.groupBy("cell").agg(F.count("*").alias("segments"), F.sum(F.coalesce("n", F.lit(0))).alias("synapses"), F.when(F.size(old) > 0, csv(old)).alias("old"))


@query("conn_compare", f"with {_S_GRAPH} select cast(cell as integer) as cell, cast(segment as integer) as segment, cast(row_number() over (partition by cell order by segment) - 1 as integer) as place from seg")
def conn_compare(spark, sf):
    return connections.compare(segment_table(spark)).select("cell", "segment", "place")


_S_OV = f"with {_S_SYN}, {_S_BITS}, o as (select event_id, segment as col, count(*) as overlap from a join syn using (presyn) where perm >= 0.5 group by event_id, segment)"


@query("sp_overlaps", f'{_S_OV} select event_id, cast(col as integer) as "column", cast(overlap as bigint) as overlap from o')
def sp_overlaps(spark, sf):
    return spatial_pooler.overlaps(event_bits(spark, sf), synapse_table(spark), ["event_id"], "bits", POOLER)


@query("sp_inhibit_global", f"""{_S_OV}, every as (select event_id, col, coalesce(overlap, 0) as overlap from (select event_id, c as col from events cross join range({N_COLUMNS}) t(c)) left join o using (event_id, col)),
  r as (select event_id, col, row_number() over (partition by event_id order by overlap desc, col) as rn from every) select event_id, string_agg(col, ',' order by col) as active from r where rn <= 10 group by event_id""")
def sp_inhibit_global(spark, sf):
    return spatial_pooler.pool(event_bits(spark, sf), synapse_table(spark), ["event_id"], "bits", POOLER).select("event_id", csv(F.col("active")).alias("active"))


@query("sp_inhibit_local", f"""{_S_OV}, n as (select c as col, x as nbr from range({N_COLUMNS}) t(c), range({N_COLUMNS}) u(x) where abs(c - x) <= 8 and c <> x), area as (select col, count(*) as area from n group by col),
  g as (select o.event_id, o.col, area, count(*) filter (p.overlap > o.overlap) as stronger from o join n using (col) join area using (col) left join o p on p.event_id = o.event_id and p.col = n.nbr group by o.event_id, o.col, area)
  select event_id, cast(col as integer) as "column" from g where stronger < ceil((area + 1) * 0.04)""")
def sp_inhibit_local(spark, sf):
    p = replace(POOLER, global_inhibition=False, inhibition_radius=8, wrap=False)
    return spatial_pooler.pool(event_bits(spark, sf), synapse_table(spark), ["event_id"], "bits", p).select("event_id", F.explode("active").alias("column"))


# ---- one step of pooler learning; one tick of a temporal memory -----------------------------------------------------------

_S_WON = f"""every as (select event_id, col, coalesce(overlap, 0) as overlap from (select event_id, c as col from events cross join range({N_COLUMNS}) t(c)) left join o using (event_id, col)),
  r as (select event_id, col, row_number() over (partition by event_id order by overlap desc, col) as rn from every), won as (select event_id, col from r where rn <= 10)"""


@query("sp_inhibit_boosted", f"""{_S_OV}, every as (select event_id, col, coalesce(overlap, 0) * exp(2.0 * (0.04 - (col % 10) / 100.0)) as boosted from (select event_id, c as col from events cross join range({N_COLUMNS}) t(c)) left join o using (event_id, col)),
  r as (select event_id, col, row_number() over (partition by event_id order by boosted desc, col) as rn from every) select event_id, string_agg(col, ',' order by col) as active from r where rn <= 10 group by event_id""")
def sp_inhibit_boosted(spark, sf):
    columns = spark.range(N_COLUMNS).select(F.col("id").cast("int").alias("column"))
    boosts = columns.withColumn("boost", spatial_pooler.boost_factors(F.col("column") % 10 / F.lit(100.0), F.lit(0.04), 2.0))
    return spatial_pooler.pool(event_bits(spark, sf), synapse_table(spark), ["event_id"], "bits", POOLER, boosts).select("event_id", csv(F.col("active")).alias("active"))


@query("sp_duty_cycles", f"""{_S_OV}, {_S_WON}, b as (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as back from events),
  d as (select user_id, col, sum(pow(0.99, back) / 100) as duty from won join b using (event_id) group by user_id, col)
  select user_id, cast(col as integer) as "column", round(duty, 6) as duty, round(exp(2.0 * (0.04 - duty)), 6) as boost from d""")
def sp_duty_cycles(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", VALUE.encode(F.col("value")).alias("bits"))
    won = spatial_pooler.pool(e, synapse_table(spark), ["user_id", "ts", "event_id"], "bits", POOLER)
    duty = spatial_pooler.duty_cycles(won, ["user_id"], ["ts", "event_id"], "active", 100)
    return duty.select("user_id", "column", r6(F.col("duty")).alias("duty"), r6(spatial_pooler.boost_factors(F.col("duty"), F.lit(0.04), 2.0)).alias("boost"))


_S_OVERLAP_DUTY = f"{_S_OV}, d as (select c as col, (select count(*) from o where o.col = c) / (select count(*) from events) as duty from range({N_COLUMNS}) t(c))"


def overlap_duty(spark: SparkSession, sf: str) -> DataFrame:
    """(column, overlap_duty): the share of events that a column overlaps."""
    e = event_bits(spark, sf)
    n = spatial_pooler.overlaps(e, synapse_table(spark), ["event_id"], "bits", POOLER).groupBy("column").agg(F.count("*").alias("n"))
    every = spark.range(N_COLUMNS).select(F.col("id").cast("int").alias("column"))
    return every.join(n, "column", "left").select("column", (F.coalesce("n", F.lit(0)) / F.lit(e.count())).alias("overlap_duty"))


@query("sp_minimum_duty", f"{_S_OVERLAP_DUTY} select cast(a.col as integer) as \"column\", round(any_value(a.duty), 6) as overlap_duty, round(0.9 * max(b.duty), 6) as min_duty from d a join d b on abs(a.col - b.col) <= 8 group by a.col")
def sp_minimum_duty(spark, sf):
    p = replace(POOLER, min_share_overlap=0.9, global_inhibition=False, inhibition_radius=8, wrap=False)
    return spatial_pooler.minimum_duty(overlap_duty(spark, sf), p).select("column", *[r6(F.col(c)).alias(c) for c in ("overlap_duty", "min_duty")])


@query("sp_bump_weak", f"{_S_OVERLAP_DUTY}, weak as (select col as segment from d where duty < 0.9 * (select max(duty) from d)) select cast(segment as integer) as segment, cast(presyn as integer) as presyn, round(least(perm + case when segment in (select segment from weak) then 0.05 else 0 end, 1), 6) as perm from syn")
def sp_bump_weak(spark, sf):
    p = replace(POOLER, min_share_overlap=0.9)
    return synapses_out(spatial_pooler.bump_weak(synapse_table(spark), spatial_pooler.minimum_duty(overlap_duty(spark, sf), p), p))


@query("sp_adapt", f"{_S_UNIQUE} select cast(segment as integer) as segment, cast(presyn as integer) as presyn, round(case when segment % 3 <> 0 then perm else greatest(least(perm + case when presyn in (select presyn from often) then 0.05 else -0.008 end, 1), 0) end, 6) as perm from syn")
def sp_adapt(spark, sf):
    columns = spark.range(N_COLUMNS).where("id % 3 = 0").select(F.col("id").cast("int").alias("column"))
    return synapses_out(spatial_pooler.adapt_columns(synapse_table(spark), frequent_bits(spark, sf), columns, POOLER))


@query("sp_radius", f"with {_S_SYN}, s as (select segment, max(presyn) - min(presyn) + 1 as span from syn where perm >= 0.5 group by segment) select cast(greatest(1, floor((sum(span) / {N_COLUMNS} * {N_COLUMNS} / {N_INPUTS} - 1) / 2 + 0.5)) as integer) as radius from s")
def sp_radius(spark, sf):
    return spatial_pooler.inhibition_radius(synapse_table(spark), POOLER)


TICK = temporal_memory.MemoryParams(columns=(64,), cells_per_column=4, activation=3, min_threshold=3, max_new=6)
_S_TICK = f"""with seg as (select s as segment, (s * 37) % 256 as cell from range(160) t(s)), tsy as (select s as segment, (s * 31 + i * 17) % 256 as presyn, ((s * 7 + i * 13) % 100) / 100.0 as perm from range(160) t(s), range(24) u(i)),
  rec as (select event_id, list_transform({_S_VALUE}, lambda b: b * 7 % 256) as before, list_distinct(list_transform({_S_VALUE}, lambda b: b * 5 % 64)) as cols from events),
  b as (select event_id, unnest(before) as presyn from rec), ec as (select event_id, unnest(cols) as col from rec),
  act as (select event_id, segment, cell, cell // 4 as col, count(*) filter (perm >= 0.5) as connected, count(*) as potential from b join tsy using (presyn) join seg using (segment) group by all),
  pc as (select distinct event_id, cell, col from act where connected >= 3),
  best as (select event_id, col, segment, cell, potential from (select *, row_number() over (partition by event_id, col order by potential desc, cell, segment) as rn from act where potential >= 3) where rn = 1)"""


def tick_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of events, and the segments and synapses of a graph by arithmetic."""
    s, i = F.col("id").cast("int"), F.col("i")
    segments = spark.range(160).select(s.alias("segment"), (s * 37 % 256).alias("cell"))
    rows = spark.range(160).select("id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i"))
    synapses = rows.select(s.alias("segment"), ((s * 31 + i * 17) % 256).alias("presyn"), ((s * 7 + i * 13) % 100 / F.lit(100.0)).alias("perm"))
    e = spread(t(spark, sf, "events").select("event_id", "value"), "event_id").select("event_id", VALUE.encode(F.col("value")).alias("bits"))
    return e.select("event_id", F.transform("bits", lambda b: b * 7 % 256).alias("before"), F.transform("bits", lambda b: b * 5 % 64).alias("cols")), segments, synapses


@query("tm_segments", f"{_S_TICK} select event_id, cast(segment as integer) as segment, cast(cell as integer) as cell, cast(connected as bigint) as connected, cast(potential as bigint) as potential, connected >= 3 as active, potential >= 3 as matching from act where potential >= 3")
def tm_segments(spark, sf):
    return ticks.segment_activity(*tick_tables(spark, sf), ["event_id"], TICK).where("matching or active")


@query("tm_predictive", f"{_S_TICK} select event_id, string_agg(cell, ',' order by cell) as cells from pc group by event_id")
def tm_predictive(spark, sf):
    return ticks.predictive_cells(ticks.segment_activity(*tick_tables(spark, sf), ["event_id"], TICK), ["event_id"]).select("event_id", csv(F.col("cells")).alias("cells"))


@query("tm_tick", f"""{_S_TICK}, own as (select event_id, col, list(cell order by cell) as own from pc group by all), pred as (select event_id, list(cell order by cell) as cells from pc group by event_id),
  least as (select cell // 4 as col, cell, row_number() over (partition by cell // 4 order by n, cell) as rn from (select c as cell, count(segment) as n from range(256) t(c) left join seg on seg.cell = c group by c)),
  j as (select event_id, col, own, best.cell as bc, least.cell as lc from ec left join own using (event_id, col) left join best using (event_id, col) left join least using (col) where least.rn = 1),
  made as (select event_id, list_sort(flatten(list(coalesce(own, range(col * 4, col * 4 + 4))))) as active, list_sort(flatten(list(coalesce(own, [coalesce(bc, lc)])))) as win, 1 - count(own) / count(*) as anomaly from j group by event_id)
  select event_id, {s_csv('active')} as active_cells, {s_csv('win')} as winner_cells, {s_csv('coalesce(cells, [])')} as predicted_cells, round(anomaly, 6) + 0.0 as anomaly from made left join pred using (event_id)""")
def tm_tick(spark, sf):
    out = ticks.compute(*tick_tables(spark, sf), ["event_id"], TICK)
    return out.select("event_id", *[csv(F.col(c)).alias(c) for c in ("active_cells", "winner_cells", "predicted_cells")], r6(F.col("anomaly")).alias("anomaly"))


@query("tm_changes", f"""{_S_TICK}, pcol as (select distinct event_id, col from pc), m as (select act.event_id, act.segment, act.connected, act.potential, ec.col is not null as now, pcol.col is null and best.segment is not null as is_best
    from act left join ec using (event_id, col) left join pcol using (event_id, col) left join best on best.event_id = act.event_id and best.segment = act.segment)
  select event_id, cast(segment as integer) as segment, case when now then 'adapt' else 'punish' end as change, cast(case when now and is_best then greatest(0, 6 - potential) else 0 end as bigint) as grow
  from m where (now and (connected >= 3 or is_best)) or (not now and potential >= 3)""")
def tm_changes(spark, sf):
    return ticks.changes(*tick_tables(spark, sf), ["event_id"], TICK)


# The winners of the tick before are the cells active then whose number is even.
_S_DELTAS = f"""{_S_TICK}, win as (select event_id, presyn from b where presyn % 2 = 0), pcol as (select distinct event_id, col from pc),
  ch as (select act.event_id, act.segment, act.cell, ec.col is not null as now, case when ec.col is not null and pcol.col is null and best.segment is not null then greatest(0, 6 - act.potential) else 0 end as grow
    from act left join ec using (event_id, col) left join pcol using (event_id, col) left join best on best.event_id = act.event_id and best.segment = act.segment
    where (ec.col is not null and (act.connected >= 3 or (pcol.col is null and best.segment is not null))) or (ec.col is null and act.potential >= 3)),
  adapted as (select ch.event_id, ch.segment, ch.cell, tsy.presyn, perm as was, greatest(least(perm + case when not now then -0.02::double when win.presyn is not null then 0.1::double else -0.1::double end, 1), 0) as perm from ch join tsy using (segment) left join win on win.event_id = ch.event_id and win.presyn = tsy.presyn),
  known as (select distinct event_id, col from act where connected >= 3 or potential >= 3),
  least as (select cell // 4 as col, cell, row_number() over (partition by cell // 4 order by n, cell) as rn from (select c as cell, count(segment) as n from range(256) t(c) left join seg on seg.cell = c group by c)),
  made as (select event_id, 160 + row_number() over (partition by event_id order by col) - 1 as segment, least.cell, 6 as grow, true as new from ec anti join known using (event_id, col) join least using (col) where least.rn = 1 and event_id in (select event_id from win)),
  growing as (select event_id, segment, cell, grow, false as new from ch where grow > 0 union all select * from made),
  free as (select g.*, win.presyn, row_number() over (partition by g.event_id, g.segment order by {{draw}}, win.presyn) as place from growing g join win using (event_id) left join tsy on tsy.segment = g.segment and tsy.presyn = win.presyn where new or tsy.presyn is null),
  grown as (select event_id, segment, cell, presyn, null::double as was, 0.21::double as perm, new from free where place <= grow),
  more as (select event_id, segment, count(*) as more from grown where not new group by all),
  old as (select a.*, more, count(*) over (partition by a.event_id, a.segment) + coalesce(more, 0) - 26 as excess, row_number() over (partition by a.event_id, a.segment order by perm, presyn) as weak from adapted a left join more using (event_id, segment)),
  deltas as (select event_id, segment, cell, presyn, was, case when more is not null and weak <= excess then null else perm end as perm, false as new from old where was is distinct from case when more is not null and weak <= excess then null else perm end union all select * from grown)"""


#: As TICK, with punishment and a maximum that growth meets.
LEARNING_TICK = replace(TICK, predicted_decrement=0.02, max_synapses=26)


def learning_ticks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records, segments, synapses = tick_tables(spark, sf)
    return records.withColumn("winners", F.filter("before", lambda c: c % 2 == 0)), segments, synapses


@query("tm_deltas", _S_DELTAS.format(draw=s_uniform("grow", "g.event_id", "g.segment", "win.presyn")) + " select event_id, cast(segment as integer) as segment, cast(cell as integer) as cell, cast(presyn as integer) as presyn, round(was, 6) as was, round(perm, 6) + 0.0 as perm, new from deltas")
def tm_deltas(spark, sf):
    return ticks.deltas(*learning_ticks(spark, sf), ["event_id"], LEARNING_TICK, digits=6)


@query("tm_next_tick", _S_DELTAS.format(draw=s_uniform("grow", "g.event_id", "g.segment", "win.presyn")) + """, seen as (select event_id, segment, cell, count(*) filter (perm >= 0.5) as connected, count(*) as potential from b join tsy using (presyn) join seg using (segment) group by all),
  more2 as (select event_id, segment, cell, (perm is not null)::int - (was is not null)::int as potential, coalesce(perm >= 0.5, false)::int - coalesce(was >= 0.5, false)::int as connected from b join deltas using (event_id, presyn)),
  both2 as (select event_id, segment, cell, sum(connected) as connected, sum(potential) as potential from (select event_id, segment, cell, connected, potential from seen union all select event_id, segment, cell, connected, potential from more2) group by all)
  select event_id, cast(segment as integer) as segment, cast(cell as integer) as cell, cast(connected as bigint) as connected, cast(potential as bigint) as potential from both2 where potential >= 3""")
def tm_next_tick(spark, sf):
    """The segments that match when a record meets the same cells again, after what its first tick has taught."""
    records, segments, synapses = learning_ticks(spark, sf)
    taught = ticks.learned(records, segments, synapses, ["event_id"], LEARNING_TICK)
    act = ticks.segment_activity(taught, segments, synapses, ["event_id"], LEARNING_TICK, deltas="deltas")
    return act.where("matching").select("event_id", "segment", "cell", "connected", "potential")


def user_series(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, sf, "events").select(F.col("user_id").cast("string").alias("series"), F.row_number().over(order).cast("long").alias("seq"), "value", "event_type", VALUE.encode(F.col("value")).alias("bits"))


@query("sp_learn")
def sp_learn(spark, sf):
    p = spatial_pooler.PoolerParams(inputs=(400,), columns=(128,), potential_radius=400, boost=1.0)
    return spatial_pooler.run_series(user_series(spark, sf), p).select("series", "seq", csv(F.col("active")).alias("active"), "max_overlap")


MEMORY = temporal_memory.MemoryParams(columns=(256,), cells_per_column=4, activation=8, min_threshold=5, max_new=15, initial=0.3)


@query("tm_run")
def tm_run(spark, sf):
    s = user_series(spark, sf).withColumn("cols", windows.scatter_columns(F.col("bits"), 256))
    ticks = temporal_memory.run_series(s, MEMORY)
    return ticks.select("series", "seq", r6(F.col("anomaly")).alias("anomaly"), "n_segments", "n_synapses", F.size("active_cells").alias("active"))


@query("cell_statistics")
def cell_statistics(spark, sf):
    s = user_series(spark, sf).withColumn("cols", windows.scatter_columns(F.col("bits"), 256))
    return windows.cell_statistics(temporal_memory.run_series(s, MEMORY)).select("cell", "active", "correct", "anomalous", r6(F.col("rate")).alias("rate"), r6(F.col("accuracy")).alias("accuracy"))


@query("classifier_learn")
def classifier_learn(spark, sf):
    s = user_series(spark, sf).withColumn("bucket", F.array_position(F.array(*[F.lit(x) for x in EVENT_TYPES]), F.col("event_type")).cast("int") - 1)
    return classifier.learn_series(s, 0.1, (0, 1)).select("series", "step", "bit", "bucket", r6(F.col("w")).alias("w"))


_S_W = "wt as (select b as bit, k as bucket, ((b * 13 + k * 7) % 50) / 100.0 as w from range(400) t(b), range(5) u(k))"
_S_PROB = f"""with {_S_W}, z as (select event_id, bucket, sum(w) as z from (select event_id, unnest({_S_VALUE}) as bit from events) join wt using (bit) group by event_id, bucket),
  e as (select event_id, bucket, exp(z - max(z) over (partition by event_id)) as e from z), p as (select event_id, bucket, e / sum(e) over (partition by event_id) as p from e)"""


def weight_table(spark: SparkSession) -> DataFrame:
    b, k = F.col("id").cast("int"), F.col("k")
    rows = spark.range(400).select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return rows.select(F.lit(1).alias("step"), b.alias("bit"), k.alias("bucket"), ((b * 13 + k * 7) % 50 / F.lit(100.0)).alias("w"))


@query("classifier_infer", f"{_S_PROB} select event_id, cast(bucket as integer) as bucket, round(p, 6) as p from p")
def classifier_infer(spark, sf):
    return classifier.infer(event_bits(spark, sf), weight_table(spark), ["event_id"]).select("event_id", "bucket", r6(F.col("p")).alias("p"))


@query("anomaly_raw", f"{_S_PAIRS} select event_id, round(1 - len(list_intersect(bits, before)) / len(bits), 6) as score from p where before is not null")
def anomaly_raw(spark, sf):
    return pairs(spark, sf).where("before is not null").select("event_id", r6(anomaly.score(F.col("bits"), F.col("before"))).alias("score"))


@query("anomaly_from_cells", "select event_id, round(1 - len(list_intersect(a, p)) / len(a), 6) as score from (select event_id, list_distinct([event_id % 5, event_id % 7, event_id % 3]) as a, list_distinct(list_transform([event_id % 11, event_id % 13], lambda c: c // 4)) as p from events)")
def anomaly_from_cells(spark, sf):
    k = F.col("event_id")
    a = F.array_distinct(F.array(*[(k % n).cast("int") for n in (5, 7, 3)]))
    return t(spark, sf, "events").select("event_id", r6(anomaly.score_of_cells(a, F.array((k % 11).cast("int"), (k % 13).cast("int")), 4)).alias("score"))


def _s_likelihood(learning: int, samples: int, every: int) -> str:
    first = max(learning, every)
    c = anomaly.ERFC
    poly = repr(c[-1])
    for x in reversed(c[1:-1]):
        poly = f"({x!r} + t * {poly})"
    return f"""with s as (select event_id, user_id, ts, value / 500.0 as x from events),
      w as (select *, row_number() over o as i, avg(x) over l as m, var_pop(x) over l as v from s
        window o as (partition by user_id order by ts, event_id), l as (partition by user_id order by ts, event_id rows between {samples - 1} preceding and current row)),
      e as (select *, last_value(case when i >= {first} and (i - {first}) % {every} = 0 then m end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as em,
        last_value(case when i >= {first} and (i - {first}) % {every} = 0 then greatest(v, 0.0001) end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as ev from w),
      z as (select event_id, i, (x - coalesce(em, 0.5)) / sqrt(coalesce(ev, 0.0001)) / sqrt(2) as z from e),
      q as (select *, 1 / (1 + 0.5 * abs(z)) as t from z), f as (select *, t * exp(-z * z + ({c[0]!r}) + t * {poly}) as tau from q)
      select event_id, round(case when i < {learning} then 0.5 else 1 - 0.5 * (case when z >= 0 then tau else 2 - tau end) end, 6) + 0.0 as likelihood from f"""


@query("anomaly_likelihood", _s_likelihood(20, 15, 10))
def anomaly_likelihood(spark, sf):
    s = t(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("value") / 500.0).alias("x"))
    return anomaly.Likelihood(20, 15, 10).add(s, "x", ["user_id"], ["ts", "event_id"]).select("event_id", r6(F.col("likelihood")).alias("likelihood"))


# ---- one long series: all events by time, cut into slices ------------------------------------------------------------------


def _s_long(sql: str) -> str:
    """The SQL of a query by user, for all events as one series."""
    return sql.replace("partition by user_id ", "").replace("list(value order by rn) as s from (select user_id, ", "list(value order by rn) as s from (select ")


@query("enc_delta_long", _s_long(SQL["enc_delta"]))
def enc_delta_long(spark, sf):
    e = E.DeltaEncoder()
    d = slices.delta(t(spark, sf, "events").select("event_id", "ts", "value"), "value", [], ["ts", "event_id"])
    return d.select("event_id", r6(F.col("delta")).alias("delta"), csv(e.encode(F.col("delta"))).alias("bits"))


@query("count_windows_long", "select cast(rn // 10 as bigint) as win, array_to_string(list(cast(round(value * 1000) as bigint) order by rn), ',') as samples from (select value, row_number() over (order by ts, event_id) - 1 as rn from events) group by rn // 10 having count(*) = 10")
def count_windows_long(spark, sf):
    w = slices.count_windows(t(spark, sf, "events"), [], ["ts", "event_id"], "value", 10)
    return w.select(F.col("window").alias("win"), csv(F.transform("samples", lambda v: F.round(v * 1000).cast("long"))).alias("samples"))


@query("anomaly_likelihood_long", _s_long(_s_likelihood(288, 100, 100)))
def anomaly_likelihood_long(spark, sf):
    s = t(spark, sf, "events").select("event_id", "ts", (F.col("value") / 500.0).alias("x"))
    return slices.likelihood(s, "x", [], ["ts", "event_id"], anomaly.Likelihood(288, 100, 100)).select("event_id", r6(F.col("likelihood")).alias("likelihood"))


@query("sdr_metrics_long", f"""with e as (select event_id, ts, {_S_VALUE} as bits from events), p as (select bits, lag(bits) over (order by ts, event_id) as before from e), q as (select len(bits) / 400 as s, len(list_intersect(bits, before)) as o, before from p)
  select cast(count(*) as bigint) as num_samples, round(avg(s), 6) as sparsity_mean, round(stddev_pop(s), 6) + 0.0 as sparsity_std, round(avg(case when before is not null then o end), 6) as overlap_mean,
  cast(min(case when before is not null then o end) as bigint) as overlap_min, cast(max(case when before is not null then o end) as bigint) as overlap_max from q""")
def sdr_metrics_long(spark, sf):
    e = t(spark, sf, "events").select("ts", "event_id", VALUE.encode(F.col("value")).alias("bits"))
    m = slices.summary(e, "bits", 400, [], ["ts", "event_id"])
    return m.select("num_samples", *[r6(F.col(c)).alias(c) for c in ("sparsity_mean", "sparsity_std", "overlap_mean")], *[F.col(c).cast("long").alias(c) for c in ("overlap_min", "overlap_max")])


# ---- sessions: a reset flag, or a gap of twelve hours, begins a new one ------------------------------------------------------

_S_SESSION = """b as (select event_id, user_id, ts, value, event_type, case when lag(ts) over o is null or event_type = 'signup' or ts - lag(ts) over o > interval 12 hours then 1 else 0 end as new from events window o as (partition by user_id order by ts, event_id)),
  s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from b)"""


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "value", "event_type")
    gap = F.col("ts") - F.col("before_.v0") > F.expr("interval '12' hour")
    s = slices.sessions(e, ["user_id"], ["ts", "event_id"], (F.col("event_type") == "signup") | gap, ["ts"])
    return staged(s.drop("event_type"), "sessions")  # counted, and read by what asks for them


@query("session_delta", f"""with {_S_SESSION}, d as (select event_id, session, coalesce(value - lag(value) over (partition by user_id, session order by ts, event_id), 0.0) as delta from s)
  select event_id, cast(session as bigint) as session, round(delta, 6) + 0.0 as delta, {s_csv(s_scalar("delta", -100.0, 100.0, 100, 10))} as bits from d""")
def session_delta(spark, sf):
    e = E.DeltaEncoder()
    d = slices.delta(user_sessions(spark, sf), "value", ["user_id", "session"], ["ts", "event_id"])
    return d.select("event_id", "session", r6(F.col("delta")).alias("delta"), csv(e.encode(F.col("delta"))).alias("bits"))


@query("session_likelihood", f"with {_S_SESSION}, " + _s_likelihood(4, 3, 2).replace("with s as (select event_id, user_id, ts, value / 500.0 as x from events)", "xs as (select event_id, user_id, session, ts, value / 500.0 as x from s)").replace("var_pop(x) over l as v from s", "var_pop(x) over l as v from xs").replace("partition by user_id ", "partition by user_id, session "))
def session_likelihood(spark, sf):
    s = user_sessions(spark, sf).withColumn("x", F.col("value") / 500.0)
    return slices.likelihood(s, "x", ["user_id", "session"], ["ts", "event_id"], anomaly.Likelihood(4, 3, 2)).select("event_id", r6(F.col("likelihood")).alias("likelihood"))


# ---- joins by ranges --------------------------------------------------------------------------------------------------------


@query("interval_overlaps", """with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, date_diff('day', timestamp '1970-01-01', l_shipdate) as low, date_diff('day', timestamp '1970-01-01', l_shipdate) + cast(floor(l_quantity) as bigint) as high from lineitem)
  select a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_extendedprice, cast(count(b.l_orderkey) as bigint) as overlapping, max(case when b.l_orderkey is not null then least(a.high, b.high) - greatest(a.low, b.low) + 1 end) as greatest
  from l a left join l b on a.l_partkey = b.l_partkey and a.low <= b.high and b.low <= a.high and (a.l_orderkey, a.l_linenumber, a.l_suppkey, a.l_extendedprice) <> (b.l_orderkey, b.l_linenumber, b.l_suppkey, b.l_extendedprice) group by all""")
def interval_overlaps(spark, sf):
    low = F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long")
    rows = t(spark, sf, "lineitem").select(*LINE, "l_partkey", "l_suppkey", "l_extendedprice", low.alias("low"), (low + F.floor("l_quantity")).alias("high"))
    return ranges.overlaps(rows, ["l_partkey"], "low", "high", [*LINE, "l_partkey", "l_suppkey", "l_extendedprice"])


@query("radius_neighbours", """with p as (select event_id, epoch_us(ts) / 3600000000.0::double as x, value as y from events)
  select a.event_id, cast(count(b.event_id) as bigint) as neighbours from p a left join p b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 25.0::double and a.event_id <> b.event_id group by a.event_id""")
def radius_neighbours(spark, sf):
    e = t(spark, sf, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000.0)).alias("x"), "value")
    return ranges.neighbours(e, "event_id", "x", "value", 5.0)


# ---- metrics and topology -----------------------------------------------------------------------------------------------


@query("sdr_metrics", f"""{_S_PAIRS}, q as (select user_id, len(bits) / 400 as s, len(list_intersect(bits, before)) as o, before from p)
  select user_id, cast(count(*) as bigint) as num_samples, round(avg(s), 6) as sparsity_mean, round(stddev_pop(s), 6) + 0.0 as sparsity_std, round(coalesce(avg(case when before is not null then o end), 0), 6) as overlap_mean,
  cast(coalesce(min(case when before is not null then o end), 0) as bigint) as overlap_min, cast(coalesce(max(case when before is not null then o end), 0) as bigint) as overlap_max from q group by user_id""")
def sdr_metrics(spark, sf):
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", VALUE.encode(F.col("value")).alias("bits"))
    m = metrics.summary(e, "bits", 400, ["user_id"], ["ts", "event_id"])
    return m.select("user_id", "num_samples", *[r6(F.col(c)).alias(c) for c in ("sparsity_mean", "sparsity_std", "overlap_mean")], *[F.col(c).cast("long").alias(c) for c in ("overlap_min", "overlap_max")])


_S_COUNTS = f"c as (select bit, count(*) as n from (select unnest({_S_VALUE}) as bit from events) group by bit)"


@query("activation_frequencies", f"with {_S_COUNTS} select cast(bit as integer) as bit, round(n / (select count(*) from events), 6) as frequency from c")
def activation_frequencies(spark, sf):
    return metrics.activation_frequencies(event_bits(spark, sf), "bits", []).select("bit", r6(F.col("frequency")).alias("frequency"))


@query("activation_usage", f"with {_S_COUNTS}, s as (select sum(n) as t from c) select round(-sum(n / t * log2(n / t)), 6) as entropy, cast(400 - count(*) as bigint) as dead_bits, round((400 - count(*)) / 400, 6) as dead_ratio from c, s")
def activation_usage(spark, sf):
    u = metrics.usage(event_bits(spark, sf), "bits", 400, [])
    return u.select(r6(F.col("entropy")).alias("entropy"), F.col("dead_bits").cast("long").alias("dead_bits"), r6(F.col("dead_ratio")).alias("dead_ratio"))


@query("sdr_metrics_by_day", f"""with e as (select event_id, ts, {_S_VALUE} as bits from events), p as (select bits, lag(bits) over (order by ts, event_id) as before from e), q as (select len(bits) / 400 as s, len(list_intersect(bits, before)) as o, before from p),
  {_S_COUNTS}, t as (select sum(n) as t from c), u as (select -sum(n / t * log2(n / t)) as entropy, 400 - count(*) as dead_bits from c, t)
  select cast(count(*) as bigint) as num_samples, round(avg(s), 6) as sparsity_mean, round(avg(case when before is not null then o end), 6) as overlap_mean, cast(min(case when before is not null then o end) as bigint) as overlap_min,
  cast(max(case when before is not null then o end) as bigint) as overlap_max, round(any_value(entropy), 6) as entropy, cast(any_value(dead_bits) as bigint) as dead_bits from q, u""")
def sdr_metrics_by_day(spark, sf):
    """Summaries of days, merged to those of all days."""
    e = t(spark, sf, "events").select("ts", "event_id", VALUE.encode(F.col("value")).alias("bits"))
    days = metrics.partial(e, "bits", 400, [], ["ts", "event_id"], F.to_date("ts"))
    m = metrics.merged(days, 400, [])
    return m.select("num_samples", *[r6(F.col(c)).alias(c) for c in ("sparsity_mean", "overlap_mean", "entropy")], *[F.col(c).cast("long").alias(c) for c in ("overlap_min", "overlap_max", "dead_bits")])


@query("neighborhood", "with c as (select i, i // 20 as y, i % 20 as x from range(300) t(i)) select cast(a.i as integer) as cell, cast(b.i as integer) as nbr from c a join c b on abs(a.y - b.y) <= 2 and abs(a.x - b.x) <= 2 and a.i <> b.i")
def neighborhood(spark, sf):
    return topology.neighbor_table(spark, (15, 20), 2)


@query("neighborhood_wrapped", "with c as (select i, i // 5 as y, i % 5 as x from range(35) t(i)) select cast(a.i as integer) as cell, cast(b.i as integer) as nbr from c a join c b on least(abs(a.y - b.y), 7 - abs(a.y - b.y)) <= 3 and least(abs(a.x - b.x), 5 - abs(a.x - b.x)) <= 3")
def neighborhood_wrapped(spark, sf):
    return topology.neighbor_table(spark, (7, 5), 3, wrap=True, with_centre=True)


@query("map_column_to_input", "select cast(i as integer) as col, cast(least(floor((i // 8 + 0.5) * 3.0), 29) * 50 + least(floor((i % 8 + 0.5) * 6.25), 49) as integer) as input from range(80) t(i)")
def map_column_to_input(spark, sf):
    c = F.col("id").cast("int")
    return spark.range(80).select(c.alias("col"), topology.map_column_to_input(c, (10, 8), (30, 50)).cast("int").alias("input"))


@query("potential_pool", "select cast(i as integer) as col, string_agg(p, ',' order by p) as pool from range(50) t(i), range(200) u(p) where abs(p - least(floor((i + 0.5) * 4.0), 199)) <= 6 group by i")
def potential_pool(spark, sf):
    c = F.col("id").cast("int")
    return spark.range(50).select(c.alias("col"), csv(topology.potential_pool(c, (50,), (200,), 6)).alias("pool"))


_S_DRAWS = f"(sqrt(-2 * ln({s_uniform('n-length', 'c_custkey')})) * cos({2 * math.pi!r}::double * {s_uniform('n-angle', 'c_custkey')}))"


@query("random_draws", f"""select c_custkey, round({s_uniform('u', 'c_custkey')}, 6) as uniform, cast(floor({s_uniform('b', 'c_custkey')} * 10) as bigint) as below, round(-2.0::double + {s_uniform('r', 'c_custkey')} * 5.0::double, 6) + 0.0 as between_, {s_uniform('c', 'c_custkey')} < 0.3 as chance,
  round(1.0::double + 2.0::double * {_S_DRAWS}, 6) + 0.0 as normal, round(-ln({s_uniform('e', 'c_custkey')}) / 0.5::double, 6) + 0.0 as exponential,
  array_to_string(list_transform(list_sort(list_transform(range(20), lambda x: {{'u': {s_uniform('s', 'c_custkey', 'x')}, 'x': x}})), lambda s: s.x)[1:5], ',') as sample from customer""")
def random_draws(spark, sf):
    k, items = "c_custkey", F.sequence(F.lit(0), F.lit(19))
    cols = {"uniform": r6(draws.uniform("u", k)), "below": draws.below(10, "b", k), "between_": r6(draws.between(-2, 3, "r", k)), "chance": draws.chance(0.3, "c", k), "normal": r6(draws.normal(1, 2, "n", k)), "exponential": r6(draws.exponential(0.5, "e", k)), "sample": csv(draws.sample(items, 5, "s", k))}
    return t(spark, sf, "customer").select(k, *[c.alias(n) for n, c in cols.items()])


_S_MIXED = "[c_custkey * 7 % 50, c_custkey * 3 % 50, c_custkey % 50, c_custkey * 7 % 50]"


@query("sdr_construct", f"select c_custkey, {s_csv(f'list_sort(list_distinct({_S_MIXED}))')} as from_items, {s_csv(f'list_sort(list_distinct({_S_MIXED}))')} as sparse, '' as zero, {s_csv(f'list_sort(list_distinct({_S_MIXED}))')} = {s_csv('list_sort(list_distinct([c_custkey % 50, c_custkey * 3 % 50]))')} as equal, 'SDR( 5, 10 ) ' || array_to_string(list_sort(list_distinct({_S_MIXED})), ', ') as shown from customer")
def sdr_construct(spark, sf):
    k = F.col("c_custkey")
    bits = kernels.normal(F.array(*[(k * n % 50).cast("int") for n in (7, 3, 1, 7)]))
    other = kernels.normal(F.array(*[(k * n % 50).cast("int") for n in (1, 3)]))
    return t(spark, sf, "customer").select("c_custkey", csv(bits).alias("from_items"), csv(sdr.checked(bits, 50)).alias("sparse"), csv(sdr.zero()).alias("zero"), (bits == other).alias("equal"), sdr.show(bits, sdr.Shape((5, 10))).alias("shown"))


# ---- lookups, bits as JSON, statistics of ticks -----------------------------------------------------------------------------


@query("conn_lookups", f"with {_S_GRAPH} select cast(cell as integer) as cell, cast(segment as integer) as segment, cast(row_number() over (partition by cell order by segment) - 1 as integer) as place, cast(count(presyn) as bigint) as synapses, cast(count(case when perm >= 0.5 then 1 end) as bigint) as connected from seg left join few using (segment) group by cell, segment")
def conn_lookups(spark, sf):
    return connections.lookups(segment_table(spark), synapse_table(spark).where("perm >= (segment % 5) * 0.1"), 0.5)


@query("conn_update", f"with {_S_SYN} select cast(segment as integer) as segment, cast(presyn as integer) as presyn, round(case when (segment + presyn) % 3 = 0 then greatest(least(perm * 3 - 1, 1), 0) else perm end, 6) as perm from syn")
def conn_update(spark, sf):
    own = synapse_table(spark)
    new = own.where("(segment + presyn) % 3 = 0").withColumn("perm", F.col("perm") * 3 - 1)
    return synapses_out(connections.update_permanences(own, new.unionByName(spark.createDataFrame([(-1, -1, 0.5)], "segment int, presyn int, perm double"))))


@query("sdr_json", f"select event_id, '{{\"dims\":[400],\"bits\":[' || {s_csv(_S_VALUE)} || ']}}' as json, {s_csv(_S_VALUE)} as back, 400 as size from events")
def sdr_json(spark, sf):
    e = event_bits(spark, sf).withColumn("json", model_io.to_json(F.col("bits"), 400))
    back = model_io.from_json(F.col("json"))
    return e.select("event_id", "json", csv(back["bits"]).alias("back"), back["dims"][0].alias("size"))


@query("receptive_radius", "select c_nationkey, round(greatest(0.0, (pow(avg(c_custkey % 50 + 1), 0.5) - 1) / 2), 6) as radius from customer group by c_nationkey")
def receptive_radius(spark, sf):
    return t(spark, sf, "customer").groupBy("c_nationkey").agg(r6(topology.receptive_field_radius(F.col("c_custkey") % 50 + 1, 2)).alias("radius"))


@query("classifier_best", f"{_S_PROB} select event_id, cast(bucket as integer) as bucket from (select event_id, bucket, row_number() over (partition by event_id order by round(p, 9) desc, bucket desc) as rn from p) where rn = 1")
def classifier_best(spark, sf):
    p = classifier.infer(event_bits(spark, sf), weight_table(spark), ["event_id"]).withColumn("p", F.round("p", 9))
    return classifier.best(p, ["event_id"]).select("event_id", "bucket")


_S_ANOMALIES = f"{_S_PAIRS}, a as (select user_id, (1 - len(list_intersect(bits, before)) / len(bits)) * 0.02 as x from p where before is not null), g as (select user_id, max(x) as high, avg(x) as mean, quantile_disc(x, 0.25) as low from a group by user_id)"


@query("detected_groups", f"{_S_ANOMALIES} select user_id, high > -1.981 + 2.0 or mean > 0.012 * 1.3 or low > 0.015 * 1.2 or mean > 0.015 as found from g")
def detected_groups(spark, sf):
    a = pairs(spark, sf).where("before is not null").select("user_id", (anomaly.score(F.col("bits"), F.col("before")) * 0.02).alias("x"))
    g = a.groupBy("user_id").agg(F.max("x").alias("high"), F.avg("x").alias("mean"), F.expr("percentile_disc(0.25) within group (order by x)").alias("low"))
    return g.select("user_id", windows.detected(F.col("high") * 1.0, F.col("mean"), F.col("low"), -1.981, 0.012, 0.015).alias("found"))


@query("cell_statistics_of_ticks", SQL["tm_tick"].replace(SQL["tm_tick"][SQL["tm_tick"].index("  select event_id, array_to_string(active"):], """, u as (select unnest(active) as cell, coalesce(cells, []) as cells, anomaly from made left join pred using (event_id))
  select cast(cell as integer) as cell, cast(count(*) as bigint) as active, cast(count(*) filter (list_contains(cells, cell)) as bigint) as correct, cast(count(*) filter (anomaly > 0.5) as bigint) as anomalous, round(count(*) / (select count(*) from made), 6) as rate, round(count(*) filter (list_contains(cells, cell)) / count(*), 6) as accuracy from u group by cell"""))
def cell_statistics_of_ticks(spark, sf):
    stats = windows.cell_statistics(ticks.compute(*tick_tables(spark, sf), ["event_id"], TICK))
    return stats.select("cell", "active", "correct", "anomalous", r6(F.col("rate")).alias("rate"), r6(F.col("accuracy")).alias("accuracy"))
