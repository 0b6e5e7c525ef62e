"""DuckDB SQL for the 64-bit hash kernels of the encoders: FNV-1a, a linear congruential generator, and distinct draws.

All of it is unsigned arithmetic modulo 2**64 in 128-bit integers.
"""

from __future__ import annotations

from quillon.functions.kernels import FNV_OFFSET, FNV_PRIME, LCG_FACTOR

TOP = 1 << 64
_MOD = f"{TOP}::uhugeint"


def s_bytes(x: str) -> str:
    """The UTF-8 bytes of a string."""
    return f"list_transform(range(octet_length(encode({x}))), lambda i: cast('0x' || substr(hex(encode({x})), cast(2 * i + 1 as bigint), 2) as uhugeint))"


def s_fnv(values: str, start: str = f"{FNV_OFFSET}::uhugeint") -> str:
    """FNV-1a over a list of unsigned numbers."""
    return f"list_reduce({values}, lambda h, b: xor(h, b) * {FNV_PRIME}::uhugeint % {_MOD}, {start})"


def s_unsigned(x: str) -> str:
    """A signed 64-bit number as an unsigned one."""
    return f"cast(case when {x} < 0 then cast({x} as hugeint) + {TOP}::hugeint else cast({x} as hugeint) end as uhugeint)"


def s_first(values: str, n: int) -> str:
    """The first n distinct values, in order."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)[1:{n}]"


def s_draws(state: str, size: int, steps: int) -> str:
    """The generator's first draws below size: state k is a**k * state + (1 + a + ... + a**(k - 1))."""
    factor, term, factors, terms = 1, 0, [], []
    for _ in range(steps):
        factor, term = factor * LCG_FACTOR % TOP, (term * LCG_FACTOR + 1) % TOP
        factors.append(f"{factor}::uhugeint")
        terms.append(f"{term}::uhugeint")
    return f"list_transform(range(1, {steps + 1}), lambda k: cast(([{', '.join(factors)}][k] * {state} + [{', '.join(terms)}][k]) % {_MOD} % {size}::uhugeint as bigint))"


def s_level_states(levels: int) -> str:
    """A list of the hash states after a level's number."""
    return "[" + ", ".join(f"{(FNV_OFFSET ^ k) * FNV_PRIME % TOP}::uhugeint" for k in range(levels)) + "]"


def s_finalised(states: str, key: str, size: int, width: int, steps: int = 120) -> str:
    """CTEs draws and picked (key, bits): the first width distinct numbers below size of a state that is finalised again and again.

    states: a table of (key, h).
    """
    shift = f"(h // {1 << 33}::uhugeint)"
    one = f"(select {key}, n, xor(h, {shift}) * {0xFF51AFD7ED558CCD}::uhugeint % {_MOD} as h from draws where n < {steps})"
    two = f"(select {key}, n, xor(h, {shift}) * {0xC4CEB9FE1A85EC53}::uhugeint % {_MOD} as h from {one})"
    return f"""draws as (select {key}, 0 as n, h from {states} union all select {key}, n + 1, xor(h, {shift}) from {two}),
      seen as (select {key}, cast(h % {size}::uhugeint as bigint) as bit, min(n) as n from draws where n > 0 group by all),
      picked as (select {key}, list(bit order by n)[1:{width}] as bits from seen group by {key})"""


def s_signs(vectors: str, key: str, planes: str, low: int = 0, high: int = 64) -> str:
    """(key, state): bit i of state is 1 if the product of a vector with plane low + i isn't negative.

    vectors: a table of (key, place, x); planes: one of (plane, place, w).
    """
    dots = f"select {key}, plane, sum(x * w) as dot from {vectors} join {planes} using (place) where plane >= {low} and plane < {high} group by all"
    return f"select {key}, cast(sum(case when dot >= 0 then cast(pow(2.0::double, plane - {low}) as hugeint) else 0::hugeint end) as uhugeint) as state from ({dots}) group by {key}"


def s_lcg_planes(count: int, dim: int, seed: int) -> str:
    """CTEs steps and planes (plane, place, w): the values of encoders.text.lcg_planes."""
    return f"""recursive steps as (select 0 as k, {seed}::uhugeint as s union all select k + 1, (s * {LCG_FACTOR}::uhugeint + 1::uhugeint) % {_MOD} from steps where k < {count * dim}),
      planes as (select (k - 1) // {dim} as plane, (k - 1) % {dim} as place, cast(s // {1 << 33}::uhugeint as double) / 2147483647.5::double - 1.0::double as w from steps where k > 0)"""


def s_rotated(x: str, turn: int) -> str:
    """A 64-bit number turned left."""
    return f"(({x} * {1 << turn}::uhugeint) % {_MOD} + {x} // {1 << 64 - turn}::uhugeint)" if turn else x
