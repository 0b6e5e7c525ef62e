"""Encoders of prices, currency pairs and order books."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.functions.kernels import bits_udf, clamp, fnv, joined, no_bits, run

from .base import Encoder
from .signal import part, scaled

_MASK = (1 << 64) - 1


def log_share(x: Column, low: float, high: float, log_scale: bool) -> Column:
    """x's place in [low, high], clamped, by its logarithm if so wished."""
    return (F.ln(clamp(x, low, high)) - F.lit(math.log(low))) / F.lit(math.log(high) - math.log(low)) if log_scale else scaled(x, low, high)


@dataclass
class PriceEncoder(Encoder):
    """A run for the price, and with change_bits one for the change in per cent."""

    price_bits: int = 100
    price_width: int = 21
    change_bits: int = 50
    change_width: int = 10
    minimum: float = 0.01
    maximum: float = 10_000.0
    max_percent: float = 10.0
    log_scale: bool = True

    def __post_init__(self):
        require(0 < self.minimum < self.maximum, "minimum", "must be positive and below maximum")
        require(0 < self.price_width <= self.price_bits and self.change_width <= self.change_bits, "width", "must be positive and at most the bits")
        self.size = self.price_bits + self.change_bits

    def encode(self, price: Column, change: Column | None = None, percent: bool = True) -> Column:
        p = run(log_share(price.cast("double"), self.minimum, self.maximum, self.log_scale), self.price_bits, self.price_width)
        if change is None or not self.change_bits:
            return F.when(price.isNotNull(), p)
        c = change if percent else F.when(price != 0, change / price * 100.0).otherwise(F.lit(0.0))
        c = run(scaled(c, -self.max_percent, self.max_percent), self.change_bits, self.change_width, self.price_bits)
        return F.when(price.isNotNull() & change.isNotNull(), F.concat(p, c)).when(price.isNotNull(), p)

    @staticmethod
    def change_percent(price: Column, before: Column) -> Column:
        return F.when(before != 0, (price - before) / before * 100.0)


def parse_pair(pair: Column) -> tuple[Column, Column]:
    """Base and quote of EUR/USD or EURUSD, in upper case; null if it is neither."""
    up = F.upper(pair)
    base = F.regexp_extract(up, r"^([A-Z]{3})/?([A-Z]{3})$", 1)
    return F.when(base != "", base), F.when(base != "", F.substring(up, -3, 3))


def inverse_pair(pair: Column) -> Column:
    base, quote = parse_pair(pair)
    return F.concat(quote, F.lit("/"), base)


@dataclass
class CurrencyPairEncoder(Encoder):
    """Hashed bits of base and quote, and a run for the rate if it isn't null."""

    base_bits: int = 64
    base_width: int = 16
    quote_bits: int = 64
    quote_width: int = 16
    rate_bits: int = 100
    rate_width: int = 21
    minimum: float = 1e-4
    maximum: float = 1e4
    log_scale: bool = True
    strict: bool = True

    def __post_init__(self):
        require(self.base_width <= self.base_bits and self.quote_width <= self.quote_bits and self.rate_width <= self.rate_bits, "width", "must be at most the bits")
        self.size = self.base_bits + self.quote_bits + self.rate_bits

    @staticmethod
    def code_bits(code: str, bits: int, width: int) -> list[int]:
        """Distinct numbers below bits, by repeated finalising of the code's hash."""
        state, out = fnv(code.encode()), dict[int, None]()
        while len(out) < width:
            for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                state = (state ^ state >> 33) * factor & _MASK
            state ^= state >> 33
            out[state % bits] = None
        return list(out)

    def encode(self, pair: Column, rate: Column | None = None) -> Column:
        def codes(bits: int, width: int, offset: int):
            def function(column):
                known = {c: [offset + b for b in self.code_bits(c, bits, width)] for c in column.dropna().unique()}
                return [known.get(c) for c in column]

            return bits_udf(function)

        base, quote = parse_pair(pair)
        own = F.concat(codes(self.base_bits, self.base_width, 0)(base), codes(self.quote_bits, self.quote_width, self.base_bits)(quote))
        if rate is not None:
            r = run(log_share(rate, self.minimum, self.maximum, self.log_scale), self.rate_bits, self.rate_width, self.base_bits + self.quote_bits)
            own = F.when(rate.isNull(), own).otherwise(F.concat(own, r))
        return self.within(F.when(pair.isNotNull(), base.isNotNull()), own, "not a currency pair")


def _volume(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda a, x: a + x["volume"])


def book_metrics(bids: Column, asks: Column) -> dict[str, Column]:
    """Best prices, mid, spread, totals and imbalance of array<struct<price, volume>> columns."""
    bid, ask = F.get(bids, F.lit(0))["price"], F.get(asks, F.lit(0))["price"]
    buy, sell = _volume(bids), _volume(asks)
    mid = (bid + ask) / 2.0
    return {
        "best_bid": bid, "best_ask": ask, "mid": mid, "spread": ask - bid, "spread_percent": F.when(mid > 0, (ask - bid) / mid * 100.0),
        "bid_volume": buy, "ask_volume": sell, "imbalance": F.when(buy + sell == 0, F.lit(0.0)).otherwise((buy - sell) / (buy + sell)),
    }


@dataclass
class OrderBookEncoder(Encoder):
    """A run for the volume of each level of either side, the spread (if both sides have one) and the imbalance."""

    depth: int = 5
    bits_per_level: int = 20
    width_per_level: int = 4
    spread_bits: int = 30
    spread_width: int = 6
    imbalance_bits: int = 30
    imbalance_width: int = 6
    max_spread_percent: float = 5.0
    max_volume: float = 1_000_000.0

    def __post_init__(self):
        require(self.depth > 0 and self.max_volume > 0 and self.max_spread_percent > 0, "depth", "must be positive")
        require(self.width_per_level <= self.bits_per_level and self.spread_width <= self.spread_bits and self.imbalance_width <= self.imbalance_bits, "width", "must be at most the bits")
        self.size = 2 * self.depth * self.bits_per_level + self.spread_bits + self.imbalance_bits

    def encode(self, bids: Column, asks: Column) -> Column:
        def side(levels: Column, first: int) -> Column:
            return F.flatten(F.transform(F.slice(levels, 1, self.depth), lambda x, i: part(clamp(x["volume"] / F.lit(self.max_volume), 0.0, 1.0), self.bits_per_level, self.width_per_level, (i + F.lit(first)) * F.lit(self.bits_per_level))))

        m, at = book_metrics(bids, asks), 2 * self.depth * self.bits_per_level
        spread = F.when(m["spread_percent"].isNotNull(), run(clamp(m["spread_percent"] / F.lit(self.max_spread_percent), 0.0, 1.0), self.spread_bits, self.spread_width, at)).otherwise(no_bits())
        tilt = run((m["imbalance"] + 1.0) / 2.0, self.imbalance_bits, self.imbalance_width, at + self.spread_bits)
        return F.concat(side(bids, 0), side(asks, self.depth), spread, tilt)
