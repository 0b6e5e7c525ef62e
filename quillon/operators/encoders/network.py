"""Encoders of internet and hardware addresses."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.functions.kernels import BITS, bits_udf, fnv, joined, lcg_pick, run

from .base import Encoder

_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$"


@dataclass
class IpAddressEncoder(Encoder):
    """A run per octet; with ipv6 a run per 16-bit group, and IPv4 addresses fill the first four groups' places.

    An octet's share is of 255; with narrow_v4 it is of 65535 in the wide form, which leaves all octets near 0.
    """

    bits_per_segment: int = 32
    width_per_segment: int = 8
    ipv6: bool = False
    narrow_v4: bool = False
    strict: bool = True

    def __post_init__(self):
        require(0 < self.width_per_segment <= self.bits_per_segment, "width_per_segment", "must be positive and at most the bits")
        self.size = self.bits_per_segment * (8 if self.ipv6 else 4)

    def _runs(self, segments: list[Column], top: float) -> Column:
        return joined(*[run(s / F.lit(top), self.bits_per_segment, self.width_per_segment, k * self.bits_per_segment) for k, s in enumerate(segments)])

    def encode(self, address: Column) -> Column:
        octets = [F.try_element_at(F.split(address, r"\."), F.lit(k + 1)).try_cast("double") for k in range(4)]
        v4 = self._runs(octets + [F.lit(0.0)] * (4 if self.ipv6 else 0), 65535.0 if self.narrow_v4 and self.ipv6 else 255.0)
        is_v4 = address.rlike(_V4)
        if not self.ipv6:
            return self.within(is_v4, v4, "not an IPv4 address")

        def groups(column):
            out = []
            for a in column:
                try:
                    number = int(ipaddress.IPv6Address(a))
                    out.append([number >> 16 * (7 - k) & 0xFFFF for k in range(8)])
                except (ValueError, TypeError):
                    out.append(None)
            return out

        @F.pandas_udf(BITS)
        def parsed(column: pd.Series) -> pd.Series:
            return pd.Series(groups(column), dtype=object)

        of_v6 = parsed(address)
        v6 = self._runs([F.get(of_v6, F.lit(k)).cast("double") for k in range(8)], 65535.0)
        return F.when(is_v4, v4).otherwise(self.within(F.when(address.isNotNull(), of_v6.isNotNull()), v6, "not an IP address"))


@dataclass
class MacAddressEncoder(Encoder):
    """A run per octet, and hashed bits of the maker's prefix (the first three octets)."""

    bits_per_octet: int = 32
    width_per_octet: int = 8
    oui_bits: int = 64
    oui_width: int = 16
    strict: bool = True

    def __post_init__(self):
        require(0 < self.width_per_octet <= self.bits_per_octet and 0 < self.oui_width <= self.oui_bits, "width", "must be positive and at most the bits")
        self.size = 6 * self.bits_per_octet + self.oui_bits

    @staticmethod
    def octet(mac: Column, k: int) -> Column:
        return F.conv(F.substring(mac, 3 * k + 1, 2), 16, 10).cast("int")

    @classmethod
    def is_multicast(cls, mac: Column) -> Column:
        return cls.octet(mac, 0).bitwiseAND(1) == 1

    @classmethod
    def is_local(cls, mac: Column) -> Column:
        return cls.octet(mac, 0).bitwiseAND(2) == 2

    def encode(self, mac: Column) -> Column:
        at = 6 * self.bits_per_octet

        def oui(column):
            known = {p: [at + b for b in lcg_pick(fnv(bytes.fromhex(p)), self.oui_width, self.oui_bits)] for p in column.dropna().unique()}
            return [known.get(p) for p in column]

        good = mac.rlike(r"^[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}$")
        prefix = F.when(good, F.lower(F.regexp_replace(F.substring(mac, 1, 8), "[:-]", "")))
        runs = [run(self.octet(mac, k) / F.lit(255.0), self.bits_per_octet, self.width_per_octet, k * self.bits_per_octet) for k in range(6)]
        return self.within(good, joined(*runs, bits_udf(oui)(prefix)), "not a MAC address")
