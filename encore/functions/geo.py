"""Geohash cells and codes, and great-circle distance, as parameters and as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from encore.constants import EARTH_RADIUS

# fixed values: the geohash base-32 alphabet
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash_centre(code: str) -> tuple[float, float]:
    """Centre (lat, lon) of a geohash cell; used on the search parameter only."""
    lat, lon = [-90.0, 90.0], [-180.0, 180.0]
    even = True
    for ch in code.lower():
        bits = _BASE32.index(ch)
        for shift in range(4, -1, -1):
            rng = lon if even else lat
            mid = (rng[0] + rng[1]) / 2
            if (bits >> shift) & 1:
                rng[0] = mid
            else:
                rng[1] = mid
            even = not even
    return (lat[0] + lat[1]) / 2, (lon[0] + lon[1]) / 2


def geohash_bits(precision: int) -> tuple[int, int]:
    """Bits of latitude and longitude in a geohash of ``precision`` characters; the
    longitude comes first."""
    return 5 * precision // 2, (5 * precision + 1) // 2


def _axis(value: Column, lo: float, span: float, bits: int) -> Column:
    """Number of the cell that holds ``value`` on an axis cut into 2**bits cells."""
    at = F.floor((value - F.lit(lo)) / F.lit(span) * F.lit(float(1 << bits)))
    return F.when(value.isNotNull(), F.greatest(F.least(at, F.lit((1 << bits) - 1)), F.lit(0)).cast("long"))


def geohash_cell(lat: Column, lon: Column, precision: int) -> Column:
    """The geohash cell of a point as one number: row times columns plus column."""
    a, b = geohash_bits(precision)
    return (_axis(lat, -90.0, 180.0, a) * F.lit(1 << b) + _axis(lon, -180.0, 360.0, b)).cast("long")


def geohash_code(lat: Column, lon: Column, precision: int) -> Column:
    """Geohash of a point, ``precision`` (at most 12) characters; NULL without a point."""
    a, b = geohash_bits(precision)
    row, col = _axis(lat, -90.0, 180.0, a), _axis(lon, -180.0, 360.0, b)
    chars = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for i in range(5 * c, 5 * c + 5):  # bits alternate, longitude first
            own, left = (col, b - 1 - i // 2) if i % 2 == 0 else (row, a - 1 - i // 2)
            value = value * 2 + F.shiftright(own, left).bitwiseAND(F.lit(1))
        chars.append(F.substr(F.lit(_BASE32), value.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)


def geohash_point(code: Column) -> Column:
    """Centre of a geohash as struct<latitude, longitude>; NULL for NULL, for an empty
    code and for one with other characters."""
    digit = F.transform(F.split(F.lower(code), ""), lambda c: F.instr(F.lit(_BASE32), c) - 1)

    def step(state, d):
        def bits(*places):
            out = F.lit(0).cast("long")
            for p in places:
                out = out * 2 + F.shiftright(d, p).bitwiseAND(F.lit(1))
            return out
        even = state["n"] % 2 == 0  # five bits: three to the axis that is due, two to the other
        first, second = bits(4, 2, 0), bits(3, 1)
        return F.struct(
            (state["n"] + 1).alias("n"),
            F.when(even, state["lon"] * 8 + first).otherwise(state["lon"] * 4 + second).alias("lon"),
            F.when(even, state["lat"] * 4 + second).otherwise(state["lat"] * 8 + first).alias("lat"))

    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("n"), zero.alias("lon"), zero.alias("lat"))

    def centre(s):
        lat_cells = F.pow(F.lit(2.0), F.floor(s["n"] * 5 / 2))
        lon_cells = F.pow(F.lit(2.0), F.ceil(s["n"] * 5 / 2))
        return F.struct(((s["lat"] + 0.5) * 180.0 / lat_cells - 90.0).alias("latitude"),
                        ((s["lon"] + 0.5) * 360.0 / lon_cells - 180.0).alias("longitude"))

    return F.when((F.length(code) > 0) & F.forall(digit, lambda d: d >= 0), F.aggregate(digit, start, step, centre))


def haversine(lat1, lon1, lat2, lon2, unit: str = "miles") -> Column:
    """Great-circle distance between two points (degrees) as a column expression."""
    def c(x):
        return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(float(x)))
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dphi = p2 - p1
    dl = F.radians(c(lon2)) - F.radians(c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_RADIUS[unit]) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_py(lat1, lon1, lat2, lon2, unit: str = "miles") -> float:
    """Scalar twin of :func:`haversine` for tests."""
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = (math.sin((p2 - p1) / 2) ** 2
         + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2)
    return 2 * EARTH_RADIUS[unit] * math.asin(min(1.0, math.sqrt(a)))
