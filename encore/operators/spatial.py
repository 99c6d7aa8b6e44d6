"""Radius search with many centres (JN7): every (point, centre) pair within the centre's
radius, by an equi-join on geohash cells.

A centre's circle is covered by geohash cells of a precision whose cells are at least as
wide and high as the circle's half box, so nine cells cover it, also across the date line
and the poles (there the cells are larger, up to the whole globe).  A point has one cell at
each precision that some centre uses (twelve at most).  Points and covers meet on
(precision, cell) and the great-circle distance is verified, so a pair comes out once.

The covers are broadcast only if counted to be few; beyond that the join is by shuffle, and
cells that hold more than a partition's share of the points are split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.constants import EARTH_RADIUS, EVENT_RADIUS_UNIT
from encore.functions.geo import geohash_bits, geohash_cell, haversine
from encore.operators.ranking import split_join
from encore.session import stored

#: Finest cells used; circles under some metres fall into them as well.
MAX_PRECISION = 12
#: Degrees added around a circle's box against rounding.
SLACK = 1e-9


def box_of(lat: Column, radius: Column, unit: str) -> tuple[Column, Column]:
    """Half height and half width in degrees of the box around a circle; 180 wide where
    the circle holds a pole."""
    angle = radius / F.lit(EARTH_RADIUS[unit])
    high = F.degrees(angle) + F.lit(SLACK)
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians(lat))))) + F.lit(SLACK)
    return high, F.when((lat + high >= 90) | (lat - high <= -90), F.lit(180.0)).otherwise(wide)


def covered(centres: DataFrame, lat: str, lon: str, radius: str, unit: str) -> DataFrame:
    """``centres`` with one row for each cell (``_level``, ``_cell``) of its circle."""
    high, wide = box_of(F.col(lat), F.col(radius), unit)
    sized = centres.withColumns({"_high": high, "_wide": wide})
    level = F.lit(0)
    for p in range(1, MAX_PRECISION + 1):
        a, b = geohash_bits(p)
        level = F.when((F.col("_high") <= 180.0 / (1 << a)) & (F.col("_wide") <= 360.0 / (1 << b)), F.lit(p)).otherwise(level)
    rows_, cols_ = F.lit(1), F.lit(1)
    for p in range(1, MAX_PRECISION + 1):
        a, b = geohash_bits(p)
        rows_ = F.when(F.col("_level") == p, F.lit(1 << a)).otherwise(rows_)
        cols_ = F.when(F.col("_level") == p, F.lit(1 << b)).otherwise(cols_)

    def cell(value, n, lo, span):
        return F.floor((value - F.lit(lo)) / F.lit(span) * n).cast("long")

    sized = sized.withColumn("_level", level).withColumns({"_rows": rows_.cast("long"), "_cols": cols_.cast("long")})
    low = F.greatest(cell(F.col(lat) - F.col("_high"), F.col("_rows"), -90.0, 180.0), F.lit(0))
    top = F.least(cell(F.col(lat) + F.col("_high"), F.col("_rows"), -90.0, 180.0), F.col("_rows") - 1)
    west = cell(F.col(lon) - F.col("_wide"), F.col("_cols"), -180.0, 360.0)
    east = F.least(cell(F.col(lon) + F.col("_wide"), F.col("_cols"), -180.0, 360.0), west + F.col("_cols") - 1)
    return (sized.withColumn("_row", F.explode(F.sequence(low, top)))
            .withColumn("_col", F.explode(F.sequence(west, east)))
            .withColumn("_cell", F.col("_row") * F.col("_cols") + F.pmod(F.col("_col"), F.col("_cols")))
            .drop("_high", "_wide", "_rows", "_cols", "_row", "_col"))


def near_centres(points: DataFrame, centres: DataFrame, on=(), unit: str = EVENT_RADIUS_UNIT,
                 lat: str = "latitude", lon: str = "longitude", centre_lat: str = "centre_latitude",
                 centre_lon: str = "centre_longitude", radius: str = "radius") -> DataFrame:
    """JN7: every point with every centre within the centre's radius (and equal in the
    columns ``on``), with the columns of both and ``distance``.

    Points and centres without coordinates, or with ones that are not finite or lie off
    the globe, meet nothing, nor do centres with a radius that is NULL or negative; equal
    rows stay apart; empty tables give no rows."""
    def on_globe(a, b):
        return F.col(a).between(-90, 90) & F.col(b).between(-180, 180)  # NaN is above all

    on = list(on)
    cover = stored(covered(centres.where(on_globe(centre_lat, centre_lon) & (F.col(radius) >= 0)
                                              & (F.col(radius) < math.inf)),
                           centre_lat, centre_lon, radius, unit), "covers")
    levels = sorted(r[0] for r in cover.select("_level").distinct().collect())  # at most 13
    cells = F.array(*[F.struct(F.lit(p).alias("_level"), geohash_cell(F.col(lat), F.col(lon), p).alias("_cell"))
                      for p in levels] or [F.struct(F.lit(-1).alias("_level"), F.lit(0).cast("long").alias("_cell"))])
    placed = (points.where(on_globe(lat, lon)).withColumn("_at", F.explode(cells))
              .withColumns({"_level": F.col("_at._level"), "_cell": F.col("_at._cell")}).drop("_at"))
    met = split_join(placed, cover, [*on, "_level", "_cell"])
    return (met.withColumn("distance", haversine(lat, lon, F.col(centre_lat), F.col(centre_lon), unit))
            .where(F.col("distance") <= F.col(radius)).drop("_level", "_cell"))
