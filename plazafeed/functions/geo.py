"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6371000.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def to_segment_m(lat: Column, lng: Column, alat: Column, alng: Column, blat: Column, blng: Column) -> Column:
    """From a point to the nearest point of a segment, on a plane laid at the point."""
    k = F.cos(F.radians(lat))
    x = lambda g: F.radians(g - lng) * k * EARTH_M
    y = lambda g: F.radians(g - lat) * EARTH_M
    ax, ay, bx, by = x(alng), y(alat), x(blng), y(blat)
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    u = F.when(long2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.when(long2 == 0, 1.0).otherwise(long2))))
    return F.sqrt(F.pow(ax + u * dx, 2) + F.pow(ay + u * dy, 2))


def to_line_m(lat: Column, lng: Column, alat: Column, alng: Column, blat: Column, blng: Column) -> Column:
    """From a point to the line through a segment, on the same plane: no more than ``to_segment_m``, and cheaper. Points at one place make no line: 0."""
    k = F.cos(F.radians(lat))
    cross = (alng - lng) * (blat - alat) - (alat - lat) * (blng - alng)
    return F.abs(cross) * k * EARTH_M / F.greatest(F.degrees(F.hypot((blng - alng) * k, blat - alat)), F.lit(1e-9))


def with_segment_m(pairs: DataFrame, name: str) -> DataFrame:
    """``pairs(lat, lng, a_lat, a_lng, b_lat, b_lng, ..)`` with ``to_segment_m`` as ``name`` in place of these, each step made once."""
    own = ["lat", "lng", *(f"{x}_{y}" for x in "ab" for y in ("lat", "lng"))]
    rest, c = [x for x in pairs.columns if x not in own], F.col
    p = pairs.withColumn("_k", F.cos(F.radians("lat")))
    p = p.select(*rest, *[(F.radians(c(f"{e}_lng") - c("lng")) * c("_k") * EARTH_M).alias(f"_{e}x") for e in "ab"], *[(F.radians(c(f"{e}_lat") - c("lat")) * EARTH_M).alias(f"_{e}y") for e in "ab"])
    p = p.withColumns({"_dx": c("_bx") - c("_ax"), "_dy": c("_by") - c("_ay")})
    p = p.withColumn("_l", c("_dx") * c("_dx") + c("_dy") * c("_dy"))
    u = F.when(c("_l") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(c("_ax") * c("_dx") + c("_ay") * c("_dy")) / F.when(c("_l") == 0, 1.0).otherwise(c("_l")))))
    return p.withColumn("_u", u).select(*rest, F.sqrt(F.pow(c("_ax") + c("_u") * c("_dx"), 2) + F.pow(c("_ay") + c("_u") * c("_dy"), 2)).alias(name))


def distance_label(m: Column) -> Column:
    """Whole metres to the next ten below a kilometre, else kilometres with one decimal."""
    return F.when(m < 1000, F.concat((F.round(m / 10) * 10).cast("int").cast("string"), F.lit(" м"))).otherwise(F.concat(F.format_number(m / 1000, 1), F.lit(" км")))
