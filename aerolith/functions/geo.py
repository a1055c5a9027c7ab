"""Great-circle distance, cells and shapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NM_RADIUS, M_RADIUS = 3440.065, 6_371_000.0
CRUISE_KT, OVERHEAD_MIN = 450.0, 35.0


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine(lat1, lon1, lat2, lon2, radius: float = NM_RADIUS) -> Column:
    """Distance in the unit of ``radius``; null if a coordinate is null."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # rounding may leave a just outside 0..1; least() alone would skip a null
    return F.when(a.isNotNull(), F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


def expected_minutes(distance_nm, cruise_kt: float = CRUISE_KT, overhead: float = OVERHEAD_MIN) -> Column:
    return col(distance_nm) / cruise_kt * 60 + overhead


def heading_sector(heading) -> Column:
    """45-degree sector 0..7."""
    return F.floor(F.pmod(col(heading), F.lit(360)) / 45).cast("int")


def cell(x) -> Column:
    """Whole degree at or below ``x``."""
    return F.floor(col(x)).cast("int")


def point(lat, lon) -> Column:
    """GeoJSON point, null without both coordinates."""
    lat, lon = col(lat), col(lon)
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def drop_repeats(trail) -> Column:
    """``trail`` (lat, lon structs) without points equal to the one before."""
    trail = col(trail)
    before = lambda i: F.get(trail, i - 1)
    return F.filter(trail, lambda x, i: (i == 0) | (x["lat"] != before(i)["lat"]) | (x["lon"] != before(i)["lon"]))


def line(trail) -> Column:
    """GeoJSON line through the points of ``trail`` without repeats; null with fewer than two."""
    points = drop_repeats(trail)
    return F.when(F.size(points) >= 2, F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda x: F.array(x["lon"], x["lat"])).alias("coordinates")))


def in_bbox(df: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    """Rows inside the box, edges included; the box itself is validated here."""
    if not (-90 <= lat_min <= lat_max <= 90 and -180 <= lon_min <= lon_max <= 180):
        raise ValueError("a box needs -90 <= lat_min <= lat_max <= 90 and -180 <= lon_min <= lon_max <= 180")
    return df.filter(F.col("lat").between(lat_min, lat_max) & F.col("lon").between(lon_min, lon_max))
