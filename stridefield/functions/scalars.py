"""Scalar formulas of wayfinding as Column expressions; no shuffle, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii in feet, metres, kilometres
RADIUS_FT, RADIUS_M, RADIUS_KM = 20_925_524.9, 6_371_000.0, 6_371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_M) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    # least() skips nulls, so a missing coordinate is kept null by the test
    return F.when(a.isNotNull(), F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def walking_time(metres: Column) -> Column:
    """Seconds at 1.4 m/s."""
    return metres / F.lit(1.4)


def outdoor_travel_time(metres: Column, bike: Column) -> Column:
    return metres / F.when(bike, F.lit(5.0)).otherwise(F.lit(1.4))


def planar_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.hypot((lon2 - lon1) * 87700.0, (lat2 - lat1) * 111320.0)


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x2 - x1) + F.abs(y2 - y1)


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.atan2(y2 - y1, x2 - x1)


def wind_adjustment(speed: Column, direction: Column, bearing_rad: Column, mode: str = "intended") -> Column:
    """0 below 5 mph, else half the wind's part along the segment; ``as_written`` takes the bearing's radians from degrees."""
    angle = F.radians(direction - bearing_rad) if mode == "as_written" else F.radians(direction) - bearing_rad
    return F.when(speed < 5, F.lit(0.0)).otherwise(0.5 * speed * F.cos(angle))


def rain_slowdown(inches: Column, mode: str = "intended") -> Column:
    """Share of speed lost by inches of rain; ``as_written`` gives 0.5 under 0.01 inches and 0 from there on."""
    if mode == "as_written":
        return F.when(inches < 0.01, 0.5).otherwise(0.0)
    return (
        F.when(inches < 0.01, 0.0).when(inches <= 0.1, 0.1).when(inches <= 0.3, 0.2).when(inches <= 2, 0.3).otherwise(0.5)
    )


def format_travel_time(seconds: Column) -> Column:
    """"M min S sec", or "S sec" under a minute."""
    whole = F.floor(seconds).cast("long")
    minutes, rest = F.floor(whole / 60).cast("long"), whole % 60
    return F.when(minutes > 0, F.concat_ws(" ", minutes.cast("string"), F.lit("min"), rest.cast("string"), F.lit("sec"))).otherwise(
        F.concat_ws(" ", rest.cast("string"), F.lit("sec"))
    )


def orientation(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees of the undirected segment, in [0, 180)."""
    return F.pmod(F.degrees(bearing(x1, y1, x2, y2)), F.lit(180.0))


def orientation_rgb(degrees: Column) -> Column:
    """red, green, blue in 0..1: red at 0 and 180, blue at 90, in steps of 1/255."""
    blue = F.floor(255 * (1 - F.abs(degrees - 90.0) / 90.0)) / 255.0
    red = F.floor(255 * F.abs(degrees - 90.0) / 90.0) / 255.0
    return F.struct(red.alias("red"), F.lit(0.0).alias("green"), blue.alias("blue"))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return utm_zone(lon) + F.when(lat >= 0, 32600).otherwise(32700)


def utm_project(lon: Column, lat: Column, zone: Column) -> Column:
    """easting, northing in metres on WGS84 by the Krueger series to the fourth order."""
    # Semi-major axis and flattening of WGS84, scale on the meridian
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = k0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280,
    )
    e = 2 * n**0.5 / (1 + n)
    s, away = F.sin(F.radians(lat)), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500000.0 + radius * east).alias("easting"), (F.when(lat < 0, 1e7).otherwise(0.0) + radius * north).alias("northing"))


def rel_to_pixel(rel: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least((rel * size).cast("int"), size - 1))


def rescale_pixel(x: Column, width: Column, new_width: Column) -> Column:
    return (x / width * new_width).cast("int")


def pixel_travel_time(pixels: Column) -> Column:
    return pixels / F.lit(15.0) / F.lit(1.4)


def scale_entrance(x: Column, factor: Column) -> Column:
    """Half-even rounding of x * factor."""
    return F.rint(x * factor).cast("long")
