"""Points, geohashes, the Dutch grid."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The geohash alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def parse_point(c: Column) -> Column:
    """struct(lat, lon) of "lat,lon"; null unless both are numbers on the globe."""
    lat, lon = (F.trim(F.split_part(c, F.lit(","), F.lit(k))).try_cast("double") for k in (1, 2))
    good = c.rlike("^[^,]*,[^,]*$") & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))


def _cell(value: Column, low: float, high: float, bits: int) -> Column:
    """Number of the interval after that many halvings; a value at a midpoint stays below it."""
    scaled = (value - F.lit(low)) / F.lit(high - low) * F.lit(float(1 << bits))
    return F.least(F.greatest(F.ceil(scaled).cast("long") - 1, F.lit(0)), F.lit((1 << bits) - 1)).cast("long")


def geohash_encode(lat: Column, lon: Column, n: int) -> Column:
    """Geohash of n characters, by arithmetic on the two cell numbers."""
    bits = 5 * n
    x, y = _cell(lon, -180.0, 180.0, (bits + 1) // 2), _cell(lat, -90.0, 90.0, bits // 2)
    out = []
    for k in range(n):
        code = F.lit(0).cast("long")
        for b in range(5 * k, 5 * k + 5):  # even bits are of the longitude
            source, shift = (x, (bits + 1) // 2 - 1 - b // 2) if b % 2 == 0 else (y, bits // 2 - 1 - b // 2)
            code = code * 2 + F.shiftright(source, shift).bitwiseAND(F.lit(1))
        out.append(F.substring(F.lit(ALPHABET), code.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def geohash_decode_exactly(c: Column, n: int) -> Column:
    """struct(lat, lon, lat_err, lon_err) of a geohash of n characters: the middle of its cell and half its sides."""
    bits = 5 * n
    x, y = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(n):
        code = F.instr(F.lit(ALPHABET), F.substring(c, k + 1, 1)) - 1
        for b in range(5):
            bit = F.shiftright(code.cast("long"), 4 - b).bitwiseAND(F.lit(1))
            if (5 * k + b) % 2 == 0:
                x = x * 2 + bit
            else:
                y = y * 2 + bit
    width, height = 360.0 / (1 << (bits + 1) // 2), 180.0 / (1 << bits // 2)
    return F.struct(((y + 0.5) * height - 90).alias("lat"), ((x + 0.5) * width - 180).alias("lon"), F.lit(height / 2).alias("lat_err"), F.lit(width / 2).alias("lon_err"))


def geohash_decode(c: Column, n: int) -> Column:
    """struct(lat, lon), rounded to the digits that the cell's size warrants."""
    cell = geohash_decode_exactly(c, n)
    bits = 5 * n
    digits = [max(1, round(-math.log10(side / 2))) - 1 for side in (180.0 / (1 << bits // 2), 360.0 / (1 << (bits + 1) // 2))]
    return F.struct(F.round(cell["lat"], digits[0]).alias("lat"), F.round(cell["lon"], digits[1]).alias("lon"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


# Published coefficients of the approximation of the Dutch grid around Amersfoort, in units of 100 km and seconds.
_LAT = {(0, 1): 3235.65389, (2, 0): -32.58297, (0, 2): -0.24750, (2, 1): -0.84978, (0, 3): -0.06550, (2, 2): -0.01709, (1, 0): -0.00738, (4, 0): 0.00530, (2, 3): -0.00039, (4, 1): 0.00033, (1, 1): -0.00012}
_LON = {(1, 0): 5260.52916, (1, 1): 105.94684, (1, 2): 2.45656, (3, 0): -0.81885, (1, 3): 0.05594, (3, 1): -0.05607, (0, 1): 0.01199, (3, 2): -0.00256, (1, 4): 0.00128, (0, 2): 0.00022, (2, 0): -0.00022, (5, 0): 0.00026}


def rd_to_wgs84(x: Column, y: Column) -> Column:
    """struct(lon, lat) of a point of the Dutch grid, rounded up to 6 decimals."""
    dx, dy = (x - 155000.0) / 100000.0, (y - 463000.0) / 100000.0
    series = lambda terms: reduce(lambda a, b: a + b, [F.lit(c) * F.pow(dx, F.lit(p)) * F.pow(dy, F.lit(q)) for (p, q), c in terms.items()])
    up = lambda c: F.ceil(c * 1e6) / F.lit(1e6)
    return F.struct(up(F.lit(5.38720621) + series(_LON) / 3600).alias("lon"), up(F.lit(52.15517440) + series(_LAT) / 3600).alias("lat"))


def parse_bbox(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """struct(min_lat, min_lon, max_lat, max_lon): all with a point are degrees (x is the latitude), none are of the grid, else null."""
    sides = [min_x, min_y, max_x, max_y]
    dots = [c.contains(".") for c in sides]
    every, none = reduce(lambda a, b: a & b, dots), ~reduce(lambda a, b: a | b, dots)
    number = [c.try_cast("double") for c in sides]
    low, high = rd_to_wgs84(number[0], number[1]), rd_to_wgs84(number[2], number[3])
    box = lambda a, b, c, d: F.struct(a.alias("min_lat"), b.alias("min_lon"), c.alias("max_lat"), d.alias("max_lon"))
    return F.when(every, box(*number)).when(none, box(low["lat"], low["lon"], high["lat"], high["lon"]))
