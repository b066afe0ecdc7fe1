"""Column functions over string, bitmap and geo values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def get_range(value: Column, start: int, end: int) -> Column:
    """GETRANGE/SUBSTR: an inclusive range of bytes, negative places from the end."""
    held, n = value.cast("binary"), F.octet_length(value)
    a = F.greatest(n + start, F.lit(0)) if start < 0 else F.lit(start)
    b = n + end if end < 0 else F.least(F.lit(end), n - 1)
    return F.when((a > b) | (a >= n), F.lit("")).otherwise(F.substr(held, a + 1, b - a + 1).cast("string"))


def set_range(value: Column, at: int, part: str) -> Column:
    """SETRANGE: overwrite bytes from a place on, padded with NUL where the value is shorter."""
    v = F.coalesce(value, F.lit(""))
    if not part:
        return v
    n, new = F.octet_length(v), part.encode()
    padded = F.when(n < at, F.concat(v, F.repeat(F.lit("\0"), F.lit(at) - n))).otherwise(v).cast("binary")
    return F.concat(F.substring(padded, 1, at), F.lit(new), F.substr(padded, F.lit(at + len(new) + 1), F.greatest(n, F.lit(1)))).cast("string")


def incr_by(value: Column, by: int) -> Column:
    """INCRBY: checked 64-bit addition; null on overflow or where the value is no integer."""
    return F.try_add(value.try_cast("bigint"), F.lit(by).cast("bigint"))


def glob(pattern: str) -> str:
    """A glob of * ? [set] and backslash as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[\\s\\S]*"
        elif c == "?":
            out += "[\\s\\S]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i + 1 : j]
            negated = body[:1] == "^"
            out += "[" + "^" * negated + body[negated:].replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = j
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out += c if c.isalnum() else f"\\{c}"
        i += 1
    return f"^{out}$"


def matches(value: Column, pattern: str) -> Column:
    return value.rlike(glob(pattern))


def bit_count(value: Column) -> Column:
    """BITCOUNT of a string's bytes, from the hexadecimal digits."""
    digits = F.split(F.hex(value.cast("binary")), "")
    ones = F.transform(digits, lambda d: F.when(d == "", 0).otherwise(F.bit_count(F.conv(d, 16, 10).cast("int"))))
    return F.aggregate(ones, F.lit(0), lambda a, x: a + x).cast("long")


def get_bit(value: Column, at: Column | int) -> Column:
    """GETBIT, most significant bit of a byte first; 0 past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    byte = F.conv(F.substr(F.hex(value.cast("binary")), F.floor(at / 8).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.coalesce((byte / F.pow(F.lit(2.0), 7 - at % 8)).cast("int") % 2, F.lit(0))


def bit_pos(value: Column, bit: int) -> Column:
    """BITPOS: the first place of a bit, -1 if there is none."""
    bits = F.array_join(F.transform(F.split(F.hex(value.cast("binary")), ""), lambda d: F.when(d == "", "").otherwise(F.lpad(F.conv(d, 16, 2), 4, "0"))), "")
    return F.instr(bits, str(bit)) - 1


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """GEODIST."""
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2.0 * EARTH_M * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v)) / UNITS[unit]


def geo_score(lon: Column, lat: Column, lat_max: float = 85.05112878) -> Column:
    """GEOADD: the 52-bit number of interleaved longitude and latitude bits."""
    x = F.floor((lon + 180.0) / 360.0 * (1 << 26)).cast("long")
    y = F.floor((lat + lat_max) / (2 * lat_max) * (1 << 26)).cast("long")
    return _spread(y).bitwiseOR(F.shiftleft(_spread(x), 1))


def _spread(c: Column) -> Column:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def geo_position(score: Column, lat_max: float = 85.05112878) -> Column:
    """GEOPOS: the middle of the score's cell, as lon and lat."""

    def squash(c: Column) -> Column:
        c = c.bitwiseAND(F.lit(0x5555555555555555))
        for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
            c = c.bitwiseOR(F.shiftright(c, shift)).bitwiseAND(F.lit(mask))
        return c

    lon = (squash(F.shiftright(score, 1)) + 0.5) / (1 << 26) * 360.0 - 180.0
    lat = (squash(score) + 0.5) / (1 << 26) * (2 * lat_max) - lat_max
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def geohash(lon: Column, lat: Column) -> Column:
    """GEOHASH: 11 characters of the standard hash, the last always 0."""
    score = geo_score(lon, lat, 90.0)
    letters = F.array(*[F.lit(c) for c in BASE32])
    return F.concat(*[F.get(letters, F.shiftright(score, 52 - 5 * (i + 1)).bitwiseAND(F.lit(31)).cast("int")) for i in range(10)], F.lit("0"))


def in_bounds(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a place lies in a box of bounds(), which may go beyond 180 degrees to either side."""
    west, south, east, north = box
    across = F.lit(False)
    if west < -180:
        across = lon >= west + 360
    if east > 180:
        across = across | (lon <= east - 360)
    return lat.between(south, north) & (lon.between(west, east) | across)


def in_rectangle(lon: Column, lat: Column, at: tuple[float, float], width_m: float, height_m: float) -> Column:
    """GEOSEARCH BYBOX: both the way along the place's parallel and the way along its meridian are within half a side."""
    along = haversine(lon, lat, F.lit(at[0]), lat)
    up = haversine(F.lit(at[0]), lat, F.lit(at[0]), F.lit(at[1]))
    return (along <= width_m / 2) & (up <= height_m / 2)


def bounds(lon: float, lat: float, radius_m: float) -> tuple[float, float, float, float]:
    """A box (west, south, east, north) that holds the circle, for a filter that reaches the scan; see in_bounds()."""
    d = math.degrees(radius_m / EARTH_M)
    w = 180.0 if abs(lat) + d >= 90 else math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(lat)))))
    return lon - w, lat - d, lon + w, lat + d
