"""Geography as column expressions: geohash cells, distances, polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The geohash alphabet (fixed value).
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_M = 6_371_000.0
DEGREE_M = 111_320.0
DEGREE_LAT_M = 110_540.0


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def pinned(df, **columns: Column):
    """Adds columns that later steps refer to by name and don't evaluate again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _bits(precision: int) -> tuple[int, int]:
    return (5 * precision + 1) // 2, 5 * precision // 2


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """The geohash cell of a point: both coordinates quantised, their bits interleaved from longitude on."""
    of_lon, of_lat = _bits(precision)
    x = F.least(F.floor((lon + 180) / 360 * (1 << of_lon)), F.lit((1 << of_lon) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * (1 << of_lat)), F.lit((1 << of_lat) - 1)).cast("long")
    chars = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for k in range(5):
            at = 5 * c + k
            source, shift = (y, of_lat - 1 - at // 2) if at % 2 else (x, of_lon - 1 - at // 2)
            value = value + F.shiftleft(F.shiftright(source, shift).bitwiseAND(1), 4 - k)
        chars.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def box_ranges(lat_lo: float, lat_hi: float, lon_lo: float, lon_hi: float, precision: int = 7, most: int = 32) -> list[tuple[str, str]]:
    """Ranges (first and last cell) that hold every geohash of a point in the box: at most ``most``, neighbours joined.

    Cells are in the order of their interleaved bits. Regions are halved bit by bit, the widest first; those inside the box are
    kept whole, and those on its border too when no more ranges are allowed. So ranges may hold more than the box, never less.
    """
    wanted, bits, slack = ((lat_lo, lat_hi), (lon_lo, lon_hi)), 5 * precision, 1e-9
    whole: list[tuple[int, int]] = []
    border = [(0, 0, ((-90.0, 90.0), (-180.0, 180.0)))]
    while border and len(whole) + len(border) < most:
        prefix, depth, sides = border.pop(0)
        axis = 1 - depth % 2
        lo, hi = sides[axis]
        for bit, part in ((0, (lo, (lo + hi) / 2)), (1, ((lo + hi) / 2, hi))):
            now = (part, sides[1]) if axis == 0 else (sides[0], part)
            if any(have[1] < want[0] - slack or have[0] > want[1] + slack for have, want in zip(now, wanted, strict=True)):
                continue
            inside = all(have[0] >= want[0] and have[1] <= want[1] for have, want in zip(now, wanted, strict=True))
            if inside or depth + 1 == bits:
                whole.append((prefix * 2 + bit, depth + 1))
            else:
                border.append((prefix * 2 + bit, depth + 1, now))
    spans = sorted((p << (bits - d), ((p + 1) << (bits - d)) - 1) for p, d in whole + [(p, d) for p, d, _ in border])
    joined: list[list[int]] = []
    for first, last in spans:
        if joined and first == joined[-1][1] + 1:
            joined[-1][1] = last
        else:
            joined.append([first, last])
    text = lambda n: "".join(BASE32[n >> 5 * (precision - 1 - c) & 31] for c in range(precision))
    return [(text(first), text(last)) for first, last in joined]


def geohash_box(cell: Column, precision: int) -> Column:
    """A struct lat_lo, lat_hi, lon_lo, lon_hi of a cell of known length."""
    of_lon, of_lat = _bits(precision)
    x = y = F.lit(0).cast("long")
    for c in range(precision):
        value = F.instr(F.lit(BASE32), F.substring(cell, c + 1, 1)) - 1
        for k in range(5):
            bit = F.shiftright(value, 4 - k).bitwiseAND(1).cast("long")
            if (5 * c + k) % 2:
                y = y * 2 + bit
            else:
                x = x * 2 + bit
    lat, lon = 180.0 / (1 << of_lat), 360.0 / (1 << of_lon)
    return F.struct((y * lat - 90).alias("lat_lo"), ((y + 1) * lat - 90).alias("lat_hi"), (x * lon - 180).alias("lon_lo"), ((x + 1) * lon - 180).alias("lon_hi"))


def cell_centre(cell: Column, precision: int) -> Column:
    """A struct lat, lon of the middle of a cell."""
    return let(geohash_box(cell, precision), lambda box: F.struct(((box["lat_lo"] + box["lat_hi"]) / 2).alias("lat"), ((box["lon_lo"] + box["lon_hi"]) / 2).alias("lon")))


def neighbours(cell: Column, precision: int) -> Column:
    """The eight cells around a cell, from south-west to north-east."""
    of_lon, of_lat = _bits(precision)
    steps = F.array(*[F.struct(F.lit(i * 180.0 / (1 << of_lat)).alias("lat"), F.lit(j * 360.0 / (1 << of_lon)).alias("lon")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    return let(cell_centre(cell, precision), lambda c: F.transform(steps, lambda s: geohash(c["lat"] + s["lat"], c["lon"] + s["lon"], precision)))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(_lit(lat1)), F.radians(_lit(lat2))
    s, t = F.sin((p2 - p1) / 2), F.sin(F.radians(_lit(lon2) - _lit(lon1)) / 2)
    return 2 * EARTH_M * F.asin(F.sqrt(s * s + F.cos(p1) * F.cos(p2) * t * t))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first to the second point, 0 to 360."""
    p1, p2 = F.radians(_lit(lat1)), F.radians(_lit(lat2))
    dl = F.radians(_lit(lon2) - _lit(lon1))
    east, north = F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def offset(lat, lon, north_m, east_m) -> Column:
    """A struct lat, lon of the point so many metres north and east."""
    lat, lon = _lit(lat), _lit(lon)
    return F.struct((lat + _lit(north_m) / DEGREE_M).alias("lat"), (lon + _lit(east_m) / (DEGREE_M * F.cos(F.radians(lat)))).alias("lon"))


def circle(lat, lon, radius_m: float, sides: int = 32) -> Column:
    """A ring of ``sides`` points around a centre, from north over east."""
    angles = [2 * math.pi * k / sides for k in range(sides)]
    return F.array(*[offset(lat, lon, radius_m * math.cos(a), radius_m * math.sin(a)) for a in angles])


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a ray from the point to the east crosses the open ring an odd number of times; an empty ring holds nothing."""

    def crosses(a: Column, b: Column) -> Column:
        at = a["lon"] + (lat - a["lat"]) * (b["lon"] - a["lon"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        return F.coalesce(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < at), F.lit(False))

    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, shifted, crosses), F.lit(False), lambda odd, c: odd != c)


def ring_from_geojson(text: Column) -> Column:
    """The outer ring of a GeoJSON polygon as (lat, lon) points, without the closing point."""
    points = F.from_json(text, "type string, coordinates array<array<array<double>>>")["coordinates"][0]
    ring = F.transform(points, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    return F.slice(ring, 1, F.size(ring) - 1)


def ring_to_geojson(ring: Column) -> Column:
    """A ring as GeoJSON text, closed."""
    points = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(p["lon"], p["lat"]))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates")))


def heading_difference(a: Column, b: Column) -> Column:
    """The angle between two headings, 0 to 180."""
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def flat_distance_m(lat, lon, to_lat, to_lon) -> Column:
    """Distance on a plane that touches the first point; fine within a city."""
    dx = (_lit(to_lon) - _lit(lon)) * DEGREE_M * F.cos(F.radians(_lit(lat)))
    dy = (_lit(to_lat) - _lit(lat)) * DEGREE_LAT_M
    return F.sqrt(dx * dx + dy * dy)
