"""Geography on a sphere: distances in the JVM, GeoJSON shapes in Arrow batches with numpy.

Cell systems, buffers of lines and polygons and the union and intersection of polygons are not there; those functions say so.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.registry import function, unsupported
from sluice.plans.expr import E, as_double, as_string

DOUBLE, BOOL, STRING, VARIANT = T.DoubleType(), T.BooleanType(), T.StringType(), T.VariantType()
RADIUS = 6371008.8  # metres, mean radius of the Earth


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b, c, d = (F.radians(x) for x in (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((d - b) / 2), 2) + F.cos(b) * F.cos(d) * F.pow(F.sin((c - a) / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _valid(*pairs: tuple[Column, Column]) -> Column:
    out = F.lit(True)
    for lon, lat in pairs:
        out = out & lon.between(-180, 180) & lat.between(-90, 90)
    return out


@function("geo_distance_2points", 4)
def _(ctx, args):
    x = [as_double(ctx, a) for a in args]
    return E(F.when(_valid((x[0], x[1]), (x[2], x[3])), haversine(*x)), DOUBLE)


@function("geo_azimuth", 4)
def _(ctx, args):
    """Clockwise from true north, in radians."""
    a, b, c, d = (F.radians(as_double(ctx, x)) for x in args)
    y = F.sin(c - a) * F.cos(d)
    x = F.cos(b) * F.sin(d) - F.sin(b) * F.cos(d) * F.cos(c - a)
    angle = F.atan2(y, x)
    return E(F.when(angle < 0, angle + 2 * math.pi).otherwise(angle), DOUBLE)


@function("geo_angle", 4, 6)
def _(ctx, args):
    """The angle at the Earth's centre between two points, or at the second of three points."""
    x = [as_double(ctx, a) for a in args]
    if len(x) == 4:
        return E(haversine(*x) / RADIUS, DOUBLE)
    a, b, c = haversine(*x[2:4], *x[4:6]) / RADIUS, haversine(*x[0:2], *x[4:6]) / RADIUS, haversine(*x[0:4]) / RADIUS
    return E(F.acos(F.try_divide(F.cos(b) - F.cos(a) * F.cos(c), F.sin(a) * F.sin(c))), DOUBLE)


@function("geo_point_in_circle", 5)
def _(ctx, args):
    x = [as_double(ctx, a) for a in args]
    return E(haversine(*x[:4]) <= x[4], BOOL)


# ---- shapes ---------------------------------------------------------------------------------------------------------


def metres(a, b) -> float:
    lon1, lat1, lon2, lat2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def lines_of(shape: dict) -> list[np.ndarray]:
    c = shape["coordinates"]
    return [np.array(c, float)] if shape["type"] == "LineString" else [np.array(p, float) for p in c]


def rings_of(shape: dict) -> list[list[np.ndarray]]:
    c = shape["coordinates"]
    return [[np.array(r, float) for r in p] for p in (c if shape["type"] == "MultiPolygon" else [c])]


def nearest_on(p, line: np.ndarray) -> tuple[np.ndarray, float]:
    """The nearest place of a line, on the tangent plane at the point."""
    scale = math.cos(math.radians(p[1])) or 1e-9
    best = (line[0], math.inf)
    for a, b in zip(line[:-1], line[1:], strict=True):
        u, w = (b - a) * [scale, 1], (np.array(p) - a) * [scale, 1]
        t = min(1.0, max(0.0, float(u @ w) / (float(u @ u) or 1e-18)))
        q = a + t * (b - a)
        if (d := metres(p, q)) < best[1]:
            best = (q, d)
    return best


def inside(p, rings: list[np.ndarray]) -> bool:
    out = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                out = not out
    return out


def ring_area(ring: np.ndarray) -> float:
    lon, lat = np.radians(ring[:, 0]), np.radians(ring[:, 1])
    return abs(float(((lon[1:] - lon[:-1]) * (2 + np.sin(lat[:-1]) + np.sin(lat[1:]))).sum()) * RADIUS * RADIUS / 2)


def length(line: np.ndarray) -> float:
    return sum(metres(a, b) for a, b in zip(line[:-1], line[1:], strict=True))


def along(line: np.ndarray, part: float) -> list[float]:
    want = length(line) * part
    for a, b in zip(line[:-1], line[1:], strict=True):
        d = metres(a, b)
        if d >= want:
            return list(a + (b - a) * (want / d if d else 0))
        want -= d
    return list(line[-1])


def densify(line: np.ndarray, step: float) -> list:
    out = [list(line[0])]
    for a, b in zip(line[:-1], line[1:], strict=True):
        n = max(1, math.ceil(metres(a, b) / step))
        out += [list(a + (b - a) * k / n) for k in range(1, n + 1)]
    return out


def simplify(line: np.ndarray, tolerance: float) -> list:
    """Keeps the points that lie farther than the tolerance from the chord, recursively."""
    if len(line) < 3:
        return [list(p) for p in line]
    distances = [nearest_on(p, line[[0, -1]])[1] for p in line[1:-1]]
    k = int(np.argmax(distances)) + 1
    if distances[k - 1] <= tolerance:
        return [list(line[0]), list(line[-1])]
    return simplify(line[: k + 1], tolerance)[:-1] + simplify(line[k:], tolerance)


def point(xy) -> dict:
    return {"type": "Point", "coordinates": [float(xy[0]), float(xy[1])]}


def rebuilt(shape: dict, work) -> dict:
    """A shape with each of its lines or rings replaced."""
    kind, c = shape["type"], shape["coordinates"]
    line = lambda x: work(np.array(x, float))
    out = line(c) if kind == "LineString" else [line(x) for x in c] if kind in ("MultiLineString", "Polygon") else [[line(x) for x in p] for p in c]
    return {"type": kind, "coordinates": out}


def polygon_centroid(shape: dict) -> dict:
    ring = max((p[0] for p in rings_of(shape)), key=ring_area)
    x, y = ring[:, 0], ring[:, 1]
    cross = x[:-1] * y[1:] - x[1:] * y[:-1]
    a = cross.sum() / 2 or 1e-18
    return point((((x[:-1] + x[1:]) * cross).sum() / (6 * a), ((y[:-1] + y[1:]) * cross).sum() / (6 * a)))


def line_centroid(shape: dict) -> dict:
    weight, place = 0.0, np.zeros(2)
    for line in lines_of(shape):
        for a, b in zip(line[:-1], line[1:], strict=True):
            d = metres(a, b)
            weight, place = weight + d, place + d * (a + b) / 2
    return point(place / (weight or 1e-18))


def shape_udf(names: str, count: int, work, result, shape_at: int = -1):
    """work(numbers, shape); the shape is the argument at the given place."""

    @function(names, *(count if isinstance(count, tuple) else (count, count)), kind="U")
    def _(ctx, args):
        where = shape_at % len(args)

        @F.pandas_udf("string" if result is VARIANT else result)
        def run(*columns: pd.Series) -> pd.Series:
            out = []
            for row in zip(*columns, strict=True):
                try:
                    found = work([v for k, v in enumerate(row) if k != where], json.loads(row[where]))
                    out.append(json.dumps(found) if result is VARIANT else found)
                except (ValueError, TypeError, KeyError, IndexError, ZeroDivisionError):
                    out.append(None)
            return pd.Series(out, dtype=object)

        found = run(*[as_string(ctx, a) if k == where else as_double(ctx, a) for k, a in enumerate(args)])
        return E(F.try_parse_json(found) if result is VARIANT else found, result)


def _edge(p, shape):
    return min((nearest_on(p, r) for rings in rings_of(shape) for r in rings), key=lambda x: x[1])


shape_udf("geo_distance_point_to_line", 3, lambda p, s: min(nearest_on(p, x)[1] for x in lines_of(s)), DOUBLE)
shape_udf("geo_closest_point_on_line", 3, lambda p, s: point(min((nearest_on(p, x) for x in lines_of(s)), key=lambda x: x[1])[0]), VARIANT)
shape_udf("geo_distance_point_to_polygon", 3, lambda p, s: 0.0 if any(inside(p, r) for r in rings_of(s)) else _edge(p, s)[1], DOUBLE)
shape_udf("geo_closest_point_on_polygon", 3, lambda p, s: point(p) if any(inside(p, r) for r in rings_of(s)) else point(_edge(p, s)[0]), VARIANT)
shape_udf("geo_point_in_polygon", 3, lambda p, s: any(inside(p, r) for r in rings_of(s)), BOOL)
shape_udf("geo_line_length", 1, lambda _, s: sum(map(length, lines_of(s))), DOUBLE)
shape_udf("geo_line_centroid", 1, lambda _, s: line_centroid(s), VARIANT)
shape_udf("geo_line_densify", 2, lambda n, s: rebuilt(s, lambda x: densify(x, n[0])), VARIANT, 0)
shape_udf("geo_line_simplify", (1, 2), lambda n, s: rebuilt(s, lambda x: simplify(x, n[0] if n else 10.0)), VARIANT, 0)
shape_udf("geo_line_interpolate_point", 2, lambda n, s: point(along(lines_of(s)[0], n[0])), VARIANT, 0)


def locate(p, line: np.ndarray) -> float:
    at, done, best = 0.0, 0.0, math.inf
    for a, b in zip(line[:-1], line[1:], strict=True):
        q, d = nearest_on(p, np.array([a, b]))
        if d < best:
            best, at = d, done + metres(a, q)
        done += metres(a, b)
    return at / (done or 1e-18)


shape_udf("geo_line_locate_point", 3, lambda p, s: locate(p, lines_of(s)[0]), DOUBLE, 0)
shape_udf("geo_polygon_area", 1, lambda _, s: sum(ring_area(p[0]) - sum(map(ring_area, p[1:])) for p in rings_of(s)), DOUBLE)
shape_udf("geo_polygon_centroid", 1, lambda _, s: polygon_centroid(s), VARIANT)
shape_udf("geo_polygon_perimeter", 1, lambda _, s: sum(length(r) for p in rings_of(s) for r in p), DOUBLE)
shape_udf("geo_polygon_densify", 2, lambda n, s: rebuilt(s, lambda x: densify(x, n[0])), VARIANT, 0)
shape_udf("geo_polygon_simplify", (1, 2), lambda n, s: rebuilt(s, lambda x: simplify(x, n[0] if n else 10.0)), VARIANT, 0)

# ---- pairs of shapes, on the plane of longitude and latitude -------------------------------------------------------------


def crossing(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    """Where two segments meet: no point, one, or the two ends of what they share."""
    r, s, gap = b - a, d - c, c - a
    turn = r[0] * s[1] - r[1] * s[0]
    off = gap[0] * r[1] - gap[1] * r[0]
    if abs(turn) > 1e-15:
        t, u = (gap[0] * s[1] - gap[1] * s[0]) / turn, off / turn
        return [a + t * r] if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12 else []
    along_r = float(r @ r)
    if abs(off) > 1e-15 or not along_r:
        return []
    low, high = sorted((float((c - a) @ r) / along_r, float((d - a) @ r) / along_r))
    low, high = max(0.0, low), min(1.0, high)
    return [a + low * r, a + high * r] if low < high else [a + low * r] if low == high else []


def segments(lines: list[np.ndarray]):
    for line in lines:
        yield from zip(line[:-1], line[1:], strict=True)


def meetings(one: list[np.ndarray], two: list[np.ndarray]) -> list[tuple[float, float]]:
    """All places where two sets of lines meet, each once, in order."""
    found = {(round(float(x), 12), round(float(y), 12)) for a, b in segments(one) for c, d in segments(two) for x, y in crossing(a, b, c, d)}
    return sorted(found)


def _rings(shape: dict) -> list[np.ndarray]:
    return [r for rings in rings_of(shape) for r in rings]


def _within(p, shape: dict) -> bool:
    return any(inside(p, r) for r in rings_of(shape))


def lines_meet(one: dict, two: dict) -> bool:
    return bool(meetings(lines_of(one), lines_of(two)))


def line_meets_polygon(line: dict, polygon: dict) -> bool:
    return any(_within(x[0], polygon) for x in lines_of(line)) or bool(meetings(lines_of(line), _rings(polygon)))


def polygons_meet(one: dict, two: dict) -> bool:
    return bool(meetings(_rings(one), _rings(two))) or _within(_rings(one)[0][0], two) or _within(_rings(two)[0][0], one)


def as_points(found: list) -> dict | None:
    return None if not found else point(found[0]) if len(found) == 1 else {"type": "MultiPoint", "coordinates": [list(p) for p in found]}


def line_in_polygon(line: dict, polygon: dict) -> dict | None:
    """The parts of a line that lie in a polygon."""
    border, parts = _rings(polygon), []
    for path in lines_of(line):
        for a, b in zip(path[:-1], path[1:], strict=True):
            cuts = sorted({0.0, 1.0, *(float((q - a) @ (b - a) / ((b - a) @ (b - a) or 1)) for c, d in segments(border) for q in crossing(a, b, c, d))})
            for low, high in zip(cuts, cuts[1:], strict=False):
                if high - low > 1e-12 and _within(a + (b - a) * (low + high) / 2, polygon):
                    begin, end = list(map(float, a + (b - a) * low)), list(map(float, a + (b - a) * high))
                    if parts and np.allclose(parts[-1][-1], begin):
                        parts[-1].append(end)
                    else:
                        parts.append([begin, end])
    if not parts:
        return as_points(meetings(lines_of(line), border))
    return {"type": "LineString", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiLineString", "coordinates": parts}


def pair_udf(name: str, work, result):
    @function(name, 2, kind="U")
    def _(ctx, args):
        @F.pandas_udf("string" if result is VARIANT else result)
        def run(ones: pd.Series, twos: pd.Series) -> pd.Series:
            out = []
            for one, two in zip(ones, twos, strict=True):
                try:
                    found = work(json.loads(one), json.loads(two))
                    out.append(found if result is not VARIANT or found is None else json.dumps(found))
                except (ValueError, TypeError, KeyError, IndexError):
                    out.append(None)
            return pd.Series(out, dtype=object)

        found = run(*[as_string(ctx, a) for a in args])
        return E(F.try_parse_json(found) if result is VARIANT else found, result)


pair_udf("geo_intersects_2lines", lines_meet, BOOL)
pair_udf("geo_intersects_line_with_polygon", line_meets_polygon, BOOL)
pair_udf("geo_intersects_2polygons", polygons_meet, BOOL)
pair_udf("geo_intersection_2lines", lambda a, b: as_points(meetings(lines_of(a), lines_of(b))), VARIANT)
pair_udf("geo_intersection_line_with_polygon", line_in_polygon, VARIANT)


def circle(lon: float, lat: float, radius: float, tolerance: float = 10.0) -> dict:
    """A polygon whose corners lie at the distance from the point and whose sides are off by the tolerance at most."""
    n = max(8, math.ceil(math.pi / math.acos(max(0.0, 1 - min(tolerance, radius) / radius))))
    d, y = radius / RADIUS, math.radians(lat)
    ring = []
    for k in range(n):
        turn = -2 * math.pi * k / n  # counter-clockwise
        up = math.asin(math.sin(y) * math.cos(d) + math.cos(y) * math.sin(d) * math.cos(turn))
        over = math.atan2(math.sin(turn) * math.sin(d) * math.cos(y), math.cos(d) - math.sin(y) * math.sin(up))
        ring.append([(lon + math.degrees(over) + 540) % 360 - 180, math.degrees(up)])
    return {"type": "Polygon", "coordinates": [[*ring, ring[0]]]}


@function("geo_point_buffer", 3, 4, kind="U")
def _(ctx, args):
    @F.pandas_udf("string")
    def run(*columns: pd.Series) -> pd.Series:
        fits = lambda r: all(v == v for v in r) and abs(r[0]) <= 180 and abs(r[1]) <= 90 and r[2] > 0 and all(t > 0 for t in r[3:])
        return pd.Series([json.dumps(circle(*r)) if fits(r) else None for r in zip(*columns, strict=True)], dtype=object)

    return E(F.try_parse_json(run(*[as_double(ctx, a) for a in args])), VARIANT)


#: Names of shapes in GeoJSON by their upper-case names in WKT.
WKT_KINDS = {k.upper(): k for k in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")}


def _split(text: str) -> list[str]:
    """The parts between commas outside brackets."""
    parts, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(text[at:k])
            at = k + 1
    return [*parts, text[at:]]


def _nested(text: str) -> list:
    text = text.strip()
    if not text.startswith("("):
        return [float(v) for v in text.split()]
    return [_nested(x) for x in _split(text[1:-1])]


def from_wkt(text: str) -> dict:
    kind, _, body = text.strip().partition("(")
    name, body = kind.split()[0].upper(), f"({body}"
    if name == "GEOMETRYCOLLECTION":
        return {"type": "GeometryCollection", "geometries": [from_wkt(x) for x in _split(body.strip()[1:-1])]}
    found = _nested(body)
    if name == "MULTIPOINT":
        found = [p[0] if isinstance(p[0], list) else p for p in found]
    return {"type": WKT_KINDS[name], "coordinates": found[0] if name == "POINT" else found}


@function("geo_from_wkt", 1, kind="U")
def _(ctx, args):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for text in s:
            try:
                out.append(json.dumps(from_wkt(text)))
            except (ValueError, TypeError, KeyError, IndexError, AttributeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return E(F.try_parse_json(run(as_string(ctx, args[0]))), VARIANT)


shape_udf("geo_union_lines_array", 1, lambda _, s: {"type": "MultiLineString", "coordinates": [x.tolist() for shape in s for x in lines_of(shape)]}, VARIANT)
shape_udf("geo_simplify_polygons_array", (1, 2), lambda n, s: [rebuilt(shape, lambda x: simplify(x, n[0] if n else 10.0)) for shape in s], VARIANT, 0)

# ---- geohash --------------------------------------------------------------------------------------------------------

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed value: the digits of geohashes


def geohash(lon: float, lat: float, digits: int = 5) -> str:
    spans, out, bit, value = [[-180.0, 180.0], [-90.0, 90.0]], "", 0, 0
    while len(out) < digits:
        which, x = (bit + len(out) * 5) % 2, (lon, lat)
        span = spans[which]
        mid = sum(span) / 2
        up = x[which] >= mid
        span[0 if up else 1] = mid
        value = value * 2 + up
        bit += 1
        if bit == 5:
            out, bit, value = out + BASE32[value], 0, 0
    return out


def box(code: str) -> tuple[float, float, float, float]:
    spans = [[-180.0, 180.0], [-90.0, 90.0]]
    for k, c in enumerate("".join(f"{BASE32.index(x):05b}" for x in code)):
        span = spans[k % 2]
        span[0 if c == "1" else 1] = sum(span) / 2
    return spans[0][0], spans[1][0], spans[0][1], spans[1][1]


def neighbours(code: str) -> list[str]:
    w, s, e, n = box(code)
    lon, lat, dx, dy = (w + e) / 2, (s + n) / 2, e - w, n - s
    out = []
    for y in (1, 0, -1):
        for x in (-1, 0, 1):
            if (x or y) and -90 <= lat + y * dy <= 90:
                out.append(geohash((lon + x * dx + 540) % 360 - 180, lat + y * dy, len(code)))
    return out


def hash_udf(names: str, work):
    @function(names, 1, kind="U")
    def _(ctx, args):
        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: json.dumps(work(x)) if x and all(c in BASE32 for c in x) else None)

        return E(F.try_parse_json(run(F.lower(as_string(ctx, args[0])))), VARIANT)


def _corners(code: str) -> dict:
    w, s, e, n = box(code)
    return {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}


hash_udf("geo_geohash_to_central_point", lambda c: point(((box(c)[0] + box(c)[2]) / 2, (box(c)[1] + box(c)[3]) / 2)))
hash_udf("geo_geohash_to_polygon", _corners)
hash_udf("geo_geohash_neighbors", neighbours)


@function("geo_point_to_geohash", 2, 3, kind="U")
def _(ctx, args):
    digits = int(args[2].constant) if len(args) > 2 else 5

    @F.pandas_udf("string")
    def run(lon: pd.Series, lat: pd.Series) -> pd.Series:
        return pd.Series([geohash(x, y, digits) if -180 <= x <= 180 and -90 <= y <= 90 else None for x, y in zip(lon, lat, strict=True)], dtype=object)

    return E(run(as_double(ctx, args[0]), as_double(ctx, args[1])), STRING)


unsupported(
    "geo_h3cell_children geo_h3cell_level geo_h3cell_neighbors geo_h3cell_parent geo_h3cell_rings geo_h3cell_to_central_point "
    "geo_h3cell_to_polygon geo_info_from_ip_address geo_intersection_2polygons geo_line_buffer geo_line_to_s2cells "
    "geo_point_to_h3cell geo_point_to_s2cell geo_polygon_buffer geo_polygon_to_h3cells geo_polygon_to_s2cells geo_s2cell_neighbors "
    "geo_s2cell_to_central_point geo_s2cell_to_polygon geo_union_polygons_array"
)
