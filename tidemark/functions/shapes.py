"""Shapes: parsed from WKT, WKB, GeoJSON, GML and KML, covered by cells of the interleaved code, and used as predicates.

A Shape is a list of polygons, each a list of rings of (lat, lon): the first is the outside, the rest are holes. Lines and
points are kept apart and only covered by the cells they touch. A cover is a set of cells, hexadecimal prefixes of the code;
its size is bounded by the number of cells asked for, so it can be broadcast.
"""

from __future__ import annotations

import json
import re
import struct
import xml.etree.ElementTree as xml
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import geo

Ring = list[tuple[float, float]]


@dataclass
class Shape:
    polygons: list[list[Ring]] = field(default_factory=list)
    lines: list[Ring] = field(default_factory=list)
    points: Ring = field(default_factory=list)

    def contains(self, lat: float, lon: float) -> bool:
        return any(_inside(p[0], lat, lon) and not any(_inside(h, lat, lon) for h in p[1:]) for p in self.polygons)

    def column(self, lat: Column, lon: Column) -> Column:
        """Whether a place lies in one of the polygons."""
        out = F.lit(False)
        for outside, *holes in self.polygons:
            here = geo.within_polygon(lat, lon, outside)
            for h in holes:
                here = here & ~geo.within_polygon(lat, lon, h)
            out = out | here
        return out

    def box(self) -> tuple[float, float, float, float]:
        """(south, west, north, east)."""
        places = [p for poly in self.polygons for ring in poly for p in ring] + [p for line in self.lines for p in line] + self.points
        return min(p[0] for p in places), min(p[1] for p in places), max(p[0] for p in places), max(p[1] for p in places)


def _inside(ring: Ring, lat: float, lon: float) -> bool:
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def _closed(ring: Ring) -> Ring:
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


# --- text formats ---------------------------------------------------------------------------------


def from_wkt(text: str) -> Shape:
    """POINT, LINESTRING, POLYGON, their MULTI forms and GEOMETRYCOLLECTION, as x y = lon lat."""
    out = Shape()
    for kind, body in re.findall(r"((?:MULTI)?(?:POINT|LINESTRING|POLYGON))\s*Z?\s*(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))", text.upper()):
        rings = [[(float(y), float(x)) for x, y, *_ in (p.split() for p in ring.split(","))] for ring in re.findall(r"\(([^()]+)\)", body)]
        if kind == "POLYGON":
            out.polygons.append([_closed(r) for r in rings])
        elif kind == "MULTIPOLYGON":
            for poly in re.findall(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)", body[1:-1]):
                out.polygons.append([_closed([(float(y), float(x)) for x, y, *_ in (p.split() for p in r.split(","))]) for r in re.findall(r"\(([^()]+)\)", poly)])
        elif kind.endswith("LINESTRING"):
            out.lines += rings
        else:
            out.points += [p for r in rings for p in r]
    return out


def to_wkt(shape: Shape) -> str:
    def ring(r: Ring) -> str:
        return "(" + ", ".join(f"{lon:.12g} {lat:.12g}" for lat, lon in [*r, r[0]]) + ")"

    if len(shape.polygons) == 1:
        return f"POLYGON ({', '.join(ring(r) for r in shape.polygons[0])})"
    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(ring(r) for r in p) + ")" for p in shape.polygons) + ")"


def from_geojson(text: str | dict) -> Shape:
    g = json.loads(text) if isinstance(text, str) else text
    out = Shape()
    for part in g.get("features", g.get("geometries", [g.get("geometry", g)])):
        part = part.get("geometry", part)
        kind, c = part["type"], part.get("coordinates", [])
        turn = lambda r: [(p[1], p[0]) for p in r]
        if kind == "Polygon":
            out.polygons.append([_closed(turn(r)) for r in c])
        elif kind == "MultiPolygon":
            out.polygons += [[_closed(turn(r)) for r in p] for p in c]
        elif kind == "LineString":
            out.lines.append(turn(c))
        elif kind == "MultiLineString":
            out.lines += [turn(r) for r in c]
        elif kind == "Point":
            out.points.append((c[1], c[0]))
        elif kind == "MultiPoint":
            out.points += turn(c)
    return out


def to_geojson(shape: Shape) -> str:
    polygons = [[[[lon, lat] for lat, lon in [*r, r[0]]] for r in p] for p in shape.polygons]
    return json.dumps({"type": "Polygon", "coordinates": polygons[0]} if len(polygons) == 1 else {"type": "MultiPolygon", "coordinates": polygons})


def from_wkb(data: bytes) -> Shape:
    out, at = Shape(), 0

    def read() -> None:
        nonlocal at
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5

        def places(n: int) -> Ring:
            nonlocal at
            flat = struct.unpack_from(f"{order}{2 * n}d", data, at)
            at += 16 * n
            return [(flat[2 * i + 1], flat[2 * i]) for i in range(n)]

        def count() -> int:
            nonlocal at
            (n,) = struct.unpack_from(order + "I", data, at)
            at += 4
            return n

        if kind == 1:
            out.points.extend(places(1))
        elif kind == 2:
            out.lines.append(places(count()))
        elif kind == 3:
            out.polygons.append([_closed(places(count())) for _ in range(count())])
        elif kind in (4, 5, 6, 7):
            for _ in range(count()):
                read()
        else:
            raise ValueError(f"geometry type {kind}")

    read()
    return out


def to_wkb(shape: Shape) -> bytes:
    def polygon(p: list[Ring]) -> bytes:
        body = b"".join(struct.pack("<I", len(r) + 1) + b"".join(struct.pack("<2d", lon, lat) for lat, lon in [*r, r[0]]) for r in p)
        return struct.pack("<BII", 1, 3, len(p)) + body

    parts = [polygon(p) for p in shape.polygons]
    return parts[0] if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(parts)


def _numbers(text: str, pair: str) -> Ring:
    if pair == "lon,lat":  # KML: lon,lat[,alt] separated by blanks
        return [(float(p.split(",")[1]), float(p.split(",")[0])) for p in text.split()]
    flat = [float(x) for x in text.split()]  # GML: lat lon lat lon
    return list(zip(flat[::2], flat[1::2], strict=True))


def _from_xml(text: str, ring_tag: str, outer: str, inner: str, pair: str) -> Shape:
    out = Shape()
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    for e in xml.fromstring(text).iter():
        if local(e) == "Polygon":
            rings: list[Ring] = []
            for role in (outer, inner):
                for side in (x for x in e.iter() if local(x) == role):
                    rings += [_closed(_numbers(x.text, pair)) for x in side.iter() if local(x) == ring_tag]
            out.polygons.append(rings)
        elif local(e) == "Point":
            out.points += [p for x in e.iter() if local(x) in (ring_tag, "pos") for p in _numbers(x.text, pair)]
    return out


def from_gml(text: str) -> Shape:
    return _from_xml(text, "posList", "exterior", "interior", "lat lon")


def from_kml(text: str) -> Shape:
    return _from_xml(text, "coordinates", "outerBoundaryIs", "innerBoundaryIs", "lon,lat")


def to_gml(shape: Shape) -> str:
    ring = lambda r: "<LinearRing><posList>" + " ".join(f"{a:.12g} {o:.12g}" for a, o in [*r, r[0]]) + "</posList></LinearRing>"
    return "<MultiSurface>" + "".join("<surfaceMember><Polygon><exterior>" + ring(p[0]) + "</exterior>" + "".join(f"<interior>{ring(h)}</interior>" for h in p[1:]) + "</Polygon></surfaceMember>" for p in shape.polygons) + "</MultiSurface>"


def to_kml(shape: Shape) -> str:
    ring = lambda r: "<LinearRing><coordinates>" + " ".join(f"{o:.12g},{a:.12g}" for a, o in [*r, r[0]]) + "</coordinates></LinearRing>"
    return "<MultiGeometry>" + "".join("<Polygon><outerBoundaryIs>" + ring(p[0]) + "</outerBoundaryIs>" + "".join(f"<innerBoundaryIs>{ring(h)}</innerBoundaryIs>" for h in p[1:]) + "</Polygon>" for p in shape.polygons) + "</MultiGeometry>"


# --- cells ----------------------------------------------------------------------------------------


def code(lat: float, lon: float) -> int:
    y = min(int((lat + 90.0) / 180.0 * 4294967296), 4294967295)
    x = min(int((lon + 180.0) / 360.0 * 4294967296), 4294967295)
    out = 0
    for k in range(31, -1, -1):
        out = out << 2 | (y >> k & 1) << 1 | x >> k & 1
    return out


def cell_box(cell: str) -> tuple[float, float, float, float]:
    """(south, west, north, east) of a cell."""
    bits, y, x = bin(int("1" + cell, 16))[3:], 0, 0
    for i in range(0, len(bits), 2):
        y, x = y << 1 | int(bits[i]), x << 1 | int(bits[i + 1])
    n = 1 << len(bits) // 2
    return y / n * 180 - 90, x / n * 360 - 180, (y + 1) / n * 180 - 90, (x + 1) / n * 360 - 180


def cell_center(cell: str) -> tuple[float, float]:
    """(latitude, longitude) of a cell's middle."""
    south, west, north, east = cell_box(cell)
    return (south + north) / 2, (west + east) / 2


def to_geocell(cell: str) -> int:
    """A cell of 1 to 15 digits as a signed long: four bits of its length, then its digits."""
    if not 1 <= len(cell) <= 15:
        raise ValueError("a cell has 1 to 15 digits")
    n = len(cell) << 60 | int(cell, 16) << 60 - 4 * len(cell)
    return n - (1 << 64) if n >> 63 else n


def from_geocell(number: int) -> str:
    """What to_geocell made a long of."""
    digits = f"{number & (1 << 64) - 1:016x}"
    if digits[0] == "0":
        raise ValueError("no cell has this number")
    return digits[1 : int(digits[0], 16) + 1]


def _touches(shape: Shape, box) -> str:
    """in, out or edge: how a box lies to the polygons."""
    s, w, n, e = box
    corners = [shape.contains(a, o) for a in (s, n) for o in (w, e)]
    edges = [(a, b) for p in shape.polygons for r in p for a, b in zip(r, [*r[1:], r[0]], strict=True)] + [(a, b) for line in shape.lines for a, b in zip(line, line[1:], strict=False)]
    if any(_crosses(a, b, box) for a, b in edges) or any(s <= a <= n and w <= o <= e for a, o in shape.points):
        return "edge"
    return "in" if all(corners) else "out"


def _crosses(a, b, box) -> bool:
    """Whether a segment meets a box, by clipping it."""
    s, w, n, e = box
    t0, t1 = 0.0, 1.0
    for d, lo, hi in ((b[0] - a[0], s - a[0], n - a[0]), (b[1] - a[1], w - a[1], e - a[1])):
        if d == 0:
            if lo > 0 or hi < 0:
                return False
            continue
        u, v = sorted((lo / d, hi / d))
        t0, t1 = max(t0, u), min(t1, v)
        if t0 > t1:
            return False
    return True


def cover(shape: Shape, most: int = 512, deepest: int = 16, inside: bool = False) -> set[str]:
    """Cells that cover the shape (or, with inside, lie in it): the largest are split first, until ``most`` cells or ``deepest`` digits."""
    done: set[str] = set()
    work = [f"{d:x}" for d in range(16)]
    while work:
        next_: list[str] = []
        for c in work:
            where = _touches(shape, cell_box(c))
            if where == "in":
                done.add(c)
            elif where == "edge":
                next_.append(c)
        if not next_:
            break
        if len(next_[0]) >= deepest or len(done) + 16 * len(next_) > most:
            if not inside:
                done |= set(next_)
            break
        work = [c + f"{d:x}" for c in next_ for d in range(16)]
    return done


def normal(cells: set[str]) -> set[str]:
    """Without cells inside others; sixteen full siblings become their parent."""
    out = {c for c in cells if not any(c[:i] in cells for i in range(1, len(c)))}
    while True:
        parents: dict[str, int] = {}
        for c in out:
            parents[c[:-1]] = parents.get(c[:-1], 0) + 1
        full = {p for p, n in parents.items() if n == 16 and p}
        if not full:
            return out
        out = {c for c in out if c[:-1] not in full} | full


def union(a: set[str], b: set[str]) -> set[str]:
    return normal(a | b)


def intersection(a: set[str], b: set[str]) -> set[str]:
    inside = lambda c, cells: any(c[:i] in cells for i in range(1, len(c) + 1))
    return normal({c for c in a if inside(c, b)} | {c for c in b if inside(c, a)})


def difference(a: set[str], b: set[str]) -> set[str]:
    """Cells of a with b's cut out; a cell that holds one of b's is split around it."""
    out, work = set(), list(a)
    while work:
        c = work.pop()
        if any(c[:i] in b for i in range(1, len(c) + 1)):
            continue
        if any(x.startswith(c) for x in b):
            work += [c + f"{d:x}" for d in range(16)]
        else:
            out.add(c)
    return normal(out)


def regexp(cells: set[str]) -> str:
    """A pattern that the codes of all places in the cells match."""
    return "^(" + "|".join(sorted(cells)) + ").*$"


def neighbour(cell: str, north: int, east: int) -> str | None:
    """The cell so many cells north and east; longitude wraps, beyond a pole there is none."""
    s, w, n, e = cell_box(cell)
    lat, lon = (s + n) / 2 + north * (n - s), (w + e) / 2 + east * (e - w)
    if not -90 <= lat < 90:
        return None
    lon = (lon + 180) % 360 - 180
    return f"{code(lat, lon):016x}"[: len(cell)]


def in_cells(lat: Column, lon: Column, cells: set[str]) -> Column:
    """Whether a place's code begins with one of the cells."""
    full = F.lower(F.lpad(F.hex(geo.hhcode(lat, lon)), 16, "0"))
    out = F.lit(False)
    for size in sorted({len(c) for c in cells}):
        out = out | F.substring(full, 1, size).isin(*[c for c in cells if len(c) == size])
    return out
