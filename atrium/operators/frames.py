"""Affine frames: page, building, globe and grid, as column arithmetic with literal parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from atrium import params
from atrium.functions.geometry import col


def page_to_metres(x, y, x0: float, y0: float, scale: float = params.M_PER_POINT) -> tuple[Column, Column]:
    return F.round((col(x) - x0) * scale, 3), F.round((col(y) - y0) * scale, 3)


def half_turn(x, y, w="w", d="d", ox="ox", oy="oy") -> tuple[Column, Column]:
    """The drawing turned by 180 degrees inside its box of origin (ox, oy) and size (w, d)."""
    return col(w) - (col(x) - col(ox)), col(d) - (col(y) - col(oy))


def half_turn_back(x, y, w="w", d="d", ox="ox", oy="oy") -> tuple[Column, Column]:
    return col(w) - col(x) + col(ox), col(d) - col(y) + col(oy)


@dataclass(frozen=True)
class GeoReference:
    lon: float
    lat: float
    ux: float
    uy: float
    m_per_lon: float
    m_per_lat: float


def georeference(ring: list[tuple[float, float]], beside: float = 5.0) -> GeoReference:
    """The building's frame: x along the ring's first side, from its westernmost vertex near that side."""
    (lon0, lat0), (lon1, lat1) = ring[0], ring[1]
    m_lat, m_lon = params.METRES_PER_DEGREE, params.METRES_PER_DEGREE * math.cos(math.radians(lat0))
    dx, dy = (lon1 - lon0) * m_lon, (lat1 - lat0) * m_lat
    n = math.hypot(dx, dy)
    ux, uy = dx / n, dy / n
    local = [((x - lon0) * m_lon, (y - lat0) * m_lat) for x, y in ring]
    west = min(x * ux + y * uy for x, y in local if abs(x * uy - y * ux) < beside)
    return GeoReference(lon0 + west * ux / m_lon, lat0 + west * uy / m_lat, ux, uy, m_lon, m_lat)


def to_lnglat(x, y, at: GeoReference) -> tuple[Column, Column]:
    x, y = col(x), col(y)
    return at.lon + (x * at.ux + y * at.uy) / at.m_per_lon, at.lat + (x * at.uy - y * at.ux) / at.m_per_lat


def from_lnglat(lng, lat, at: GeoReference) -> tuple[Column, Column]:
    mx, my = (col(lng) - at.lon) * at.m_per_lon, (col(lat) - at.lat) * at.m_per_lat
    return mx * at.ux + my * at.uy, mx * at.uy - my * at.ux


@dataclass(frozen=True)
class GridFrame:
    """Cells on the globe: origin is the centre of cell (0, 0); ex and ey are its steps in degrees."""

    origin: tuple[float, float]
    ex: tuple[float, float]
    ey: tuple[float, float]

    def to_cell(self, lng, lat) -> tuple[Column, Column]:
        """Fractional cell of a place."""
        det = self.ex[0] * self.ey[1] - self.ex[1] * self.ey[0]
        dx, dy = col(lng) - self.origin[0], col(lat) - self.origin[1]
        return (dx * self.ey[1] - dy * self.ey[0]) / det, (dy * self.ex[0] - dx * self.ex[1]) / det

    def to_lnglat(self, i, j) -> tuple[Column, Column]:
        i, j = col(i), col(j)
        return self.origin[0] + i * self.ex[0] + j * self.ey[0], self.origin[1] + i * self.ex[1] + j * self.ey[1]

    def handedness(self) -> Column:
        """1 if j lies to the left of i, else -1: longitude is scaled, which keeps the sign."""
        scale = math.cos(math.radians(self.origin[1]))
        return F.when(F.lit(self.ex[0] * scale * self.ey[1] - self.ex[1] * self.ey[0] * scale) > 0, 1).otherwise(-1)


def best_bearing(screen_w, screen_h, box, base: float = 0.0) -> Column:
    """``base``, or 90 degrees more if a box of degrees (west, south, east, north) is shown larger standing
    on a screen of that size; a tie, or a screen without size, keeps ``base``. Longitudes shrink with the
    cosine of the middle latitude."""
    b, w, h = col(box), col(screen_w), col(screen_h)
    wide = (b["east"] - b["west"]) * F.cos(F.radians((b["south"] + b["north"]) / 2))
    tall = b["north"] - b["south"]
    zoom = lambda across, up: F.least(w / F.nullif(across, F.lit(0.0)), h / F.nullif(up, F.lit(0.0)))
    return F.when((w > 0) & (h > 0) & (zoom(tall, wide) > zoom(wide, tall)), base + 90.0).otherwise(F.lit(base))
