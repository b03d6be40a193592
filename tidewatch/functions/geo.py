"""Planar geography in degrees: boxes, polygons with holes, and distance buffers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

KM_A_DEGREE = 111.0


def in_box(lat: Column, lon: Column, box: str | None) -> Column | None:
    """Inclusive overlap with 'west,south,east,north'; None where the text hasn't four parts, an error where they are no numbers."""
    parts = (box or "").split(",")
    if len(parts) != 4:
        return None
    west, south, east, north = map(float, parts)
    return lon.between(west, east) & lat.between(south, north)


def edges(rings: Column) -> Column:
    """All sides of all rings (array of arrays of struct(x, y)), as an array of struct(a, b)."""
    sides = F.transform(rings, lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return F.flatten(sides)


def inside(lat: Column, lon: Column, sides: Column) -> Column:
    """Even-odd rule: a ray to the east crosses an odd number of sides."""
    crosses = lambda s: (
        ((s["a"]["y"] > lat) != (s["b"]["y"] > lat))
        & (lon < (s["b"]["x"] - s["a"]["x"]) * (lat - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    )
    return F.size(F.filter(sides, crosses)) % 2 == 1


def distance(lat: Column, lon: Column, sides: Column) -> Column:
    """Degrees to the nearest side."""

    def to_side(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        length = dx * dx + dy * dy
        t = F.when(length > 0, ((lon - s["a"]["x"]) * dx + (lat - s["a"]["y"]) * dy) / length).otherwise(0.0)
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        return F.sqrt(F.pow(lon - s["a"]["x"] - t * dx, 2) + F.pow(lat - s["a"]["y"] - t * dy, 2))

    return F.array_min(F.transform(sides, to_side))


def within(lat: Column, lon: Column, sides: Column, buffer_km: float = 5.0) -> Column:
    """Inside the polygon or nearer to it than the buffer; null coordinates give false."""
    return F.coalesce(inside(lat, lon, sides) | (distance(lat, lon, sides) < buffer_km / KM_A_DEGREE), F.lit(False))


Ring = list[tuple[float, float]]


class Territory:
    """The union of features, each a list of polygons, each of these a ring and its holes; with a grid of cells that most points are settled by.

    A point is in it if it is in any polygon, or nearer than the buffer to a side of one. Cells that no side comes near are inside or outside as
    a whole; only points of the other cells are tested against polygons, and of these against those only whose box they reach.
    """

    def __init__(self, features: list[list[list[Ring]]], buffer_km: float = 5.0, cells: int = 64):
        self.polygons = [[[(float(x), float(y)) for x, y, *_ in ring] for ring in polygon] for feature in features for polygon in feature]
        self.buffer, self.cells = buffer_km / KM_A_DEGREE, cells
        xs, ys = ([p[i] for polygon in self.polygons for ring in polygon for p in ring] for i in (0, 1))
        self.box = (min(xs) - self.buffer, min(ys) - self.buffer, max(xs) + self.buffer, max(ys) + self.buffer) if xs else None
        self.grid = self._classified() if xs else ""

    def _classified(self) -> str:
        """A letter for each cell, row by row: i inside, o outside, b where a side comes within the buffer."""
        west, south, east, north = self.box
        wide, high = (east - west) / self.cells, (north - south) / self.cells
        reach = math.hypot(wide, high) / 2 + self.buffer  # from the centre to whatever can touch a point of the cell
        x, y = np.meshgrid(west + (np.arange(self.cells) + 0.5) * wide, south + (np.arange(self.cells) + 0.5) * high)
        near, held = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
        for polygon in self.polygons:
            odd = np.zeros(x.shape, bool)
            for ring in polygon:
                for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
                    dx, dy = bx - ax, by - ay
                    t = np.clip(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy or 1.0), 0, 1)
                    near |= np.hypot(x - ax - t * dx, y - ay - t * dy) <= reach * (1 + 1e-9)
                    if ay != by:
                        odd ^= ((ay > y) != (by > y)) & (x < dx * (y - ay) / dy + ax)
            held |= odd
        return "".join(np.where(near, "b", np.where(held, "i", "o")).ravel().tolist())

    def contains(self, lat: Column, lon: Column) -> Column:
        """Whether points are in the territory or within the buffer; null coordinates give false."""
        if not self.box:
            return F.lit(False)
        west, south, east, north = self.box
        place = lambda v, low, high: F.floor((v - low) / ((high - low) / self.cells)).cast("int")
        column, row = (F.least(place(v, a, b), F.lit(self.cells - 1)) for v, a, b in ((lon, west, east), (lat, south, north)))
        cell = F.substring(F.lit(self.grid), row * self.cells + column + 1, F.lit(1))
        some = F.lit(False)
        for polygon in self.polygons:
            xs, ys = [p[0] for p in polygon[0]], [p[1] for p in polygon[0]]
            reached = lon.between(min(xs) - self.buffer, max(xs) + self.buffer) & lat.between(min(ys) - self.buffer, max(ys) + self.buffer)
            sides = edges(F.array(*[F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring]) for ring in polygon]))
            some = some | (reached & (inside(lat, lon, sides) | (distance(lat, lon, sides) < self.buffer)))
        known = lon.between(west, east) & lat.between(south, north)
        return F.coalesce(F.when(~known, False).when(cell == "i", True).when(cell == "o", False).otherwise(some), F.lit(False))


def location_key(region: Column, lat: Column, lon: Column) -> Column:
    """What counts as one location: the region, else coordinates at two decimals."""
    return F.coalesce(region, F.concat(F.format_string("%.2f", lat), F.lit(","), F.format_string("%.2f", lon)))


def bubble_size(n: Column) -> Column:
    return F.least(F.lit(64.0), F.greatest(F.lit(24.0), 16 + F.sqrt(n) * 10))
