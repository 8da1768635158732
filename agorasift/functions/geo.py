"""Column expressions for points, boxes and polygons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def in_box(lat: Column, lon: Column, south: Column, north: Column, west: Column, east: Column) -> Column:
    """True inside a half-open box, so neighbouring boxes never share a point."""
    return (lat >= south) & (lat < north) & (lon >= west) & (lon < east)


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray test against an array of ``struct(x, y)`` vertices."""
    edges = F.arrays_zip(
        ring.alias("a"), F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)).alias("b")
    )

    def crosses(edge: Column) -> Column:
        ax, ay = edge["a"]["x"], edge["a"]["y"]
        bx, by = edge["b"]["x"], edge["b"]["y"]
        spans = (ay > y) != (by > y)
        return spans & (x < ax + F.try_divide((bx - ax) * (y - ay), by - ay))

    return F.size(F.filter(edges, crosses)) % 2 == 1
