"""Geometry expressions on arrays of vertices and small per-geometry helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefspark.functions.geo import _c, bbox

RING = "array<struct<x:double,y:double>>"


def rings_bbox(rings) -> Column:
    """Bounding box of nested vertex arrays (rings of structs x, y)."""
    flat = F.flatten(_c(rings))
    xs, ys = F.transform(flat, lambda p: p.x), F.transform(flat, lambda p: p.y)
    return bbox(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def coordinates_bbox(text) -> Column:
    """Bounding box of a GeoJSON coordinates text, whatever the nesting, 2-D or 3-D.

    A vertex is the innermost bracket; its first two numbers are x and y.
    """
    vertices = F.regexp_extract_all(_c(text), F.lit(r"\[([^\[\]]+)\]"), 1)
    pairs = F.transform(vertices, lambda v: F.split(v, ","))
    xs = F.transform(pairs, lambda p: F.trim(p[0]).cast("double"))
    ys = F.transform(pairs, lambda p: F.trim(p[1]).cast("double"))
    return bbox(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def ring_is_real(ring) -> Column:
    """At least three distinct vertices."""
    return F.size(F.array_distinct(_c(ring))) >= 3


def close_ring(ring) -> Column:
    ring = _c(ring)
    first = F.element_at(ring, 1)
    return F.when(F.element_at(ring, -1) == first, ring).otherwise(F.concat(ring, F.array(first)))


def ring_mean(ring) -> Column:
    """Mean of the vertices of a ring."""
    ring = _c(ring)
    count = F.size(ring).cast("double")
    total = F.aggregate(
        ring, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda acc, p: F.struct((acc.x + p.x).alias("x"), (acc.y + p.y).alias("y")))
    return F.struct((total.x / count).alias("x"), (total.y / count).alias("y"))


def parts_in_box(parts, clip) -> Column:
    """Polygon parts whose outer ring meets the clip box; all parts when none does."""
    parts = _c(parts)
    x0, y0, x1, y1 = (F.lit(float(v)) for v in clip)

    def meets(part):
        xs, ys = F.transform(part[0], lambda p: p.x), F.transform(part[0], lambda p: p.y)
        return ((F.array_max(xs) >= x0) & (F.array_min(xs) <= x1)
                & (F.array_max(ys) >= y0) & (F.array_min(ys) <= y1))

    kept = F.filter(parts, meets)
    return F.when(F.size(kept) > 0, kept).otherwise(parts)


def segment_meets_box(ax, ay, bx, by, x0, y0, x1, y1) -> Column:
    """Slab test: does the closed segment a-b meet the closed box?  Points count as segments."""
    ax, ay, bx, by = _c(ax), _c(ay), _c(bx), _c(by)
    x0, y0, x1, y1 = _c(x0), _c(y0), _c(x1), _c(y1)

    def slab(a, d, low, high):
        t_a, t_b = (low - a) / d, (high - a) / d
        inside = (a >= low) & (a <= high)
        enter = F.when(d != 0, F.least(t_a, t_b)).when(inside, 0.0).otherwise(2.0)
        leave = F.when(d != 0, F.greatest(t_a, t_b)).when(inside, 1.0).otherwise(-1.0)
        return enter, leave

    enter_x, leave_x = slab(ax, F.nullif(bx - ax, F.lit(0.0)), x0, x1)
    enter_y, leave_y = slab(ay, F.nullif(by - ay, F.lit(0.0)), y0, y1)
    return (F.greatest(enter_x, enter_y, F.lit(0.0)) <= F.least(leave_x, leave_y, F.lit(1.0)))


def simplify_vertices(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on one polyline (n x 2); end points stay."""
    keep = np.zeros(len(points), dtype=bool)
    if len(points) == 0:
        return points
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        start, end = todo.pop()
        if end - start < 2:
            continue
        a, d = points[start], points[end] - points[start]
        rel = points[start + 1:end] - a
        length = np.hypot(*d)
        off = np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0]) / length if length else np.hypot(rel[:, 0], rel[:, 1])
        far = int(np.argmax(off))
        if off[far] > tolerance:
            middle = start + 1 + far
            keep[middle] = True
            todo += [(start, middle), (middle, end)]
    return points[keep]


def clip_ring(points: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Part of a ring inside a rectangle (one half-plane after the other); closed, or empty."""
    ring = points[:-1] if len(points) > 1 and np.array_equal(points[0], points[-1]) else points
    for axis, bound, sign in ((0, x0, 1.0), (0, x1, -1.0), (1, y0, 1.0), (1, y1, -1.0)):
        if len(ring) == 0:
            break
        following = np.roll(ring, -1, axis=0)
        depth, depth_next = sign * (ring[:, axis] - bound), sign * (following[:, axis] - bound)
        inside, crosses = depth >= 0, (depth >= 0) != (depth_next >= 0)
        share = np.divide(depth, depth - depth_next, out=np.zeros_like(depth), where=crosses)
        cut = ring + share[:, None] * (following - ring)
        cut[:, axis] = bound
        both = np.stack([ring, cut], axis=1).reshape(-1, 2)
        ring = both[np.stack([inside, crosses], axis=1).reshape(-1)]
    return np.vstack([ring, ring[:1]]) if len(ring) else ring.reshape(0, 2)


def clipped_ring(ring, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Part of a ring inside a rectangle, closed, or an empty array: one half-plane after the other, in the JVM."""
    planes = F.array(*[F.struct(F.lit(axis).alias("axis"), F.lit(float(bound)).alias("bound"), F.lit(sign).alias("sign"))
                       for axis, bound, sign in ((0, x0, 1.0), (0, x1, -1.0), (1, y0, 1.0), (1, y1, -1.0))])

    def vertex(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    def half(left: Column, plane: Column) -> Column:
        upright = plane.axis == 0

        def depth(p: Column) -> Column:
            return plane.sign * (F.when(upright, p.x).otherwise(p.y) - plane.bound)

        def kept(p: Column, q: Column) -> Column:
            here, there = depth(p), depth(q)
            share = here / (here - there)
            cut = vertex(F.when(upright, plane.bound).otherwise(p.x + share * (q.x - p.x)), F.when(upright, p.y + share * (q.y - p.y)).otherwise(plane.bound))
            crosses = (here >= 0) != (there >= 0)
            return (F.when((here >= 0) & crosses, F.array(p, cut)).when(here >= 0, F.array(p)).when(crosses, F.array(cut))
                    .otherwise(F.array().cast("array<struct<x: double, y: double>>")))

        # neighbours side by side; the last vertex meets the first
        following = F.concat(F.slice(left, 2, F.size(left)), F.slice(left, 1, 1))
        return F.flatten(F.zip_with(left, following, kept))

    ring = F.transform(_c(ring), lambda p: vertex(p.x.cast("double"), p.y.cast("double")))
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    left = F.aggregate(planes, F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring), half)
    return F.transform(F.array(left), lambda r: F.concat(r, F.slice(r, 1, 1)))[0]
