"""Planar geometry as column expressions: all of it stays inside code generation.

A point is a P of two columns; the same expressions work on doubles and on integer
lattices, where areas, orientations and dot products are exact.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class P(NamedTuple):
    x: Column
    y: Column

    def __add__(self, o: P) -> P:  # type: ignore[override]
        return P(self.x + o.x, self.y + o.y)

    def __sub__(self, o: P) -> P:
        return P(self.x - o.x, self.y - o.y)

    def __neg__(self) -> P:
        return P(-self.x, -self.y)

    def scale(self, k: Column | float) -> P:
        return P(self.x * k, self.y * k)

    def dot(self, o: P) -> Column:
        return self.x * o.x + self.y * o.y

    def cross(self, o: P) -> Column:
        return self.x * o.y - self.y * o.x

    def length_sq(self) -> Column:
        return self.dot(self)

    def length(self) -> Column:
        return F.sqrt(self.length_sq())

    def distance_sq(self, o: P) -> Column:
        return (self - o).length_sq()

    def distance(self, o: P) -> Column:
        return F.sqrt(self.distance_sq(o))

    def unit_or_zero(self) -> P:
        k = F.coalesce(F.try_divide(F.lit(1.0), self.length()), F.lit(0.0))
        return self.scale(k)

    def lerp(self, o: P, t: Column) -> P:
        return self + (o - self).scale(t)

    def close_to(self, o: P, eps: float) -> Column:
        return (F.abs(self.x - o.x) <= eps) & (F.abs(self.y - o.y) <= eps)

    def equals(self, o: P) -> Column:
        return (self.x == o.x) & (self.y == o.y)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"))


def point(x: str, y: str) -> P:
    return P(F.col(x), F.col(y))


def field(c: Column) -> P:
    return P(c["x"], c["y"])


def area2(a: P, b: P, c: P) -> Column:
    """Twice the signed area of a triangle, positive if counter-clockwise; the orientation of c about a->b."""
    return (b - a).cross(c - a)


orient2d = area2


def in_circle(a: P, b: P, c: P, d: P) -> Column:
    """Positive if d is inside the circle of the counter-clockwise triangle abc."""
    rows = [(p - d) for p in (a, b, c)]
    (u, v, w), (uu, vv, ww) = rows, [p.length_sq() for p in rows]
    return u.x * (v.y * ww - vv * w.y) - u.y * (v.x * ww - vv * w.x) + uu * (v.x * w.y - v.y * w.x)


def in_box(a: P, b: P, p: P) -> Column:
    """Whether p is in the box of a and b, border included; on the segment if it is collinear."""
    return p.x.between(F.least(a.x, b.x), F.greatest(a.x, b.x)) & p.y.between(F.least(a.y, b.y), F.greatest(a.y, b.y))


def on_segment(a: P, b: P, p: P) -> Column:
    return (area2(a, b, p) == 0) & in_box(a, b, p)


def segments_meet(a: P, b: P, c: P, d: P) -> Column:
    """'none', 'point' or 'collinear': how the closed segments ab and cd meet."""
    o1, o2, o3, o4 = area2(a, b, c), area2(a, b, d), area2(c, d, a), area2(c, d, b)
    sign = lambda v: F.signum(v.cast("double"))
    flat = (o1 == 0) & (o2 == 0) & (o3 == 0) & (o4 == 0)
    overlap = in_box(a, b, c) | in_box(a, b, d) | in_box(c, d, a) | in_box(c, d, b)
    touch = [(o == 0) & in_box(*s) for o, s in ((o1, (a, b, c)), (o2, (a, b, d)), (o3, (c, d, a)), (o4, (c, d, b)))]
    proper = (sign(o1) * sign(o2) < 0) & (sign(o3) * sign(o4) < 0)
    return F.when(flat, F.when(overlap, "collinear").otherwise("none")).when(proper | reduce(lambda p, q: p | q, touch), "point").otherwise("none")


def crossing_terms(a: P, b: P, c: P, d: P) -> tuple[Column, Column, Column]:
    """The denominator of the crossing's parameters and the numerators of those along ab and cd; exact on a lattice."""
    r, s = b - a, d - c
    return r.cross(s), (c - a).cross(s), (c - a).cross(r)


def crossing(a: P, b: P, c: P, d: P) -> Column:
    """struct<t,u,x,y> of the crossing of ab and cd with both parameters in [0,1]; null if none or parallel."""
    below, along_ab, along_cd = crossing_terms(a, b, c, d)
    t, u = (F.try_divide(v.cast("double"), below.cast("double")) for v in (along_ab, along_cd))
    at = P(a.x.cast("double"), a.y.cast("double")).lerp(P(b.x.cast("double"), b.y.cast("double")), t)
    return F.when(t.between(0, 1) & u.between(0, 1), F.struct(t.alias("t"), u.alias("u"), at.x.alias("x"), at.y.alias("y")))


def segment_parameter(a: P, b: P, p: P) -> Column:
    """Place on ab, 0 to 1, that is nearest to p; 0 on a segment without length."""
    along = F.coalesce(F.try_divide((p - a).dot(b - a).cast("double"), (b - a).length_sq()), F.lit(0.0))
    return F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))


def nearest_on_segment(a: P, b: P, p: P) -> P:
    return a.lerp(b, segment_parameter(a, b, p))


def in_triangle(a: P, b: P, c: P, p: P) -> Column:
    """Whether p is in the triangle, border included, whatever its winding."""
    s = [area2(a, b, p), area2(b, c, p), area2(c, a, p)]
    return ~(((s[0] < 0) | (s[1] < 0) | (s[2] < 0)) & ((s[0] > 0) | (s[1] > 0) | (s[2] > 0)))


def nearest_on_triangle(a: P, b: P, c: P, p: P) -> Column:
    """struct<d2,edge,x,y>: p itself (edge -1) if inside, else the nearest edge point, the first edge on ties."""
    inside = F.struct(F.lit(0.0).alias("d2"), F.lit(-1).alias("edge"), p.x.cast("double").alias("x"), p.y.cast("double").alias("y"))
    sides = []
    for k, (s, e) in enumerate(((a, b), (b, c), (c, a))):
        q = nearest_on_segment(s, e, p)
        sides.append(F.struct(q.distance_sq(p).alias("d2"), F.lit(k).alias("edge"), q.x.cast("double").alias("x"), q.y.cast("double").alias("y")))
    return F.when(in_triangle(a, b, c, p), inside).otherwise(F.array_min(F.array(*sides)))


def barycentric(a: P, b: P, c: P, p: P) -> Column:
    """Weights of the corners, or null for a triangle without area."""
    whole = area2(a, b, c).cast("double")
    parts = [F.try_divide(area2(*t), whole) for t in ((b, c, p), (c, a, p), (a, b, p))]
    return F.when(whole != 0, F.array(*parts))


def centroid(a: P, b: P, c: P) -> P:
    return P((a.x + b.x + c.x) / 3, (a.y + b.y + c.y) / 3)


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(*points: P) -> Box:
        xs, ys = [p.x for p in points], [p.y for p in points]
        if len(points) == 1:
            return Box(xs[0], ys[0], xs[0], ys[0])
        return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    def is_empty(self) -> Column:
        return (self.x0 > self.x1) | (self.y0 > self.y1)

    def width(self) -> Column:
        return self.x1 - self.x0

    def height(self) -> Column:
        return self.y1 - self.y0

    def center(self) -> P:
        return P((self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2)

    def union(self, o: Box) -> Box:
        return Box(F.least(self.x0, o.x0), F.least(self.y0, o.y0), F.greatest(self.x1, o.x1), F.greatest(self.y1, o.y1))

    def grow(self, by: Column | float) -> Box:
        return Box(self.x0 - by, self.y0 - by, self.x1 + by, self.y1 + by)

    def contains(self, p: P) -> Column:
        return p.x.between(self.x0, self.x1) & p.y.between(self.y0, self.y1)

    def intersects(self, o: Box) -> Column:
        return (self.x0 <= o.x1) & (o.x0 <= self.x1) & (self.y0 <= o.y1) & (o.y0 <= self.y1)

    def distance_to(self, p: P) -> Column:
        dx = F.greatest(self.x0 - p.x, p.x - self.x1, F.lit(0))
        dy = F.greatest(self.y0 - p.y, p.y - self.y1, F.lit(0))
        return F.sqrt(dx * dx + dy * dy)


def box(prefix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")])


def snap(x: Column, cell: float) -> Column:
    """x on a grid of the cell, halves away from zero; -0.0 becomes 0.0."""
    return F.round(x / cell) * cell + F.lit(0.0)


def collinear_overlap(a: P, b: P, c: P, d: P, tol: float) -> Column:
    """struct<t0,t1> along ab of its overlap with cd, if both ends of cd are within tol of the line of ab and the
    overlap is longer than tol; else null."""
    run = (b - a).length()
    ux, uy = F.try_divide(b.x - a.x, run), F.try_divide(b.y - a.y, run)
    u = P(ux, uy)
    off = lambda p: F.abs(u.cross(p - a))
    at = lambda p: u.dot(p - a)
    t0, t1 = F.greatest(F.lit(0.0), F.least(at(c), at(d))), F.least(run, F.greatest(at(c), at(d)))
    return F.when((run > 0) & (off(c) <= tol) & (off(d) <= tol) & (t1 - t0 > tol), F.struct(t0.alias("t0"), t1.alias("t1")))


# rings: arrays of struct<x,y>, closed without a repeated first point


def ring_edges(ring: Column) -> Column:
    """array<struct<a,b>> of directed edges, the closing one last."""
    n = F.size(ring)
    turned = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.when(n > 0, F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array())


def ring_area2(ring: Column) -> Column:
    """Shoelace sum in ring order; 0 with fewer than three points."""
    zero = F.lit(0).cast("double")
    total = F.aggregate(ring_edges(ring), zero, lambda acc, e: acc + field(e["a"]).cross(field(e["b"])))
    return F.when(F.size(ring) < 3, zero).otherwise(total)


def ring_winding(ring: Column) -> Column:
    a = ring_area2(ring)
    return F.when(a > 0, "ccw").when(a < 0, "cw").otherwise("degenerate")


def ring_oriented(ring: Column, ccw: bool) -> Column:
    """The ring in the asked winding; one without area stays as it is."""
    a = ring_area2(ring)
    return F.when(a < 0 if ccw else a > 0, F.reverse(ring)).otherwise(ring)


def ring_contains(ring: Column, p: P) -> Column:
    """Even-odd test; the border is inside."""
    edges = ring_edges(ring)
    border = F.exists(edges, lambda e: on_segment(field(e["a"]), field(e["b"]), p))
    odd = F.aggregate(edges, F.lit(False), lambda acc, e: acc != ray_crosses(field(e["a"]), field(e["b"]), p))
    return border | odd


def ray_crosses(a: P, b: P, p: P) -> Column:
    """Whether a ray from p to larger x crosses ab, its lower end included; without a division."""
    up = (a.y <= p.y) & (b.y > p.y)
    down = (b.y <= p.y) & (a.y > p.y)
    side = area2(a, b, p)
    return (up & (side > 0)) | (down & (side < 0))


def winding_part(a: P, b: P, p: P) -> Column:
    """What the edge ab adds to the winding number about p."""
    side = area2(a, b, p)
    return F.when((a.y <= p.y) & (b.y > p.y) & (side > 0), 1).when((b.y <= p.y) & (a.y > p.y) & (side < 0), -1).otherwise(0)


def holed_area(ring: Column, holes: Column) -> Column:
    """The area of a ring less that of its holes (array of rings), 0 at least."""
    whole = F.abs(ring_area2(ring))
    return F.greatest(F.aggregate(holes, whole, lambda acc, h: acc - F.abs(ring_area2(h))), F.lit(0.0)) / 2


def holed_contains(ring: Column, holes: Column, p: P) -> Column:
    """In the ring, border included, and in no hole, where the border counts as the hole's."""
    return ring_contains(ring, p) & ~F.exists(holes, lambda h: ring_contains(h, p))
