"""Single rings: stairs, straight points, a point inside, and rings moved sideways.  All of a ring is one task's."""

from __future__ import annotations

import math

from .predicates import Point, orient, within

Ring = list[Point]


def _around(ring: Ring, k: int, by: int) -> Point:
    return ring[(k + by) % len(ring)]


def area2(ring: Ring) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) if len(ring) > 2 else 0.0


def straight_out(ring: Ring) -> Ring:
    """The ring without points straight between their neighbours; all of a pass go together, until none does."""
    while len(ring) > 2:
        kept = [p for k, p in enumerate(ring) if orient(_around(ring, k, -1), p, _around(ring, k, 1)) != 0]
        if len(kept) == len(ring):
            break
        ring = kept
    return ring


def _is_stair(ring: Ring, k: int) -> bool:
    """Between two perpendicular unit steps, the step before running on in the direction of the second."""
    a, b, c, d = (_around(ring, k, j) for j in (-2, -1, 0, 1))
    (ux, uy), (vx, vy), (wx, wy) = ((q[0] - p[0], q[1] - p[1]) for p, q in ((a, b), (b, c), (c, d)))
    return vx * vx + vy * vy == 1 == wx * wx + wy * wy and vx * wx + vy * wy == 0 == ux * wy - uy * wx and ux * wx + uy * wy > 0


def smooth(ring: Ring) -> Ring:
    """The ring without the middles of stairs; all of a pass go together, and a pass that leaves fewer than three
    points or comes to a ring of fewer than four is not made."""
    while len(ring) >= 4:
        kept = [p for k, p in enumerate(ring) if not _is_stair(ring, k)]
        if len(kept) == len(ring) or len(kept) < 3:
            break
        ring = kept
    return ring


def inside_point(ring: Ring) -> Point | None:
    """The middle of the first corner triangle that points inwards and holds no other point of the ring."""
    whole = area2(ring)
    if not whole:
        return None
    for k, b in enumerate(ring):
        a, c = _around(ring, k, -1), _around(ring, k, 1)
        if orient(a, b, c) * whole > 0:
            others = [p for j, p in enumerate(ring) if j not in ((k - 1) % len(ring), k, (k + 1) % len(ring))]
            if not any(within(a, b, c, p) for p in others):
                return (a[0] + b[0] + c[0]) / 3, (a[1] + b[1] + c[1]) / 3
    return None


def moved_left(ring: Ring, by: float, limit: float = 2.0) -> Ring | None:
    """The ring with each side moved to its left.  Corners that bend away are mitred up to limit times the distance
    and cut off beyond; at the others both ends stay, so a narrow part may fold over.  None for a ring without area."""
    ring = [p for k, p in enumerate(ring) if len(ring) < 2 or p != _around(ring, k, -1)]
    if len(ring) < 3 or not area2(ring):
        return None
    if by == 0:
        return ring
    sides = []
    for k, p in enumerate(ring):
        q = _around(ring, k, 1)
        size = math.dist(p, q)
        sides.append(((p[1] - q[1]) / size, (q[0] - p[0]) / size))
    out: Ring = []
    for k, (x, y) in enumerate(ring):
        (px, py), (qx, qy) = sides[k - 1], sides[k]
        turn, alike = px * qy - py * qx, px * qx + py * qy
        ends = [(x + px * by, y + py * by), (x + qx * by, y + qy * by)]
        if turn == 0:
            out.append(ends[1])
        elif turn < 0 and alike >= 2 / max(limit, 1.0) ** 2 - 1 and (half := math.sqrt(max((1 + alike) / 2, 0.0))) > 0:
            size = math.hypot(px + qx, py + qy)
            out.append((x + (px + qx) / size * by / half, y + (py + qy) / size * by / half))
        else:
            out += ends
    return out
