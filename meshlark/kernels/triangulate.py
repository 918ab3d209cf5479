"""Constrained Delaunay triangulation of a polygon with holes, for one region in one task.

Holes are joined to the outer ring by bridges, the ring is cut into ears, and edges that
are not sides are flipped until each is locally Delaunay.  Signs are exact, so the result
does not depend on rounding; ties leave an edge as it is.
"""

from __future__ import annotations

from collections import deque

from .predicates import Point, in_circle, orient, within

Tri = tuple[int, int, int]


def _area2(points: list[Point], ring: list[int]) -> float:
    return sum(points[a][0] * points[b][1] - points[b][0] * points[a][1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _crosses(p: Point, q: Point, a: Point, b: Point) -> bool:
    """Whether pq and ab meet other than in a shared end."""
    if p in (a, b) or q in (a, b):
        other = [(x, y) for x in (p, q) for y in (a, b) if x != y]
        shared = p if p in (a, b) else q
        far = q if shared == p else p
        end = b if shared == a else a
        if far == end:
            return True
        return bool(other) and orient(shared, far, end) == 0 and (far[0] - shared[0]) * (end[0] - shared[0]) + (far[1] - shared[1]) * (end[1] - shared[1]) > 0
    o1, o2, o3, o4 = orient(p, q, a), orient(p, q, b), orient(a, b, p), orient(a, b, q)
    if o1 != o2 and o3 != o4:
        return True
    inside = lambda u, v, w: min(u[0], v[0]) <= w[0] <= max(u[0], v[0]) and min(u[1], v[1]) <= w[1] <= max(u[1], v[1])
    return any(o == 0 and inside(*s) for o, s in ((o1, (p, q, a)), (o2, (p, q, b)), (o3, (a, b, p)), (o4, (a, b, q))))


def _in_angle(before: Point, v: Point, after: Point, q: Point) -> bool:
    """Whether q is strictly in the inner angle of a counter-clockwise ring at v."""
    left, right = orient(v, after, q), orient(before, v, q)
    return left > 0 and right > 0 if orient(before, v, after) > 0 else left > 0 or right > 0


def _faces(points: list[Point], ring: list[int], k: int, q: Point) -> bool:
    return _in_angle(points[ring[k - 1]], points[ring[k]], points[ring[(k + 1) % len(ring)]], q)


def _bridge(points: list[Point], ring: list[int], hole: list[int], rest: list[list[int]]) -> list[int]:
    sides = [(points[a], points[b]) for r in [ring, hole, *rest] for a, b in zip(r, r[1:] + r[:1], strict=True)]
    start = max(range(len(hole)), key=lambda k: points[hole[k]])
    for h in range(len(hole)):
        at = (start + h) % len(hole)
        p = points[hole[at]]
        near = sorted(range(len(ring)), key=lambda k: (points[ring[k]][0] - p[0]) ** 2 + (points[ring[k]][1] - p[1]) ** 2)
        for k in near:
            q = points[ring[k]]
            if p != q and _faces(points, ring, k, p) and not any(_crosses(p, q, *s) for s in sides):
                turned = hole[at:] + hole[: at + 1]
                return ring[: k + 1] + turned + ring[k:]
    raise ValueError("a hole is not inside its outer ring, or rings cross")


def _ears(points: list[Point], ring: list[int]) -> list[Tri]:
    n = len(ring)
    after, before = [(k + 1) % n for k in range(n)], [(k - 1) % n for k in range(n)]
    out: list[Tri] = []
    left, k, tried = n, 0, 0
    while left > 3:
        a, c = before[k], after[k]
        pa, pb, pc = points[ring[a]], points[ring[k]], points[ring[c]]
        turn, clear = orient(pa, pb, pc), True
        if turn > 0:
            # places of the ring may share a point (bridges), so the cut has to run inside at both of its ends
            at = lambda v: points[ring[v]]
            clear = tried > left or _in_angle(at(before[a]), pa, pb, pc) and _in_angle(pb, pc, at(after[c]), pa)
            m = after[c]
            while m != a and clear:
                p = points[ring[m]]
                clear = p in (pa, pb, pc) or not within(pa, pb, pc, p)
                m = after[m]
        if turn > 0 and clear or turn == 0 and pa == pc or tried > 2 * left:
            if tried > 2 * left and turn <= 0:
                raise ValueError("the ring crosses itself")
            if turn > 0:
                out.append((ring[a], ring[k], ring[c]))
            after[a], before[c] = c, a
            left, tried = left - 1, 0
            k = c
        else:
            k, tried = c, tried + 1
    a, c = before[k], after[k]
    if orient(points[ring[a]], points[ring[k]], points[ring[c]]) > 0:
        out.append((ring[a], ring[k], ring[c]))
    return out


def _delaunay(points: list[Point], tris: list[Tri], fixed: set[frozenset[int]]) -> list[Tri]:
    tri = [list(t) for t in tris]
    owner: dict[frozenset[int], list[int]] = {}
    for k, t in enumerate(tri):
        for i in range(3):
            owner.setdefault(frozenset((t[i], t[i - 1])), []).append(k)
    todo = deque(e for e in owner if e not in fixed)
    waiting = set(todo)
    while todo:
        e = todo.popleft()
        waiting.discard(e)
        pair = owner.get(e, ())
        if len(pair) != 2 or e in fixed:
            continue
        s, t = pair
        a = next(v for v in tri[s] if v not in e)
        d = next(v for v in tri[t] if v not in e)
        i = tri[s].index(a)
        b, c = tri[s][(i + 1) % 3], tri[s][(i + 2) % 3]
        if in_circle(points[a], points[b], points[c], points[d]) <= 0 or orient(points[a], points[b], points[d]) <= 0 or orient(points[d], points[c], points[a]) <= 0:
            continue
        tri[s], tri[t] = [a, b, d], [a, d, c]
        del owner[e]
        owner[frozenset((a, d))] = [s, t]
        for edge, old, new in ((frozenset((b, d)), t, s), (frozenset((a, c)), s, t)):
            owner[edge] = [new if k == old else k for k in owner[edge]]
        for edge in (frozenset((a, b)), frozenset((b, d)), frozenset((d, c)), frozenset((c, a))):
            if edge not in fixed and edge not in waiting:
                todo.append(edge)
                waiting.add(edge)
    return [tuple(t) for t in tri]  # type: ignore[misc]


def triangulate(outer: list[Point], holes: list[list[Point]]) -> tuple[list[Point], list[Tri], set[frozenset[int]]]:
    """(points, counter-clockwise triangles, sides): points are numbered by place, the first of equal ones.

    Winding is put right, repeated neighbours are dropped, and rings without area are left out; an outer ring
    without area gives no triangles.  Rings that cross raise ValueError.
    """
    ids: dict[Point, int] = {}
    points: list[Point] = []

    def ring_of(ring: list[Point], ccw: bool) -> list[int]:
        out: list[int] = []
        for p in ring:
            p = (p[0] + 0.0, p[1] + 0.0)
            if p not in ids:
                ids[p] = len(points)
                points.append(p)
            if not out or out[-1] != ids[p]:
                out.append(ids[p])
        while len(out) > 1 and out[0] == out[-1]:
            out.pop()
        area = _area2(points, out) if len(out) > 2 else 0
        return [] if area == 0 else out if (area > 0) == ccw else out[::-1]

    ring = ring_of(outer, True)
    inner = [h for h in (ring_of(h, False) for h in holes) if h]
    if not ring:
        return [], [], set()
    sides = {frozenset(s) for r in [ring, *inner] for s in zip(r, r[1:] + r[:1], strict=True)}
    inner.sort(key=lambda r: max(points[v] for v in r), reverse=True)
    for k, hole in enumerate(inner):
        ring = _bridge(points, ring, hole, inner[k + 1 :])
    return points, _delaunay(points, _ears(points, ring), sides), sides
