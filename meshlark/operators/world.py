"""Worlds of tiles: meshes at offsets, linked where their borders overlap."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom as G
from ..kernels.search import BLOCKED, CLEAR, OUTSIDE, UNSURE, Mesh, crossing, nearest_on, pull
from . import mesh as M
from . import spatial


def tile_boxes(tris: DataFrame) -> DataFrame:
    """(id, x0, y0, x1, y1) per tile of triangles (tile, tid, ax..cy) in world coordinates."""
    box = G.Box.of(*M.corners())
    return tris.groupBy(F.col("tile").alias("id")).agg(F.min(box.x0).alias("x0"), F.min(box.y0).alias("y0"), F.max(box.x1).alias("x1"), F.max(box.y1).alias("y1"))


def place(tris: DataFrame, tiles: DataFrame) -> DataFrame:
    """Triangles (tile, ...) moved to their tile's offset (tile, dx, dy)."""
    return M.translate(tris.join(tiles, "tile"), F.col("dx"), F.col("dy")).drop("dx", "dy")


def stitch(edges: DataFrame, size: float, tol: float = 1e-6) -> DataFrame:
    """(tile_a, tri_a, tile_b, tri_b, x0, y0, x1, y1): border edges (tile, tid, ax, ay, bx, by) of different tiles,
    the lower tile first, that overlap along a line by more than tol.

    Edges meet by the cells of their boxes, grown by tol; only pairs with a common cell are tested.
    """
    box = lambda p: G.Box.of(G.point(f"{p}ax", f"{p}ay"), G.point(f"{p}bx", f"{p}by")).grow(tol)
    names = ("tile", "tid", "ax", "ay", "bx", "by")
    sides = []
    for p in ("l_", "r_"):
        e = edges.select(*[F.col(n).alias(p + n) for n in names])
        sides.append(spatial.bucket_boxes(e, size, box(p)))
    met = sides[0].join(sides[1], ["gx", "gy"]).where("l_tile < r_tile")
    low = (spatial.cell_of(F.greatest(box("l_").x0, box("r_").x0), size) == F.col("gx")) & (spatial.cell_of(F.greatest(box("l_").y0, box("r_").y0), size) == F.col("gy"))
    a, b = G.point("l_ax", "l_ay"), G.point("l_bx", "l_by")
    hit = met.where(box("l_").intersects(box("r_")) & low).withColumn("o", G.collinear_overlap(a, b, G.point("r_ax", "r_ay"), G.point("r_bx", "r_by"), tol)).where("o is not null")
    run = (b - a).length()
    p, q = a.lerp(b, F.col("o.t0") / run), a.lerp(b, F.col("o.t1") / run)
    return hit.select(F.col("l_tile").alias("tile_a"), F.col("l_tid").alias("tri_a"), F.col("r_tile").alias("tile_b"), F.col("r_tid").alias("tri_b"), p.x.alias("x0"), p.y.alias("y0"), q.x.alias("x1"), q.y.alias("y1"))


def locate(points: DataFrame, tris: DataFrame, size: float) -> DataFrame:
    """points (id, x, y) with tile, tid: the lowest tile, then triangle, that holds the point; null outside."""
    key = F.struct("tile", "tid")
    found = spatial.locate(points, tris.withColumn("tid", key), size)
    return found.select(*points.columns, F.col("tid.tile").alias("tile"), F.col("tid.tid").alias("tid"))


def metadata_at(points: DataFrame, tris: DataFrame, meta: DataFrame, size: float) -> DataFrame:
    """points with tid and the columns that meta (tid, ...) has for it, null outside the mesh or without an entry."""
    return spatial.locate(points, tris, size).join(meta, "tid", "left")


class TiledMesh:
    """Meshes by tile with links between triangles of different tiles; a node is (tile, triangle)."""

    def __init__(self, tiles: dict[int, Mesh], links: list[tuple[int, int, int, int, float, float, float, float]]):
        self.tiles = tiles
        self.links: dict[tuple[int, int], list[tuple[tuple[int, int], tuple[float, float], tuple[float, float]]]] = {}
        for ta, a, tb, b, x0, y0, x1, y1 in sorted(links):
            self.links.setdefault((ta, a), []).append(((tb, b), (x0, y0), (x1, y1)))
            self.links.setdefault((tb, b), []).append(((ta, a), (x0, y0), (x1, y1)))

    def locate(self, p) -> tuple[int, int] | None:
        for k in sorted(self.tiles):
            if (t := self.tiles[k].locate(p)) is not None:
                return k, t
        return None

    def _next(self, node):
        k, t = node
        m = self.tiles[k]
        for i in range(3):
            e, o = m.edge(m.tris[t], i), m.across(t, i)
            if o is not None and e not in m.walls:
                yield (k, o), m.vertices[e[0]], m.vertices[e[1]]
        yield from self.links.get(node, ())

    def path(self, start, goal) -> list[tuple[float, float]] | None:
        """Corners from start to goal across tiles, or None."""
        a, b = self.locate(start), self.locate(goal)
        if a is None or b is None:
            return None
        cost, entry, came, done, heap = {a: 0.0}, {a: start}, {}, set(), [(math.dist(start, goal), a)]
        while heap:
            _, n = heapq.heappop(heap)
            if n == b:
                break
            if n in done:
                continue
            done.add(n)
            for o, p, q in self._next(n):
                if o in done:
                    continue
                at = nearest_on(p, q, entry[n])
                step, ahead = math.dist(entry[n], at), math.dist(at, goal)
                new = cost[n] + step + (ahead if o == b else 0.0)
                if new < cost.get(o, math.inf):
                    cost[o], entry[o], came[o] = new, at, (n, p, q)
                    heapq.heappush(heap, (new + (0.0 if o == b else ahead), o))
        else:
            return None
        gates, n = [], b
        while n != a:
            before, p, q = came[n]
            m = self.tiles[before[0]]
            c = [sum(v) / 3 for v in zip(*m.corners(before[1]), strict=True)]
            # seen from the triangle that is left, the left end comes later in its counter-clockwise order
            turn = (p[0] - c[0]) * (q[1] - c[1]) - (p[1] - c[1]) * (q[0] - c[0])
            gates.append((q, p) if turn > 0 else (p, q))
            n = before
        return pull(start, goal, gates[::-1])

    def sight(self, p, q):
        """As Mesh.sight, through links where the line leaves a tile."""
        n = self.locate(p)
        if n is None:
            return OUTSIDE, None
        seen: set[tuple[int, int]] = set()
        while n not in seen:
            seen.add(n)
            m, t = self.tiles[n[0]], n[1]
            if m.locate(q) == t:
                return CLEAR, None
            best = None
            for i in range(3):
                e = m.edge(m.tris[t], i)
                hit = crossing(p, q, m.vertices[e[0]], m.vertices[e[1]])
                if hit is not None and (best is None or hit > best[0]):
                    best = hit, i, e
            if best is None:
                return UNSURE, None
            at = p[0] + (q[0] - p[0]) * best[0], p[1] + (q[1] - p[1]) * best[0]
            beyond = m.across(t, best[1])
            if beyond is not None and best[2] not in m.walls:
                n = n[0], beyond
                continue
            link = next((o for o, a, b in self.links.get(n, ()) if math.dist(nearest_on(a, b, at), at) <= 1e-6), None)
            if link is None:
                return BLOCKED, at
            n = link
        return UNSURE, None


def zone_crossings(steps: DataFrame) -> DataFrame:
    """(path, seq, tid, from_zone, to_zone) where zone changes along (path, seq, tid, zone), null zones included."""
    w = Window.partitionBy("path").orderBy("seq")
    s = steps.withColumns({"from_zone": F.lag("zone").over(w), "k": F.row_number().over(w)})
    return s.where((F.col("k") > 1) & ~F.col("from_zone").eqNullSafe(F.col("zone"))).select("path", "seq", "tid", "from_zone", F.col("zone").alias("to_zone"))
