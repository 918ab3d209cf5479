"""The registered queries over the lattice views, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geom as G
from ..kernels import sweep
from ..operators import crowd, doors, graph, grid, mesh, navigation, paths, rings, spatial, world
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SIZE = 8.0  # bucket of the lattice joins


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return put


_IN = """(NOT (((bx-ax)*(y-ay)-(by_-ay)*(x-ax) < 0 OR (cx-bx)*(y-by_)-(cy-by_)*(x-bx) < 0 OR (ax-cx)*(y-cy)-(ay-cy)*(x-cx) < 0)
       AND ((bx-ax)*(y-ay)-(by_-ay)*(x-ax) > 0 OR (cx-bx)*(y-by_)-(cy-by_)*(x-bx) > 0 OR (ax-cx)*(y-cy)-(ay-cy)*(x-cx) > 0)))"""
_LOCATED = f"located AS (SELECT p.id, min(t.tid) AS tid FROM pts p JOIN g_tris t ON p.x BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND p.y BETWEEN least(ay, by_, cy) AND greatest(ay, by_, cy) AND {_IN} GROUP BY p.id)"
_REGION = "label AS (SELECT c, min(r) AS r FROM cell_reach GROUP BY c), region AS (SELECT t.tid, dense_rank() OVER (ORDER BY l.r) - 1 AS region FROM g_tris t JOIN label l ON t.cell = l.c)"


def _with(views: str, ctes: str, body: str) -> str:
    """A statement over views and further expressions."""
    head = V.sql(views, "\x00")
    return head.replace("\n\x00", f",\n{ctes}\n{body}")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return mesh.regions(mesh.adjacency(V.tris(spark, d)))


@query(_with("pts g_tris cell_reach", f"{_LOCATED}, {_REGION}", """
SELECT r.region, n.n AS n_points, a.area2 FROM (SELECT DISTINCT region FROM region) r
JOIN (SELECT region, count(*) AS n FROM located JOIN region USING (tid) GROUP BY 1) n USING (region)
JOIN (SELECT region, sum((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax)) AS area2 FROM g_tris JOIN region USING (tid) GROUP BY 1) a USING (region)"""))
def point_region_stats(spark: SparkSession, d: str) -> DataFrame:
    """Points per connected region, and its doubled area."""
    t = V.tris(spark, d)
    region = mesh.regions(mesh.adjacency(t))
    hits = spatial.locate(V.points(spark, d), t, SIZE).where("tid is not null")
    n = hits.join(region, "tid").groupBy("region").agg(F.count("*").alias("n_points"))
    area = t.join(region, "tid").groupBy("region").agg(F.sum(mesh.tri_area2()).alias("area2"))
    return n.join(area, "region").select("region", "n_points", "area2")


@query(_with("pts g_tris", _LOCATED, "SELECT p.id, l.tid FROM pts p LEFT JOIN located l USING (id)"))
def locate(spark: SparkSession, d: str) -> DataFrame:
    return spatial.locate(V.points(spark, d), V.tris(spark, d), SIZE).select("id", "tid")


@query(V.sql("g_tris", """
SELECT tid, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS area2, ax+bx+cx AS sx, ay+by_+cy AS sy, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) > 0 AS ccw,
       least(ax,bx,cx) AS x0, least(ay,by_,cy) AS y0, greatest(ax,bx,cx) AS x1, greatest(ay,by_,cy) AS y1 FROM g_tris"""))
def tri_scalars(spark: SparkSession, d: str) -> DataFrame:
    A, B, C = mesh.corners()
    box = G.Box.of(A, B, C)
    area = G.area2(A, B, C)
    return V.tris(spark, d).select("tid", area.alias("area2"), (A.x + B.x + C.x).alias("sx"), (A.y + B.y + C.y).alias("sy"), (area > 0).alias("ccw"), *[v.alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


_ORIENTS = "o AS (SELECT *, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS o1, (bx-ax)*(dy-ay)-(by_-ay)*(dx-ax) AS o2, (dx-cx)*(ay-cy)-(dy-cy)*(ax-cx) AS o3, (dx-cx)*(by_-cy)-(dy-cy)*(bx-cx) AS o4 FROM line_pairs)"
_BOX = lambda a, b, p: f"({p}x BETWEEN least({a}x,{b}x) AND greatest({a}x,{b}x) AND {p}y{'_' if p == 'b' else ''} BETWEEN least({a}y,{b}y{'_' if b == 'b' else ''}) AND greatest({a}y,{b}y{'_' if b == 'b' else ''}))"
@query(_with("line_pairs", _ORIENTS, f"""
SELECT i, j, CASE WHEN o1 = 0 AND o2 = 0 AND o3 = 0 AND o4 = 0 THEN
           CASE WHEN {_BOX('a', 'b', 'c')} OR {_BOX('a', 'b', 'd')} OR {_BOX('c', 'd', 'a')} OR {_BOX('c', 'd', 'b')} THEN 'collinear' ELSE 'none' END
         WHEN sign(o1) * sign(o2) < 0 AND sign(o3) * sign(o4) < 0 OR o1 = 0 AND {_BOX('a', 'b', 'c')} OR o2 = 0 AND {_BOX('a', 'b', 'd')}
              OR o3 = 0 AND {_BOX('c', 'd', 'a')} OR o4 = 0 AND {_BOX('c', 'd', 'b')} THEN 'point' ELSE 'none' END AS kind FROM o"""))
def orient_classify(spark: SparkSession, d: str) -> DataFrame:
    """How all lines with touching boxes meet."""
    met = spatial.line_pairs(V.lines(spark, d, once=False), lambda *ends: {"kind": sweep.meet(*ends)}, "kind byte")
    return met.select("i", "j", F.when(F.col("kind") == 0, "none").when(F.col("kind") == 1, "point").otherwise("collinear").alias("kind"))


@query(V.sql("line_pairs", """
SELECT i, j, abs(den) AS den, tn * sign(den)::BIGINT AS tn, un * sign(den)::BIGINT AS un FROM (
  SELECT i, j, (bx-ax)*(dy-cy)-(by_-ay)*(dx-cx) AS den, (cx-ax)*(dy-cy)-(cy-ay)*(dx-cx) AS tn, (cx-ax)*(by_-ay)-(cy-ay)*(bx-ax) AS un FROM line_pairs)
WHERE den <> 0 AND tn * sign(den) BETWEEN 0 AND abs(den) AND un * sign(den) BETWEEN 0 AND abs(den)"""))
def segment_hits(spark: SparkSession, d: str) -> DataFrame:
    """The crossings of all lines, their parameters as exact fractions tn/den and un/den."""
    def hits(a, b, c, d) -> dict:
        rx, ry, sx, sy, px, py = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1], c[0] - a[0], c[1] - a[1]
        den = rx * sy - ry * sx
        turn = np.sign(den)
        den, tn, un = den * turn, (px * sy - py * sx) * turn, (px * ry - py * rx) * turn
        return {"den": den, "tn": tn, "un": un, "_keep": (den != 0) & (tn >= 0) & (tn <= den) & (un >= 0) & (un <= den)}

    return spatial.line_pairs(V.lines(spark, d, once=False), hits, "den long, tn long, un long")


@query(V.sql("spots lines", """
SELECT id, s, round(ax + (bx-ax)*t, 6) AS qx, round(ay + (by_-ay)*t, 6) AS qy FROM (
  SELECT DISTINCT p.id, l.id AS s, ax, ay, bx, by_, CASE WHEN ax = bx AND ay = by_ THEN 0.0::DOUBLE ELSE
      least(greatest(((x-ax)*(bx-ax)+(y-ay)*(by_-ay))::DOUBLE / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)), 0), 1) END AS t
  FROM (SELECT *, x // 32 AS gx, y // 32 AS gy FROM spots) p
  JOIN (SELECT *, unnest(range((least(ay, by_) - 16) // 32, (greatest(ay, by_) + 16) // 32 + 1)) AS gy FROM (SELECT *, unnest(range((least(ax, bx) - 16) // 32, (greatest(ax, bx) + 16) // 32 + 1)) AS gx FROM lines)) l
    ON p.gx = l.gx AND p.gy = l.gy AND x BETWEEN least(ax, bx) - 16 AND greatest(ax, bx) + 16 AND y BETWEEN least(ay, by_) - 16 AND greatest(ay, by_) + 16)"""))
def nearest_on_segment(spark: SparkSession, d: str) -> DataFrame:
    """The nearest place to every spot on each line whose box, grown by 16, holds it."""
    s = V.lines(spark, d, once=False).withColumnRenamed("id", "s")
    return spatial.near_segments(V.spots(spark, d), s, 16, 6)


@query(V.sql("ring_edges", """
SELECT ring_id, count(*) AS n, sum(ax*by_-bx*ay) AS area2, CASE WHEN sum(ax*by_-bx*ay) > 0 THEN 'ccw' WHEN sum(ax*by_-bx*ay) < 0 THEN 'cw' ELSE 'degenerate' END AS winding,
       min(ax) AS x0, min(ay) AS y0, max(ax) AS x1, max(ay) AS y1 FROM ring_edges GROUP BY ring_id"""))
def ring_shoelace(spark: SparkSession, d: str) -> DataFrame:
    return rings.shoelace(V.rings(spark, d))


_CROSS = "(ay <= y AND by_ > y AND (bx-ax)*(y-ay)-(by_-ay)*(x-ax) > 0) OR (by_ <= y AND ay > y AND (bx-ax)*(y-ay)-(by_-ay)*(x-ax) < 0)"
_SOME_RINGS = "r AS (SELECT * FROM ring_edges WHERE ring_id % 50 = 0)"


@query(_with("pts ring_edges", _SOME_RINGS, f"""
SELECT id, ring_id FROM pts CROSS JOIN r GROUP BY id, ring_id
HAVING count(*) FILTER ({_CROSS}) % 2 = 1 OR bool_or((bx-ax)*(y-ay)-(by_-ay)*(x-ax) = 0 AND x BETWEEN least(ax,bx) AND greatest(ax,bx) AND y BETWEEN least(ay,by_) AND greatest(ay,by_))"""))
def ring_contains(spark: SparkSession, d: str) -> DataFrame:
    """Points in the rings of every 50th customer (the rings asked about)."""
    return rings.containing(V.points(spark, d), V.rings(spark, d).where("ring_id % 50 = 0"), SIZE)


def _winding(spark: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    e = rings.ring_edges(asked).select("ring_id", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", F.col("by").alias("by_"))
    return spatial.winding_numbers(V.points(spark, d).select("id", "x", "y"), e, SIZE)


@query(_with("pts ring_edges", _SOME_RINGS, """
SELECT id, ring_id, sum(CASE WHEN ay <= y AND by_ > y AND (bx-ax)*(y-ay)-(by_-ay)*(x-ax) > 0 THEN 1 WHEN by_ <= y AND ay > y AND (bx-ax)*(y-ay)-(by_-ay)*(x-ax) < 0 THEN -1 ELSE 0 END) AS winding
FROM pts CROSS JOIN r GROUP BY id, ring_id HAVING winding <> 0"""))
def winding_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Winding numbers about the rings of every 50th customer."""
    return _winding(spark, d, V.rings(spark, d).where("ring_id % 50 = 0"))


@query(V.sql("rings", """
SELECT ring_id, seq, x, y FROM (
  SELECT ring_id, seq, x, y, coalesce(lag(x) OVER w, last_value(x) OVER a) AS px, coalesce(lag(y) OVER w, last_value(y) OVER a) AS py,
         coalesce(lead(x) OVER w, first_value(x) OVER a) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER a) AS ny FROM rings
  WINDOW w AS (PARTITION BY ring_id ORDER BY seq), a AS (PARTITION BY ring_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
WHERE (x-px)*(ny-py)-(y-py)*(nx-px) <> 0"""))
def ring_drop_collinear_1pass(spark: SparkSession, d: str) -> DataFrame:
    return rings.collinear_pass(V.rings(spark, d))


@query(V.sql("borders", "SELECT col, row, dir, x0, y0, x1, y1 FROM borders"))
def border_edges(spark: SparkSession, d: str) -> DataFrame:
    return grid.border_edges(V.cells(spark, d)).drop("grid_id")


@query(V.sql("borders", f"""
SELECT edge, next FROM (
  SELECT (e.row * {V.WIDTH} + e.col) * 4 + e.dir AS edge, (n.row * {V.WIDTH} + n.col) * 4 + n.dir AS next,
         row_number() OVER (PARTITION BY e.row, e.col, e.dir ORDER BY (n.col = e.col AND n.row = e.row) DESC, (n.row * {V.WIDTH} + n.col) * 4 + n.dir) AS k
  FROM borders e JOIN borders n ON e.x1 = n.x0 AND e.y1 = n.y0) WHERE k = 1"""))
def loop_successor(spark: SparkSession, d: str) -> DataFrame:
    return grid.loop_successors(grid.border_edges(V.cells(spark, d)), V.WIDTH).select("edge", "next")


_SEED = f"""seeds AS (SELECT c.col, c.row, c.walkable, c.col IN (0, {V.WIDTH - 1}) OR c.row IN (0, {V.HEIGHT - 1}) OR EXISTS (
  SELECT 1 FROM g_cells o WHERE NOT o.walkable AND o.col BETWEEN c.col - 1 AND c.col + 1 AND o.row BETWEEN c.row - 1 AND c.row + 1) AS seed FROM g_cells c)"""


@query(_with("g_cells", _SEED, "SELECT col, row, seed FROM seeds"))
def seed_mask(spark: SparkSession, d: str) -> DataFrame:
    return grid.seed_mask(V.cells(spark, d), V.WIDTH, V.HEIGHT).select("col", "row", "seed")


@query(_with("g_cells", _SEED, "SELECT col, row, NOT seed AS walkable FROM seeds"))
def erode_r1(spark: SparkSession, d: str) -> DataFrame:
    return grid.erode(V.cells(spark, d), V.WIDTH, V.HEIGHT, 1.0).select("col", "row", "walkable")


@query(_with("g_cells", _SEED, "SELECT a.col, a.row, min((a.col - b.col) * (a.col - b.col)) AS g FROM seeds a JOIN seeds b ON a.row = b.row AND b.seed GROUP BY a.col, a.row"))
def edt_row_pass(spark: SparkSession, d: str) -> DataFrame:
    return grid.row_pass(grid.seed_mask(V.cells(spark, d), V.WIDTH, V.HEIGHT)).select("col", "row", "g")


_SQ = "sq AS (SELECT a.col, a.row, min((a.col - b.col) * (a.col - b.col) + (a.row - b.row) * (a.row - b.row)) AS sq FROM seeds a CROSS JOIN seeds b WHERE b.seed GROUP BY a.col, a.row)"


@query(_with("g_cells", f"{_SEED}, {_SQ}", "SELECT col, row, sq FROM sq"))
def clearance_sq(spark: SparkSession, d: str) -> DataFrame:
    return grid.clearance(V.cells(spark, d), V.WIDTH, V.HEIGHT).select("col", "row", "sq")


@query(_with("g_cells", f"{_SEED}, {_SQ}", "SELECT col, row, sq >= 2 AS walkable FROM sq"))
def erode_r14(spark: SparkSession, d: str) -> DataFrame:
    return grid.erode(V.cells(spark, d), V.WIDTH, V.HEIGHT, 1.4).select("col", "row", "walkable")


@query(V.sql("g_cells", """
SELECT c.i AS col, r.i AS row, coalesce(g.walkable, false) AS walkable FROM range(20) c(i) CROSS JOIN range(12) r(i) LEFT JOIN g_cells g ON g.col = c.i - 5 AND g.row = r.i - 3"""))
def subgrid_padded(spark: SparkSession, d: str) -> DataFrame:
    window = spark.createDataFrame([(0, -5, -3, 20, 12)], "grid_id long, col0 long, row0 long, w long, h long")
    return grid.subgrid(V.cells(spark, d), window).select("col", "row", "walkable")


@query(V.sql("adj", "SELECT tid, e, nbr FROM adj"))
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return mesh.adjacency(V.tris(spark, d)).select("tid", "e", "nbr")


def _door_lines(spark: SparkSession) -> DataFrame:
    return spark.range(16).select(F.col("id").alias("door"), (F.col("id") * 8 + 3).alias("ax"), F.lit(0).cast("long").alias("ay"), (F.col("id") * 8 + 3).alias("bx"), (F.col("id") * 5 + 10).alias("by"))


_LINES = "lines AS (SELECT i AS door, i * 8 + 3 AS px, 0 AS py, i * 8 + 3 AS qx, i * 5 + 10 AS qy FROM range(16) r(i))"
_EDGE_XY = f"""ex AS (SELECT tid, e, lo, hi, nbr, 2 * (lo % {V.WIDTH + 1}) AS ax, 2 * (lo // {V.WIDTH + 1}) AS ay, 2 * (hi % {V.WIDTH + 1}) AS bx, 2 * (hi // {V.WIDTH + 1}) AS by_ FROM adj)"""
_CUT = """cut AS (SELECT DISTINCT door, lo, hi FROM (SELECT door, lo, hi, (qx-px)*(by_-ay)-(qy-py)*(bx-ax) AS den, (ax-px)*(by_-ay)-(ay-py)*(bx-ax) AS tn, (ax-px)*(qy-py)-(ay-py)*(qx-px) AS un
  FROM lines CROSS JOIN ex WHERE nbr IS NOT NULL) WHERE den <> 0 AND tn::DOUBLE / den BETWEEN 0 AND 1 AND un::DOUBLE / den BETWEEN 0 AND 1)"""


def _edge_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Edges with neighbours, their ends and boxes."""
    e = mesh.adjacency(V.tris(spark, d)).where("nbr is not null and nbr > tid")
    x, y = (lambda v: 2 * (F.col(v) % (V.WIDTH + 1))), (lambda v: 2 * F.floor(F.col(v) / (V.WIDTH + 1)))
    return e.select("lo", "hi", x("lo").alias("ax"), y("lo").alias("ay"), x("hi").alias("bx"), y("hi").alias("by"))


def _door_edges(spark: SparkSession, d: str) -> DataFrame:
    return doors.edges(_door_lines(spark), _edge_boxes(spark, d), SIZE)


@query(_with("adj", f"{_LINES}, {_EDGE_XY}, {_CUT}", "SELECT door, lo, hi FROM cut"))
def door_edges(spark: SparkSession, d: str) -> DataFrame:
    return _door_edges(spark, d)


_FOLD = """f AS (SELECT *, sum(CASE WHEN action = 'toggle' THEN 1 ELSE 0 END) OVER w AS flips, max(CASE WHEN action <> 'toggle' THEN k END) OVER w AS lastset FROM
   (SELECT *, row_number() OVER (PARTITION BY door ORDER BY ts, seq) AS k FROM door_events) WINDOW w AS (PARTITION BY door ORDER BY k ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT a.door, a.k, (CASE WHEN b.action = 'close' THEN 1 ELSE 0 END + a.flips - coalesce(b.flips, 0)) % 2 AS closed FROM f a LEFT JOIN f b ON a.door = b.door AND a.lastset = b.k),
 g AS (SELECT door, k, closed, closed <> coalesce(lag(closed) OVER (PARTITION BY door ORDER BY k), 0) AS changed FROM s),
 doors AS (SELECT door, CASE WHEN arg_max(closed, k) = 1 THEN 'closed' ELSE 'open' END AS state, count(*) FILTER (changed) AS generation FROM g GROUP BY door)"""


@query(_with("door_events", _FOLD, "SELECT door, state, generation FROM doors"))
def door_state(spark: SparkSession, d: str) -> DataFrame:
    return doors.state(V.door_events(spark, d))


_WALL_SQL = "walls AS (SELECT DISTINCT lo, hi FROM adj WHERE nbr IS NULL UNION SELECT lo, hi FROM cut JOIN doors USING (door) WHERE state = 'closed')"


def _walls(spark: SparkSession, d: str) -> DataFrame:
    closed = _door_edges(spark, d).join(doors.state(V.door_events(spark, d)).where("state = 'closed'"), "door")
    return mesh.wall_edges(mesh.adjacency(V.tris(spark, d)), closed)


@query(_with("adj door_events", f"{_LINES}, {_EDGE_XY}, {_CUT}, {_FOLD}, {_WALL_SQL}", "SELECT lo, hi FROM walls"))
def wall_edges(spark: SparkSession, d: str) -> DataFrame:
    """Walls with closed doors."""
    return _walls(spark, d)


@query(_with("adj door_events", f"{_LINES}, {_EDGE_XY}, {_CUT}, {_FOLD}, {_WALL_SQL}", "SELECT lo AS vid FROM walls UNION SELECT hi FROM walls"))
def wall_vertices(spark: SparkSession, d: str) -> DataFrame:
    return mesh.wall_vertices(_walls(spark, d))


@query(V.sql("adj", "SELECT tid, e, a, b FROM adj WHERE nbr IS NULL"))
def boundary_outline(spark: SparkSession, d: str) -> DataFrame:
    return mesh.boundary(mesh.adjacency(V.tris(spark, d)))


@query(_with("g_tris cell_reach", _REGION, "SELECT tid, region FROM region"))
def regions(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d)


@query(_with("g_tris cell_reach", _REGION, """
SELECT region, n, area2, round(mx::DOUBLE / (3 * area2), 6) AS x, round(my::DOUBLE / (3 * area2), 6) AS y, x0, y0, x1, y1 FROM (
  SELECT region, count(*) AS n, sum(a) AS area2, sum(a * (ax+bx+cx)) AS mx, sum(a * (ay+by_+cy)) AS my, min(least(ax,bx,cx)) AS x0, min(least(ay,by_,cy)) AS y0,
         max(greatest(ax,bx,cx)) AS x1, max(greatest(ay,by_,cy)) AS y1 FROM (SELECT *, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS a FROM g_tris) JOIN region USING (tid) GROUP BY region)"""))
def region_stats(spark: SparkSession, d: str) -> DataFrame:
    s = mesh.region_stats(V.tris(spark, d), _regions(spark, d))
    whole = F.col("area2") * 3
    return s.select("region", "n", "area2", F.round(F.col("mx").cast("double") / whole, 6).alias("x"), F.round(F.col("my").cast("double") / whole, 6).alias("y"), "x0", "y0", "x1", "y1")


@query(_with("pts g_tris cell_reach", f"{_LOCATED}, {_REGION}", """
SELECT a.id AS start_id, b.id AS goal_id, r.region = s.region AS reachable FROM pts a JOIN pts b ON b.id = a.id + 1
JOIN located la ON la.id = a.id JOIN located lb ON lb.id = b.id JOIN region r ON r.tid = la.tid JOIN region s ON s.tid = lb.tid"""))
def reachable_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = V.tris(spark, d)
    at = spatial.locate(V.points(spark, d), t, SIZE).where("tid is not null").join(mesh.regions(mesh.adjacency(t)), "tid").select("id", "region")
    goal = at.select((F.col("id") - 1).alias("id"), F.col("id").alias("goal_id"), F.col("region").alias("goal"))
    return at.join(goal, "id").select(F.col("id").alias("start_id"), "goal_id", (F.col("region") == F.col("goal")).alias("reachable"))


@query(V.sql("boxes g_tris", """
SELECT id, tid FROM boxes JOIN g_tris ON x0 <= greatest(ax,bx,cx) AND x1 >= least(ax,bx,cx) AND y0 <= greatest(ay,by_,cy) AND y1 >= least(ay,by_,cy)"""))
def aabb_query(spark: SparkSession, d: str) -> DataFrame:
    t = spatial.with_box(V.tris(spark, d)).withColumnRenamed("tid", "id")
    return spatial.boxes_meet(V.boxes(spark, d), t, SIZE).select(F.col("l_id").alias("id"), F.col("r_id").alias("tid"))


def _edge_d2(s: str, e: str) -> str:
    sx, sy, ex, ey = f"{s}x", f"{s}y" + "_" * (s == "b"), f"{e}x", f"{e}y" + "_" * (e == "b")
    t = f"least(greatest(((x-{sx})*({ex}-{sx})+(y-{sy})*({ey}-{sy}))::DOUBLE / (({ex}-{sx})*({ex}-{sx})+({ey}-{sy})*({ey}-{sy})), 0), 1)"
    return f"power({sx} + ({ex}-{sx})*{t} - x, 2) + power({sy} + ({ey}-{sy})*{t} - y, 2)"


@query(_with("pts g_tris", f"near AS (SELECT p.id, tid, CASE WHEN {_IN} THEN 0 ELSE least({_edge_d2('a', 'b')}, {_edge_d2('b', 'c')}, {_edge_d2('c', 'a')}) END AS d2 FROM pts p CROSS JOIN g_tris)", """
SELECT id, arg_min(tid, (round(d2, 6), tid)) AS tid, round(sqrt(min(d2)), 6) AS distance FROM near GROUP BY id"""))
def nearest_triangle(spark: SparkSession, d: str) -> DataFrame:
    """For every point the nearest triangle and its distance."""
    found = spatial.nearest_triangle(V.points(spark, d).select("id", "x", "y"), V.tris(spark, d), 4.0)
    return found.select("id", "tid", F.round(F.sqrt("d2"), 6).alias("distance"))


@query(V.sql("segs", "SELECT x, y, min(id * 2 + k) AS keep, count(*) AS n FROM (SELECT id, 0 AS k, ax AS x, ay AS y FROM segs UNION ALL SELECT id, 1, bx, by_ FROM segs) GROUP BY x, y"))
def dedup_vertices(spark: SparkSession, d: str) -> DataFrame:
    s = V.segments(spark, d)
    v = s.select((F.col("id") * 2).alias("vid"), F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(s.select((F.col("id") * 2 + 1).alias("vid"), F.col("bx").alias("x"), F.col("by").alias("y")))
    return mesh.dedup_vertices(v).groupBy("x", "y").agg(F.min("keep").alias("keep"), F.count("*").alias("n"))


@query(V.sql("segs", """
SELECT least(a, b) AS lo, greatest(a, b) AS hi, coalesce(min(CASE WHEN mark <> 0 THEN mark END), 0) AS mark FROM (SELECT ax * 256 + ay AS a, bx * 256 + by_ AS b, mark FROM segs) WHERE a <> b GROUP BY 1, 2"""))
def merge_segments(spark: SparkSession, d: str) -> DataFrame:
    s = V.segments(spark, d)
    return mesh.merge_segments(s.select((F.col("ax") * 256 + F.col("ay")).alias("a"), (F.col("bx") * 256 + F.col("by")).alias("b"), "mark"))


@query(V.sql("g_tris", """
SELECT part, tid + coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tid, ax, ay FROM (
  SELECT part, n, unnest(ts) AS tid, unnest(xs) AS ax, unnest(ys) AS ay FROM (
    SELECT cell % 3 AS part, max(tid) + 1 AS n, list(tid ORDER BY tid) AS ts, list(ax ORDER BY tid) AS xs, list(ay ORDER BY tid) AS ys FROM g_tris GROUP BY 1))""").replace(
    "SELECT part, tid + coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tid, ax, ay FROM (\n  SELECT part, n, unnest",
    "SELECT part, tid + o AS tid, ax, ay FROM (\n  SELECT part, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o, unnest"))
def mesh_append(spark: SparkSession, d: str) -> DataFrame:
    parts = V.tris(spark, d).select((F.col("cell") % 3).alias("part"), "tid", "ax", "ay")
    return mesh.append(parts)


_STEPS = "steps AS (SELECT user_id, ts, id, x, y, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY ts, id))"


def _arcs(spark: SparkSession, d: str) -> DataFrame:
    return paths.arcs(V.points(spark, d), "user_id", ["ts", "id"])


@query(_with("pts", _STEPS, "SELECT id, user_id, round(sum(coalesce(step, 0)) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 4) AS arc FROM steps"))
def arc_length(spark: SparkSession, d: str) -> DataFrame:
    return _arcs(spark, d).select("id", "user_id", F.round("arc", 4).alias("arc"))


@query(_with("pts", _STEPS + """, arcs AS (SELECT *, sum(coalesce(step, 0)) OVER w AS arc, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
  half AS (SELECT user_id, max(arc) * 0.375 AS s FROM arcs GROUP BY user_id)""", """
SELECT user_id, round(CASE WHEN step < 1e-12 THEN lx ELSE lx + (x - lx) * (s - (arc - step)) / step END, 3) AS px, round(CASE WHEN step < 1e-12 THEN ly ELSE ly + (y - ly) * (s - (arc - step)) / step END, 3) AS py
FROM (SELECT a.*, h.s, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS k FROM arcs a JOIN half h USING (user_id) WHERE a.step IS NOT NULL AND h.s <= a.arc) WHERE k = 1"""))
def point_at_arc(spark: SparkSession, d: str) -> DataFrame:
    """The point at three eighths of each user's way."""
    at = paths.point_at(_arcs(spark, d), "user_id", 0.375)
    return at.select("user_id", F.round("px", 3).alias("px"), F.round("py", 3).alias("py"))


@query(V.sql("pts", """
SELECT user_id, id, zone_from, zone_to FROM (SELECT user_id, id, lag((x // 32) * 10 + y // 24) OVER w AS zone_from, (x // 32) * 10 + y // 24 AS zone_to, row_number() OVER w AS k FROM pts
WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)) WHERE k > 1 AND zone_from IS DISTINCT FROM zone_to"""))
def zone_crossings(spark: SparkSession, d: str) -> DataFrame:
    zone = (F.floor(F.col("x") / 32) * 10 + F.floor(F.col("y") / 24)).cast("long")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "id"))
    steps = V.points(spark, d).select(F.col("user_id").alias("path"), seq.alias("seq"), F.col("id").alias("tid"), zone.alias("zone"))
    return world.zone_crossings(steps).select(F.col("path").alias("user_id"), F.col("tid").alias("id"), F.col("from_zone").alias("zone_from"), F.col("to_zone").alias("zone_to"))


@query(V.sql("g_tris pts", """
SELECT d.id, t.tid FROM (SELECT id, (id * 7919 % 65536) / 65536.0::DOUBLE AS u FROM pts) d
JOIN (SELECT tid, sum(a) OVER (ORDER BY tid) AS top, a, sum(a) OVER () AS total FROM (SELECT tid, ((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))::DOUBLE AS a FROM g_tris)) t
  ON d.u * t.total >= t.top - t.a AND d.u * t.total < t.top"""))
def area_sampling(spark: SparkSession, d: str) -> DataFrame:
    u = lambda k: ((F.col("id") * k % 65536) / F.lit(65536.0))
    draws = V.points(spark, d).select("id", u(7919).alias("u0"), u(104729).alias("u1"), u(1299709).alias("u2"))
    return mesh.sample_points(V.tris(spark, d), draws).select("id", "tid")


@query("""
SELECT batch, count(*) AS submitted, count(*) - 1 AS coalesced, max(event_id) AS latest, row_number() OVER (ORDER BY batch) AS generation
FROM (SELECT event_id, date_trunc('hour', ts) AS batch FROM events) GROUP BY batch""")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Per batch (an hour) the newest snapshot is built and the others are passed over."""
    e = V.table(spark, d, "events").select("event_id", F.date_trunc("hour", "ts").alias("batch"))
    b = e.groupBy("batch").agg(F.count("*").alias("submitted"), (F.count("*") - 1).alias("coalesced"), F.max("event_id").alias("latest"))
    return graph.ranked(b, ["batch"]).select(*b.columns, (F.col("rank") + 1).alias("generation"))


@query(V.sql("agent_pairs", "SELECT id, other FROM agent_pairs"))
def crowd_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return spatial.neighbours(V.agents(spark, d).select("id", "x", "y"), 4.0)


_CONTACTS = """q AS (SELECT n.id, b.priority - a.priority AS above, (b.x-a.x) AS px, (b.y-a.y) AS py, (a.vx-b.vx) AS wx, (a.vy-b.vy) AS wy FROM agent_pairs n JOIN agents a ON a.id = n.id JOIN agents b ON b.id = n.other),
 c AS (SELECT id, above, px*px+py*py-1 AS c, px*wx+py*wy AS b, wx*wx+wy*wy AS a FROM q),
 t AS (SELECT id, CASE WHEN c < 0 THEN 1.0 WHEN a > 0 AND b > 0 AND b*b - a*c >= 0 AND (b - sqrt((b*b - a*c))) / a < 2
               THEN (1 - (b - sqrt((b*b - a*c))) / a / 2) * power(2, greatest(least(above / 2, 2), -2)) ELSE 0 END AS p FROM c)"""


@query(_with("agent_pairs", _CONTACTS, "SELECT id, round(max(p), 6) AS penalty FROM t GROUP BY id"))
def ttc_penalty(spark: SparkSession, d: str) -> DataFrame:
    """The largest time-to-contact penalty of each agent's own velocity among its neighbours, over two seconds."""
    return crowd.penalties(V.agents(spark, d), None, crowd.Settings(cell=4.0)).select("id", F.round("penalty", 6).alias("penalty"))


# Graph and triangulation kernels: no SQL; tests/ holds them to their own properties


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Each point asks the way to the next one."""
    p = V.points(spark, d).select("id", "x", "y")
    goal = p.select((F.col("id") - 1).alias("id"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    return p.join(goal, "id").select("id", F.col("x").alias("sx"), F.col("y").alias("sy"), "gx", "gy")


@query()
def astar_paths(spark: SparkSession, d: str) -> DataFrame:
    found = navigation.find_paths(_questions(spark, d), navigation.load(V.tris(spark, d)))
    return found.select("id", "status", F.size("points").alias("n_points"), F.size("triangles").alias("n_triangles"))


@query()
def los_batch(spark: SparkSession, d: str) -> DataFrame:
    return navigation.sight(_questions(spark, d), navigation.load(V.tris(spark, d)))


@query()
def visibility(spark: SparkSession, d: str) -> DataFrame:
    asked = V.points(spark, d).select("id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    return navigation.visibility(asked, navigation.load(V.tris(spark, d)), 12.0, 16)


@query()
def path_clear(spark: SparkSession, d: str) -> DataFrame:
    return navigation.ways_clear(_questions(spark, d), navigation.load(V.tris(spark, d)))


@query()
def cdt_mesh(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of the grid's regions: loops become outer rings and their holes."""
    loops = grid.trace_loops(V.cells(spark, d), V.WIDTH).drop("grid_id")
    shape = rings.shoelace(loops)
    outer = loops.join(shape.where("winding = 'ccw'").select("ring_id"), "ring_id")
    holes = loops.join(shape.where("winding = 'cw'").select("ring_id"), "ring_id")
    first = holes.where("seq = 0").select(F.col("ring_id").alias("hole"), "x", "y")
    parent = rings.parents(first, outer, SIZE).select(F.col("hole").alias("ring_id"), F.col("parent").alias("region_id"))
    rows = outer.select(F.col("ring_id").alias("region_id"), "ring_id", F.lit(False).alias("hole"), "seq", "x", "y")
    rows = rows.unionByName(holes.join(parent, "ring_id").select("region_id", "ring_id", F.lit(True).alias("hole"), "seq", "x", "y"))
    return navigation.triangulate(rings_straight(rows)).select("region_id", "tid", "v", "ax", "ay", "bx", "by", "cx", "cy")


def rings_straight(rows: DataFrame) -> DataFrame:
    """Rings of regions without straight-line points (one pass removes all of a lattice loop's)."""
    return rings.collinear_pass(rows)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
