"""Triangle meshes as rows (tid, v array<long>, ax..cy): adjacency, walls, regions and statistics.

Edge i of a triangle is opposite its corner i, from corner i+1 to corner i+2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom as G
from ..plans.storage import Tables
from .graph import components, ranked


def edges(tris: DataFrame) -> DataFrame:
    """(tid, e, a, b, lo, hi): three directed edges per triangle with their undirected key."""
    ends = F.array(*[F.struct(F.lit(i).alias("e"), F.col("v")[(i + 1) % 3].alias("a"), F.col("v")[(i + 2) % 3].alias("b")) for i in range(3)])
    return tris.select("tid", F.explode(ends).alias("x")).select("tid", "x.e", "x.a", "x.b", F.least("x.a", "x.b").alias("lo"), F.greatest("x.a", "x.b").alias("hi"))


def adjacency(tris: DataFrame) -> DataFrame:
    """edges with nbr: the triangle beyond each edge, null on the border; one exchange on the edge key."""
    w = Window.partitionBy("lo", "hi")
    e = edges(tris).withColumns({"t0": F.min("tid").over(w), "t1": F.max("tid").over(w)})
    other = F.when(F.col("t0") == F.col("t1"), None).when(F.col("tid") == F.col("t0"), F.col("t1")).otherwise(F.col("t0"))
    return e.withColumn("nbr", other).drop("t0", "t1")


def boundary(adj: DataFrame) -> DataFrame:
    return adj.where("nbr is null").select("tid", "e", "a", "b")


def with_marks(adj: DataFrame, marks: DataFrame) -> DataFrame:
    """adj with mark int (0: none) from marks (lo, hi, mark)."""
    return adj.join(marks, ["lo", "hi"], "left").withColumn("mark", F.coalesce("mark", F.lit(0)))


def wall_edges(adj: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(lo, hi) of edges that stop movement: on the border, marked, or of a closed door (lo, hi)."""
    wall = F.col("nbr").isNull()
    if "mark" in adj.columns:
        wall = wall | (F.col("mark") != 0)
    out = adj.where(wall).select("lo", "hi")
    return (out if closed is None else out.unionByName(closed.select("lo", "hi"))).distinct()


def wall_vertices(walls: DataFrame) -> DataFrame:
    return walls.select(F.explode(F.array("lo", "hi")).alias("vid")).distinct()


def portals(adj: DataFrame, walls: DataFrame) -> DataFrame:
    """Edges with a neighbour that are no walls."""
    return adj.where("nbr is not null").join(walls, ["lo", "hi"], "left_anti")


def regions(adj: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(tid, region): connected components over portals, numbered from 0 by their lowest triangle."""
    tables = Tables(adj.sparkSession)
    adj = tables.save(adj)
    free = portals(adj, wall_edges(adj, closed)).where("nbr < tid").select(F.col("tid").alias("a"), F.col("nbr").alias("b"))
    root = components(free, tables).withColumnRenamed("node", "tid")
    found = tables.save(adj.select("tid").distinct().join(root, "tid", "left").select("tid", F.coalesce("root", "tid").alias("r")))
    names = ranked(found.select("r").distinct(), ["r"]).withColumnRenamed("rank", "region")
    return found.join(names, "r").select("tid", F.col("region").cast("long").alias("region"))


def corners() -> tuple[G.P, G.P, G.P]:
    return G.point("ax", "ay"), G.point("bx", "by"), G.point("cx", "cy")


def tri_area2() -> Column:
    return G.area2(*corners())


def region_stats(tris: DataFrame, region: DataFrame) -> DataFrame:
    """(region, n, area2, mx, my, x0, y0, x1, y1); mx, my: area-weighted sum of corner sums, 6 * area * centroid."""
    a, b, c = corners()
    w = F.abs(tri_area2())
    box = G.Box.of(a, b, c)
    return tris.join(region, "tid").groupBy("region").agg(
        F.count("*").alias("n"), F.sum(w).alias("area2"), F.sum(w * (a.x + b.x + c.x)).alias("mx"), F.sum(w * (a.y + b.y + c.y)).alias("my"),
        F.min(box.x0).alias("x0"), F.min(box.y0).alias("y0"), F.max(box.x1).alias("x1"), F.max(box.y1).alias("y1"),
    )


def translate(tris: DataFrame, dx: Column | float, dy: Column | float) -> DataFrame:
    """Shifted corners; ids and adjacency stay."""
    return tris.withColumns({f"{k}{d}": F.col(f"{k}{d}") + o for k in "abc" for d, o in (("x", dx), ("y", dy))})


def append(parts: DataFrame, keys: tuple[str, ...] = ("tid",)) -> DataFrame:
    """Disjoint union of parts (part, *keys, ...): every id is moved on by what the parts before it use.

    Offsets are prefix sums over one row per part.
    """
    sizes = parts.groupBy("part").agg(*[(F.max(k) + 1).alias(f"_n_{k}") for k in keys])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", *[F.coalesce(F.sum(f"_n_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in keys])
    return parts.join(offsets, "part").withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in keys}).drop(*[f"_o_{k}" for k in keys])


def invalid_corners(tris: DataFrame, vertices: DataFrame) -> DataFrame:
    """(tid, vid) of corners that name no vertex."""
    return tris.select("tid", F.explode("v").alias("vid")).join(vertices.select("vid"), "vid", "left_anti")


def dedup_vertices(vertices: DataFrame) -> DataFrame:
    """vertices (vid, x, y) with keep: the lowest id at the same place; -0.0 counts as 0.0."""
    w = Window.partitionBy(F.col("x") + F.lit(0), F.col("y") + F.lit(0))
    return vertices.withColumn("keep", F.min("vid").over(w))


def merge_segments(segments: DataFrame) -> DataFrame:
    """(lo, hi, mark): undirected segments once, without self loops, with the smallest mark that isn't 0."""
    return segments.where("a <> b").groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(
        F.coalesce(F.min(F.when(F.col("mark") != 0, F.col("mark"))), F.lit(0)).alias("mark")
    )


def flipped(tris: DataFrame) -> DataFrame:
    """Triangles with their second and third corner exchanged, so of the other winding."""
    v = F.array(F.col("v")[0], F.col("v")[2], F.col("v")[1])
    return tris.withColumns({"v": v, **{f"{k}{x}": F.col(f"{o}{x}") for k, o in (("b", "c"), ("c", "b")) for x in "xy"}})


def sample_points(tris: DataFrame, draws: DataFrame, among: Column | None = None) -> DataFrame:
    """draws (id, u0, u1, u2 in [0,1)) with tid, x, y: a triangle by area, then a point in it, folded from the square.

    among: a condition on the triangles, such as a region.  The running area comes from sorted ranges; draws meet it
    by a range of equal shares, so each pair is bucketed.
    """
    a, b, c = corners()
    area = F.abs(tri_area2()).cast("double")
    held = tris.where(tri_area2() != 0) if among is None else tris.where((tri_area2() != 0) & among)
    run = ranked(held.select("tid", *[f"{k}{d}" for k in "abc" for d in "xy"], area.alias("area")), ["tid"], "area").withColumnRenamed("before", "low")
    total = run.agg(F.max(F.col("low") + F.col("area"))).first()[0] or 0.0
    shares = 1024
    run = run.withColumns({"top": F.col("low") + F.col("area"), "total": F.lit(total)})
    spread = run.withColumn("share", F.explode(F.sequence(F.floor(F.col("low") / F.col("total") * shares), F.floor(F.col("top") / F.col("total") * shares))))
    pick = draws.withColumn("share", F.floor(F.col("u0") * shares)).join(spread, "share")
    t = F.col("u0") * F.col("total")
    hit = pick.where((t >= F.col("low")) & (t < F.col("top")))
    fold = F.col("u1") + F.col("u2") > 1
    r, s = F.when(fold, 1 - F.col("u1")).otherwise(F.col("u1")), F.when(fold, 1 - F.col("u2")).otherwise(F.col("u2"))
    p = a + (b - a).scale(r) + (c - a).scale(s)
    return hit.select("id", "tid", p.x.alias("x"), p.y.alias("y"))
