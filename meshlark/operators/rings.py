"""Rings as rows (ring_id, seq, x, y): areas, containment, simplification and nesting."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom as G
from ..kernels import outlines
from . import spatial


def ring_edges(rings: DataFrame) -> DataFrame:
    """rings with bx, by: the next point, the first after the last."""
    w = Window.partitionBy("ring_id").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rings.withColumns({"bx": F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), "by": F.coalesce(F.lead("y").over(w), F.first("y").over(whole))})


def shoelace(rings: DataFrame) -> DataFrame:
    """(ring_id, n, area2, winding, x0, y0, x1, y1); area2 is 0 with fewer than three points."""
    e = ring_edges(rings)
    out = e.groupBy("ring_id").agg(
        F.count("*").alias("n"), F.sum(F.col("x") * F.col("by") - F.col("bx") * F.col("y")).alias("s"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
    )
    area = F.when(F.col("n") < 3, F.lit(0)).otherwise(F.col("s"))
    return out.withColumn("area2", area).withColumn("winding", F.when(area > 0, "ccw").when(area < 0, "cw").otherwise("degenerate")).drop("s")


def containing(points: DataFrame, rings: DataFrame, size: float) -> DataFrame:
    """(id, ring_id): rings that hold the point by the even-odd rule, border included.

    A place meets the edges of its y-bucket only; see spatial.ring_hits.
    """
    e = ring_edges(rings).select("ring_id", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", F.col("by").alias("by_"))
    return spatial.ring_hits(points, e, size)


def collinear_pass(rings: DataFrame) -> DataFrame:
    """Rings without the points that lie straight between their neighbours, all judged at once."""
    w = Window.partitionBy("ring_id").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = ring_edges(rings).withColumns({"px": F.coalesce(F.lag("x").over(w), F.last("x").over(whole)), "py": F.coalesce(F.lag("y").over(w), F.last("y").over(whole))})
    bent = G.area2(G.point("px", "py"), G.point("x", "y"), G.point("bx", "by")) != 0
    return near.where(bent).select(*rings.columns)


def stair_middles(rings: DataFrame) -> DataFrame:
    """(ring_id, seq) of the middles of staircases: between two perpendicular unit steps, the step before
    going the same way as the step after."""
    w = Window.partitionBy("ring_id")
    r = rings.withColumns({"n": F.count("*").over(w), "i": F.row_number().over(w.orderBy("seq")) - 1}).where("n >= 4")
    # the last two points come once more in front, the first one behind, so that neighbours need no wrapping
    turned = F.array(F.col("i"), F.when(F.col("i") >= F.col("n") - 2, F.col("i") - F.col("n")), F.when(F.col("i") == 0, F.col("n")))
    r = r.select("ring_id", "seq", "x", "y", "n", F.explode(F.filter(turned.cast("array<long>"), lambda k: k.isNotNull())).alias("i"))
    w = w.orderBy("i")
    step = lambda k: G.P(F.lead("x", k).over(w) - F.lead("x", k - 1).over(w), F.lead("y", k).over(w) - F.lead("y", k - 1).over(w))
    legs = {f"{n}{c}": v for n, k in (("a", -1), ("b", 0), ("c", 1)) for c, v in zip("xy", step(k), strict=True)}
    r = r.withColumns(legs).where("i >= 0 and i < n")
    before, into, out = (G.point(f"{n}x", f"{n}y") for n in "abc")
    unit = (into.length_sq() == 1) & (out.length_sq() == 1) & (into.dot(out) == 0)
    return r.where(unit & (before.cross(out) == 0) & (before.dot(out) > 0)).select("ring_id", "seq")


def finish(rings: DataFrame, smooth: bool = True, offset: float = 0.0) -> DataFrame:
    """(ring_id, points array<struct<x,y>>, inside struct<x,y>, moved array<struct<x,y>>): each ring without stairs (if
    asked for) and straight points, a point inside, and the ring moved to its left; null where a ring has no area.
    A ring is one task's; rings that come to fewer than three points have no row."""
    xy = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    as_rows = lambda ring: None if ring is None else [{"x": x, "y": y} for x, y in ring]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("seq").to_pylist(), table.column("x").to_pylist(), table.column("y").to_pylist(), strict=True))
        ring = [(x, y) for _, x, y in rows]
        ring = outlines.straight_out(outlines.smooth(ring) if smooth else ring)
        held = len(ring) >= 3
        inside = outlines.inside_point(ring) if held else None
        return pa.table({
            "ring_id": pa.array([table.column("ring_id")[0].as_py()] * held, pa.int64()), "points": pa.array([as_rows(ring)] * held, pa.list_(xy)),
            "inside": pa.array([inside and {"x": inside[0], "y": inside[1]}] * held, xy), "moved": pa.array([as_rows(outlines.moved_left(ring, offset))] * held, pa.list_(xy)),
        })

    kind = "struct<x:double,y:double>"
    picked = rings.select("ring_id", "seq", F.col("x").cast("double"), F.col("y").cast("double"))
    return picked.groupBy("ring_id").applyInArrow(run, f"ring_id long, points array<{kind}>, inside {kind}, moved array<{kind}>")


def parents(holes: DataFrame, rings: DataFrame, size: float) -> DataFrame:
    """(hole, parent): the outer ring of the smallest area that holds the hole's first point, the lower id on ties.

    holes: (hole, x, y); rings: outer rings' points.  Holes outside all rings are left out.
    """
    inside = containing(holes.select(F.col("hole").alias("id"), "x", "y"), rings, size)
    areas = shoelace(rings).select("ring_id", F.abs("area2").alias("area"))
    return inside.join(areas, "ring_id").groupBy(F.col("id").alias("hole")).agg(F.min_by("ring_id", F.struct("area", "ring_id")).alias("parent"))


def drop_repeats(rings: DataFrame) -> DataFrame:
    """Rings without points equal to the one before, the first compared with the last; rings of under three points go."""
    w = Window.partitionBy("ring_id").orderBy("seq")
    e = ring_edges(rings).where((F.col("x") != F.col("bx")) | (F.col("y") != F.col("by"))).select(*rings.columns)
    return e.withColumn("n", F.count("*").over(Window.partitionBy("ring_id"))).where("n >= 3").drop("n").withColumn("seq", F.row_number().over(w) - 1)
