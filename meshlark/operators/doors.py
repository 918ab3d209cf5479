"""Doors of a mesh: which edges a door's line closes, and what a stream of events makes of the doors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom as G
from . import spatial


def edges(lines: DataFrame, sides: DataFrame, size: float) -> DataFrame:
    """(door, lo, hi): sides (lo, hi, ax, ay, bx, by) that the line (door, ax, ay, bx, by) of a door crosses or touches.

    Boxes meet by cells first; lines that run along a side do not cross it.
    """
    box = lambda df, key: df.select(key.alias("id"), F.least("ax", "bx").alias("x0"), F.least("ay", "by").alias("y0"), F.greatest("ax", "bx").alias("x1"), F.greatest("ay", "by").alias("y1"))
    near = spatial.boxes_meet(box(lines, F.col("door")), box(sides, F.struct("lo", "hi")), size)
    q = sides.withColumnsRenamed({"ax": "cx", "ay": "cy", "bx": "dx", "by": "dy"})
    met = near.select(F.col("l_id").alias("door"), "r_id.lo", "r_id.hi").join(lines, "door").join(q, ["lo", "hi"])
    hit = G.crossing(G.point("ax", "ay"), G.point("bx", "by"), G.point("cx", "cy"), G.point("dx", "dy"))
    return met.where(hit.isNotNull()).select("door", "lo", "hi").distinct()


def state(events: DataFrame) -> DataFrame:
    """(door, state, generation) after the events (door, ts, seq, action open, close or toggle): open doors to start
    with; an event that changes nothing leaves the generation.

    An opening or closing sets the state whatever came before, and toggles flip it: so the state after an event is
    that of the last setting with the parity of the toggles since, all from window sums.
    """
    w = Window.partitionBy("door").orderBy("ts", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    flips = F.sum((F.col("action") == "toggle").cast("int")).over(upto)
    e = events.withColumn("flips", flips)
    at = F.when(F.col("action") != "toggle", F.struct(F.col("action").alias("a"), F.col("flips").alias("f")))
    e = e.withColumn("set", F.last(at, ignorenulls=True).over(upto))
    closed = (F.coalesce((F.col("set.a") == "close").cast("int"), F.lit(0)) + F.col("flips") - F.coalesce("set.f", F.lit(0))) % 2
    e = e.withColumn("closed", closed)
    changed = F.col("closed") != F.coalesce(F.lag("closed").over(w), F.lit(0))
    e = e.withColumn("changed", changed.cast("long"))
    return e.groupBy("door").agg(F.max_by("closed", F.struct("ts", "seq")).alias("c"), F.sum("changed").alias("generation")).select("door", F.when(F.col("c") == 1, "closed").otherwise("open").alias("state"), "generation")


def nearest_portal(points: DataFrame, tris: DataFrame, adjacency: DataFrame, size: float, blocked: DataFrame | None = None) -> DataFrame:
    """points (id, x, y) with lo, hi, d2: the nearest inner edge of the triangle that holds the point and of its
    neighbours; the triangle's own edges first on ties, then the lower edge.  Null outside the mesh, or where all are walls.

    adjacency: (tid, e, lo, hi, nbr); blocked: (lo, hi) of edges that are walls as well.
    """
    here = spatial.locate(points, tris, size).where("tid is not null").select("id", "x", "y", F.col("tid").alias("at"))
    open_ = adjacency.where("nbr is not null")
    if blocked is not None:
        open_ = open_.join(blocked.select("lo", "hi"), ["lo", "hi"], "left_anti")
    beyond = adjacency.where("nbr is not null").select(F.col("tid").alias("at"), F.col("nbr").alias("tid"), F.lit(1).alias("hop"))
    around = beyond.unionByName(tris.select(F.col("tid").alias("at"), "tid", F.lit(0).alias("hop")))
    ends = tris.select("tid", F.explode(F.arrays_zip("v", F.array(*[F.struct(F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y")) for k in "abc"]).alias("p"))).alias("c")).select(F.col("c.v").alias("v"), F.col("c.p.x").alias("x"), F.col("c.p.y").alias("y")).distinct()
    placed = open_.join(ends.select(F.col("v").alias("lo"), F.col("x").alias("ax"), F.col("y").alias("ay")), "lo").join(ends.select(F.col("v").alias("hi"), F.col("x").alias("bx"), F.col("y").alias("by")), "hi")
    met = here.join(around, "at").join(placed.select("tid", "lo", "hi", "ax", "ay", "bx", "by"), "tid")
    p = G.point("x", "y")
    d2 = G.nearest_on_segment(G.point("ax", "ay"), G.point("bx", "by"), p).distance_sq(p)
    best = met.groupBy("id").agg(F.min(F.struct(d2.alias("d2"), "hop", "lo", "hi")).alias("m"))
    return points.join(best.select("id", "m.lo", "m.hi", "m.d2"), "id", "left")
