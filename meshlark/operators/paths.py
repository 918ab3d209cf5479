"""Following polylines: arc lengths, points along them, corners kept at a distance, and agents' progress."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom as G
from ..kernels.search import nearest_on
from . import spatial


def arcs(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    """points (key, x, y, order...) with seq from 0, step, arc (length up to the point) and the point before (lx, ly)."""
    w = Window.partitionBy(key).orderBy(*order)
    before = G.P(F.lag("x").over(w), F.lag("y").over(w))
    p = points.withColumn("step", F.coalesce(G.point("x", "y").distance(before), F.lit(0.0)))
    return p.withColumns({"arc": F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), "seq": F.row_number().over(w) - 1, "lx": before.x, "ly": before.y})


def point_at(arced: DataFrame, key: str, share: float) -> DataFrame:
    """(key, px, py): the point at a share of each way's length, on the first leg that reaches it; ways of one point
    have none, legs without length count by their start."""
    total = F.max("arc").over(Window.partitionBy(key)) * share
    reach = arced.withColumn("s", total).where("seq > 0 and s <= arc")
    first = spatial.first_per(reach, [key], [F.col("seq")])
    t = F.when(F.col("step") < 1e-12, 0.0).otherwise((F.col("s") - (F.col("arc") - F.col("step"))) / F.col("step"))
    at = G.point("lx", "ly").lerp(G.point("x", "y"), t)
    return first.select(key, at.x.alias("px"), at.y.alias("py"))


def turns(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, seq, x, y, arc, cos, side, ox, oy) of inner points: the cosine of the turn, 1 left, -1 right or 0, and
    the unit vector to the outside of the corner (0, 0 where a leg has no length or the way turns right back).  cos is
    null where a leg has no length.  Products come before the roots, so on a lattice straight ways have side 0."""
    w = Window.partitionBy(key).orderBy(*order)
    a = arcs(points, key, order).withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}).where("seq > 0 and nx is not null")
    into, out = G.point("x", "y") - G.point("lx", "ly"), G.point("nx", "ny") - G.point("x", "y")
    rows = a.withColumns({"ix": into.x, "iy": into.y, "ux": out.x, "uy": out.y})
    into, out = G.point("ix", "iy"), G.point("ux", "uy")
    side = F.signum(into.cross(out)).cast("int")
    flat = (into.length_sq() == 0) | (out.length_sq() == 0)
    back = (side == 0) & (into.dot(out) < 0)
    along = (into.unit_or_zero() + out.unit_or_zero()).unit_or_zero()
    turn = F.when(side > 0, 1.0).otherwise(-1.0)
    away = G.P(F.when(flat | back, 0.0).otherwise(along.y * turn), F.when(flat | back, 0.0).otherwise(-along.x * turn))
    cos = F.when(~flat, F.least(F.greatest(F.try_divide(into.dot(out), into.length() * out.length()), F.lit(-1.0)), F.lit(1.0)))
    return rows.select(key, "seq", "x", "y", "arc", cos.alias("cos"), side.alias("side"), away.x.alias("ox"), away.y.alias("oy"))


class Follower:
    """Progress of an agent along a way of points; it never goes back."""

    def __init__(self, points: list[tuple[float, float]], lookahead: float = 1.0, avoid: float = 0.0, least_turn: float = 0.1):
        if not points:
            raise ValueError("a way needs a point")
        self.points, self.lookahead, self.avoid, self.least_turn = points, lookahead, avoid, least_turn
        self.upto = [0.0]
        for p, q in pairwise(points):
            self.upto.append(self.upto[-1] + math.dist(p, q))
        self.length, self.arc = self.upto[-1], 0.0
        self.corners = [c for k in range(1, len(points) - 1) if (c := self._corner(k))]

    def _corner(self, k: int) -> tuple[float, float, float] | None:
        """(arc, x, y): the outside of the corner, if it turns enough."""
        legs = []
        for p, q in pairwise(self.points[k - 1 : k + 2]):
            size = math.dist(p, q)
            if not size:
                return None
            legs.append(((q[0] - p[0]) / size, (q[1] - p[1]) / size))
        (ix, iy), (ox, oy) = legs
        size = math.hypot(ix + ox, iy + oy)
        if not size or math.acos(min(max(ix * ox + iy * oy, -1.0), 1.0)) < self.least_turn:
            return None
        turn = 1.0 if ix * oy - iy * ox > 0 else -1.0
        return self.upto[k], (iy + oy) / size * turn, -(ix + ox) / size * turn

    def leg(self, arc: float) -> int:
        """The first leg that reaches so far."""
        return next((k for k, end in enumerate(self.upto[1:]) if arc <= end), len(self.points) - 2)

    def at(self, arc: float) -> tuple[float, float]:
        arc = min(max(arc, 0.0), self.length)
        if len(self.points) == 1:
            return self.points[0]
        k = self.leg(arc)
        (px, py), (qx, qy), size = self.points[k], self.points[k + 1], self.upto[k + 1] - self.upto[k]
        t = 0.0 if size < 1e-12 else (arc - self.upto[k]) / size
        return px + (qx - px) * t, py + (qy - py) * t

    def advance(self, agent: tuple[float, float]) -> float:
        """The arc of the nearest place from the leg before the present one on, or the present arc if that is more."""
        if len(self.points) > 1:
            best = math.inf, self.arc
            for k in range(max(self.leg(self.arc) - 1, 0), len(self.points) - 1):
                near = nearest_on(self.points[k], self.points[k + 1], agent)
                gap = (near[0] - agent[0]) ** 2 + (near[1] - agent[1]) ** 2
                if gap < best[0]:
                    best = gap, self.upto[k] + math.dist(self.points[k], near)
            self.arc = max(self.arc, best[1])
        return self.arc

    def target(self, agent: tuple[float, float]) -> tuple[float, float]:
        """Where to steer: the point a lookahead beyond the agent's progress, moved to the outside of near corners."""
        ahead = min(self.advance(agent) + self.lookahead, self.length)
        x, y = self.at(ahead)
        for arc, ox, oy in self.corners:
            room = self.avoid - abs(ahead - arc)
            if room > 0:
                x, y = x + ox * room, y + oy * room
        return x, y

    @property
    def progress(self) -> float:
        return self.arc / self.length if self.length else 0.0

    @property
    def at_end(self) -> bool:
        return self.arc >= self.length - 1e-9


def follow(ways: DataFrame, seen: DataFrame, lookahead: float = 1.0, avoid: float = 0.0, least_turn: float = 0.1) -> DataFrame:
    """(id, seq, arc, progress, at_end, tx, ty): an agent's progress and target at each place it was seen at.

    ways: (id, points array<struct<x,y>>); seen: (id, seq, x, y).  An agent's places are taken in the order of seq by
    one task, as each depends on the progress before; agents without a way or with an empty one have no rows.
    """
    far = seen.join(ways.where("size(points) > 0"), "id")
    rows = far.repartition(int(far.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, follower = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["id"] != current:
                    current, follower = r["id"], Follower([(p["x"], p["y"]) for p in r["points"]], lookahead, avoid, least_turn)
                x, y = follower.target((r["x"], r["y"]))
                out.append({"id": current, "seq": r["seq"], "arc": follower.arc, "progress": follower.progress, "at_end": follower.at_end, "tx": x, "ty": y})
            yield from pa.Table.from_pylist(out, pa.schema([("id", pa.int64()), ("seq", pa.int64()), ("arc", pa.float64()), ("progress", pa.float64()), ("at_end", pa.bool_()), ("tx", pa.float64()), ("ty", pa.float64())])).to_batches()

    picked = rows.select("id", F.col("seq").cast("long"), F.col("x").cast("double"), F.col("y").cast("double"), F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("points"))
    return picked.mapInArrow(run, "id long, seq long, arc double, progress double, at_end boolean, tx double, ty double")
