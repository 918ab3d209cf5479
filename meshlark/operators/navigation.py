"""Batches of questions about a mesh: rows of questions, one mesh held by every task.

The mesh is sent to all tasks, so its size is checked; a larger world is cut into meshes
with an id, whose questions are grouped by that id instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import triangulate as T
from ..kernels.search import Mesh
from . import spatial

MAX_TRIANGLES = 1_000_000


def load(tris: DataFrame, closed: DataFrame | None = None, cell: float = 4.0) -> Mesh:
    """The mesh of (tid, v, ax..cy) as one object; ValueError beyond MAX_TRIANGLES, for which per_mesh() is."""
    if tris.count() > MAX_TRIANGLES:
        raise ValueError("the mesh is too large for one task: give it mesh ids and use per_mesh()")
    return build(tris.select("tid", "v", *[f"{k}{d}" for k in "abc" for d in "xy"]).toArrow().to_pylist(), closed.select("lo", "hi").collect() if closed is not None else (), cell)


def build(rows: list[dict], closed=(), cell: float = 4.0) -> Mesh:
    vertices = {v: (float(r[f"{k}x"]), float(r[f"{k}y"])) for r in rows for v, k in zip(r["v"], "abc", strict=True)}
    return Mesh(vertices, {r["tid"]: tuple(r["v"]) for r in rows}, closed={(e[0], e[1]) for e in closed}, cell=cell)


def per_mesh(questions: DataFrame, tris: DataFrame, ask: Callable[[Mesh, dict], dict], schema: pa.Schema, ddl: str, key: str = "mesh", cell: float = 4.0) -> DataFrame:
    """The answers of ask to the questions about each of many meshes: triangles (key, tid, v, ax..cy) and questions
    (key, id, ...) of one mesh meet in one task, so meshes of any number take no room on the driver.

    Questions about a mesh that is not there have no answer; a mesh itself has to fit into a task.
    """

    def run(_, asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        m = build(held.to_pylist(), cell=cell)
        return pa.Table.from_pylist([ask(m, r) for r in asked.to_pylist()], schema)

    return questions.groupBy(key).cogroup(tris.groupBy(key)).applyInArrow(run, ddl)


def find_paths_per_mesh(questions: DataFrame, tris: DataFrame, clearance: float = 0.0, key: str = "mesh") -> DataFrame:
    """As find_paths, for questions (key, id, sx, sy, gx, gy) about many meshes (key, tid, v, ax..cy)."""

    def ask(m: Mesh, r: dict) -> dict:
        status, points, way = m.path((r["sx"], r["sy"]), (r["gx"], r["gy"]), clearance)
        return {key: r[key], "id": r["id"], "status": status, "points": _xy(points), "triangles": way}

    schema = pa.schema([(key, pa.int64()), ("id", pa.int64()), ("status", pa.string()), ("points", _POINTS), ("triangles", pa.list_(pa.int64()))])
    rows = questions.select(key, "id", *[F.col(c).cast("double") for c in ("sx", "sy", "gx", "gy")])
    return per_mesh(rows, tris, ask, schema, f"{key} long, id long, status string, points array<struct<x:double,y:double>>, triangles array<long>", key)


def _each(mesh: Mesh, ask: Callable[[Mesh, dict], dict], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pa.Table.from_pylist([ask(mesh, r) for r in batch.to_pylist()], schema).to_batches()

    return run


_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _xy(points) -> list[dict] | None:
    return None if points is None else [{"x": x, "y": y} for x, y in points]


_ASKED = ("sx", "sy", "gx", "gy")


def _once(questions: DataFrame, mesh: Mesh, ask: Callable[[Mesh, dict], dict], schema: pa.Schema, ddl: str) -> DataFrame:
    """(id, *schema) of questions (id, sx, sy, gx, gy): equal ones are brought together and asked once, and the answer
    goes on with a list of their ids that is unfolded there."""
    most = 256  # ids of a list, so that an answer with a long way is not held too often
    out = pa.schema([("ids", pa.list_(pa.int64())), *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, answer = None, None
        for batch in batches:
            rows: list[dict] = []
            for r in batch.to_pylist():
                asked = tuple(r[c] for c in _ASKED)
                if asked != last:
                    last, answer = asked, ask(mesh, r)
                if rows and rows[-1]["_of"] is answer and len(rows[-1]["ids"]) < most:
                    rows[-1]["ids"].append(r["id"])
                else:
                    rows.append({"ids": [r["id"]], "_of": answer})
            yield from pa.Table.from_pylist([{"ids": r["ids"], **r["_of"]} for r in rows], out).to_batches()

    rows = questions.select("id", *[F.col(c).cast("double") for c in _ASKED])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = rows.repartition(n, *_ASKED).sortWithinPartitions(*_ASKED).mapInArrow(run, f"ids array<long>, {ddl}")
    return told.select(F.explode("ids").alias("id"), *schema.names)


def find_paths(questions: DataFrame, mesh: Mesh, clearance: float = 0.0) -> DataFrame:
    """questions (id, sx, sy, gx, gy) -> (id, status, points array<struct<x,y>>, triangles array<long>)."""

    def ask(m: Mesh, r: dict) -> dict:
        status, points, way = m.path((r["sx"], r["sy"]), (r["gx"], r["gy"]), clearance)
        return {"status": status, "points": _xy(points), "triangles": way}

    schema = pa.schema([("status", pa.string()), ("points", _POINTS), ("triangles", pa.list_(pa.int64()))])
    return _once(questions, mesh, ask, schema, "status string, points array<struct<x:double,y:double>>, triangles array<long>")


def path_statuses(questions: DataFrame, mesh: Mesh) -> DataFrame:
    """(id, status) as find_paths has them without clearance, by regions: the ways themselves are not searched."""
    ask = lambda m, r: {"status": m.status((r["sx"], r["sy"]), (r["gx"], r["gy"]))}
    return _once(questions, mesh, ask, pa.schema([("status", pa.string())]), "status string")


def ways_clear(questions: DataFrame, mesh: Mesh, clearance: float = 0.0) -> DataFrame:
    """(id, clear boolean): paths_clear of find_paths, without the paths in between."""
    ask = lambda m, r: {"clear": m.path_clear(m.path((r["sx"], r["sy"]), (r["gx"], r["gy"]), clearance)[1])}
    return _once(questions, mesh, ask, pa.schema([("clear", pa.bool_())]), "clear boolean")


def sight(questions: DataFrame, mesh: Mesh) -> DataFrame:
    """questions (id, sx, sy, gx, gy) -> (id, kind, x, y): clear, blocked at (x, y), source_outside, indeterminate."""

    def ask(m: Mesh, r: dict) -> dict:
        kind, at = m.sight((r["sx"], r["sy"]), (r["gx"], r["gy"]))
        return {"id": r["id"], "kind": kind, "x": at and at[0], "y": at and at[1]}

    schema = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("x", pa.float64()), ("y", pa.float64())])
    rows = questions.select("id", *[F.col(c).cast("double") for c in ("sx", "sy", "gx", "gy")])
    return spatial.dealt(rows).mapInArrow(_each(mesh, ask, schema), "id long, kind string, x double, y double")


def visibility(questions: DataFrame, mesh: Mesh, radius: float, samples: int) -> DataFrame:
    """questions (id, sx, sy) -> (id, points) of the visible region's border, null outside the mesh."""
    ask = lambda m, r: {"id": r["id"], "points": _xy(m.visible((r["sx"], r["sy"]), radius, samples))}
    schema = pa.schema([("id", pa.int64()), ("points", _POINTS)])
    rows = questions.select("id", F.col("sx").cast("double"), F.col("sy").cast("double"))
    return spatial.dealt(rows).mapInArrow(_each(mesh, ask, schema), "id long, points array<struct<x:double,y:double>>")


def paths_clear(paths: DataFrame, mesh: Mesh) -> DataFrame:
    """(id, clear boolean) of (id, points): every leg in sight; a path of one point or none is clear."""
    ask = lambda m, r: {"id": r["id"], "clear": m.path_clear([(p["x"], p["y"]) for p in r["points"] or ()])}
    return spatial.dealt(paths.select("id", "points")).mapInArrow(_each(mesh, ask, pa.schema([("id", pa.int64()), ("clear", pa.bool_())])), "id long, clear boolean")


def keep_off_walls(points: DataFrame, mesh: Mesh, radius: float) -> DataFrame:
    """(id, x, y) pushed radius off the walls."""

    def ask(m: Mesh, r: dict) -> dict:
        x, y = m.keep_off((r["x"], r["y"]), radius)
        return {"id": r["id"], "x": x, "y": y}

    schema = pa.schema([("id", pa.int64()), ("x", pa.float64()), ("y", pa.float64())])
    return spatial.dealt(points.select("id", F.col("x").cast("double"), F.col("y").cast("double"))).mapInArrow(_each(mesh, ask, schema), "id long, x double, y double")


def _region(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: (r["ring_id"], r["seq"]))
    rings: dict[tuple[bool, int], list] = {}
    for r in rows:
        rings.setdefault((r["hole"], r["ring_id"]), []).append((float(r["x"]), float(r["y"])))
    outer = next((v for (hole, _), v in rings.items() if not hole), [])
    points, tris, sides = T.triangulate(outer, [v for (hole, _), v in rings.items() if hole])
    region = rows[0]["region_id"]
    out = [{"region_id": region, "tid": k, "v": list(t), **{f"{c}{d}": points[v][i] for c, v in zip("abc", t, strict=True) for i, d in enumerate("xy")},
            "wall": [frozenset((t[(i + 1) % 3], t[(i + 2) % 3])) in sides for i in range(3)]} for k, t in enumerate(tris)]
    schema = pa.schema([("region_id", pa.int64()), ("tid", pa.int64()), ("v", pa.list_(pa.int64())), *[(f"{k}{d}", pa.float64()) for k in "abc" for d in "xy"], ("wall", pa.list_(pa.bool_()))])
    return pa.Table.from_pylist(out, schema)


def triangulate(rings: DataFrame) -> DataFrame:
    """(region_id, tid, v, ax..cy, wall array<boolean>): the constrained Delaunay triangles of each region's rings
    (region_id, ring_id, hole, seq, x, y); wall[i]: the edge opposite corner i is a side.  A region is one task's."""
    return rings.groupBy("region_id").applyInArrow(_region, "region_id long, tid long, v array<long>, ax double, ay double, bx double, by double, cx double, cy double, wall array<boolean>")
