"""Mesh files as DataFrames, through Spark's own readers: any path that Spark can open."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import formats

_MESH = pa.schema([("path", pa.string()), ("tid", pa.int64()), ("v", pa.list_(pa.int64())), ("nbr", pa.list_(pa.int64())), ("marks", pa.list_(pa.int32())), *[(f"{k}{d}", pa.float64()) for k in "abc" for d in "xy"], ("area", pa.float64()), ("region", pa.int64())])
_MESH_SQL = "path string, tid long, v array<long>, nbr array<long>, marks array<int>, ax double, ay double, bx double, by double, cx double, cy double, area double, region long"
_GRAPH = pa.schema([("path", pa.string()), ("kind", pa.string()), ("id", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("a", pa.int64()), ("b", pa.int64()), ("mark", pa.int32())])


def _rows(parse: Callable[[bytes], Iterator[dict]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from pa.Table.from_pylist([{"path": path, **r} for r in parse(data)], schema).to_batches(65536)

    return run


def _mesh_rows(data: bytes) -> Iterator[dict]:
    m = formats.from_bytes(data)
    for t, v in enumerate(m.tris.tolist()):
        corners = {f"{k}{d}": float(m.vertices[v[i]][j]) for i, k in enumerate("abc") for j, d in enumerate("xy")}
        yield {"tid": t, "v": v, "nbr": [None if n == formats.NONE else n for n in m.nbr[t].tolist()], "marks": m.marks[t].tolist(), **corners, "area": float(m.info["area"][t]), "region": int(m.info["region"][t])}


def _graph_rows(vertices_only: bool):
    def parse(data: bytes, companion: bytes | None = None) -> Iterator[dict]:
        g = formats.parse_poly(data.decode(), vertices_only, companion and companion.decode())
        for k, ((x, y), m) in enumerate(zip(g.vertices, g.vertex_marks, strict=True)):
            yield {"kind": "vertex", "id": k, "x": x, "y": y, "mark": m}
        for k, ((a, b), m) in enumerate(zip(g.segments, g.segment_marks, strict=True)):
            yield {"kind": "segment", "id": k, "a": a, "b": b, "mark": m}
        for k, (x, y) in enumerate(g.holes):
            yield {"kind": "hole", "id": k, "x": x, "y": y}

    return parse


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_navmesh(spark: SparkSession, path: str) -> DataFrame:
    """A row per triangle of every mesh file; a missing neighbour is null."""
    return _files(spark, path).mapInArrow(_rows(_mesh_rows, _MESH), _MESH_SQL)


def read_poly(spark: SparkSession, path: str, vertices_only: bool = False) -> DataFrame:
    """(path, kind, id, x, y, a, b, mark): vertices, segments and holes of .poly (or, with vertices_only, .node) files.

    A .poly file without vertices takes those of the .node file of its name, if that is in the path too.
    """
    parse, sql = _graph_rows(vertices_only), "path string, kind string, id long, x double, y double, a long, b long, mark int"
    if vertices_only:
        return _files(spark, path).mapInArrow(_rows(parse, _GRAPH), sql)

    def run(table: pa.Table) -> pa.Table:
        held = dict(zip(table.column("path").to_pylist(), table.column("content").to_pylist(), strict=True))
        nodes = next((data for name, data in held.items() if name.endswith(".node")), None)
        rows = [{"path": name, **r} for name, data in held.items() if not name.endswith(".node") for r in parse(data, nodes)]
        return pa.Table.from_pylist(rows, _GRAPH)

    stem = F.regexp_replace("path", r"\.(poly|node)$", "")
    return _files(spark, path).groupBy(stem.alias("stem")).applyInArrow(lambda t: run(t.select(["path", "content"])), sql)


def _pack(table: pa.Table) -> pa.Table:
    import numpy as np

    rows = sorted(table.to_pylist(), key=lambda r: r["tid"])
    place = {v: (r[f"{k}x"], r[f"{k}y"]) for r in rows for v, k in zip(r["v"], "abc", strict=True)}
    ids = {v: k for k, v in enumerate(sorted(place))}
    vertices = np.array([place[v] for v in sorted(place)], float)
    tris = np.array([[ids[v] for v in r["v"]] for r in rows])
    data = formats.to_bytes(vertices, tris, marks=np.array([r["marks"] for r in rows]))
    return pa.table({"mesh_id": pa.array([rows[0]["mesh_id"]], pa.int64()), "content": pa.array([data], pa.binary()), "digest": pa.array([f"{formats.fnv1a(data):016x}"])})


def navmesh_bytes(tris: DataFrame) -> DataFrame:
    """(mesh_id, content binary, digest) of meshes (mesh_id, tid, v, ax..cy, marks array<int>); a mesh is one task's."""
    return tris.groupBy("mesh_id").applyInArrow(_pack, "mesh_id long, content binary, digest string")


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """(path, ring_id, hole, seq, x, y) of JSON scenes; outer_polygon is the first perimeter."""
    ring = "array<struct<x:double,y:double>>"
    s = spark.read.schema(f"version int, outer_polygon {ring}, perimeters array<{ring}>, holes array<{ring}>").option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    outer = F.when(F.col("outer_polygon").isNotNull(), F.array("outer_polygon")).otherwise(F.array().cast(f"array<{ring}>"))
    none = F.array().cast(f"array<{ring}>")
    both = [s.select("path", F.lit(h).alias("hole"), F.posexplode(c).alias("ring_id", "ring")) for h, c in ((False, F.concat(outer, F.coalesce("perimeters", none))), (True, F.coalesce("holes", none)))]
    return both[0].unionByName(both[1]).select("path", "ring_id", "hole", F.posexplode("ring").alias("seq", "p")).select("path", "ring_id", "hole", "seq", "p.x", "p.y")


class SaveError(Exception):
    """What kept a file from being written: kind is unmapped_vertex, empty or folder."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def _put(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        uri = folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"
        system, root = fs.FileSystem.from_uri(uri)
        system.create_dir(root, recursive=True)
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), []
            for name, content in zip(names, batch.column("content").to_pylist(), strict=True):
                if not name or "/" in name:
                    raise SaveError("folder", f"{name!r} is no name of a file")
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["name", "n_bytes"])

    return run


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes (name, content binary) as files of the folder, by executors; returns how many.  A task that runs again
    writes the same bytes to the same names."""
    return rows.select("name", "content").mapInArrow(_put(folder), "name string, n_bytes long").count()


def _text(kind: str, base: int, marks: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        of = lambda k: [r for r in rows if r["kind"] == k]
        place = {r["id"]: k for k, r in enumerate(of("vertex"))}
        if kind != "node" and any(r[c] not in place for r in of("segment") + of("triangle") for c in ("a", "b")):
            raise SaveError("unmapped_vertex", "a segment or triangle names a vertex that is not there")
        g = formats.Graph([(r["x"], r["y"]) for r in of("vertex")], [r["mark"] or 0 for r in of("vertex")], [(place[r["a"]], place[r["b"]]) for r in of("segment")] if kind == "poly" else [], [r["mark"] or 0 for r in of("segment")] if kind == "poly" else [], [(r["x"], r["y"]) for r in of("hole")])
        text = formats.format_node(g, base, marks) if kind == "node" else formats.format_poly(g, base, marks)
        return pa.table({"graph_id": pa.array([rows[0]["graph_id"]], pa.int64()), "content": pa.array([text])})

    return run


def graph_text(rows: DataFrame, kind: str = "poly", base: int = 1, marks: bool = True) -> DataFrame:
    """(graph_id, content string): the .node or .poly text of each graph (graph_id, kind, id, x, y, a, b, mark), rows
    in the order of their ids; a graph is one task's.  SaveError where a segment names no vertex."""
    if kind not in ("node", "poly"):
        raise SaveError("folder", f"no text of kind {kind}")
    return rows.groupBy("graph_id").applyInArrow(_text(kind, base, marks), "graph_id long, content string")


def ele_text(tris: DataFrame, base: int = 1) -> DataFrame:
    """(mesh_id, content string): the .ele text of each mesh (mesh_id, tid, v) whose corners are numbered from 0."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["tid"])
        return pa.table({"mesh_id": pa.array([rows[0]["mesh_id"]], pa.int64()), "content": pa.array([formats.format_ele([tuple(r["v"]) for r in rows], base)])})

    return tris.select("mesh_id", "tid", "v").groupBy("mesh_id").applyInArrow(run, "mesh_id long, content string")
