"""Occupancy grids as rows (grid_id, col, row, walkable): borders, erosion and clearance.

Whatever lies outside a grid is wall.  All operators keep to grid_id, so any number of
grids is handled at once and each by as many tasks as its rows and columns give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Directed border edges of a cell, counter-clockwise: name, neighbour, start and end corner as offsets.
SIDES = (("S", (0, -1), (0, 0), (1, 0)), ("E", (1, 0), (1, 0), (1, 1)), ("N", (0, 1), (1, 1), (0, 1)), ("W", (-1, 0), (0, 1), (0, 0)))


def lattice(spark: SparkSession, width: int, height: int, grid_id: int = 0, walkable: bool = False) -> DataFrame:
    """A grid of one value; all wall unless asked otherwise."""
    cells = spark.range(width * height)
    return cells.select(F.lit(grid_id).cast("long").alias("grid_id"), (F.col("id") % width).alias("col"), F.floor(F.col("id") / width).alias("row"), F.lit(walkable).alias("walkable"))


def bad_grids(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """(grid_id, expected, found) of grids (grid_id, w, h) whose cells are not w*h."""
    found = cells.groupBy("grid_id").agg(F.count("*").alias("found"))
    both = grids.join(found, "grid_id", "left").select("grid_id", (F.col("w") * F.col("h")).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.where("expected <> found")


def cells_at(cells: DataFrame, places: DataFrame) -> DataFrame:
    """places (grid_id, col, row, ...) with walkable; false outside the grid."""
    return places.join(cells, ["grid_id", "col", "row"], "left").withColumn("walkable", F.coalesce("walkable", F.lit(False)))


def set_cells(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Cells with the values of edits (grid_id, col, row, walkable); edits outside are ignored."""
    new = edits.withColumnRenamed("walkable", "_new")
    return cells.join(new, ["grid_id", "col", "row"], "left").select("grid_id", "col", "row", F.coalesce("_new", "walkable").alias("walkable"))


def subgrid(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows (grid_id, col0, row0, w, h) as grids of their own place: (grid_id, col, row, walkable), wall outside."""
    target = windows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("w").cast("int") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("h").cast("int") - 1)))
    target = target.select("grid_id", F.col("col").cast("long").alias("c"), F.col("row").cast("long").alias("r"), (F.col("col") + F.col("col0")).cast("long").alias("col"), (F.col("row") + F.col("row0")).cast("long").alias("row"))
    return cells_at(cells, target).select("grid_id", F.col("c").alias("col"), F.col("r").alias("row"), "walkable")


def border_edges(cells: DataFrame) -> DataFrame:
    """(grid_id, col, row, dir 0-3 = S,E,N,W, x0, y0, x1, y1): sides of walkable cells that face a wall.

    Every walkable cell sends a mark to its four neighbours, so one exchange on the cell serves all four sides.
    """
    open_ = cells.where("walkable")
    sides = F.array(*[F.struct(F.lit(k).alias("dir"), *[F.lit(v).alias(n) for n, v in zip(("nx", "ny", "sx", "sy", "ex", "ey"), (*o, *s, *e), strict=True)]) for k, (_, o, s, e) in enumerate(SIDES)])
    looked = open_.select("grid_id", "col", "row", F.explode(sides).alias("s")).withColumns({"ncol": F.col("col") + F.col("s.nx"), "nrow": F.col("row") + F.col("s.ny")})
    there = open_.select("grid_id", F.col("col").alias("ncol"), F.col("row").alias("nrow"))
    faced = looked.join(there, ["grid_id", "ncol", "nrow"], "left_anti")
    corner = lambda d, x: (F.col(d) + F.col(f"s.{x}")).alias
    return faced.select("grid_id", "col", "row", F.col("s.dir").alias("dir"), corner("col", "sx")("x0"), corner("row", "sy")("y0"), corner("col", "ex")("x1"), corner("row", "ey")("y1"))


def edge_id(col: Column, row: Column, dir_: Column, width: int) -> Column:
    """Row-major order of border edges as one number."""
    return ((row * width + col) * 4 + dir_).cast("long")


def loop_successors(edges: DataFrame, width: int) -> DataFrame:
    """(grid_id, edge, next): the border edge that goes on from each one's end.

    Where two edges start at a corner, the one of the same cell is taken: cells that touch at a corner only stay apart.
    """
    e = edges.withColumn("edge", edge_id(F.col("col"), F.col("row"), F.col("dir"), width))
    start = e.select("grid_id", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("edge").alias("next"), F.col("col").alias("c2"), F.col("row").alias("r2"))
    met = e.join(start, ["grid_id", "x1", "y1"])
    same = ((F.col("c2") == F.col("col")) & (F.col("r2") == F.col("row"))).cast("int")
    return met.groupBy("grid_id", "edge").agg(F.max_by("next", F.struct(same, -F.col("next"))).alias("next"))


def _trace(table: pa.Table) -> pa.Table:
    """Follows successors; loops are numbered by their lowest edge."""
    edge, nxt = table.column("edge").to_numpy(), table.column("next").to_numpy()
    order = np.argsort(edge)
    edge, nxt = edge[order], np.searchsorted(edge[order], nxt[order])
    x, y = (table.column(c).to_numpy()[order] for c in ("x0", "y0"))
    seen = np.zeros(len(edge), bool)
    rows: list[tuple[int, int, int]] = []
    loop = 0
    for k in range(len(edge)):
        if seen[k]:
            continue
        at, seq = k, 0
        while not seen[at]:
            seen[at] = True
            rows.append((loop, seq, at))
            at, seq = int(nxt[at]), seq + 1
        loop += 1
    loops, seqs, at = (np.array(v, np.int64) for v in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    grid = table.column("grid_id")[0].as_py()
    return pa.table({"grid_id": pa.array(np.full(len(loops), grid)), "ring_id": loops, "seq": seqs, "x": x[at].astype(np.int64), "y": y[at].astype(np.int64)})


def trace_loops(cells: DataFrame, width: int) -> DataFrame:
    """(grid_id, ring_id, seq, x, y): border loops, outer ones counter-clockwise and holes clockwise."""
    edges = border_edges(cells)
    named = edges.select("grid_id", edge_id(F.col("col"), F.col("row"), F.col("dir"), width).alias("edge"), "x0", "y0")
    linked = loop_successors(edges, width).join(named, ["grid_id", "edge"])
    return linked.groupBy("grid_id").applyInArrow(_trace, "grid_id long, ring_id long, seq long, x long, y long")


def seed_mask(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Cells with seed boolean: a wall, or next to one in any of eight directions, the outside included."""
    near = Window.partitionBy("grid_id", "row").orderBy("col").rangeBetween(-1, 1)
    across = cells.withColumn("_wall", F.max((~F.col("walkable")).cast("int")).over(near))
    above = Window.partitionBy("grid_id", "col").orderBy("row").rangeBetween(-1, 1)
    edge = (F.col("col") == 0) | (F.col("row") == 0) | (F.col("col") == width - 1) | (F.col("row") == height - 1)
    return across.withColumn("seed", (F.max("_wall").over(above) == 1) | edge).drop("_wall")


def row_pass(seeds: DataFrame) -> DataFrame:
    """Cells with g: the squared distance to the nearest seed of their row."""
    row = Window.partitionBy("grid_id", "row").orderBy("col")
    at = F.when(F.col("seed"), F.col("col"))
    back = F.last(at, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(at, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("col") - back, ahead - F.col("col"))
    return seeds.withColumn("g", (gap * gap).cast("long"))


def envelope(g: np.ndarray) -> np.ndarray:
    """min over q of g[q] + (r-q)^2 for every r: the lower envelope of unit parabolas, in one sweep."""
    n = len(g)
    top, edge = np.zeros(n, np.int64), np.zeros(n + 1)
    k = 0
    edge[0], edge[1] = -math.inf, math.inf
    for q in range(1, n):
        while True:
            p = top[k]
            cut = ((g[q] + q * q) - (g[p] + p * p)) / (2 * (q - p))
            if cut > edge[k]:
                break
            k -= 1
        k += 1
        top[k], edge[k], edge[k + 1] = q, cut, math.inf
    out, k = np.zeros(n, np.int64), 0
    for r in range(n):
        while edge[k + 1] < r:
            k += 1
        out[r] = g[top[k]] + (r - top[k]) ** 2
    return out


def _columns(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("row").to_numpy())
    table = table.take(pa.array(order))
    return table.append_column("sq", pa.array(envelope(table.column("g").to_numpy().astype(np.int64))))


def clearance(cells: DataFrame, width: int, height: int) -> DataFrame:
    """(grid_id, col, row, walkable, sq): the exact squared gap, in cells, between a cell and the nearest wall."""
    rows = row_pass(seed_mask(cells, width, height)).select("grid_id", "col", "row", "walkable", "g")
    out = rows.groupBy("grid_id", "col").applyInArrow(_columns, "grid_id long, col long, row long, walkable boolean, g long, sq long")
    return out.drop("g")


def radius_threshold(radius: float) -> int:
    """ceil(radius^2), 1 at least for a positive radius; ValueError for a negative or infinite one."""
    if not math.isfinite(radius) or radius < 0:
        raise ValueError(f"invalid radius {radius}")
    return 0 if radius == 0 else max(1, math.ceil(radius * radius))


def threshold(field: DataFrame, radius: float) -> DataFrame:
    """walkable where the clearance reaches the radius; radius 0 keeps every cell, walls too."""
    return field.withColumn("walkable", F.col("sq") >= radius_threshold(radius)).drop("sq")


def erode(cells: DataFrame, width: int, height: int, radius: float) -> DataFrame:
    """Cells whose clearance reaches the radius stay walkable; radius 0 changes nothing.

    A radius up to 1 needs the seeds only: clearances are whole numbers.
    """
    radius_threshold(radius)
    if radius == 0:
        return cells
    if radius <= 1:
        seeds = seed_mask(cells, width, height)
        return seeds.withColumn("walkable", ~F.col("seed")).drop("seed")
    return threshold(clearance(cells, width, height), radius)


def parse_pbm(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and walkable[row, col] with row 0 at the bottom of a binary PBM (P4); a set bit is passable."""
    fields, at = [], 0
    while len(fields) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("the header is cut short")
        fields.append(data[at:end])
        at = end
    if fields[0] != b"P4":
        raise ValueError("not a binary PBM")
    width, height = int(fields[1]), int(fields[2])
    stride = (width + 7) // 8
    body = data[at + 1 : at + 1 + stride * height]
    if len(body) < stride * height:
        raise ValueError("the pixels are cut short")
    bits = np.unpackbits(np.frombuffer(body, np.uint8).reshape(height, stride), axis=1)[:, :width]
    return width, height, bits[::-1].astype(bool)


def _pbm_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            w, h, bits = parse_pbm(data)
            rows, cols = np.divmod(np.arange(w * h), w)
            yield pa.RecordBatch.from_arrays([pa.array([path] * (w * h)), pa.array(cols), pa.array(rows), pa.array(bits.reshape(-1))], ["path", "col", "row", "walkable"])


def read_pbm(spark: SparkSession, path: str) -> DataFrame:
    """(path, col, row, walkable) of every PBM file of a path that Spark can read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_pbm_rows, "path string, col long, row long, walkable boolean")


def format_pbm(width: int, height: int, walkable: np.ndarray) -> bytes:
    """A binary PBM (P4) of walkable[row, col] with row 0 at the bottom."""
    return b"P4\n%d %d\n" % (width, height) + np.packbits(walkable[::-1].astype(np.uint8), axis=1).tobytes()


def write_pbm(cells: DataFrame, folder: str) -> None:
    """A file for each grid of cells (grid_id, col, row, walkable), by Spark's executors; a grid is one task's.

    Cells that are not there are walls; the grid reaches to the largest column and row that are.
    """

    def run(table: pa.Table) -> pa.Table:
        col, row = table.column("col").to_numpy(), table.column("row").to_numpy()
        field = np.zeros((int(row.max()) + 1, int(col.max()) + 1), bool)
        field[row, col] = table.column("walkable").to_numpy(zero_copy_only=False)
        data = format_pbm(field.shape[1], field.shape[0], field)
        return pa.table({"name": pa.array([f"grid-{table.column('grid_id')[0].as_py()}.pbm"]), "content": pa.array([data], pa.binary())})

    from ..sources.files import write_files

    write_files(cells.select("grid_id", "col", "row", "walkable").groupBy("grid_id").applyInArrow(run, "name string, content binary"), folder)
