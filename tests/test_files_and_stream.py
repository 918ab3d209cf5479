import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.kernels import formats
from meshlark.operators import grid
from meshlark.sources import files
from meshlark.streaming.worker import Worker


def test_files_are_read(spark, tmp_path):
    (tmp_path / "a.mesh").write_bytes(formats.to_bytes(np.array([[0, 0], [2, 0], [2, 2], [0, 2]]), np.array([[0, 1, 2], [0, 2, 3]])))
    m = files.read_navmesh(spark, f"file://{tmp_path}/a.mesh").orderBy("tid").collect()
    assert [r.v for r in m] == [[0, 1, 2], [0, 2, 3]] and m[0].nbr == [None, 1, None] and m[1].area == 2.0
    (tmp_path / "a.poly").write_text("3 2 0 0\n1 0 0\n2 1 0\n3 0 1\n1 0\n1 1 2\n0\n")
    p = files.read_poly(spark, f"file://{tmp_path}/a.poly").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in p} == {"vertex": 3, "segment": 1}
    (tmp_path / "a.pbm").write_bytes(b"P4 3 1\n" + bytes([0b10100000]))
    assert [r.walkable for r in grid.read_pbm(spark, f"file://{tmp_path}/a.pbm").orderBy("col").collect()] == [True, False, True]
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "outer_polygon": [{"x": 0, "y": 0}, {"x": 1, "y": 0}, {"x": 0, "y": 1}], "holes": []}))
    assert files.read_scenes(spark, f"file://{tmp_path}/a.json").count() == 3


def test_mesh_bytes_round_trip(spark, tmp_path):
    rows = [(7, 0, [10, 11, 12], 0.0, 0.0, 2.0, 0.0, 2.0, 2.0, [1, 0, 1]), (7, 1, [10, 12, 13], 0.0, 0.0, 2.0, 2.0, 0.0, 2.0, [1, 1, 0])]
    t = spark.createDataFrame(rows, "mesh_id long, tid long, v array<long>, ax double, ay double, bx double, by double, cx double, cy double, marks array<int>")
    r = files.navmesh_bytes(t).first()
    m = formats.from_bytes(r.content)
    assert m.tris.tolist() == [[0, 1, 2], [0, 2, 3]] and r.digest == f"{formats.fnv1a(r.content):016x}"


def test_grid_edits_windows_and_outside(spark):
    g = grid.set_cells(grid.lattice(spark, 3, 3, walkable=True), spark.createDataFrame([(0, 1, 1, False), (0, 9, 9, False)], "grid_id long, col long, row long, walkable boolean"))
    assert g.where("not walkable").count() == 1 and g.count() == 9
    at = grid.cells_at(g, spark.createDataFrame([(0, -1, 0), (0, 0, 0)], "grid_id long, col long, row long"))
    assert [r.walkable for r in at.orderBy("col").collect()] == [False, True]
    loops = grid.trace_loops(g, 3).groupBy("ring_id").count().orderBy("ring_id").collect()
    assert [r["count"] for r in loops] == [12, 4]
    for radius in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            grid.erode(g, 3, 3, radius)
    assert grid.erode(g, 3, 3, 0.0).where("walkable").count() == 8


@pytest.mark.parametrize("radius", [1.0, 1.5, 2.0, 2.9])
def test_erosion_equals_brute_force(spark, radius):
    rng = np.random.default_rng(int(radius * 10))
    w, h = 23, 17
    open_ = rng.random((h, w)) > 0.06
    g = spark.createDataFrame([(0, c, r, bool(open_[r, c])) for r in range(h) for c in range(w)], "grid_id long, col long, row long, walkable boolean")
    got = {(r.col, r.row) for r in grid.erode(g, w, h, radius).where("walkable").collect()}
    walls = [(c, r) for r in range(-1, h + 1) for c in range(-1, w + 1) if not (0 <= c < w and 0 <= r < h and open_[r, c])]
    gap = lambda a, b: max(abs(a - b) - 1, 0)
    want = {(c, r) for r in range(h) for c in range(w) if min(gap(c, x) ** 2 + gap(r, y) ** 2 for x, y in walls) >= radius**2 and open_[r, c]}
    assert got == want


def test_newest_snapshot_of_a_batch_wins(spark, tmp_path):
    def build(df):
        if df.where("bad").count():
            raise RuntimeError("no perimeter")
        return df.groupBy("seq").agg(F.count("*").alias("cells"))

    source = str(tmp_path / "in")
    worker = Worker(spark, str(tmp_path / "out"), build)
    stream = lambda: worker.start(spark.readStream.schema("seq long, bad boolean").parquet(source), str(tmp_path / "cp"))
    spark.createDataFrame([(1, False), (2, False), (2, False)], "seq long, bad boolean").write.parquet(source)
    stream().awaitTermination()
    assert worker.current().select("seq", "cells").first() == (2, 2)
    spark.createDataFrame([(3, True)], "seq long, bad boolean").write.mode("append").parquet(source)
    stream().awaitTermination()
    s = worker.stats().first()
    assert (s.submitted, s.coalesced, s.completed, s.failed, s.generation) == (3, 1, 1, 1, 0)
    assert worker.current().select("seq").first()[0] == 2


def test_poly_without_vertices_takes_them_from_its_node_file(spark, tmp_path):
    (tmp_path / "a.node").write_text("3 2 0 1\n1 0 0 4\n2 1 0 5\n3 0 1 6\n")
    (tmp_path / "a.poly").write_text("0 2 0 0\n1 1\n1 1 3 9\n0\n")
    (tmp_path / "b.poly").write_text("2 2 0 0\n0 0 0\n1 5 5\n1 0\n0 0 1\n0\n")
    got = sorted((r.path[-6:], r.kind, r.id, r.x, r.a, r.b, r.mark) for r in files.read_poly(spark, str(tmp_path)).collect())
    assert [g for g in got if g[0] == "a.poly"] == [("a.poly", "segment", 0, None, 0, 2, 9), ("a.poly", "vertex", 0, 0.0, None, None, 4), ("a.poly", "vertex", 1, 1.0, None, None, 5), ("a.poly", "vertex", 2, 0.0, None, None, 6)]
    assert len([g for g in got if g[0] == "b.poly"]) == 3 and len(got) == 7


def test_files_are_written_by_executors(spark, tmp_path):
    rows = spark.createDataFrame([(1, "vertex", 0, 0.5, 1.0, None, None, 3), (1, "vertex", 1, 2.0, 1.0, None, None, 0), (1, "segment", 0, None, None, 0, 1, 2)], "graph_id long, kind string, id long, x double, y double, a long, b long, mark int")
    from pyspark.sql import functions as F

    text = files.graph_text(rows).select(F.lit("g.poly").alias("name"), F.encode("content", "utf-8").alias("content"))
    assert files.write_files(text, str(tmp_path / "out")) == 1
    back = sorted((r.kind, r.id, r.x, r.a, r.b, r.mark) for r in files.read_poly(spark, str(tmp_path / "out")).collect())
    assert back == [("segment", 0, None, 0, 1, 2), ("vertex", 0, 0.5, None, None, 3), ("vertex", 1, 2.0, None, None, 0)]
    tris = spark.createDataFrame([(1, 0, [0, 1, 2])], "mesh_id long, tid long, v array<long>")
    assert files.ele_text(tris).first().content.split()[:3] == ["1", "3", "0"]
    with pytest.raises(Exception, match="not there"):
        files.graph_text(rows.where("id = 0")).collect()
