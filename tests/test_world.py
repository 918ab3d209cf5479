import math

from pyspark.sql import functions as F

from meshlark.kernels.search import BLOCKED, CLEAR, OUTSIDE, Mesh
from meshlark.operators import crowd, mesh, navigation, spatial, world


def room(w, h, x=0.0, y=0.0, first=0):
    v = {0: (x, y), 1: (x + w, y), 2: (x + w, y + h), 3: (x, y + h)}
    return v, {first: (0, 1, 2), first + 1: (0, 2, 3)}


def rows(tile, v, tris):
    return [(tile, t, list(c), *[float(z) for k in c for z in v[k]]) for t, c in tris.items()]


SCHEMA = "tile long, tid long, v array<long>, ax double, ay double, bx double, by double, cx double, cy double"


def test_two_tiles_are_linked_and_crossed(spark):
    a, b = room(4, 4), room(4, 2)
    tris = spark.createDataFrame(rows(0, *a) + rows(1, *b), SCHEMA)
    placed = world.place(tris, spark.createDataFrame([(0, 0.0, 0.0), (1, 4.0, 1.0)], "tile long, dx double, dy double"))
    assert placed.where("tile = 1").agg(F.min("ax"), F.max("cy")).first() == (4.0, 3.0)
    border = []
    for r in placed.collect():
        p = [(r.ax, r.ay), (r.bx, r.by), (r.cx, r.cy)]
        border += [(r.tile, r.tid, *map(float, p[(i + 1) % 3]), *map(float, p[(i + 2) % 3])) for i in range(3)]
    edges = spark.createDataFrame(border, "tile long, tid long, ax double, ay double, bx double, by double")
    links = [tuple(r) for r in world.stitch(edges, 2.0).collect()]
    assert len(links) == 1 and links[0][:4] == (0, 0, 1, 1) and sorted((links[0][5], links[0][7])) == [1.0, 3.0]
    tiled = world.TiledMesh({0: Mesh(*a), 1: Mesh(*room(4, 2, 4.0, 1.0))}, links)
    assert tiled.path((1, 2), (7, 2)) == [(1, 2), (7, 2)]
    bent = tiled.path((1, 3.9), (7, 2.9))
    assert len(bent) == 3 and math.dist(bent[1], (4, 3)) < 1e-9
    assert tiled.path((1, 1), (20, 20)) is None
    assert tiled.sight((1, 2), (7, 2.1))[0] == CLEAR and tiled.sight((1, 3.9), (7, 3.9))[0] == BLOCKED and tiled.sight((-1, 0), (1, 1))[0] == OUTSIDE
    at = world.locate(spark.createDataFrame([(0, 1.0, 1.0), (1, 6.0, 2.0), (2, 4.0, 2.0), (3, 9.0, 9.0)], "id long, x double, y double"), placed, 2.0)
    assert {r.id: r.tile for r in at.collect()} == {0: 0, 1: 1, 2: 0, 3: None}


def test_zones_along_a_path(spark):
    steps = spark.createDataFrame([(1, k, k, z) for k, z in enumerate(["a", "a", None, None, "b"])], "path long, seq long, tid long, zone string")
    assert [(r.seq, r.from_zone, r.to_zone) for r in world.zone_crossings(steps).orderBy("seq").collect()] == [(2, "a", None), (4, None, "b")]


def test_an_agent_walks_across_an_open_arena(spark):
    v, tris = room(20, 20)
    m, frame = Mesh(v, tris), spark.createDataFrame(rows(0, v, tris), SCHEMA)
    agents = spark.createDataFrame([(0, 2.0, 10.0, 0.0, 0.0, 0.3, 2.0, 1.0, 18.0, 10.0, None, 0), (1, 10.0, 10.2, 0.0, 0.0, 0.3, 2.0, 1.0, None, None, None, 0)], crowd.SCHEMA)
    for _ in range(3):
        agents = spark.createDataFrame(crowd.tick(agents, m, frame, 0.5).collect(), crowd.SCHEMA)
    a = {r.id: r for r in agents.collect()}
    assert 4.5 < a[0].x <= 5.0 + 1e-9 and abs(a[0].y - 10) < 0.5 and a[0].route[-1].x == 18.0
    assert (a[1].x, a[1].y, a[1].route) == (10.0, 10.2, None)


def test_penalty_is_the_worst_of_neighbours(spark):
    agents = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0, 0.5, 1.0, 0.0, None, None, None, 0), (1, 2.0, 0.0, 0.0, 0.0, 0.5, 1.0, 0.0, None, None, None, 0), (2, 0.0, 0.9, 0.0, 0.0, 0.5, 1.0, 0.0, None, None, None, 0)], crowd.SCHEMA)
    choices = spark.createDataFrame([(0, 1, 1.0, 0.0), (1, 1, 0.0, 0.0)], "id long, k int, cx double, cy double")
    got = {r.id: r.penalty for r in crowd.penalties(agents, choices, crowd.Settings(cell=2.0)).collect()}
    assert got[0] == 1.0 and abs(got[1] - 0.5) < 1e-9


def test_mesh_utilities(spark):
    v, tris = room(2, 2)
    t = spark.createDataFrame(rows(0, v, tris), SCHEMA).drop("tile")
    adj = mesh.adjacency(t)
    assert mesh.boundary(adj).count() == 4 and mesh.regions(adj).select("region").distinct().count() == 1
    marked = mesh.with_marks(adj, spark.createDataFrame([(0, 2, 5)], "lo long, hi long, mark int"))
    assert mesh.regions(marked).select("region").distinct().count() == 2
    assert mesh.invalid_corners(t, spark.createDataFrame([(0,), (1,), (2,)], "vid long")).collect()[0].vid == 3
    assert spatial.nearest_triangle(spark.createDataFrame([(0, 50.0, 1.0)], "id long, x double, y double"), t, 4.0).first().qx == 2.0
    m = navigation.load(t)
    kept = navigation.keep_off_walls(spark.createDataFrame([(0, 0.1, 1.0)], "id long, x double, y double"), m, 0.5).first()
    assert abs(kept.x - 0.5) < 1e-9


def test_agents_without_a_way_give_room(spark):
    row = lambda i, x, y, vx=0.0, vy=0.0: (i, x, y, vx, vy, 0.5, 2.0, 0.0, None, None, None, 0)
    agents = spark.createDataFrame([row(0, 5.0, 5.0), row(1, 5.6, 5.0), row(2, 20.0, 5.0), row(3, 22.0, 5.0, -2.0), row(4, 40.0, 5.0), row(5, 60.0, 5.0), row(6, 60.0, 5.0)], crowd.SCHEMA)
    got = {r.id: (r.nvx, r.nvy) for r in crowd.choose(agents, crowd.Settings(cell=4.0)).collect()}
    assert got[0][0] < 0 < got[1][0] and abs(got[0][0] + 1) < 1e-9 and abs(got[0][1]) < 1e-9  # overlapping: straight apart at half speed
    assert abs(got[2][0] ** 2 + got[2][1] ** 2 - 1) < 1e-9  # about to be run into: a nudge
    assert got[4] == (0.0, 0.0)
    assert got[5] != got[6] and abs(got[5][0] ** 2 + got[5][1] ** 2 - 1) < 1e-9  # at one place: apart by their ids


def test_all_corners_within_reach_are_passed(spark):
    frame = spark.createDataFrame([(0, [0, 1, 2], 0.0, 0.0, 20.0, 0.0, 20.0, 20.0), (1, [0, 2, 3], 0.0, 0.0, 20.0, 20.0, 0.0, 20.0)], "tid long, v array<long>, ax double, ay double, bx double, by double, cx double, cy double")
    m = navigation.load(frame)
    way = [(5.0, 5.0), (5.1, 5.0), (12.0, 5.0)]
    agents = spark.createDataFrame([(0, 5.0, 5.0, 0.0, 0.0, 0.3, 0.1, 1.0, 12.0, 5.0, way, 0), (1, 5.0, 15.0, 0.0, 0.0, 0.3, 1.0, 1.0, 5.0, 18.0, [], 0), (2, -4.0, 10.0, 0.0, 0.0, 0.3, 1.0, 1.0, None, None, None, 0)], crowd.SCHEMA)
    out = {r.id: r for r in crowd.tick(agents, m, frame, 0.5).collect()}
    assert [tuple(p) for p in out[0].route] == way[2:] and out[1].route == [] and out[1].y > 15.0 and out[1].stuck == 0
    assert (out[2].x, out[2].y) == (0.0, 10.0)  # off the mesh: put on its nearest place
