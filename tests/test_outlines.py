"""Single rings and paths against plain versions."""

import math
import random

from meshlark.kernels import outlines as O
from meshlark.operators import paths, rings


def stairs(n):
    """A triangle whose long side is a staircase of n unit steps."""
    up = [p for k in range(n) for p in ((n - k, k), (n - k, k + 1))]
    return [(0, 0), *up]


def test_stairs_become_a_diagonal(spark):
    ring = [(float(x), float(y)) for x, y in stairs(5)]
    assert O.straight_out(O.smooth(ring))[0] == (0, 0) and len(O.straight_out(O.smooth(ring))) < len(ring) / 2
    square = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)]
    assert O.smooth(square) == square and O.straight_out([(0, 0), (1, 0), (2, 0), (2, 2), (0, 2), (0, 1)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    frame = spark.createDataFrame([(r, k, x, y) for r, one in ((1, ring), (2, square)) for k, (x, y) in enumerate(one)], "ring_id long, seq long, x double, y double")
    got = {(r.ring_id, r.seq) for r in rings.stair_middles(frame).collect()}
    assert got == {(1, k) for k in range(len(ring)) if O._is_stair(ring, k)} != set()
    done = {r.ring_id: r for r in rings.finish(frame, offset=-0.5).collect()}
    assert [tuple(p) for p in done[1].points] == O.straight_out(O.smooth(ring)) and tuple(done[2].inside) == O.inside_point(square)
    assert sorted(tuple(p) for p in done[2].moved) == [(-0.5, -0.5), (-0.5, 3.5), (3.5, -0.5), (3.5, 3.5)] or len(done[2].moved) == 8


def test_a_point_inside_is_inside():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(5, 12)
        ring = [(math.cos(a) * r, math.sin(a) * r) for a, r in zip((2 * math.pi * (k + rng.uniform(0, 0.9)) / n for k in range(n)), (rng.uniform(0.3, 1) for _ in range(n)), strict=True)]
        p = O.inside_point(ring)
        if p is not None:
            odd = False
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
                    odd = not odd
            assert odd
    assert O.inside_point([(0, 0), (1, 1), (2, 2)]) is None and O.moved_left([(0, 0), (1, 1), (2, 2)], 1.0) is None


def test_moved_rings():
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert O.moved_left(square, 0.0) == square
    inner = O.moved_left(square, 1.0)  # left of a counter-clockwise ring is inside: both ends of each corner stay
    assert len(inner) == 8 and (1.0, 0.0) in inner and (0.0, 1.0) in inner
    outer = O.moved_left(square[::-1], 1.0)  # corners bend away: mitred
    assert sorted((round(x, 9), round(y, 9)) for x, y in outer) == [(-1.0, -1.0), (-1.0, 5.0), (5.0, -1.0), (5.0, 5.0)]
    assert len(O.moved_left(square[::-1], 1.0, limit=1.0)) == 8


def test_followers_never_go_back(spark):
    way = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]
    f = paths.Follower(way, lookahead=2.0)
    assert f.target((3.0, 1.0)) == (5.0, 0.0) and f.arc == 3.0 and f.target((1.0, 0.0)) == (5.0, 0.0)
    assert f.target((9.0, 0.0)) == (10.0, 1.0) and abs(f.progress - 0.45) < 1e-12 and not f.at_end
    assert f.target((10.0, 20.0)) == (10.0, 10.0) and f.at_end
    shy = paths.Follower(way, lookahead=1.0, avoid=2.0)
    x, y = shy.target((9.0, 0.0))  # the target is the corner itself: pushed out by the whole distance
    assert abs(x - (10 + 2 / math.sqrt(2))) < 1e-9 and abs(y + 2 / math.sqrt(2)) < 1e-9
    assert paths.Follower([(1.0, 1.0)]).target((5.0, 5.0)) == (1.0, 1.0) and paths.Follower([(1.0, 1.0)]).progress == 0.0
    ways = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0)]), (2, [])], "id long, points array<struct<x:double,y:double>>")
    seen = spark.createDataFrame([(1, 1, 2.0, 5.0), (1, 0, 4.0, 1.0), (2, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)], "id long, seq long, x double, y double")
    assert sorted(tuple(r) for r in paths.follow(ways, seen, lookahead=1.0).collect()) == [(1, 0, 4.0, 0.4, False, 5.0, 0.0), (1, 1, 4.0, 0.4, False, 5.0, 0.0)]


def test_turns_are_exact_on_a_lattice(spark):
    # straight legs of odd lengths turn to no side, and legs without length have no cosine
    ways = {1: [(0, 0), (49, 7), (147, 21), (98, 14)], 2: [(5, 5), (5, 5), (8, 9), (4, 12)], 3: [(0, 0), (3, 1), (2, 4)]}
    rows = [(k, n, float(x), float(y)) for k, way in ways.items() for n, (x, y) in enumerate(way)]
    t = paths.turns(spark.createDataFrame(rows, "way long, n long, x double, y double"), "way", ["n"])
    got = sorted((r.way, r.seq, r.cos if r.cos is None else round(r.cos, 12), r.side, round(r.ox, 6) + 0.0, round(r.oy, 6) + 0.0) for r in t.collect())
    assert [r[:4] for r in got] == [(1, 1, 1.0, 0), (1, 2, -1.0, 0), (2, 1, None, 0), (2, 2, 0.0, 1), (3, 1, 0.0, 1)]
    assert got[1][4:] == got[2][4:] == (0.0, 0.0)
