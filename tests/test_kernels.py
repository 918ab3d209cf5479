import math
import random

import numpy as np
import pytest

from meshlark.kernels import formats, predicates, search, triangulate
from meshlark.operators.grid import envelope, parse_pbm


def area(p, t):
    a, b, c = (p[v] for v in t)
    return ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2


def star(rng, n):
    return [(50 + r * math.cos(2 * math.pi * i / n), 50 + r * math.sin(2 * math.pi * i / n)) for i in range(n) for r in [20 + 25 * rng.random()]]


def ring_area(r):
    return abs(sum(r[i - 1][0] * r[i][1] - r[i][0] * r[i - 1][1] for i in range(len(r)))) / 2


def test_triangulation_is_constrained_delaunay_and_paths_stay_inside():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randint(9, 22)
        outer, holes = star(rng, n), []
        for cx, cy in ((45, 45), (55, 55), (45, 56)):
            if rng.random() < 0.7:
                m = rng.randint(3, 7)
                holes.append([(cx + 3 * math.cos(2 * math.pi * i / m), cy + 3 * math.sin(2 * math.pi * i / m)) for i in range(m)])
        p, t, sides = triangulate.triangulate(outer, holes)
        assert len(t) == n + sum(map(len, holes)) + 2 * len(holes) - 2
        assert abs(sum(area(p, x) for x in t) - ring_area(outer) + sum(map(ring_area, holes))) < 1e-6
        mesh = search.Mesh(dict(enumerate(p)), dict(enumerate(t)))
        for e, ts in mesh.beyond.items():
            assert (len(ts) == 1) == (frozenset(e) in sides)
            if len(ts) == 2:
                far = next(v for v in t[ts[1]] if v not in e)
                assert predicates.in_circle(*(p[v] for v in t[ts[0]]), p[far]) <= 0
        ends = [(30 + 40 * rng.random(), 30 + 40 * rng.random()) for _ in range(8)]
        for a, b in zip(ends, ends[1:], strict=False):
            status, path, way = mesh.path(a, b)
            if status != "ok":
                continue
            assert path[0] == a and path[-1] == b and sum(map(math.dist, path, path[1:])) >= math.dist(a, b) - 1e-9
            for u, v in zip(path, path[1:], strict=False):
                for f in (0.1, 0.5, 0.9):
                    q = u[0] + (v[0] - u[0]) * f, u[1] + (v[1] - u[1]) * f
                    if mesh.locate(q) is None:
                        assert min(math.dist(q, search.nearest_on(mesh.vertices[x], mesh.vertices[y], q)) for x, y in mesh.walls) < 1e-6


def test_degenerate_rings():
    assert triangulate.triangulate([(0, 0), (1, 1)], [])[1] == []
    assert triangulate.triangulate([(0, 0), (2, 0), (1, 0)], [])[1] == []
    assert len(triangulate.triangulate([(0, 0), (0, 0), (0, 2), (2, 2), (2, 0), (0, 0)], [])[1]) == 2
    with pytest.raises(ValueError):
        triangulate.triangulate([(0, 0), (4, 0), (4, 4), (0, 4)], [[(9, 9), (10, 9), (9, 10)]])


def test_exact_signs():
    a, b = (0.1, 0.1), (0.3, 0.3)
    assert predicates.orient((0.0, 0.0), (1.0, 1.0), (0.5, 0.5 + 2**-53)) == 1
    assert predicates.orient((0.0, 0.0), (1.0, 1.0), (0.5, 0.5)) == 0
    assert predicates.orient(a, b, (0.2, 0.2)) == -predicates.orient(b, a, (0.2, 0.2))
    assert predicates.in_circle((0, 0), (1, 0), (1, 1), (0, 1)) == 0


def test_sight_and_clearance_in_a_room():
    p, t, _ = triangulate.triangulate([(0, 0), (4, 0), (4, 4), (0, 4)], [[(1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 2.5)]])
    m = search.Mesh(dict(enumerate(p)), dict(enumerate(t)))
    assert m.sight((0.5, 0.6), (3.5, 0.7))[0] == search.CLEAR
    kind, at = m.sight((0.5, 2.1), (3.5, 2.1))
    assert kind == search.BLOCKED and abs(at[0] - 1.5) < 1e-9
    assert m.sight((2, 2), (3, 3))[0] == search.OUTSIDE
    assert m.path((0.5, 2), (3.5, 2.1))[0] == "ok" and len(m.path((0.5, 2), (3.5, 2.1))[1]) > 2
    assert m.path((0.5, 2), (3.5, 2.1), clearance=2.0)[0] == "unreachable"
    assert m.path((9, 9), (1, 1))[0] == "start_outside"
    assert len(m.visible((0.5, 0.5), 1.0, 4)) == 8 and m.visible((2, 2), 1.0, 8) is None
    x, y = m.keep_off((0.05, 2.0), 0.3)
    assert abs(x - 0.3) < 1e-9 and y == 2.0


def test_binary_format_round_trip_and_errors():
    p, t, _ = triangulate.triangulate([(0, 0), (4, 0), (4, 4), (0, 4)], [[(1, 1), (2, 1), (2, 2), (1, 2)]])
    data = formats.to_bytes(np.array(p), np.array(t))
    m = formats.from_bytes(data)
    assert m.tris.tolist() == [list(x) for x in t] and m.vertices.tolist() == [list(map(float, x)) for x in p]
    assert abs(m.info["area"].sum() - 15) < 1e-12 and set(m.info["region"]) == {0}
    for k, row in enumerate(m.nbr.tolist()):
        assert all(o == formats.NONE or k in m.nbr[o] for o in row)
    for bad, said in ((b"x" + data[1:], "BadMagic"), (data[:8] + b"\x09" + data[9:], "Unsupported"), (data[:-4], "Truncated")):
        with pytest.raises(ValueError, match=said):
            formats.from_bytes(bad)


def test_poly_text_from_base_one_and_zero():
    text = "# square\n4 2 0 1\n{0} 0 0 1\n{1} 4 0 1\n{2} 4 4 1\n{3} 0 4 1\n4 1\n{0} {0} {1} 2\n{1} {1} {2} 2\n{2} {2} {3} 2\n{3} {3} {0} 2\n1\n1 2 2\n"
    graphs = [formats.parse_poly(text.format(*range(b, b + 4))) for b in (0, 1)]
    assert graphs[0] == graphs[1] == formats.parse_poly(formats.format_poly(graphs[0]))
    assert graphs[0].segments == [(0, 1), (1, 2), (2, 3), (3, 0)] and graphs[0].holes == [(2.0, 2.0)]
    with pytest.raises(ValueError, match="line 2"):
        formats.parse_poly("\n4 3 0 0\n")
    assert formats.format_ele([(0, 1, 2)]) == "1 3 0\n1 1 2 3\n"


def test_pbm_bits_and_envelope():
    w, h, bits = parse_pbm(b"P4\n# map\n10 2\n" + bytes([0b10000000, 0b01000000, 0, 0]))
    assert (w, h) == (10, 2) and bits[1].tolist() == [True] + [False] * 8 + [True] and not bits[0].any()
    rng = np.random.default_rng(1)
    for _ in range(50):
        g = rng.integers(0, 60, rng.integers(1, 30))
        r = np.arange(len(g))
        assert envelope(g).tolist() == (g[None, :] + (r[:, None] - r[None, :]) ** 2).min(1).tolist()


def test_generator_and_digest():
    r = predicates.Lcg(1)
    assert all(0 <= r.next_float() < 1 for _ in range(100)) and predicates.Lcg(7).next_int() == predicates.Lcg(7).next_int()
    assert formats.fnv1a(b"") == 0xCBF29CE484222325 and formats.fnv1a(b"a") == 0xAF63DC4C8601EC8C
