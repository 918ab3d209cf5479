"""Equal questions are asked once, and shorter ways to an answer give the same."""

from support import DATA, same_rows

from meshlark.kernels.search import Mesh
from meshlark.operators import navigation
from meshlark.plans import catalogue, geometry_queries, views  # noqa: F401


def test_found_ways_end_as_the_sql_says_and_clear_ones_as_before(spark, duck):
    m, asked = navigation.load(views.tris(spark, DATA)), catalogue._questions(spark, DATA)
    found = navigation.find_paths(asked, m)
    same_rows(found.select("id", "status"), duck.sql(catalogue.oracle_sql()["path_status"]))
    before, now = navigation.paths_clear(found, m).collect(), navigation.ways_clear(asked, m).collect()
    assert sorted(map(tuple, before)) == sorted(map(tuple, now)) and len(now) == 999


def test_equal_questions_are_asked_once(spark):
    m = Mesh({0: (0.0, 0.0), 1: (4.0, 0.0), 2: (4.0, 4.0), 3: (0.0, 4.0)}, {0: (0, 1, 2), 1: (0, 2, 3)})
    questions = [(3.0, 1.0, 1.0, 3.0), (9.0, 9.0, 1.0, 1.0), (1.0, 1.0, 1.0, 9.0)]
    asked = spark.createDataFrame([(k, *questions[k % 3]) for k in range(1500)], "id long, sx double, sy double, gx double, gy double").coalesce(1)
    count = spark.sparkContext.accumulator(0)

    class Counted(Mesh):
        def path(self, *a):
            count.add(1)
            return Mesh.path(self, *a)

    counted = Counted(m.vertices, m.tris)
    got = {r.id: (r.status, len(r.points), r.triangles) for r in navigation.find_paths(asked, counted).collect()}
    want = [("ok", 2, [0, 1]), ("start_outside", 0, []), ("goal_outside", 0, [])]
    assert len(got) == 1500 and all(got[k] == want[k % 3] for k in got)
    assert count.value == 3


def test_a_status_is_that_of_the_search_where_edges_have_three_triangles():
    at = {0: (0.0, 0.0), 1: (4.0, 0.0), 2: (2.0, 4.0), 3: (2.0, -4.0), 4: (8.0, 4.0)}
    for tris in ({0: (0, 1, 2), 1: (1, 0, 3)}, {0: (0, 1, 2), 1: (1, 0, 3), 2: (0, 1, 4)}):
        m = Mesh(at, tris)
        assert m.plain == (len(tris) == 2)
        for p in [(2.0, 1.0), (2.0, -1.0), (5.0, 2.0), (20.0, 0.0)]:
            for q in [(2.0, 1.0), (2.0, -1.0), (5.0, 2.0), (20.0, 0.0)]:
                assert m.status(p, q) == m.path(p, q)[0]


def test_signs_on_a_lattice_need_no_rationals(monkeypatch):
    from fractions import Fraction

    from meshlark.kernels import predicates

    def none(*_):
        raise AssertionError("rationals on a lattice")

    thirds = (0.1, 0.1), (0.7, 0.7), (0.4, 0.4)
    want = [(Fraction(b[0]) - Fraction(a[0])) * (Fraction(c[1]) - Fraction(a[1])) - (Fraction(b[1]) - Fraction(a[1])) * (Fraction(c[0]) - Fraction(a[0])) for a, b, c in (thirds,)]
    assert predicates.orient(*thirds) == (want[0] > 0) - (want[0] < 0)
    monkeypatch.setattr(predicates, "Fraction", none)
    assert predicates.orient((0.0, 0.0), (2.0**40, 2.0**40), (3.0, 3.0)) == 0
    assert predicates.orient((1 / 256, 0.0), (3 / 256, 2 / 256), (5 / 256, 4 / 256)) == 0
    assert predicates.in_circle((0.0, 0.0), (2.5, 0.0), (2.5, 2.5), (0.0, 2.5)) == 0
