import pytest
from support import DATA, same_rows

from meshlark.plans import catalogue, geometry_queries  # noqa: F401

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(catalogue.queries()[name](spark, DATA), duck.sql(SQL[name]))


def test_kernels_run_over_all_questions(spark):
    q = catalogue.queries()
    paths = {r.id: r for r in q["astar_paths"](spark, DATA).collect()}
    seen = {r.id: r for r in q["los_batch"](spark, DATA).collect()}
    assert len(paths) == len(seen) == 999
    for i, r in seen.items():
        if r.kind == "clear":
            assert paths[i].status == "ok"


def test_triangulated_regions_have_the_area_of_their_cells(spark):
    from pyspark.sql import functions as F

    from meshlark.operators import mesh
    from meshlark.plans import views

    t = catalogue.queries()["cdt_mesh"](spark, DATA)
    total = t.agg(F.sum(mesh.tri_area2()), F.min(mesh.tri_area2())).first()
    assert total[1] > 0 and total[0] == 2 * views.cells(spark, DATA).where("walkable").count()
