"""Connected components over edges of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import Tables


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root is the component's smallest node.

    Each round hooks every node to its smallest lower neighbour, compresses the parent
    chains by pointer jumping and contracts the graph, so a star of any size ends in one
    round.  All state is in tables; only counts come to the driver.  No edges: no rows.
    """
    graph = tables.save(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    found: DataFrame | None = None
    while not graph.isEmpty():
        parent = tables.save(graph.groupBy("hi").agg(F.min("lo").alias("up")).withColumnRenamed("hi", "node"))
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            jumped = tables.save(parent.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            parent = jumped.select("node", "up")
            if not moved:
                break
        if found is None:
            found = parent
        else:
            later = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            found = tables.save(found.join(later, "up", "left").select("node", F.coalesce("upper", "up").alias("up")).unionByName(parent))
        ups = [parent.select(F.col("node").alias(side), F.col("up").alias(f"{side}_up")) for side in ("hi", "lo")]
        ends = graph.join(ups[0], "hi", "left").join(ups[1], "lo", "left").select(F.coalesce("hi_up", "hi").alias("a"), F.coalesce("lo_up", "lo").alias("b"))
        graph = tables.save(ends.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    if found is None:
        return graph.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    roots = found.select(F.col("up").alias("node")).distinct().withColumn("root", F.col("node"))
    return found.select("node", F.col("up").alias("root")).unionByName(roots)


def ranked(df: DataFrame, order: list[str], value: str | None = None) -> DataFrame:
    """df with rank (from 0 in the order of the columns) and, with value, before: its sum over the rows in front.

    Rows are sorted by ranges; windows run within a range, and only counts and sums per range meet on the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = Tables(spark)
    dealt = tables.save(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    what = F.sum(value) if value else F.lit(0)
    sizes = sorted(tuple(r) for r in dealt.groupBy("_part").agg(F.count("*"), what).collect())  # a row per range
    real = bool(value) and dict(df.dtypes)[value] in ("double", "float")
    starts, rank, total = [], 0, 0.0 if real else 0
    for part, count, add in sizes:
        starts.append((part, rank, total))
        rank, total = rank + count, total + (add or 0)
    base = F.broadcast(spark.createDataFrame(starts, f"_part int, _rank long, _before {'double' if real else 'long'}"))
    w = Window.partitionBy("_part").orderBy(*order)
    out = dealt.join(base, "_part").withColumn("rank", F.col("_rank") + F.row_number().over(w) - 1)
    if value:
        out = out.withColumn("before", F.col("_before") + F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop("_part", "_rank", "_before")
