"""Integer-lattice geometry derived from the given tables, in DataFrame form and in SQL.

Coordinates are integers, ties are broken by ids, and a division or root comes last, so
results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 64, 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid_id, col, row, cell, walkable): a 64x48 grid; a cell is wall where a sum over its orders divides by 3."""
    o = table(spark, sf_dir, "orders")
    held = o.groupBy((F.col("o_custkey") % WIDTH).alias("col"), (F.col("o_orderkey") % HEIGHT).alias("row")).agg(F.sum(F.col("o_custkey") + F.col("o_orderkey")).alias("s"))
    grid = spark.range(WIDTH * HEIGHT).select((F.col("id") % WIDTH).alias("col"), F.floor(F.col("id") / WIDTH).alias("row"))
    both = grid.join(held, ["col", "row"], "left")
    return both.select(F.lit(0).cast("long").alias("grid_id"), "col", "row", (F.col("row") * WIDTH + F.col("col")).alias("cell"), (F.col("s").isNull() | (F.col("s") % 3 != 0)).alias("walkable"))


def tris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, cell, v, ax..cy): two counter-clockwise triangles per walkable cell, on a doubled lattice."""
    c = cells(spark, sf_dir).where("walkable")
    corner = lambda dx, dy: F.struct(((F.col("row") + dy) * (WIDTH + 1) + F.col("col") + dx).alias("v"), (2 * (F.col("col") + dx)).alias("x"), (2 * (F.col("row") + dy)).alias("y"))
    halves = [F.struct(F.lit(k).alias("k"), *[corner(*d).alias(n) for n, d in zip("abc", p, strict=True)]) for k, p in enumerate((((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1))))]
    t = c.select("cell", F.explode(F.array(*halves)).alias("t"))
    return t.select((F.col("cell") * 2 + F.col("t.k")).alias("tid"), "cell", F.array("t.a.v", "t.b.v", "t.c.v").alias("v"), *[F.col(f"t.{k}.{d}").alias(f"{k}{d}") for k in "abc" for d in "xy"])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", "ts", ((F.col("user_id") * 37 + F.col("event_id")) % (2 * WIDTH)).alias("x"), ((F.col("event_id") * 11) % (2 * HEIGHT)).alias("y"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ring_id, seq, x, y): a customer's orders in time, three at least."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey")
    r = o.select(
        F.col("o_custkey").alias("ring_id"), (F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")) - 1).cast("long").alias("seq"),
        (F.col("o_orderkey") * 17 % 128).alias("x"), (F.col("o_orderkey") * 29 % 96).alias("y"), F.count("*").over(w).alias("n"),
    )
    return r.where("n >= 3").drop("n")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ax, ay, bx, by, mark): distinct segments on a 256 lattice."""
    i = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    s = i.select((F.col("l_partkey") % 256).alias("ax"), (F.col("l_suppkey") * 7 % 256).alias("ay"), ((F.col("l_partkey") + q) % 256).alias("bx"), ((F.col("l_suppkey") * 7 + q * 3) % 256).alias("by")).distinct()
    key = ((F.col("ax") * 256 + F.col("ay")) * 256 + F.col("bx")) * 256 + F.col("by")
    return s.withColumn("id", key).withColumn("mark", (F.col("ax") % 3).cast("int"))


#: Lattices of short lines, spots and agents, wide enough that what meets grows with the rows and not their square.
SPAN, CROWD_SPAN = 4096, 1024


def lines(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """(id, ax, ay, bx, by): distinct short segments, from 14 to 20 long at most, all places above 0.

    once=False leaves repeated rows in, for operators that count rows of one id once themselves."""
    i = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    a = i.select(((F.col("l_orderkey") * 37 + F.col("l_partkey")) % SPAN + 64).alias("ax"), ((F.col("l_orderkey") * 101 + F.col("l_suppkey") * 7) % SPAN + 64).alias("ay"), (q % 29 - 14).alias("dx"), (q * 3 % 41 - 20).alias("dy"))
    a = a.distinct() if once else a
    key = ((F.col("ax") * 8192 + F.col("ay")) * 64 + F.col("dx") + 32) * 64 + F.col("dy") + 32
    return a.select(key.alias("id"), "ax", "ay", (F.col("ax") + F.col("dx")).alias("bx"), (F.col("ay") + F.col("dy")).alias("by"))


def spots(spark: SparkSession, sf_dir: str, span: int = SPAN) -> DataFrame:
    """(id, user_id, x, y) of the events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", ((F.col("event_id") * 7919 + F.col("user_id") * 37) % span + 64).alias("x"), ((F.col("event_id") * 104729 + F.col("user_id") * 53) % span + 64).alias("y"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, vx, vy, radius, priority): every event is an agent."""
    s = spots(spark, sf_dir, CROWD_SPAN)
    speed = [(F.col("id") % 5 - 2).cast("double").alias("vx"), (F.col("id") % 7 - 3).cast("double").alias("vy")]
    return s.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *speed, F.lit(0.5).alias("radius"), (F.col("id") % 3).cast("double").alias("priority"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x0, y0, x1, y1) on the points' lattice, one per customer."""
    c = table(spark, sf_dir, "customer")
    x, y = F.col("c_custkey") * 13 % 120, F.col("c_custkey") * 7 % 90
    return c.select(F.col("c_custkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + 1 + F.col("c_custkey") % 7).alias("x1"), (y + 1 + F.col("c_nationkey") % 5).alias("y1"))


def door_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(door, seq, ts, action): what happens to 16 doors."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "click", "toggle").when(F.col("event_type").isin("error", "purchase"), "close").otherwise("open")
    return e.select((F.col("user_id") % 16).alias("door"), F.col("event_id").alias("seq"), "ts", action.alias("action"))


SQL = {
    "g_cells": f"""
  SELECT c.col, c.row, c.row * {WIDTH} + c.col AS cell, s IS NULL OR s % 3 <> 0 AS walkable
  FROM (SELECT i % {WIDTH} AS col, i // {WIDTH} AS row FROM range({WIDTH * HEIGHT}) r(i)) c
  LEFT JOIN (SELECT o_custkey % {WIDTH} AS col, o_orderkey % {HEIGHT} AS row, sum(o_custkey + o_orderkey) AS s FROM orders GROUP BY 1, 2) h
    ON c.col = h.col AND c.row = h.row""",
    "g_tris": f"""
  SELECT cell * 2 AS tid, cell, row * {WIDTH + 1} + col AS va, row * {WIDTH + 1} + col + 1 AS vb, (row + 1) * {WIDTH + 1} + col + 1 AS vc,
         2 * col AS ax, 2 * row AS ay, 2 * col + 2 AS bx, 2 * row AS by_, 2 * col + 2 AS cx, 2 * row + 2 AS cy FROM g_cells WHERE walkable
  UNION ALL
  SELECT cell * 2 + 1, cell, row * {WIDTH + 1} + col, (row + 1) * {WIDTH + 1} + col + 1, (row + 1) * {WIDTH + 1} + col,
         2 * col, 2 * row, 2 * col + 2, 2 * row + 2, 2 * col, 2 * row + 2 FROM g_cells WHERE walkable""",
    "pts": f"""
  SELECT event_id AS id, user_id, ts, (user_id * 37 + event_id) % {2 * WIDTH} AS x, (event_id * 11) % {2 * HEIGHT} AS y FROM events""",
    "rings": """
  SELECT * FROM (
    SELECT o_custkey AS ring_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq,
           o_orderkey * 17 % 128 AS x, o_orderkey * 29 % 96 AS y, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n >= 3""",
    "ring_edges": """
  SELECT ring_id, seq, n, x AS ax, y AS ay,
         coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_
  FROM rings WINDOW w AS (PARTITION BY ring_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "segs": """
  SELECT ((ax * 256 + ay) * 256 + bx) * 256 + by_ AS id, ax, ay, bx, by_, CAST(ax % 3 AS INTEGER) AS mark FROM (
    SELECT DISTINCT l_partkey % 256 AS ax, l_suppkey * 7 % 256 AS ay, (l_partkey + CAST(l_quantity AS BIGINT)) % 256 AS bx,
                    (l_suppkey * 7 + CAST(l_quantity AS BIGINT) * 3) % 256 AS by_ FROM lineitem)""",
    "lines": f"""
  SELECT ((ax * 8192 + ay) * 64 + dx + 32) * 64 + dy + 32 AS id, ax, ay, ax + dx AS bx, ay + dy AS by_ FROM (
    SELECT DISTINCT (l_orderkey * 37 + l_partkey) % {SPAN} + 64 AS ax, (l_orderkey * 101 + l_suppkey * 7) % {SPAN} + 64 AS ay,
                    CAST(l_quantity AS BIGINT) % 29 - 14 AS dx, CAST(l_quantity AS BIGINT) * 3 % 41 - 20 AS dy FROM lineitem)""",
    "line_cells": """
  SELECT *, unnest(range(least(ay, by_) // 32, greatest(ay, by_) // 32 + 1)) AS gy FROM (SELECT *, unnest(range(least(ax, bx) // 32, greatest(ax, bx) // 32 + 1)) AS gx FROM lines)""",
    "line_pairs": """
  SELECT DISTINCT a.id AS i, b.id AS j, a.ax, a.ay, a.bx, a.by_, b.ax AS cx, b.ay AS cy, b.bx AS dx, b.by_ AS dy FROM line_cells a JOIN line_cells b ON a.gx = b.gx AND a.gy = b.gy AND a.id < b.id
    AND least(a.ax, a.bx) <= greatest(b.ax, b.bx) AND least(b.ax, b.bx) <= greatest(a.ax, a.bx) AND least(a.ay, a.by_) <= greatest(b.ay, b.by_) AND least(b.ay, b.by_) <= greatest(a.ay, a.by_)""",
    "spots": f"""
  SELECT event_id AS id, user_id, (event_id * 7919 + user_id * 37) % {SPAN} + 64 AS x, (event_id * 104729 + user_id * 53) % {SPAN} + 64 AS y FROM events""",
    "agents": f"""
  SELECT event_id AS id, ((event_id * 7919 + user_id * 37) % {CROWD_SPAN} + 64)::DOUBLE AS x, ((event_id * 104729 + user_id * 53) % {CROWD_SPAN} + 64)::DOUBLE AS y,
         (event_id % 5 - 2)::DOUBLE AS vx, (event_id % 7 - 3)::DOUBLE AS vy, (event_id % 3)::DOUBLE AS priority FROM events""",
    "agent_pairs": """
  SELECT a.id, b.id AS other FROM (SELECT id, floor(x / 4) AS gx, floor(y / 4) AS gy, u.dx, v.dy FROM agents CROSS JOIN (VALUES (-1), (0), (1)) u(dx) CROSS JOIN (VALUES (-1), (0), (1)) v(dy)) a
    JOIN (SELECT id, floor(x / 4) AS gx, floor(y / 4) AS gy FROM agents) b ON b.gx = a.gx + a.dx AND b.gy = a.gy + a.dy AND a.id <> b.id""",
    "boxes": """
  SELECT c_custkey AS id, c_custkey * 13 % 120 AS x0, c_custkey * 7 % 90 AS y0, c_custkey * 13 % 120 + 1 + c_custkey % 7 AS x1,
         c_custkey * 7 % 90 + 1 + c_nationkey % 5 AS y1 FROM customer""",
    "door_events": """
  SELECT user_id % 16 AS door, event_id AS seq, ts,
         CASE WHEN event_type = 'click' THEN 'toggle' WHEN event_type IN ('error', 'purchase') THEN 'close' ELSE 'open' END AS action FROM events""",
    "t_edges": """
  SELECT tid, e, a, b, least(a, b) AS lo, greatest(a, b) AS hi FROM (
    SELECT tid, 0 AS e, vb AS a, vc AS b FROM g_tris UNION ALL SELECT tid, 1, vc, va FROM g_tris UNION ALL SELECT tid, 2, va, vb FROM g_tris)""",
    "adj": """
  SELECT t.*, o.tid AS nbr FROM t_edges t LEFT JOIN t_edges o ON t.lo = o.lo AND t.hi = o.hi AND t.tid <> o.tid""",
    "cell_next": f"""
  SELECT a.cell AS c, b.cell AS n FROM g_cells a JOIN g_cells b ON a.row = b.row AND b.col = a.col + 1 WHERE a.walkable AND b.walkable
  UNION ALL SELECT b.cell, a.cell FROM g_cells a JOIN g_cells b ON a.row = b.row AND b.col = a.col + 1 WHERE a.walkable AND b.walkable
  UNION ALL SELECT a.cell, b.cell FROM g_cells a JOIN g_cells b ON a.col = b.col AND b.row = a.row + 1 WHERE a.walkable AND b.walkable
  UNION ALL SELECT b.cell, a.cell FROM g_cells a JOIN g_cells b ON a.col = b.col AND b.row = a.row + 1 WHERE a.walkable AND b.walkable""",
    "cell_reach": """
  SELECT cell AS c, cell AS r FROM g_cells WHERE walkable
  UNION
  SELECT x.n, q.r FROM cell_reach q JOIN cell_next x ON x.c = q.c WHERE x.n > q.r""",
    "borders": f"""
  SELECT c.col, c.row, d.dir, c.col + d.sx AS x0, c.row + d.sy AS y0, c.col + d.ex AS x1, c.row + d.ey AS y1
  FROM g_cells c CROSS JOIN (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)) d(dir, nx, ny, sx, sy, ex, ey)
  LEFT JOIN g_cells o ON o.col = c.col + d.nx AND o.row = c.row + d.ny WHERE c.walkable AND NOT coalesce(o.walkable, false)""",
}

#: What each view is made of.
NEEDS = {"line_cells": ["lines"], "line_pairs": ["line_cells"], "agent_pairs": ["agents"], "g_tris": ["g_cells"], "ring_edges": ["rings"], "t_edges": ["g_tris"], "adj": ["t_edges"], "cell_next": ["g_cells"], "cell_reach": ["cell_next"], "borders": ["g_cells"]}


def sql(views: str, body: str) -> str:
    """A statement with the named views (and what they need) as common table expressions."""
    listed: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in listed:
            listed.append(name)

    for v in views.split():
        add(v)
    head = "WITH RECURSIVE " if "cell_reach" in listed else "WITH "
    return head + ",\n".join(f"{v} AS ({SQL[v]})" for v in listed) + "\n" + body
