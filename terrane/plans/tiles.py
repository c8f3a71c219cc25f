"""Queries over tile pyramids, matrices and index order, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import binary, grid, ordering
from terrane.operators import index, pyramid
from terrane.operators.layer import BoundingBox, Layer
from terrane.plans import inputs as i

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


WORLD = grid.WORLD
#: The ladder over the world, two tiles wide at zoom 0, and tile addresses of order points, in SQL.
M_SQL = "m AS (SELECT CAST(range AS BIGINT) AS zoom_level, CAST(2 * (1 << range) AS BIGINT) AS matrix_width, CAST(1 << range AS BIGINT) AS matrix_height, CAST(360 AS DOUBLE) / (CAST(2 * (1 << range) AS DOUBLE) * 256) AS pixel_x_size, CAST(180 AS DOUBLE) / (CAST(1 << range AS DOUBLE) * 256) AS pixel_y_size FROM range({a}, {b}))"
AT_SQL = "CAST(greatest(0, least(floor((x + 180) / (pixel_x_size * 256)), matrix_width - 1)) AS BIGINT) AS tile_column, CAST(greatest(0, least(floor((90 - y) / (pixel_y_size * 256)), matrix_height - 1)) AS BIGINT) AS tile_row"


def ladder(spark: SparkSession, low: int, high: int) -> DataFrame:
    return grid.ladder(spark, WORLD, low, high, base=(2 << low, 1 << low))


def edge_points(spark: SparkSession, d: str) -> DataFrame:
    """Order points and positions on the extent's edges."""
    edges = i.texts(spark, [(-1, 180.0, 90.0), (-2, -180.0, -90.0), (-3, 180.0, -90.0), (-4, 180.5, 0.0), (-5, 0.0, 0.0)], "fid long, x double, y double")
    return i.order_points(spark, d).unionByName(edges)


EDGES = i.sql_values([(-1, 180.0, 90.0), (-2, -180.0, -90.0), (-3, 180.0, -90.0), (-4, 180.5, 0.0), (-5, 0.0, 0.0)], "e", "fid, x, y")


@query("tile_at", f"WITH {i.PO_SQL}, {EDGES}, {M_SQL.format(a=6, b=7)}, q AS (SELECT * FROM po UNION ALL SELECT * FROM e) SELECT fid, zoom_level, CASE WHEN x <= 180 THEN tile_column END AS tile_column, CASE WHEN x <= 180 THEN tile_row END AS tile_row FROM (SELECT *, {AT_SQL} FROM q, m)")
def tile_at(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.tiles_of(edge_points(spark, d), WORLD, ladder(spark, 6, 6)).select("fid", "zoom_level", "tile_column", "tile_row")


@query("tile_bounds", f"WITH {M_SQL.format(a=5, b=6)}, a AS (SELECT o_orderkey, o_orderkey % 70 - 3 AS c, o_orderkey % 37 - 2 AS r FROM orders) SELECT o_orderkey, -180 + CAST(c AS DOUBLE) * (pixel_x_size * 256) AS min_x, 90 - CAST(r AS DOUBLE) * (pixel_y_size * 256) - pixel_y_size * 256 AS min_y, -180 + CAST(c AS DOUBLE) * (pixel_x_size * 256) + pixel_x_size * 256 AS max_x, 90 - CAST(r AS DOUBLE) * (pixel_y_size * 256) AS max_y FROM a, m")
def tile_bounds(spark: SparkSession, d: str) -> DataFrame:
    a = i.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 70 - 3).alias("c"), (F.col("o_orderkey") % 37 - 2).alias("r"))
    both = a.join(F.broadcast(ladder(spark, 5, 5)))
    box = grid.tile_bounds(WORLD, grid.span(F.col("pixel_x_size"), F.col("tile_width")), grid.span(F.col("pixel_y_size"), F.col("tile_height")), F.col("c"), F.col("r"))
    return both.select("o_orderkey", box.alias("b")).select("o_orderkey", "b.*")


BOXES = "b AS (SELECT fid, x - 20 AS x0, x + CAST(fid % 5 AS DOUBLE) * 10 - 15 AS x1, y - 95 + CAST(fid % 40 AS DOUBLE) AS y0, y + 3 AS y1 FROM ps)"


@query("tile_range", f"""WITH {i.PS_SQL}, {BOXES}, {M_SQL.format(a=4, b=5)}
SELECT fid, ok, CASE WHEN ok THEN CAST(greatest(0, least(floor((greatest(x0, -180) + 180) / (pixel_x_size * 256)), matrix_width - 1)) AS BIGINT) END AS min_column, CASE WHEN ok THEN CAST(greatest(0, least(floor((least(x1, 180) + 180) / (pixel_x_size * 256)), matrix_width - 1)) AS BIGINT) END AS max_column,
CASE WHEN ok THEN CAST(greatest(0, least(floor((90 - least(y1, 90)) / (pixel_y_size * 256)), matrix_height - 1)) AS BIGINT) END AS min_row, CASE WHEN ok THEN CAST(greatest(0, least(floor((90 - greatest(y0, -90)) / (pixel_y_size * 256)), matrix_height - 1)) AS BIGINT) END AS max_row
FROM (SELECT *, x0 <= x1 AND y0 <= y1 AND x1 >= -180 AND x0 <= 180 AND y1 >= -90 AND y0 <= 90 AS ok FROM b, m)""")
def tile_range(spark: SparkSession, d: str) -> DataFrame:
    fid, x, y = F.col("fid"), F.col("x"), F.col("y")
    b = i.supplier_points(spark, d).select("fid", (x - 20).alias("x0"), (x + (fid % 5).cast("double") * 10 - 15).alias("x1"), (y - 95 + (fid % 40).cast("double")).alias("y0"), (y + 3).alias("y1"))
    both = b.join(F.broadcast(ladder(spark, 4, 4)))
    r = grid.tile_range(WORLD, grid.span(F.col("pixel_x_size"), F.col("tile_width")), grid.span(F.col("pixel_y_size"), F.col("tile_height")), F.col("matrix_width"), F.col("matrix_height"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return both.select("fid", r.alias("r")).select("fid", F.col("r").isNotNull().alias("ok"), "r.*")


@query("tile_ladder", f"WITH {M_SQL.format(a=0, b=21)} SELECT zoom_level, matrix_width, matrix_height, CAST(256 AS BIGINT) AS tile_width, CAST(256 AS BIGINT) AS tile_height, pixel_x_size, pixel_y_size FROM m")
def tile_ladder(spark: SparkSession, d: str) -> DataFrame:
    return ladder(spark, 0, 20)


def world(spark: SparkSession, d: str, high: int = 6) -> pyramid.Pyramid:
    """The pyramid whose tiles hold an order point at zooms 0 to `high`; tile_data counts the points."""
    matrices = ladder(spark, 0, high)
    at = pyramid.tiles_of(i.order_points(spark, d), WORLD, matrices)
    tiles = at.groupBy(*pyramid.ADDRESS).agg(F.count(F.lit(1)).cast("string").alias("tile_data"))
    return pyramid.Pyramid(WORLD, matrices, tiles)


T_SQL = f"{i.PO_SQL}, {M_SQL.format(a=0, b=7)}, t AS (SELECT zoom_level, tile_column, tile_row, CAST(count(*) AS VARCHAR) AS tile_data FROM (SELECT *, {AT_SQL} FROM po, m) GROUP BY 1, 2, 3)"


@query("tile_count_by_zoom", f"WITH {T_SQL} SELECT zoom_level, count(*) AS n FROM t GROUP BY 1")
def tile_count_by_zoom(spark: SparkSession, d: str) -> DataFrame:
    return world(spark, d).counts()


@query("tile_cursor", f"WITH {T_SQL} SELECT * FROM t")
def tile_cursor(spark: SparkSession, d: str) -> DataFrame:
    return world(spark, d).cursor()


@query("tile_scan_zoom", f"WITH {T_SQL} SELECT * FROM t WHERE zoom_level = 3")
def tile_scan_zoom(spark: SparkSession, d: str) -> DataFrame:
    return world(spark, d).cursor_at(3)


@query("tile_scan_box", f"WITH {T_SQL} SELECT * FROM t WHERE zoom_level = 5 AND tile_column BETWEEN 16 AND 38 AND tile_row BETWEEN 7 AND 19")
def tile_scan_box(spark: SparkSession, d: str) -> DataFrame:
    return world(spark, d).cursor_in(5, BoundingBox(-90.0, -22.0, 37.5, 45.1))


@query("tile_point_lookup", f"WITH {T_SQL}, a AS (SELECT 6 AS zoom_level, s_suppkey % 128 AS tile_column, (s_suppkey * 3) % 64 AS tile_row FROM supplier) SELECT CAST(a.zoom_level AS BIGINT) AS zoom_level, CAST(a.tile_column AS BIGINT) AS tile_column, CAST(a.tile_row AS BIGINT) AS tile_row, t.tile_data FROM a LEFT JOIN t USING (zoom_level, tile_column, tile_row)")
def tile_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    addresses = i.table(spark, d, "supplier").select(F.lit(6).cast("long").alias("zoom_level"), (k % 128).alias("tile_column"), ((k * 3) % 64).alias("tile_row"))
    return world(spark, d).lookup(addresses)


@query("tile_put_delete", f"""WITH {T_SQL}, new AS (SELECT 3 AS zoom_level, CAST(s_suppkey % 16 AS BIGINT) AS tile_column, CAST(s_suppkey % 8 AS BIGINT) AS tile_row, s_name AS tile_data, row_number() OVER (PARTITION BY s_suppkey % 16, s_suppkey % 8 ORDER BY s_suppkey DESC) AS n FROM supplier),
up AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.zoom_level = t.zoom_level AND new.tile_column = t.tile_column AND new.tile_row = t.tile_row) UNION ALL SELECT CAST(zoom_level AS BIGINT), tile_column, tile_row, tile_data FROM new WHERE n = 1)
SELECT * FROM up WHERE zoom_level <> 2""")
def tile_put_delete(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    new = i.table(spark, d, "supplier").select(F.lit(3).cast("long").alias("zoom_level"), (k % 16).alias("tile_column"), (k % 8).alias("tile_row"), F.col("s_name").alias("tile_data"), k.alias("at"))
    changed = world(spark, d).put(new, order=F.col("at"))
    return changed.delete(changed.tiles.where("zoom_level = 2").select(*pyramid.ADDRESS)).tiles


@query("tms_flip", f"WITH {T_SQL} SELECT zoom_level, tile_column, tile_row, (1 << zoom_level) - 1 - tile_row AS tms_row FROM t")
def tms_flip(spark: SparkSession, d: str) -> DataFrame:
    p = world(spark, d)
    both = p.tiles.join(F.broadcast(p.matrices.select("zoom_level", "matrix_height")), "zoom_level")
    return both.select(*pyramid.ADDRESS, grid.flip_row(F.col("matrix_height"), F.col("tile_row")).alias("tms_row"))


@query("xyz_check", "WITH a AS (SELECT o_orderkey, o_orderkey % 6 AS z, o_orderkey % 40 AS x, o_orderkey % 23 AS y FROM orders) SELECT o_orderkey, CASE WHEN x < (1 << z) AND y < (1 << z) THEN x END AS quad_column, CASE WHEN x < (1 << z) AND y < (1 << z) THEN y END AS quad_row, CAST(NULL AS BIGINT) AS world_column FROM a")
def xyz_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    a = i.table(spark, d, "orders").select("o_orderkey", (k % 6).alias("z"), (k % 40).alias("x"), (k % 23).alias("y"))
    side = F.expr("shiftleft(1L, cast(z as int))")
    quad = grid.xyz_tile(grid.WEB_MERCATOR, F.col("z"), side, side, F.col("z"), F.col("x"), F.col("y"))
    other = grid.xyz_tile(WORLD, F.col("z"), side, side, F.col("z"), F.col("x"), F.col("y"))
    return a.select("o_orderkey", quad["tile_column"].alias("quad_column"), quad["tile_row"].alias("quad_row"), other["tile_column"].alias("world_column"))


FAULTY = [
    ("good", 0, 1, 256, 1.0, None), ("good", 1, 2, 256, 0.5, None), ("good", 2, 4, 256, 0.25, None),
    ("zoom", -1, 1, 256, 1.0, "negative zoom"), ("width", 0, 0, 256, 1.0, "matrix_width not positive"), ("tile", 0, 1, 0, 1.0, "tile_width not positive"),
    ("pixel", 0, 1, 256, 0.0, "pixel_x_size not positive"), ("span", 0, 1, 256, 0.9, "x span differs"), ("twice", 3, 1, 256, 1.0, None), ("twice", 3, 1, 256, 1.0, "duplicate zoom"),
    ("flat", 0, 1, 256, 1.0, None), ("flat", 1, 1, 256, 1.0, "pixel_x_size not descending"), ("other", 0, 1, 256, 1.0, None), ("other", 1, 4, 256, 0.25, None),
]


def faulty(spark: SparkSession) -> DataFrame:
    df = i.texts(spark, [r[:5] for r in FAULTY], "table_name string, zoom_level long, matrix_width long, tile_width long, pixel_x_size double")
    return df.withColumn("matrix_height", F.col("matrix_width")).withColumn("tile_height", F.col("tile_width")).withColumn("pixel_y_size", F.col("pixel_x_size"))


@query("matrix_faults", "WITH " + i.sql_values([(r[0], r[1], r[5]) for r in FAULTY], "t", "table_name, zoom_level, fault") + " SELECT table_name, CAST(zoom_level AS BIGINT) AS zoom_level, fault FROM t")
def matrix_faults(spark: SparkSession, d: str) -> DataFrame:
    return grid.matrix_faults(faulty(spark), grid.Extent(0.0, 0.0, 256.0, 256.0), "table_name").select("table_name", "zoom_level", "fault")


@query("ladder_validate", "WITH " + i.sql_values([r[:5] for r in FAULTY], "t", "table_name, zoom_level, w, t, pixel") + " SELECT table_name, coalesce(bool_and(prev IS NULL OR abs(prev / 2 - pixel) <= 1e-9 * greatest(abs(prev / 2), abs(pixel))), true) AS is_ladder FROM (SELECT *, lag(pixel) OVER (PARTITION BY table_name ORDER BY zoom_level) AS prev FROM t) GROUP BY table_name")
def ladder_validate(spark: SparkSession, d: str) -> DataFrame:
    return grid.is_power_of_two(faulty(spark), "table_name")


@query("png_probe", "SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS BIGINT) END AS width, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size * 2 AS BIGINT) END AS height, CASE WHEN p_partkey % 9 <> 0 THEN p_size = 10 END AS fits FROM part")
def png_probe(spark: SparkSession, d: str) -> DataFrame:
    word = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))
    magic = F.when(F.col("p_partkey") % 9 == 0, "FFD8FFE0000D0A1A").otherwise("89504E470D0A1A0A")
    payload = F.concat(F.unhex(magic), F.unhex(F.lit("0000000D49484452")), word(F.col("p_size")), word(F.col("p_size") * 2), F.unhex(F.lit("0806000000")))
    df = i.table(spark, d, "part").select("p_partkey", payload.alias("payload"))
    size = binary.png_size(F.col("payload"))
    return df.select("p_partkey", size["width"].alias("width"), size["height"].alias("height"), grid.payload_fits(size, F.lit(10), F.lit(20)).alias("fits"))


HILBERT_SQL = """h(fid, hx, hy, d, s) AS (
  SELECT fid, hx, hy, CAST(0 AS BIGINT), CAST(32768 AS BIGINT) FROM g
  UNION ALL
  SELECT fid, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN s - 1 - (hy & (s - 1)) ELSE hy & (s - 1) END ELSE hx & (s - 1) END,
         CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN s - 1 - (hx & (s - 1)) ELSE hx & (s - 1) END ELSE hy & (s - 1) END,
         d + s * s * xor(3 * rx, ry), s // 2
  FROM (SELECT *, CAST((hx & s) > 0 AS BIGINT) AS rx, CAST((hy & s) > 0 AS BIGINT) AS ry FROM h WHERE s > 0))"""


@query("hilbert_key", f"""WITH RECURSIVE {i.P_SQL}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
g AS (SELECT fid, CAST(floor(greatest(0, least(1, (x - x0) / (x1 - x0))) * 65535) AS BIGINT) AS hx, CAST(floor(greatest(0, least(1, (y - y0) / (y1 - y0))) * 65535) AS BIGINT) AS hy FROM p, e), {HILBERT_SQL}
SELECT fid, d AS hilbert FROM h WHERE s = 0""")
def hilbert_key(spark: SparkSession, d: str) -> DataFrame:
    return ordering.with_hilbert(i.point_layer(spark, d)).select("fid", "hilbert")


@query("packed_levels", """WITH RECURSIVE c AS (SELECT CAST(range AS BIGINT) AS entries FROM range(0, 5000, 7)), l(entries, level, nodes) AS (
  SELECT entries, 0, greatest(1, (entries + 50) // 51) FROM c UNION ALL SELECT entries, level + 1, (nodes + 50) // 51 FROM l WHERE nodes > 1)
SELECT entries, CAST(level AS INTEGER) AS level, nodes FROM l""")
def packed_levels(spark: SparkSession, d: str) -> DataFrame:
    sizes = ordering.level_sizes(F.col("entries"), 51, levels=8)
    return spark.range(0, 5000, 7).select(F.col("id").alias("entries")).select("entries", F.posexplode(sizes).alias("level", "nodes"))


@query("packed_leaves", f"""WITH RECURSIVE {i.P_SQL}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
g AS (SELECT fid, CAST(floor(greatest(0, least(1, (x - x0) / (x1 - x0))) * 65535) AS BIGINT) AS hx, CAST(floor(greatest(0, least(1, (y - y0) / (y1 - y0))) * 65535) AS BIGINT) AS hy FROM p, e), {HILBERT_SQL}
SELECT fid AS id, CAST((row_number() OVER (ORDER BY d, fid) - 1) // 51 AS BIGINT) AS leaf FROM h WHERE s = 0""")
def packed_leaves(spark: SparkSession, d: str) -> DataFrame:
    return index.packed(index.build(i.point_layer(spark, d)), 51).select("id", F.col("leaf").cast("long").alias("leaf"))


@query("segment_runs", """WITH k AS (SELECT o_orderkey + 100 * (o_orderkey // 500) + 20 * (o_orderkey // 7) AS id FROM orders), g AS (SELECT id, CASE WHEN id - lag(id) OVER (ORDER BY id) <= 64 THEN 0 ELSE 1 END AS n FROM k), r AS (SELECT id, sum(n) OVER (ORDER BY id) AS run FROM g)
SELECT min(id) AS lo, max(id) AS hi, count(*) AS n FROM r GROUP BY run""")
def segment_runs(spark: SparkSession, d: str) -> DataFrame:
    """All orders, spread so that gaps open: small ones, which a run bridges, and large ones, which end it."""
    spread = F.expr("o_orderkey + 100 * (o_orderkey div 500) + 20 * (o_orderkey div 7)")
    return ordering.key_runs(i.table(spark, d, "orders").select(spread.alias("id")), "id")


@query("dense_span", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n, max(o_orderkey) - min(o_orderkey) + 1 = count(*) AS is_dense FROM orders")
def dense_span(spark: SparkSession, d: str) -> DataFrame:
    return Layer(i.order_points(spark, d), geom=None).dense_span()


@query("index_audit", """WITH p AS (SELECT c_custkey AS fid FROM customer)
SELECT (SELECT count(*) FROM p) AS indexable, (SELECT count(*) FROM p WHERE fid % 13 <> 0) + 5 AS entries, (SELECT count(*) FROM p WHERE fid % 13 = 0) AS missing, CAST(5 AS BIGINT) AS extra, (SELECT count(*) FROM p WHERE fid % 17 = 0 AND fid % 13 <> 0) AS not_covering""")
def index_audit(spark: SparkSession, d: str) -> DataFrame:
    layer = i.point_layer(spark, d)
    short = F.when(F.col("id") % 17 == 0, F.col("minx") + 1).otherwise(F.col("minx")).cast("float")
    kept = index.build(layer).drop("hilbert").where("id % 13 <> 0").withColumn("minx", short)
    ghosts = spark.range(10_000_000, 10_000_005).select("id", *[F.lit(0.0).cast("float").alias(c) for c in ("minx", "maxx", "miny", "maxy")])
    return index.audit(layer, kept.unionByName(ghosts))


@query("index_maintain", "SELECT count(*) AS indexable, count(*) AS entries, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS not_covering, true AS is_consistent FROM customer WHERE c_custkey % 10 <> 4")
def index_maintain(spark: SparkSession, d: str) -> DataFrame:
    layer = i.point_layer(spark, d)
    moved = layer.where("fid % 10 = 3").withColumns({c: F.col(c) + 0.25 for c in ("minx", "maxx", "miny", "maxy")})
    gone = layer.where("fid % 10 = 4")
    after = layer.where("fid % 10 NOT IN (3, 4)").unionByName(moved)
    return index.is_consistent(index.audit(after, index.maintain(index.build(layer), moved, gone)))


@query("f32_round_out", f"WITH {i.P_SQL} SELECT fid, CAST(x / 3 AS FLOAT) AS nearest, true AS covers FROM p")
def f32_round_out(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("x") / 3
    df = i.points(spark, d).select("fid", v.alias("v"))
    down, up = ordering.round_down(F.col("v")), ordering.round_up(F.col("v"))
    tight = (up.cast("double") - down.cast("double")) <= F.abs(F.col("v")) * 3e-7
    return df.select("fid", F.col("v").cast("float").alias("nearest"), ((down.cast("double") <= F.col("v")) & (up.cast("double") >= F.col("v")) & tight).alias("covers"))
