"""Queries over layers: boxes, filters, projections, extents, values and dates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import binary, codec, convert, types
from terrane.operators.container import ColumnSpec, GeometrySpec, TableSpec
from terrane.operators.layer import BoundingBox, Layer, fold_extent, spatial_join
from terrane.plans import inputs as i

BOX = BoundingBox(-120.0, -45.0, 60.0, 30.5)
BOX_SQL = "x >= -120 AND x <= 60 AND y >= -45 AND y <= 30.5"
QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def hexed(df: DataFrame) -> DataFrame:
    return df.withColumn("geom", F.hex("geom"))


@query("bbox_points", f"WITH {i.P_SQL} SELECT fid, c_name, c_acctbal, x, y FROM p WHERE {BOX_SQL}")
def bbox_points(spark: SparkSession, d: str) -> DataFrame:
    return i.stored_points(spark, d).features_in(BOX).with_columns("c_name", "c_acctbal", "x", "y").rows()


@query("bbox_points_decoded", f"WITH {i.P_SQL} SELECT fid, x AS minx, x AS maxx, y AS miny, y AS maxy FROM p WHERE {BOX_SQL}")
def bbox_points_decoded(spark: SparkSession, d: str) -> DataFrame:
    blobs = i.points(spark, d).select("fid", codec.encode_points(4326)(F.col("x"), F.col("y")).alias("geom"))
    e = binary.with_header_envelope(blobs, "geom").drop("geom")
    return e.where(BOX.overlaps(F.col("minx"), F.col("maxx"), F.col("miny"), F.col("maxy")))


@query("bbox_points_no_envelope", f"WITH {i.P_SQL} SELECT fid, c_name FROM p WHERE {BOX_SQL}")
def bbox_points_no_envelope(spark: SparkSession, d: str) -> DataFrame:
    df = i.points(spark, d).withColumn("geom", codec.encode_points(4326, with_envelope=False)(F.col("x"), F.col("y")))
    return Layer(df).features_in(BOX).with_columns("c_name").rows()


LINES = """l AS (SELECT l_orderkey AS fid, min(l_quantity) AS minx, max(l_quantity) AS maxx, CAST(min(l_linenumber) AS DOUBLE) AS miny, CAST(max(l_linenumber) AS DOUBLE) AS maxy FROM lineitem GROUP BY l_orderkey)"""


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line for each order, its vertices (quantity, line number)."""
    lines = i.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fid"), "l_quantity", F.col("l_linenumber").cast("double").alias("at"))
    runs = lines.repartition("fid").sortWithinPartitions("fid", "at", "l_quantity")
    drawn = runs.mapInArrow(codec.lines_of_runs(0), f"fid {lines.schema['fid'].dataType.simpleString()}, geom binary")
    return drawn.select("fid", binary.body(F.col("geom")).alias("geom"))


@query("bbox_lines", f"WITH {LINES} SELECT fid, minx, maxx, miny, maxy FROM l WHERE minx <= 8 AND maxx >= 3 AND miny <= 2 AND maxy >= 2")
def bbox_lines(spark: SparkSession, d: str) -> DataFrame:
    layer = i.stored(spark, d, "lines", TableSpec("lines", [], GeometrySpec("LINESTRING", 0)), lambda: order_lines(spark, d)).features_in(BoundingBox(3.0, 2.0, 8.0, 2.0))
    return layer.df.where(layer.predicate).select("fid", "minx", "maxx", "miny", "maxy")


@query("bbox_boundary_inclusive", f"WITH {i.P_SQL}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p WHERE fid % 97 < 5) SELECT fid, x, y FROM p, e WHERE x >= -179.5 AND x <= -150.3 AND y >= -89.3 AND y <= -27.9")
def bbox_boundary_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return i.stored_points(spark, d).features_in(BoundingBox(-179.5, -89.3, -150.3, -27.9)).with_columns("x", "y").rows()


def holes(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh geometry null, every eleventh empty."""
    x = F.when((F.col("fid") % 7 == 0) | (F.col("fid") % 11 == 0), F.lit(None)).otherwise(F.col("x"))
    y = F.when(F.col("fid") % 7 == 0, F.lit(None)).when(F.col("fid") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("y"))
    df = i.points(spark, d).withColumn("geom", codec.encode_points(4326)(x.cast("double"), y.cast("double")))
    return i.with_sidecar(df)


@query("bbox_excludes_null_empty", f"WITH {i.P_SQL} SELECT fid, c_name FROM p WHERE fid % 7 <> 0 AND fid % 11 <> 0 AND {BOX_SQL}")
def bbox_excludes_null_empty(spark: SparkSession, d: str) -> DataFrame:
    made = lambda: holes(spark, d).select("fid", "c_name", binary.body(F.col("geom")).alias("geom"))
    layer = i.stored(spark, d, "holes", TableSpec("holes", [ColumnSpec("c_name", "TEXT")], GeometrySpec("POINT", 4326)), made)
    return layer.features_in(BOX).with_columns("c_name").rows()


@query("geometry_is_empty", f"WITH {i.P_SQL} SELECT fid, CASE WHEN fid % 7 = 0 THEN NULL ELSE fid % 11 = 0 END AS is_empty FROM p")
def geometry_is_empty(spark: SparkSession, d: str) -> DataFrame:
    return holes(spark, d).select("fid", binary.header(F.col("geom"))["empty"].alias("is_empty"))


@query("select_where", f"WITH {i.P_SQL} SELECT fid, c_name, c_acctbal FROM p WHERE c_acctbal > 1000.5 AND c_mktsegment = 'BUILDING'")
def select_where(spark: SparkSession, d: str) -> DataFrame:
    return Layer(i.points(spark, d), geom=None).select("c_acctbal > :least AND c_mktsegment = :segment", least=1000.5, segment="BUILDING").with_columns("c_name", "c_acctbal").rows()


@query("bbox_and_where", f"WITH {i.P_SQL} SELECT fid, c_name FROM p WHERE {BOX_SQL} AND c_nationkey < 10")
def bbox_and_where(spark: SparkSession, d: str) -> DataFrame:
    return i.stored_points(spark, d).features_in(BOX).select("c_nationkey < :n", n=10).with_columns("c_name").rows()


@query("project_columns", f"WITH {i.P_SQL} SELECT fid, c_name, c_mktsegment FROM p")
def project_columns(spark: SparkSession, d: str) -> DataFrame:
    return Layer(i.points(spark, d), geom=None).with_columns("c_mktsegment", "c_name", "c_name").rows()


@query("project_without_geometry_bbox", f"WITH {i.P_SQL} SELECT fid, c_name, c_acctbal, c_mktsegment, c_nationkey, x, y FROM p WHERE {BOX_SQL}")
def project_without_geometry_bbox(spark: SparkSession, d: str) -> DataFrame:
    return i.stored_points(spark, d).features_in(BOX).without_geometry().rows()


@query("column_values", "SELECT c_acctbal FROM customer")
def column_values(spark: SparkSession, d: str) -> DataFrame:
    return Layer(i.points(spark, d), geom=None).column_values("c_acctbal")


@query("keyset_page", f"WITH {i.P_SQL} SELECT fid, c_name FROM p WHERE fid >= 500 ORDER BY fid LIMIT 64")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return Layer(i.points(spark, d), geom=None).with_columns("c_name").page(500, 64)


@query("layer_count", "SELECT count(*) AS n FROM customer")
def layer_count(spark: SparkSession, d: str) -> DataFrame:
    return Layer(i.points(spark, d), geom=None).count()


@query("extent_measure", f"WITH {i.P_SQL} SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM p WHERE fid % 7 <> 0 AND fid % 11 <> 0")
def extent_measure(spark: SparkSession, d: str) -> DataFrame:
    return Layer(holes(spark, d)).measured_extent()


@query("extent_recorded", "SELECT CAST(-10 AS DOUBLE) AS min_x, CAST(-5 AS DOUBLE) AS min_y, CAST(10 AS DOUBLE) AS max_x, CAST(5 AS DOUBLE) AS max_y")
def extent_recorded(spark: SparkSession, d: str) -> DataFrame:
    recorded = i.texts(spark, [(-10.0, -5.0, 10.0, 5.0)], "min_x double, min_y double, max_x double, max_y double")
    return Layer(holes(spark, d)).extent(recorded)


@query("extent_fold", f"""WITH {i.P_SQL}, b AS (SELECT c_nationkey, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p GROUP BY c_nationkey)
SELECT n_nationkey AS c_nationkey, least(x0, CAST(n_nationkey AS DOUBLE) - 20) AS min_x, least(y0, CAST(-3 AS DOUBLE)) AS min_y, greatest(x1, CAST(n_nationkey AS DOUBLE)) AS max_x, greatest(y1, CAST(3 AS DOUBLE)) AS max_y
FROM nation LEFT JOIN b ON b.c_nationkey = n_nationkey""")
def extent_fold(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    old = i.table(spark, d, "nation").select(k.alias("c_nationkey"), (k.cast("double") - 20.0).alias("min_x"), F.lit(-3.0).alias("min_y"), k.cast("double").alias("max_x"), F.lit(3.0).alias("max_y"))
    return fold_extent(old, i.point_layer(spark, d), ["c_nationkey"])


@query("bool_lenient", "SELECT l_orderkey, l_linenumber, l_linenumber % 3 <> 0 AS flag FROM lineitem")
def bool_lenient(spark: SparkSession, d: str) -> DataFrame:
    return i.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", convert.boolean(F.col("l_linenumber") % 3).alias("flag"))


@query("bool_strict_errors", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 IN (0, 1) THEN l_linenumber % 3 = 1 END AS flag, l_linenumber % 3 NOT IN (0, 1) AS is_error FROM lineitem")
def bool_strict_errors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("l_linenumber") % 3
    flag = convert.boolean_strict(v)
    return i.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("flag"), flag.isNull().alias("is_error"))


TYPE_NAMES = ["INTEGER", "bigint unsigned", "VARCHAR(20)", "charint", "CLOB", "nvarchar", "BLOB", "", "DECIMAL(10,5)", "FLOATING POINT", "tinyblob", "REAL", "datetime", "TEXT", " text ", "text(30)", "Blob ( 7 )", "boolean", "MEDIUMINT", "date", "polygon", "CURVE", "POINTZ", "SMALLINT(3)"]


@query("affinity", f"""WITH {i.sql_values([(x,) for x in TYPE_NAMES], "t", "declared")}
SELECT declared, CASE WHEN upper(declared) LIKE '%INT%' THEN 'integer' WHEN upper(declared) LIKE '%CHAR%' OR upper(declared) LIKE '%CLOB%' OR upper(declared) LIKE '%TEXT%' THEN 'text' WHEN upper(declared) LIKE '%BLOB%' OR trim(declared) = '' THEN 'blob' ELSE 'real' END AS affinity FROM t""")
def affinity(spark: SparkSession, d: str) -> DataFrame:
    return i.texts(spark, [(x,) for x in TYPE_NAMES], "declared string").withColumn("affinity", types.affinity(F.col("declared")))


PARSED = {"INTEGER": "INTEGER", "BLOB": "BLOB", "REAL": "REAL", "datetime": "DATETIME", "TEXT": "TEXT", " text ": "TEXT", "text(30)": "TEXT(30)", "Blob ( 7 )": "BLOB(7)", "boolean": "BOOLEAN", "MEDIUMINT": "MEDIUMINT", "date": "DATE", "polygon": "POLYGON", "CURVE": "CURVE"}


@query("column_type_parse", "WITH " + i.sql_values([(x, PARSED.get(x)) for x in TYPE_NAMES], "t", "declared, parsed") + " SELECT declared, parsed FROM t")
def column_type_parse(spark: SparkSession, d: str) -> DataFrame:
    return i.texts(spark, [(x,) for x in TYPE_NAMES], "declared string").withColumn("parsed", types.column_type(F.col("declared")))


@query("storage_check", """WITH s(declared) AS (VALUES ('BOOLEAN'), ('INTEGER'), ('REAL'), ('TEXT'), ('BLOB'), ('DATE')), c(storage) AS (VALUES ('null'), ('integer'), ('real'), ('text'), ('blob'))
SELECT declared, storage, storage = 'null' OR (declared IN ('BOOLEAN', 'INTEGER') AND storage = 'integer') OR (declared = 'REAL' AND storage IN ('real', 'integer')) OR (declared IN ('TEXT', 'DATE') AND storage = 'text') OR (declared = 'BLOB' AND storage = 'blob') AS lenient_ok,
storage = 'null' OR (declared IN ('BOOLEAN', 'INTEGER') AND storage = 'integer') OR (declared = 'REAL' AND storage = 'real') OR (declared IN ('TEXT', 'DATE') AND storage = 'text') OR (declared = 'BLOB' AND storage = 'blob') AS strict_ok FROM s, c""")
def storage_check(spark: SparkSession, d: str) -> DataFrame:
    declared, storage = ["BOOLEAN", "INTEGER", "REAL", "TEXT", "BLOB", "DATE"], ["null", "integer", "real", "text", "blob"]
    df = i.texts(spark, [(a, b) for a in declared for b in storage], "declared string, storage string")
    ok = lambda strict: convert.storage_error(F.col("declared"), F.col("storage"), strict).isNull()
    return df.withColumn("lenient_ok", ok(False)).withColumn("strict_ok", ok(True))


DATE_SQL = "CASE o_orderkey % 5 WHEN 0 THEN '2026-7-4' WHEN 1 THEN '2023-02-29' ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query("date_parse", f"""WITH t AS (SELECT o_orderkey, {DATE_SQL} AS s FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN CAST(date_diff('day', DATE '1970-01-01', try_cast(s AS DATE)) AS INTEGER) END AS days,
CASE WHEN NOT regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'malformed' WHEN try_cast(s AS DATE) IS NULL THEN 'out of range' END AS error FROM t""")
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    s = F.when(k == 0, "2026-7-4").when(k == 1, "2023-02-29").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return i.table(spark, d, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", convert.date_days(F.col("s")).alias("days"), convert.date_error(F.col("s")).alias("error"))


STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


@query("datetime_strict", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) // 1000 * 1000 END AS micros FROM events")
def datetime_strict(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", STAMP))
    return i.table(spark, d, "events").select("event_id", convert.datetime_micros(s, lenient=False).alias("micros"))


@query("datetime_lenient", "SELECT event_id, CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) - CASE event_id % 5 WHEN 1 THEN 7200000000 WHEN 2 THEN -19800000000 WHEN 3 THEN 7200000000 ELSE 0 END AS micros, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 120 WHEN 2 THEN -330 WHEN 3 THEN 120 ELSE 0 END AS offset_minutes FROM events")
def datetime_lenient(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    s = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(k == 0, "").when(k == 1, "+02:00").when(k == 2, "-0530").when(k == 3, "+02").otherwise("Z"))
    return i.table(spark, d, "events").select("event_id", s.alias("s")).select("event_id", convert.datetime_micros(F.col("s")).alias("micros"), convert.offset_minutes(F.col("s")).alias("offset_minutes"))


@query("datetime_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || CASE WHEN epoch_us(ts) % 1000 = 0 THEN lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') ELSE lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') || '000' END || 'Z' AS s FROM events")
def datetime_format(spark: SparkSession, d: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return i.table(spark, d, "events").select("event_id", convert.format_micros(micros).alias("s"))


@query("epoch_days", "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders")
def epoch_days(spark: SparkSession, d: str) -> DataFrame:
    days = convert.date_days(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return i.table(spark, d, "orders").select("o_orderkey", days.alias("days")).withColumn("s", convert.date_from_days(F.col("days")).cast("string"))


@query("embedding_lines_bbox", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
b AS (SELECT vec_id AS fid, list_min(list_filter(v, lambda a, i: (i - 1) % 2 = 0)) AS minx, list_max(list_filter(v, lambda a, i: (i - 1) % 2 = 0)) AS maxx, list_min(list_filter(v, lambda a, i: (i - 1) % 2 = 1)) AS miny, list_max(list_filter(v, lambda a, i: (i - 1) % 2 = 1)) AS maxy FROM e)
SELECT fid, minx, maxx, miny, maxy FROM b WHERE minx <= 1.5 AND maxx >= 0.2 AND miny <= 0.5 AND maxy >= -0.1""")
def embedding_lines_bbox(spark: SparkSession, d: str) -> DataFrame:
    flat = F.transform("embedding", lambda v: v.cast("double"))
    blobs = i.table(spark, d, "embeddings").select(F.col("vec_id").alias("fid"), codec.encode_lines(0)(flat).alias("geom"))
    layer = Layer(i.with_sidecar(blobs)).features_in(BoundingBox(0.2, -0.1, 1.5, 0.5))
    return layer.df.where(layer.predicate).select("fid", "minx", "maxx", "miny", "maxy")


@query("bbox_spatial_join", f"""WITH {i.P_SQL}, {i.PS_SQL} SELECT ps.fid AS box_id, p.fid FROM ps JOIN p ON p.x >= ps.x - 6 AND p.x <= ps.x + 6 AND p.y >= ps.y - 4 AND p.y <= ps.y + 4""")
def bbox_spatial_join(spark: SparkSession, d: str) -> DataFrame:
    boxes = i.supplier_points(spark, d).select(F.col("fid").alias("box_id"), (F.col("x") - 6).alias("minx"), (F.col("x") + 6).alias("maxx"), (F.col("y") - 4).alias("miny"), (F.col("y") + 4).alias("maxy"))
    features = i.points(spark, d).select("fid", F.col("x").alias("minx"), F.col("x").alias("maxx"), F.col("y").alias("miny"), F.col("y").alias("maxy"))
    return spatial_join(features, boxes, cell=10.0)


@query("header_fields", f"WITH {i.P_SQL} SELECT fid, 4326 AS srs_id, 1 AS indicator, false AS empty, true AS little, 40 AS body_offset, 1 AS type_code FROM p")
def header_fields(spark: SparkSession, d: str) -> DataFrame:
    blob = codec.encode_points(4326)(F.col("x"), F.col("y"))
    df = i.points(spark, d).select("fid", blob.alias("geom"))
    h = binary.header(F.col("geom"))
    return df.select("fid", *[h[c].alias(c) for c in ("srs_id", "indicator", "empty", "little", "body_offset")], binary.wkb_code(binary.body(F.col("geom"))).alias("type_code"))


ARCS = [
    (1, 5.0, 0.0, 0.0, 5.0, -5.0, 0.0, -5.0, 5.0, 0.0, 5.0),
    (2, 4.0, 3.0, 3.0, 4.0, -3.0, 4.0, -3.0, 4.0, 3.0, 5.0),
    (3, 0.0, 0.0, 2.0, 2.0, 4.0, 4.0, 0.0, 4.0, 0.0, 4.0),
    (4, 10.0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 10.0, -5.0, 5.0),
    (5, -5.0, 0.0, 0.0, -5.0, 5.0, 0.0, -5.0, 5.0, -5.0, 0.0),
    (6, 3.0, 4.0, -5.0, 0.0, 3.0, -4.0, -5.0, 3.0, -5.0, 5.0),
]


@query("arc_envelope", "WITH " + i.sql_values([(a[0], *a[7:]) for a in ARCS], "t", "arc_id, minx, maxx, miny, maxy") + " SELECT * FROM t")
def arc_envelope(spark: SparkSession, d: str) -> DataFrame:
    import struct

    bodies = [(a[0], (struct.pack("<BII", 1, codec.CIRCULAR, 3) + struct.pack("<6d", *a[1:7])).hex()) for a in ARCS]
    df = i.texts(spark, bodies, "arc_id int, body string")
    enc = codec.encode_wkb(0)(F.unhex("body"))
    return df.select("arc_id", enc.alias("e")).select("arc_id", "e.minx", "e.maxx", "e.miny", "e.maxy")


@query("geometry_type_match", "SELECT CAST(a.range AS INTEGER) AS declared, CAST(b.range AS INTEGER) AS code, a.range = b.range OR a.range = 0 OR (a.range = 7 AND b.range IN (4, 5, 6, 7, 11, 12)) AS ok FROM range(15) a, range(15) b")
def geometry_type_match(spark: SparkSession, d: str) -> DataFrame:
    df = spark.range(225).select((F.col("id") / 15).cast("int").alias("declared"), (F.col("id") % 15).cast("int").alias("code"))
    return df.withColumn("ok", types.type_matches(F.col("declared"), F.col("code")))


@query("zm_check", "SELECT CAST(1000 * b.range + 1 AS INTEGER) AS code, CAST(a.range // 3 AS INTEGER) AS z, CAST(a.range % 3 AS INTEGER) AS m, (CASE a.range // 3 WHEN 0 THEN b.range NOT IN (1, 3) WHEN 1 THEN b.range IN (1, 3) ELSE true END) AND (CASE a.range % 3 WHEN 0 THEN b.range NOT IN (2, 3) WHEN 1 THEN b.range IN (2, 3) ELSE true END) AS ok FROM range(9) a, range(4) b")
def zm_check(spark: SparkSession, d: str) -> DataFrame:
    df = spark.range(36).select((F.col("id") % 4 * 1000 + 1).cast("int").alias("code"), (F.col("id") / 12).cast("int").alias("z"), ((F.col("id") / 4).cast("int") % 3).alias("m"))
    dims = binary.dimensions(F.col("code"))
    return df.withColumn("ok", types.zm_allowed(F.col("z"), dims.isin(1, 3)) & types.zm_allowed(F.col("m"), dims.isin(2, 3)))
