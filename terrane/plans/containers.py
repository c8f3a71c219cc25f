"""Queries that go through containers: writes, catalogues, constraints, index and file, with their SQL."""

from __future__ import annotations

import os
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import codec, convert, grid, images, names, spatial, types
from terrane.functions.binary import body
from terrane.operators import container as c
from terrane.operators import relations, validate
from terrane.operators.layer import BoundingBox, Layer
from terrane.operators.shared import scratch
from terrane.plans import inputs as i
from terrane.sources import sqlite

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def fresh(spark: SparkSession) -> c.Container:
    return c.Container.create(spark, scratch(spark, "container"))


def customers(spark: SparkSession, d: str) -> c.Container:
    """customer as an attribute table."""
    box = fresh(spark)
    box.create_table(c.TableSpec("people", [c.ColumnSpec("name", "TEXT"), c.ColumnSpec("balance", "DOUBLE"), c.ColumnSpec("nation", "INT", default=7)], primary_key="id"))
    box.insert("people", people(spark, d))
    return box


def people(spark: SparkSession, d: str) -> DataFrame:
    return i.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))


PEOPLE = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_nationkey AS nation FROM customer"


@query("container_insert", f"{PEOPLE} UNION ALL SELECT c_custkey + 10000000, c_name, NULL, 7 FROM customer WHERE c_custkey % 50 = 0")
def container_insert(spark: SparkSession, d: str) -> DataFrame:
    box = customers(spark, d)
    box.insert("people", people(spark, d).where("id % 50 = 0").select((F.col("id") + 10_000_000).alias("id"), "name"))
    return c.Container.open(spark, box.path).table("PEOPLE")


@query("container_update", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) || '!' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 4 = 0 THEN 7 ELSE c_nationkey END AS nation FROM customer")
def container_update(spark: SparkSession, d: str) -> DataFrame:
    box = customers(spark, d)
    changed = people(spark, d).where("id % 4 = 0").select("id", F.concat(F.upper("name"), F.lit("!")).alias("name"))
    box.update("people", changed.union(changed.limit(1).withColumn("id", F.lit(-5).cast("long"))))
    return c.Container.open(spark, box.path).table("people")


@query("container_update_columns", "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS nation FROM customer")
def container_update_columns(spark: SparkSession, d: str) -> DataFrame:
    box = customers(spark, d)
    box.update_columns("people", people(spark, d).where("id % 4 = 0").select("id", F.lit(None).cast("double").alias("balance"), (F.col("nation") + 1).alias("nation")))
    return box.table("people")


@query("container_delete", f"{PEOPLE} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def container_delete(spark: SparkSession, d: str) -> DataFrame:
    box = customers(spark, d)
    box.delete("people", i.table(spark, d, "orders").where("o_totalprice > 200000").select("o_custkey"))
    return box.table("people")


@query("container_upsert", "SELECT user_id AS id, event_type AS kind, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def container_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, each the last row of its keys; the second takes the place of the first."""
    box = fresh(spark)
    rows = i.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), "value", "ts", "event_id")
    half = rows.agg(F.percentile_approx("ts", 0.5)).first()[0]
    box.commit(created={"latest": rows.select("id", "kind", "value").schema})
    for batch in (rows.where(F.col("ts") <= F.lit(half)), rows.where(F.col("ts") > F.lit(half))):
        box.upsert("latest", batch, ["id", "kind"], F.struct("ts", "event_id"))
    return box.table("latest")


@query("container_transaction", f"{PEOPLE} WHERE c_custkey % 3 <> 0 UNION ALL SELECT -1, 'late', 0.5, 1")
def container_transaction(spark: SparkSession, d: str) -> DataFrame:
    box = customers(spark, d)
    late = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("late").alias("name"), F.lit(0.5).alias("balance"), F.lit(1).alias("nation"))

    def work(inner: c.Container) -> None:
        inner.insert("people", late)
        inner.delete("people", people(spark, d).where("id % 3 = 0").select("id"))

    box.transaction(work)
    return c.Container.open(spark, box.path).table("people")


@query("container_versions", "SELECT 'before' AS state, count(*) AS n FROM customer UNION ALL SELECT 'after', count(*) FROM customer WHERE c_custkey % 2 = 1")
def container_versions(spark: SparkSession, d: str) -> DataFrame:
    """An older state stays readable, and compaction changes no row."""
    box = customers(spark, d)
    version = box.state["version"]
    box.delete("people", people(spark, d).where("id % 2 = 0").select("id"))
    box.compact("people")
    counted = lambda at, name: at.table("people").agg(F.lit(name).alias("state"), F.count(F.lit(1)).alias("n"))
    return counted(c.Container.open(spark, box.path, version=version), "before").union(counted(box, "after"))


@query("contents_listing", "SELECT n_name AS table_name, CASE n_nationkey % 2 WHEN 0 THEN 'features' ELSE 'attributes' END AS data_type, CASE n_nationkey % 2 WHEN 0 THEN 4326 END AS srs_id FROM nation ORDER BY 1")
def contents_listing(spark: SparkSession, d: str) -> DataFrame:
    box = fresh(spark)
    for r in i.table(spark, d, "nation").select("n_name", "n_nationkey").collect():  # 25 tables to be
        box.create_table(c.TableSpec(r.n_name, [], c.GeometrySpec("POINT", 4326) if r.n_nationkey % 2 == 0 else None))
    return c.Container.open(spark, box.path).contents().select("table_name", "data_type", "srs_id")


def parts_box(spark: SparkSession, d: str) -> c.Container:
    """An empty table for part, with constraints on its columns."""
    box = fresh(spark)
    columns = [c.ColumnSpec("name", "TEXT", not_null=True), c.ColumnSpec("brand", "TEXT"), c.ColumnSpec("size", "INT"), c.ColumnSpec("price", "DOUBLE", unique=True)]
    box.create_table(c.TableSpec("parts", columns, primary_key="id"))
    rows = [("sizes", "range", None, 5.0, True, 30.0, False, None), ("brands", "glob", "Brand#[1-3]*", None, None, None, None, None)]
    rows += [("names", "enum", f"part {k}", None, None, None, None, None) for k in range(3)]
    c.add_column_constraint(box, spark.createDataFrame(rows, c.CONSTRAINTS))
    told = [("parts", "size", None, "Size", None, None, "sizes"), ("parts", "brand", None, None, None, None, "brands")]
    c.set_data_columns(box, spark.createDataFrame(told, c.DATA_COLUMNS))
    return box


def part_rows(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 7 != 0, F.col("p_name"))
    return i.table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


PARTS = "p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name, p_brand AS brand, p_size AS size, p_retailprice AS price FROM part), u AS (SELECT price FROM p WHERE price IS NOT NULL GROUP BY price HAVING count(*) > 1)"


@query("write_violations", f"WITH {PARTS} SELECT id, name IS NULL AS null_name, NOT (size >= 5 AND size < 30) AS bad_size, NOT (brand GLOB 'Brand#[1-3]*') AS bad_brand, price IN (SELECT price FROM u) AS twice FROM p")
def write_violations(spark: SparkSession, d: str) -> DataFrame:
    told = c.violations(parts_box(spark, d), "parts", part_rows(spark, d))
    has = lambda x: F.array_contains("violations", x)
    return told.select("id", has("name").alias("null_name"), has("size").alias("bad_size"), has("brand").alias("bad_brand"), has("price").alias("twice"))


@query("write_enforced", f"WITH {PARTS} SELECT id, name, brand, size, price FROM p WHERE name IS NOT NULL AND size >= 5 AND size < 30 AND brand GLOB 'Brand#[1-3]*' AND price NOT IN (SELECT price FROM u)")
def write_enforced(spark: SparkSession, d: str) -> DataFrame:
    """What no rule forbids is written with the rules on; what one forbids is refused as a whole, and leaves nothing."""
    box = parts_box(spark, d)
    told = c.violations(box, "parts", part_rows(spark, d))
    try:
        box.insert("parts", told.where("size(violations) > 0").drop("violations"), constraints=True)
    except Exception as refused:
        if not any(x in str(refused) for x in ("refused", "repeats")):
            raise
    box.insert("parts", told.where("size(violations) = 0").drop("violations"), constraints=True)
    return box.table("parts")


@query("constraint_rows", "SELECT 'brand' AS column_name, 'glob' AS kind, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high UNION ALL SELECT 'size', 'range', 5, 30")
def constraint_rows(spark: SparkSession, d: str) -> DataFrame:
    rules = c.constraint_rules(parts_box(spark, d), "PARTS")
    return i.texts(spark, [(k, r["kind"], r.get("low"), r.get("high")) for k, r in sorted(rules.items())], "column_name string, kind string, low double, high double")


@query("table_schema", "SELECT * FROM (VALUES (0, 'id', 'bigint', true, false, CAST(NULL AS VARCHAR)), (1, 'name', 'string', false, false, NULL), (2, 'brand', 'string', false, true, NULL), (3, 'size', 'bigint', false, true, 'Size'), (4, 'price', 'double', false, true, NULL)) t(ordinal, column_name, type, is_primary_key, nullable, title)")
def table_schema(spark: SparkSession, d: str) -> DataFrame:
    return c.table_schema(parts_box(spark, d), "Parts").select("ordinal", "column_name", "type", "is_primary_key", "nullable", "title")


@query("stored_bbox", f"WITH {i.P_SQL} SELECT fid, c_name, x, y FROM p WHERE x BETWEEN -40 AND 20 AND y BETWEEN -30 AND 10")
def stored_bbox(spark: SparkSession, d: str) -> DataFrame:
    return i.stored_points(spark, d).features_in(BoundingBox(-40, -30, 20, 10)).with_columns("c_name", "x", "y").rows()


@query("stored_geometry", f"WITH {i.P_SQL} SELECT fid, 'POINT (' || CAST(x AS VARCHAR) || ' ' || CAST(y AS VARCHAR) || ')' AS text FROM p WHERE x BETWEEN -40 AND 20 AND y BETWEEN -30 AND 10")
def stored_geometry(spark: SparkSession, d: str) -> DataFrame:
    """The geometry of rows in a box, as text."""
    rows = i.stored_points(spark, d).features_in(BoundingBox(-40, -30, 20, 10)).geometry()
    return rows.select("fid", codec.texts()(F.col("geom")).alias("text"))


@query("stored_extent", f"WITH {i.P_SQL} SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM p")
def stored_extent(spark: SparkSession, d: str) -> DataFrame:
    return i.stored_points(spark, d).measured_extent()


@query("stored_join", f"WITH {i.P_SQL}, {i.PS_SQL} SELECT ps.fid AS box_id, p.fid FROM ps JOIN p ON p.x >= ps.x - 3 AND p.x <= ps.x + 3 AND p.y >= ps.y - 2 AND p.y <= ps.y + 2")
def stored_join(spark: SparkSession, d: str) -> DataFrame:
    from terrane.operators.layer import spatial_join

    boxes = i.supplier_points(spark, d).select(F.col("fid").alias("box_id"), (F.col("x") - 3).alias("minx"), (F.col("x") + 3).alias("maxx"), (F.col("y") - 2).alias("miny"), (F.col("y") + 2).alias("maxy"))
    return spatial_join(i.stored_points(spark, d).df, boxes, cell=6.0)


@query("extent_recomputed", f"WITH {i.P_SQL} SELECT 'written' AS state, min(x) AS min_x, max(y) AS max_y FROM p UNION ALL SELECT 'deleted', min(x), max(y) FROM p UNION ALL SELECT 'measured', min(x), max(y) FROM p WHERE x > -50")
def extent_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """The recorded bounds: grown by the write, left by the delete, then measured anew."""
    box = fresh(spark)
    box.create_table(c.TableSpec("points", [], c.GeometrySpec("POINT", 4326)))
    rows = i.points(spark, d).withColumn("geom", body(codec.encode_points(4326)(F.col("x"), F.col("y"))))
    box.insert("points", rows.select("fid", "geom"))
    seen = [("written", box.rows("contents")[0])]
    box.delete("points", i.points(spark, d).where("x <= -50").select("fid"))
    seen.append(("deleted", box.rows("contents")[0]))
    box.recompute_extent("points")
    seen.append(("measured", box.rows("contents")[0]))
    return i.texts(spark, [(k, r["min_x"], r["max_y"]) for k, r in seen], "state string, min_x double, max_y double")


CURVES = [(1, (5.0, 0.0, 0.0, 5.0, -5.0, 0.0, 0.0, -5.0, 5.0, 0.0), (-5.0, 5.0, -5.0, 5.0)), (2, (0.0, 0.0, 1.0, 1.0, 2.0, 0.0, 3.0, -1.0, 4.0, 0.0), (0.0, 4.0, -1.0, 1.0))]


def curve(numbers: tuple) -> bytearray:
    return bytearray(struct.pack(f"<BII{len(numbers)}d", 1, codec.CIRCULAR, len(numbers) // 2, *numbers))


@query("curved_layer", "WITH " + i.sql_values([(k, *box) for k, _, box in CURVES], "t", "fid, minx, maxx, miny, maxy") + " SELECT *, 'gpkg_geom_CIRCULARSTRING' AS extension_name FROM t")
def curved_layer(spark: SparkSession, d: str) -> DataFrame:
    """Strings of several arcs: their boxes, and the extension that the write registers."""
    box = fresh(spark)
    box.create_table(c.TableSpec("arcs", [], c.GeometrySpec("GEOMETRY", 0)))
    box.insert("arcs", spark.createDataFrame([(k, curve(p)) for k, p, _ in CURVES], "fid long, geom binary"))
    told = box.table_extensions("arcs").where("extension_name LIKE 'gpkg_geom%'").select("extension_name")
    rounded = [F.round(x, 9).alias(x) for x in ("minx", "maxx", "miny", "maxy")]
    return box.table("arcs").select("fid", *rounded).join(F.broadcast(told))


@query("srs_listing", "SELECT -1 AS srs_id, 'Undefined Cartesian SRS' AS srs_name UNION ALL SELECT 0, 'Undefined geographic SRS' UNION ALL SELECT 4326, 'WGS 84' UNION ALL SELECT 32600 + CAST(range AS INTEGER), 'WGS 84 / UTM zone ' || range || 'N' FROM range(31, 34) UNION ALL SELECT 3857, 'WGS 84 / Pseudo-Mercator'")
def srs_listing(spark: SparkSession, d: str) -> DataFrame:
    box = fresh(spark)
    for code in (32631, 32632, 32633, 3857, 32631):
        box.add_epsg_srs(code)
    return box.srs_list().where(F.col("definition").contains("AUTHORITY") | (F.col("srs_id") < 1)).select("srs_id", "srs_name")


@query("srs_definition", "SELECT 32600 + CAST(range AS INTEGER) AS code, 'UTM zone ' || range || 'N' AS conversion, CAST(range * 6 - 183 AS INTEGER) AS meridian FROM range(1, 61)")
def srs_definition(spark: SparkSession, d: str) -> DataFrame:
    """Conversion and central meridian, read back from the newer definition text."""
    rows = i.texts(spark, [(k, names.epsg_definition(k).wkt2) for k in range(32601, 32661)], "code int, wkt string")
    meridian = F.regexp_extract("wkt", r'"Longitude of natural origin",(-?[0-9]+)', 1).cast("int")
    return rows.select("code", F.regexp_extract("wkt", r'CONVERSION\["([^"]+)"', 1).alias("conversion"), meridian.alias("meridian"))


@query("pyramid_listing", "SELECT * FROM (VALUES ('mercator', 0, 1, 1), ('mercator', 1, 2, 2), ('mercator', 2, 4, 4), ('world', 0, 2, 1), ('world', 1, 4, 2)) t(table_name, zoom_level, matrix_width, matrix_height)")
def pyramid_listing(spark: SparkSession, d: str) -> DataFrame:
    box = fresh(spark)
    c.create_pyramid(box, "world", grid.WORLD, grid.ladder(spark, grid.WORLD, 0, 1, base=(2, 1)))
    c.create_pyramid(box, "mercator", grid.WEB_MERCATOR, grid.ladder(spark, grid.WEB_MERCATOR, 0, 2))
    every = c.tile_pyramids(box).join(box.table("tile_matrix"), "table_name")
    return every.select("table_name", *[F.col(x).cast("int").alias(x) for x in ("zoom_level", "matrix_width", "matrix_height")])


@query("pyramid_writes", "SELECT o_orderkey % 4 AS tile_column, o_orderkey // 4 % 2 AS tile_row, max(o_orderkey) AS n FROM orders WHERE o_orderkey % 4 > 0 GROUP BY ALL")
def pyramid_writes(spark: SparkSession, d: str) -> DataFrame:
    """Tiles put through a container in two batches, the last of an address counting, and a column of them deleted."""
    box = fresh(spark)
    c.create_pyramid(box, "world", grid.WORLD, grid.ladder(spark, grid.WORLD, 0, 1, base=(2, 1)))
    k = F.col("o_orderkey")
    payload = F.concat(F.lit("tile "), F.lpad(k.cast("string"), 12, "0")).cast("binary")
    tiles = i.table(spark, d, "orders").select(F.lit(1).cast("long").alias("zoom_level"), (k % 4).alias("tile_column"), (F.floor(k / 4) % 2).cast("long").alias("tile_row"), payload.alias("tile_data"), k)
    half = tiles.agg(F.expr("max(o_orderkey) div 2")).first()[0]
    for batch in (tiles.where(k <= half), tiles.where(k > half)):
        c.put_tiles(box, "world", batch.select(*c._fields(c.TILES)), "tile_data")
    c.delete_tiles(box, "world", spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "zoom_level long, tile_column long, tile_row long"))
    return c.open_pyramid(box, "world").tiles.select("tile_column", "tile_row", F.substring(F.col("tile_data").cast("string"), 6, 12).cast("long").alias("n"))


@query("container_relations", "SELECT l_orderkey AS base_id, l_partkey AS related_id FROM lineitem WHERE l_quantity > 40")
def container_relations(spark: SparkSession, d: str) -> DataFrame:
    box = fresh(spark)
    for name in ("orders", "parts"):
        box.create_table(c.TableSpec(name, []))
    c.add_relations(box, spark.createDataFrame([(1, "Orders", "fid", "PARTS", "fid", "attributes", "orders_parts")], c.RELATIONS))
    pairs = i.table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("base_id"), F.col("l_partkey").alias("related_id"))
    c.add_mappings(box, "orders_parts", pairs)
    mapping = relations.relations_from(box.table("relations"), "orders").first().mapping_table_name
    return box.table(mapping)


@query("container_metadata", "SELECT n_nationkey AS id, r_name AS metadata, 't' || n_nationkey % 3 AS table_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 = 1")
def container_metadata(spark: SparkSession, d: str) -> DataFrame:
    box = fresh(spark)
    nation = i.table(spark, d, "nation").join(i.table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    k = F.col("n_nationkey").cast("long")
    c.add_metadata(box, nation.select(k.alias("id"), F.lit("dataset").alias("md_scope"), F.lit("u").alias("md_standard_uri"), F.lit("text/plain").alias("mime_type"), F.col("r_name").alias("metadata")))
    at = F.concat(F.lit("t"), (k % 3).cast("string"))
    none = lambda kind: F.lit(None).cast(kind)
    c.add_references(box, nation.select(F.lit("table").alias("reference_scope"), at.alias("table_name"), none("string").alias("column_name"), none("long").alias("row_id_value"), none("timestamp").alias("timestamp"), k.alias("md_file_id"), none("long").alias("md_parent_id")))
    found = relations.metadata_for(box.table("metadata_reference"), "table", table_name="t1")
    told = found.join(box.table("metadata"), F.col("md_file_id") == F.col("id"))
    return told.select(F.col("id").cast("int").alias("id"), "metadata", "table_name")


@query("container_copy", f"SELECT 'people' AS name, count(*) AS n FROM customer UNION ALL SELECT 'left behind: world', 0")
def container_copy(spark: SparkSession, d: str) -> DataFrame:
    box = customers(spark, d)
    c.create_pyramid(box, "world", grid.WORLD, grid.ladder(spark, grid.WORLD, 0, 0, base=(2, 1)))
    other, left = box.copy_to(scratch(spark, "container"))
    counted = other.table("people").agg(F.lit("people").alias("name"), F.count(F.lit(1)).alias("n"))
    behind = [(f"left behind: {x}", 0) for x in left if not x.startswith("tile_matrix")]
    return counted.union(i.texts(spark, behind, "name string, n long"))


@query("container_extensions", "SELECT * FROM (VALUES (CAST(NULL AS VARCHAR), 'acme_b', 'unrecognised'), ('a', 'gpkg_schema', 'implemented'), ('b', 'gpkg_zoom_other', 'implemented')) t(table_name, extension_name, support)")
def container_extensions(spark: SparkSession, d: str) -> DataFrame:
    box = fresh(spark)
    for row in (("b", None, "gpkg_zoom_other"), (None, None, "acme_b"), ("a", None, "gpkg_schema"), ("a", None, "gpkg_schema"), ("a", "x", "acme_gone")):
        box.register((*row, "d", "read-write"))
    box.unregister("acme_gone", "A", "X")
    return box.extensions().select("table_name", "extension_name", names.extension_support(F.col("extension_name")).alias("support"))


@query("index_repair", "SELECT 'new' AS state, count(*) AS entries, CAST(0 AS BIGINT) AS missing, true AS is_consistent FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'grown', count(*) FILTER (c_custkey % 2 = 0), count(*) FILTER (c_custkey % 2 = 1), false FROM customer UNION ALL SELECT 'repaired', count(*), 0, true FROM customer")
def index_repair(spark: SparkSession, d: str) -> DataFrame:
    """The audit of a stored index: built, left behind by a write, repaired."""
    box = fresh(spark)
    box.create_table(c.TableSpec("points", [], c.GeometrySpec("POINT", 4326)))
    rows = i.points(spark, d).withColumn("geom", body(codec.encode_points(4326)(F.col("x"), F.col("y")))).select("fid", "geom")
    told = lambda state: (state, *box.audit_index("points").select("entries", "missing", "is_consistent").first())
    box.insert("points", rows.where("fid % 2 = 0"))
    box.create_index("points")
    seen = [told("new")]
    box.insert("points", rows.where("fid % 2 = 1"))
    seen.append(told("grown"))
    box.repair_index("points")
    seen.append(told("repaired"))
    return i.texts(spark, seen, "state string, entries long, missing long, is_consistent boolean")


@query("geometry_names", "SELECT CAST(range AS INTEGER) AS code, range NOT IN (13, 14) AS has_body FROM range(15)")
def geometry_names(spark: SparkSession, d: str) -> DataFrame:
    """Each name of a geometry type to its code, in any case, and whether a body may have it."""
    rows = i.texts(spark, [(n.lower() if k % 2 else n,) for k, n in enumerate(types.GEOMETRY_TYPES)], "name string")
    code = types.geometry_code(F.col("name"))
    return rows.select(code.cast("int").alias("code"), (~code.isin(13, 14)).alias("has_body"))


@query("quoted_names", "SELECT n_name AS name, '`' || replace(n_name || CASE WHEN n_nationkey % 2 = 0 THEN '`x' ELSE '' END, '`', '``') || '`' AS quoted FROM nation")
def quoted_names(spark: SparkSession, d: str) -> DataFrame:
    rows = i.table(spark, d, "nation").select("n_name", "n_nationkey").collect()  # 25 identifiers
    return i.texts(spark, [(r.n_name, names.quote(r.n_name + ("`x" if r.n_nationkey % 2 == 0 else ""))) for r in rows], "name string, quoted string")


def local_folder(spark: SparkSession) -> str:
    """A folder that this machine's file system and Spark name alike: a file that SQLite writes is one of the driver's."""
    folder = scratch(spark, "files").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    return folder


@query("file_roundtrip", f"WITH {i.P_SQL} SELECT fid, c_name, c_acctbal, minx, miny FROM (SELECT *, x AS minx, y AS miny FROM p) WHERE x BETWEEN -100 AND 50 AND y BETWEEN -30 AND 60")
def file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A layer written to a file with its R-tree, and a box of it read from there."""
    path = f"{local_folder(spark)}/points.file"
    sqlite.export(i.stored_box(spark, d, "points"), path)
    layer = Layer(sqlite.read(spark, path, "points", columns="fid,c_name,c_acctbal,minx,maxx,miny,maxy"), geom="geom").features_in(BoundingBox(-100, -30, 50, 60))
    return layer.df.where(layer.predicate).select("fid", "c_name", "c_acctbal", "minx", "miny")


@query("file_index_state", "SELECT 'current' AS state, count(*) AS entries FROM customer")
def file_index_state(spark: SparkSession, d: str) -> DataFrame:
    path = f"{local_folder(spark)}/points.file"
    sqlite.export(i.stored_box(spark, d, "points"), path)
    con = sqlite.connect(path)
    entries = con.execute("SELECT count(*) FROM rtree_points_geom").fetchone()[0]
    con.close()
    return i.texts(spark, [(sqlite.index_state(path, "points"), entries)], "state string, entries long")


@query("st_functions", f"WITH {i.P_SQL} SELECT fid, CASE WHEN fid % 7 <> 0 AND fid % 11 <> 0 THEN x END AS minx, CASE WHEN fid % 7 <> 0 AND fid % 11 <> 0 THEN y END AS maxy, CASE WHEN fid % 7 <> 0 THEN fid % 11 = 0 END AS is_empty FROM p")
def st_functions(spark: SparkSession, d: str) -> DataFrame:
    """Bounds by the functions' SQL names."""
    from terrane.plans.layers import holes

    spatial.register(spark)
    return holes(spark, d).select("fid", F.expr("ST_MinX(geom)").alias("minx"), F.expr("ST_MaxY(geom)").alias("maxy"), F.expr("ST_IsEmpty(geom)").alias("is_empty"))


@query("st_is_empty_body", "SELECT * FROM (VALUES (1, false), (2, true), (3, true), (4, NULL)) t(k, is_empty)")
def st_is_empty_body(spark: SparkSession, d: str) -> DataFrame:
    """A point, one without a finite pair whose header doesn't say so, a line of no points, and a broken blob."""
    plain = codec.header(0, [], False, False)
    point = lambda x: plain + struct.pack("<BIdd", 1, codec.POINT, x, x)
    blobs = [point(1.0), point(float("nan")), plain + struct.pack("<BII", 1, codec.LINE, 0), b"GP\x00\x01"]
    rows = i.texts(spark, [(k + 1, b.hex()) for k, b in enumerate(blobs)], "k int, blob string")
    return rows.select("k", spatial.st_is_empty(F.unhex("blob")).alias("is_empty"))


@query("arrow_batches", f"WITH {i.P_SQL}, b AS (SELECT fid, (row_number() OVER (ORDER BY fid) - 1) // 100 AS batch FROM p WHERE x > 0) SELECT CAST(batch AS INTEGER) AS batch, min(fid) AS lo, max(fid) AS hi, count(*) AS n FROM b GROUP BY batch")
def arrow_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a layer in id order, a hundred to a batch."""
    layer = i.stored_points(spark, d).select("x > :least", least=0.0).with_columns("c_name", "geom")
    told = [(k, b.column("fid")[0].as_py(), b.column("fid")[-1].as_py(), b.num_rows) for k, b in enumerate(layer.read_arrow(rows=100))]
    return spark.createDataFrame(told, "batch int, lo long, hi long, n long")


@query("arrow_fields", "SELECT * FROM (VALUES ('fid', 'int64', CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER)), ('c_name', 'string', NULL, NULL), ('geom', 'binary', 'geoarrow.wkb', 4326)) t(name, type, extension, code)")
def arrow_fields(spark: SparkSession, d: str) -> DataFrame:
    schema = i.stored_points(spark, d).with_columns("c_name", "geom").arrow_schema()
    mark = lambda f, key: (f.metadata or {}).get(key.encode(), b"").decode() or None
    rows = i.texts(spark, [(f.name, str(f.type), mark(f, "ARROW:extension:name"), mark(f, "ARROW:extension:metadata")) for f in schema], "name string, type string, extension string, metadata string")
    return rows.select("name", "type", "extension", names.crs_code(F.col("metadata")).alias("code"))


@query("mistyped_geometries", "WITH t AS (SELECT o_orderkey AS fid, CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 8 END AS INTEGER) AS geom_type, o_orderkey % 2 AS dims FROM orders) SELECT fid, geom_type, CASE WHEN geom_type <> 2 THEN 'geometry type' ELSE 'z or m' END AS error FROM t WHERE geom_type <> 2 OR dims = 1")
def mistyped_geometries(spark: SparkSession, d: str) -> DataFrame:
    """Geometries that a column of flat line strings may not hold."""
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, 1).when(k % 3 == 1, 2).otherwise(8)
    rows = i.table(spark, d, "orders").select(k.alias("fid"), kind.cast("int").alias("geom_type"), (k % 2).cast("int").alias("dims"))
    return Layer(rows).mistyped("LINESTRING", z=0, m=0)


@query("tile_to_xyz", "WITH a AS (SELECT o_orderkey, o_orderkey % 6 AS z, o_orderkey % 40 AS x, o_orderkey % 23 AS y FROM orders) SELECT o_orderkey, CASE WHEN ok THEN z END AS z, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y FROM (SELECT *, x < (1 << z) AND y < (1 << z) AS ok FROM a)")
def tile_to_xyz(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    df = i.table(spark, d, "orders").select("o_orderkey", (k % 6).alias("z"), (k % 40).alias("x"), (k % 23).alias("y"))
    side = F.pow(F.lit(2.0), F.col("z").cast("double")).cast("long")
    at = grid.tile_xyz(grid.WEB_MERCATOR, F.col("z"), side, side, F.col("x"), F.col("y"))
    return df.select("o_orderkey", *[at[c_].alias(c_) for c_ in ("z", "x", "y")])


@query("datetime_offset_out", "SELECT event_id, strftime(ts + to_minutes(CASE event_id % 3 WHEN 0 THEN 330 WHEN 1 THEN -90 ELSE 0 END), '%Y-%m-%dT%H:%M:%S.') || CASE WHEN epoch_us(ts) % 1000 = 0 THEN lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') ELSE lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') || '000' END || CASE event_id % 3 WHEN 0 THEN '+05:30' WHEN 1 THEN '-01:30' ELSE 'Z' END AS s FROM events")
def datetime_offset_out(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    offset = F.when(k == 0, 330).when(k == 1, -90)
    rows = i.table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), offset.alias("offset"))
    return rows.select("event_id", convert.format_micros(F.col("t"), F.col("offset")).alias("s"))


@query("reading_options", "SELECT p_partkey, p_size % 3 <> 0 AS lenient, CASE WHEN p_size % 3 < 2 THEN p_size % 3 = 1 END AS strict, CASE WHEN p_size % 3 = 2 THEN 'not a boolean' END AS error FROM part")
def reading_options(spark: SparkSession, d: str) -> DataFrame:
    df = i.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("lenient"), (F.col("p_size") % 3).alias("strict"))
    both = c.read_value(c.read_value(df, "lenient", "BOOLEAN"), "strict", "BOOLEAN", convert.STRICT_READING)
    return both.select("p_partkey", "lenient", "strict", F.col("strict_error").alias("error"))


IMAGES = {
    "png": bytes.fromhex("89504E470D0A1A0A0000000D49484452") + struct.pack(">II", 256, 128),
    "jpeg": b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9) + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 300, 400) + bytes(10),
    "webp": b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + bytes(4) + (511).to_bytes(3, "little") + (255).to_bytes(3, "little"),
    "tiff": b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHxx", 256, 3, 1, 77) + struct.pack("<HHII", 257, 4, 1, 88),
    "gif": b"GIF89a",
}


@query("image_probe", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'tiff' END AS format, CAST(CASE p_partkey % 5 WHEN 0 THEN 256 WHEN 1 THEN 400 WHEN 2 THEN 512 WHEN 3 THEN 77 END AS BIGINT) AS width, CAST(CASE p_partkey % 5 WHEN 0 THEN 128 WHEN 1 THEN 300 WHEN 2 THEN 256 WHEN 3 THEN 88 END AS BIGINT) AS height FROM part")
def image_probe(spark: SparkSession, d: str) -> DataFrame:
    """Size and format of a payload of each kind that is probed, and of one that isn't."""
    payload = F.element_at(F.array(*[F.unhex(F.lit(b.hex())) for b in IMAGES.values()]), (F.col("p_partkey") % 5 + 1).cast("int"))
    found = i.table(spark, d, "part").select("p_partkey", images.probes()(payload).alias("s"))
    return found.select("p_partkey", "s.format", "s.width", "s.height")


@query("findings_order", "SELECT severity, kind, table_name FROM (VALUES ('error', 'missing table', 'b', 0), ('error', 'missing table', 'd', 1), ('warning', 'case differs', 'C', 2), ('warning', 'unrecognised extension', 't', 3), ('advisory', 'no index', 'a', 4)) t(severity, kind, table_name, k) ORDER BY k")
def findings_order(spark: SparkSession, d: str) -> DataFrame:
    contents = i.texts(spark, [(x,) for x in ("a", "b", "C", "d")], "table_name string")
    there = i.texts(spark, [("a",), ("c",)], "name string")
    indexes = i.texts(spark, [("a", "absent", True), ("C", "current", True)], "table_name string, status string, is_consistent boolean")
    extensions = i.texts(spark, [("acme_x", "t")], "extension_name string, table_name string")
    return validate.validate(contents=contents, tables=there, indexes=indexes, extensions=extensions).select("severity", "kind", "table_name")


@query("container_of_schema", "SELECT * FROM (VALUES (0, 'fid', 'bigint', CAST(NULL AS VARCHAR)), (1, 'n', 'bigint', 'MEDIUMINT'), (2, 'name', 'string', 'TEXT'), (3, 'day', 'date', 'DATE'), (4, 'shape', 'binary', 'GEOMETRY')) t(ordinal, column_name, type, declared)")
def container_of_schema(spark: SparkSession, d: str) -> DataFrame:
    """A table made from a Spark schema."""
    schema = T.StructType([T.StructField("fid", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("day", T.DateType()), T.StructField("shape", T.BinaryType(), True, {"crs": "4326"})])
    box = fresh(spark)
    box.create_table(c.TableSpec.of_schema("made", schema))
    return c.table_schema(box, "made").where("ordinal < 5").select("ordinal", "column_name", "type", "declared")
