"""Queries over catalogues, relations, metadata, constraints and writes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import codec, constraints, names
from terrane.operators import container, pyramid, relations, validate
from terrane.operators.shared import scratch
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


@query("related_walk", "SELECT o_orderkey, o_orderstatus, p_partkey, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def related_walk(spark: SparkSession, d: str) -> DataFrame:
    base = i.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    mapping = i.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("base_id"), F.col("l_partkey").alias("related_id"))
    other = i.table(spark, d, "part").select("p_partkey", "p_brand")
    return relations.related(base, mapping, other, "o_orderkey", "p_partkey").select("o_orderkey", "o_orderstatus", "p_partkey", "p_brand")


@query("related_ids", "SELECT l_partkey AS related_id FROM lineitem WHERE l_orderkey = 77")
def related_ids(spark: SparkSession, d: str) -> DataFrame:
    mapping = i.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("base_id"), F.col("l_partkey").alias("related_id"))
    return relations.related_ids(mapping, 77)


@query("relations_from", "SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'Roads' WHEN 1 THEN 'ROADS' ELSE 'rivers' END AS base_table_name, n_name AS related_table_name FROM nation WHERE n_nationkey % 3 < 2")
def relations_from(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    df = i.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(k == 0, "Roads").when(k == 1, "ROADS").otherwise("rivers").alias("base_table_name"), F.col("n_name").alias("related_table_name"))
    return relations.relations_from(df, "roads")


RELATION_NAMES = ["media", "simple_attributes", "features", "attributes", "tiles", "Media", "x-", "x-acme", "x-_n", "x-acme_", "x-a_b_c", "x-a_b", "y-a_b", "", "x-é_ß"]


@query("relation_name_conformance", f"WITH {i.sql_values([(x,) for x in RELATION_NAMES], 't', 'relation_name')} SELECT relation_name, relation_name IN ('media', 'simple_attributes', 'features', 'attributes', 'tiles') OR regexp_full_match(relation_name, 'x-[^_]+_.+') AS ok FROM t")
def relation_name_conformance(spark: SparkSession, d: str) -> DataFrame:
    return i.texts(spark, [(x,) for x in RELATION_NAMES], "relation_name string").withColumn("ok", names.relation_conforms(F.col("relation_name")))


REFERENCES = f"""r AS (SELECT o_orderkey AS md_file_id, CASE o_orderkey % 5 WHEN 0 THEN '{names.WHOLE_FILE}' WHEN 1 THEN 'table' WHEN 2 THEN 'column' WHEN 3 THEN 'row' ELSE 'row/col' END AS reference_scope,
CASE WHEN o_orderkey % 5 > 0 THEN 't' || CAST(o_orderkey % 3 AS VARCHAR) END AS table_name, CASE WHEN o_orderkey % 5 IN (2, 4) THEN 'c' || CAST(o_orderkey % 2 AS VARCHAR) END AS column_name, CASE WHEN o_orderkey % 5 > 2 THEN o_orderkey % 11 END AS row_id_value FROM orders)"""


def references(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    scope = F.when(k % 5 == 0, names.WHOLE_FILE).when(k % 5 == 1, "table").when(k % 5 == 2, "column").when(k % 5 == 3, "row").otherwise("row/col")
    name = lambda p, m, c: F.when(c, F.concat(F.lit(p), (k % m).cast("string")))
    return i.table(spark, d, "orders").select(k.alias("md_file_id"), scope.alias("reference_scope"), name("t", 3, k % 5 > 0).alias("table_name"), name("c", 2, (k % 5).isin(2, 4)).alias("column_name"), F.when(k % 5 > 2, k % 11).alias("row_id_value"), F.lit(None).cast("long").alias("md_parent_id"))


@query("metadata_for", f"WITH {REFERENCES} SELECT md_file_id FROM r WHERE reference_scope = 'row/col' AND table_name IS NOT DISTINCT FROM 't1' AND column_name IS NOT DISTINCT FROM 'c0' AND row_id_value IS NOT DISTINCT FROM 4")
def metadata_for(spark: SparkSession, d: str) -> DataFrame:
    return relations.metadata_for(references(spark, d), "row/col", table_name="t1", column_name="c0", row_id_value=4).select("md_file_id")


@query("metadata_for_whole", f"WITH {REFERENCES} SELECT md_file_id FROM r WHERE reference_scope = '{names.WHOLE_FILE}' AND table_name IS NULL AND column_name IS NULL AND row_id_value IS NULL")
def metadata_for_whole(spark: SparkSession, d: str) -> DataFrame:
    return relations.metadata_for(references(spark, d), names.WHOLE_FILE).select("md_file_id")


@query("metadata_ancestors", """WITH RECURSIVE n AS (SELECT n_nationkey + 100 AS id, CAST(n_regionkey + 10 AS BIGINT) AS parent FROM nation UNION ALL SELECT r_regionkey + 10, 1 FROM region),
u(id, depth, ancestor) AS (SELECT id, 1, parent FROM n UNION ALL SELECT u.id, depth + 1, n.parent FROM u JOIN n ON n.id = u.ancestor) SELECT CAST(id AS BIGINT) AS id, CAST(depth AS INTEGER) AS depth, ancestor FROM u WHERE id >= 100""")
def metadata_ancestors(spark: SparkSession, d: str) -> DataFrame:
    nation = i.table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("md_file_id"), (F.col("n_regionkey") + 10).cast("long").alias("md_parent_id"))
    region = i.table(spark, d, "region").select((F.col("r_regionkey") + 10).cast("long").alias("md_file_id"), F.lit(1).cast("long").alias("md_parent_id"))
    return relations.ancestors(nation.union(region), nation.select(F.col("md_file_id").alias("id"))).select("id", "depth", "ancestor")


@query("reference_check", f"""WITH {REFERENCES} SELECT md_file_id, CASE WHEN md_file_id % 7 = 0 THEN 'dangling' END AS error FROM r""")
def reference_check(spark: SparkSession, d: str) -> DataFrame:
    records = i.table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"))
    return relations.check_references(references(spark, d), records).select("md_file_id", "error")


SCOPES = ["dataset", "Dataset", "featureType", "style", "undefined", "other", ""]


@query("metadata_scope", f"WITH {i.sql_values([(x,) for x in SCOPES], 't', 'scope')} SELECT scope, scope IN ('dataset', 'featureType', 'style', 'undefined') AS listed FROM t")
def metadata_scope(spark: SparkSession, d: str) -> DataFrame:
    return i.texts(spark, [(x,) for x in SCOPES], "scope string").withColumn("listed", names.metadata_scope_listed(F.col("scope")))


@query("constraint_range", "SELECT l_orderkey, l_linenumber, l_discount >= 0.02 AND l_discount <= 0.07 AS cc, l_discount >= 0.02 AND l_discount < 0.07 AS co, l_discount > 0.02 AND l_discount <= 0.07 AS oc, l_discount > 0.02 AND l_discount < 0.07 AS oo FROM lineitem")
def constraint_range(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("l_discount")
    kinds = {"cc": (True, True), "co": (True, False), "oc": (False, True), "oo": (False, False)}
    return i.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[constraints.in_range(v, 0.02, 0.07, *k).alias(n) for n, k in kinds.items()])


@query("constraint_enum", "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS text_ok, CAST(o_orderkey % 12 AS VARCHAR) IN ('1', '3', '5', '10') AS int_ok FROM orders")
def constraint_enum(spark: SparkSession, d: str) -> DataFrame:
    df = i.table(spark, d, "orders")
    return df.select("o_orderkey", constraints.in_enum(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("text_ok"), constraints.in_enum(F.col("o_orderkey") % 12, ["1", "3", "5", "10"], "bigint").alias("int_ok"))


@query("constraint_glob", "SELECT p_partkey, p_brand GLOB 'Brand#[1-3]' AS ok, p_type GLOB '*A?*' AS type_ok FROM part")
def constraint_glob(spark: SparkSession, d: str) -> DataFrame:
    return i.table(spark, d, "part").select("p_partkey", constraints.matches_glob(F.col("p_brand"), "Brand#[1-3]").alias("ok"), constraints.matches_glob(F.col("p_type"), "*A?*").alias("type_ok"))


@query("constraint_enforce", "SELECT p_partkey, list_filter([CASE WHEN NOT (p_size BETWEEN 5 AND 30) THEN 'p_size' END, CASE WHEN NOT (p_brand IN ('Brand#1', 'Brand#2')) THEN 'p_brand' END], lambda x: x IS NOT NULL)::VARCHAR AS violations FROM part")
def constraint_enforce(spark: SparkSession, d: str) -> DataFrame:
    df = relations.enforce(i.table(spark, d, "part"), {"p_size": {"kind": "range", "low": 5, "high": 30}, "p_brand": {"kind": "enum", "members": ["Brand#1", "Brand#2"]}})
    return df.select("p_partkey", F.concat(F.lit("["), F.array_join("violations", ", "), F.lit("]")).alias("violations"))


EXTENSION_NAMES = {
    "gpkg_rtree_index": "implemented", "gpkg_zoom_other": "implemented", "gpkg_webp": "implemented", "gpkg_metadata": "implemented", "gpkg_schema": "implemented", "gpkg_crs_wkt": "implemented", "gpkg_crs_wkt_1_1": "implemented",
    "related_tables": "implemented", "gpkg_related_tables": "implemented", "gpkg_geom_CURVE": "implemented", "gpkg_geom_curvepolygon": "implemented", "gpkg_geom_POINT": "unrecognised", "gpkg_geom_": "unrecognised",
    "gpkg_2d_gridded_coverage": "known", "gdal_aspatial": "known", "gpkg_srs_id_trigger": "removed", "gpkg_geometry_type_trigger": "removed", "GPKG_WEBP": "unrecognised", "acme_x": "unrecognised",
}


@query("extension_classify", f"WITH {i.sql_values(list(EXTENSION_NAMES.items()), 't', 'extension_name, support')} SELECT * FROM t")
def extension_classify(spark: SparkSession, d: str) -> DataFrame:
    return i.texts(spark, [(x,) for x in EXTENSION_NAMES], "extension_name string").withColumn("support", names.extension_support(F.col("extension_name")))


@query("srs_utm", "WITH c AS (SELECT range AS code FROM range(32590, 32770)), z AS (SELECT code, code BETWEEN 32601 AND 32660 AS n, code BETWEEN 32601 AND 32660 OR code BETWEEN 32701 AND 32760 AS ok FROM c) SELECT code, CASE WHEN ok THEN 'WGS 84 / UTM zone ' || (code % 100) || CASE WHEN n THEN 'N' ELSE 'S' END END AS name, CASE WHEN ok THEN CAST(code % 100 * 6 - 183 AS INTEGER) END AS central_meridian, CASE WHEN ok THEN CASE WHEN n THEN 0 ELSE 10000000 END END AS false_northing FROM z")
def srs_utm(spark: SparkSession, d: str) -> DataFrame:
    z = names.utm_zone(F.col("code"))
    return spark.range(32590, 32770).select(F.col("id").alias("code")).select("code", *[z[c].alias(c) for c in ("name", "central_meridian", "false_northing")])


WKT = [('GEOGCRS["WGS 84",DATUM["x"]]', 4326, "WGS 84"), ("undefined", 7, "EPSG:7"), ('X[""]', 8, "EPSG:8"), (None, 9, "EPSG:9"), ('X["open', 10, "EPSG:10")]


@query("srs_name", f"WITH {i.sql_values([(w, c, n) for w, c, n in WKT], 't', 'wkt, code, name')} SELECT code, name FROM t")
def srs_name(spark: SparkSession, d: str) -> DataFrame:
    df = i.texts(spark, [(w, c) for w, c, _ in WKT], "wkt string, code int")
    return df.select("code", names.srs_name(F.col("wkt"), F.col("code")).alias("name"))


@query("crs_code", "WITH t(metadata, code) AS (VALUES ('{\"crs\": {\"id\": {\"authority\": \"EPSG\", \"code\": 3857}}}', 3857), ('{\"crs\": \"EPSG:4326\"}', 4326), ('{}', NULL), ('{\"crs\": {\"base_crs\": {\"id\": {\"code\": 1}}}}', NULL)) SELECT * FROM t")
def crs_code(spark: SparkSession, d: str) -> DataFrame:
    texts = ['{"crs": {"id": {"authority": "EPSG", "code": 3857}}}', '{"crs": "EPSG:4326"}', "{}", '{"crs": {"base_crs": {"id": {"code": 1}}}}']
    return i.texts(spark, [(t,) for t in texts], "metadata string").withColumn("code", names.crs_code(F.col("metadata")))


STATUS = [(t, g, "absent" if not t and g == "none" else "current" if t and g == "v1_4" else "legacy" if t and g in ("pre_v1_4", "mixed") else "stale") for t in (True, False) for g in ("none", "v1_4", "pre_v1_4", "mixed")]


@query("index_status", f"WITH {i.sql_values(STATUS, 't', 'has_table, generation, status')} SELECT * FROM t")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    suffixes = {"none": ["insert", "delete"], "v1_4": ["insert", "update2", "update6"], "pre_v1_4": ["update1", "update2"], "mixed": ["update3", "update7"]}
    rows = [(t, ",".join(suffixes[g])) for t, g, _ in STATUS]
    df = i.texts(spark, rows, "has_table boolean, suffixes string").withColumn("generation", names.trigger_generation(F.split("suffixes", ",")))
    return df.select("has_table", "generation", names.index_status(F.col("has_table"), F.col("generation")).alias("status"))


PRAGMAS = [(1196437808, 0, "1.0"), (1196437809, 5, "1.1"), (1196444487, 10200, "1.2"), (1196444487, 10299, "1.2"), (1196444487, 10301, "1.3"), (1196444487, 10400, "1.4"), (1196444487, 99999, "1.4"), (1196444487, 10100, None), (0, 10400, None)]


@query("version_classify", f"WITH {i.sql_values(PRAGMAS, 't', 'application_id, user_version, version')} SELECT * FROM t")
def version_classify(spark: SparkSession, d: str) -> DataFrame:
    df = i.texts(spark, [p[:2] for p in PRAGMAS], "application_id int, user_version int")
    return df.withColumn("version", names.version(F.col("application_id"), F.col("user_version")))


@query("contents_layers", "SELECT upper(n_name) AS table_name FROM nation WHERE n_nationkey % 4 <> 1 AND n_nationkey % 5 <> 0")
def contents_layers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    nation = i.table(spark, d, "nation")
    contents = nation.select(F.upper("n_name").alias("table_name"), F.when(k % 4 == 1, "tiles").otherwise("features").alias("data_type"))
    geometry = nation.where(k % 5 != 0).select(F.lower("n_name").alias("table_name"))
    return container.feature_layers(contents, geometry.union(geometry))


@query("open_warnings", "SELECT 'case differs: ' || n_name AS warning FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT 'no geometry column: ' || n_name FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'extension: acme_x'")
def open_warnings(spark: SparkSession, d: str) -> DataFrame:
    nation = i.table(spark, d, "nation")
    contents = nation.select(F.col("n_name").alias("table_name"), F.lit("features").alias("data_type"))
    geometry = nation.where("n_nationkey % 5 <> 0").select(F.lower("n_name").alias("table_name"))
    extensions = i.texts(spark, [("acme_x",), ("gpkg_webp",)], "extension_name string")
    listed = sorted(r[0] if r[1] % 6 else r[0].lower() for r in nation.select("n_name", "n_nationkey").collect())  # the catalogue's own tables: 25
    return container.open_warnings(contents, geometry, extensions, listed)


@query("findings_by_severity", """SELECT 'error' AS severity, (SELECT count(*) FROM nation WHERE n_nationkey % 8 = 0) + (SELECT count(*) FROM nation WHERE n_nationkey % 9 = 3) + (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0) AS n
UNION ALL SELECT 'warning', (SELECT count(*) FROM nation WHERE n_nationkey % 8 <> 0 AND n_nationkey % 6 = 1) + 2 + (SELECT count(*) FROM nation WHERE n_nationkey % 9 = 2) UNION ALL SELECT 'advisory', (SELECT count(*) FROM nation WHERE n_nationkey % 9 = 1)""")
def findings_by_severity(spark: SparkSession, d: str) -> DataFrame:
    k, nation = F.col("n_nationkey"), i.table(spark, d, "nation")
    contents = nation.select(F.col("n_name").alias("table_name"))
    there = nation.where(k % 8 != 0).select(F.when(k % 6 == 1, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"))
    status = F.when(k % 9 == 1, "absent").when(k % 9 == 2, "legacy").otherwise("current")
    indexes = nation.select(F.col("n_name").alias("table_name"), status.alias("status"), (k % 9 != 3).alias("is_consistent"))
    extensions = i.texts(spark, [("acme_x", "t"), ("gpkg_srs_id_trigger", None), ("gpkg_webp", None)], "extension_name string, table_name string")
    records = i.table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"))
    return validate.by_severity(validate.validate(contents=contents, tables=there, extensions=extensions, indexes=indexes, references=references(spark, d), records=records))


@query("upsert_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    df = i.table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return pyramid.latest(df, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id", "value")


@query("partial_update", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'changed' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, c_acctbal FROM customer")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    old = i.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    changes = old.where("c_custkey % 4 = 0").select("c_custkey", F.concat(F.lit("changed"), F.col("c_custkey").cast("string")).alias("c_name"), F.lit(None).cast("int").alias("c_nationkey"))
    return container.partial_update(old, changes, "c_custkey")


@query("layer_roundtrip", f"WITH {i.P_SQL} SELECT fid, c_name, c_acctbal, x AS minx, x AS maxx, y AS miny, y AS maxy, false AS geom_empty FROM p WHERE x BETWEEN -100 AND 50 AND y BETWEEN -30 AND 60")
def layer_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from terrane.functions.binary import body, with_header_envelope

    box = container.Container.create(spark, scratch(spark, "container"))
    spec = container.TableSpec("places", [container.ColumnSpec("c_name", "TEXT"), container.ColumnSpec("c_acctbal", "DOUBLE")], container.GeometrySpec("POINT", 4326))
    box.create_table(spec)
    blobs = i.points(spark, d).select("fid", "c_name", "c_acctbal", codec.encode_points(4326)(F.col("x"), F.col("y")).alias("geom"))
    box.insert("places", blobs.withColumn("geom", body(F.col("geom"))))
    read = container.Container.open(spark, box.path).layer("Places")
    rows = read.df.where("minx <= 50 AND maxx >= -100 AND miny <= 60 AND maxy >= -30").drop("minx", "maxx", "miny", "maxy")
    return with_header_envelope(rows, "geom").select("fid", "c_name", "c_acctbal", "minx", "maxx", "miny", "maxy", "geom_empty")
