"""Standard derivations of layers, tiles and texts from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import codec
from terrane.functions.binary import body, with_header_envelope
from terrane.operators.container import ColumnSpec, Container, GeometrySpec, TableSpec
from terrane.operators.layer import Layer
from terrane.operators.shared import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def point_columns(key: str) -> tuple:
    k = F.col(key)
    return ((k % 3600) / F.lit(10.0) - 180.0).alias("x"), (((k * 7) % 1800) / F.lit(10.0) - 90.0).alias("y")


#: The same derivation in SQL; {k} is the key.
POINT_SQL = "CAST({k} % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) AS x, CAST(({k} * 7) % 1800 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(90 AS DOUBLE) AS y"
P_SQL = f"p AS (SELECT c_custkey AS fid, c_name, c_acctbal, c_mktsegment, c_nationkey, {POINT_SQL.format(k='c_custkey')} FROM customer)"
PO_SQL = f"po AS (SELECT o_orderkey AS fid, {POINT_SQL.format(k='o_orderkey')} FROM orders)"
PS_SQL = f"ps AS (SELECT s_suppkey AS fid, {POINT_SQL.format(k='s_suppkey')} FROM supplier)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as fid, values, x, y."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fid"), "c_name", "c_acctbal", "c_mktsegment", "c_nationkey", *point_columns("c_custkey"))


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fid"), *point_columns("o_orderkey"))


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fid"), *point_columns("s_suppkey"))


def with_sidecar(df: DataFrame, blob: str = "geom") -> DataFrame:
    """df with minx, maxx, miny, maxy decoded from the blob's header, in the JVM."""
    return with_header_envelope(df, blob)


def point_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points with geom and sidecar columns, made as they are read."""
    encoded = points(spark, sf_dir).withColumn("geom", codec.encode_points(4326)(F.col("x"), F.col("y")))
    return with_sidecar(encoded)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, spec: TableSpec, rows: Callable[[], DataFrame]) -> Layer:
    """A layer at rest: rows() are written once in an application to a container in the shared folder, and read from there."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        box = Container.create(spark, scratch(spark, "container"))
        box.create_table(spec)
        box.insert(spec.name, rows())
        _STORED[key] = box.path
    return Container.open(spark, _STORED[key]).layer(spec.name)


def stored_box(spark: SparkSession, sf_dir: str, name: str) -> Container:
    """The container of stored points."""
    stored_points(spark, sf_dir)
    return Container.open(spark, _STORED[spark.sparkContext.applicationId, sf_dir, name])


POINT_COLUMNS = [ColumnSpec("c_name", "TEXT"), ColumnSpec("c_acctbal", "DOUBLE"), ColumnSpec("c_mktsegment", "TEXT"), ColumnSpec("c_nationkey", "INT"), ColumnSpec("x", "DOUBLE"), ColumnSpec("y", "DOUBLE")]


def stored_points(spark: SparkSession, sf_dir: str) -> Layer:
    """points as a layer of a container."""
    made = lambda: points(spark, sf_dir).withColumn("geom", body(codec.encode_points(4326)(F.col("x"), F.col("y"))))
    return stored(spark, sf_dir, "points", TableSpec("points", POINT_COLUMNS, GeometrySpec("POINT", 4326)), made)


def texts(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A small literal table as a relation of the session, without a Python round trip."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = [c.strip().split(" ")[1] for c in schema.split(",")]
    rows = [F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(row, names, kinds, strict=True)]) for row in values]
    return spark.range(1).select(F.inline(F.array(*rows)))


def sql_values(values: list, name: str, columns: str) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    rows = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in values)
    return f"{name}({columns}) AS (VALUES {rows})"
