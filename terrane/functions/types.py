"""Declared types, storage affinity and geometry type names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Geometry type names in the order of their WKB codes, and the declared types with the Spark type of each.
GEOMETRY_TYPES = ["GEOMETRY", "POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION", "CIRCULARSTRING", "COMPOUNDCURVE", "CURVEPOLYGON", "MULTICURVE", "MULTISURFACE", "CURVE", "SURFACE"]
COLLECTIONS = ["GEOMETRYCOLLECTION", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "MULTICURVE", "MULTISURFACE"]
DECLARED = {
    "BOOLEAN": T.BooleanType(),
    "TINYINT": T.LongType(),
    "SMALLINT": T.LongType(),
    "MEDIUMINT": T.LongType(),
    "INT": T.LongType(),
    "INTEGER": T.LongType(),
    "FLOAT": T.DoubleType(),
    "DOUBLE": T.DoubleType(),
    "REAL": T.DoubleType(),
    "TEXT": T.StringType(),
    "BLOB": T.BinaryType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampType(),
}
Z_M_FLAGS = {0: "prohibited", 1: "mandatory", 2: "optional"}


def column_type(declared: Column) -> Column:
    """The canonical name of a declared type: trimmed, upper case, an integer length kept on TEXT and BLOB; null outside the vocabulary."""
    name = F.upper(F.trim(declared))
    sized = F.regexp_extract(name, r"^(TEXT|BLOB)\s*\(\s*([0-9]+)\s*\)$", 1)
    length = F.regexp_extract(name, r"^(TEXT|BLOB)\s*\(\s*([0-9]+)\s*\)$", 2)
    return F.when(name.isin(*DECLARED, *GEOMETRY_TYPES), name).when(sized != "", F.concat(sized, F.lit("("), length, F.lit(")")))


def affinity(declared: Column) -> Column:
    """integer, text, blob or real: SQLite's rules for a type outside the vocabulary, in their order."""
    name = F.upper(declared)
    return F.when(name.contains("INT"), "integer").when(name.rlike("CHAR|CLOB|TEXT"), "text").when(name.contains("BLOB") | (F.trim(name) == ""), "blob").otherwise("real")


def spark_type(declared: str) -> T.DataType:
    """The Spark type of a declared type, by name, else by affinity; geometry is binary."""
    name = re.sub(r"\s*\(.*", "", declared.strip().upper())
    if name in DECLARED and (name == declared.strip().upper() or name in ("TEXT", "BLOB")):
        return DECLARED[name]
    if declared.strip().upper() in GEOMETRY_TYPES:
        return T.BinaryType()
    whole = declared.upper()
    if "INT" in whole:
        return T.LongType()
    if re.search("CHAR|CLOB|TEXT", whole):
        return T.StringType()
    return T.BinaryType() if "BLOB" in whole or not whole.strip() else T.DoubleType()


def declared_type(kind: T.DataType) -> str:
    """The declared type for a Spark type; ValueError for one that has none."""
    names = {T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "MEDIUMINT", T.LongType: "INTEGER", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "TEXT", T.BinaryType: "BLOB", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampType: "DATETIME", T.TimestampNTZType: "DATETIME"}
    if type(kind) not in names:
        raise ValueError(f"no declared type for {kind.simpleString()}")
    return names[type(kind)]


def geometry_code(name: Column) -> Column:
    """The WKB base code of a geometry type name in any case; null if there is none."""
    at = F.array_position(F.array(*[F.lit(x) for x in GEOMETRY_TYPES]), F.upper(name))
    return F.when(at > 0, at - 1).cast("int")


def type_matches(declared_code: Column, code: Column) -> Column:
    """Whether a geometry of a base code may stand in a column declared so: equal, any in GEOMETRY, a collection in GEOMETRYCOLLECTION."""
    collections = [GEOMETRY_TYPES.index(x) for x in COLLECTIONS]
    return (declared_code == code) | (declared_code == 0) | ((declared_code == GEOMETRY_TYPES.index("GEOMETRYCOLLECTION")) & code.isin(*collections))


def zm_allowed(flag: Column, present: Column) -> Column:
    """z or m flag against whether the geometry has the dimension: 0 prohibits, 1 demands, 2 leaves open."""
    return F.when(flag == 0, ~present).when(flag == 1, present).when(flag == 2, F.lit(True))
