"""Named functions of a geometry blob: its bounds and whether it is empty, for DataFrames and, once registered, for SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from terrane.functions import codec

#: Name of each function in SQL and the bound it gives.
BOUNDS = {"ST_MinX": "minx", "ST_MaxX": "maxx", "ST_MinY": "miny", "ST_MaxY": "maxy"}


def st_bound(name: str, blob: Column) -> Column:
    """ST_MinX and so on of a blob: null for null, an empty geometry or a malformed blob; the body is walked where the header has no envelope."""
    return codec.envelopes()(blob)[BOUNDS[name]]


def st_is_empty(blob: Column) -> Column:
    """Whether a geometry has no finite pair of coordinates, by its body if its header doesn't say so; null for null or a malformed blob."""
    return codec.emptiness()(blob)


def register(spark: SparkSession) -> None:
    """The functions by their names in SQL."""
    for name, side in BOUNDS.items():
        spark.udf.register(name, codec.bound(side))
    spark.udf.register("ST_IsEmpty", codec.emptiness())
