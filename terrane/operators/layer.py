"""Feature and attribute layers over DataFrames.

A feature layer has an id, value columns, a geometry blob and sidecar columns minx, maxx, miny, maxy, geom_empty,
which are computed once when the layer is written.  Box filters are plain comparisons of sidecar columns
with literals, so they reach the Parquet scan; geometry bytes are read only if they are selected.  A null or
empty geometry never matches a box, and bounds are inclusive.
"""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import codec, names, types
from terrane.functions.binary import body
from terrane.operators.shared import settled

SIDECAR = ("minx", "maxx", "miny", "maxy")


class LayerError(ValueError):
    """A layer, column or table that isn't there or is of another kind."""


@dataclass(frozen=True)
class BoundingBox:
    min_x: float
    min_y: float
    max_x: float
    max_y: float

    def overlaps(self, minx: Column, maxx: Column, miny: Column, maxy: Column) -> Column:
        """The predicate itself: false for null or NaN bounds; NaN sorts above every number in Spark, so maxima are bounded too."""
        number = ~(F.isnan(minx) | F.isnan(maxx) | F.isnan(miny) | F.isnan(maxy))
        return F.coalesce((minx <= self.max_x) & (maxx >= self.min_x) & (miny <= self.max_y) & (maxy >= self.min_y) & number, F.lit(False))


def clean_sidecar(df: DataFrame) -> DataFrame:
    """NaN bounds made null: NaN never reaches a comparison, a minimum or a maximum."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in SIDECAR})


@dataclass(frozen=True)
class Layer:
    """df with roles: `fid` the id, `geom` the geometry (None for attributes); `columns` the projection."""

    df: DataFrame
    fid: str = "fid"
    geom: str | None = "geom"
    columns: tuple[str, ...] | None = None
    srs_id: int = 0
    predicate: Column | None = field(default=None, compare=False)

    @property
    def value_columns(self) -> list[str]:
        hidden = {self.fid, self.geom, *SIDECAR, "geom_empty", "geom_type", "dims"}
        return [c for c in self.df.columns if c not in hidden]

    @property
    def has_sidecar(self) -> bool:
        return set(SIDECAR) <= set(self.df.columns)

    def with_columns(self, *names: str) -> Layer:
        """Only these value columns, in table order, and the geometry if it is named; LayerError for an unknown name."""
        able = [c for c in self.df.columns if c in self.value_columns or c == self.geom]
        if unknown := sorted(set(names) - set(able)):
            raise LayerError(f"no such column: {', '.join(unknown)}")
        return replace(self, columns=tuple(c for c in able if c in names))

    def without_geometry(self) -> Layer:
        return replace(self, columns=tuple(c for c in (self.columns or self.value_columns) if c != self.geom))

    def _where(self, test: Column) -> Layer:
        return replace(self, predicate=test if self.predicate is None else self.predicate & test)

    def features_in(self, box: BoundingBox) -> Layer:
        """Rows whose envelope meets the box: by sidecar columns where there are any, else decoded from the blob."""
        if self.geom is None:
            raise LayerError("an attribute layer has no geometry")
        if self.has_sidecar:
            plain = (F.col("minx") <= box.max_x) & (F.col("maxx") >= box.min_x) & (F.col("miny") <= box.max_y) & (F.col("maxy") >= box.min_y)
            return self._where(plain)
        e = codec.envelopes()(F.col(self.geom))
        return self._where(box.overlaps(e["minx"], e["maxx"], e["miny"], e["maxy"]))

    def select(self, where: str, **params) -> Layer:
        """Rows for which trusted SQL holds; :name in it, outside of quotes, stands for a parameter, which becomes a typed literal."""
        return self._where(F.expr(bound(where, params)))

    def rows(self) -> DataFrame:
        """The id and the projected columns of the rows that are left."""
        kept = self.df if self.predicate is None else self.df.where(self.predicate)
        names = self.columns if self.columns is not None else [c for c in self.df.columns if c in self.value_columns or c == self.geom]
        return kept.select(self.fid, *names)

    features = rows

    def explain(self) -> str:
        return self.rows()._jdf.queryExecution().toString()

    def geometry(self) -> DataFrame:
        """The id and the geometry; LayerError if the projection left it out."""
        if self.geom is None or (self.columns is not None and self.geom not in self.columns):
            raise LayerError("the geometry isn't projected")
        return self.rows().select(self.fid, self.geom)

    def column_values(self, name: str) -> DataFrame:
        if name == self.geom:
            raise LayerError(f"{name} is the geometry")
        return self.with_columns(name).rows().select(name)

    def ordered(self) -> DataFrame:
        """Rows in id order, as a columnar read gives them."""
        return self.rows().orderBy(self.fid)

    def arrow_schema(self) -> pa.Schema:
        """The projection's Arrow schema; the geometry is a GeoArrow field of WKB with its reference system."""
        from pyspark.sql.pandas.types import to_arrow_schema

        plain = to_arrow_schema(self.rows().schema)
        if self.geom is None or self.geom not in plain.names:
            return plain
        marks = {"ARROW:extension:name": "geoarrow.wkb", "ARROW:extension:metadata": names.crs_metadata(self.srs_id)}
        at = plain.get_field_index(self.geom)
        return plain.set(at, pa.field(self.geom, pa.binary(), metadata=marks))

    def read_arrow(self, rows: int = 8192, most_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
        """Record batches in id order, of at most `rows` rows and, where a row alone isn't larger, most_bytes; geometries as WKB.

        One partition at a time is in the driver's memory.
        """
        df = self.rows()
        if self.geom is not None and self.geom in df.columns:
            df = df.withColumn(self.geom, body(F.col(self.geom)))
        schema, waiting, size = self.arrow_schema(), [], 0
        turn = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)
        for row in df.orderBy(self.fid).toLocalIterator(prefetchPartitions=True):
            own = sum(len(v) if isinstance(v, (bytes, bytearray, str)) else 8 for v in row)
            if waiting and (len(waiting) >= rows or (most_bytes is not None and size + own > most_bytes)):
                yield turn()
                waiting, size = [], 0
            waiting.append(tuple(row))
            size += own
        if waiting:
            yield turn()

    def mistyped(self, declared: str, z: int = 2, m: int = 2) -> DataFrame:
        """The id, geom_type and `error` of geometries that a column of the declared type, with these z and m codes, may not hold."""
        code, dims = F.col("geom_type"), F.col("dims")
        error = F.when(~types.type_matches(types.geometry_code(F.lit(declared)), code), "geometry type")
        error = error.when(~(types.zm_allowed(F.lit(z), dims.isin(1, 3)) & types.zm_allowed(F.lit(m), dims.isin(2, 3))), "z or m")
        return self.df.where(code.isNotNull()).select(self.fid, "geom_type", error.alias("error")).where("error IS NOT NULL")

    def page(self, after: int, size: int) -> DataFrame:
        """The next `size` rows with an id of `after` or more, in id order."""
        return self._where(F.col(self.fid) >= after).rows().orderBy(self.fid).limit(size)

    def count(self) -> DataFrame:
        return (self.df if self.predicate is None else self.df.where(self.predicate)).agg(F.count(F.lit(1)).alias("n"))

    def measured_extent(self) -> DataFrame:
        """min_x, min_y, max_x, max_y over all geometries that are neither null nor empty; nulls if there are none."""
        return self.df.agg(*self.bounds())

    @staticmethod
    def bounds() -> list[Column]:
        """Aggregates of the sidecar columns: min_x, min_y, max_x, max_y; NaN counts as null."""
        number = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
        return [F.min(number("minx")).alias("min_x"), F.min(number("miny")).alias("min_y"), F.max(number("maxx")).alias("max_x"), F.max(number("maxy")).alias("max_y")]

    def extent(self, recorded: DataFrame | None = None) -> DataFrame:
        """The recorded bounds where all are there and in order, else the measured ones.  Never used to prune."""
        if recorded is None:
            return self.measured_extent()
        good = recorded.where("min_x <= max_x AND min_y <= max_y").select("min_x", "min_y", "max_x", "max_y").limit(1)
        return good.withColumn("_o", F.lit(0)).union(self.measured_extent().withColumn("_o", F.lit(1))).orderBy("_o").limit(1).drop("_o")

    def dense_span(self) -> DataFrame:
        """lo, hi, n and whether the ids leave no gap."""
        return self.df.agg(F.min(self.fid).alias("lo"), F.max(self.fid).alias("hi"), F.count(self.fid).alias("n")).withColumn("is_dense", F.col("hi") - F.col("lo") + 1 == F.col("n"))


#: Quoted text and names, comments, and parameters of a SQL condition, in the order in which they are looked for.
PIECES = re.compile(r"""(?P<other>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|::)|:(?P<name>[A-Za-z_]\w*)""", re.S)


def bound(where: str, params: dict) -> str:
    """A SQL condition with its parameters as literals; LayerError for one without a value, or a value without its parameter."""
    used = set()

    def literal(match: re.Match) -> str:
        name = match["name"]
        if name is None:
            return match[0]
        if name not in params:
            raise LayerError(f"no value for :{name}")
        used.add(name)
        return _literal(params[name])

    out = PIECES.sub(literal, where)
    if unused := sorted(set(params) - used):
        raise LayerError(f"no parameter :{unused[0]}")
    return out


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return str(value) if abs(value) < 1 << 31 else f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"CAST('{value}' AS DOUBLE)"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{value.hex()}'"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP'{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE'{value.isoformat()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def fold_extent(old: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Recorded boxes (key, min_x, min_y, max_x, max_y) grown by a batch's (key, minx, maxx, miny, maxy)."""
    new = clean_sidecar(batch).groupBy(*key).agg(F.min("minx").alias("x0"), F.min("miny").alias("y0"), F.max("maxx").alias("x1"), F.max("maxy").alias("y1"))
    both = old.join(new, key, "full_outer")
    return both.select(*key, F.least("min_x", "x0").alias("min_x"), F.least("min_y", "y0").alias("min_y"), F.greatest("max_x", "x1").alias("max_x"), F.greatest("max_y", "y1").alias("max_y"))


#: Levels of the join's grid; a box that no cell of the last but one holds is on the last, which has one cell.
TOP = 40


def spatial_join(features: DataFrame, boxes: DataFrame, cell: float, fid: str = "fid", box_id: str = "box_id") -> DataFrame:
    """(box_id, fid) of features whose envelope meets a box's.

    Cells of level k are cell * 2^k wide.  An envelope is dealt to the first level whose cells are as wide as
    it, where it covers four at most, and a pair meets on the higher of its two levels, whose cells the lower
    one covers as well; so an envelope of any size makes a bounded number of rows.  A pair that shares several
    cells is told by the one that holds the low corner of its overlap, so there is no distinct.  The join is a plain
    one on level and cell: adaptive execution splits a crowded cell.
    """

    def placed(df: DataFrame, own: str, prefix: str) -> DataFrame:
        a, b, c, d = (F.col(n) for n in SIDECAR)
        width = F.greatest(b - a, d - c)
        level = F.when(width <= cell, 0).when(width < cell * 2.0 ** (TOP - 1), F.ceil(F.log2(width / cell))).otherwise(TOP)
        whole = clean_sidecar(df).where(a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull())
        return whole.select(F.col(own), level.cast("int").alias(f"{prefix}level"), *[F.col(n).alias(prefix + n) for n in SIDECAR])

    def levels(df: DataFrame, prefix: str) -> list[int]:
        return sorted(r[0] for r in df.select(f"{prefix}level").distinct().collect())  # TOP + 1 at most

    def at(value: Column, level: Column) -> Column:
        return F.when(level == TOP, 0).otherwise(F.floor(value / (cell * F.pow(F.lit(2.0), level.cast("double"))))).cast("long")

    def dealt(df: DataFrame, prefix: str, others: list[int]) -> DataFrame:
        """One row for each level on which a row meets one of the other side's levels, and for each cell there."""
        own = F.col(f"{prefix}level")
        meets = F.array_distinct(F.transform(F.array(*[F.lit(k) for k in others]), lambda k: F.greatest(k, own)))
        spread = df.withColumn("level", F.explode(meets))
        for axis, low, high in (("cx", "minx", "maxx"), ("cy", "miny", "maxy")):
            spread = spread.withColumn(axis, F.explode(F.sequence(at(F.col(prefix + low), F.col("level")), at(F.col(prefix + high), F.col("level")))))
        return spread

    left, right = placed(features, fid, "f_"), placed(boxes, box_id, "b_")
    f_levels, b_levels = levels(left, "f_"), levels(right, "b_")
    if not f_levels or not b_levels:
        return left.select(fid).join(right.select(box_id)).where("false").select(box_id, fid)
    pairs = dealt(left, "f_", b_levels).join(dealt(right, "b_", f_levels), ["level", "cx", "cy"])
    meet = (F.col("f_minx") <= F.col("b_maxx")) & (F.col("f_maxx") >= F.col("b_minx")) & (F.col("f_miny") <= F.col("b_maxy")) & (F.col("f_maxy") >= F.col("b_miny"))
    corner = [at(F.greatest(f"f_{c}", f"b_{c}"), F.col("level")) for c in ("minx", "miny")]
    own = (F.col("level") == F.greatest("f_level", "b_level")) & (corner[0] == F.col("cx")) & (corner[1] == F.col("cy"))
    return pairs.where(meet & own).select(box_id, fid)


def next_fids(df: DataFrame, last: int, fid: str = "fid") -> DataFrame:
    """df with ids after `last`, gapless, in the order of its rows: counts of each partition first, then places within it, so nothing is
    sorted globally.  Rows are written once with their places, as another run could cut partitions elsewhere."""
    numbered = settled(df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = numbered.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_at")))
    return placed.join(F.broadcast(offsets), "_part").withColumn(fid, (F.col("_start") + F.col("_rank") + last).cast("long")).drop("_part", "_at", "_start", "_rank")
