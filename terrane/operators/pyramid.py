"""Tile pyramids: matrices by zoom and tiles (zoom_level, tile_column, tile_row, tile_data)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import grid, images
from terrane.operators.layer import BoundingBox, LayerError

ADDRESS = ("zoom_level", "tile_column", "tile_row")
ORDER = ("zoom_level", "tile_row", "tile_column")


@dataclass(frozen=True)
class Pyramid:
    extent: grid.Extent
    matrices: DataFrame
    tiles: DataFrame

    def cursor(self) -> DataFrame:
        """The whole pyramid in matrix order."""
        return self.tiles.orderBy(*ORDER)

    def cursor_at(self, zoom: int) -> DataFrame:
        return self.tiles.where(F.col("zoom_level") == zoom).orderBy(*ORDER)

    def matrix(self, zoom: int) -> dict:
        row = self.matrices.where(F.col("zoom_level") == zoom).first()
        if row is None:
            raise LayerError(f"no zoom level {zoom}")
        return row.asDict()

    def cursor_in(self, zoom: int, box: BoundingBox) -> DataFrame:
        """Tiles of a zoom that the box touches, in matrix order: plain ranges that reach the scan; none for a miss, LayerError for an unknown zoom."""
        m = self.matrix(zoom)
        span_x, span_y = m["pixel_x_size"] * m["tile_width"], m["pixel_y_size"] * m["tile_height"]
        e = self.extent
        if box.min_x > box.max_x or box.min_y > box.max_y or box.max_x < e.min_x or box.min_x > e.max_x or box.max_y < e.min_y or box.min_y > e.max_y:
            return self.tiles.where("false")

        def index(distance: float, size: float, count: int) -> int:
            return int(max(0, min(distance // size, count - 1)))

        columns = [index(max(e.min_x, min(e.max_x, x)) - e.min_x, span_x, m["matrix_width"]) for x in (box.min_x, box.max_x)]
        rows = [index(e.max_y - max(e.min_y, min(e.max_y, y)), span_y, m["matrix_height"]) for y in (box.max_y, box.min_y)]
        near = (F.col("zoom_level") == zoom) & F.col("tile_column").between(*columns) & F.col("tile_row").between(*rows)
        return self.tiles.where(near).orderBy(*ORDER)

    def get(self, zoom: int, column: int, row: int) -> DataFrame:
        return self.tiles.where((F.col("zoom_level") == zoom) & (F.col("tile_column") == column) & (F.col("tile_row") == row))

    def lookup(self, addresses: DataFrame) -> DataFrame:
        """addresses with tile_data, null where there is no tile."""
        return addresses.join(self.tiles.select(*ADDRESS, "tile_data"), list(ADDRESS), "left")

    def counts(self) -> DataFrame:
        return self.tiles.groupBy("zoom_level").agg(F.count(F.lit(1)).alias("n"))

    def zoom_levels(self) -> DataFrame:
        return self.matrices.select("zoom_level").orderBy("zoom_level")

    def faults(self) -> DataFrame:
        return grid.matrix_faults(self.matrices, self.extent).where("fault IS NOT NULL")

    def checked(self, new: DataFrame) -> DataFrame:
        """new tiles with `error`: an unknown zoom, an address outside the grid, a PNG, JPEG, WebP or TIFF whose size is not the zoom's or can't be read."""
        m = self.matrices.select("zoom_level", "matrix_width", "matrix_height", "tile_width", "tile_height")
        both = new.join(F.broadcast(m), "zoom_level", "left")  # one row a zoom: tens at most
        both = both.withColumn("_size", images.probes()(F.col("tile_data")))
        outside = ~grid.contains(F.col("matrix_width"), F.col("matrix_height"), F.col("tile_column"), F.col("tile_row"))
        wrong = F.col("_size").isNotNull() & ~grid.payload_fits(F.col("_size"), F.col("tile_width"), F.col("tile_height"))
        broken = F.col("_size").isNull() & images.looks_like_one(F.col("tile_data"))
        error = F.when(F.col("matrix_width").isNull(), "unknown zoom").when(outside, "outside the grid").when(wrong, "payload size").when(broken, "payload")
        return both.withColumn("error", error).select(*new.columns, "error")

    def put(self, new: DataFrame, order: Column | None = None) -> Pyramid:
        """Tiles after an upsert by address; among several new ones the last by `order` counts."""
        return Pyramid(self.extent, self.matrices, upsert(self.tiles, new, list(ADDRESS), order))

    def delete(self, addresses: DataFrame) -> Pyramid:
        return Pyramid(self.extent, self.matrices, self.tiles.join(addresses.select(*ADDRESS), list(ADDRESS), "left_anti"))


def tiles_of(points: DataFrame, extent: grid.Extent, matrices: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """points once for each matrix, with the tile that each falls in; a point outside has a null tile.  Matrices are broadcast: one row a zoom."""
    both = points.join(F.broadcast(matrices))
    at = grid.tile_at(extent, grid.span(F.col("pixel_x_size"), F.col("tile_width")), grid.span(F.col("pixel_y_size"), F.col("tile_height")), F.col("matrix_width"), F.col("matrix_height"), F.col(x), F.col(y))
    return both.withColumn("_t", at).withColumn("tile_column", F.col("_t.tile_column")).withColumn("tile_row", F.col("_t.tile_row")).drop("_t")


def latest(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key by `order`: a maximum of structs, which combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max(F.struct(order.alias("_order"), *rest)).alias("_l")).select(*[F.col(c) if c in key else F.col(f"_l.{c}").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """old with new in place of rows of equal key, and added."""
    if order is not None:
        new = latest(new, key, order)
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def number_in_group(df: DataFrame, key: list[str], order: list[Column], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
