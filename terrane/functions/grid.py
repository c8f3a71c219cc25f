"""Tile matrix arithmetic as expressions.  Rows count south from the top edge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Half the span of the web mercator square, and the relative tolerance of extents.
HALF_SPAN, TOLERANCE = 20037508.342789244, 1e-9


@dataclass(frozen=True)
class Extent:
    """The exact extent of a tile matrix set."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float
    srs_id: int = 0

    def __post_init__(self) -> None:
        values = (self.min_x, self.min_y, self.max_x, self.max_y)
        if not (self.min_x < self.max_x and self.min_y < self.max_y) or any(abs(v) == float("inf") for v in values):
            raise ValueError(f"no tile can be measured against {values}")

    @property
    def is_web_mercator(self) -> bool:
        sides = ((self.min_x, -HALF_SPAN), (self.min_y, -HALF_SPAN), (self.max_x, HALF_SPAN), (self.max_y, HALF_SPAN))
        return self.srs_id == 3857 and all(abs(a - b) <= TOLERANCE * abs(b) for a, b in sides)


WORLD = Extent(-180.0, -90.0, 180.0, 90.0, 4326)
WEB_MERCATOR = Extent(-HALF_SPAN, -HALF_SPAN, HALF_SPAN, HALF_SPAN, 3857)


def ladder(spark: SparkSession, extent: Extent, min_zoom: int, max_zoom: int, base: tuple[int, int] = (1, 1), tile: tuple[int, int] = (256, 256)) -> DataFrame:
    """Matrices of zooms that double their grid at each step; ValueError for an empty range or one whose grid overflows."""
    if min_zoom < 0 or max_zoom < min_zoom or min(*base, *tile) <= 0 or max(base) << (max_zoom - min_zoom + 1) >= 1 << 63:
        raise ValueError(f"zooms {min_zoom} to {max_zoom} of a grid of {base} tiles of {tile}")
    steps = spark.range(min_zoom, max_zoom + 1).select(F.col("id").alias("zoom_level"))
    wide, high = (F.expr(f"shiftleft({b}L, cast(zoom_level - {min_zoom} as int))") for b in base)
    grid = steps.select("zoom_level", wide.alias("matrix_width"), high.alias("matrix_height"), F.lit(tile[0]).cast("long").alias("tile_width"), F.lit(tile[1]).cast("long").alias("tile_height"))
    pixel = lambda span, n, t: F.lit(span) / (F.col(n).cast("double") * F.col(t).cast("double"))
    return grid.withColumn("pixel_x_size", pixel(extent.max_x - extent.min_x, "matrix_width", "tile_width")).withColumn("pixel_y_size", pixel(extent.max_y - extent.min_y, "matrix_height", "tile_height"))


def span(pixel: Column, size: Column) -> Column:
    """Ground extent of one tile along an axis."""
    return pixel * size.cast("double")


def tile_bounds(extent: Extent, span_x: Column, span_y: Column, column: Column, row: Column) -> Column:
    """min_x, min_y, max_x, max_y of a tile, inside the grid or not."""
    left, top = F.lit(extent.min_x) + column.cast("double") * span_x, F.lit(extent.max_y) - row.cast("double") * span_y
    return F.struct(left.alias("min_x"), (top - span_y).alias("min_y"), (left + span_x).alias("max_x"), top.alias("max_y"))


def _index(distance: Column, size: Column, count: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(distance / size), count - 1)).cast("long")


def tile_at(extent: Extent, span_x: Column, span_y: Column, width: Column, height: Column, x: Column, y: Column) -> Column:
    """tile_column and tile_row of a position, its edges included; null outside the extent."""
    inside = (x >= extent.min_x) & (x <= extent.max_x) & (y >= extent.min_y) & (y <= extent.max_y)
    return F.when(inside, F.struct(_index(x - extent.min_x, span_x, width).alias("tile_column"), _index(extent.max_y - y, span_y, height).alias("tile_row")))


def tile_range(extent: Extent, span_x: Column, span_y: Column, width: Column, height: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """min_column, max_column, min_row, max_row that a box touches; null for an inverted box or one outside."""
    ordered = (min_x <= max_x) & (min_y <= max_y)
    apart = (max_x < extent.min_x) | (min_x > extent.max_x) | (max_y < extent.min_y) | (min_y > extent.max_y)
    # Indices are clamped to the grid, so a box that sticks out needs no cutting.
    columns = {f"{side}_column": _index(x - extent.min_x, span_x, width) for side, x in (("min", min_x), ("max", max_x))}
    rows = {f"{side}_row": _index(extent.max_y - y, span_y, height) for side, y in (("min", max_y), ("max", min_y))}
    return F.when(ordered & ~apart, F.struct(*[c.alias(n) for n, c in {**columns, **rows}.items()]))


def contains(width: Column, height: Column, column: Column, row: Column) -> Column:
    return (column >= 0) & (column < width) & (row >= 0) & (row < height)


def flip_row(height: Column, row: Column) -> Column:
    """Between rows counted from the top and from the bottom; its own inverse."""
    return height - 1 - row


def xyz_tile(extent: Extent, zoom: Column, width: Column, height: Column, z: Column, x: Column, y: Column) -> Column:
    """tile_column and tile_row of an XYZ address; null unless the grid is the web mercator square of 2^zoom and the address is inside."""
    side = F.when((zoom >= 0) & (zoom < 63), F.pow(F.lit(2.0), zoom.cast("double")).cast("long"))
    quad = F.lit(extent.is_web_mercator) & (width == side) & (height == side) & (zoom == z)
    return F.when(quad & contains(width, height, x, y), F.struct(x.cast("long").alias("tile_column"), y.cast("long").alias("tile_row")))


def tile_xyz(extent: Extent, zoom: Column, width: Column, height: Column, column: Column, row: Column) -> Column:
    """z, x and y of a tile of the web mercator square of 2^zoom; null for another grid or a tile outside of it: the inverse of xyz_tile()."""
    at = xyz_tile(extent, zoom, width, height, zoom, column, row)
    return F.when(at.isNotNull(), F.struct(zoom.cast("long").alias("z"), at["tile_column"].alias("x"), at["tile_row"].alias("y")))


def payload_fits(size: Column, tile_width: Column, tile_height: Column) -> Column:
    """Whether a payload's size (struct of width and height) is the zoom's tile size."""
    return (size["width"] == tile_width) & (size["height"] == tile_height)


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= TOLERANCE * F.greatest(F.abs(a), F.abs(b))


def matrix_faults(matrices: DataFrame, extent: Extent, table: str | None = None) -> DataFrame:
    """matrices with `fault`, the first rule each breaks: sign of zoom, positive sizes, span, distinct zooms, shrinking pixels; null if none."""
    order = Window.partitionBy(*([table] if table else [])).orderBy("zoom_level")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) <= 0) | (F.col(c) == float("inf"))
    spans = lambda n, t, p: F.col(n).cast("double") * F.col(t).cast("double") * F.col(p)
    fault = F.when(F.col("zoom_level") < 0, "negative zoom")
    for c in ("matrix_width", "matrix_height", "tile_width", "tile_height"):
        fault = fault.when(F.col(c) <= 0, f"{c} not positive")
    for c in ("pixel_x_size", "pixel_y_size"):
        fault = fault.when(bad(c), f"{c} not positive")
    fault = fault.when(~_near(F.lit(extent.max_x - extent.min_x), spans("matrix_width", "tile_width", "pixel_x_size")), "x span differs")
    fault = fault.when(~_near(F.lit(extent.max_y - extent.min_y), spans("matrix_height", "tile_height", "pixel_y_size")), "y span differs")
    fault = fault.when(F.lag("zoom_level").over(order) == F.col("zoom_level"), "duplicate zoom")
    for c in ("pixel_x_size", "pixel_y_size"):
        fault = fault.when(F.col(c) >= F.lag(c).over(order), f"{c} not descending")
    return matrices.withColumn("fault", fault)


def is_power_of_two(matrices: DataFrame, table: str) -> DataFrame:
    """(table, is_ladder): whether each zoom's pixels are half of the zoom's before; true for fewer than two."""
    order = Window.partitionBy(table).orderBy("zoom_level")
    halves = F.lit(True)
    for c in ("pixel_x_size", "pixel_y_size"):
        halves = halves & F.coalesce(_near(F.lag(c).over(order) / 2, F.col(c)), F.lit(True))
    return matrices.withColumn("_half", halves).groupBy(table).agg(F.every("_half").alias("is_ladder"))
