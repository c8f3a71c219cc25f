"""Hilbert keys, outward rounding to floats, packed tree levels and key runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.shared import ranged

# Bits of a Hilbert axis, bytes of a tree cell and node header, the rounding step of the index, the gap that runs may bridge.
BITS, CELL, NODE_HEADER, STEP, GAP = 16, 24, 4, 1.0 / 8388608.0, 64


def grid_cell(value: Column, low: Column, high: Column) -> Column:
    """A coordinate's cell of 2^16 over [low, high]; 0 where that is empty or the value isn't finite."""
    side = (1 << BITS) - 1
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    broken = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (high <= low)
    return F.when(broken, F.lit(0)).otherwise(F.floor(share * side)).cast("long")


def _turns() -> list[int]:
    """For each of four ways that the curve lies (flipped, swapped) and two bits of x and y each: 16 times the way after them, plus their four bits of the position."""
    out = []
    for way in range(4):
        for bits in range(16):
            flip, swap, at = way >> 1, way & 1, 0
            for k in (1, 0):
                rx, ry = (bits >> 2 + k & 1) ^ flip, (bits >> k & 1) ^ flip
                rx, ry = (ry, rx) if swap else (rx, ry)
                at = at * 4 + (3 * rx ^ ry)
                if not ry:
                    flip, swap = flip ^ rx, swap ^ 1
            out.append((flip * 2 + swap) * 16 + at)
    return out


def hilbert(x: Column, y: Column) -> Column:
    """Position on the Hilbert curve of a cell (x, y) of the 2^16 grid, two bits of each at a time through a table, so that it is compiled; x and y had best be plain columns."""
    table, way, key = F.array(*[F.lit(t) for t in _turns()]), F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(BITS - 2, -1, -2):
        pair = lambda v: F.shiftright(v.cast("long"), k).bitwiseAND(3)  # noqa: E731, B023
        found = table[way * 16 + pair(x) * 4 + pair(y)]
        way, key = F.shiftright(found, 4), key + F.shiftleft(found.bitwiseAND(15).cast("long"), 2 * k)
    return key


def with_hilbert(df: DataFrame, minx: str = "minx", maxx: str = "maxx", miny: str = "miny", maxy: str = "maxy", name: str = "hilbert") -> DataFrame:
    """df with the Hilbert key of each box's centre over the extent of all centres; the extent is one row, joined by broadcast."""
    cx, cy = (F.col(minx) + F.col(maxx)) / 2, (F.col(miny) + F.col(maxy)) / 2
    extent = df.agg(F.min(cx).alias("_x0"), F.max(cx).alias("_x1"), F.min(cy).alias("_y0"), F.max(cy).alias("_y1"))
    both = df.join(F.broadcast(extent))
    both = both.withColumn("_hx", grid_cell(cx, F.col("_x0"), F.col("_x1"))).withColumn("_hy", grid_cell(cy, F.col("_y0"), F.col("_y1")))
    return both.withColumn(name, hilbert(F.col("_hx"), F.col("_hy"))).drop("_x0", "_x1", "_y0", "_y1", "_hx", "_hy")


def round_down(value: Column) -> Column:
    """A float no larger than the double, by the index's rule."""
    near = value.cast("float")
    return F.when(near.cast("double") > value, (value * F.when(value < 0, 1 + STEP).otherwise(1 - STEP)).cast("float")).otherwise(near)


def round_up(value: Column) -> Column:
    """A float no smaller than the double."""
    near = value.cast("float")
    return F.when(near.cast("double") < value, (value * F.when(value < 0, 1 - STEP).otherwise(1 + STEP)).cast("float")).otherwise(near)


def fan_out(node_bytes: int, fill: float = 1.0) -> int:
    """Entries of a packed node of so many bytes."""
    return max(2, int((node_bytes - NODE_HEADER) // CELL * fill))


def level_sizes(entries: Column, fanout: int, levels: int = 64) -> Column:
    """Nodes of each level of a packed tree, leaves first and the root last, as an array."""
    wide = max(2, fanout)
    ceil = lambda n: F.floor((n + (wide - 1)) / wide)
    first = F.greatest(ceil(entries), F.lit(1)).cast("long")
    grow = lambda acc, _: F.when(F.element_at(acc, -1) > 1, F.concat(acc, F.array(ceil(F.element_at(acc, -1)).cast("long")))).otherwise(acc)
    return F.aggregate(F.array(*[F.lit(k) for k in range(levels)]), F.array(first), grow)


def key_runs(ids: DataFrame, key: str, group: str | None = None, gap: int = GAP) -> DataFrame:
    """Closed ranges (lo, hi) of the keys in ids, gaps up to `gap` bridged; for each group on its own if one is named.

    Runs are numbered within ranges of the keys, and the ranges then joined end to end: one row each.
    """
    part = [group] if group else []
    rows = ranged(ids, *part, key)
    inside = Window.partitionBy(*part, "_range").orderBy(key)
    new = F.coalesce((F.col(key) - F.lag(key).over(inside) > gap).cast("int"), F.lit(0))
    rows = rows.withColumn("_new", new).withColumn("_at", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*part, "_range").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"), F.max("_at").alias("_n"))
    order = Window.partitionBy(*part).orderBy("_range")
    fresh = F.coalesce((F.col("_lo") - F.lag("_hi").over(order) > gap).cast("int"), F.lit(1))
    ends = ends.withColumn("_fresh", fresh)
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumn("_base", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) + before)
    runs = rows.join(F.broadcast(ends.select(*part, "_range", "_base")) if not group else ends.select(*part, "_range", "_base"), [*part, "_range"])
    runs = runs.groupBy(*part, (F.col("_base") + F.col("_at")).alias("_run"))
    return runs.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).drop("_run")
