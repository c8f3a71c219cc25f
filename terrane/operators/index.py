"""Spatial index tables: building, packing, auditing, verifying."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import ordering
from terrane.operators.layer import SIDECAR, clean_sidecar
from terrane.operators.shared import ranged


def build(layer: DataFrame, fid: str = "fid") -> DataFrame:
    """(id, minx, maxx, miny, maxy, hilbert): bounds rounded outward to floats; null and empty geometries have no entry."""
    boxes = clean_sidecar(layer).where("minx IS NOT NULL AND miny IS NOT NULL").select(F.col(fid).alias("id"), *SIDECAR)
    down, up = ordering.round_down, ordering.round_up
    keyed = ordering.with_hilbert(boxes)
    return keyed.select("id", down(F.col("minx")).alias("minx"), up(F.col("maxx")).alias("maxx"), down(F.col("miny")).alias("miny"), up(F.col("maxy")).alias("maxy"), "hilbert")


def clustered(layer: DataFrame, partitions: int | None = None) -> DataFrame:
    """layer in Hilbert order, so that row groups have narrow bounds and box filters skip most of them."""
    keyed = ordering.with_hilbert(clean_sidecar(layer))
    ranged = keyed.repartitionByRange(partitions, "hilbert") if partitions else keyed.repartitionByRange("hilbert")
    return ranged.sortWithinPartitions("hilbert").drop("hilbert")


def packed(index: DataFrame, fanout: int) -> DataFrame:
    """index with `leaf`, the number of the packed leaf of each entry in Hilbert order, counted over ranges of the order."""
    rows = ranged(index, "hilbert", "id")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # a row for each shuffle partition
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("hilbert", "id"))
    leaf = F.floor((F.col("_start") + F.col("_rank") - 1) / max(2, fanout))
    return rows.withColumn("_rank", rank).join(F.broadcast(start), "_range").withColumn("leaf", leaf).drop("_range", "_rank", "_start")


def audit(layer: DataFrame, index: DataFrame, fid: str = "fid") -> DataFrame:
    """indexable, entries, missing, extra, not_covering: one row."""
    features = clean_sidecar(layer).where("minx IS NOT NULL AND miny IS NOT NULL").select(F.col(fid).alias("id"), *SIDECAR)
    entries = index.select("id", *[F.col(c).cast("double").alias(f"i_{c}") for c in SIDECAR], F.lit(True).alias("_entry"))
    both = features.withColumn("_row", F.lit(True)).join(entries, "id", "full_outer")
    row, entry = F.col("_row").isNotNull(), F.col("_entry").isNotNull()
    short = (F.col("i_minx") > F.col("minx")) | (F.col("i_maxx") < F.col("maxx")) | (F.col("i_miny") > F.col("miny")) | (F.col("i_maxy") < F.col("maxy"))
    count = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(count(row).alias("indexable"), count(entry).alias("entries"), count(row & ~entry).alias("missing"), count(entry & ~row).alias("extra"), count(row & entry & short).alias("not_covering"))


def is_consistent(audited: DataFrame) -> DataFrame:
    return audited.withColumn("is_consistent", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("not_covering") == 0))


def maintain(index: DataFrame, written: DataFrame, deleted: DataFrame | None = None, fid: str = "fid") -> DataFrame:
    """index after rows were written (their sidecar columns) and others deleted."""
    gone = written.select(F.col(fid).alias("id"))
    gone = gone if deleted is None else gone.union(deleted.select(F.col(fid).alias("id")))
    columns = [c for c in index.columns if c != "hilbert"]
    return index.join(gone.distinct(), "id", "left_anti").select(*columns).unionByName(build(written, fid).select(*columns))


def candidates(index: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Ids whose entry meets a box; features are tested again exactly."""
    return index.where((F.col("minx") <= max_x) & (F.col("maxx") >= min_x) & (F.col("miny") <= max_y) & (F.col("maxy") >= min_y)).select("id")
