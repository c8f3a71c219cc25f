"""Command line over containers: python -m terrane info|validate|copy|rebuild|index|drop-index|repair|tiles|tile PATH ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import terrane
from terrane.operators import container as c
from terrane.operators import validate
from terrane.functions import grid


def findings(box: c.Container):
    """validate() over what a container holds; its layers' own sidecar columns are their index."""
    spark, specs = box.spark, box.state["specs"]
    tables = spark.createDataFrame([(t,) for t in sorted(box.state["tables"])], "name string")
    layers = [n for n, x in specs.items() if isinstance(x, dict) and x.get("geometry")]
    # One audit a layer that has an index; a layer without one is told as it is.
    status = [(n, "current" if specs[n]["spatial_index"] else "absent", not specs[n]["spatial_index"] or box.audit_index(n).first().is_consistent) for n in layers]
    more = {}
    if "metadata_reference" in box.state["tables"]:
        more |= {"references": box.table("metadata_reference"), "records": c.optional(box, "metadata", c.METADATA)}
    if "relations" in box.state["tables"]:
        more["relations"] = box.table("relations")
    if "tile_matrix" in box.state["tables"]:
        faults = [grid.matrix_faults(box.table("tile_matrix").where(F.col("table_name") == r.table_name), c.open_pyramid(box, r.table_name).extent) for r in c.tile_pyramids(box).collect()]  # one plan a pyramid
        for f in faults:
            more["pyramids"] = f if "pyramids" not in more else more["pyramids"].unionByName(f)
    return validate.validate(contents=box.table("contents"), tables=tables, extensions=box.table("extensions"), indexes=spark.createDataFrame(status, "table_name string, status string, is_consistent boolean"), **more)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 where validate finds an error (with --strict a warning), or there is no index to drop."""
    parser = argparse.ArgumentParser(prog="terrane")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in {"info": (), "validate": (), "copy": ("to",), "rebuild": ("layer",), "index": ("layer",), "drop-index": ("layer",), "repair": ("layer",), "tiles": ("table",), "tile": ("table", "zoom", "column", "row", "out")}.items():
        sub = commands.add_parser(name)
        for argument in ("path", *more):
            sub.add_argument(argument, type=int if argument in ("zoom", "column", "row") else str)
        if name == "validate":
            sub.add_argument("--strict", action="store_true", help="warnings count as errors")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    terrane.visible(spark)
    box = c.Container.open(spark, args.path, lenient=args.command in ("info", "validate"))
    if args.command == "info":
        for r in box.contents().collect():
            print(f"{r.table_name}\t{r.data_type}\t{r.srs_id}\t{box.table(r.table_name).count()}")
        for w in box.warnings:
            print(f"warning: {w}", file=sys.stderr)
    elif args.command == "validate":
        found = findings(box).collect()
        for r in found:
            print(f"{r.severity}\t{r.kind}\t{r.table_name or ''}\t{r.repair or ''}")
        failing = ("error", "warning") if args.strict else ("error",)
        return int(any(r.severity in failing for r in found))
    elif args.command == "copy":
        for left in box.copy_to(args.to)[1]:
            print(f"left behind: {left}")
    elif args.command == "rebuild":
        box.compact(args.layer)
    elif args.command == "index":
        box.create_index(args.layer)
    elif args.command == "drop-index":
        return int(not box.drop_index(args.layer))
    elif args.command == "repair":
        print("rebuilt" if box.repair_index(args.layer) else "in step")
    elif args.command == "tiles":
        for r in c.open_pyramid(box, args.table).counts().orderBy("zoom_level").collect():
            print(f"{r.zoom_level}\t{r.n}")
    else:
        row = c.open_pyramid(box, args.table).get(args.zoom, args.column, args.row).first()
        if row is None:
            print("no such tile", file=sys.stderr)
            return 1
        with open(args.out, "wb") as f:
            f.write(row.tile_data)
    return 0


if __name__ == "__main__":
    sys.exit(main())
