"""Findings about a container, most severe first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import names
from terrane.operators.relations import check_references

# Kinds of findings with their severity and what mends them.
KINDS = {
    "missing table": ("error", "drop the catalogue row or restore the table"),
    "index out of step": ("error", "rebuild the index"),
    "dangling metadata reference": ("error", None),
    "missing mapping table": ("error", None),
    "legacy application id": ("warning", "rewrite the file"),
    "case differs": ("warning", None),
    "removed extension": ("warning", None),
    "unrecognised extension": ("warning", None),
    "legacy index triggers": ("warning", "repair the index"),
    "inconsistent pyramid": ("warning", None),
    "relation name": ("warning", None),
    "no index": ("advisory", "build an index"),
}
RANK = {"error": 0, "warning": 1, "advisory": 2}


def finding(kind: str, df: DataFrame, table: Column | None = None) -> DataFrame:
    severity, repair = KINDS[kind]
    return df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), (F.lit(None) if table is None else table).cast("string").alias("table_name"), F.lit(repair).cast("string").alias("repair"))


def validate(*, contents: DataFrame, tables: DataFrame, extensions: DataFrame | None = None, indexes: DataFrame | None = None, pyramids: DataFrame | None = None, references: DataFrame | None = None, records: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """severity, kind, table_name and repair of each finding, most severe first.

    tables (name): what is there.  indexes (table_name, status, is_consistent).  pyramids (table_name, fault).
    """
    t = tables.select(F.lower("name").alias("_l"), F.col("name").alias("_n"))
    with_table = contents.join(t, F.lower("table_name") == F.col("_l"), "left")
    out = [finding("missing table", with_table.where("_l IS NULL"), F.col("table_name")), finding("case differs", with_table.where("_n != table_name"), F.col("table_name"))]
    if extensions is not None:
        support = names.extension_support(F.col("extension_name"))
        out += [finding(f"{kind} extension", extensions.where(support == kind), F.col("table_name")) for kind in ("removed", "unrecognised")]
    if indexes is not None:
        tests = {"no index": "status = 'absent'", "legacy index triggers": "status = 'legacy'", "index out of step": "status = 'stale' OR (status IN ('current', 'legacy') AND NOT is_consistent)"}
        out += [finding(kind, indexes.where(test), F.col("table_name")) for kind, test in tests.items()]
    if pyramids is not None:
        out.append(finding("inconsistent pyramid", pyramids.where("fault IS NOT NULL").select("table_name").distinct(), F.col("table_name")))
    if references is not None and records is not None:
        out.append(finding("dangling metadata reference", check_references(references, records).where("error = 'dangling'")))
    if relations is not None:
        out.append(finding("relation name", relations.where(~names.relation_conforms(F.col("relation_name")))))
        missing = relations.join(t, F.lower("mapping_table_name") == F.col("_l"), "left_anti")
        out.append(finding("missing mapping table", missing, F.col("mapping_table_name")))
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    return reduce(DataFrame.unionByName, out).orderBy(rank[F.col("severity")], "kind", "table_name")


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
