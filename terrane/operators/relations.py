"""Many-to-many relations, metadata and its hierarchy, and columns' constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import constraints, names
from terrane.operators.shared import settled

TARGETS = ("table_name", "column_name", "row_id_value")


def related(base: DataFrame, mapping: DataFrame, other: DataFrame, base_key: str, other_key: str) -> DataFrame:
    """Rows of base and other that the mapping (base_id, related_id) ties, repeats kept."""
    return base.join(mapping, base[base_key] == mapping["base_id"]).join(other, mapping["related_id"] == other[other_key])


def related_ids(mapping: DataFrame, base_id: int) -> DataFrame:
    return mapping.where(F.col("base_id") == base_id).select("related_id")


def relations_from(relations: DataFrame, table: str) -> DataFrame:
    """Relations whose base is this table in any case, by id."""
    return relations.where(F.lower("base_table_name") == table.lower()).orderBy("id")


def add_relation(relations: DataFrame, contents: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """relations with the rows of new that conform and whose ends are in contents, and the refused ones with `error`."""
    tables = contents.select(F.lower("table_name").alias("_t")).distinct()
    ends = new.join(tables.withColumnRenamed("_t", "_b"), F.lower("base_table_name") == F.col("_b"), "left").join(tables.withColumnRenamed("_t", "_r"), F.lower("related_table_name") == F.col("_r"), "left")
    error = F.when(~names.relation_conforms(F.col("relation_name")), "relation name").when(F.col("_b").isNull() | F.col("_r").isNull(), "unknown table")
    told = ends.withColumn("error", error).select(*new.columns, "error")
    return relations.unionByName(told.where("error IS NULL").drop("error")), told.where("error IS NOT NULL")


def metadata_for(references: DataFrame, scope: str, whole: str = names.WHOLE_FILE, **target) -> DataFrame:
    """References of a scope to exactly this target; columns that the scope leaves out have to be null.  whole: the scope of the whole file."""
    targets = {**names.REFERENCE_TARGETS, whole: ()}
    if scope not in targets or set(target) - set(targets[scope]):
        raise ValueError(f"scope {scope} with target {sorted(target)}")
    same = [F.col(c).eqNullSafe(F.lit(target.get(c))) for c in TARGETS]
    return references.where((F.col("reference_scope") == scope) & reduce(lambda a, b: a & b, same))


def ancestors(references: DataFrame, start: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(id, depth, ancestor, error) up the parent chain of each id in start, nearest first.

    One parent counts for a record, the smallest.  A chain that comes back to itself ends with error 'cycle', one
    that leads to a missing record with 'dangling'.  Chains have any length: each round continues all known
    ancestors by as many steps as are known, so a chain of n takes log n rounds.  Chains that came back are
    set aside, and rounds end when no other chain has grown.
    """
    parents = settled(references.where("md_parent_id IS NOT NULL").groupBy(F.col("md_file_id").cast("long").alias("id")).agg(F.min("md_parent_id").cast("long").alias("parent")))
    jump, depth = parents.select("id", F.col("parent").alias("to")), 1
    asked = start.select(F.col("id").cast("long").alias("id")).distinct()
    now = settled(_until_seen(parents.select("id", F.lit(1).alias("depth"), F.col("parent").alias("ancestor")).join(asked, "id", "left_semi")))
    done = now.where("stop IS NOT NULL")
    while True:
        ends = jump.select(F.col("id").alias("_at"), F.col("to").alias("_to"))
        going = now.where("stop IS NULL").select("id", "depth", "ancestor")
        further = going.join(ends, F.col("ancestor") == F.col("_at")).select("id", (F.col("depth") + depth).alias("depth"), F.col("_to").alias("ancestor"))
        now = settled(_until_seen(going.union(further)))
        done = done.union(now.where("stop IS NOT NULL"))
        if now.where((F.col("depth") > depth) & F.col("stop").isNull()).limit(1).count() == 0:
            break
        jump, depth = settled(jump.join(ends, F.col("to") == F.col("_at")).select("id", F.col("_to").alias("to"))), 2 * depth
    walked = done.union(now.where("stop IS NULL")).select("id", "depth", "ancestor", F.when(F.col("depth") == F.col("stop"), "cycle").alias("error"))
    if records is None:
        return walked
    there = records.select(F.col("id").alias("_k")).distinct()
    return walked.join(there, walked.ancestor == there["_k"], "left").select("id", "depth", "ancestor", F.coalesce("error", F.when(F.col("_k").isNull(), "dangling")).alias("error"))


def _until_seen(chains: DataFrame) -> DataFrame:
    """chains (id, depth, ancestor) up to the first ancestor that a chain has seen, its own id included, and that depth as `stop`."""
    nth = F.row_number().over(Window.partitionBy("id", "ancestor").orderBy("depth"))
    told = chains.withColumn("_again", (nth > 1) | (F.col("ancestor") == F.col("id")))
    stop = F.min(F.when(F.col("_again"), F.col("depth"))).over(Window.partitionBy("id"))
    return told.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("depth") <= F.col("stop"))).drop("_again")


def check_references(references: DataFrame, records: DataFrame, whole: str = names.WHOLE_FILE) -> DataFrame:
    """references with `error`: unknown scope, wrong targets, own parent, or a record that isn't there."""
    wanted = names.reference_targets(F.col("reference_scope"), whole)
    filled = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in TARGETS]), lambda x: x.isNotNull())
    known = records.select(F.col("id").alias("_k")).distinct()
    both = references.join(known, references.md_file_id == known["_k"], "left")
    error = F.when(wanted.isNull(), "unknown scope").when(wanted != filled, "targets").when(F.col("md_parent_id") == F.col("md_file_id"), "own parent").when(F.col("_k").isNull(), "dangling")
    return both.withColumn("error", error).drop("_k")


def assembled(rows: DataFrame) -> DataFrame:
    """Constraint rows (constraint_name, constraint_type, value, min, min_is_inclusive, max, max_is_inclusive) as one row for each name; null inclusivity is inclusive."""
    first = lambda c: F.first(c, ignorenulls=True)
    return rows.groupBy("constraint_name", "constraint_type").agg(
        F.sort_array(F.collect_list("value")).alias("members"),
        first("min").alias("min"),
        F.coalesce(first("min_is_inclusive"), F.lit(True)).alias("min_is_inclusive"),
        first("max").alias("max"),
        F.coalesce(first("max_is_inclusive"), F.lit(True)).alias("max_is_inclusive"),
    )


def enforce(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """df with `violations`, the columns whose constraint a row breaks; rules: column to constraint() arguments."""
    kinds = dict(df.dtypes)
    broken = [F.when(~constraints.constraint(value=F.col(c), value_type=kinds[c], **rule), F.lit(c)) for c, rule in rules.items()]
    return df.withColumn("violations", F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>"))
