"""Mixing sources to target weights.

Every row gets a key hashed from its id, so that the order inside a source is random and the same on each
run.  Rows are sorted by key within the source's key ranges, running token totals come from sums over levels
of buckets (common.running_total), and a source is cut exactly where its budget ends; a budget above the source's size
repeats whole epochs first.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null id hashes like
an empty one.  Rows that agree in id and size are interchangeable.  An empty table gives an empty result.
Columns of the input that are named like those added here are overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.llm.common import bucket_digits, group_key, packed, random_key, running_total, settle, table, unpacked, word_count

MAX_EPOCHS, SEED = 3, "mix-1:"


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """_group, source_size, target, _budget from (_group, source_size), one row for each source.

    Weights 1, 2, 3, repeating in the order of _group, share the total.  A source stops at max_epochs times
    its size, and what it leaves is shared by the weights of the others, until none is above: sources are
    taken by size over weight, and the first that its share doesn't fill sets the level for the rest.
    """
    everything, big = Window.partitionBy(), "decimal(38,0)"
    weighed = sources.withColumn("_weight", ((F.row_number().over(Window.orderBy("_group")) - 1) % 3 + 1).cast(big)).withColumn("_cap", (F.col("source_size") * max_epochs).cast(big))
    by_fill = Window.orderBy(F.col("source_size").cast("double") / F.col("_weight").cast("double"), "_group")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = weighed.select(
        "*",
        F.row_number().over(by_fill).alias("_rank"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast(big).alias("_left"),
        (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))).cast(big).alias("_weights"),
    )
    above = F.col("_cap").cast("double") * F.col("_weights").cast("double") > F.col("_left").cast("double") * F.col("_weight").cast("double")
    first = F.min(F.when(above, F.struct("_rank", "_left", "_weights"))).over(everything)
    level = F.col("_first._left").cast("double") / F.col("_first._weights").cast("double")
    capped = F.col("_first").isNull() | (F.col("_rank") < F.col("_first._rank"))
    out = filled.withColumn("_first", first).withColumn("target", F.when(capped, F.col("_cap").cast("double")).otherwise(level * F.col("_weight").cast("double")))
    return out.select("_group", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("_budget"))


def mix(docs: DataFrame, size: Column | None = None, rows: int | None = None, seed: str = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs with size, source_size, target, taken and copies.

    taken: words that the mix takes of the row, repeats counted, so that a source's sum is its budget; the
    row at the cut gives the part that remains.  copies: taken in whole documents, the cut rounded to half.
    size: tokens of a row, by default its words.  rows: the number of rows, where it is known.
    """
    sized = docs.withColumn("size", word_count(F.col("text")) if size is None else size)
    digits = bucket_digits(docs.count() if rows is None else rows)
    keyed = sized.withColumn("_group", group_key(F.col("source"))).withColumn("_key", random_key(seed, F.col("doc_id"))).withColumn("_bucket", F.substring("_key", 1, digits))
    plan = targets(keyed.groupBy("_group").agg(F.sum("size").alias("source_size")), max_epochs)
    placed = running_total(keyed, ["_group"], "_bucket", ["_key", "doc_id", "size"], F.col("size"), "_before", F.substring("_bucket", 1, digits // 2), plan)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_budget") - F.col("_epochs") * F.col("source_size") - F.col("_before")))
    placed = placed.withColumn("_epochs", epochs).withColumn("_part", part.cast("long"))
    taken = (F.col("_epochs") * F.col("size") + F.col("_part")).cast("long")
    copies = (F.col("_epochs") + F.when((F.col("size") > 0) & (2 * F.col("_part") >= F.col("size")), 1).otherwise(0)).cast("long")
    return placed.withColumn("taken", taken).withColumn("copies", copies).drop("_group", "_key", "_bucket", "_before", "_epochs", "_part", "_budget")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with the columns of docs."""
    whole = docs.select("doc_id", "source", "text", packed(docs))
    out = mix(whole, **options)
    return unpacked(out.where("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    thin = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix(thin, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substring(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
f AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER o AS r,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)),
l AS (SELECT min(r) AS r FROM f WHERE CAST(cap AS DOUBLE) * weights > CAST(rest AS DOUBLE) * weight),
t AS (
  SELECT f.source, f.source_size,
         CASE WHEN l.r IS NULL OR f.r < l.r THEN CAST(f.cap AS DOUBLE)
              ELSE CAST(g.rest AS DOUBLE) / CAST(g.weights AS DOUBLE) * CAST(f.weight AS DOUBLE) END AS target
  FROM f CROSS JOIN l LEFT JOIN f AS g ON g.r = l.r),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
            + greatest(0, least(size, budget - budget // source_size * source_size - before)) END AS BIGINT) AS taken
FROM p
"""
