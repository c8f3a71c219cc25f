"""Sharding by proportional stratified interleaving.

Rows are ranked within their source in an order shuffled by a seed; row number r of n gets the fraction
(2r + 1) / 2n; all rows are sorted by that fraction and cut into runs of equal length, so every shard holds
each source in the proportion of the whole.  The law is `rows`: shard sizes differ by one row at most.
Both ranks are running counts over levels of buckets (common.running_total); no task sorts a whole source or the table.

Nulls: a null text has the size of an empty one; a null source is a source of its own; a null id hashes
like an empty one.  Equal texts are not kept together: each row is placed by its source and key alone, and
rows that agree in id, size and checksum are interchangeable.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import bucket_digits, group_key, packed, random_key, running_total, settle, table

SHARDS, SEED = 8, "shard-1:"


def measured(docs: DataFrame) -> DataFrame:
    """docs with size (UTF-8 bytes of the text and one for its end) and text_crc32."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumn("size", (F.octet_length(text) + 1).cast("long")).withColumn("text_crc32", F.crc32(text))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, rows: int | None = None) -> DataFrame:
    """docs (as measured() returns them) with law, shard, slot and grown_shard.

    slot: place in the shard, from 0 without gaps.  Every column of docs travels along.
    """
    rows = docs.count() if rows is None else rows
    digits = bucket_digits(rows)
    keyed = docs.withColumn("_group", group_key(F.col("source"))).withColumn("_key", random_key(seed, F.col("doc_id"))).withColumn("_bucket", F.substring("_key", 1, digits))
    counts = keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    tie = ["_key", "doc_id", "size", "text_crc32"]
    ranked = running_total(keyed, ["_group"], "_bucket", tie, F.lit(1), "_rank", F.substring("_bucket", 1, digits // 2), counts)
    ranked = ranked.withColumn("_fraction", (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_n")).cast("double"))
    ranges = ranked.withColumn("_all", F.lit(0)).withColumn("_bucket", F.floor(F.col("_fraction") * 16**digits))
    out = running_total(ranges, ["_all"], "_bucket", ["_fraction", "_group", *tie], F.lit(1), "_place", F.floor(F.col("_bucket") / 16 ** (digits // 2)))
    total = max(rows, 1)
    shard = F.expr(f"_place * {shards} div {total}")
    out = out.withColumn("law", F.lit("rows")).withColumn("shard", shard.cast("int"))
    start = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return out.withColumn("slot", (F.col("_place") - start).cast("long")).withColumn("grown_shard", F.lit(None).cast("int")).drop("_group", "_key", "_bucket", "_rank", "_n", "_fraction", "_all", "_place")


def sharded(docs: DataFrame, **options) -> DataFrame:
    """docs with columns shard and slot after its own."""
    whole = measured(docs.select("doc_id", "source", "text", packed(docs))).drop("text")
    own = [f"_row.`{c}`" for c in docs.columns if c not in ("shard", "slot")]  # such columns of docs give way
    return interleave(whole, **options).select(*own, "shard", "slot")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder for each shard; its files hold ranges of slots, each in order, so that many tasks write a shard."""
    out = interleave(measured(docs), **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = settle(measured(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "text_crc32"))
    return interleave(thin).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: DuckDB has no crc32; it is folded over the bytes with the usual table, which is built from its polynomial.
OP7_SQL = r"""
WITH c AS (SELECT list(v ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256)))),
t AS (SELECT doc_id, source, coalesce(text, '') AS text, substring(md5('shard-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS k FROM documents),
d AS (SELECT doc_id, source, k, octet_length(encode(text)) + 1 AS size,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(('0x' || h) AS BIGINT))), lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295) AS text_crc32
      FROM t, c),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM d),
g AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * r + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), source NULLS LAST, k, doc_id NULLS FIRST, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(place * 8 // total AS INTEGER) AS shard, CAST(place - ((place * 8 // total) * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM g
"""
