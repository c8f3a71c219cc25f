"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Texts are lower-cased and cut at white space; shingles are five words, or all of an item's words where it has
fewer.  Items are partitioned by size, each partition doubling the one before.  The sketch of an item is its k
least shingle hashes (a bottom-k MinHash), k the most that any item of its partition could miss, and one: a
document that contains 0.8 of the item then shares a sketch hash with it, however long it is and wherever the
shingles stand, so the search has no false negatives.  Every shingle of every document, of the lengths that
items have, probes the sketches; pairs that meet, in documents large enough, are verified by the exact share
of the item's shingles that the document has.  Only DataFrame functions are used.

An item of one to four words is found wherever these words stand in a row.

Nulls: a null text or item has no shingles and meets nothing.  A row without an id is reported with a null id.
Rows that agree in id and text are reported once for each item.  Items that agree in id and text are one item.
Empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import packed, settle, table, thin_filter, unpacked

SHINGLE, TENTHS = 5, 8
#: Bytes, as estimated, up to which the sketches, and the items' shingles, are broadcast; above, they are shuffled.
BROADCAST_BYTES, SKETCH_ROW = 32 << 20, 48


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _needed(n: Column) -> Column:
    return F.ceil(n * TENTHS / 10).cast("int")


def _hashes(rows: DataFrame, width: int, *keep: str) -> DataFrame:
    """One row for each shingle of `width` words of rows (_w among the columns), with its hash _h and the text's count _n."""
    last = F.size("_w") - width
    at = rows.select(*keep, "_w", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("_at"))
    grams = [F.expr(f"get(_w, _at + {k})") for k in range(width)]
    return at.select(*keep, (F.size("_w") - width + 1).alias("_n"), F.xxhash64(*grams).alias("_h"))


def _shingles(words: str, width: str) -> Column:
    """The distinct shingles of `width` words, as text."""
    return F.expr(f"CASE WHEN size({words}) < {width} THEN array() ELSE array_distinct(transform(sequence(0, size({words}) - {width}), i -> array_join(slice({words}, i + 1, {width}), ' '))) END")


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, th, _w, width) of each item that has a word: a hash of its text, its words, and how many make a shingle."""
    rows = benchmark.where("text IS NOT NULL").select("item_id", F.xxhash64("text").alias("th"), _words(F.col("text")).alias("_w"))
    return rows.where(F.size("_w") > 0).withColumn("width", F.least(F.size("_w"), F.lit(SHINGLE)))


def sketches(benchmark: DataFrame) -> DataFrame:
    """(item_id, th, width, _h, need): the sketch hashes of each item and the shingles that a document has to share."""
    every = items(benchmark)
    hashed = [_hashes(every.where(F.col("width") == w), w, "item_id", "th", "width") for w in range(1, SHINGLE + 1)]
    least = reduce(DataFrame.union, hashed).groupBy("item_id", "th", "width").agg(F.array_sort(F.collect_set("_h")).alias("hs"))
    top = F.expr("shiftleft(2, floor(log2(size(hs)))) - 1").cast("int")  # the largest size of the partition
    k = top - _needed(top) + 1
    return least.select("item_id", "th", "width", _needed(F.size("hs")).alias("need"), F.explode(F.slice("hs", F.lit(1), k)).alias("_h"))


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row, item_id, n_shingles, n_found, containment) of each row of docs that contains an item; row is a hash of the row's id and text."""
    sketch = settle(sketches(benchmark))
    by_width = {r.width: r.n for r in sketch.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}  # SHINGLE rows at most
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    worded = rows.select("doc_id", "row", _words(F.col("text")).alias("_w"))
    met = []
    for width, n in sorted(by_width.items()):
        wanted, probes = sketch.where(F.col("width") == width), _hashes(worded, width, "doc_id", "row")
        if n * SKETCH_ROW <= BROADCAST_BYTES:
            wanted = F.broadcast(wanted)
        else:
            probes = thin_filter(probes, F.col("_h"), wanted, F.col("_h")).where("_hit")
        met.append(probes.join(wanted, "_h").where("_n >= need").select("doc_id", "row", "item_id", "th", "width"))
    none = docs.sparkSession.createDataFrame([], "doc_id long, row long, item_id long, th long, width int")
    pairs = settle((reduce(DataFrame.union, met) if met else none).distinct())
    wanted = pairs.select(F.col("doc_id").alias("_i"), F.col("row").alias("_r"), "width").distinct()
    same_row = (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_i"))
    texts = rows.join(wanted, same_row).dropDuplicates(["doc_id", "row", "width"])
    have = texts.select("doc_id", "row", "width", _words(F.col("text")).alias("_w")).select("doc_id", "row", "width", _shingles("_w", "width").alias("have"))
    want = items(benchmark).dropDuplicates(["item_id", "th"]).select("item_id", "th", _shingles("_w", "width").alias("want"))
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if 2 * SHINGLE * size <= BROADCAST_BYTES:
        want = F.broadcast(want)
    asked = pairs.join(want, pairs.item_id.eqNullSafe(want.item_id) & (pairs.th == want.th)).select(F.col("doc_id").alias("_i"), F.col("row").alias("_r"), F.col("width").alias("_wide"), pairs.item_id, "want")
    both = have.join(asked, same_row & (F.col("width") == F.col("_wide")))
    counted = both.select("doc_id", "row", "item_id", F.size("want").cast("long").alias("n_shingles"), F.size(F.array_intersect("have", "want")).cast("long").alias("n_found"))
    return counted.where(F.col("n_found") * 10 >= F.col("n_shingles") * TENTHS).withColumn("containment", F.col("n_found").cast("double") / F.col("n_shingles").cast("double"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no item."""
    hit = settle(contained(docs, benchmark).select(F.col("doc_id").alias("_i"), F.col("row").alias("_r")).distinct())
    rows = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("doc_id", "text").alias("_x"), packed(docs))
    return unpacked(rows.join(hit, (F.col("_x") == F.col("_r")) & F.col("_d").eqNullSafe(F.col("_i")), "left_anti"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_shingles", "n_found", "containment")


OP8_SQL = r"""
WITH b AS (SELECT row_number() OVER () AS rid, item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
bw AS (SELECT rid, least(len(w), 5) AS width, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM b),
dw AS (SELECT rid, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d),
bg AS (SELECT rid, width, v AS g1, v || ' ' || lead(v, 1) OVER o AS g2, v || ' ' || lead(v, 1) OVER o || ' ' || lead(v, 2) OVER o AS g3,
         v || ' ' || lead(v, 1) OVER o || ' ' || lead(v, 2) OVER o || ' ' || lead(v, 3) OVER o AS g4,
         v || ' ' || lead(v, 1) OVER o || ' ' || lead(v, 2) OVER o || ' ' || lead(v, 3) OVER o || ' ' || lead(v, 4) OVER o AS g5
       FROM bw WINDOW o AS (PARTITION BY rid ORDER BY i)),
dg AS (SELECT rid, v AS g1, v || ' ' || lead(v, 1) OVER o AS g2, v || ' ' || lead(v, 1) OVER o || ' ' || lead(v, 2) OVER o AS g3,
         v || ' ' || lead(v, 1) OVER o || ' ' || lead(v, 2) OVER o || ' ' || lead(v, 3) OVER o AS g4,
         v || ' ' || lead(v, 1) OVER o || ' ' || lead(v, 2) OVER o || ' ' || lead(v, 3) OVER o || ' ' || lead(v, 4) OVER o AS g5
       FROM dw WINDOW o AS (PARTITION BY rid ORDER BY i)),
bs AS (SELECT DISTINCT rid, width, CASE width WHEN 1 THEN g1 WHEN 2 THEN g2 WHEN 3 THEN g3 WHEN 4 THEN g4 ELSE g5 END AS s FROM bg),
n AS (SELECT rid, count(s) AS n FROM bs GROUP BY rid),
m AS (SELECT DISTINCT dg.rid AS d, bs.rid AS b, bs.s FROM dg JOIN bs ON bs.width = 5 AND dg.g5 = bs.s
  UNION ALL SELECT DISTINCT dg.rid, bs.rid, bs.s FROM dg JOIN bs ON bs.width = 4 AND dg.g4 = bs.s
  UNION ALL SELECT DISTINCT dg.rid, bs.rid, bs.s FROM dg JOIN bs ON bs.width = 3 AND dg.g3 = bs.s
  UNION ALL SELECT DISTINCT dg.rid, bs.rid, bs.s FROM dg JOIN bs ON bs.width = 2 AND dg.g2 = bs.s
  UNION ALL SELECT DISTINCT dg.rid, bs.rid, bs.s FROM dg JOIN bs ON bs.width = 1 AND dg.g1 = bs.s),
c AS (SELECT m.d, m.b, n.n, count(*) AS found FROM m JOIN n ON n.rid = m.b GROUP BY m.d, m.b, n.n)
SELECT doc_id, item_id, n AS n_shingles, found AS n_found, CAST(found AS DOUBLE) / n AS containment
FROM c JOIN d ON d.rid = c.d JOIN b ON b.rid = c.b WHERE found * 10 >= n * 8
"""
