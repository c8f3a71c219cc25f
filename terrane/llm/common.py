"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.operators.shared import settled

#: A word, as Java and RE2 regular expressions read it; bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Keys are 16 hex digits; their leading digits are the buckets that running totals are summed over, and half of those the coarse ones.
KEY_DIGITS, ROWS_A_BUCKET = 16, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    hold_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hold_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of an Arrow batch, where the session doesn't: whole texts and blocks make its 10,000 rows large."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, size)


def settle(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: its lineage ends there, so a lost executor
    costs a reread and nothing upstream runs twice.  The folder goes when the application ends, if not before."""
    hold_batches(df.sparkSession)
    return settled(df)


def forget(df: DataFrame) -> None:
    """Delete what settle() wrote for df, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("settled-"):
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name among them can clash with a name used here."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")


def unpacked(df: DataFrame, *more: str) -> DataFrame:
    return df.select("_row.*", *more)


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.regexp_count(text, F.lit(WORD)).cast("long"))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def thin_filter(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, bits: int = 1 << 26) -> DataFrame:
    """rows with `_hit`, false where key (a long) certainly isn't among the keys of wanted.

    The hashes of wanted are marked in a bitmap that is broadcast: `bits` bits in rows of 4 KB, 8 MB at most by
    default, however many keys there are.  Where they are very many it says true for others as well.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits)) + 1
    marks = wanted.select(place(wanted_key).alias("h")).select(F.expr("bitmap_bucket_number(h)").alias("_part"), F.expr("bitmap_bit_position(h)").alias("p"))
    bitmap = marks.groupBy("_part").agg(F.expr("bitmap_construct_agg(p)").alias("_bits"))
    keyed = rows.withColumn("_slot", place(key)).withColumn("_part", F.expr("bitmap_bucket_number(_slot)")).withColumn("_at", F.expr("cast(bitmap_bit_position(_slot) as int)"))
    byte = F.expr("cast(conv(hex(substring(_bits, _at div 8 + 1, 1)), 16, 10) as int)")
    hit = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2.0), (F.col("_at") % 8).cast("double"))), F.lit(2)) == 1, F.lit(False))
    return keyed.join(F.broadcast(bitmap), "_part", "left").withColumn("_hit", hit).drop("_slot", "_part", "_at", "_bits")


def random_key(seed: str, doc_id: Column) -> Column:
    """Sixteen hex digits, uniform over ids and the same on every run."""
    return F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, KEY_DIGITS)


def bounded_sample(rows: DataFrame, column: str, chosen: DataFrame, most: int) -> DataFrame:
    """`column`, _key and further columns of chosen for the rows (_id, column) whose id is in chosen (_id, _key, ...).

    Each value that an id has counts once, and `most` values at most in the order of _key and a hash of the
    value, however often ids repeat.  chosen has to have `most` rows at most, of short columns: it is broadcast.
    """
    met = rows.join(F.broadcast(chosen), "_id").withColumn("_th", F.xxhash64(column))
    picked = met.select("_key", "_id", "_th").distinct().orderBy("_key", "_id", "_th").limit(most)
    once = met.join(F.broadcast(picked), ["_key", "_id", "_th"], "left_semi").dropDuplicates(["_key", "_id", "_th"])
    return once.drop("_id", "_th")


def group_key(source: Column) -> Column:
    """A source as a never-null string in code point order, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def bucket_digits(rows: int) -> int:
    """Leading hex digits of a key so that a bucket holds about ROWS_A_BUCKET of so many rows."""
    digits = 2
    while digits < 6 and rows > ROWS_A_BUCKET * 16**digits:
        digits += 1
    return digits


def running_total(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, name: str, coarse: Column, per_group: DataFrame | None = None) -> DataFrame:
    """df with the sum of value over the rows before each row of its group, as column `name`.

    Three levels: sums of value for each (group, bucket), added up over the buckets of a coarse one, and over
    the coarse ones; then a window inside one bucket.  No task ever sees a whole group or all its buckets, so
    a source with a third of all rows is spread like any other.  bucket has to be monotone in order, and coarse,
    a function of bucket, in bucket.  per_group: columns for each group, joined on the way.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum")).withColumn("_coarse", coarse)
    above = sums.groupBy(*group, "_coarse").agg(F.sum("_sum").alias("_total"))
    so_far = lambda by, at, what: F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = above.withColumn("_offset", so_far(group, "_coarse", "_total")).drop("_total")
    sums = sums.withColumn("_sum", so_far([*group, "_coarse"], bucket, "_sum"))
    offsets = sums.join(above, [*group, "_coarse"]).withColumn("_offset", F.col("_offset") + F.col("_sum")).drop("_sum", "_coarse")
    if per_group is not None:
        offsets = offsets.join(per_group, group)
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return run.join(offsets, [*group, bucket]).withColumn(name, (F.col(name) + F.col("_offset")).cast("long")).drop("_offset")
