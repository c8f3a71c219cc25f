import datetime
import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import constraints, convert, grid, names, ordering, types


def column(spark, values, kind="string"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").coalesce(1)


def applied(spark, values, f, kind="string"):
    return [r.o for r in column(spark, values, kind).select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


GLOBS = [("abc", "a*c"), ("abc", "a?c"), ("a.c", "a.c"), ("abc", "a.c"), ("b", "[^a]"), ("a", "[^a]"), ("m", "[a-m]"), ("n", "[a-m]"), ("]", "[]]"), ("-", "[a-]"), ("x", "[x"), ("[x", "[[]x"), ("é", "?"), ("", "*"), ("", "?"), ("a\nb", "a*b"), ("^", "[x^]"), ("\\", "[\\]"), ("ab", "*[b]"), ("A", "a"), ("a", "[b-a]"), ("5", "[0-9]"), ("$", "$"), ("a+b", "a+b"), ("z", "[^]a]"), ("]", "[^]a]")]


@pytest.mark.parametrize(("text", "pattern"), GLOBS)
def test_glob_is_sqlites(spark, text, pattern):
    want = bool(sqlite3.connect(":memory:").execute("SELECT ? GLOB ?", (text, pattern)).fetchone()[0])
    assert applied(spark, [text, None], lambda c: constraints.matches_glob(c, pattern)) == [want, True]


def test_ranges_enums_and_nulls(spark):
    assert applied(spark, [1.0, 2.0, None], lambda c: constraints.in_range(c, 1, 2, False, True), "double") == [False, True, True]
    assert applied(spark, [3.0, 3.5, None], lambda c: constraints.in_enum(c, ["3", "3.5"], "double"), "double") == [True, True, True]
    assert applied(spark, ["5", None], lambda c: constraints.constraint("range", c, "string")) == [False, True]


DATES = {"2026-07-24": datetime.date(2026, 7, 24), "2024-02-29": datetime.date(2024, 2, 29), "2023-02-29": None, "2026-7-4": None, "2026-13-01": None, " 2026-07-24": None, "": None, "2026-07-24 ": None, None: None}
STAMPS = {
    "2026-07-24T12:34:56.789Z": (True, True), "2026-07-24T12:34:56Z": (False, True), "2026-07-24 12:34:56": (False, True), "2026-07-24 12:34:56.1": (False, True), "2026-07-24T12:34:56.123456789+02:00": (False, True),
    "2026-07-24T12:34:56-0530": (False, True), "2026-07-24T12:34:56+02": (False, True), "2026-07-24T24:00:00.000Z": (False, False), "2026-07-24T12:60:00.000Z": (False, False), "2026-02-30T12:00:00.000Z": (False, False),
    "2026-07-24T12:34:56.Z": (False, False), "2026-07-24T12:34:56.1234567890Z": (False, False), "2026-07-24T12:34:56+24:00": (False, False), "2026-07-24": (False, False), "x": (False, False), None: (False, False), "2026-07-24T12:34:56+2:00": (False, False),
}


def test_dates(spark):
    assert applied(spark, list(DATES), convert.date) == list(DATES.values())
    errors = applied(spark, ["2026-7-4", "2023-02-29", "2024-02-29", None], convert.date_error)
    assert errors == ["malformed", "out of range", None, None]


def test_datetimes(spark):
    for lenient in (False, True):
        got = applied(spark, list(STAMPS), lambda c: convert.datetime_micros(c, lenient))  # noqa: B023
        assert [g is not None for g in got] == [v[lenient] for v in STAMPS.values()]
    micros = lambda s: int(datetime.datetime.fromisoformat(s).timestamp() * 1e6)
    got = dict(zip(STAMPS, applied(spark, list(STAMPS), convert.datetime_micros), strict=True))
    assert got["2026-07-24T12:34:56-0530"] == micros("2026-07-24T12:34:56-05:30") and got["2026-07-24T12:34:56+02"] == micros("2026-07-24T12:34:56+02:00")
    assert got["2026-07-24T12:34:56.123456789+02:00"] == micros("2026-07-24T12:34:56+02:00") + 123456
    out = applied(spark, [0, 1, -1, 1_753_360_496_789_000, 1_753_360_496_789_001], convert.format_micros, "long")
    assert out == ["1970-01-01T00:00:00.000Z", "1970-01-01T00:00:00.000001000Z", "1969-12-31T23:59:59.999999000Z", "2025-07-24T12:34:56.789Z", "2025-07-24T12:34:56.789001000Z"]
    assert applied(spark, ["0000-01-01T00:00:00.000Z", "9999-12-31T23:59:59.999Z"], convert.datetime_micros) == [-62167219200000000, 253402300799999000]


def test_type_names(spark):
    assert applied(spark, ["Integer", "text(5)", "VARCHAR(20)", "polygon", None], types.column_type) == ["INTEGER", "TEXT(5)", None, "POLYGON", None]
    assert applied(spark, ["CHARINT", "VARCHAR", "", "DECIMAL", "blobby"], types.affinity) == ["integer", "text", "blob", "real", "blob"]
    assert types.spark_type("VARCHAR(20)") == T.StringType() and types.spark_type("TEXT(9)") == T.StringType() and types.spark_type("numeric") == T.DoubleType() and types.spark_type("point") == T.BinaryType()
    assert types.declared_type(T.IntegerType()) == "MEDIUMINT"
    with pytest.raises(ValueError, match="no declared type"):
        types.declared_type(T.ArrayType(T.StringType()))
    with pytest.raises(ValueError, match="identifier"):
        names.quote("")
    assert names.quote("a`b") == "`a``b`"


def slow_hilbert(x, y):
    """Rotating quadrants of ever smaller squares."""
    d, s = 0, 1 << 15
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * rx) ^ ry)
        x, y = x & (s - 1), y & (s - 1)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        s //= 2
    return d


def test_hilbert_is_a_curve(spark):
    rng = np.random.default_rng(1)
    cells = [(int(x), int(y)) for x, y in rng.integers(0, 1 << 16, (200, 2))] + [(0, 0), (65535, 0), (65535, 65535), (0, 65535)]
    df = spark.createDataFrame(cells, "x long, y long")
    got = df.select("x", "y", ordering.hilbert(F.col("x"), F.col("y")).alias("d")).collect()
    assert all(r.d == slow_hilbert(r.x, r.y) for r in got)
    small = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    path = [(r.x, r.y) for r in small.withColumn("d", ordering.hilbert(F.col("x"), F.col("y"))).orderBy("d").collect()]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))


def test_rounding_outward(spark):
    values = [0.1, -0.1, 1 / 3, 1e10 + 0.1, -1e10 - 0.1, 0.0, 180.0, 16777217.0, 1e-30]
    df = column(spark, values, "double").select("v", ordering.round_down(F.col("v")).alias("d"), ordering.round_up(F.col("v")).alias("u"))
    assert all(r.d <= r.v <= r.u for r in df.collect())


def test_levels_and_runs(spark):
    sizes = applied(spark, [0, 1, 51, 52, 2601, 2602], lambda c: ordering.level_sizes(c, 51), "long")
    assert sizes == [[1], [1], [1], [2, 1], [51, 1], [52, 2, 1]]
    assert applied(spark, [9], lambda c: ordering.level_sizes(c, 1), "long") == [[5, 3, 2, 1]] and ordering.fan_out(4096, 0.5) == 85
    runs = ordering.key_runs(spark.createDataFrame([(1,), (5,), (69,), (134,), (200,)], "id long"), "id").orderBy("lo").collect()
    assert [(r.lo, r.hi, r.n) for r in runs] == [(1, 69, 3), (134, 134, 1), (200, 200, 1)]


def test_tiles(spark):
    with pytest.raises(ValueError, match="measured"):
        grid.Extent(1, 0, 1, 1)
    with pytest.raises(ValueError, match="zooms"):
        grid.ladder(spark, grid.WORLD, 3, 2)
    with pytest.raises(ValueError, match="zooms"):
        grid.ladder(spark, grid.WORLD, 0, 62, base=(2, 1))
    assert grid.WEB_MERCATOR.is_web_mercator and not grid.WORLD.is_web_mercator
    one = F.lit(90.0), F.lit(90.0), F.lit(4), F.lit(2)
    df = spark.createDataFrame([(-180.0, 90.0), (180.0, -90.0), (0.0, 0.0), (-90.0, 0.0), (181.0, 0.0), (math.nan, 0.0)], "x double, y double").coalesce(1)
    got = [r.t and tuple(r.t) for r in df.select(grid.tile_at(grid.WORLD, *one, F.col("x"), F.col("y")).alias("t")).collect()]
    assert got == [(0, 0), (3, 1), (2, 1), (1, 1), None, None]
    boxes = spark.createDataFrame([(-200.0, -200.0, 200.0, 200.0), (0.0, 0.0, 0.0, 0.0), (5.0, 0.0, 4.0, 1.0), (180.0, -95.0, 190.0, -90.0), (190.0, 0.0, 195.0, 1.0)], "a double, b double, c double, d double").coalesce(1)
    got = [r.t and tuple(r.t) for r in boxes.select(grid.tile_range(grid.WORLD, *one, *map(F.col, "abcd")).alias("t")).collect()]
    assert got == [(0, 3, 0, 1), (2, 2, 1, 1), None, (3, 3, 1, 1), None]
