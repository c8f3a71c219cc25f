"""Reading integers, doubles and geometry headers out of binary columns with Catalyst expressions.

Nothing here leaves the JVM.  Offsets count from 0.  A geometry blob is an 8-byte header (magic "GP",
version 0, flags, srs id), an optional envelope of doubles and an ISO WKB body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bytes an envelope takes by indicator, and the flag bits of a header.
ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
LITTLE, EMPTY, EXTENDED = 1, 16, 32


def _slice(b: Column, at: Column | int, size: int) -> Column:
    return F.substring(b, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(size))


def _number(b: Column) -> Column:
    """Big-endian bytes, 8 at most, as a signed long."""
    return F.conv(F.hex(b), 16, -10).cast("long")


def _reversed(b: Column, size: int) -> Column:
    return F.concat(*[F.substring(b, k, 1) for k in range(size, 0, -1)])


def unsigned(b: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """The unsigned integer of `size` (1 to 4) bytes at an offset; null beyond the end."""
    part = _slice(b, at, size)
    part = _reversed(part, size) if little and size > 1 else part
    return F.when(F.octet_length(b) >= (F.lit(at) if isinstance(at, int) else at) + size, _number(part))


def signed32(b: Column, at: int, little: Column) -> Column:
    raw = F.when(little, unsigned(b, at, 4, True)).otherwise(unsigned(b, at, 4))
    return F.when(raw >= 2**31, raw - 2**32).otherwise(raw).cast("int")


def _double(bits: Column) -> Column:
    """IEEE 754 bits as a double, exact for every value: mantissa times a power of two, taken in two steps for subnormals."""
    fraction, power = bits.bitwiseAND(4503599627370495), F.shiftrightunsigned(bits, 52).bitwiseAND(2047).cast("int")
    whole = F.when(power == 0, fraction).otherwise(fraction + 4503599627370496).cast("double")
    shift = F.when(power == 0, F.lit(1)).otherwise(power)
    size = whole * F.pow(F.lit(2.0), F.greatest(shift - 1075, F.lit(-1000)).cast("double")) * F.pow(F.lit(2.0), F.least(shift - 75, F.lit(0)).cast("double"))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(power == 2047, special).otherwise(size) * F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def double(b: Column, at: Column | int, little: Column | bool = True) -> Column:
    """The double at an offset; null beyond the end."""
    part = _slice(b, at, 8)
    if isinstance(little, bool):
        bits = _number(_reversed(part, 8) if little else part)
    else:
        bits = F.when(little, _number(_reversed(part, 8))).otherwise(_number(part))
    return F.when(F.octet_length(b) >= (F.lit(at) if isinstance(at, int) else at) + 8, _double(bits))


def flags(blob: Column) -> Column:
    """The flag byte of a well-formed header; null if the magic or the version is another or the blob is short."""
    good = (F.octet_length(blob) >= 8) & (F.hex(F.substring(blob, 1, 3)) == "475000")
    return F.when(good, unsigned(blob, 3, 1))


def _indicator(blob: Column) -> Column:
    return F.shiftright(flags(blob), 1).bitwiseAND(7)


def is_little(blob: Column) -> Column:
    return flags(blob).bitwiseAND(LITTLE) == 1


def body_offset(blob: Column) -> Column:
    """Where the WKB body starts; null for a bad header, an indicator above 4, or a blob that ends before."""
    sizes = F.create_map(*[F.lit(x) for kv in ENVELOPE_BYTES.items() for x in kv])
    at = 8 + F.try_element_at(sizes, _indicator(blob).cast("int"))
    return F.when(F.octet_length(blob) >= at, at)


def body(blob: Column) -> Column:
    return F.when(body_offset(blob).isNotNull(), F.substring(blob, body_offset(blob) + 1, F.octet_length(blob)))


def header(blob: Column) -> Column:
    """srs_id, indicator, empty, extended, little and body_offset of a geometry blob; null if the header is bad."""
    little = is_little(blob)
    fields = F.struct(
        signed32(blob, 4, little).alias("srs_id"),
        _indicator(blob).cast("int").alias("indicator"),
        (flags(blob).bitwiseAND(EMPTY) > 0).alias("empty"),
        (flags(blob).bitwiseAND(EXTENDED) > 0).alias("extended"),
        little.alias("little"),
        body_offset(blob).cast("int").alias("body_offset"),
    )
    return F.when(body_offset(blob).isNotNull(), fields)


def header_envelope(blob: Column) -> Column:
    """minx, maxx, miny, maxy from the header; null where it has no envelope or says that the geometry is empty."""
    little = is_little(blob)
    there = (_indicator(blob) > 0) & body_offset(blob).isNotNull() & (flags(blob).bitwiseAND(EMPTY) == 0)
    values = [double(blob, 8 + 8 * k, little).alias(n) for k, n in enumerate(("minx", "maxx", "miny", "maxy"))]
    return F.when(there, F.struct(*values))


def once(value: Column) -> Column:
    """value, marked as not deterministic, so that the optimizer keeps it a column of its own.

    A filter on a column derived from it would else be moved below, with the whole expression copied into
    each comparison until the generated method outgrows its limit.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def with_header_envelope(df: DataFrame, blob: str, names: tuple[str, ...] = ("minx", "maxx", "miny", "maxy")) -> DataFrame:
    """df with the columns of header_envelope(), decoded in steps: flags, raw bits, doubles.

    One expression for it all would repeat the bits in each branch and outgrow a generated method; as
    columns of their own they are computed once and every step stays compiled.
    """
    b = F.col(blob)
    step = df.withColumn("_flags", flags(b)).withColumn("_at", body_offset(b))
    there = (F.shiftright("_flags", 1).bitwiseAND(7) > 0) & F.col("_at").isNotNull() & (F.col("_flags").bitwiseAND(EMPTY) == 0)
    raw = F.hex(F.substring(b, 9, 32))
    swapped = F.regexp_replace(F.reverse(raw), "(.)(.)", "$2$1")  # the bytes from last to first
    step = step.withColumn("_little", F.col("_flags").bitwiseAND(LITTLE) == 1).withColumn("_raw", once(F.when(there, F.when(F.col("_little"), swapped).otherwise(raw))))
    first = lambda k: F.when(F.col("_little"), 49 - 16 * k).otherwise(16 * k + 1)
    bits = {f"_bits{k}": once(F.conv(F.substring(F.col("_raw"), first(k), F.lit(16)), 16, -10).cast("long")) for k in range(4)}
    out = step.withColumns(bits).withColumns({n: once(_double(F.col(f"_bits{k}"))) for k, n in enumerate(names)})
    return out.drop("_flags", "_at", "_raw", "_little", *bits)


def wkb_code(wkb: Column) -> Column:
    """The ISO type code of a WKB body, extended flag bits taken off; null for a bad byte order or a short body."""
    order = unsigned(wkb, 0, 1)
    raw = F.when(order == 1, unsigned(wkb, 1, 4, True)).when(order == 0, unsigned(wkb, 1, 4))
    return F.when(raw < 0x20000000, raw).otherwise(raw.bitwiseAND(0xFF)).cast("int")


def base_type(code: Column) -> Column:
    return (code % 1000).cast("int")


def dimensions(code: Column) -> Column:
    """0 XY, 1 XYZ, 2 XYM, 3 XYZM."""
    return F.floor(code / 1000).cast("int")


def png_size(payload: Column) -> Column:
    """width and height of a PNG payload, from its header; null for anything else."""
    good = (F.hex(F.substring(payload, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(payload, 13, 4)) == "49484452") & (F.octet_length(payload) >= 24)
    return F.when(good, F.struct(unsigned(payload, 16, 4).alias("width"), unsigned(payload, 20, 4).alias("height")))
