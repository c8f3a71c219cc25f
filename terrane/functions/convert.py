"""Dates, datetimes and typed values from text and stored classes, as expressions that never throw.

Each reading gives a value or null; error() of the same input says what is wrong.  Strict datetimes are
YYYY-MM-DDTHH:MM:SS.SSSZ exactly; lenient ones allow a space, no or one to nine fraction digits, and no
zone, Z, +HH:MM, +HHMM or +HH.  No zone counts as UTC.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
STRICT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$"
LENIENT = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,9}))?(Z|[+-][0-9]{2}(?::?[0-9]{2})?)?$"
DAY = 86_400_000_000


@dataclass(frozen=True)
class Options:
    """What a conversion lets pass: each switch on its own, or all by LENIENT_READING and STRICT_READING."""

    any_boolean: bool = True  # an INTEGER other than 0 and 1 is true
    loose_datetime: bool = True  # the wider shapes of a datetime
    integer_as_real: bool = True  # an INTEGER in a column of floats


LENIENT_READING, STRICT_READING = Options(), Options(False, False, False)


def date(text: Column) -> Column:
    """A DATE: ten characters, valid in the calendar; else null."""
    return F.when(text.rlike(DATE), text.try_cast("date"))


def date_days(text: Column) -> Column:
    """Days since 1970-01-01 of a DATE text."""
    return F.unix_date(date(text))


def date_from_days(days: Column) -> Column:
    return F.date_from_unix_date(days)


def _part(text: Column, group: int) -> Column:
    return F.regexp_extract(text, LENIENT, group)


def offset_minutes(text: Column) -> Column:
    """Minutes east of UTC of a lenient datetime's zone: 0 for Z, null for none or a bad one."""
    zone = _part(text, 6)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.coalesce(F.nullif(F.right(F.regexp_replace(zone, "^[+-][0-9]{2}:?", ""), F.lit(2)), F.lit("")).try_cast("int"), F.lit(0))
    signed = F.when(zone.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes)
    return F.when(zone == "Z", 0).when((zone != "") & (hours <= 23) & (minutes <= 59), signed)


def nanoseconds(text: Column) -> Column:
    """The fraction of a lenient datetime, in nanoseconds."""
    return F.when(text.rlike(LENIENT), F.rpad(_part(text, 5), 9, "0").try_cast("int"))


def datetime_micros(text: Column, lenient: bool = True) -> Column:
    """Microseconds since the epoch, the offset taken off, finer digits cut; null where the text is malformed or out of range."""
    days = F.unix_date(_part(text, 1).try_cast("date")).cast("long")
    hour, minute, second = (_part(text, k).try_cast("int") for k in (2, 3, 4))
    zone = _part(text, 6)
    fine = (hour <= 23) & (minute <= 59) & (second <= 59) & ((zone == "") | offset_minutes(text).isNotNull())
    at = days * DAY + (hour * 3600 + minute * 60 + second).cast("long") * 1_000_000 + F.floor(F.coalesce(nanoseconds(text), F.lit(0)) / 1000)
    shape = LENIENT if lenient else STRICT
    return F.when(text.rlike(shape) & fine, at - F.coalesce(offset_minutes(text), F.lit(0)).cast("long") * 60_000_000)


def datetime(text: Column, lenient: bool = True) -> Column:
    return F.timestamp_micros(datetime_micros(text, lenient))


def date_error(text: Column) -> Column:
    """Null, 'malformed' or 'out of range'."""
    return F.when(text.isNotNull() & ~text.rlike(DATE), "malformed").when(text.isNotNull() & date(text).isNull(), "out of range")


def datetime_error(text: Column, lenient: bool = True) -> Column:
    return F.when(text.isNotNull() & ~text.rlike(LENIENT if lenient else STRICT), "malformed").when(text.isNotNull() & datetime_micros(text, lenient).isNull(), "out of range")


def format_micros(micros: Column, offset: Column | None = None) -> Column:
    """YYYY-MM-DDTHH:MM:SS.SSS of microseconds since the epoch, with nine digits where three don't do, and Z; with an offset in minutes, the time there and +HH:MM or -HH:MM."""
    local = micros if offset is None else micros + F.coalesce(offset, F.lit(0)).cast("long") * 60_000_000
    seconds = F.floor(local / 1_000_000)
    rest = local - seconds * 1_000_000
    stem = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    whole = F.lpad(F.floor(rest / 1000).cast("string"), 3, "0")
    fraction = F.when(rest % 1000 == 0, whole).otherwise(F.concat(F.lpad(rest.cast("string"), 6, "0"), F.lit("000")))
    zone = F.lit("Z")
    if offset is not None:
        two = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
        shown = F.concat(F.when(offset < 0, "-").otherwise("+"), two(F.abs(offset) / 60), F.lit(":"), two(F.abs(offset) % 60))
        zone = F.when(offset.isNull(), F.lit("Z")).otherwise(shown)
    return F.concat(stem, F.lit("."), fraction, zone)


def boolean(number: Column) -> Column:
    """An INTEGER read as BOOLEAN, leniently: anything but 0 is true."""
    return number != 0


def boolean_strict(number: Column) -> Column:
    return F.when(number.isin(0, 1), number == 1)


# The storage classes that each declared type accepts.
ACCEPTED = {"BOOLEAN": ("integer",), "TINYINT": ("integer",), "SMALLINT": ("integer",), "MEDIUMINT": ("integer",), "INT": ("integer",), "INTEGER": ("integer",), "FLOAT": ("real", "integer"), "DOUBLE": ("real", "integer"), "REAL": ("real", "integer"), "TEXT": ("text",), "BLOB": ("blob",), "DATE": ("text",), "DATETIME": ("text",)}


def storage_error(declared: Column, storage: Column, strict: bool = False) -> Column:
    """What is wrong with a storage class under a declared type: null, or 'storage class ... in a ... column'."""
    allowed = F.lit(False)
    for name, classes in ACCEPTED.items():
        kept = [c for c in classes if not (strict and name in ("FLOAT", "DOUBLE", "REAL") and c == "integer")]
        allowed = allowed | ((declared == name) & storage.isin(*kept))
    return F.when((storage != "null") & ~allowed & declared.isin(*ACCEPTED), F.concat(F.lit("storage class "), storage, F.lit(" in a "), declared, F.lit(" column")))
