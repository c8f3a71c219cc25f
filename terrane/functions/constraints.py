"""Column constraints as boolean expressions: ranges, enumerations and globs.  A null value passes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(value: Column, low: float, high: float, low_inclusive: bool = True, high_inclusive: bool = True) -> Column:
    number = value.cast("double")
    above = number >= low if low_inclusive else number > low
    below = number <= high if high_inclusive else number < high
    return value.isNull() | (above & below)


def decimal_text(value: Column, kind: str) -> Column:
    """A number as the text that an enumeration lists: whole doubles without a fraction."""
    if kind in ("float", "double"):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def in_enum(value: Column, members: list[str], kind: str = "string") -> Column:
    return value.isNull() | decimal_text(value, kind).isin(*members)


def glob_regex(pattern: str) -> str | None:
    """An anchored regular expression for a glob: * any run, ? one character, [..] a class with ranges, ^ negating;
    a ] that comes first is itself, and null stands for a class that never ends, which matches nothing."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c != "[":
            out.append(re.escape(c))
        else:
            negate = pattern[at : at + 1] == "^"
            at += negate
            end = pattern.find("]", at + 1)
            if end < 0:
                return None
            inner, parts, k = pattern[at:end], [], 0
            while k < len(inner):
                if k + 2 < len(inner) and inner[k + 1] == "-":
                    low, high = inner[k], inner[k + 2]
                    if low <= high:
                        parts.append(f"\\x{{{ord(low):x}}}-\\x{{{ord(high):x}}}")
                    k += 3
                else:
                    parts.append(f"\\x{{{ord(inner[k]):x}}}")
                    k += 1
            body = "".join(parts)
            out.append(f"[{'^' if negate else ''}{body}]" if body else ("." if negate else "(?!)"))
            at = end + 1
    return "(?s)^" + "".join(out) + r"\z"


def matches_glob(value: Column, pattern: str) -> Column:
    regex = glob_regex(pattern)
    return value.isNull() | (F.lit(False) if regex is None else value.cast("string").rlike(regex))


def constraint(kind: str, value: Column, value_type: str = "string", **spec) -> Column:
    """The check of a constraint row: range (text fails), enum or glob."""
    if kind == "range":
        return value.isNull() if value_type == "string" else in_range(value, **spec)
    if kind == "enum":
        return in_enum(value, spec["members"], value_type)
    if kind == "glob":
        return matches_glob(value, spec["pattern"])
    raise ValueError(f"unknown constraint {kind}")
