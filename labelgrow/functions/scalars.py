"""Scalar expressions that the operators share. NaN and infinities become null here and nowhere else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(c: Column, lower: bool = False) -> Column:
    """A key without outer blanks and with inner runs of blanks as one; empty is null."""
    tidy = F.regexp_replace(F.trim(F.regexp_replace(c.cast("string"), r"[ \t\r\n]+", " ")), "^$", "")
    tidy = F.translate(tidy, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if lower else tidy
    return F.when(tidy != "", tidy)


def finite(c: Column) -> Column:
    """The value as a double; null if it isn't a finite number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def segment(name: Column, i: int) -> Column:
    """The i-th part, from 0, of a dotted name."""
    return F.get(F.split(name, r"\."), F.lit(i))


def family(name: Column, prefix: str = "features") -> Column:
    """The family of a dotted name: its second part, or the second and third under ``prefix``."""
    parts = F.split(name, r"\.")
    return F.when(segment(name, 0) == prefix, F.array_join(F.slice(parts, 2, 2), ".")).otherwise(segment(name, 1))


def hash32(c: Column) -> Column:
    """The first 32 bits of the MD5 of a string, as a long: the same in any engine."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def bucket(c: Column, n: int) -> Column:
    """A string's bucket among n."""
    return F.pmod(hash32(c), F.lit(n)).cast("int")


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b; ``default`` where b is zero."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def label_ids(label: str) -> str:
    """The name of a label's provenance column."""
    return f"{label}_ids"
