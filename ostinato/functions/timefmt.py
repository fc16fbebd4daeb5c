"""Times as text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hms(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def hms_round(seconds: Column) -> Column:
    """H:MM:SS of seconds rounded half to even, with carry."""
    return _hms(F.bround(seconds, 0))


def hms_floor(seconds: Column) -> Column:
    return _hms(F.floor(seconds))


def parse_hms(text: Column) -> Column:
    """H:MM:SS (any number of hour digits) or a plain number of seconds; else null."""
    part = lambda i: F.split_part(text, F.lit(":"), F.lit(i)).try_cast("double")
    clock = part(1) * 3600 + part(2) * 60 + part(3)
    return F.when(text.rlike(r"^\d+:\d{2}:\d{2}$"), clock).otherwise(text.try_cast("double"))
