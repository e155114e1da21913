"""Durations for people; scalar expressions of the loaders."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_text(seconds: float) -> str:
    """Hours, minutes and seconds to the millisecond."""
    return str(timedelta(milliseconds=round(seconds * 1000)))


def title_of(title: Column) -> Column:
    """The title without a year at its end."""
    return F.when(title.rlike(r"^.+ \(\d+\)$"), F.regexp_extract(title, r"^(.+) \((\d+)\)$", 1)).otherwise(title)


def year_of(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, r"^(.+) \((\d+)\)$", 2), F.lit("")).cast("int")


def genres_of(genres: Column) -> Column:
    """Distinct names: runs of other characters than letters and digits become ``_``."""
    return F.array_distinct(F.transform(F.split(genres, r"\|"), lambda g: F.lower(F.regexp_replace(g, "[^a-zA-Z0-9]+", "_"))))


def blank_as_absent(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))
