"""Text and clock expressions of the event log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weekday order.
WEEK = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def clock(minute: Column) -> Column:
    """Minute of the day as HH:MM; hours are not wrapped."""
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))


def minutes(text: Column) -> Column:
    """HH:MM as minutes, null unless both parts are numbers."""
    parts = F.split(text, ":")
    return F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")


def cell_label(r: Column, c: Column) -> tuple[Column, Column]:
    """Row letter and column number as the plan shows them."""
    return F.char(97 + r), 14 - c


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def name_list(text: Column, default: list[str]) -> Column:
    """Comma-separated names, trimmed, without empty ones; ``default`` when none are left."""
    names = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(names) > 0, names).otherwise(F.array(*[F.lit(x) for x in default]))


def duration(seconds: Column) -> Column:
    """Seconds as ``Xm YYs``, or ``Ys`` under a minute."""
    s = F.bround(seconds).cast("long")
    return F.when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def weekday(day: Column) -> Column:
    """Place in the week from 0, 99 for unknown days."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(d) for d in WEEK]), day), F.lit(0)) - 1, F.lit(99)).cast("int")


def hue(identity: Column) -> Column:
    """A colour's hue (0 to 1) for an id, spread by the golden ratio."""
    return (identity * 0.618033988749895) % 1.0
