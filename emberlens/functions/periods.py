"""Time spans of an incident's pictures and of the feed, as column expressions. ``as_of`` is always given: nothing reads a clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from emberlens.functions import text as T
from emberlens.functions.numeric import num

#: Days before the first detection in which a picture counts as one from before, up to the day before it.
BEFORE_DAYS = 60
#: The first year of a vegetation series.
FIRST_YEAR = 2017


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def before_window(first_seen: Column) -> Column:
    return _span(first_seen - F.expr(f"INTERVAL '{BEFORE_DAYS}' DAY"), first_seen - F.expr("INTERVAL '1' DAY"))


def after_window(last_seen: Column, as_of: Column) -> Column:
    """From a second after the last detection; null where that isn't past."""
    start = last_seen + F.expr("INTERVAL '1' SECOND")
    return F.when(start < as_of, _span(start, as_of))


def activity_window(first_seen: Column, last_seen: Column) -> Column:
    return _span(first_seen, last_seen)


def summer_window(year) -> Column:
    """July and August, to the last millisecond."""
    y = num(year).cast("int")
    return _span(F.make_timestamp(y, F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp(y, F.lit(8), F.lit(31), F.lit(23), F.lit(59), F.lit(59.999)))


def is_partial(year, as_of: Column) -> Column:
    return as_of < summer_window(year)["end"]


def search_window(year, as_of: Column) -> Column:
    """The summer of a year, cut at ``as_of``."""
    w = summer_window(year)
    return _span(w["start"], F.when(is_partial(year, as_of), as_of).otherwise(w["end"]))


def series_years(as_of: Column, first: int = FIRST_YEAR) -> Column:
    """The years from ``first`` whose summer has begun; none before that."""
    year = F.year(as_of)
    last = F.when(as_of >= summer_window(year)["start"], year).otherwise(year - 1)
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.expr("cast(array() as array<int>)"))


def period_start(as_of: Column, days: int) -> Column:
    """First day of the last ``days`` days, today included."""
    return F.date_sub(F.to_date(as_of), days - 1)


def recent_start(as_of: Column, days: int = 90) -> Column:
    return F.date_sub(F.to_date(as_of), days)


def period_range(period: str | None, start: str | None, end: str | None, as_of: dt.datetime) -> dict[str, str]:
    """A request's period ('7', '30', '90' or 'custom') as dates; a pair the wrong way round is swapped."""
    if not period:
        return {}
    if period == "custom":
        if start and end and start > end:
            start, end = end, start
        return {k: v for k, v in (("start_date", start), ("end_date", end)) if v}
    return {"start_date": (as_of - dt.timedelta(days=int(period) - 1)).date().isoformat()}


def day_span(days: Column) -> Column:
    """Days from the first to the last of a sorted array of days; null without any."""
    return F.datediff(F.element_at(days, -1), F.element_at(days, 1))


def nrt_since(as_of: Column, history_since: Column, days: int = 30) -> Column:
    """The first day of which all detections are at hand: what retention keeps, but not before the history began."""
    return F.greatest(F.date_sub(F.to_date(as_of), days), F.to_date(history_since))


def series_key(aoi: tuple, site: tuple) -> Column:
    """The key of a picture series: its area and the incident's site, as two incidents may share an area."""
    return F.concat(T.format_bbox(*aoi), F.lit("|"), T.format_bbox(*site))
