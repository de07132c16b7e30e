"""Text, date and request helpers."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- observations
def normalize_confidence(value) -> Column:
    """high / nominal / low from letters, words or a percentage (80 and 30 are the bounds); null for anything else."""
    v = F.lower(F.trim(col(value)))
    percent = F.when(v.rlike(r"^[0-9]+(\.[0-9]+)?$"), v.try_cast("double"))
    return (
        F.when(v.isin("h", "high"), "high").when(v.isin("n", "nominal"), "nominal").when(v.isin("l", "low"), "low")
        .when(percent >= 80, "high").when(percent >= 30, "nominal").when(percent.isNotNull(), "low")
    )


def sql_time(hhmm) -> Column:
    """'HHMM', leading zeros optional, as 'HH:MM:00'; null if it isn't a time."""
    t = F.trim(col(hhmm))
    padded = F.lpad(t, 4, "0")
    hour, minute = F.substring(padded, 1, 2), F.substring(padded, 3, 2)
    ok = t.rlike("^[0-9]{1,4}$") & (hour.try_cast("int") <= 23) & (minute.try_cast("int") <= 59)
    return F.when(ok, F.concat_ws(":", hour, minute, F.lit("00")))


def acquired_at(day, hhmm) -> Column:
    """Acquisition time; null for a day or time that doesn't exist."""
    return F.try_to_timestamp(F.concat_ws(" ", col(day), sql_time(hhmm)), F.lit("yyyy-MM-dd HH:mm:ss"))


# ---- official statistics
def statistics_number(raw) -> Column:
    """'1 234,5' as 1234.5; blanks, dashes and words as null."""
    bare = F.regexp_replace(F.regexp_replace(col(raw), r"[\s   ]", ""), ",", ".")
    return F.when(bare.rlike(r"^-?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?$"), bare.try_cast("double"))


def normalize_region_name(raw) -> Column:
    """Lower case, one kind of e, dash and space, no quotes, no punctuation at the end."""
    x = F.regexp_replace(F.lower(col(raw)), "ё", "е")
    for pattern, by in (
        (r"[   \t\r\n]", " "), (r"[‐-―−­]", "-"), ("[\"«»“”„']", ""), (r"\s*-\s*", "-"),
        (r"\s*\(\s*", " ("), (r"\s*\)\s*", ") "), (r"\s+", " "), (r"[.,;:\s]+$", ""),
    ):
        x = F.regexp_replace(x, pattern, by)
    return F.trim(x)


def strip_city_prefix(name) -> Column:
    return F.trim(F.regexp_replace(col(name), r"^(г\.\s?|город федерального значения |город )", ""))


def strip_parens(name) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col(name), r"\s*\([^)]*\)\s*", " "), r"\s+", " "))


def first_filled(*columns) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns])


# ---- exports
def csv_cell(value, is_text: bool = True) -> Column:
    """A field: null empty, quotes doubled, quoted where needed; texts that a spreadsheet would run get an apostrophe."""
    v = F.coalesce(col(value).cast("string"), F.lit(""))
    if is_text:
        v = F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)
    return F.when(v.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_line(columns: list[tuple[str, bool]]) -> Column:
    return F.concat_ws(",", *[csv_cell(c, is_text) for c, is_text in columns])


def ascii_json(value) -> Column:
    """Text with every character beyond ASCII as its escape."""
    units = F.regexp_extract_all(F.hex(F.encode(col(value), "UTF-16BE")), F.lit("(.{4})"), 1)
    shown = F.transform(units, lambda u: F.when(u < F.lit("0080"), F.decode(F.unhex(F.substring(u, 3, 2)), "UTF-8")).otherwise(F.concat(F.lit("\\u"), F.lower(u))))
    return F.array_join(shown, "")


COMPASS = ("north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west")


def compass_words(bearing) -> Column:
    """One of eight sectors of 45 degrees."""
    sector = F.pmod(F.floor(col(bearing) / 45.0 + 0.5), F.lit(8)).cast("int")
    return F.element_at(F.array(*[F.lit(w) for w in COMPASS]), sector + 1)


def format_bbox(*edges) -> Column:
    return F.concat_ws(",", *[F.format_string("%.5f", col(e)) for e in edges])


# ---- quality
def excerpt(body, most: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(col(body), r"\s+", " ")), 1, most)


def looks_like_markup(body) -> Column:
    return F.coalesce(col(body).rlike(r"^\s*<"), F.lit(False))


def is_png(body) -> Column:
    return F.coalesce(F.substring(col(body), 1, 8) == F.unhex(F.lit("89504E470D0A1A0A")), F.lit(False))


# ---- dates in file names
def version_date(name, pattern: str = r"v?(\d{8})") -> Column:
    """The date in a name like v20240131; null if there is none or it doesn't exist."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(col(name), pattern, 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def distribution_problem(version, today) -> Column:
    """Why a version like v20240131 can't be used: format, no real day, in the future, before 2023; null when it can."""
    v, day = col(version), version_date(version, r"^v(\d{8})$")
    return (
        F.when(v.isNull() | ~v.rlike(r"^v[0-9]{8}$"), "format").when(day.isNull(), "not a day")
        .when(day > col(today), "in the future").when(F.year(day) < 2023, "too old")
    )


# ---- requests (driver side, never on data)
def first_text(value) -> str | None:
    value = value[0] if isinstance(value, (list, tuple)) and value else value
    return value.strip() or None if isinstance(value, str) else None


def iso_date(value) -> str | None:
    text = first_text(value)
    if not text or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return None
    try:
        return dt.date.fromisoformat(text).isoformat()
    except ValueError:
        return None


def _number(value) -> float | None:
    try:
        n = float(first_text(value) if not isinstance(value, (int, float)) else value)
    except (TypeError, ValueError):
        return None
    return n if n == n and abs(n) != float("inf") else None


def clamp_limit(value, default: int = 12, most: int = 100) -> int:
    n = _number(value)
    return default if n is None else min(max(int(n), 1), most)


def clamp_offset(value) -> int:
    n = _number(value)
    return 0 if n is None or n < 0 else int(n)


def bounded_int(value, low: int, high: int, default: int | None = None) -> int | None:
    """Days (1 to 30), years (2001 to 2100), ids (1 to 2**31 - 1): a whole number in range, else the default."""
    n = _number(value)
    return int(n) if n is not None and n == int(n) and low <= n <= high else default


def platform_label(platform, scene_id) -> Column:
    """The satellite of a scene as it is shown: by its platform, else by the beginning of its id, else the mission's name alone."""
    letter = F.upper(F.coalesce(F.nullif(F.regexp_extract(F.coalesce(col(platform), F.lit("")), r"(?i)^sentinel-2([abc])$", 1), F.lit("")), F.nullif(F.regexp_extract(F.coalesce(col(scene_id).cast("string"), F.lit("")), r"^S2([ABC])_", 1), F.lit(""))))
    return F.concat(F.lit("Sentinel-2"), F.coalesce(letter, F.lit("")))
