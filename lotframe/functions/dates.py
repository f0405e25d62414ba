"""Date coercion and day counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import strip

# Accepted spellings of a day in order of preference, month first. A
# pattern is tried only where its shape matches, so a column of one spelling
# costs one parse per row.
DAY_SHAPES = (
    (r"\d{4}-\d{1,2}-\d{1,2}", ("yyyy-M-d",)),
    (r"\d{1,2}/\d{1,2}/\d{4}", ("M/d/yyyy", "d/M/yyyy")),
    (r"\d{1,2}-\d{1,2}-\d{4}", ("M-d-yyyy", "d-M-yyyy")),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", ("M.d.yyyy", "d.M.yyyy")),
    (r"\d{1,2}/\d{1,2}/\d{2}", ("M/d/yy", "d/M/yy")),
    (r"\d{1,2}-\d{1,2}-\d{2}", ("M-d-yy", "d-M-yy")),
    (r"\d{4}/\d{1,2}/\d{1,2}", ("yyyy/M/d",)),
    (r"\d{8}", ("yyyyMMdd",)),
    (r"[A-Za-z]{3} \d{1,2} \d{4}", ("MMM d yyyy",)),
    (r"[A-Za-z]{4,9} \d{1,2} \d{4}", ("MMMM d yyyy",)),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", ("d MMM yyyy",)),
    (r"\d{1,2} [A-Za-z]{4,9} \d{4}", ("d MMMM yyyy",)),
    (r"\d{1,2} [A-Za-z]{3} \d{2}", ("d MMM yy",)),
    (r"[A-Za-z]{3} \d{1,2} \d{2}", ("MMM d yy",)),
)
#: Of these, the first are tried on a cell as it is, before anything is cut or replaced.
COMMON_SHAPES = 2
# Fixed value: a time of day after the day, with or without seconds and AM or PM.
TIME_OF_DAY = r"[ T]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.]\d+)?)? ?([AaPp][Mm])?$"
ISO_MOMENT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"

DAYS_PER_YEAR = 365.25


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _plain_day(day: Column) -> Column:
    """Spellings with month names without commas, full stops and hyphens."""
    spaced = F.regexp_replace(day, r"[,\s]+|(?<=[A-Za-z])[.-]|-(?=[A-Za-z])", " ")
    return F.when(day.rlike("[A-Za-z]"), F.initcap(F.btrim(F.regexp_replace(spaced, " +", " ")))).otherwise(day)


def _of_pattern(day: Column, pattern: str) -> Column:
    """Two-digit years from 69 on are of the last century."""
    parsed = F.try_to_timestamp(day, F.lit(pattern))
    if "yyyy" in pattern:
        return parsed

    def of_century(moment: Column) -> Column:
        earlier = F.add_months(F.to_date(moment), -1200).cast("timestamp")
        return F.when(F.year(moment) >= 2069, earlier).otherwise(moment)

    return _bound(parsed, of_century)


def _midnight(day: Column) -> Column:
    parsed = F.lit(None).cast("timestamp")
    for shape, patterns in reversed(DAY_SHAPES):
        tries = [_of_pattern(day, p) for p in patterns]
        parsed = F.when(day.rlike(f"^{shape}$"), F.coalesce(*tries)).otherwise(parsed)
    return parsed


def _seconds(text: Column) -> Column:
    """Seconds after midnight of the time of day at the end; null if there is no such time."""
    part = [F.regexp_extract(text, TIME_OF_DAY, i) for i in range(1, 5)]
    hour, minute, second = (F.coalesce(p.try_cast("int"), F.lit(0)) for p in part[:3])
    afternoon = F.when(F.lower(part[3]) == "pm", 12).otherwise(0)
    clock = F.when(part[3] == "", hour).when(hour.between(1, 12), hour % 12 + afternoon)
    valid = (clock < 24) & (minute < 60) & (second < 60)
    return F.when(valid, clock * 3600 + minute * 60 + second)


def lenient_date(text: Column) -> Column:
    """Timestamp of one cell, or null; the spelling is chosen row by row.

    A day may be followed by a time of day. Commas, a full stop after a month name and
    hyphens around one count as spaces; any white space may stand around.
    """

    def moment(text: Column) -> Column:
        midnight = _bound(_plain_day(F.regexp_replace(text, TIME_OF_DAY, "")), _midnight)
        clock = F.when(text.rlike(TIME_OF_DAY), _seconds(text)).otherwise(F.lit(0))
        iso = F.when(text.rlike(ISO_MOMENT), F.try_to_timestamp(text))
        return F.coalesce(iso, F.timestamp_seconds(F.unix_seconds(midnight) + clock))

    text = text.cast("string")
    common = F.lit(None).cast("timestamp")
    for shape, patterns in reversed(DAY_SHAPES[:COMMON_SHAPES]):
        common = F.when(text.rlike(rf"^{shape}\z"), F.coalesce(*[_of_pattern(text, p) for p in patterns])).otherwise(common)
    is_common = text.rlike("^(" + "|".join(shape for shape, _ in DAY_SHAPES[:COMMON_SHAPES]) + r")\z")
    return F.when(is_common, common).otherwise(_bound(strip(text), moment))


def whole_days(start: Column, end: Column) -> Column:
    """Floor of the elapsed days, in wall-clock time.

    ``datediff`` counts midnights; a later time of day on ``start`` means the
    last day is not complete.
    """
    clock = "HH:mm:ss.SSSSSS"
    incomplete = F.date_format(start, clock) > F.date_format(end, clock)
    return F.datediff(end, start) - F.when(incomplete, 1).otherwise(0)


def years_held(acquired: Column, as_of: Column) -> Column:
    """Years from a timestamp to midnight of ``as_of``; negative if later."""
    day = F.to_date(as_of)
    unfinished = F.when(acquired > F.date_trunc("day", acquired), 1).otherwise(0)
    return (F.datediff(day, F.to_date(acquired)) - unfinished) / F.lit(DAYS_PER_YEAR)


def years_between(start: Column, end: Column) -> Column:
    """Years of whole days, null unless at least one day passed."""
    days = whole_days(start, end)
    return F.when(days > 0, days / F.lit(DAYS_PER_YEAR))
