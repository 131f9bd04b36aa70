"""Timestamps: parsing in several formats, calendar features, log levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level names (English and Korean) -> the six levels.
LEVELS = {
    "정보": "INFO",
    "경고": "WARN",
    "오류": "ERROR",
    "심각": "ERROR",
    "디버그": "DEBUG",
    "INFO": "INFO",
    "WARN": "WARN",
    "WARNING": "WARN",
    "ERROR": "ERROR",
    "SEVERE": "ERROR",
    "DEBUG": "DEBUG",
    "TRACE": "TRACE",
    "FATAL": "FATAL",
}

_CLOCK = r"^\d{2}:\d{2}:\d{2}\.\d{3,6}$"
_ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS"
_FRACTION = "[.SSSSSS]"  # reads one to six digits


def normalize_level(c: Column, levels: dict[str, str] = LEVELS) -> Column:
    """Map a level name to one of the six levels; unknown names are upper-cased."""
    table = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
    return F.coalesce(table[c], F.upper(c))


def _ntz(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")


def timestamp_text(raw: Column) -> Column:
    """Comma fractions become points, runs of white space one blank."""
    return F.regexp_replace(F.translate(raw, ",", "."), r"\s+", " ")


def _month_case(c: Column) -> Column:
    """``18-MAR-2030 ...`` -> ``18-Mar-2030 ...``."""
    return F.concat(F.left(c, F.lit(3)), F.initcap(F.substring(c, 4, 3)), F.substring(c, F.lit(7), F.length(c)))


def full_timestamp(raw: Column, two_digit_year: bool = True, seconds_only: bool = True) -> Column:
    """Timestamp of a text that carries its date; null when no format fits.

    The text has single blanks and a point before the fraction (``timestamp_text``).
    """
    c = raw
    tries = [
        F.when(
            c.rlike(r"^\d{2}-[A-Za-z]{3}-\d{4} "),
            _ntz(_month_case(c), f"dd-MMM-yyyy HH:mm:ss{_FRACTION}"),
        ),
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2} .*\."), _ntz(c, f"yyyy-MM-dd HH:mm:ss{_FRACTION}")),
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T.*\."), _ntz(c, f"yyyy-MM-dd'T'HH:mm:ss{_FRACTION}")),
    ]
    if two_digit_year:
        short = c.rlike(r"^\d{2}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")
        tries.append(F.when(short, _ntz(F.concat(F.lit("20"), c), "yyyy-MM-dd HH:mm:ss")))
    if seconds_only:
        whole = c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")
        tries.append(F.when(whole, _ntz(c, "yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(*tries)


def is_clock(raw: Column) -> Column:
    """True for a time of day without a date that is a possible time."""
    return raw.rlike(_CLOCK) & _clock_on(F.lit("2000-01-01"), raw).isNotNull()


def _clock_on(day: Column, raw: Column) -> Column:
    return _ntz(F.concat_ws(" ", day, raw), f"yyyy-MM-dd HH:mm:ss{_FRACTION}")


def clock_on_date(raw: Column, date: Column) -> Column:
    """Timestamp of a time of day on the given date."""
    return F.when(date.isNotNull(), _clock_on(F.date_format(date, "yyyy-MM-dd"), raw))


def iso_millis(ts: Column) -> Column:
    """ISO-8601 text with milliseconds, without a zone."""
    return F.date_format(ts, _ISO_MS)


def lenient_timestamp(raw: Column, base_date: Column) -> Column:
    """UTC timestamp of ``HH:MM:SS`` (on ``base_date``), a plain or an ISO date-time."""
    c = F.trim(raw)
    clock = c.rlike(r"^\d{1,2}:\d{2}:\d{2}$")
    return F.coalesce(
        F.when(
            clock,
            F.try_to_timestamp(
                F.concat_ws(" ", F.date_format(base_date, "yyyy-MM-dd"), c),
                F.lit("yyyy-MM-dd H:mm:ss"),
            ),
        ),
        F.when(~clock, F.try_to_timestamp(c)),
    )


def utc_timestamp(raw: Column) -> Column:
    """UTC timestamp of a text in any ISO form; null when it cannot be read."""
    return F.try_to_timestamp(F.trim(raw))


def _micros_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))


def millis_between(later: Column, earlier: Column) -> Column:
    """Difference in milliseconds as a double."""
    return _micros_between(later, earlier).cast("double") / 1000.0


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference in seconds as a double."""
    return _micros_between(later, earlier).cast("double") / 1_000_000.0


def calendar(ts: Column, zone: str | None = None) -> dict[str, Column]:
    """Time features of a timestamp; weekday counts from Monday = 0, hours 9..17 are business."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz")) if zone else ts
    hour, day = F.hour(local), F.weekday(local)
    return {
        "ts_epoch_ms": F.unix_millis(ts),
        "ts_hour": hour.cast("bigint"),
        "ts_minute": F.minute(local).cast("bigint"),
        "ts_second": F.second(local).cast("bigint"),
        "ts_millisecond": F.pmod(F.unix_millis(ts), F.lit(1000)),
        "ts_dayofweek": day.cast("bigint"),
        "ts_is_weekend": F.coalesce(day.isin(5, 6), F.lit(False)).cast("tinyint"),
        "ts_is_business_hours": F.coalesce(hour.between(9, 17), F.lit(False)).cast("tinyint"),
    }
