"""Dates: seconds since 1970 (UTC), texts, and broken-down times [year, month from 0, day, h, m, s, weekday from Sunday
0, day of year from 0]. All is counted on timestamps without a time zone, so the session's own plays no part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
#: Letters of % formats and the patterns that read them.
_PATTERNS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "p": "a", "I": "hh", "Z": "'UTC'", "z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "%": "%"}
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pattern(fmt: str) -> str:
    """A date pattern, for reading, for a % format."""
    out, i, text = "", 0, ""

    def quoted(t: str) -> str:
        return "'" + t.replace("'", "''") + "'" if t else ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in _PATTERNS:
                raise ValueError(f"%{fmt[i + 1]} is not supported")
            out, text, i = out + quoted(text) + _PATTERNS[fmt[i + 1]], "", i + 2
        else:
            text, i = text + fmt[i], i + 1
    return out + quoted(text)


def timestamp(seconds: Column | str) -> Column:
    """The timestamp, without a time zone, that is so many seconds after 1970 began."""
    whole = F.floor(_c(seconds))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(whole / 86400).cast("int")).cast("timestamp_ntz")
    part = (whole - F.floor(whole / 86400) * 86400).cast("int")
    return day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), part.cast("decimal(18,6)"))


def seconds(t: Column | str) -> Column:
    """Whole seconds from 1970 to a timestamp without a time zone."""
    t = _c(t).cast("timestamp_ntz")
    return F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))


def todate(seconds_: Column | str) -> Column:
    return F.concat(F.replace(timestamp(seconds_).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def fromdate(text: Column | str) -> Column:
    return strptime(text, "%Y-%m-%dT%H:%M:%SZ")


def strptime(text: Column | str, fmt: str) -> Column:
    """Seconds of a text in a % format, which is read as UTC; null if it is not in the format."""
    return seconds(F.to_timestamp_ntz(_c(text), F.lit(pattern(fmt))))


def strftime(seconds_: Column | str, fmt: str) -> Column:
    """Seconds as a text in a % format, part by part."""
    t = timestamp(seconds_)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    named = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at)
    year, hour = F.lpad(F.year(t).cast("string"), 4, "0"), F.hour(t)
    of = {
        "Y": year, "m": two(F.month(t)), "d": two(F.day(t)), "H": two(hour), "M": two(F.minute(t)), "S": two(F.second(t).cast("int")), "y": F.substring(year, 3, 2),
        "B": named(_MONTHS, F.month(t)), "b": F.substring(named(_MONTHS, F.month(t)), 1, 3), "A": named(_DAYS, F.dayofweek(t)), "a": F.substring(named(_DAYS, F.dayofweek(t)), 1, 3),
        "j": F.lpad(F.dayofyear(t).cast("string"), 3, "0"), "p": F.when(hour < 12, "AM").otherwise("PM"), "I": two((hour + 11) % 12 + 1), "Z": F.lit("UTC"), "z": F.lit("+0000"),
        "F": F.substring(t.cast("string"), 1, 10), "T": F.substring(t.cast("string"), 12, 8), "D": F.concat_ws("/", two(F.month(t)), two(F.day(t)), F.substring(year, 3, 2)),
        "e": F.lpad(F.day(t).cast("string"), 2, " "), "s": F.floor(_c(seconds_)).cast("string"), "%": F.lit("%"),
    }
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in of:
                raise ValueError(f"%{fmt[i + 1]} is not supported")
            out.append(of[fmt[i + 1]])
            i += 2
        else:
            out.append(F.lit(fmt[i]))
            i += 1
    return F.concat(F.lit(""), *out)


def gmtime(seconds_: Column | str) -> Column:
    t = timestamp(seconds_)
    second = F.second(t) + (_c(seconds_) - F.floor(_c(seconds_)))
    parts = [F.year(t), F.month(t) - 1, F.day(t), F.hour(t), F.minute(t), second, F.dayofweek(t) - 1, F.dayofyear(t) - 1]
    return F.array(*[p.cast("double") for p in parts])


def mktime(parts: Column | str) -> Column:
    """Seconds of a broken-down time; what is missing after the day is 0."""
    p = lambda i, least=0: F.coalesce(F.get(_c(parts), F.lit(i)), F.lit(float(least)))
    day = F.make_date(p(0).cast("int"), (p(1) + 1).cast("int"), p(2, 1).cast("int"))
    return F.unix_date(day).cast("long") * 86400 + F.floor(p(3)) * 3600 + F.floor(p(4)) * 60 + F.floor(p(5))


def to_datetime(text: Column | str) -> Column:
    """A timestamp of an RFC 3339 text, one with a space, without seconds, or a date alone; else null."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd[ ]['T']HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd[ ]['T']HH:mm", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(_c(text), F.lit(f)) for f in formats])


def timedelta(weeks: float = 0, days: float = 0, hours: float = 0, minutes: float = 0, seconds: float = 0) -> Column:
    """An interval, to be added to timestamps or taken from them."""
    total = (weeks * 7 + days) * 86400 + hours * 3600 + minutes * 60 + seconds
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(total).cast("decimal(18,6)"))


def total_seconds(later: Column | str, earlier: Column | str) -> Column:
    """The seconds between two timestamps without a time zone, with fractions."""
    def micros(t: Column) -> Column:
        return seconds(t) * 1_000_000 + F.extract(F.lit("SECOND"), t.cast("timestamp_ntz")) % 1 * 1_000_000

    return (micros(_c(later)) - micros(_c(earlier))).cast("double") / 1e6


def truncated(t: Column | str, unit: str) -> Column:
    """A timestamp without a time zone at the beginning of its year, month, week, day, hour or minute."""
    t = _c(t)
    if unit in ("hour", "minute"):
        day = t.cast("date").cast("timestamp_ntz")
        return day + F.make_dt_interval(F.lit(0), F.hour(t), F.minute(t) if unit == "minute" else F.lit(0))
    return (F.trunc(t.cast("date"), unit) if unit != "day" else t.cast("date")).cast("timestamp_ntz")


def parts(t: Column | str) -> Column:
    """struct(year, month, day, hour, minute, second, weekday from Monday 0, day_of_year from 1)."""
    t = _c(t)
    return F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.day(t).alias("day"), F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.second(t).cast("int").alias("second"), F.weekday(t).alias("weekday"), F.dayofyear(t).alias("day_of_year"))
