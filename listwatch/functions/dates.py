"""Date text functions (X3, X4, X5, X10, X21, X22). ``as_of`` is always a
parameter; nothing reads the wall clock (X27)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: relative-day words and the local zone of the site
TODAY_WORD = "היום"
YESTERDAY_WORD = "אתמול"
LOCAL_ZONE = "Asia/Jerusalem"
RTL_MARK = "‏"

# dd/mm/yy or dd/mm/yyyy at the start, ended by a non-digit or the end (Q9)
DMY_PATTERN = r"^([0-9]{2})/([0-9]{2})/([0-9]{2}([0-9]{2})?)([^0-9]|$)"
DMY_TOKEN = r"(^|[^0-9])([0-9]{2}/[0-9]{2}/[0-9]{2})([^0-9]|$)"


def _fmt(c: Column, pattern: str) -> Column:
    return F.date_format(c, pattern)


def as_timestamp(s: Column) -> Column:
    """ISO-8601 text (with or without 'Z' / 'T') as a UTC timestamp."""
    t = F.regexp_replace(F.regexp_replace(F.trim(s), "Z$", ""), "T", " ")
    return F.try_to_timestamp(t)


def format_date_only(ts_or_text: Column, is_text: bool = False) -> Column:
    """dd/MM/yyyy of an ISO value, else of a 'yyyy-MM-dd' prefix, else the
    input unchanged; NULL/empty -> ''."""
    if not is_text:
        return F.coalesce(_fmt(ts_or_text, "dd/MM/yyyy"), F.lit(""))
    s = F.trim(ts_or_text)
    iso = _fmt(as_timestamp(s), "dd/MM/yyyy")
    prefix = _fmt(F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")), "dd/MM/yyyy")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(iso, prefix, s))


def format_datetime(ts_or_text: Column, is_text: bool = False) -> Column:
    """dd/MM/yyyy HH:mm (session zone UTC, no shift), else unchanged."""
    if not is_text:
        return F.coalesce(_fmt(ts_or_text, "dd/MM/yyyy HH:mm"), F.lit(""))
    s = F.trim(ts_or_text)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("")).otherwise(
        F.coalesce(_fmt(as_timestamp(s), "dd/MM/yyyy HH:mm"), s))


def parse_dmy(s: Column) -> Column:
    """Leading dd/mm/yy (+2000) or dd/mm/yyyy as a date; invalid -> NULL."""
    d = F.regexp_extract(s, DMY_PATTERN, 1)
    m = F.regexp_extract(s, DMY_PATTERN, 2)
    y = F.regexp_extract(s, DMY_PATTERN, 3)
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    return F.when(d != "", F.try_to_date(F.concat_ws("-", year, m, d), "yyyy-MM-dd"))


def local_date(as_of: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(as_of, LOCAL_ZONE))


def parse_date_or_none(s: Column, as_of: Column) -> Column:
    """dd/mm/yy(yy) prefix, else ISO date, else the today/yesterday
    words (relative to ``as_of``), else NULL."""
    t = F.trim(s)
    today = F.to_date(as_of)
    return F.coalesce(
        parse_dmy(t),
        F.to_date(as_timestamp(t)),
        F.when(t == TODAY_WORD, today),
        F.when(t == YESTERDAY_WORD, F.date_sub(today, 1)))


def ad_created_text(raw: Column, as_of: Column) -> Column:
    """The dd/mm/yy token of the text; else the today/yesterday word as
    a dd/MM/yy date of ``as_of`` in the site's zone; else the raw text.
    RTL marks are removed before the word check."""
    token = F.regexp_extract(raw, DMY_TOKEN, 2)
    txt = F.trim(F.regexp_replace(raw, RTL_MARK, ""))
    day = local_date(as_of)
    return (F.when(token != "", token)
            .when(txt.contains(TODAY_WORD), F.date_format(day, "dd/MM/yy"))
            .when(txt.contains(YESTERDAY_WORD), F.date_format(F.date_sub(day, 1), "dd/MM/yy"))
            .otherwise(raw))
