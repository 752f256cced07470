"""Notice dates: normalising, parsing, archive month.

Each step mentions its input once or twice only. Catalyst inlines expressions when it merges
projections and pushes filters, so a step that repeats its input would multiply with the next.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.text import WS

# Three parts of which the first has two bytes.
_SHORT_YEAR = r"(?s)^([\x00-\x2c\x2e-\x7f]{2}|[\x{80}-\x{7ff}])-([^-]*)-([^-]*)\z"
_NUMBERS = rf"^{WS}*[0-9]{{1,4}}-{WS}*[0-9]{{1,2}}-{WS}*[0-9]{{1,2}}\z"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def _dashed(raw: Column, strip_trailing_sep: bool) -> Column:
    dashed = F.translate(raw, "./", "--")
    if strip_trailing_sep:
        dashed = F.regexp_replace(dashed, rf"[-]+{WS}*$", "")
    return F.regexp_replace(dashed, _SHORT_YEAR, "20$1-$2-$3")


def _calendar_date(dashed: Column) -> Column:
    """DATE of ``y-m-d`` text, NULL if it is none."""
    compact = F.regexp_replace(F.regexp_extract(dashed, _NUMBERS, 0), WS, "")
    # A cast wants four digits or more in a year.
    return F.regexp_replace(compact, "^([0-9]{1,3})-", "000$1-").try_cast("date")


def parse_date(raw: Column, strip_trailing_sep: bool = False) -> Column:
    """DATE of a raw notice date, NULL where it cannot be read."""
    return _calendar_date(_dashed(raw, strip_trailing_sep))


def normalize_date(raw: Column, strip_trailing_sep: bool = False) -> Column:
    """``yyyy-MM-dd`` where the date can be read, otherwise the dashed text as it is.

    Two-digit years always become 20YY.
    """
    dashed = _dashed(raw, strip_trailing_sep)
    return F.coalesce(_calendar_date(dashed).cast("string"), dashed)


def iso_date(date: Column) -> Column:
    """DATE of a normalised date, NULL where it was not readable."""
    return F.regexp_extract(date, _ISO, 0).try_cast("date")


def archive_day(date: Column, as_of: str) -> Column:
    """Day whose month a normalised date belongs to; unreadable dates go with ``as_of``."""
    return F.coalesce(iso_date(date), F.lit(as_of).cast("date"))


def archive_year(date: Column, as_of: str) -> Column:
    return F.year(archive_day(date, as_of))


def archive_month(date: Column, as_of: str) -> Column:
    return F.month(archive_day(date, as_of))
