"""Date and time column expressions (session time zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: formats the reference reads or prints ---
ISO_UTC_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"  # JavaScript Date.toISOString()
MONTH_FORMAT = "yyyy-MM"                          # date_histogram key_as_string
DISPLAY_DATE_FORMAT = "yyyy-MM-dd"                # fixed instead of a machine locale
ARCHIVE_DATE_KEY_FORMAT = "MMMddyyyy"             # e.g. Jan052020 (strptime %b%d%Y)
UNKNOWN_DATE = "UnknownDate"
ARCHIVE_TIME_FORMAT = "MMM dd HH:mm:ss Z yyyy"    # an archive date without its weekday
# --- end of fixed values ---


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(s) -> Column:
    """Lenient parse of 'YYYY-MM-DD HH:MM:SS+ZZ:ZZ' and ISO forms; null when unparsable.

    A value that is already a timestamp passes through.
    """
    return F.try_to_timestamp(_col(s).cast("string"))


def iso_utc(ts) -> Column:
    """Format as ``toISOString()`` does: UTC, millisecond precision, 'Z'.

    Correct in any session time zone: the instant is shifted to UTC wall-clock
    time before formatting.
    """
    return F.date_format(F.to_utc_timestamp(_col(ts), F.current_timezone()), ISO_UTC_FORMAT)


def month_key(ts) -> Column:
    return F.date_format(_col(ts), MONTH_FORMAT)


def display_date(ts) -> Column:
    return F.date_format(_col(ts), DISPLAY_DATE_FORMAT)


def archive_date_key(created_at) -> Column:
    """Month, day and year tokens (whitespace parts 1, 2 and 5) of an archive date.

    'Sun Jan 05 10:00:00 +0000 2020' -> 'Jan052020'; fewer than six parts
    gives 'UnknownDate'. The caller filters null/empty strings first.
    """
    parts = F.filter(F.split(_col(created_at), r"(?U)\s+"), lambda x: x != "")
    return F.when(F.size(parts) < 6, F.lit(UNKNOWN_DATE)).otherwise(
        F.concat(F.get(parts, 1), F.get(parts, 2), F.get(parts, 5))
    )


def parse_archive_date_key(key) -> Column:
    """'Jan052020' -> DATE; null for 'UnknownDate' or anything unparsable."""
    return F.try_to_date(_col(key), ARCHIVE_DATE_KEY_FORMAT)


def parse_archive_timestamp(created_at) -> Column:
    """'Sun Jan 05 10:00:00 +0000 2020' -> TIMESTAMP; null for anything else (the weekday is not looked at)."""
    c = F.trim(_col(created_at))
    return F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3}\s+", ""), F.lit(ARCHIVE_TIME_FORMAT))
