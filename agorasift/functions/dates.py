"""Column expressions for post dates, local days and day folders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The two date formats of posts (after the day name) and the
# date that names a day folder or file.
POST_FORMAT = "MMM dd HH:mm:ss Z yyyy"
OLD_FORMAT = "yyyy-MM-dd HH:mm:ss"
PATH_DATE_PATTERN = r"(\d{4}-\d{2}-\d{2})"
PATH_SLOT_PATTERN = r"(\d{12})"


def parse_post_date(text: Column) -> Column:
    """Instant of a post date in either format; null for anything else."""
    return F.coalesce(
        F.try_to_timestamp(F.substring(text, 5, 40), F.lit(POST_FORMAT)),
        F.try_to_timestamp(text, F.lit(OLD_FORMAT)),
    )


def local_time(instant: Column, zone: str) -> Column:
    return F.from_utc_timestamp(instant.cast("timestamp"), zone)


def local_day(instant: Column, zone: str) -> Column:
    """Calendar day in the zone, right on days with a clock change too."""
    return F.to_date(local_time(instant, zone))


def date_from_path(path: Column) -> Column:
    """Last ``yyyy-mm-dd`` in a path."""
    return F.element_at(F.regexp_extract_all(path, F.lit(PATH_DATE_PATTERN), F.lit(1)), -1).cast("date")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days from one instant to another, rounded down."""
    seconds = F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))
    return F.floor(seconds / F.lit(86400))
