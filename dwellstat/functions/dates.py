"""Lenient dates and snapshot months."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellstat import reference_values as rv


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def us_date(text) -> Column:
    """``MM/dd/yyyy`` text as a date, null where it does not parse."""
    return F.try_to_date(_col(text), "M/d/yyyy")


def age_days(date, reference: dt.date = rv.AGE_REFERENCE_DATE) -> Column:
    return F.datediff(F.lit(reference), _col(date))


def snapshot_date(date, latest: dt.date) -> Column:
    """Start of the month, no later than the newest snapshot on hand; null stays null."""
    month = F.trunc(_col(date), "month")
    return F.when(month > F.lit(latest), F.lit(latest)).otherwise(month)


def folder_timestamp(name) -> Column:
    """Run time from a folder called ``yyyy-MM-ddTHHmmss``."""
    return F.try_to_timestamp(_col(name), F.lit("yyyy-MM-dd'T'HHmmss")).cast("timestamp_ntz")
