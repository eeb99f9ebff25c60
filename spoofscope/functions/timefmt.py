"""Timestamp helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoofscope.functions.coerce import NUMERIC_TEXT


def iso_epoch(c: Column) -> Column:
    """ISO-8601 text (``Z`` or offset suffix) or a number -> epoch seconds
    (BIGINT, numbers truncated); anything unparseable or NULL -> 0.  Text
    without an offset is read in the session time zone (UTC)."""
    t = F.trim(c.cast("string"))
    num = F.when(t.rlike(NUMERIC_TEXT), F.floor(F.abs(t.try_cast("double"))) * F.signum(t.try_cast("double")))
    ts = F.unix_timestamp(F.try_to_timestamp(t))
    return F.coalesce(num.cast("bigint"), ts.cast("bigint"), F.lit(0).cast("bigint"))
