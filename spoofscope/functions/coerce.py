"""Type coercion for feeds that arrive as text.

Rule used throughout the library: missing is NULL, never NaN.  Text is parsed
leniently (unparseable -> NULL) and non-finite numbers become NULL at ingest.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plain decimal / scientific notation only.  Spark's cast would also accept
# suffixed ('1d', '1f') and hexadecimal forms, which the feed never means.
NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

def is_finite(c: Column) -> Column:
    """Neither NaN nor infinite: such numbers times 0 are NaN, all others 0.
    ``c`` is evaluated once, which keeps generated code small."""
    return c * F.lit(0.0) == F.lit(0.0)


def finite_or_null(c: Column) -> Column:
    """NaN and +-Infinity -> NULL."""
    return F.when(is_finite(c), c)


def parse_double(c: Column) -> Column:
    """Lenient text -> DOUBLE: trimmed decimal/scientific text, else NULL."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(NUMERIC_TEXT), t.try_cast("double"))


def numeric(c: Column, kind: str) -> Column:
    """A column of type ``kind`` as DOUBLE; text is parsed leniently."""
    return c.cast("double") if kind in _NUMBERS or kind.startswith("decimal") else parse_double(c)


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def coerce_numeric(c: Column) -> Column:
    """Any column -> DOUBLE with NULL for unparseable or non-finite values."""
    return finite_or_null(parse_double(c))


def coerce_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Coerce ``cols`` to DOUBLE, choosing the cheap path for numeric columns."""
    types = dict(df.dtypes)
    out = {}
    for c in cols:
        if c not in types:
            continue
        out[c] = finite_or_null(numeric(F.col(c), types[c]))
    return df.withColumns(out) if out else df


def bool_flag(c: Column, accept_numeric_text: bool = False) -> Column:
    """Boolean-ish value -> INT 0/1.

    'true' (any case) and '1' map to 1; 'false', '0', 'nan', 'none', NULL and
    anything unrecognised map to 0.  Text such as '1.0' is unrecognised (0)
    unless ``accept_numeric_text`` is set, in which case any number equal to 1
    maps to 1.
    """
    u = F.upper(F.trim(c.cast("string")))
    one = u.isin("TRUE", "1")
    if accept_numeric_text:
        one = one | (parse_double(u) == F.lit(1.0))
    return F.when(one, F.lit(1)).otherwise(F.lit(0))


def zero_fill(c: Column) -> Column:
    """NULL, NaN and +-Infinity -> 0.0."""
    return F.coalesce(finite_or_null(c.cast("double")), F.lit(0.0))
