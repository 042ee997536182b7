"""Column expressions for cleaning keys and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks removed around keys and names: ASCII white space, no-break space, BOM, zero width space.
BLANKS = " \t\n\r\x0b\x0c ﻿​"


def stripped(value: Column | str) -> Column:
    """Without blanks around it."""
    return F.btrim(F.col(value) if isinstance(value, str) else value, F.lit(BLANKS))


def some(value: Column | str) -> Column:
    """Without blanks around it; null where nothing is left."""
    text = stripped(value)
    return F.when(text != "", text)


def key(value: Column | str) -> Column:
    """Comparable key: no blanks around it, lower case, null where empty."""
    return F.lower(some(value))
