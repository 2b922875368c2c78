"""Results that later filters must not take apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows, with ``columns`` passed through a one-element list.

    The optimizer moves a filter on a computed column below its projection and writes the
    column's whole expression into the filter, so that searches run twice or, over several
    steps, many times. It does not do so for columns made by a generator, while filters on
    all other columns still reach the scan.
    """
    keep = [c for c in df.columns if c not in columns]
    made = df.select(*keep, F.inline(F.array(F.struct(*columns))))
    return made.select(*df.columns)
