"""A fence for computed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, *names: str) -> DataFrame:
    """The same rows and columns, the named ones computed before anything that reads them.

    The optimiser moves a consumer's predicates below projections by writing the columns' definitions into them. Definitions
    whose higher-order functions look into other arrays would then compute those arrays again for every element. Predicates
    on what a generator puts out stay above it.
    """
    rest = [F.col(c) for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names)))).select(*df.columns)
