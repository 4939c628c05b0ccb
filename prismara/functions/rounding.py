"""Rounding. ``scaled_round`` is the default, as SQL engines round doubles; ``exact_round`` rounds binary values half to even."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(c: Column, digits: int) -> Column:
    """Rounds the double itself and not its shortest decimal form; no built-in does, so this is a vectorised UDF."""

    @F.pandas_udf("double")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else round(v, digits)).astype("float64")

    return rounded(c)


def scaled_round(c: Column | str, digits: int) -> Column:
    """Rounds the double times a power of ten, halves away from zero, and divides again.

    Spark's ``round`` takes the shortest decimal form: 1.005 to two digits is 1.01 there, and 1.0 here, where 1.005 * 100 is below a half.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(10.0**digits)) / F.lit(10.0**digits)
