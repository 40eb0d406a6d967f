"""What the operators on vectors share: clean rows, integer components and packed matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components beyond this are an error: their sums of squares would leave 64 bits.
MOST = 1 << 28


def finite(vec: Column) -> Column:
    """Whether a vector and all its components are there and finite; false for null."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok, F.lit(False))


def whole(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, in double precision."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale))


def clean_rows(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, ints): the rows with a finite vector, whose components become integers."""
    return df.filter(finite(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), whole(F.col(vec_col)).alias("ints"))


def width_of(rows: DataFrame) -> tuple[int, int]:
    """(width, largest absolute component) of ``ints``; (0, 0) without rows.

    Vectors of several widths and components beyond ``MOST`` are errors: no result is defined for them.
    """
    top = F.coalesce(F.array_max(F.transform("ints", F.abs)), F.lit(0))
    low, high, most = rows.agg(F.min(F.size("ints")), F.max(F.size("ints")), F.max(top)).first()
    if low is None:
        return 0, 0
    if low != high:
        raise ValueError(f"vectors of {low} and {high} components in one table")
    if most > MOST:
        raise ValueError(f"an integer component of {most} is beyond {MOST}")
    return low, most


def matrix(column, width: int) -> np.ndarray:
    """(rows, width) of an Arrow list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
