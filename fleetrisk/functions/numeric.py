"""Numeric column expressions (JVM-side, codegen friendly, ANSI safe)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that a lenient numeric parser accepts: decimal / scientific notation,
# inf / infinity / nan in any case. Suffixed literals such as "1d" or "2f"
# (which a bare double cast would accept) are rejected.
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


def nan_to_null(c: Column) -> Column:
    """NaN is not missing in Spark aggregates; turn it into NULL once, at load."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(c: Column | str) -> Column:
    """Coerce text or numbers to double; anything unparsable becomes NULL.

    ``inf`` text is kept as +/-Infinity, ``nan`` becomes NULL (PRJ2).
    """
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    parsed = F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))
    return nan_to_null(parsed)


def _present(cols: Sequence[Column]) -> Column:
    return sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean over the non-NULL cells of a row; NULL when all are NULL."""
    n = _present(cols)
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n > 0, total / n)


def row_std(cols: Sequence[Column]) -> Column:
    """Sample standard deviation over the non-NULL cells; NULL below 2 cells."""
    n = _present(cols)
    m = row_mean(cols)
    ss = sum((F.coalesce((c - m) * (c - m), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n >= 2, F.sqrt(ss / (n - 1)))


def row_zero_count(cols: Sequence[Column]) -> Column:
    """Number of cells equal to zero (NULL is not zero)."""
    return sum((F.when(c == 0, 1).otherwise(0) for c in cols), F.lit(0)).cast("double")


def round6(c: Column) -> Column:
    return F.round(c, 6)
