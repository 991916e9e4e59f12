"""Registry of named queries: a Spark builder and, where SQL can state it, a DuckDB twin.

Every query reads the given tables (``events`` via the telemetry mapping,
``conversations`` for the text operators) over their whole extent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# Rounding offset 0.5 - 2**-10: output precision for the engine comparison.
# Means of a few 1-3 decimal values often sit exactly on a decimal tie
# (41.4421875); two engines summing in different orders then land one ulp on
# either side and round apart. Moving the cut by 2**-10 of a unit puts it
# where such rationals cannot fall. Both engines evaluate the same formula in
# double arithmetic.
ROUND_OFFSET = 0.4990234375


def round6(c):
    """floor(x * 1e6 + 0.4990234375) / 1e6 -- see ROUND_OFFSET."""
    return F.floor(c * F.lit(1e6) + F.lit(ROUND_OFFSET)) / F.lit(1e6)


def rounded(df: DataFrame) -> DataFrame:
    """Round every floating column so engines agree beyond summation order.

    Built as one ``selectExpr`` (a single JVM call) rather than a Column tree per field.
    """
    exprs = []
    for f in df.schema.fields:
        q = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (DoubleType, FloatType)):
            # floor() gives a long: NaN, infinities and huge values stay as they are
            exprs.append(f"if(abs({q}) < 1e12, floor({q} * 1000000.0D + {ROUND_OFFSET}D) / 1000000.0D, cast({q} AS double)) AS {q}")
        else:
            exprs.append(q)
    return df.selectExpr(*exprs)


def sql_round6(expr: str) -> str:
    return f"floor(({expr}) * 1000000.0 + {ROUND_OFFSET}) / 1000000.0"


def r6(cols: list[str]) -> str:
    return ", ".join(f"{sql_round6(c)} AS {c}" for c in cols)
