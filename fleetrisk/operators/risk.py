"""Risk labels, bands, formatting and the deterministic proxy scorer.

The proxy scorer stands in for a trained model wherever a result must be
checked exactly (metrics, risk board): it is a pure function of integer
feature columns, so any engine reproduces it bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import (DEFAULT_RECOMMENDATION, RISK_DISPLAY, RISK_EMOJI, RISK_LEVELS,
                      RISK_RECOMMENDATIONS, UNKNOWN_LEVEL)


def _lookup(mapping: dict, key: Column, default: str | None) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    v = m[key]
    return F.coalesce(v, F.lit(default)) if default is not None else v


def risk_level(cls: Column) -> Column:
    """JN2: class -> no_risk / degradation_risk / shutdown_risk, else 'unknown'."""
    return _lookup(RISK_LEVELS, cls, UNKNOWN_LEVEL)


def risk_display(cls: Column) -> Column:
    return _lookup(RISK_DISPLAY, cls, UNKNOWN_LEVEL)


def risk_emoji(cls: Column) -> Column:
    return _lookup(RISK_EMOJI, cls, "")


def recommendation(level: Column) -> Column:
    """JN2: level -> recommendation text, default 'Monitor closely.'."""
    return _lookup(RISK_RECOMMENDATIONS, level, DEFAULT_RECOMMENDATION)


def risk_band(prob: Column) -> Column:
    """FN16: > 0.7 high, > 0.4 medium, else low."""
    return F.when(prob > 0.7, "high").when(prob > 0.4, "medium").otherwise("low")


def percent(prob: Column, decimals: int = 2) -> Column:
    """FN15: 0.1234 -> '12.34%'."""
    return F.format_string(f"%.{decimals}f%%", prob * 100)


def pretty_feature(name: Column) -> Column:
    """FN17: 'inv_power_24h_mean' -> 'Inv Power 24h Mean'."""
    return F.initcap(F.regexp_replace(name, "_", " "))


def direction(impact: Column) -> Column:
    """FN14: sign of an attribution as text."""
    return F.when(impact > 0, "increases risk").otherwise("decreases risk")


def argmax_class(probs: Column) -> Column:
    """FN13: index of the largest class probability (first on ties)."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def failure_probability(probs: Column) -> Column:
    """FN13: 1 - P(no risk), rounded to 4 places."""
    return F.round(F.lit(1.0) - probs[0], 4)


# ----------------------------------------------------------- proxy model ---
def proxy_score(df: DataFrame) -> DataFrame:
    """Deterministic stand-in scores on a featured table.

    ``proxy_prob`` in [0, 1), ``proxy_pred`` = prob >= 0.5, ``proxy_class`` in {0,1,2}.
    """
    raw = (F.col("inverter_idx").cast("long") * 37 + F.col("hour") * 11 + F.col("day_of_week") * 5
           + F.col("alarm_count_7d").cast("long") * 13)
    prob = (raw % 1000) / 1000.0
    cls = ((F.col("inverter_idx") + F.col("hour") + F.col("alarm_count_24h").cast("int")) % 3).cast("int")
    return df.select("*", prob.alias("proxy_prob"), (prob >= 0.5).cast("int").alias("proxy_pred"),
                     cls.alias("proxy_class"))


PROXY_SQL = """
proxy AS (
  SELECT *, CAST(((CAST(inverter_idx AS BIGINT) * 37 + hour * 11 + day_of_week * 5
      + CAST(alarm_count_7d AS BIGINT) * 13) % 1000) AS DOUBLE) / 1000.0 AS proxy_prob,
    CAST((inverter_idx + hour + CAST(alarm_count_24h AS INTEGER)) % 3 AS INTEGER) AS proxy_class
  FROM featured
),
scored AS (
  SELECT *, CASE WHEN proxy_prob >= 0.5 THEN 1 ELSE 0 END AS proxy_pred FROM proxy
)"""
