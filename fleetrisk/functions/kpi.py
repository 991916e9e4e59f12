"""Electrical KPI and event expressions (FN4-FN12) of the training features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NOMINAL_FREQ
from .numeric import row_mean


def alarm_active(alarm_code: Column) -> Column:
    """FN4: 1 when the (missing = 0) alarm code is positive."""
    return (F.coalesce(alarm_code, F.lit(0.0)) > 0).cast("int")


def voltage_imbalance(v_r: Column, v_y: Column, v_b: Column) -> Column:
    """FN5: max |v - mean| / mean over the present phases; 0 when mean <= 0 or missing."""
    m = row_mean([v_r, v_y, v_b])
    dev = F.greatest(F.abs(v_r - m), F.abs(v_y - m), F.abs(v_b - m))
    return F.when(m > 0, F.try_divide(dev, m)).otherwise(F.lit(0.0))


def pf_deviation(pf: Column) -> Column:
    """FN6: |1 - |pf||, a missing power factor counts as 1."""
    return F.abs(F.lit(1.0) - F.abs(F.coalesce(pf, F.lit(1.0))))


def freq_deviation(freq: Column) -> Column:
    """FN7: |f - 50|, a missing frequency counts as 50."""
    return F.abs(F.coalesce(freq, F.lit(NOMINAL_FREQ)) - F.lit(NOMINAL_FREQ))


def power_ratio(power: Column, mean24: Column) -> Column:
    """FN8: power / 24h mean when the mean exceeds 10, else 1.0 (missing power = 0)."""
    return F.when(mean24 > 10, F.try_divide(F.coalesce(power, F.lit(0.0)), mean24)).otherwise(F.lit(1.0))


def zero_fraction(num_zero: Column, total: Column) -> Column:
    """FN9: zero strings / total strings; missing total -> 1, total 0 -> 1."""
    t = F.coalesce(total, F.lit(1.0))
    t = F.when(t == 0, F.lit(1.0)).otherwise(t)
    return F.try_divide(F.coalesce(num_zero, F.lit(0.0)), t)


def shutdown_event(alarm_code: Column, power: Column, daytime: Column) -> Column:
    """FN10: alarm, or zero power in daytime -- missing power counts as zero."""
    return ((F.coalesce(alarm_code, F.lit(0.0)) > 0)
            | ((F.coalesce(power, F.lit(0.0)) == 0) & (daytime == 1))).cast("int")


def degradation_event(power: Column, mean24: Column) -> Column:
    """FN11: producing, but below half of a 24h mean that exceeds 100."""
    p = F.coalesce(power, F.lit(0.0))
    m = F.coalesce(mean24, F.lit(0.0))
    return ((p > 0) & (m > 100) & (p < m * 0.5)).cast("int")


def target_multiclass(shutdown_ahead: Column, degradation_ahead: Column) -> Column:
    """FN12: 2 if a shutdown lies ahead, else 1 if a degradation does, else 0."""
    return (F.when(shutdown_ahead > 0, 2).when(degradation_ahead > 0, 1).otherwise(0)).cast("int")


def target_binary(shutdown_ahead: Column, degradation_ahead: Column) -> Column:
    return ((shutdown_ahead > 0) | (degradation_ahead > 0)).cast("int")
