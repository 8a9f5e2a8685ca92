"""Exact comparison of quantities, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compare_canonical(claim: Column, official: Column, precision: bool = True) -> Column:
    """Status of two quantity structs (value_base, dimension, currency, denominator, qualifier, quantum).

    A qualifier cannot be compared; other dimensions, currencies or denominators are another
    unit. By precision the difference may be half of the claim's last displayed place; else
    half a per cent of the official value, where an official 0 is matched by 0 only. Written
    without division, so decimals stay exact.
    """
    diff = F.abs(claim["value_base"] - official["value_base"])
    same = claim["dimension"].eqNullSafe(official["dimension"]) & claim["currency"].eqNullSafe(official["currency"]) & claim["denominator"].eqNullSafe(official["denominator"])
    near = (diff * 2 <= claim["quantum"]) if precision else (diff * 200 <= F.abs(official["value_base"]))
    return (
        F.when(claim["qualifier"].isNotNull() | official["qualifier"].isNotNull(), "QUALIFIER_UNSUPPORTED")
        .when(~same, "UNIT_MISMATCH")
        .when(near, "MATCH")
        .otherwise("VALUE_MISMATCH")
    )


def verdict(status: Column, error: Column | None = None) -> Column:
    """MATCH verifies, VALUE_MISMATCH refutes, all else (errors first) leaves the claim unverifiable."""
    failed = F.lit(False) if error is None else error.isNotNull()
    return F.when(failed, "UNVERIFIABLE").when(status == "MATCH", "VERIFIED").when(status == "VALUE_MISMATCH", "REFUTED").otherwise("UNVERIFIABLE")


def apply_direction(value: Column, direction: Column) -> Column:
    """A negative literal stays; a decrease negates a positive one."""
    return F.when((value > 0) & (direction == "DECREASE"), -value).otherwise(value)


def derived(operator: Column, measurement: Column, baseline: Column) -> Column:
    """PERCENT_CHANGE, DIFFERENCE or RATIO of two cells; null on a zero baseline where it divides."""
    change = F.try_divide((measurement - baseline) * 100, baseline)
    return F.when(operator == "PERCENT_CHANGE", change).when(operator == "DIFFERENCE", measurement - baseline).when(operator == "RATIO", F.try_divide(measurement, baseline))
