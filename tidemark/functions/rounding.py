"""Rounding that reproduces the two conventions the reference's numbers use.

Both work on the binary double scaled by 10^places, as the reference's engines
do, and stay plain column arithmetic (whole-stage codegen, no UDF).

* ``round_sql``  - the SQL ``ROUND(double, p)`` of the reference's queries:
  half away from zero, so ``round_sql(1.005, 2) == 1.0`` (the double is just
  below 1.005). Spark's own ``F.round`` goes through the shortest decimal
  string and gives 1.01, so it is not used for reference figures.
* ``round_even`` - pandas / NumPy ``.round(p)``: ``rint(x * 10^p) / 10^p``,
  half to even on the scaled value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Doubles at or above 2**52 have no fractional part.
_WHOLE = 4503599627370496.0


def _scale(places: int) -> float:
    return float(10 ** places)


def _sql_text(name: str, places: int) -> str:
    """``round_sql`` as one SQL expression over a named column (built JVM-side
    in a single call); the same operations as the Column form."""
    x = f"CAST(`{name}` AS DOUBLE)"
    y = f"({x} * {_scale(places)!r}D)"
    a = f"abs({y})"
    whole = f"CAST(floor({a}) AS DOUBLE)"
    rounded = (f"CASE WHEN {a} >= {_WHOLE!r}D THEN {a} ELSE {whole} + "
               f"CASE WHEN {a} - {whole} >= 0.5D THEN 1.0D ELSE 0.0D END END")
    return f"CASE WHEN isnan({y}) THEN {x} ELSE signum({y}) * ({rounded}) / {_scale(places)!r}D END"


def round_sql(col: Column | str, places: int = 0) -> Column:
    """ROUND(x, places) on a double, half away from zero on the scaled binary value.

    ``col`` may be a Column or a column name (then built as one SQL expression).
    """
    if isinstance(col, str):
        return F.expr(_sql_text(col, places))
    scale = _scale(places)
    y = col.cast("double") * F.lit(scale)
    a = F.abs(y)
    whole = F.floor(a).cast("double")
    rounded = F.when(a >= F.lit(_WHOLE), a).otherwise(
        whole + F.when(a - whole >= F.lit(0.5), F.lit(1.0)).otherwise(F.lit(0.0)))
    return (F.when(F.isnan(y), col.cast("double"))
            .otherwise(F.signum(y) * rounded / F.lit(scale)))


def round_even(col: Column | str, places: int = 0) -> Column:
    """pandas ``Series.round(places)``: half to even on the scaled binary value."""
    scale = _scale(places)
    if isinstance(col, str):
        return F.expr(f"rint(CAST(`{col}` AS DOUBLE) * {scale!r}D) / {scale!r}D")
    return F.rint(col.cast("double") * F.lit(scale)) / F.lit(scale)
