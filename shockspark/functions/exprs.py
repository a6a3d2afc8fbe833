"""Reusable column expressions.

All helpers return ``Column`` objects evaluated inside whole-stage codegen; nothing here
is a Python UDF.  Null handling follows SURVEY 1.3: SQL NULL, never NaN; every division
goes through ``safe_div`` because ANSI mode raises on ``x / 0``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def safe_div(num, den) -> Column:
    """``num / den`` as double; NULL when ``den`` is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def div_if_positive(num, den, otherwise=None) -> Column:
    """``num / den`` when ``den > 0`` else ``otherwise`` (a NULL denominator also gives
    ``otherwise``, like ``np.where(den > 0, ...)``)."""
    res = F.when(col(den) > 0, safe_div(num, den))
    return res if otherwise is None else res.otherwise(lit(otherwise))


def clip(c, lo=None, hi=None) -> Column:
    """Null-preserving clip (``least``/``greatest`` would skip NULLs)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.when(x < lo, lit(lo).cast("double")).otherwise(out)
    if hi is not None:
        out = F.when(x > hi, lit(hi).cast("double")).otherwise(out)
    return out.cast("double")


def stability_normalize(ratio) -> Column:
    """``min(1, r / (1 + 0.5 |r - 1|))``: 1 at r = 1, penalises collapse and overshoot."""
    r = col(ratio)
    v = r / (F.lit(1.0) + F.abs(r - F.lit(1.0)) * F.lit(0.5))
    return F.when(v > 1.0, F.lit(1.0)).otherwise(v)


def pct_change(new, old) -> Column:
    """``(new - old) / old`` as a fraction; NULL when old is 0 or NULL."""
    return safe_div(col(new) - col(old), col(old))


def r6(c) -> Column:
    """Round a double to 6 places for presentation.

    Two steps: rounding to 9 places first removes last-bit noise of floating-point
    sums (whose value depends on the summation order), so a mean that lies exactly on
    a 7th-decimal tie rounds the same way whatever order the rows were added in."""
    return F.round(F.round(col(c).cast("double"), 9), 6)


def round_doubles(df, digits: int = 6):
    """Round every double column of ``df`` to ``digits`` places (via 9), keeping names."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.round(F.round(F.col(f.name), digits + 3), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def null_words_to_null(c, words=("nat", "nan", "none", "")) -> Column:
    """Strings that spell a missing value become NULL."""
    x = col(c)
    return F.when(F.lower(F.trim(x)).isin(*words), F.lit(None).cast("string")).otherwise(x)


def _round_exact(c, digits: int, tie) -> Column:
    """``c`` rounded to ``digits`` places by its exact binary value; ``tie(floor)`` says whether
    a value exactly in the middle goes up in magnitude.  The rounding error of x * 10^d
    is recovered by splitting x into two halves whose products are exact."""
    x = col(c).cast("double")
    size, m = F.abs(x), float(10 ** digits)
    scaled = size * m
    wide = size * 134217729.0
    high = wide - (wide - size)
    error = (high * m - scaled) + (size - high) * m
    floor = F.floor(scaled).cast("double")
    beyond = (scaled - floor - 0.5) + error
    up = (beyond > 0) | ((beyond == 0) & tie(floor))
    rounded = (floor + up.cast("double")) / m
    return F.when(size >= 2.0 ** 50 / m, x).when(x < 0, -rounded).otherwise(rounded)


def round_python(c, digits: int = 0) -> Column:
    """Python's ``round``: the exact binary value, a tie to the even neighbour (1.115 -> 1.11,
    0.125 -> 0.12)."""
    return _round_exact(c, digits, lambda floor: floor % 2 == 1)


def to_fixed(c, digits: int = 0) -> Column:
    """JavaScript's ``toFixed``: the exact binary value, a tie away from zero (1.115 -> 1.11,
    0.125 -> 0.13)."""
    return _round_exact(c, digits, lambda floor: F.lit(True))


def round_pandas(c, digits: int = 0) -> Column:
    """``Series.round``: the scaled value rounded half to even, scaled back."""
    m = float(10 ** digits)
    return F.rint(col(c).cast("double") * m) / m
