"""Exact quantiles (linear interpolation, as pandas / ``quantile_cont``) without
gathering the values in one task.

``percentile(x, q)`` keeps a value->count map of the whole column in the final
aggregation task, which does not hold at scale for a high-cardinality double column.
Here the ranked positions of the distinct values come from the distributed prefix sum
of ``functions.ranking``; only the (at most two) values that bracket the target rank
are aggregated.  ``approx=True`` switches to ``percentile_approx`` (one pass, bounded
memory, relative error 1/accuracy).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspark.functions.ranking import value_positions
from shockspark.session import cut_lineage


def quantiles(df: DataFrame, col: str, qs: dict[str, float], approx: bool = False,
              accuracy: int = 10_000) -> DataFrame:
    """One row with a column per entry of ``qs`` (name -> q in [0, 1]).
    NULL values are ignored; an empty input gives NULLs."""
    x = F.col(col).cast("double")
    if approx:
        return df.agg(*[F.percentile_approx(x, q, accuracy).alias(name) for name, q in qs.items()])
    vals = df.select(x.alias("_v")).filter(F.col("_v").isNotNull())
    pos = value_positions(vals, "_v")
    n = vals.agg(F.count(F.lit(1))).scalar()
    # Target positions are projected first (a scalar subquery may not appear inside an
    # aggregate function), then the bracketing values are picked in one aggregate.
    proj = [F.col("_v"), F.col("_before"), F.col("_k")]
    for i, q in enumerate(qs.values()):
        r = (n - 1) * F.lit(float(q))
        proj += [F.floor(r).alias(f"_lo{i}"), F.ceil(r).alias(f"_hi{i}"), (r - F.floor(r)).alias(f"_fr{i}")]
    pos = pos.select(*proj)

    def covers(k):
        return (F.col("_before") <= F.col(k)) & (F.col(k) < F.col("_before") + F.col("_k"))

    exprs = []
    for i, name in enumerate(qs):
        v_lo = F.max(F.when(covers(f"_lo{i}"), F.col("_v")))
        v_hi = F.max(F.when(covers(f"_hi{i}"), F.col("_v")))
        exprs.append((v_lo + (v_hi - v_lo) * F.max(f"_fr{i}")).alias(name))
    return pos.agg(*exprs)


def median_and_filled_quantile(df: DataFrame, col: str, q: float) -> tuple[float | None, float | None]:
    """Exact (median m of the non-null values, q-quantile of the values after every NULL
    is replaced by m), from one positions pass.

    With n values, k NULLs, L values below m and E equal to m, the filled order is:
    the L values below m, then E + k copies of m, then the rest; a filled position j
    maps back to position j (j < L), m (j < L + E + k) or j - k of the original
    order.  The positions are written once; one aggregate over them picks the median's
    bracket, a second one L, E and every value that may bracket the quantile."""
    x = df.select(F.col(col).cast("double").alias("_v"))
    n, k = x.agg(F.count("_v"), F.count_if(F.col("_v").isNull())).first()
    if not n:
        return None, None
    pos = cut_lineage(value_positions(x.filter(F.col("_v").isNotNull()), "_v"), "positions")

    def at(i: int):
        hit = (F.col("_before") <= i) & (F.lit(i) < F.col("_before") + F.col("_k"))
        return F.max(F.when(hit, F.col("_v")))

    def bracket(r: float) -> tuple[int, int, float]:
        low = int(np.floor(r))
        return low, int(np.ceil(r)), r - low

    low, high, part = bracket((n - 1) * 0.5)
    a, b = pos.agg(at(low), at(high)).first()
    m = a + (b - a) * part
    low, high, part = bracket((n + k - 1) * q)
    below, equal, *values = pos.agg(
        F.coalesce(F.sum(F.when(F.col("_v") < m, F.col("_k"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("_v") == m, F.col("_k"))), F.lit(0)),
        at(low), at(high), at(low - k), at(high - k)).first()

    def filled(j: int, own: float, shifted: float) -> float:
        return own if j < below else m if j < below + equal + k else shifted

    a, b = filled(low, values[0], values[2]), filled(high, values[1], values[3])
    return m, a + (b - a) * part
