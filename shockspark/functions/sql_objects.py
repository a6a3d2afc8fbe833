"""Session catalogue objects for SQL users: the reusable shock view and a table
function over any daily fact.

``register_shock_sql(spark, fact)`` makes, for the session,

* ``daily_metrics``: the fact itself,
* ``demand_shock(shock_start, days_before, days_after)``: a SQL table function, inlined by
  the analyzer, so that constant arguments become date filters of the fact's scan,
* ``v_demand_shock_metrics``: the view for one crisis (31 days after, as the view of SURVEY A6).

    SELECT * FROM demand_shock(DATE '1998-06-01', 30, 31) ORDER BY booking_change_pct

For the windows of many crises at once use ``shock_metrics(fact, all_crises(...))`` (J4): a
lateral call for each row of a crisis table is right as well, but joins without a key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

VIEW_POST_DAYS = 31

#: Output columns of the function and the view.
SHOCK_TABLE = ("destination_id STRING, crisis_id INT, pre_bookings BIGINT, post_bookings BIGINT, pre_searches DOUBLE, post_searches DOUBLE, "
               "pre_adr DOUBLE, post_adr DOUBLE, pre_cancellation_rate DOUBLE, post_cancellation_rate DOUBLE, booking_change_pct DOUBLE, "
               "search_change_pct DOUBLE, adr_change_pct DOUBLE, cancellation_spike DOUBLE")


def _side(name: str, flag: str) -> str:
    sums = {"bookings": "bookings", "cancellations": "cancellations", "total": "total_reservations", "searches": "search_demand"}
    each = [f"CASE WHEN count_if({flag}) > 0 THEN coalesce(sum({column}) FILTER (WHERE {flag}), 0) END AS {name}_{out}" for out, column in sums.items()]
    return ", ".join([*each, f"avg(adr) FILTER (WHERE {flag}) AS {name}_adr"])


def _change(after: str, before: str) -> str:
    return f"try_divide({after} - {before}, {before})"


def shock_function_sql(table: str = "daily_metrics", name: str = "demand_shock") -> str:
    """``CREATE FUNCTION`` of the shock metrics over ``table``: one scan, one conditional
    aggregate; a missing crisis id counts as 0, rows without a destination are left out, sums
    are NULL for a side without rows."""
    before, after = ("try_divide({0}_cancellations, {0}_total)".format(side) for side in ("pre", "post"))
    return f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(shock_start DATE, days_before INT, days_after INT)
RETURNS TABLE ({SHOCK_TABLE})
RETURN
WITH days AS (
  SELECT destination_id, coalesce(crisis_id, 0) AS crisis_id, date < {name}.shock_start AS is_pre, bookings, cancellations, total_reservations,
         search_demand, adr
  FROM {table}
  WHERE date >= date_sub({name}.shock_start, {name}.days_before) AND date < date_add({name}.shock_start, {name}.days_after)
    AND destination_id IS NOT NULL),
sides AS (
  SELECT destination_id, crisis_id, {_side('pre', 'is_pre')}, {_side('post', 'NOT is_pre')} FROM days GROUP BY destination_id, crisis_id)
SELECT destination_id, CAST(crisis_id AS INT), CAST(pre_bookings AS BIGINT), CAST(post_bookings AS BIGINT), CAST(pre_searches AS DOUBLE),
       CAST(post_searches AS DOUBLE), pre_adr, post_adr, {before}, {after},
       {_change('post_bookings', 'pre_bookings')}, {_change('post_searches', 'pre_searches')}, {_change('post_adr', 'pre_adr')}, {after} - {before}
FROM sides"""


def register_shock_sql(spark: SparkSession, fact: DataFrame, crisis_start: dt.date | str | None = None, pre_days: int = 30,
                       post_days: int = VIEW_POST_DAYS, table: str = "daily_metrics") -> None:
    """Make the fact, the table function and (with ``crisis_start``) the view known to
    ``spark.sql``; all end with the session."""
    fact.createOrReplaceTempView(table)
    spark.sql(shock_function_sql(table))
    if crisis_start is not None:
        day = dt.date.fromisoformat(str(crisis_start)[:10]).isoformat()
        spark.sql(f"SELECT * FROM demand_shock(DATE '{day}', {int(pre_days)}, {int(post_days)})").createOrReplaceTempView("v_demand_shock_metrics")
