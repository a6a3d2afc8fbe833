"""Window totals from running totals against conditional sums."""

import datetime as dt
import random

from conftest import SF0001
from pyspark.sql import functions as F

from shockspark.operators.cumulative import running_totals, window_totals
from shockspark.sources import fixtures as fx

DAY0 = dt.date(1995, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def random_windows(n, span=2600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = sorted((rng.randrange(-50, span), rng.randrange(-50, span)))
        out.append((i, None if i % 97 == 0 else day(a), None if i % 89 == 0 else day(b)))
    return out + [(n, day(30), day(10))]


def test_ten_thousand_windows_are_conditional_sums(spark):
    flights = fx.fact_flights(spark, SF0001)
    windows = random_windows(10_000)
    totals = running_totals(flights, {"flights": F.col("flights_count"), "seats": F.col("seat_capacity")})
    got = window_totals(totals, spark.createDataFrame(windows, "window int, date_from date, date_to date"), ["flights", "seats"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Sequence" not in plan and "sequence(" not in plan  # nothing is expanded to days
    rows = [(r.date, r.flights_count, r.seat_capacity) for r in flights.collect()]
    by_day = {}
    for d, f, s in rows:
        x = by_day.setdefault(d, [0, 0.0])
        x[0], x[1] = x[0] + f, x[1] + s
    days = sorted(by_day)
    found = {r.window: r for r in got.collect()}
    assert len(found) == len(windows)
    for w, a, b in windows[::7] + windows[-1:]:
        inside = [by_day[d] for d in days if (a is None or d >= a) and (b is None or d <= b)]
        assert found[w].flights == sum(x[0] for x in inside)
        assert abs(found[w].seats - sum(x[1] for x in inside)) < 1e-6


def test_the_fact_is_read_once(spark):
    flights = fx.fact_flights(spark, SF0001)
    totals = running_totals(flights, {"flights": F.col("flights_count")}, ("destination_id",))
    windows = spark.createDataFrame([("NATION_1", day(0), day(400)), ("NATION_2", day(5), day(900))], "destination_id string, date_from date, date_to date")
    got = window_totals(totals, windows, ["flights"], ("destination_id",))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") <= 1 + plan.count("ReusedExchange")


def test_keys_gaps_nulls_and_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", day(1), 1, 0.1), ("a", day(1), 2, 0.2), ("a", day(9), 4, nan), (None, day(2), 8, 1e-9), ("b", None, 16, 5.0), ("b", day(3), None, inf)]
    df = spark.createDataFrame(rows, "k string, date date, n int, x double")
    totals = running_totals(df, {"n": F.col("n"), "x": F.col("x")}, ("k",))
    windows = [("a", day(0), day(0)), ("a", day(1), day(8)), ("a", day(2), day(9)), ("a", None, None), (None, day(2), day(2)), ("b", None, day(5)), ("c", None, None)]
    got = [tuple(r) for r in window_totals(totals, spark.createDataFrame(windows, "k string, date_from date, date_to date"), ["n", "x"], ("k",)).collect()]
    expected = [(0, 0.0), (3, 0.3), (4, 0.0), (7, 0.3), (8, 1e-9), (0, 0.0), (0, 0.0)]
    assert sorted(got, key=str) == sorted([(*w, *e) for w, e in zip(windows, expected)], key=str)
    every = window_totals(totals, spark.createDataFrame([(1, day(1), day(2))], "w int, date_from date, date_to date"), ["n"], ("k",))
    assert sorted(((r.k, r.w, r.n) for r in every.collect()), key=str) == sorted([("a", 1, 3), (None, 1, 8), ("b", 1, 0)], key=str)
    assert window_totals(running_totals(df.limit(0), {"n": F.col("n")}), spark.createDataFrame([(1, day(1), day(2))], "w int, date_from date, date_to date"), ["n"]).first().n == 0
