"""Daily sketches: merged over a range they come near the exact forms, and only the store is read."""

import datetime as dt

import numpy as np
from conftest import SF0001, rows
from pyspark.sql import functions as F

from shockspark.operators import kpis as KP
from shockspark.operators import sketches as S
from shockspark.sources import fixtures as fx
from shockspark.sources.versioned import read_table

D0 = dt.date(2022, 1, 30)


def test_ranges_against_the_exact_forms(spark, tmp_path):
    fact, path = fx.daily_metrics(spark, SF0001), str(tmp_path / "sketches")
    S.store_sketches(S.daily_sketches(fact, sums=("bookings", "room_nights", "absent"), distinct=("destination_id",), spread=("adr",)), path)
    store = read_table(spark, path)
    for start, end in (("1997-01-01", "1997-12-31"), ("1998-06-01", "1998-06-01"), (None, "1996-05-05"), (None, None)):
        part = fact.filter(F.lit(True) if not start else F.col("date") >= start).filter(F.lit(True) if not end else F.col("date") <= end)
        assert rows(S.summary_of_range(store, start, end)) == rows(KP.summary(part)), (start, end)
        adr = np.sort([r.adr for r in part.select("adr").dropna().collect()])
        got = S.clean_bounds(store, start, end).first()
        for value, q in ((got.median, 0.5), (got.p99, 0.99)):
            low, high = np.searchsorted(adr, value, "left") / len(adr), np.searchsorted(adr, value, "right") / len(adr)
            assert low - 0.012 - 1 / len(adr) <= q <= high + 0.012 + 1 / len(adr), (start, end, q)


def test_many_distinct_values_and_quantiles_of_many_days(spark):
    df = spark.range(200_000).select(F.expr("date_add(DATE'2022-01-01', CAST(id % 50 AS INT))").alias("date"), (F.col("id") % 60_000).alias("who"),
                                     F.pow(F.col("id") / 1000.0, 2.0).alias("x"))
    merged = S.merged_sketches(S.daily_sketches(df, distinct=("who",), spread=("x",)))
    got = merged.select("records", S.distinct_count("distinct_who").alias("n"), *[S.quantile("spread_x", q).alias(f"q{i}") for i, q in enumerate((0.01, 0.5, 0.9))]).first()
    assert got.records == 200_000 and abs(got.n - 60_000) < 0.04 * 60_000
    assert all(abs(np.sqrt(v) / 200 - q) < 0.012 for v, q in zip(got[2:], (0.01, 0.5, 0.9)))


def test_only_the_days_of_the_range_are_read(spark, tmp_path):
    path = str(tmp_path / "s")
    S.store_sketches(S.daily_sketches(fx.daily_metrics(spark, SF0001), sums=("bookings", "room_nights"), distinct=("destination_id",)), path)
    query = S.summary_of_range(read_table(spark, path), "1997-02-03", "1997-05-05")
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and str(tmp_path) in plan and "month" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(date,1997-02-03)" in plan and all(str(tmp_path) in f for f in query.inputFiles())
    assert {f.split("month=")[1][:7] for f in read_table(spark, path).filter("month >= '1997-02' AND month <= '1997-05'").inputFiles()} >= {"1997-02", "1997-05"}


def test_refresh_of_a_month_nulls_and_empty_ranges(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "date date, destination_id string, bookings long, room_nights double, adr double"
    day = [D0 + dt.timedelta(days=k) for k in range(4)]  # two months
    first = spark.createDataFrame([(day[0], "A", 1, 1.0, 5.0), (day[0], None, None, None, None), (day[2], "B", 2, 2.0, float("nan")), (None, "C", 9, 9.0, 9.0)], schema)

    def sketched(df):
        return S.daily_sketches(df, sums=("bookings", "room_nights"), distinct=("destination_id",), spread=("adr",))

    S.store_sketches(sketched(first), path)
    whole = S.summary_of_range(read_table(spark, path)).first()
    assert tuple(whole) == (day[0], day[2], 3, 3, 2, 3)
    assert tuple(S.clean_bounds(read_table(spark, path)).first()) == (5.0, 5.0)
    S.store_sketches(sketched(spark.createDataFrame([(day[2], "D", 7, 1.0, 1.0), (day[3], "E", 7, 1.0, 3.0)], schema)), path, months_only=True)
    assert tuple(S.summary_of_range(read_table(spark, path)).first()) == (day[0], day[3], 15, 3, 3, 4)
    assert tuple(S.summary_of_range(read_table(spark, path), "2030-01-01").first()) == (None, None, 0, 0, 0, 0)
    assert tuple(S.clean_bounds(read_table(spark, path), "2030-01-01").first()) == (None, None)
    assert sketched(first.limit(0)).count() == 0
    by = S.merged_sketches(S.daily_sketches(first, sums=("bookings",), by=("destination_id",)), by=("destination_id",))
    assert {(r.destination_id, r.sum_bookings) for r in by.collect()} == {("A", 1), (None, None), ("B", 2)}
