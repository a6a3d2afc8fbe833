"""Series edge cases: gaps, short series, phases (SURVEY §5 (1))."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from shockspark.operators import features as FE
from shockspark.operators import forecast as FC
from shockspark.operators import kpis as KP
from shockspark.operators import series as SE

D0 = dt.date(2022, 1, 1)


def series(spark, n, gap_every=0, metric="bookings"):
    data = [("X", metric, D0 + dt.timedelta(days=i), float(10 + i % 7)) for i in range(n)
            if not (gap_every and i % gap_every == 3)]
    return spark.createDataFrame(data, "destination_id string, metric string, date date, value double") \
        .withColumn("how", F.lit("mean" if metric == "adr" else "sum"))


def test_densify_fills(spark):
    s = series(spark, 20, gap_every=5)
    d = rows(SE.densify(s), ["date"])
    assert len(d) == 20 and d[3]["value"] == 0.0 and d[3]["t"] == 3
    a = rows(SE.densify(series(spark, 20, gap_every=5, metric="adr")), ["date"])
    assert a[3]["value"] == a[2]["value"]  # forward fill for a mean series


def test_short_series_fallback(spark):
    tr = SE.densify(series(spark, 5))
    f = rows(FC.trend_season_forecast(tr, horizon=3), ["date"])
    assert [x["forecast"] for x in f] == [f[0]["forecast"]] * 3
    assert f[0]["lower"] == pytest.approx(0.8 * f[0]["forecast"])
    s = rows(FC.seasonal_ar_forecast(tr, horizon=3), ["date"])
    assert s[0]["forecast"] == 14.0 and s[0]["upper"] == pytest.approx(14.0 * 1.2)


def test_long_series_models(spark):
    tr = SE.densify(series(spark, 400))
    f = rows(FC.seasonal_ar_forecast(tr, horizon=14), ["date"])
    assert len(f) == 14
    # perfectly weekly series: the seasonal AR reproduces it
    assert f[0]["forecast"] == pytest.approx(10 + 400 % 7, abs=1e-6)
    g = rows(FC.trend_season_forecast(tr, horizon=7), ["date"])
    assert sorted(round(x["forecast"]) for x in g) == list(range(10, 17))


def test_seasonality_weekly(spark):
    s = rows(SE.detect_seasonality(SE.densify(series(spark, 120))))
    assert s[0]["dominant_period"] == 7 and s[0]["strength"] > 0.9


def test_phase_day_zero(spark):
    start = dt.date(2022, 2, 24)
    days = spark.createDataFrame([(start + dt.timedelta(days=k),) for k in (-1, 0, 14, 15, 91)], "date date") \
        .withColumn("k", F.datediff("date", F.lit(start)))
    f4 = [r["p"] for r in rows(days.select("k", FE.crisis_phase("k").alias("p")), ["k"])]
    f6 = [r["p"] for r in rows(days.select("k", FE.crisis_phase(F.greatest("k", F.lit(0)), "pre_crisis").alias("p")),
                               ["k"])]
    assert f4 == ["pre_crisis", "immediate", "immediate", "short_term", "recovery"]
    assert f6 == ["pre_crisis", "pre_crisis", "immediate", "short_term", "recovery"]


def test_lead_time_zero_falls_out(spark):
    fact = spark.createDataFrame([(0,), (1,), (3,), (45,)], "lead_time_days int")
    h = rows(KP.booking_window_histogram(fact), ["bin"])
    assert sum(x["count"] for x in h) == 3 and h[0]["count"] == 2
    h0 = rows(KP.booking_window_histogram(fact, include_zero=True), ["bin"])
    assert h0[0]["count"] == 3


def test_shares_sum_to_100(spark):
    fact = spark.createDataFrame([("A", 5, 10.0, 1), ("B", 15, 30.0, 2), ("C", 0, 60.0, 3)],
                                 "destination_id string, bookings int, search_demand double, lead_time_days int")
    o = rows(KP.ota_kpis(fact))
    assert sum(x["market_share_pct"] for x in o) == pytest.approx(100.0)
