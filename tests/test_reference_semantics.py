"""Edge cases of the reference's rules: null keys, missing columns, roundings, crisis
windows, correlation grain, storage paths, the tree model's rows."""

import datetime as dt
import json
import math

import pytest
from conftest import SF0001, rows
from pyspark.sql import functions as F

from shockspark.functions.exprs import round_pandas, round_python, to_fixed
from shockspark.functions.ranking import spearman
from shockspark.operators import filters as FL
from shockspark.operators import forecast as FC
from shockspark.operators import kpis as K
from shockspark.operators import shock as S
from shockspark.operators import travel as TR
from shockspark.operators import windows as WN
from shockspark.operators.windows import CrisisWindow
from shockspark.sources import fixtures as fx
from shockspark.sources import loaders as L
from shockspark.sources import sinks as KS

DAY = dt.date(2022, 3, 1)


def fact(spark, data):
    return spark.createDataFrame(data, "date date, destination_id string, source_market string, bookings int, cancellations int, "
                                       "total_reservations int, search_demand double, adr double, room_nights double")


def test_rows_without_a_key_are_left_out(spark):
    df = fact(spark, [(DAY, "A", "X", 3, 0, 3, 9.0, 100.0, 5.0), (DAY, None, "X", 7, 0, 7, 9.0, 100.0, 5.0), (DAY, "A", None, 2, 1, 3, 4.0, 90.0, 1.0),
                      (None, "A", "X", 1, 0, 1, 1.0, 80.0, 1.0)])
    assert [r["destination_id"] for r in rows(S.pre_post_aggregates(df, CrisisWindow.of("2022-03-01")))] == ["A"]
    assert [r["destination_id"] for r in rows(K.hotel_kpis(df))] == ["A"] == [r["destination_id"] for r in rows(K.ota_kpis(df))]
    assert [r["date"] for r in rows(K.timeline(df))] == [DAY] and [r["month"] for r in rows(K.monthly_bookings(df))] == ["2022-03"]
    assert [(r["source"], r["bookings_post"]) for r in rows(K.corridor_matrix(df.filter("date is not null"), DAY))] == [("X", 3.0)]


def test_missing_columns(spark):
    df = fact(spark, [(DAY, "A", "X", 3, 0, 3, 9.0, 100.0, 5.0)])
    s = K.summary(df.drop("room_nights", "bookings", "destination_id")).first()
    assert (s.total_bookings, s.total_room_nights, s.destinations_count, s.records_count) == (0, 0, 0, 1)
    assert set(K.timeline(df.drop("adr")).columns) == {"date", "bookings", "search_demand", "room_nights"}
    assert K.corridor_matrix(df.drop("source_market"), DAY).first().source == "A"
    shock = spark.createDataFrame([("A", -0.5)], "destination_id string, booking_change_pct double")
    risk = S.travel_risk_index(shock).first()
    assert (risk.risk_cancel, risk.risk_adr, risk.risk_level) == (0.0, 0.0, "low") and risk.risk_booking == pytest.approx(0.75)
    assert S.travel_risk_index(shock.select("destination_id")).columns == ["destination_id"]
    full = S.shock_metrics(df, CrisisWindow.of("2022-03-01")).drop("post_booking_cv")
    assert S.resilience_scores(full).first().demand_volatility_score == 0.5


def test_variation_of_an_all_null_post_window(spark):
    df = fact(spark, [(DAY, "A", "X", None, 0, 3, 9.0, 100.0, 5.0), (DAY - dt.timedelta(2), "B", "X", 2, 0, 3, 9.0, 100.0, 5.0),
                      (DAY, "C", "X", 4, 0, 4, 9.0, 100.0, 5.0)])
    got = {r["destination_id"]: r["post_booking_cv"] for r in rows(S.shock_metrics(df, CrisisWindow.of("2022-03-01")))}
    assert got == {"A": 1.0, "B": 0.5, "C": 0.5}


def test_sql_form_counts_a_missing_crisis_as_zero(spark):
    df = fact(spark, [(DAY, "A", "X", 1, 0, 1, 9.0, 100.0, 5.0), (DAY, "A", "X", 2, 0, 2, 9.0, 100.0, 5.0)])
    ids = df.withColumn("crisis_id", F.when(F.col("bookings") == 1, F.lit(0)))
    out = rows(S.shock_metrics_sql(ids, CrisisWindow.of("2022-03-01")))
    assert [(r["crisis_id"], r["post_bookings"]) for r in out] == [(0, 3)]


def test_three_roundings(spark):
    values = [1.115, 0.15, 1.25, 2.675, 39.675, 0.125, 0.5, 1.5, 2.5, -0.125, -1.115, 1e300, 0.0, 1234567.895, 0.045]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for d in (0, 1, 2):
        got = df.select("x", round_python("x", d).alias("p"), to_fixed("x", d).alias("f"), round_pandas("x", d).alias("n")).collect()
        for r in got:
            from decimal import ROUND_HALF_UP, Decimal

            assert r.p == round(r.x, d), (r.x, d)
            if abs(r.x) < 1e20:
                assert r.f == float(Decimal(r.x).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP)), (r.x, d)
                import numpy as np

                assert r.n == np.round(r.x, d)


def test_travel_type_in_any_case(spark):
    f = spark.createDataFrame([(DAY, "A", "A"), (DAY, "B", "A")], "date date, origin_country string, destination_id string")
    assert FL.filter_facts(f, travel_type="DOMESTIC").count() == 1 == FL.filter_facts(f, travel_type="International").count()
    assert FL.filter_facts(f, travel_type="other").count() == 2


def test_crisis_is_the_default_window(spark):
    crises = fx.crisis_events(spark)
    assert TR.TravelContext.of(crisis_id=2).resolved(crises).windows()["cur"] == (dt.date(1996, 3, 1), dt.date(1996, 12, 31))
    kept = TR.TravelContext.of("1996-05-01", crisis_id=2).resolved(crises)
    assert (kept.date_from, kept.date_to) == (dt.date(1996, 5, 1), dt.date(1996, 12, 31))
    open_end = TR.TravelContext.of(crisis_id=1).resolved(crises)
    assert open_end.date_from == dt.date(1998, 6, 1) and open_end.date_to is None
    assert TR.TravelContext.of(crisis_id=99).resolved(crises).date_from is None


def test_crises_on_days(spark):
    c = spark.createDataFrame([(1, "open", dt.date(2020, 1, 5), None), (2, "early", dt.date(2019, 1, 1), dt.date(2019, 2, 1)),
                               (3, "one", dt.date(2020, 1, 2), dt.date(2020, 1, 2)), (4, "late", dt.date(2030, 1, 1), None)],
                              "crisis_id int, crisis_name string, crisis_start_date date, crisis_end_date date")
    d = spark.createDataFrame([(dt.date(2020, 1, i),) for i in range(1, 8)], "date date")
    got = sorted((r["date"].day, r["crisis_id"]) for r in rows(WN.crises_active_on(d, c)))
    assert got == [(2, 3), (5, 1), (6, 1), (7, 1)]
    assert WN.crises_active_on(d.limit(0), c).count() == 0


def test_seats_without_dates(spark):
    f = fx.fact_flights(spark, SF0001)
    assert TR.seats_vs_bookings(f, fx.daily_metrics(spark, SF0001), TR.TravelContext()).count() == 0


def test_spearman_with_ties(spark):
    import pandas as pd

    xs, ys = [1.0, 1.0, 1.0, 2.0, 3.0, 3.0, 9.0] * 5, [2.0, 2.0, 5.0, 5.0, 1.0, 7.0, 7.0] * 5
    got = spearman(spark.createDataFrame(list(zip(xs, ys)), "x double, y double"), "x", "y").first()[0]
    assert got == pytest.approx(pd.Series(xs).rank().corr(pd.Series(ys).rank()))
    assert spearman(spark.createDataFrame([(1.0, 1.0)] * 4, "x double, y double"), "x", "y").first()[0] is None


def test_loaders_look_up_paths_through_spark(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    fx.daily_metrics(spark, SF0001).withColumn("month", F.date_format("date", "yyyy-MM")).write.partitionBy("month").parquet(f"{root}/daily_metrics")
    KS.replace_table(KS.conform_destinations(fx.destinations(spark, SF0001)), f"{root}/destinations")
    db = L.load_db(spark, root, "1998-01-01")
    assert set(db) == {"daily_metrics", "destinations"} and db["destinations"].count() == 25
    fx.destinations(spark, SF0001).write.option("header", "true").csv(f"{root}/d.csv")
    assert L.load_destinations(spark, f"{root}/d.csv").count() == 25
    assert L.load_destinations(spark, f"{root}/none.csv", fx.daily_metrics(spark, SF0001)).first().region is None
    with pytest.raises(FileNotFoundError):
        L.load_destinations(spark, f"{root}/none.csv")
    assert L.load_forecast_data(spark, root) == {}


def test_no_machine_local_folder_off_a_local_master(monkeypatch):
    from shockspark.session import checkpoint_root

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://elsewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        checkpoint_root(Session())


def test_json_of_special_numbers(spark):
    df = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (1.5,), (None,)], "x double")
    assert [json.loads(r.json)["x"] for r in KS.to_json_records(df).collect()] == [None, None, None, 1.5, None]


def test_tree_forecast_rows_bands_and_short_series(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(i) for i in range(140)]
    data = [("bookings", d, float(10 + 3 * (i % 7)), i) for i, d in enumerate(days)]
    data += [("adr", d, 5.0 + i, i) for i, d in enumerate(days[:20])]
    train = spark.createDataFrame(data, "metric string, date date, value double, t int")
    out = rows(FC.gbt_lag_forecast(train, (), horizon=14, n_trees=10, ahead=(1, 2, 3, 4, 5, 6, 7, 10, 14)), ["metric", "date"])
    assert len(out) == 28 and {r["model"] for r in out} == {"gbt_lags"}
    short = [r for r in out if r["metric"] == "adr"]
    assert all((r["forecast"], r["lower"], r["upper"]) == (24.0, 24.0 * 0.8, 24.0 * 1.2) for r in short)
    long = [r for r in out if r["metric"] == "bookings"]
    assert [r["date"] for r in long] == [days[-1] + dt.timedelta(i) for i in range(1, 15)]
    assert all(0 <= r["lower"] <= r["forecast"] <= r["upper"] for r in long)
    assert all(abs(r["forecast"] - (10 + 3 * ((140 + i) % 7))) < 6 for i, r in enumerate(long))
    assert FC.gbt_lag_forecast(train.filter("metric = 'adr'"), (), horizon=3, n_trees=2).count() == 3


def test_autoregression_of_a_constant_and_of_a_short_series(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(i) for i in range(40)]
    train = spark.createDataFrame([("a", d, 7.0, i) for i, d in enumerate(days)] + [("b", d, float(i), i) for i, d in enumerate(days[:12])],
                                  "metric string, date date, value double, t int")
    out = rows(FC.seasonal_ar_forecast(train, (), horizon=5), ["metric", "date"])
    assert [(r["forecast"], r["lower"], r["upper"]) for r in out[:5]] == [(7.0, 7.0, 7.0)] * 5
    assert [(r["forecast"], r["lower"], r["upper"]) for r in out[5:]] == [(11.0, 11.0 * 0.8, 11.0 * 1.2)] * 5


def test_scratch_folders_can_be_removed(spark, tmp_path, monkeypatch):
    from shockspark import session

    monkeypatch.setattr(session, "_SCRATCH", {})
    monkeypatch.setattr(session, "_CACHES", [])
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda s: f"file://{tmp_path}")
    cache, app = session.session_cache(), spark.sparkContext.applicationId
    cache.update({(app, "sf"): "a folder", ("another", "sf"): "its folder"})
    df = session.cut_lineage(spark.range(5), "five")
    assert df.count() == 5 and len(list(tmp_path.iterdir())) == 1
    session.remove_scratch(spark)
    assert list(tmp_path.iterdir()) == [] and cache == {("another", "sf"): "its folder"}
