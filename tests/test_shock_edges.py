"""Hand-made edge frames for the shock family (SURVEY §5 (1), (3), (4))."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from shockspark.operators import shock as S
from shockspark.operators.windows import CrisisWindow

START = dt.date(2022, 2, 24)
W = CrisisWindow.of(START, 30, 30)
SCHEMA = ("date date, destination_id string, crisis_id int, bookings int, cancellations int, "
          "total_reservations int, search_demand double, adr double")


def d(k):
    return START + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def fact(spark):
    data = [
        # A: normal both sides, ties with B on change
        (d(-5), "A", 1, 10, 1, 11, 100.0, 50.0), (d(-4), "A", 1, 10, 1, 11, 100.0, 50.0),
        (d(1), "A", 1, 5, 2, 7, 80.0, 40.0), (d(2), "A", 1, 5, 0, 5, 80.0, 40.0),
        # B: same change as A
        (d(-3), "B", 1, 20, 0, 20, None, 60.0), (d(3), "B", 1, 10, 0, 10, None, 60.0),
        # PRE: pre only
        (d(-2), "PRE", 1, 12, 0, 12, 10.0, 70.0),
        # POST: post only, single post row -> CV null -> 0.5
        (d(0), "POST", 1, 7, 1, 8, 5.0, 80.0),
        # ZERO: pre bookings 0
        (d(-1), "ZERO", 1, 0, 0, 0, 0.0, 30.0), (d(5), "ZERO", 1, 4, 0, 4, 3.0, 30.0),
        # out of window rows are ignored
        (d(-31), "A", 1, 999, 0, 999, 1.0, 1.0), (d(30), "A", 1, 999, 0, 999, 1.0, 1.0),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_one_sided_and_zero(fact):
    r = {x["destination_id"]: x for x in rows(S.shock_metrics(fact, W))}
    assert set(r) == {"A", "B", "PRE", "POST", "ZERO"}
    assert r["PRE"]["post_bookings"] is None and r["PRE"]["booking_change_pct"] is None
    assert r["POST"]["pre_bookings"] is None and r["POST"]["pre_cancellation_rate"] == 0.0
    assert r["POST"]["post_booking_cv"] == 0.5
    assert r["ZERO"]["booking_change_pct"] is None  # pre = 0 -> NULL, never NaN
    assert r["B"]["pre_searches"] == 0  # all-null searches on a side with rows -> 0
    assert r["A"]["booking_change_pct"] == pytest.approx(-0.5)
    assert r["A"]["cancellation_spike"] == pytest.approx(2 / 12 - 2 / 22)


def test_two_scan_form_equals_one_pass(fact):
    a = rows(S.pre_post_aggregates(fact, W).drop("_post_mean", "_post_std"), ["destination_id"])
    b = rows(S.pre_post_full_outer(fact, W), ["destination_id"])
    for x, y in zip(a, b):
        for k in y:
            if isinstance(y[k], float) and x[k] is not None:
                assert x[k] == pytest.approx(y[k])
            elif k.startswith("post_") and y[k] is None:
                assert x[k] is None
            elif k.startswith("pre_") and y[k] is None:
                assert x[k] is None


def test_resilience_bounds_and_rank_ties(fact):
    res = rows(S.resilience_scores(S.shock_metrics(fact, W)))
    for r in res:
        if r["resilience_score"] is not None:
            assert 0.0 <= r["resilience_score"] <= 1.0
    sub = {x["destination_id"]: x for x in rows(S.substitution_ranking(S.shock_metrics(fact, W)))}
    assert sub["A"]["substitution_rank"] == sub["B"]["substitution_rank"]  # tie -> same rank
    assert sub["ZERO"]["substitution_rank"] is None and sub["ZERO"]["demand_direction"] == "losing"


def test_rank_minimum(fact):
    ranked = rows(S.rank_by_resilience(S.shock_metrics(fact, W), 10))
    assert {r["destination_id"] for r in ranked} == {"A", "B", "PRE"}


def test_flows_invariant(spark):
    data = [("L1", 100, 50, -0.5), ("L2", 80, 20, -0.75), ("G1", 10, 40, 3.0), ("G2", 50, 90, 0.8)]
    shock = spark.createDataFrame(data, "destination_id string, pre_bookings long, post_bookings long, "
                                        "booking_change_pct double")
    flows = rows(S.sankey_flows(shock, 5, 5))
    lost = 100 * 0.5 + 80 * 0.75
    gained = 30 + 40
    assert sum(f["value"] for f in flows) <= 0.7 * min(lost, gained) + len(flows)
    assert {(f["source"], f["target"]) for f in flows} <= {("L1", "G1"), ("L1", "G2"), ("L2", "G1"), ("L2", "G2")}


def test_risk_tier_zero_is_unknown(spark):
    shock = spark.createDataFrame([("X", 1.0, 0.0, 0.0), ("Y", -1.0, 1.0, -1.0)],
                                  "destination_id string, booking_change_pct double, cancellation_spike double, "
                                  "adr_change_pct double")
    r = {x["destination_id"]: x for x in rows(S.travel_risk_index(shock))}
    assert r["X"]["travel_risk_index"] == 0.0 and r["X"]["risk_tier"] == "unknown"
    assert r["Y"]["risk_tier"] == "High Risk"


def test_all_crises_equals_single(spark, fact):
    crises = spark.createDataFrame([(1, "c", START, None)], "crisis_id int, crisis_name string, "
                                   "crisis_start_date date, crisis_end_date date")
    a = rows(S.shock_metrics(fact, S.all_crises(crises, 30, 30)).drop("crisis_id"), ["destination_id"])
    b = rows(S.shock_metrics(fact, W), ["destination_id"])
    assert [x["destination_id"] for x in a] == [x["destination_id"] for x in b]
    assert [x["post_bookings"] for x in a] == [x["post_bookings"] for x in b]


def test_plan_pushes_date_filter(spark, tmp_path, fact):
    p = str(tmp_path / "fact")
    fact.write.parquet(p)
    plan = S.shock_metrics(spark.read.parquet(p), W)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(date" in plan
    _ = F
