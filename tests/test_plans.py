"""Plan shapes that matter at scale (checked on sf0.001; the shapes do not depend on
the data size except where AQE re-plans at run time)."""

from conftest import SF0001
from shockspark.operators import shock as S
from shockspark.operators import travel as TR
from shockspark.operators.windows import CrisisWindow
from shockspark.sources import fixtures as fx


def _plan(df):
    """The final adaptive plan (the part before ``== Initial Plan ==``)."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]




def test_shock_window_is_one_pushed_down_scan(spark):
    df = S.shock_metrics(fx.daily_metrics(spark, SF0001), CrisisWindow.of("1998-06-01", 30, 30))
    df.collect()
    p = _plan(df)
    assert p.count("FileScan parquet") == 1
    assert "GreaterThanOrEqual(date,1998-05-02)" in p and "LessThanOrEqual(date,1998-06-30)" in p
    assert "partial_" in p or "HashAggregate" in p


def test_etl_join_never_broadcasts_lineitem(spark):
    lf = fx.line_facts_raw(spark, SF0001)
    lf.write.format("noop").mode("overwrite").save()
    p = _plan(lf)
    assert "SortMergeJoin [l_orderkey" in p
    # no broadcast exchange directly above the lineitem scan
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "FileScan parquet" in line and "l_shipdate" in line:
            assert "BroadcastExchange" not in lines[i - 1]


def test_travel_measures_run_each_aggregate_once(spark):
    """Four one-row aggregates (flights, visas, bookings, daily bookings): with one
    struct-valued subquery per fact they run as a handful of jobs, not one re-scan per
    measure (the per-column form needs over 30)."""
    ctx = TR.TravelContext.of("1998-06-01", "1998-08-31")
    m = TR.demand_measures(fx.fact_flights(spark, SF0001), fx.fact_visas(spark, SF0001),
                           fx.daily_metrics(spark, SF0001), ctx)
    sc = spark.sparkContext
    sc.setJobGroup("travel-measures", "plan test")
    m.collect()
    jobs = sc.statusTracker().getJobIdsForGroup("travel-measures")
    sc.setJobGroup("other", "other")
    assert len(jobs) <= 12


def test_no_catalogue_plan_holds_a_nested_loop_or_cartesian_join(spark):
    """Initial plans of every reference query that is built without running models."""
    import __spark_entry__ as E

    slow = {"m2_gbt_lag_forecast", "m6_tree_accuracy", "r1_incremental_daily_fact", "pipeline"}
    for name, query in E.queries().items():
        if name in slow or name.startswith("op"):
            continue
        plan = query(spark, SF0001)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_date_range_prunes_month_partitions(spark):
    from shockspark.plans.q_io import write_store
    from shockspark.sources.loaders import load_db

    fact = load_db(spark, write_store(spark, SF0001), "1998-01-15", "1998-02-10")["daily_metrics"]
    plan = fact._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.month for r in fact.select("month").distinct().collect()} == {"1998-01", "1998-02"}


def test_travel_and_ota_measures_scan_each_fact_once(spark):
    from shockspark.operators import kpis as K

    facts = fx.fact_flights(spark, SF0001), fx.fact_visas(spark, SF0001), fx.daily_metrics(spark, SF0001)
    for df, scans in ((TR.shock_trend(*facts, TR.TravelContext()), 3), (K.ota_rollup(facts[2]), 1), (K.volatility(facts[2]), 1),
                      (K.booking_value_per_destination(facts[2]), 1)):
        df.collect()
        assert _plan(df).count("FileScan parquet") == scans


def test_table_function_is_one_pushed_down_scan(spark):
    from shockspark.functions.sql_objects import register_shock_sql

    register_shock_sql(spark, fx.daily_metrics(spark, SF0001), "1998-06-01")
    calls = {"SELECT * FROM demand_shock(DATE '1998-06-01', 30, 31)": ("1998-05-02", "1998-07-02"),
             "SELECT destination_id FROM demand_shock(DATE '1997-01-10', 7, 10) WHERE crisis_id = 1": ("1997-01-03", "1997-01-20"),
             "SELECT * FROM v_demand_shock_metrics": ("1998-05-02", "1998-07-02")}
    for sql, (first, end) in calls.items():
        plan = spark.sql(sql)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "Join" not in plan
        assert f"GreaterThanOrEqual(date,{first})" in plan and f"LessThan(date,{end})" in plan


def test_daily_facts_neither_sort_nor_write_lines(spark):
    """The join below the daily facts hashes the orders and sorts no side."""
    for raw in (fx.daily_metrics_raw, fx.fact_flights_raw):
        plan = raw(spark, SF0001)._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin [l_orderkey" in plan and "SortMergeJoin" not in plan


def test_daily_facts_of_nations_with_one_name(spark, tmp_path):
    """Two nation keys of one name make one row, an unknown nation none, a null flag counts
    as a booking."""
    import datetime as dt

    day, tables = dt.datetime(1998, 1, 1), str(tmp_path)

    def land(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tables}/{name}.parquet")

    land("region", [(0, "R")], "r_regionkey int, r_name string")
    land("nation", [(1, "A", 0), (2, "A", 0), (3, "B", 0)], "n_nationkey int, n_name string, n_regionkey int")
    land("customer", [(1, 1), (2, 2), (3, 9), (4, None)], "c_custkey long, c_nationkey int")
    land("supplier", [(1, 3), (2, 3), (3, None)], "s_suppkey long, s_nationkey int")
    land("orders", [(k, k, day) for k in (1, 2, 3, 4)], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    lines = [(1, 1, 1, 1, 2.0, 10.0, "R", day), (2, 2, 2, 2, 3.0, 20.0, None, day), (1, 1, 3, 1, 2.0, 1.0, "R", day),
             (3, 1, 1, 1, 2.0, 1.0, "R", day), (4, 1, 1, 1, 2.0, 1.0, "R", day), (None, 1, 1, 1, 2.0, 1.0, "R", day)]
    land("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                            "l_returnflag string, l_shipdate timestamp")
    (r,) = fx.daily_metrics_raw(spark, tables).collect()
    assert (r.destination_id, r.source_market, r.bookings, r.cancellations, r.search_demand) == ("B", "A", 1, 1, 5.0)
    assert (r.room_nights, r.adr, r.lead_time_days, r.avg_length_of_stay) == (5.0, 30 / 200, 4, 2.5)
    (f,) = fx.fact_flights_raw(spark, tables).collect()
    assert (f.route, f.flights_count, f.seat_capacity, f.load_factor, f.airline) == ("A-B", 2, 5.0, 0.46, "AL1")
