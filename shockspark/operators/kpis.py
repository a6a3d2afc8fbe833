"""Fact summaries and stakeholder KPIs (SURVEY A15-A26, A29-A33, A46-A48, A50-A52,
X8, X9).

Shape of every plan here: one hash aggregate with partial aggregation over the fact
(shuffle bounded by the number of groups), then column expressions.  Percent-of-total
uses a one-row aggregate attached as a scalar subquery, never a window over all rows.
Day-level frames (the timeline) are bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspark.functions.exprs import div_if_positive, round_pandas, round_python, safe_div, to_fixed
from shockspark.functions.quantiles import quantiles

# Histogram bins and labels (right-closed).
LOS_BINS = [(0, 2, "1-2 nights"), (2, 4, "3-4 nights"), (4, 7, "5-7 nights"), (7, 14, "8-14 nights"),
            (14, None, "15+ nights")]
WINDOW_BINS = [(0, 3, "0-3 days"), (3, 7, "4-7 days"), (7, 14, "8-14 days"), (14, 30, "15-30 days"),
               (30, None, "30+ days")]
# Traveler mix (start, change per night of stay and bound of leisure and business; the other shares).
MIX = {"leisure": (35, 3, 55.0), "business": (30, -2, 10.0), "luxury": (5.0, 15.0), "family": (25, 5.0), "group": (100, 5.0)}
# Funnel and OTA constants.
PREBOOK_FACTOR = 1.3
COMMISSION_RATE = 0.15
VISITORS_PER_SEARCH = 3
LISTINGS_PER_DESTINATION = 50
GOPPAR_SHARE = 0.4
DEFAULT_OCCUPANCY = 0.75


def _d(x):
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x)[:10])


def summary(fact: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Date range, total bookings and room nights (truncated to int), distinct
    destinations (exact, or HyperLogLog++ with ``approx_distinct``) and row count.  A
    column the frame does not have counts as 0."""
    def total(c):
        return (F.coalesce(F.sum(c), F.lit(0)) if c in fact.columns else F.lit(0)).cast("bigint")

    nd = F.lit(0).cast("bigint")
    if "destination_id" in fact.columns:
        nd = F.approx_count_distinct("destination_id") if approx_distinct else F.count_distinct("destination_id")
    return fact.agg(
        F.min("date").alias("date_min"), F.max("date").alias("date_max"), total("bookings").alias("total_bookings"),
        total("room_nights").alias("total_room_nights"), nd.alias("destinations_count"), F.count(F.lit(1)).alias("records_count"))


def timeline(fact: DataFrame) -> DataFrame:
    """Per date: summed bookings, searches and room nights, unweighted mean adr, of
    the columns that the frame has; rows without a date are left out."""
    how = {"bookings": F.sum, "search_demand": F.sum, "adr": F.avg, "room_nights": F.sum}
    return fact.dropna(subset=["date"]).groupBy("date").agg(*[f(c).alias(c) for c, f in how.items() if c in fact.columns])


def monthly_by_destination(fact: DataFrame) -> DataFrame:
    """Bookings per (month start, destination)."""
    return fact.dropna(subset=["date", "destination_id"]).groupBy(F.trunc("date", "month").alias("date"), "destination_id").agg(
        F.sum("bookings").alias("bookings"))


def monthly_bookings(fact: DataFrame) -> DataFrame:
    """Bookings per calendar month (``yyyy-MM``)."""
    return fact.dropna(subset=["date"]).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("bookings").alias("bookings"))


def funnel(fact: DataFrame) -> DataFrame:
    """Searches -> prebooks (int(1.3 x bookings)) -> bookings -> cancellations, with
    step conversion and drop-off in percent (1 decimal).  One aggregate, then the four
    stages are unpivoted; the previous stage is a column of the same row."""
    t = fact.agg(F.coalesce(F.sum("search_demand"), F.lit(0)).cast("bigint").alias("s"),
                 F.coalesce(F.sum("bookings"), F.lit(0)).cast("bigint").alias("b"),
                 F.coalesce(F.sum("cancellations"), F.lit(0)).cast("bigint").alias("c"))
    t = t.withColumn("p", (F.col("b") * PREBOOK_FACTOR).cast("bigint"))
    def stage(i, name, value, prev):
        return F.struct(F.lit(i).alias("stage"), F.lit(name).alias("name"), value.cast("bigint").alias("value"),
                        prev.cast("bigint").alias("prev"))

    stages = t.select(F.explode(F.array(
        stage(1, "Search Volume", F.col("s"), F.lit(None)), stage(2, "Prebooks", F.col("p"), F.col("s")),
        stage(3, "Room Night Bookings", F.col("b"), F.col("p")),
        stage(4, "Cancellations", F.col("c"), F.col("b")))).alias("x")).select("x.*")
    ok = F.col("prev") > 0
    return stages.select(
        "stage", "name", "value",
        F.when(ok, to_fixed(F.col("value") / F.col("prev") * 100, 1)).alias("conversion_pct"),
        F.when(ok, to_fixed((F.col("prev") - F.col("value")) / F.col("prev") * 100, 1)).alias("drop_off_pct"))


def prepost_totals(fact: DataFrame, crisis_date) -> DataFrame:
    """Totals before / from the crisis date over the whole history (not a window);
    an empty side gives zeros; plus the percent changes of the dashboard."""
    pre = F.col("date") < F.lit(_d(crisis_date))
    post = ~pre

    def side(flag, p):
        return [F.coalesce(F.sum(F.when(flag, F.col("bookings"))), F.lit(0)).cast("bigint").alias(f"{p}_bookings"),
                F.coalesce(F.avg(F.when(flag, F.col("adr"))), F.lit(0.0)).alias(f"{p}_adr"),
                F.coalesce(F.sum(F.when(flag, F.col("search_demand"))), F.lit(0)).cast("bigint").alias(f"{p}_search"),
                F.coalesce(F.sum(F.when(flag, F.col("room_nights"))), F.lit(0)).cast("bigint").alias(f"{p}_room_nights"),
                F.coalesce(F.avg(F.when(flag, F.col("occupancy_rate"))), F.lit(0.0)).alias(f"{p}_occupancy"),
                F.coalesce(F.sum(F.when(flag, F.col("cancellations"))), F.lit(0)).cast("bigint")
                .alias(f"{p}_cancellations")]

    t = fact.agg(*side(pre, "pre"), *side(post, "post"))

    def chg(name):
        return F.when(F.col(f"pre_{name}") != 0,
                      (F.col(f"post_{name}") - F.col(f"pre_{name}")) / F.abs(F.col(f"pre_{name}")) * 100)

    return t.select("*", chg("bookings").alias("bookings_change_pct"), chg("room_nights").alias("room_nights_change_pct"),
                    chg("adr").alias("adr_change_pct"), chg("search").alias("search_change_pct"))


def corridor_matrix(fact: DataFrame, crisis_date) -> DataFrame:
    """(source market, destination) before / from the crisis date over the whole
    history; a missing side is 0; change in percent (0 when pre is 0).  Without a source
    market the destination stands for it; rows without a key are left out."""
    if "source_market" not in fact.columns:
        fact = fact.withColumn("source_market", F.col("destination_id"))
    fact = fact.dropna(subset=["source_market", "destination_id"])
    pre = F.col("date") < F.lit(_d(crisis_date))
    post = ~pre
    agg = fact.groupBy(F.col("source_market").alias("source"), F.col("destination_id").alias("destination")).agg(
        F.coalesce(F.sum(F.when(pre, F.col("bookings"))), F.lit(0)).cast("double").alias("bookings_pre"),
        F.coalesce(F.sum(F.when(post, F.col("bookings"))), F.lit(0)).cast("double").alias("bookings_post"),
        F.coalesce(F.sum(F.when(pre, F.col("search_demand"))), F.lit(0.0)).alias("search_pre"),
        F.coalesce(F.sum(F.when(post, F.col("search_demand"))), F.lit(0.0)).alias("search_post"))
    return agg.withColumn("change_pct", F.when(F.col("bookings_pre") > 0,
                                               (F.col("bookings_post") - F.col("bookings_pre"))
                                               / F.col("bookings_pre") * 100).otherwise(F.lit(0.0)))


def hotel_kpis(fact: DataFrame, group_col: str = "destination_id") -> DataFrame:
    """Occupancy (0.75 when the column is absent), ADR, RevPAR = mean(adr x occ),
    sums, cancellation rate, market demand index = share of bookings x 100."""
    occ = F.col("occupancy_rate") if "occupancy_rate" in fact.columns else F.lit(DEFAULT_OCCUPANCY)
    agg = fact.withColumn("_occ", occ).dropna(subset=[group_col]).groupBy(group_col).agg(
        F.avg("_occ").alias("occupancy_rate"), F.avg("adr").alias("adr"),
        F.avg(F.col("adr") * F.col("_occ")).alias("revpar"),
        F.sum("bookings").alias("bookings"), F.sum("cancellations").alias("cancellations"),
        F.sum("total_reservations").alias("total_reservations"), F.sum("search_demand").alias("search_demand"))
    total = agg.agg(F.sum("bookings")).scalar()
    return agg.withColumns({
        "cancellation_rate": div_if_positive("cancellations", "total_reservations", 0.0),
        "market_demand_index": F.when(total > 0, F.col("bookings") / total * 100).otherwise(F.lit(0.0)),
    })


def hotel_rollup(hk: DataFrame) -> DataFrame:
    """Unweighted means of the hotel KPIs, GOPPAR = 0.4 x RevPAR, the market with
    the highest demand index and with the highest cancellation rate (ties: lowest id)."""
    top = lambda c: F.min_by("destination_id", F.struct((-F.col(c)).alias("k"), F.col("destination_id")))
    return hk.agg(
        F.avg("adr").alias("avg_adr"), F.avg("occupancy_rate").alias("avg_occupancy"),
        F.avg("revpar").alias("avg_revpar"), F.sum("bookings").alias("total_bookings"),
        F.avg("cancellation_rate").alias("avg_cancellation_rate"),
        F.avg("market_demand_index").alias("avg_demand_index"),
        (F.avg("revpar") * GOPPAR_SHARE).alias("goppar"),
        top("market_demand_index").alias("highest_demand_market"),
        top("cancellation_rate").alias("highest_cancellation_risk"))


def ota_kpis(fact: DataFrame, group_col: str = "destination_id") -> DataFrame:
    """Searches, bookings, conversion = bookings / searches, market share by
    searches (percent), mean lead time."""
    aggs = [F.sum("search_demand").alias("search_demand"), F.sum("bookings").alias("bookings")]
    if "lead_time_days" in fact.columns:
        aggs.append(F.avg("lead_time_days").alias("avg_lead_time_days"))
    agg = fact.dropna(subset=[group_col]).groupBy(group_col).agg(*aggs)
    total = agg.agg(F.sum("search_demand")).scalar()
    return agg.withColumns({
        "conversion_rate": div_if_positive("bookings", "search_demand"),
        "market_share_pct": F.when(total > 0, F.col("search_demand") / total * 100).otherwise(F.lit(0.0)),
    })


def _by_date_and_destination(fact: DataFrame) -> DataFrame:
    """Sums and mean ADR per date (``whole_day``) and, in the same pass over the fact, per
    destination (rows without one count there as one unnamed destination)."""
    sets = [[F.col("date")], [F.col("destination_id")]]
    grouped = fact.groupingSets(sets, "date", "destination_id").agg(
        F.grouping("destination_id").alias("_g"), F.sum("bookings").alias("bookings"), F.sum("search_demand").alias("search_demand"),
        F.avg("adr").alias("adr"))
    return grouped.withColumn("whole_day", F.col("_g") == 1).drop("_g")


def ota_rollup(fact: DataFrame) -> DataFrame:
    """GBV = bookings x mean daily ADR, net revenue (15 %), look-to-book,
    conversion %, visitors = 3 x searches, listings = 50 x destinations, top market by
    searches."""
    t = _by_date_and_destination(fact).agg(
        F.sum(F.when(~F.col("whole_day"), F.col("search_demand"))).alias("total_search_demand"),
        F.sum(F.when(~F.col("whole_day"), F.col("bookings"))).cast("bigint").alias("total_bookings"),
        F.count("destination_id").alias("destinations"), F.avg(F.when(F.col("whole_day"), F.col("adr"))).alias("avg_adr"),
        F.min_by("destination_id", F.when(F.col("destination_id").isNotNull(), F.struct(
            (-F.coalesce("search_demand", F.lit(float("-inf")))).alias("k"), F.col("destination_id")))).alias("top_market"))
    s, b = F.col("total_search_demand"), F.col("total_bookings")
    gbv = b * F.col("avg_adr")
    return t.select(
        "total_search_demand", "total_bookings", "avg_adr", gbv.alias("gbv"),
        (gbv * COMMISSION_RATE).alias("net_revenue"), F.lit(COMMISSION_RATE * 100).alias("take_rate_pct"),
        F.when(b != 0, s / b).otherwise(F.lit(0.0)).alias("look_to_book"),
        F.when(s != 0, b / s * 100).otherwise(F.lit(0.0)).alias("conversion_pct"),
        (s * VISITORS_PER_SEARCH).alias("unique_visitors"),
        (F.col("destinations") * LISTINGS_PER_DESTINATION).alias("active_listings"), "top_market")


def daily_ratios(fact: DataFrame) -> DataFrame:
    """Per day: look-to-book (searches / bookings, 2 decimals, days with bookings),
    conversion % (bookings / searches x 100, 0 without searches)."""
    tl = timeline(fact)
    return tl.select(
        "date", "bookings", "search_demand",
        F.when(F.col("bookings") > 0, to_fixed(F.coalesce(F.col("search_demand"), F.lit(0.0)) / F.col("bookings"), 2))
         .alias("look_to_book"),
        F.when(F.col("search_demand") > 0, F.col("bookings") / F.col("search_demand") * 100)
         .otherwise(F.lit(0.0)).alias("conversion_pct"))


def _histogram(values: DataFrame, col: str, bins, include_zero: bool = False) -> DataFrame:
    """Right-closed bins counted in one aggregate (empty bins kept), unpivoted; pct of
    the binned total with 1 decimal."""
    x = F.col(col)
    counts = []
    for i, (lo, hi, label) in enumerate(bins):
        low = (x >= lo) if (include_zero and i == 0) else (x > lo)
        cond = low if hi is None else low & (x <= hi)
        counts.append(F.struct(F.lit(i + 1).alias("bin"), F.lit(label).alias("category"),
                               F.count_if(cond).alias("count")))
    arr = values.agg(F.array(*counts).alias("a"))
    rows = arr.select(F.explode("a").alias("r"), F.aggregate(
        F.transform("a", lambda s: s["count"]), F.lit(0).cast("bigint"), lambda acc, v: acc + v).alias("total"))
    return rows.select("r.bin", "r.category", "r.count",
                       F.when(F.col("total") > 0, round_python(F.col("r.count") / F.col("total") * 100, 1))
                        .otherwise(F.lit(0.0)).alias("pct"))


def length_of_stay_histogram(fact: DataFrame) -> DataFrame:
    """Length-of-stay bins from avg_length_of_stay (or room nights / bookings)."""
    if "avg_length_of_stay" in fact.columns:
        v = fact.select(F.col("avg_length_of_stay").alias("los")).filter(F.col("los").isNotNull())
    else:
        v = fact.filter(F.col("bookings") > 0).select((F.col("room_nights") / F.col("bookings")).alias("los"))
    return _histogram(v, "los", LOS_BINS)


def booking_window_histogram(fact: DataFrame, include_zero: bool = False) -> DataFrame:
    """Lead-time bins; a lead time of 0 falls outside (0, 3] as in the reference
    unless ``include_zero``."""
    v = fact.select(F.col("lead_time_days").alias("lt")).filter(F.col("lt").isNotNull())
    return _histogram(v, "lt", WINDOW_BINS, include_zero)


def traveler_mix(fact: DataFrame) -> DataFrame:
    """Traveler-type mix from mean length of stay and an ADR test (some
    destination's mean ADR above the 80th percentile of destination means)."""
    dest_adr = fact.groupBy("destination_id").agg(F.avg("adr").alias("a"))
    p80 = quantiles(dest_adr, "a", {"p80": 0.8}).select("p80").scalar()
    high = dest_adr.select(F.when(F.col("a") > p80, 1).otherwise(0).alias("h")).agg(F.max("h")).scalar()
    t = fact.agg(F.sum("room_nights").alias("rn"), F.sum("bookings").alias("b"))
    los = F.when(F.col("b") > 0, F.col("rn") / F.col("b")).otherwise(F.lit(3.0))
    t = t.select(los.alias("los"), F.col("b").cast("bigint").alias("total_bookings"),
                 F.coalesce(high, F.lit(0)).alias("high"))
    (l0, l1, l2), (b0, b1, b2), (low, high_share) = MIX["leisure"], MIX["business"], MIX["luxury"]
    t = t.withColumns({"leisure": F.least(F.lit(l2), l0 + F.col("los") * l1),
                       "business": F.greatest(F.lit(b2), b0 + F.col("los") * b1),
                       "luxury": F.when(F.col("high") == 1, F.lit(high_share)).otherwise(F.lit(low))})
    t = t.withColumn("family", F.greatest(F.lit(MIX["family"][1]), MIX["family"][0] - F.col("business")))
    rest = MIX["group"][0] - F.col("leisure") - F.col("business") - F.col("luxury") - F.col("family")
    t = t.withColumn("group", F.greatest(F.lit(MIX["group"][1]), rest))
    t = t.withColumn("raw_total", F.col("leisure") + F.col("business") + F.col("family") + F.col("group")
                     + F.col("luxury"))
    cats = ["Leisure", "Business", "Family", "Group", "Luxury"]
    rows = t.select("total_bookings", "raw_total", F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("ord"), F.lit(c).alias("category"), F.col(c.lower()).alias("raw"))
        for i, c in enumerate(cats)])).alias("r"))
    return rows.select("r.ord", "r.category",
                       F.floor(F.col("total_bookings") * F.col("r.raw") / F.col("raw_total")).cast("bigint").alias("count"),
                       round_python(F.col("r.raw") / F.col("raw_total") * 100, 1).alias("pct"))


def travel_type_flows(fact: DataFrame) -> DataFrame:
    """Per travel type: bookings, searches, room nights, mean ADR, booking share %
    (1 decimal)."""
    agg = fact.filter(F.col("travel_type").isNotNull()).groupBy("travel_type").agg(
        F.sum("bookings").alias("bookings"), F.sum("search_demand").alias("search_demand"),
        F.sum("room_nights").alias("room_nights"), F.avg("adr").alias("avg_adr"))
    total = agg.agg(F.sum("bookings")).scalar()
    return agg.withColumn("share_pct", F.when(total > 0, round_pandas(F.col("bookings") / total * 100, 1))
                          .otherwise(F.lit(0.0)))


def source_markets(fact: DataFrame) -> DataFrame:
    """Distinct non-null source markets in order."""
    return fact.select(F.col("source_market").alias("id")).filter(F.col("id").isNotNull()).distinct().orderBy("id")


def rebased_indices(fact: DataFrame) -> DataFrame:
    """ADR, search and booking indices per day rebased to the first day (= 100;
    a zero or missing base counts as 1), 1 decimal, and their composite mean.  The
    first-day values are ``min_by`` aggregates (scalar subqueries), not a window."""
    tl = timeline(fact)
    first = tl.agg(F.min_by(F.struct("adr", "search_demand", "bookings"), "date").alias("f"))
    base = lambda c: F.coalesce(F.when(F.col(f"f.{c}") != 0, F.col(f"f.{c}")), F.lit(1.0))
    idx = tl.withColumn("f", first.scalar()).select(
        "date", to_fixed(F.coalesce(F.col("adr"), F.lit(0.0)) / base("adr") * 100, 1).alias("hotel_index"),
        to_fixed(F.coalesce(F.col("search_demand"), F.lit(0.0)) / base("search_demand") * 100, 1).alias("ota_index"),
        to_fixed(F.coalesce(F.col("bookings"), F.lit(0)) / base("bookings") * 100, 1).alias("tech_index"))
    return idx.withColumn("composite", (F.col("hotel_index") + F.col("ota_index") + F.col("tech_index")) / 3)


def composite_prepost(fact: DataFrame, crisis_date) -> DataFrame:
    """Mean composite index before / from the crisis month (months compared as
    ``yyyy-MM`` like the UI), post-crisis trough, recovery % of the last day from the
    trough, and the per-sector table (last index, change vs 100, recovery from the
    sector trough)."""
    idx = rebased_indices(fact).withColumn("month", F.date_format("date", "yyyy-MM"))
    cm = _d(crisis_date).strftime("%Y-%m")
    pre = F.col("month") < cm
    last = F.max_by(F.struct("hotel_index", "ota_index", "tech_index", "composite"), "date")
    t = idx.agg(
        F.coalesce(F.avg(F.when(pre, F.col("composite"))), F.lit(0.0)).alias("pre_index"),
        F.coalesce(F.avg(F.when(~pre, F.col("composite"))), F.lit(0.0)).alias("post_index"),
        F.min(F.when(~pre, F.col("composite"))).alias("post_trough"),
        last.alias("last"), F.min("hotel_index").alias("hotel_trough"), F.min("ota_index").alias("ota_trough"),
        F.min("tech_index").alias("tech_trough"))

    def rec(v, trough):
        return F.when(F.col(trough) > 0, (v - F.col(trough)) / F.col(trough) * 100).otherwise(F.lit(0.0))

    return t.select(
        "pre_index", "post_index",
        F.when(F.col("post_trough").isNull(), F.lit(0.0)).otherwise(rec(F.col("last.composite"), "post_trough"))
         .alias("recovery_pct"),
        F.col("last.hotel_index").alias("hotel_post"), (F.col("last.hotel_index") - 100).alias("hotel_change"),
        rec(F.col("last.hotel_index"), "hotel_trough").alias("hotel_recovery"),
        F.col("last.ota_index").alias("ota_post"), (F.col("last.ota_index") - 100).alias("ota_change"),
        rec(F.col("last.ota_index"), "ota_trough").alias("ota_recovery"),
        F.col("last.tech_index").alias("tech_post"), (F.col("last.tech_index") - 100).alias("tech_change"),
        rec(F.col("last.tech_index"), "tech_trough").alias("tech_recovery"))


def volatility(fact: DataFrame) -> DataFrame:
    """Population std of the daily search / booking ratio (days with bookings,
    n >= 2 else 0) and the market-cap proxy = total bookings x mean daily ADR."""
    r = F.when(F.col("bookings") > 0, F.coalesce(F.col("search_demand"), F.lit(0.0)) / F.col("bookings"))
    v = timeline(fact).agg(F.count(r).alias("n"), F.stddev_pop(r).alias("sd"), F.sum("bookings").alias("b"), F.avg("adr").alias("a"))
    return v.select(F.when(F.col("n") >= 2, F.col("sd")).otherwise(F.lit(0.0)).alias("volatility_index"),
                    (F.col("b") * F.col("a")).alias("market_cap_proxy"))


def booking_value_per_destination(fact: DataFrame) -> DataFrame:
    """Average bookings per destination (rounded), booking value per destination
    (bookings x mean positive daily ADR / destinations) and conversion %."""
    day, per_day = F.col("whole_day"), lambda c: F.when(F.col("whole_day"), F.col(c))
    t = _by_date_and_destination(fact).agg(
        F.sum(per_day("bookings")).cast("bigint").alias("b"), F.count("destination_id").alias("n"),
        F.sum(per_day("search_demand")).alias("s"), F.avg(F.when(day & (F.col("adr") > 0), F.col("adr"))).alias("pos_adr"))
    pos_adr = F.col("pos_adr")
    return t.select(
        F.col("b").alias("total_bookings"), F.col("n").alias("destinations_count"),
        F.when(F.col("n") > 0, to_fixed(F.col("b") / F.col("n"), 0)).otherwise(F.lit(0.0)).alias("avg_booking_volume"),
        F.when(F.col("n") > 0, F.col("b") * pos_adr / F.col("n")).otherwise(F.lit(0.0)).alias("avg_booking_value"),
        F.when(F.col("s") > 0, F.col("b") / F.col("s") * 100).otherwise(F.lit(0.0)).alias("conversion_pct"))


def revenue_scenarios(fact: DataFrame, package_price: float = 1500.0, margin_pct: float = 15.0,
                      markup_pct: float = 8.0, tx_fee: float = 3.0, conn_fee: float = 1.5) -> DataFrame:
    """The three revenue calculators applied per destination: hotel = ADR x room
    nights x occupancy; TMC = package x bookings x margin / 100; travel tech =
    bookings x (markup % x ADR + fees)."""
    agg = fact.groupBy("destination_id").agg(
        F.avg("adr").alias("adr"), F.sum("room_nights").alias("room_nights"),
        F.avg("occupancy_rate").alias("occupancy"), F.sum("bookings").alias("bookings"))
    return agg.select(
        "destination_id", (F.col("adr") * F.col("room_nights") * F.col("occupancy")).alias("hotel_revenue"),
        (F.lit(package_price) * F.col("bookings") * margin_pct / 100).alias("tmc_revenue"),
        (F.col("bookings") * (markup_pct / 100 * F.col("adr") + tx_fee + conn_fee)).alias("tech_revenue"))


def performance_indices(fact: DataFrame) -> DataFrame:
    """X8 (documented extra): MPI, ARI and RGI = destination / market x 100 for
    occupancy, ADR and RevPAR; the market is the unweighted mean over destinations."""
    hk = hotel_kpis(fact)
    m = hk.agg(F.avg("occupancy_rate").alias("o"), F.avg("adr").alias("a"), F.avg("revpar").alias("r"))
    return hk.select("destination_id",
                     (safe_div("occupancy_rate", m.select("o").scalar()) * 100).alias("mpi"),
                     (safe_div("adr", m.select("a").scalar()) * 100).alias("ari"),
                     (safe_div("revpar", m.select("r").scalar()) * 100).alias("rgi"))


def source_market_concentration(fact: DataFrame) -> DataFrame:
    """X9 (documented extra): Herfindahl index of source-market booking shares per
    destination (two-level aggregation)."""
    by = fact.groupBy("destination_id", "source_market").agg(F.sum("bookings").alias("b"))
    tot = by.groupBy("destination_id").agg(F.sum("b").alias("t"), F.sum(F.col("b") * F.col("b")).alias("b2"),
                                           F.count(F.lit(1)).alias("markets"))
    return tot.select("destination_id", "markets",
                      F.when(F.col("t") > 0, F.col("b2") / (F.col("t") * F.col("t"))).alias("hhi"))


# Traffic-light thresholds in percent (documented KPI card colours).
LIGHTS = {"bookings": (-10.0, 0.0), "search_demand": (-10.0, 0.0), "room_nights": (-10.0, 0.0)}
RED_ABOVE = {"cancellations": 20.0}
RED_BELOW = {"adr": -5.0, "revpar": -10.0}


def baseline_changes(fact: DataFrame, window) -> DataFrame:
    """X7 / X14 input: per destination, percent change post vs pre window of bookings,
    cancellations, searches, ADR, room nights and RevPAR (one conditional aggregate)."""
    pre, post = window.is_pre("date"), window.is_post("date")
    revpar = F.col("adr") * F.coalesce(F.col("occupancy_rate"), F.lit(DEFAULT_OCCUPANCY))
    sums = ["bookings", "cancellations", "search_demand", "room_nights"]
    aggs = []
    for c in sums:
        aggs += [F.sum(F.when(pre, F.col(c))).cast("double").alias(f"_pre_{c}"),
                 F.sum(F.when(post, F.col(c))).cast("double").alias(f"_post_{c}")]
    aggs += [F.avg(F.when(pre, F.col("adr"))).alias("_pre_adr"), F.avg(F.when(post, F.col("adr"))).alias("_post_adr"),
             F.avg(F.when(pre, revpar)).alias("_pre_revpar"), F.avg(F.when(post, revpar)).alias("_post_revpar")]
    g = fact.filter(window.in_window("date")).groupBy("destination_id").agg(*aggs)
    names = sums + ["adr", "revpar"]
    return g.select("destination_id", *[
        (safe_div(F.col(f"_post_{c}") - F.col(f"_pre_{c}"), f"_pre_{c}") * 100).alias(f"{c}_change_pct")
        for c in names])


def traffic_lights(changes: DataFrame) -> DataFrame:
    """X15 (documented extra): red / amber / green class of each change."""
    out = [F.col("destination_id")]
    for c, (red, green) in LIGHTS.items():
        x = F.col(f"{c}_change_pct")
        out.append(F.when(x.isNull(), "none").when(x < red, "red").when(x > green, "green").otherwise("amber")
                   .alias(f"{c}_light"))
    for c, lim in RED_ABOVE.items():
        x = F.col(f"{c}_change_pct")
        out.append(F.when(x.isNull(), "none").when(x > lim, "red").otherwise("green").alias(f"{c}_light"))
    for c, lim in RED_BELOW.items():
        x = F.col(f"{c}_change_pct")
        out.append(F.when(x.isNull(), "none").when(x < lim, "red").otherwise("green").alias(f"{c}_light"))
    return changes.select(*out)
