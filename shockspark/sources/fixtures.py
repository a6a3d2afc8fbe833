"""Hospitality fact tables derived from the TPC-H-like test tables (FIXTURES.md §2).

The derivations are plain joins and aggregates, written so that Spark and an
independent SQL engine give identical values (integer / DECIMAL sums, no double
quotient cast to DECIMAL).

Scale notes
-----------
* ``nation`` and ``region`` are fixed-size dimensions (25 and 5 rows at every scale
  factor); they are broadcast behind a size check.
* ``customer`` and ``supplier`` grow with the scale factor; their key -> nation
  mappings are broadcast only while a row-count check passes
  (``MAPPING_BROADCAST_ROWS``), beyond it they are shuffle joins.  The large side is
  never hinted; AQE may still turn a join into a broadcast at run time from measured
  shuffle sizes.
* ``lineitem`` x ``orders`` is the one large join; it shuffles both sides once on
  the order key.  The daily facts join narrow rows (``_line_codes``): nation keys in
  place of names, no column that they do not sum, the orders hashed by partition and
  neither side sorted or written.  They aggregate by nation keys and put the names to
  the sums, of which there are at most days x nations x nations.
* ``materialized`` writes each derived table once per session into the shared
  checkpoint folder and reads it back: the lineage is cut and every later query
  scans columnar files with filter pushdown instead of recomputing the joins.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockspark.functions.broadcast import broadcast_rows
from shockspark.schemas import CRISIS_EVENTS
from shockspark.session import scratch_path, session_cache

DEFAULT_SF_DIR = "/root/testdata/sf0.001"

# Fixed values of the test crisis table (FIXTURES.md §2.3).  Ids are deliberately not
# in start-date order.
CRISIS_ROWS = [
    (1, "Crisis A", dt.date(1998, 6, 1), None, "REGION_0;REGION_1"),
    (2, "Crisis B", dt.date(1996, 3, 1), dt.date(1996, 12, 31), "REGION_2"),
    (3, "Crisis C", dt.date(2000, 2, 1), None, None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DIM_CHECKED: dict[tuple, bool] = {}


def _dimension(spark, sf_dir, name):
    """A dimension table, broadcast when its size check passes (checked once per
    session; nation and region have 25 and 5 rows at every scale factor)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    df = table(spark, sf_dir, name)
    if key not in _DIM_CHECKED:
        _DIM_CHECKED[key] = df.limit(10_001).count() <= min(10_000, broadcast_rows(df))
    return F.broadcast(df) if _DIM_CHECKED[key] else df


def _checked_broadcast(spark, sf_dir, name, df):
    """A key -> attribute mapping (customer -> nation, supplier -> destination; a row per row
    of table ``name``), broadcast while its bytes allow; beyond that a shuffle join.  They
    grow with the scale factor (1.5 M customers and 100 k suppliers per 10 GB), so the check
    is real; it is made once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, f"map-{name}", *df.columns)
    if key not in _DIM_CHECKED:
        most = broadcast_rows(df)
        _DIM_CHECKED[key] = table(spark, sf_dir, name).limit(most + 1).count() <= most
    return F.broadcast(df) if _DIM_CHECKED[key] else df


def _nation(spark, sf_dir):
    return _dimension(spark, sf_dir, "nation")


def _region(spark, sf_dir):
    return _dimension(spark, sf_dir, "region")


def _order_customer_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> customer nation name (one row per order)."""
    nation = _nation(spark, sf_dir).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source_market"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey")
    cust = _checked_broadcast(spark, sf_dir, "customer", cust)
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return orders.join(cust, orders.o_custkey == cust.c_custkey).drop("c_custkey", "c_nationkey")


def _destination_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation key -> (destination nation, region)."""
    nation = _nation(spark, sf_dir)
    region = _region(spark, sf_dir)
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("s_nationkey"),
        F.col("n_name").alias("destination_id"),
        F.col("r_name").alias("region"))


def _supplier_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> (destination nation, region)."""
    dest = _destination_nation(spark, sf_dir)
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    sup = sup.join(F.broadcast(dest), "s_nationkey").drop("s_nationkey")
    return _checked_broadcast(spark, sf_dir, "supplier", sup)


def _line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined with order (customer nation) and supplier (destination)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    oc = _order_customer_nation(spark, sf_dir).select("o_orderkey", "o_orderdate", "source_market")
    sd = _supplier_destination(spark, sf_dir)
    # Both sides grow with the data: a sort-merge join on the order key (AQE splits
    # skewed order keys); the fact side is never a broadcast build side.
    j = li.join(oc.hint("merge"), li.l_orderkey == oc.o_orderkey).drop("o_orderkey")
    return j.join(sd, j.l_suppkey == sd.s_suppkey).drop("s_suppkey")


def line_facts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one large join (line item x order x customer nation x supplier nation /
    region) with the columns every derived fact needs; materialized once."""
    j = _line_facts(spark, sf_dir)
    return j.select(
        F.col("l_shipdate").cast("date").alias("arrival_date"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        "destination_id", "source_market", "region", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_returnflag")


def _reservations_from(lf: DataFrame) -> DataFrame:
    return lf.select(
        "arrival_date", "destination_id", "source_market", "region",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_canceled"),
        (F.col("l_linenumber") % 3).cast("int").alias("stays_in_weekend_nights"),
        (F.lit(1) + F.col("l_partkey") % 5).cast("int").alias("stays_in_week_nights"),
        (F.col("l_extendedprice") / 100).alias("adr"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 45).cast("int").alias("lead_time_days"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        # Exact cents as a long: the sum is exact and order-independent like a
        # DECIMAL(18,2) sum, but stays on the primitive (non-BigDecimal) path.
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_cents"),
        (F.lit(1) + F.col("l_partkey") % 20).cast("bigint").alias("stay_len"),
    )


def reservations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reservation per line item (FIXTURES.md §2.1), plus the source columns the
    daily aggregate needs."""
    return _reservations_from(line_facts_raw(spark, sf_dir))


def _line_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with what the daily facts sum, and the nation keys of supplier and
    customer.  Orders grow with the data: a shuffle join, whose hashed side holds a key, a
    day and a nation key per order of its partition."""
    sup = _checked_broadcast(spark, sf_dir, "supplier", table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"))
    cust = _checked_broadcast(spark, sf_dir, "customer", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    li = table(spark, sf_dir, "lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "s_nationkey",
        F.col("l_shipdate").cast("date").alias("arrival_date"),
        F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("canceled"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_cents"))
    orders = table(spark, sf_dir, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"), "c_nationkey")
    return li.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))


def _named(spark: SparkSession, sf_dir: str, sums: DataFrame, market: str) -> DataFrame:
    """Sums by nation keys with the nations' names, the customer's as ``market``."""
    origin = _nation(spark, sf_dir).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias(market))
    return sums.join(F.broadcast(_destination_nation(spark, sf_dir)), "s_nationkey").join(origin, "c_nationkey")


def daily_metrics_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily fact at (date, destination_id, source_market) grain (FIXTURES.md §2.2)."""
    part = F.col("l_partkey")
    nights = (F.col("l_linenumber") % 3).cast("int") + (F.lit(1) + part % 5).cast("int")
    added = ["n", "cancellations", "quantity", "price_cents", "room_nights", "stay_len"]
    sums = _line_codes(spark, sf_dir).groupBy(F.col("arrival_date").alias("date"), "s_nationkey", "c_nationkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("canceled").alias("cancellations"),
        F.sum("quantity").alias("quantity"),
        # Exact cents as a long: the sum is exact and order-independent like a
        # DECIMAL(18,2) sum, but stays on the primitive (non-BigDecimal) path.
        F.sum("price_cents").alias("price_cents"),
        F.sum(F.when(~F.col("canceled"), nights).otherwise(0)).alias("room_nights"),
        F.sum((F.lit(1) + part % 20).cast("bigint")).alias("stay_len"),
        F.max(((F.col("l_orderkey") + F.col("l_linenumber")) % 45).cast("int")).alias("lead_time_days"),
    )
    # Several nation keys may have one name, and a key several rows.
    agg = _named(spark, sf_dir, sums, "source_market").groupBy("date", "destination_id", "source_market").agg(
        *[F.sum(c).alias(c) for c in added], F.max("lead_time_days").alias("lead_time_days"))
    n, quantity = F.col("n"), F.col("quantity").cast("double")
    return agg.select(
        "date", "destination_id", "source_market", F.lit(1).alias("crisis_id"),
        (n - F.col("cancellations")).cast("int").alias("bookings"),
        F.col("cancellations").cast("int").alias("cancellations"),
        n.cast("int").alias("total_reservations"),
        quantity.alias("search_demand"),
        (F.col("price_cents").cast("double") / 100 / (F.lit(100) * n)).alias("adr"),
        F.col("room_nights").cast("double").alias("room_nights"),
        (F.col("stay_len").cast("double") / n).alias("avg_length_of_stay"),
        F.when(F.col("source_market") == F.col("destination_id"), "domestic")
         .otherwise("international").alias("travel_type"),
        "lead_time_days",
        F.least(F.lit(0.95), quantity / (F.lit(50) * n)).alias("occupancy_rate"))


def fact_flights_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights fact (FIXTURES.md §2.4)."""
    added, least = ["n", "quantity", "price_cents"], ["part", "l_suppkey"]
    sums = _line_codes(spark, sf_dir).groupBy(F.col("order_date").alias("date"), "s_nationkey", "c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.sum("price_cents").alias("price_cents"),
        F.min(F.col("l_partkey") % 50).alias("part"), F.min("l_suppkey").alias("l_suppkey"))
    agg = _named(spark, sf_dir, sums, "origin_country").groupBy("date", "origin_country", "destination_id").agg(
        *[F.sum(c).alias(c) for c in added], *[F.min(c).alias(c) for c in least])
    return agg.select(
        "date", "origin_country", "destination_id",
        F.concat_ws("-", "origin_country", "destination_id").alias("route"),
        F.col("n").cast("int").alias("flights_count"),
        F.col("quantity").cast("double").alias("seat_capacity"),
        ((F.lit(45) + F.col("part")).cast("double") / 100).alias("load_factor"),
        (F.col("price_cents").cast("double") / 100 / (F.lit(100) * F.col("n"))).alias("avg_airfare"),
        F.concat(F.lit("AL"), (F.col("l_suppkey") % 10).cast("string")).alias("airline"))


def fact_visas_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visa fact (FIXTURES.md §2.5): target nation = nation with key orderkey % 25."""
    oc = _order_customer_nation(spark, sf_dir)
    target = _nation(spark, sf_dir).select(F.col("n_nationkey").alias("t_key"),
                                           F.col("n_name").alias("destination_id"))
    j = oc.join(target, (oc.o_orderkey % 25) == target.t_key)
    return j.groupBy(F.col("o_orderdate").cast("date").alias("date"),
                     F.col("source_market").alias("origin_country"), "destination_id").agg(
        F.count(F.lit(1)).cast("int").alias("visa_applications"),
        F.count_if(F.col("o_orderstatus") != "F").cast("int").alias("visa_issued"),
        F.count_if(F.col("o_orderstatus") == "F").cast("int").alias("visa_rejected"),
        F.min("o_orderpriority").alias("visa_type"),
        (F.lit(3) + F.min(F.col("o_orderkey") % 26).cast("double")).alias("processing_days"),
    )


def crisis_events(spark: SparkSession) -> DataFrame:
    """The three test crises (a dimension of literal rows)."""
    df = spark.createDataFrame(CRISIS_ROWS, "crisis_id int, crisis_name string, crisis_start_date date, "
                                            "crisis_end_date date, affected_regions_raw string")
    return df.select("crisis_id", "crisis_name", "crisis_start_date", "crisis_end_date",
                     F.split("affected_regions_raw", "[;,]").alias("affected_regions")).select(
        *[F.col(f.name).cast(f.dataType) for f in CRISIS_EVENTS.fields])


def destinations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destination dimension: every nation with its region."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("destination_id"),
        F.initcap(F.regexp_replace("n_name", "_", " ")).alias("destination_name"),
        F.col("r_name").alias("region"))


# ---------------------------------------------------------------------------
# Materialisation: each derived table is written once per session and sf_dir.
# ---------------------------------------------------------------------------

_BUILDERS = {
    "line_facts": line_facts_raw,
    "daily_metrics": daily_metrics_raw,
    "fact_flights": fact_flights_raw,
    "fact_visas": fact_visas_raw,
    "destinations": destinations_raw,
}
_MATERIALIZED: dict[tuple, str] = session_cache()


def materialized(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read the derived table ``name``; build and write it first if this session has
    not done so yet.  The files live in the shared checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = _MATERIALIZED.get(key)
    if path is None:
        path = scratch_path(spark, f"fixture-{name}")
        df = _BUILDERS[name](spark, sf_dir)
        if "date" in df.columns:  # a daily fact: files and row groups of few dates, for date pushdown
            df = df.repartitionByRange("date").sortWithinPartitions("date")
        df.write.mode("overwrite").parquet(path)
        _MATERIALIZED[key] = path
    return spark.read.parquet(path)


def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "daily_metrics")


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reservations_from(materialized(spark, sf_dir, "line_facts")).drop("quantity", "price_cents", "stay_len")


def fact_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "fact_flights")


def fact_visas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "fact_visas")


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "destinations")


def materialize_all(spark: SparkSession, sf_dir: str, threads: int = 3) -> None:
    """Build every derived table, submitting the jobs concurrently (the scheduler
    interleaves their tasks)."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=threads) as pool:
        for f in [pool.submit(materialized, spark, sf_dir, n) for n in _BUILDERS]:
            f.result()
