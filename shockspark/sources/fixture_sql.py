"""The fixture derivations of ``fixtures.py`` as portable SQL (DuckDB dialect).

Only the base test tables are registered in the oracle engine, so every oracle query
starts with ``WITH`` + these common table expressions.  They are written independently
of the DataFrame code in ``fixtures.py``; the two must give the same rows.
"""

RESERVATIONS = """
reservations AS (
  SELECT CAST(l.l_shipdate AS DATE) AS arrival_date,
         sn.n_name AS destination_id, cn.n_name AS source_market, r.r_name AS region,
         CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS is_canceled,
         CAST(l.l_linenumber % 3 AS INTEGER) AS stays_in_weekend_nights,
         CAST(1 + l.l_partkey % 5 AS INTEGER) AS stays_in_week_nights,
         l.l_extendedprice / 100 AS adr,
         CAST((l.l_orderkey + l.l_linenumber) % 45 AS INTEGER) AS lead_time_days,
         CAST(l.l_quantity AS BIGINT) AS quantity,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(1 + l.l_partkey % 20 AS BIGINT) AS stay_len
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  JOIN region r ON sn.n_regionkey = r.r_regionkey
)"""

DAILY_METRICS = """
daily_metrics AS (
  SELECT arrival_date AS date, destination_id, source_market, 1 AS crisis_id,
         CAST(SUM(1 - is_canceled) AS INTEGER) AS bookings,
         CAST(SUM(is_canceled) AS INTEGER) AS cancellations,
         CAST(COUNT(*) AS INTEGER) AS total_reservations,
         CAST(SUM(quantity) AS DOUBLE) AS search_demand,
         CAST(SUM(price) AS DOUBLE) / (100 * COUNT(*)) AS adr,
         CAST(SUM(CASE WHEN is_canceled = 0 THEN stays_in_weekend_nights + stays_in_week_nights ELSE 0 END) AS DOUBLE) AS room_nights,
         CAST(SUM(stay_len) AS DOUBLE) / COUNT(*) AS avg_length_of_stay,
         CASE WHEN source_market = destination_id THEN 'domestic' ELSE 'international' END AS travel_type,
         MAX(lead_time_days) AS lead_time_days,
         LEAST(0.95, CAST(SUM(quantity) AS DOUBLE) / (50 * COUNT(*))) AS occupancy_rate
  FROM reservations
  GROUP BY arrival_date, destination_id, source_market
)"""

LINE_FACTS = """
line_facts AS (
  SELECT CAST(o.o_orderdate AS DATE) AS odate, cn.n_name AS origin_country, sn.n_name AS destination_id,
         l.l_quantity, l.l_extendedprice, l.l_partkey, l.l_suppkey
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
)"""

FACT_FLIGHTS = """
fact_flights AS (
  SELECT odate AS date, origin_country, destination_id,
         origin_country || '-' || destination_id AS route,
         CAST(COUNT(*) AS INTEGER) AS flights_count,
         CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS seat_capacity,
         CAST(45 + MIN(l_partkey % 50) AS DOUBLE) / 100 AS load_factor,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / (100 * COUNT(*)) AS avg_airfare,
         'AL' || CAST(MIN(l_suppkey) % 10 AS VARCHAR) AS airline
  FROM line_facts
  GROUP BY odate, origin_country, destination_id
)"""

FACT_VISAS = """
fact_visas AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date, cn.n_name AS origin_country, tn.n_name AS destination_id,
         CAST(COUNT(*) AS INTEGER) AS visa_applications,
         CAST(SUM(CASE WHEN o.o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS INTEGER) AS visa_issued,
         CAST(SUM(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INTEGER) AS visa_rejected,
         MIN(o.o_orderpriority) AS visa_type,
         3 + CAST(MIN(o.o_orderkey % 26) AS DOUBLE) AS processing_days
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN nation tn ON o.o_orderkey % 25 = tn.n_nationkey
  GROUP BY CAST(o.o_orderdate AS DATE), cn.n_name, tn.n_name
)"""

CRISIS_EVENTS = """
crisis_events AS (
  SELECT * FROM (VALUES
    (1, 'Crisis A', DATE '1998-06-01', CAST(NULL AS DATE), 'REGION_0;REGION_1'),
    (2, 'Crisis B', DATE '1996-03-01', DATE '1996-12-31', 'REGION_2'),
    (3, 'Crisis C', DATE '2000-02-01', CAST(NULL AS DATE), CAST(NULL AS VARCHAR))
  ) t(crisis_id, crisis_name, crisis_start_date, crisis_end_date, affected_regions)
)"""

DESTINATIONS = """
destinations AS (
  SELECT n.n_name AS destination_id,
         'Nation ' || substr(n.n_name, 8) AS destination_name,
         r.r_name AS region
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

ALL_CTES = [RESERVATIONS, DAILY_METRICS, LINE_FACTS, FACT_FLIGHTS, FACT_VISAS, CRISIS_EVENTS, DESTINATIONS]


def with_fixtures(body_ctes: str, final_select: str) -> str:
    """``WITH <fixtures>, <body_ctes> <final_select>``.  ``body_ctes`` may be empty."""
    parts = [c.strip() for c in ALL_CTES]
    if body_ctes.strip():
        parts.append(body_ctes.strip())
    return "WITH " + ",\n".join(parts) + "\n" + final_select.strip()
