"""Table schemas.  Explicit ``StructType`` on every read; no inference."""

from pyspark.sql import types as T

S, I, D, DT, TS, L = (T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType(),
                      T.TimestampType(), T.LongType())


def _schema(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


DAILY_METRICS_BASE = _schema(
    ("date", DT, False), ("destination_id", S, False), ("source_market", S, True),
    ("crisis_id", I, True), ("bookings", I, True), ("cancellations", I, True),
    ("total_reservations", I, True), ("search_demand", D, True), ("adr", D, True),
    ("room_nights", D, True),
)
DAILY_METRICS_OPTIONAL = _schema(
    ("avg_length_of_stay", D, True), ("travel_type", S, True), ("lead_time_days", I, True),
    ("occupancy_rate", D, True),
)
DAILY_METRICS_ENGINEERED = _schema(
    ("bookings_per_day", D, True), ("cancellation_rate", D, True),
    ("search_to_booking_ratio", D, True), ("adr_change", D, True),
    ("demand_change_percent", D, True), ("normalized_demand_index", D, True),
    ("crisis_phase", S, True), ("days_since_crisis", I, True),
)
DAILY_METRICS = T.StructType(DAILY_METRICS_BASE.fields + DAILY_METRICS_OPTIONAL.fields
                             + DAILY_METRICS_ENGINEERED.fields)

DESTINATIONS = _schema(("destination_id", S, False), ("destination_name", S, False), ("region", S, True))

CRISIS_EVENTS = _schema(
    ("crisis_id", I, False), ("crisis_name", S, False), ("crisis_start_date", DT, False),
    ("crisis_end_date", DT, True), ("affected_regions", T.ArrayType(S), True),
)

FACT_FLIGHTS = _schema(
    ("date", DT, False), ("origin_country", S, False), ("destination_id", S, False),
    ("route", S, True), ("flights_count", I, True), ("seat_capacity", D, True),
    ("load_factor", D, True), ("avg_airfare", D, True), ("airline", S, True),
)

FACT_VISAS = _schema(
    ("date", DT, False), ("origin_country", S, False), ("destination_id", S, False),
    ("visa_applications", I, True), ("visa_issued", I, True), ("visa_rejected", I, True),
    ("visa_type", S, True), ("processing_days", D, True),
)

# Landing formats (CSV)
HOTEL_BOOKINGS_CSV = _schema(
    ("hotel", S, True), ("is_canceled", S, True), ("lead_time", S, True),
    ("arrival_date_year", S, True), ("arrival_date_month", S, True),
    ("arrival_date_day_of_month", S, True), ("stays_in_weekend_nights", S, True),
    ("stays_in_week_nights", S, True), ("adults", S, True), ("children", S, True),
    ("country", S, True), ("adr", S, True), ("reservation_status", S, True),
)

DEMAND_CSV = _schema(
    ("date", DT, True), ("destination", S, True), ("source_market", S, True),
    ("bookings", I, True), ("searches", I, True), ("cancellations", I, True),
    ("adr", D, True), ("room_nights", D, True), ("lead_time_days", I, True),
    ("occupancy_rate", D, True), ("avg_length_of_stay", D, True), ("travel_type", S, True),
)

FORECAST_OUTPUT = _schema(
    ("date", DT, True), ("metric", S, True), ("model", S, True), ("forecast", D, True),
    ("lower", D, True), ("upper", D, True),
)
FORECAST_ACCURACY = _schema(
    ("metric", S, True), ("model", S, True), ("mae", D, True), ("rmse", D, True),
    ("mape", D, True), ("mase", D, True), ("n", L, True),
)
RECOVERY_TIMELINE = _schema(
    ("destination_id", S, True), ("crisis_start", DT, True), ("baseline_level", D, True),
    ("trough_level", D, True), ("trough_date", DT, True), ("recovery_50_date", DT, True),
    ("recovery_90_date", DT, True), ("recovery_100_date", DT, True),
    ("estimated_days_to_50", I, True), ("estimated_days_to_90", I, True),
    ("estimated_days_to_100", I, True),
)
