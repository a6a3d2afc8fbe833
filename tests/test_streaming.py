"""Late rows are dropped, a restart does not duplicate, result equals batch."""

import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import rows
from shockspark.operators.features import daily_aggregates
from shockspark.streaming.incremental_fact import RESERVATION_SCHEMA, read_incremental_fact, run_incremental

D0 = dt.date(2022, 3, 1)


def land(spark, path, days, dest="A"):
    data = [(D0 + dt.timedelta(days=k), dest, "M", k % 2, 1, 2, 100.0 + k) for k in days]
    spark.createDataFrame(data, RESERVATION_SCHEMA).write.mode("append").parquet(path)


def test_incremental_fact(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    ck = os.path.join(out, "_ck")
    land(spark, landing, range(0, 20))
    run_incremental(spark, landing, out, ck, watermark="2 days")
    first = rows(read_incremental_fact(spark, out), ["date"])
    assert len(first) == 20
    # restart with nothing new: no duplicates
    run_incremental(spark, landing, out, ck, watermark="2 days")
    assert len(rows(read_incremental_fact(spark, out))) == 20
    # new on-time rows update a day; a late row (older than the watermark) is dropped
    land(spark, landing, [19, 20, 21])
    run_incremental(spark, landing, out, ck, watermark="2 days")
    land(spark, landing, [1])
    run_incremental(spark, landing, out, ck, watermark="2 days")
    cur = {r["date"]: r for r in rows(read_incremental_fact(spark, out))}
    assert len(cur) == 22
    assert cur[D0 + dt.timedelta(days=19)]["total_reservations"] == 2
    assert cur[D0 + dt.timedelta(days=1)]["total_reservations"] == 1  # late row dropped
    # equals the batch daily aggregate of the on-time rows
    batch = spark.read.schema(RESERVATION_SCHEMA).parquet(landing)
    batch = batch.filter(~((F.col("arrival_date") == D0 + dt.timedelta(days=1))
                           & (F.col("adr") == 101.0))).dropDuplicates()
    b = {r["date"]: r for r in rows(daily_aggregates(batch))}
    assert b[D0 + dt.timedelta(days=5)]["bookings"] == cur[D0 + dt.timedelta(days=5)]["bookings"]
