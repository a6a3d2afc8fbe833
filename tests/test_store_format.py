"""K5, S7 through the library's own data source: all or nothing writes, filters in the scan."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shockspark.sources import store_format as S


@pytest.fixture(scope="module")
def store(spark):
    S.register(spark)
    return lambda path: spark.read.format(S.NAME).load(path)


def fact(spark, n=200, parts=4):
    ids = F.col("id")
    return spark.range(0, n, 1, parts).select(
        F.date_add(F.lit(dt.date(2022, 1, 1)), ids.cast("int")).alias("date"), F.concat(F.lit("D"), ids % 7).alias("destination_id"),
        F.when(ids % 5 > 0, ids).alias("bookings"), (ids / 3).alias("revenue"), F.array(ids, ids + 1).alias("pair"))


def save(df, path, mode="overwrite", **options):
    df.write.format(S.NAME).mode(mode).options(**options).save(path)


def test_round_trip_and_append(spark, store, tmp_path):
    path = str(tmp_path / "t")
    save(fact(spark), path, rowsPerFile=30)
    assert store(path).dtypes == fact(spark).dtypes and store(path).exceptAll(fact(spark)).count() == 0 and store(path).count() == 200
    save(fact(spark, 10), path, "append")
    assert store(path).count() == 210
    save(fact(spark, 3), path)
    assert store(path).count() == 3
    assert [spark.read.format(S.NAME).option("commit", i).load(path).count() for i in range(3)] == [200, 210, 3]


def test_filters_mean_what_they_mean_in_spark(spark, store, tmp_path):
    path, plain = str(tmp_path / "t"), fact(spark)
    save(plain, path)
    for condition in ("date >= DATE'2022-03-01' AND date < DATE'2022-04-01'", "destination_id = 'D3'", "bookings IN (3, 4, 500)", "bookings IS NULL", "bookings IS NOT NULL",
                      "bookings <= 20 OR revenue > 50", "revenue = 2.0", "NOT bookings > 7", "bookings IN (3, NULL)", "pair[0] = 4"):
        assert sorted(map(str, store(path).filter(condition).collect())) == sorted(map(str, plain.filter(condition).collect())), condition
    assert store(path).filter("bookings > 190").select("destination_id").count() == plain.filter("bookings > 190").count()


def test_pushed_comparisons_leave_no_filter_to_spark(spark, store, tmp_path):
    reader = S.StoreReader("p", fact(spark).schema, [["a", 3], ["b", 0]])
    date, real = S.D.GreaterThan(("date",), dt.date(2022, 1, 1)), S.D.EqualTo(("revenue",), 1.0)
    assert list(reader.pushFilters([date, real])) == [real]
    assert reader.kept == [("date", "__gt__", dt.date(2022, 1, 1))] and [p.file for p in reader.partitions()] == ["a"]


def test_a_failed_task_leaves_nothing(spark, store, tmp_path):
    path = str(tmp_path / "t")
    save(fact(spark, 20), path)
    lost = fact(spark).withColumn("bookings", F.when(F.col("bookings") == 199, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("bookings")))
    with pytest.raises(Exception, match="lost"):
        save(lost, path)
    assert store(path).count() == 20 and len(os.listdir(tmp_path / "t" / "data")) == 1
    with pytest.raises(Exception, match="other columns"):
        save(spark.range(3), path, "append")
    assert store(path).count() == 20


def test_empty_and_missing_tables(spark, store, tmp_path):
    path = str(tmp_path / "t")
    save(fact(spark, 0), path)
    assert store(path).count() == 0 and store(path).columns == fact(spark).columns
    with pytest.raises(Exception, match="no committed table"):
        store(str(tmp_path / "none"))
