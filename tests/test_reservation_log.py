"""Repetitions count once, late and keyless rows are kept aside, a replay changes nothing."""

import datetime as dt
import os

from conftest import rows

from shockspark.streaming import reservation_log as R

D0 = dt.date(2022, 3, 1)


def land(spark, path, days, first=0, dest="A", nameless=False):
    data = [(None if nameless else f"{dest}{first + k}", D0 + dt.timedelta(days=k), dest, "M", k % 2, 1, 2, 100.0 + k) for k in days]
    spark.createDataFrame(data, R.LANDED).coalesce(1).write.mode("append").parquet(path)


def facts(spark, out, **kw):
    return {(r["destination_id"], (r["date"] - D0).days): r for r in rows(R.read_reservation_fact(spark, out, **kw))}


def test_repetitions_late_rows_and_replay(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")

    def run():
        R.run_log(spark, landing, out, os.path.join(out, "_ck"), lateness=5)

    land(spark, landing, range(0, 20))
    run()
    assert len(facts(spark, out)) == 20
    land(spark, landing, range(10, 20))  # landed before: the same ids
    land(spark, landing, [18, 18], first=1000)  # one id twice in a landing
    land(spark, landing, [19, 19], nameless=True)  # no ids: two reservations
    run()
    got = facts(spark, out)
    assert [got["A", k]["total_reservations"] for k in (10, 17, 18, 19)] == [1, 1, 2, 3]
    R.compact_log(spark, out)
    land(spark, landing, [3, 14, 25], first=2000)  # the newest day of earlier batches is 19: 3 is late, 14 is not
    spark.createDataFrame([("x", None, "A", "M", 0, 1, 1, 1.0), ("y", D0, None, "M", 0, 1, 1, 1.0)], R.LANDED).write.mode("append").parquet(landing)
    run()
    got, ledger = facts(spark, out), rows(R.read_ledger(spark, out))
    assert got["A", 3]["total_reservations"] == 1 and got["A", 14]["total_reservations"] == 2 and got["A", 25]["total_reservations"] == 1
    assert sorted((r["reservation_id"], r["reason"]) for r in ledger) == [("A2003", "late"), ("x", "no key"), ("y", "no key")]
    both = facts(spark, out, with_late=True)
    assert both["A", 3]["total_reservations"] == 2 and both["A", 3]["late_reservations"] == 1 and both["A", 3]["adr"] == 103.0
    assert sum(r["total_reservations"] for r in both.values()) + 2 == 20 + 1 + 2 + 3 + 2
    # the last batch once more, as after a failure before its end was noted
    before, commits = facts(spark, out, with_late=True), os.path.join(out, "_ck", "commits")
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.remove(os.path.join(commits, name))
    run()
    assert facts(spark, out, with_late=True) == before and len(rows(R.read_ledger(spark, out))) == 3
    R.compact_log(spark, out)
    R.compact_log(spark, out)
    assert facts(spark, out, with_late=True) == before


def test_nothing_landed(spark, tmp_path):
    assert R.read_reservation_fact(spark, str(tmp_path)).count() == 0 == R.read_ledger(spark, str(tmp_path)).count()
    R.compact_log(spark, str(tmp_path))
    assert R.read_reservation_fact(spark, str(tmp_path), with_late=True).columns[-1] == "late_reservations"
