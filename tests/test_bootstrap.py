"""Bootstrap intervals: against draws made by hand, and on any partitioning."""

import datetime as dt
import hashlib

import numpy as np

from shockspark.operators.bootstrap import NAMES, bootstrap_intervals

DAY0 = dt.date(2021, 1, 1)


def test_intervals_are_the_hand_made_draws(spark):
    rng = np.random.default_rng(1)
    lists = {"bookings": rng.normal(size=40).round(3).tolist(), "adr": [1.0, -2.0, 4.0]}
    residuals = spark.createDataFrame([(m, t, r) for m, rs in lists.items() for t, r in enumerate(rs)] + [("adr", 9, None)], "metric string, t int, r double")
    ahead = spark.createDataFrame([(m, DAY0 + dt.timedelta(days=h), h, 100.0 + h) for m in [*lists, "none"] for h in range(1, 10)],
                                  "metric string, date date, h int, forecast double")
    for parts in (1, 5):
        got = bootstrap_intervals(residuals.repartition(parts), ahead.repartition(parts), (), 50).collect()
        assert len(got) == 18
        for r in got:
            rs, h = lists[r.metric], (r.date - DAY0).days
            m = min(7, len(rs))
            x = []
            for b in range(1, 51):
                first = int(hashlib.md5(f"{r.metric}/{b}/{(h - 1) // 7}".encode()).hexdigest()[:15], 16) % (len(rs) - m + 1)
                x.append(100.0 + h + rs[first + (h - 1) % 7 % m])
            assert np.allclose([r[n] for n in NAMES], np.quantile(x, [0.025, 0.1, 0.9, 0.975]))
    assert bootstrap_intervals(residuals.limit(0), ahead, ()).collect() == []
