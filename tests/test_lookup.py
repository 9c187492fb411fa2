import datetime as dt
import random

import pytest

from stationcast.operators.asof import asof_latest

D0 = dt.datetime(2024, 1, 1)
FEATURES = "k string, event_timestamp timestamp_ntz, created timestamp_ntz, v int"


def brute(requests, features, ttl):
    out = {}
    for k, i, t in requests:
        ok = [f for f in features if f[0] == k and t - ttl <= f[1] <= t]
        best = max(ok, key=lambda f: (f[1], f[2]), default=None)
        out[i] = best[3] if best else None
    return out


@pytest.mark.parametrize("seed, hours", [(1, 48), (2, 5), (3, 300)])
def test_same_as_brute_force(spark, seed, hours):
    rng = random.Random(seed)
    when = lambda: D0 + dt.timedelta(hours=rng.randrange(24 * 30))
    features = [(rng.choice("ab"), when(), D0 + dt.timedelta(seconds=i), i) for i in range(60)]
    requests = [(rng.choice("abc"), i, when()) for i in range(200)]
    # requests exactly at an event and exactly at its expiry
    requests += [(f[0], 1000 + i, f[1]) for i, f in enumerate(features[:10])]
    requests += [(f[0], 2000 + i, f[1] + dt.timedelta(hours=hours)) for i, f in enumerate(features[:10])]
    got = asof_latest(
        spark.createDataFrame(requests, "k string, i int, asked timestamp_ntz"),
        spark.createDataFrame(features, FEATURES), "k", "asked", "event_timestamp", "created", hours * 3600,
    )
    assert {r["i"]: r["v"] for r in got.collect()} == brute(requests, features, dt.timedelta(hours=hours))
    assert got.count() == len(requests)


def test_later_created_row_wins_a_tie(spark):
    features = [("a", D0, D0 + dt.timedelta(days=d), d) for d in (2, 5, 3)]
    requests = spark.createDataFrame([("a", D0 + dt.timedelta(hours=1))], "k string, asked timestamp_ntz")
    got = asof_latest(requests, spark.createDataFrame(features, FEATURES), "k", "asked", "event_timestamp", "created", 3600)
    assert got.first()["v"] == 5
