"""Skew-safe helpers against brute force, with one key holding a third of all rows."""

import datetime
import random

import pytest

from pyspark.sql import functions as F

from salescope.functions.ranking import index_percentiles, latest_per_key, time_ordered_index
from salescope.operators.failures import similar_failures

BASE = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    made = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.34 else rng.choice([None, *(f"k{i}" for i in range(40))])
        # Whole seconds within two minutes, so that many rows share an instant.
        ts = BASE + datetime.timedelta(seconds=rng.randrange(120))
        value = rng.choice([0.0, -5.5, 3.25, float("inf"), float("-inf"), 5e-324, -1e308, rng.uniform(-1e6, 1e6), 10 ** rng.uniform(-8, 8)])
        made.append((i, key, ts, value))
    return made


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, value double")


def by_key(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    return groups


@pytest.mark.parametrize("partitions", [1, 16])
def test_percentiles(frame, rows, partitions):
    fractions = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.key: r for r in index_percentiles(frame.repartition(partitions), ["key"], "value", fractions).collect()}
    for key, group in by_key(rows).items():
        values = sorted(r[3] for r in group)
        for name, p in fractions.items():
            assert got[key][name] == values[min(int(len(values) * p), len(values) - 1)]


def test_percentiles_without_spread(spark):
    frame = spark.createDataFrame([("a", 2.0)] * 50 + [("b", None)], "key string, value double")
    assert [tuple(r) for r in index_percentiles(frame, ["key"], "value", {"p": 0.5}).collect()] == [("a", 2.0)]


def test_time_index(frame, rows):
    got = {r.id: r["index"] for r in time_ordered_index(frame, ["key"], "ts", "id").collect()}
    for group in by_key(rows).values():
        for place, row in enumerate(sorted(group, key=lambda r: (r[2], r[0]))):
            assert got[row[0]] == place


def test_latest(frame, rows):
    got = latest_per_key(frame, ["key"], [F.desc("ts"), F.desc("id")], 5, spread=4).collect()
    want = {r[0] for group in by_key(rows).values() for r in sorted(group, key=lambda r: (r[2], r[0]))[-5:]}
    assert {r.id for r in got} == want and len(got) == len(want)


def test_similar_failures(spark):
    rng = random.Random(3)
    made = []
    for i in range(1500):
        kind = "hot" if rng.random() < 0.34 else rng.choice([None, "E1", "E2"])
        # Three days, many equal instants, and gaps that are exact multiples of the window.
        ts = BASE + datetime.timedelta(minutes=rng.choice([0, 1, 1440, 1441, 2880, rng.randrange(4320)]), seconds=rng.choice([0, 30]))
        made.append((i, ts, kind, rng.choice([None, "", "tool"]), rng.choice(["a" * 100 + "x", "a" * 100 + "y", "b"])))
    frame = spark.createDataFrame(made, "failure_id long, ts timestamp_ntz, error_type string, tool string, message string")
    got = {r.failure_id: r.similar_count for r in similar_failures(frame).collect()}
    day = datetime.timedelta(hours=24)
    for i, ts, kind, tool, message in made:
        want = sum(1 for _, t, k, o, m in made if k == kind and o == tool and m[:100] == message[:100] and ts - day <= t <= ts)
        assert got[i] == want
