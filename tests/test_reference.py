"""Point-in-time behaviour and recurrences against plain Python."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators import decide, pit, series

D = dt.date


@pytest.fixture
def sample(spark):
    return spark.createDataFrame([("a", D(2024, 5, 1), D(2024, 4, 15), 1.0), ("b", D(2024, 5, 10), D(2024, 4, 28), 2.0), ("c", D(2024, 4, 20), D(2024, 4, 1), 3.0), ("n", None, D(2024, 4, 1), 4.0)], "event_id string, available_from date, reference_date date, value double")


def test_as_of_keeps_what_was_known(sample):
    seen = pit.filter_as_of(sample, "2024-05-01")
    assert {r["event_id"] for r in seen.collect()} == {"a", "c"}
    assert {r["event_id"] for r in pit.filter_as_of(sample, "2024-05-01", keep_unknown=True).collect()} == {"a", "c", "n"}
    pit.assert_point_in_time(seen, "2024-05-01")
    with pytest.raises(AssertionError):
        pit.assert_point_in_time(sample, "2024-05-01")
    with pytest.raises(KeyError):
        pit.filter_as_of(sample, "2024-05-01", available="nope")


def test_appending_later_rows_changes_no_result(spark, sample):
    more = spark.createDataFrame([("a", D(2024, 5, 2), D(2024, 4, 15), 99.0)], sample.schema)
    latest = lambda f: sorted(map(tuple, pit.latest_as_of(f, "2024-05-01", ["event_id"], ["available_from"], ["value"]).collect()))
    assert latest(sample) == latest(sample.unionByName(more))


def test_ewma_scores_and_holt(spark):
    y = [0.0, 1.0, 3.0, 0.0, 2.0, 8.0, 1.0, 0.0, 5.0]
    f = spark.createDataFrame([(y,)], "v array<double>")
    got, holt = f.select(series.ewma_scores(F.col("v")), series.holt_damped(F.col("v"), 2)).first()
    mean = sum(y[:8]) / 8
    level, var, want = y[0], max(sum((x - mean) ** 2 for x in y[:8]) / 8, 0.25), []
    for x in y:
        r = x - level
        want.append(r / max(math.sqrt(var), 0.5))
        level, var = 0.3 * x + 0.7 * level, 0.7 * var + 0.3 * r * r
    assert got == pytest.approx(want)
    logs = [math.log1p(x) for x in y]
    level, trend = logs[0], 0.0
    for x in logs[1:]:
        new = 0.35 * x + 0.65 * (level + 0.85 * trend)
        level, trend = new, 0.15 * (new - level) + 0.85 * 0.85 * trend
    assert holt == pytest.approx(max(0.0, math.expm1(level + (0.85 + 0.85**2) * trend)))


def test_cusum_closed_form(spark):
    z = [0.2, 1.5, -3.0, 2.0, 0.9, 0.9, -1.0]
    f = spark.createDataFrame([("k", i, x) for i, x in enumerate(z)], "k string, t int, z double")
    s, want = 0.0, []
    for x in z:
        s = max(0.0, s + x - 0.5)
        want.append(s)
    assert [r["s"] for r in series.cusum(f, "z", "k", "t").orderBy("t").collect()] == pytest.approx(want)


def test_bands(spark):
    got = spark.createDataFrame([(0.65,), (0.64,), (0.0,), (None,)], "p double").select(decide.alert_level(F.col("p"))).collect()
    assert [r[0] for r in got] == ["CRITICAL", "ALERT", "NONE", "NONE"]


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
