"""General problems: late events, units, attributes at event time, rolling totals - against brute force."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import late, rolling, units, versions

D = dt.date
DAY = D(2022, 1, 3)  # a Monday


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def delivered(spark, data):
    frame = spark.createDataFrame(data, "id string, entity string, event date, arrival date, source_table string")
    return late.first_deliveries(frame, "t", "id", F.col("entity"), "event", "arrival")


def test_late_refuses_closed_periods_only(spark):
    closes = D(2022, 1, 9) + dt.timedelta(42)
    data = [
        ("a", "e", DAY, closes, "x"),  # on the last day: accepted
        ("b", "e", DAY, closes + dt.timedelta(1), "x"),  # a day later: refused
        ("b", "e", DAY, closes + dt.timedelta(9), "x"),  # a later delivery of it changes nothing
        ("c", "e", DAY, None, "x"), ("c", "e", DAY, D(2022, 1, 5), "x"), ("c", "e", DAY, D(2022, 1, 5), "x"),
        ("d", "e", D(1970, 1, 1), D(2022, 1, 5), "x"),  # no event date
        ("f", "e", DAY, D(9999, 12, 31), "x"), ("g", None, None, None, "x"), (None, "e", DAY, DAY, "x"), ("  ", "e", DAY, DAY, "x"),
    ]
    cls = late.classify(delivered(spark, data))
    assert rows(late.refused(cls), "record_id") == [("b",)]
    assert rows(late.combine(late.partials(cls)), "period", "n") == [(DAY, 2)]


def test_late_partials_merge_in_any_split(spark):
    r = random.Random(3)
    data = [(f"r{i}", r.choice("xy"), DAY + dt.timedelta(r.randrange(30)), DAY + dt.timedelta(r.randrange(30, 60)), "s") for i in range(200)]
    whole = late.partials(late.classify(delivered(spark, data)))
    parts = [late.partials(late.classify(delivered(spark, data[a : a + 70]))) for a in (0, 70, 140)]
    merged = late.merge_partials(*parts)
    columns = ("entity_key", "period", "arrival_batch", "n", "delay_sum")
    assert rows(whole, *columns) == rows(merged, *columns)


def test_late_empty(spark):
    assert late.combine(late.partials(late.classify(delivered(spark, [])))).count() == 0


@pytest.mark.parametrize(
    "unit, element, note, want",
    [
        ("1000 head", "Stocks", None, ("head", 1000)), ("mio head", "Stock", None, ("head", 1000000)), ("An.", "Stocks", None, ("head", 1)),
        ("q", "Production", None, ("kg", 100)), ("(Tonnes (thousand))", "production", None, ("kg", 1000000)), ("kt", "Production", None, ("kg", 1000000)),
        ("hg/An", "Yield", None, ("g", 100)), ("lb/head", "Yield/Carcass Weight", None, ("g", Decimal("453.59237"))), ("sq km", "Pasture area", None, ("m2", 1000000)),
        ("acres", "Grazing area", None, ("m2", Decimal("4046.8564224"))), (None, "Production, Tonnes (thousand)", None, ("kg", 1000000)), ("-", "Yield [0.1 kg/An]", None, ("g", 100)),
        ("see note", "Stocks", "NB animals, in thousand.", ("head", 1000)), ("n/a", "Pasture area", "square kilometres of grazing land; official figure", ("m2", 1000000)),
        (None, "Stocks", "official figure", None), ("?", "Yield", None, None), ("t", "Stocks", None, None), (None, None, None, None), ("", "", "", None), ("head", "Weather", None, None),
    ],
)
def test_units(unit, element, note, want):
    assert units.unit_of(unit, element, note) == want


def test_units_round_half_up_and_missing():
    assert units.convert(0.5, Decimal(1)) == 1 and units.convert(2.5, Decimal(1)) == 3 and units.convert(0.0, Decimal(7)) == 0
    import pandas as pd

    s = pd.Series
    out = units.to_common(s(["kg"] * 4), s(["Production"] * 4), s([None] * 4), s([1.0, float("nan"), None, -999.0]))
    assert out["common_value"].tolist()[0] == 1 and out["common_value"].isna().tolist() == [False, True, True, True]


def test_versions_against_brute_force(spark):
    r = random.Random(5)
    day = lambda n: DAY + dt.timedelta(n)
    events = [(f"e{i}", r.choice(["a", "b", None]), r.choice([day(r.randrange(40)), None])) for i in range(120)]
    changes = [(r.choice(["a", "b", "z", None]), r.choice([day(r.randrange(40)), None]), r.choice([day(r.randrange(50)), None]), f"v{i:03}") for i in range(150)]
    changes += changes[:10]
    ev = spark.createDataFrame(events, "event_id string, key string, on_day date")
    ch = spark.createDataFrame(changes, "key string, valid date, known date, id string")
    got = versions.as_known(ev, F.col("key"), F.col("on_day"), ch, F.col("key"), [F.col("valid"), F.col("known")], [F.col("valid"), F.col("known"), F.col("id")], F.col("id"))
    want = []
    for e, k, d in events:
        fit = [(v, a, i) for kk, v, a, i in changes if k and d and kk == k and v and a and v <= d and a <= d]
        if fit:
            want.append((e, max(fit)[2]))
    assert rows(got, "event_id", "chosen") == sorted(want)
    none = versions.as_known(ev.limit(0), F.col("key"), F.col("on_day"), ch.limit(0), F.col("key"), [F.col("known")], [F.col("id")], F.col("id"))
    assert none.count() == 0


def test_rolling_against_brute_force_and_corrections(spark):
    r = random.Random(7)
    data = [(r.choice("ab"), DAY + dt.timedelta(r.randrange(0, 90, 3)), float(r.randrange(5))) for _ in range(60)] + [("n", None, 1.0), (None, DAY, 1.0), ("m", DAY, None)]
    frame = spark.createDataFrame(data, "e string, day date, value double")

    def brute(rows_):
        out = {}
        for e in {x[0] for x in rows_ if x[0] and x[1] and x[2] is not None}:
            mine = [(d, v) for k, d, v in rows_ if k == e and d and v is not None]
            first, last = min(d for d, _ in mine), max(d for d, _ in mine)
            for n in range((last - first).days + 1):
                t = first + dt.timedelta(n)
                out[e, t] = tuple(sum(v for d, v in mine if t - dt.timedelta(w) < d <= t) for w in (7, 30))
        return out

    def got(state):
        return {(x["entity_key"], x["day"]): (float(x["total_7"]), float(x["total_30"])) for x in state.collect()}

    state = rolling.rolling_state(rolling.daily_amounts(frame, "e", "day", "value"))
    assert got(state) == brute(data)
    fix = ("a", min(d for e, d, _ in data if e == "a" and d), 2.5)
    change = spark.createDataFrame([fix], "entity_key string, day date, delta double")
    again = rolling.correct_state(state, change)
    assert again.count() <= 30
    assert got(rolling.read_state(state, again)) == brute([*data, fix])


def test_latest_delivery_null_arrival_is_earliest(spark):
    f = spark.createDataFrame([("s", None, 5.0), ("s", DAY, 2.0), ("s", DAY, 2.0), ("t", None, 1.0)], "k string, a date, v double")
    assert rows(rolling.latest_delivery(f, "k", "a", "v"), "k", "v") == [("s", 2.0), ("t", 1.0)]


def test_corrections_beyond_the_state_and_moved_records(spark):
    """First deliveries give version 1; what is delivered again moves amounts, days and the range of days."""
    day = lambda n: dt.date(2022, 1, 1) + dt.timedelta(n)
    rows = [
        ("s1", day(0), "a", day(0), 4.0), ("s2", day(1), "a", day(10), 6.0), ("s3", day(2), "a", day(20), 1.0),
        ("s2", day(9), "a", day(10), 2.0), ("s3", day(30), "a", day(70), 5.0), ("s4", None, "a", day(3), 1.0), ("s4", day(4), "b", day(3), 9.0),
        ("s5", day(1), "c", day(5), 3.0), ("s5", day(2), "c", day(5), None), ("s1", day(0), "a", day(0), 4.0),
    ]
    f = spark.createDataFrame(rows, "k string, arrival date, entity string, day date, value double")
    pairs = rolling.deliveries(f, "k", "arrival", "value", "entity", "day")
    state = rolling.rolling_state(rolling.daily_amounts(pairs.select("first.*"), "entity", "day", "value"), run_out=True)
    out = rolling.counted_days(rolling.read_state(state, rolling.correct_state(state, rolling.changes_of(pairs, "entity", "day", "value"))))
    final = {("a", 0): 4.0, ("a", 10): 2.0, ("a", 70): 5.0, ("b", 3): 9.0}
    want = {}
    for e, first, last in (("a", 0, 70), ("b", 3, 3)):
        for t in range(first, last + 1):
            want[e, t] = tuple(sum(v for (x, u), v in final.items() if x == e and t - w < u <= t) for w in (7, 30))
    got = {(r["entity_key"], (r["day"] - day(0)).days): (float(r["total_7"]), float(r["total_30"])) for r in out.collect()}
    assert got == want
    assert rolling.counted_days(state.limit(0)).count() == 0


def test_store_of_partials_is_rewritten_by_load(spark, tmp_path):
    from tidewatch.operators import late

    D = dt.date
    rows = [("t", "r1", "e", D(2022, 1, 3), D(2022, 1, 5)), ("t", "r2", "e", D(2022, 1, 4), D(2022, 2, 20)), ("t", "r3", "e", D(2022, 1, 4), D(2022, 2, 21)), ("t", "r4", None, D(2022, 1, 4), D(2022, 3, 21))]
    cls = late.classify(spark.createDataFrame(rows, "source_table string, record_id string, entity_key string, event_date date, arrival_date date"))
    store = late.Store(spark, str(tmp_path / "store"))
    store.append(cls, F.date_format("arrival_batch", "yyyy-MM"))
    store.append(cls.where("record_id = 'r1'"), F.date_format("arrival_batch", "yyyy-MM"))  # a repeated load
    combined = {(r["entity_key"], r["period"]): (r["n"], r["n_batches"]) for r in late.combine(store.read()).collect()}
    assert combined == {("e", D(2022, 1, 3)): (2, 2)}
    assert sorted(r["record_id"] for r in late.refused_records(cls, store.read()).collect()) == ["r3", "r4"]


def test_units_round_exactly_near_halves():
    import numpy as np
    import pandas as pd

    from tidewatch.operators import units

    values = [0.5, 1.5, 2.4999999, 0.1, 3.3, 1e15, np.nan, -1.0, np.inf, 12345.6785]
    unit = ["head", "kg", "lb", "1000 head", "t", "t", "kg", "kg", "kg", "g"]
    element = ["Stocks", "Production", "Production", "Stocks", "Production", "Production", "Production", "Production", "Production", "Production"]
    got = units.to_common(pd.Series(unit), pd.Series(element), pd.Series([None] * 10), pd.Series(values))["common_value"].tolist()
    want = []
    for v, u, e in zip(values, unit, element):
        parsed = units.unit_of(u, e, None)
        want.append(units.convert(v, parsed[1]) if np.isfinite(v) and v >= 0 else pd.NA)
    assert [str(x) for x in got] == [str(x) for x in want]
