
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.missing import group_value, id_value
from tidewatch.plans import asof, core

D = dt.date


def write(spark, folder, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_group_ids_of_zeros_are_missing(spark):
    ids = ["CE-00000000", " ce-00000000 ", "0", "CE-00000010", "ce-00AB", "CE-XXXXXXXX", "-", None]
    f = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").orderBy("i")
    assert [r[0] for r in f.select(group_value(F.col("x"))).collect()] == [None, None, None, "CE-00000010", "CE-00AB", None, None, None]
    assert f.select(id_value(F.lit("EM-00000000"))).first()[0] == "EM-00000000"


def test_rolling_covers_every_signal(spark, tmp_path):
    data = [
        ("1", " news_article_count", 4.0, D(2022, 1, 3)), ("2", "News_Article_Count", 2.0, D(2022, 1, 5)), ("3", "beacon_signal_strength", -0.25, D(2022, 1, 3)),
        ("4", "beacon_signal_strength", -999.0, D(2022, 1, 4)), ("5", "healthmap_alert_count", 7.0, D(2022, 1, 4)), ("6", "healthmap_alert_count", -0.5, D(2022, 1, 9)), ("7", "n/a", 1.0, D(2022, 1, 9)),
    ]
    rows = [(f"S{i}", n, v, "qaa", "hpai", day, day) for i, n, v, day in data]
    d = write(spark, tmp_path, signal_records=(rows, "signal_id string, signal_name string, value double, country_iso3 string, disease string, reference_date date, available_from date"))
    got = {(r["entity_key"], r["day"].day): (r["total_7"], r["total_30"]) for r in core.p7_rolling(spark, d).collect()}
    news, strength, alerts = (f"QAA|HPAI|{n}" for n in ("news_article_count", "beacon_signal_strength", "healthmap_alert_count"))
    assert got == {(news, 3): (4.0, 4.0), (news, 4): (4.0, 4.0), (news, 5): (6.0, 6.0), (strength, 3): (-0.25, -0.25), (alerts, 4): (7.0, 7.0)}
    assert {r["entity_key"] for r in core.p7_found(spark, d).collect()} == {"QAA|HPAI"}


def test_store_reads_take_every_feature(spark, tmp_path):
    names = ["news_article_count", "beacon_signal_strength", "healthmap_alert_count", "one_more"]
    day, known = D(2024, 11, 25), D(2024, 11, 28)
    rows = [(f"S{i}", n, float(i), None, f"q{i}", "hpai", "src", 1.0, day, known) for i, n in enumerate(names)]
    d = write(spark, tmp_path, signal_records=(rows, "signal_id string, signal_name string, value double, denominator double, country_iso3 string, disease string, source_name string, reliability double, reference_date date, available_from date"))
    assert {r["feature"] for r in asof.store_asof_long(spark, d).collect()} == set(names)
    panel = {r["entity_key"]: r.asDict() for r in asof.store_panel(spark, d).collect()}
    assert {k: r[n] for (k, r), n in zip(sorted(panel.items()), names, strict=True)} == {f"Q{i}|HPAI": float(i) for i in range(4)}
    assert panel["Q3|HPAI"]["one_more_staleness_weeks"] == 1 and panel["Q3|HPAI"]["one_more_lag1"] == 3.0
    empty = write(spark, tmp_path / "empty", signal_records=(spark.read.parquet(f"{d}/signal_records.parquet").limit(0).collect(), spark.read.parquet(f"{d}/signal_records.parquet").schema))
    assert asof.store_panel(spark, empty).count() == 0


def test_lead_time_by_episode_with_its_report(spark, tmp_path):
    day = lambda n: D(2022, 1, 3) + dt.timedelta(n)  # noqa: E731, a Monday and the days after it
    found = [("a", 1, day(30)), ("a", 2, day(200)), ("b", 1, day(10)), ("c", 1, day(10)), ("d", 1, day(7))]
    scores = [("a", day(7), 0.1), ("a", day(14), 0.4), ("a", day(21), 0.9), ("b", day(7), 0.39), ("b", day(14), 0.9), ("d", day(7), 0.9), ("d", day(0), 0.5)]
    out = asof.with_lead_time(spark.createDataFrame(found, "entity_key string, episode int, first_date date"), spark.createDataFrame(scores, "entity_key string, as_of date, p double"))
    rows = {(r["entity_key"], r["episode"]): r for r in out.collect()}
    assert {k: (r["first_alert"], r["lead_days"], r["detected"]) for k, r in rows.items()} == {
        ("a", 1): (day(14), 16, True), ("a", 2): (day(14), 186, True), ("b", 1): (None, None, False), ("c", 1): (None, None, False), ("d", 1): (day(0), 7, True)
    }
    leads = [7, 16, 186]
    for r in rows.values():
        assert (r["n_episodes"], r["n_detected"], r["detection_rate"]) == (5, 3, pytest.approx(0.6))
        assert [r["lead_days_p25"], r["lead_days_median"], r["lead_days_p75"]] == pytest.approx(list(np.quantile(leads, [0.25, 0.5, 0.75])))
        assert r["lead_days_mean"] == pytest.approx(np.mean(leads))


def test_lead_time_scores_are_those_of_a_single_date(spark):
    ev = asof.T.events(spark, "/root/testdata/sf0.001")
    weekly = asof.weekly_scores(ev).where(F.col("as_of") == F.lit(asof.AS_OF).cast("date"))
    got = {r["entity_key"]: round(r["p"], 9) for r in weekly.collect()}
    day = F.lit(asof.AS_OF).cast("date")
    seen = ev.where((F.col("available_from") <= day) & (F.col("reference_date") > F.date_sub(day, 182)) & (F.col("reference_date") <= day))
    want = {r["entity_key"]: round(1 - math.exp(-r["n"] / 3), 9) for r in seen.groupBy("entity_key").agg(F.sum("outbreaks").alias("n")).collect()}
    assert got == want and want
