"""Cases of FINDINGS_r02: each failed before its finding was settled."""

import datetime as dt

import numpy as np
import pytest

from tests.llm.test_advice_llm import _projected, write
from tidewatch.llm import linkage, survivor
from tidewatch.llm import queries as llm

D = dt.date


def _events(spark, *rows):
    schema = "event_id string, disease string, disease_raw string, species string, country_iso3 string, admin1 string, locality string, latitude double, longitude double, reference_date date, cases long, onset_date date, canonical_event_id string"
    return spark.createDataFrame(rows, schema)


def test_open_blocks_are_listed_only_where_an_alert_looks_there(spark):
    """every event was listed up to four times as often, for alerts that lack disease or country."""
    e = _events(spark, ("E1", "HPAI", None, "ducks", "QAA", "Norland", "Brinkhofen", 10.1, 20.1, D(2022, 3, 1), 5, None, None), ("E2", None, None, None, None, None, "Brinkhofen", None, None, D(2022, 3, 2), 5, None, None))
    right = linkage._numbered(linkage._attributes(e, "e_").selectExpr("*", "false e_exact"), "e_n")
    rows = {lacking: linkage.event_blocks(right, set(lacking)).count() for lacking in (((False, False),), ((False, False), (False, True)), ((True, True),))}
    # E1: one cell, two ends of its name, a region; again ends and region for alerts without a country. E2: ends where both are open
    assert rows == {((False, False),): 4, ((False, False), (False, True)): 7, ((True, True),): 6}
    known = ("A1", "HPAI", None, None, "QAA", None, "Brinkhofen", None, None, D(2022, 3, 3), None, None, None)
    lacking = ("A2", None, None, None, None, None, "Brinkhofen", None, None, D(2022, 3, 3), None, None, None)
    for alerts, want in (((known,), {("A1", "E1")}), ((known, lacking), {("A1", "E1"), ("A2", "E1"), ("A2", "E2")})):
        found = linkage.match(_events(spark, *alerts), e)
        assert {(r["a_id"], r["e_id"]) for r in found.collect()} == want


def test_alerts_without_shared_slots_need_no_rounds(monkeypatch):
    """all alerts went through the rounds of the consensus, though most have an exact solution."""
    r = np.random.default_rng(7)
    left = np.repeat(np.arange(40), r.integers(1, 7, 40))
    n, slot = len(left), np.arange(len(left))
    w = np.array([list(linkage.WEIGHTS.values())] * n)
    s, down = np.round(r.random((n, 7)), 2), linkage.PRIOR + r.random(n) * 3
    rounds = linkage.consensus(left, slot, w, s, down)
    monkeypatch.setattr(linkage, "consensus", lambda left, *_: np.zeros(0) if len(left) == 0 else pytest.fail("rounds"))
    got = linkage.optimum(left, slot, w, s, down)
    assert got == pytest.approx(rounds, abs=1e-5) and np.bincount(left, got).max() == pytest.approx(1, abs=1e-9)
    for k in range(12):
        one = left == k
        assert got[one] == pytest.approx(_projected(np.zeros(one.sum(), int), np.arange(one.sum()), w[one], s[one], down[one]), abs=1e-5)


def test_survivors_count_no_votes_that_decide_nothing(spark, tmp_path, monkeypatch):
    """p5_found ran rounds of votes and reliabilities, whose weights had no effect on its rows."""
    event = "event_id string, canonical_event_id string, provenance_id string, source_name string, admin1 string, locality string, latitude double, longitude double, onset_date date, cases long"
    rows = [(f"E{g}{i}", f"CE-{g}", p, name, place, None, None, None, None, None) for g in (1, 2, 3) for i, (p, name, place) in enumerate((("P3", "x", "South"), ("P1", "y", "North"), ("P2", "z", "South"), ("P4", "w", None)))]
    rows += [("E41", "CE-4", None, "x", "East", None, None, None, None, 3), ("E40", "CE-4", None, "y", "West", None, None, None, None, None), ("E5", "CE-5", "P1", "y", "alone", None, None, None, None, None)]
    entry = [("P1", None, D(2022, 1, 1), "Primary Official"), ("P2", None, D(2022, 1, 3), "intelligence"), ("P3", None, D(2022, 1, 2), "intelligence"), ("P4", None, None, "primary_official")]
    d = write(spark, tmp_path, canonical_events=(rows, event), source_provenance=(entry, "provenance_id string, retrieved_at timestamp, published_at date, source_tier string"))
    truths = {(r["canonical_event_id"], r["field"]): r["value"] for r in llm.p5_truth(spark, d).collect()}
    assert {truths[f"CE-{g}", "admin1"] for g in (1, 2, 3)} == {"south"}  # there votes decide, against the best tier
    monkeypatch.setattr(survivor, "truth_discovery", lambda *_, **__: pytest.fail("rounds"))
    got = sorted(map(tuple, llm.p5_found(spark, d).collect()))
    assert got == [("CE-1", "admin1", "E11"), ("CE-2", "admin1", "E21"), ("CE-3", "admin1", "E31"), ("CE-4", "admin1", "E40"), ("CE-4", "cases", "E41")]
