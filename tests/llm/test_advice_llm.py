
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import linkage, pii
from tidewatch.llm import queries as llm

D = dt.date


def write(spark, folder, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_stand_in_group_ids_tie_no_events_and_give_no_survivors(spark, tmp_path):
    event = "event_id string, canonical_event_id string, source_event_id string, provenance_id string, source_name string, admin1 string, locality string, latitude double, longitude double, onset_date date, cases long"
    rest = (None, None, "WAHIS", "North", "Town", 1.0, 2.0, D(2022, 1, 3), 5)
    events = [(i, ce, *rest) for i, ce in (("EM-00000000", "CE-00000000"), ("EM-1", "CE-00000000"), ("EM-2", "ce-00000000 "), ("EM-3", "CE-00000007"), ("EM-4", "CE-00000007"))]
    d = write(
        spark, tmp_path, canonical_events=(events, event), linkage_decisions=([("EM-00000000", "EM-3")], "a string, b string"),
        source_provenance=([("P1", None, None, "none")], "provenance_id string, retrieved_at timestamp, published_at date, source_tier string"),
    )
    assert sorted(map(tuple, llm.p3_found(spark, d).collect())) == [(i, "EM-00000000") for i in ("EM-00000000", "EM-3", "EM-4")]
    assert {r["canonical_event_id"] for r in llm.p5_found(spark, d).collect()} == {"CE-00000007"}


def _projected(left, slot, w, s, down):
    """The optimum by projected gradients, for one left record."""
    n = np.bincount(slot)
    share, step = 1 / n[slot], 1 / (2 * w.sum(axis=1).max() + 2 * down.max() + 8)
    y = np.zeros(len(slot))
    for _ in range(1500):
        low = np.maximum(0, (np.bincount(slot, y) / n)[slot] - y)
        v = y - step * (2 * down * y - 2 * (w * np.maximum(0, s - y[:, None])).sum(axis=1) + 2 * linkage.TRANSITIVE * ((np.bincount(slot, low) / n)[slot] - low))
        a, b = 0.0, 100.0
        for _ in range(50):
            mid = (a + b) / 2
            a, b = (mid, b) if (np.clip(v - mid * share, 0, 1) * share).sum() > 1 else (a, mid)
        y = np.clip(v - b * share, 0, 1)
    return y


def test_linkage_reaches_the_optimum(spark):
    r = np.random.default_rng(4)
    weights, rows, want = list(linkage.WEIGHTS.values()), [], {}
    for k, n in enumerate([1, 3, 5, 30, 2, 4, 6]):
        equal = k < 4
        slot = np.arange(n) if equal else np.unique(r.integers(0, n - 1, n), return_inverse=True)[1]
        s = np.ones((n, 7)) if equal else np.round(r.random((n, 7)), 2)
        down = np.full(n, linkage.PRIOR) if equal else 2 + r.random(n)
        best = _projected(np.zeros(n, int), slot, np.array([weights] * n), s, down)
        for i in range(n):
            rows.append((f"a{k}", f"e{i}", f"s{slot[i]}", [(w, float(x)) for w, x in zip(weights, s[i], strict=True)], float(down[i])))
            want[f"a{k}", f"e{i}"] = best[i]
    f = spark.createDataFrame(rows, "a_id string, e_id string, slot string, up array<struct<w: double, s: double>>, down double")
    got = {(x["a_id"], x["e_id"]): x["confidence"] for x in linkage.infer(f).collect()}
    assert got == pytest.approx(want, abs=1e-5)
    assert got["a3", "e0"] == pytest.approx(1 / 30, abs=1e-5)


def test_linkage_chunks_keep_left_records_whole(monkeypatch):
    part = pd.DataFrame([(a, f"e{i}", f"s{i}", [3.0], [1.0], 2.0) for a in "abc" for i in range(4)], columns=["a_id", "e_id", "slot", "_w", "_s", "down"])
    whole = pd.concat(linkage._solved(iter([part])))
    monkeypatch.setattr(linkage, "CHUNK", 1)
    split = pd.concat(linkage._solved(iter([part[:3], part[3:3], part[3:6], part[6:]])), ignore_index=True)
    assert split.equals(whole) and whole["confidence"].tolist() == pytest.approx([0.25] * 12, abs=1e-5)
    assert list(linkage._solved(iter([]))) == []


@pytest.mark.parametrize(
    "found, name",
    [
        ("Maria Elena Varnolk Nakorre Ruiz", "Maria Elena Varnolk Nakorre Ruiz"), ("Dr Jorik van der Nakorre", "Jorik van der Nakorre"), ("Hadrel de la Varnolk y Ruiz", "Hadrel de la Varnolk y Ruiz"),
        ("Frau Lena von Varnolk", "Lena von Varnolk"), ("Hadrel Nakorre de", "Hadrel Nakorre"), ("Hadrel Nakorre on Monday", "Hadrel Nakorre"), ("hadrel nakorre", "hadrel nakorre"),
    ],
)
def test_names_stay_whole(found, name):
    text = f"Seen: {found}."
    a, b = pii._name(text, 6, 6 + len(found))
    assert text[a:b] == name
