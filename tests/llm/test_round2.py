"""Grouping on a real grid, survivors with the prior, leak removal beyond the broadcast size."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_llm import brute_components, leak_case
from tidewatch.llm import components, leaks, survivor


def test_components_exchange_on_a_grid(spark):
    """The default grid has several cells, and long chains with hubs need several rounds."""
    r = random.Random(5)
    edges = [(f"c{i:04}", f"c{i + 1:04}") for i in range(400)] + [("hub", f"h{i:03}") for i in range(300)] + [(f"v{r.randrange(400):03}", f"v{r.randrange(400):03}") for _ in range(260)]
    r.shuffle(edges)
    got = components.connected_components(spark.createDataFrame(edges, "u string, v string"), "u", "v")
    assert sorted(map(tuple, got.collect())) == brute_components(edges)


def test_truth_discovery_with_the_prior_keeps_the_order(spark):
    r = random.Random(3)
    rows = [(f"g{r.randrange(40)}", f"e{i:03}", r.choice("xyz"), r.randrange(3), r.randrange(4), r.choice(["a", "b", None])) for i in range(300)]
    rows += rows[:20] + [("alone", "e999", "x", 0, 0, "a"), ("none", "n1", "x", 0, 0, None), ("none", "n2", "x", 0, 0, None), (None, "n3", "x", 0, 0, "a"), ("nosource", "m1", None, 2, 1, "q"), ("nosource", "m2", None, 1, 1, "p")]
    f = spark.createDataFrame(rows, "grp string, id string, source string, tier int, age int, v string")
    claimed = survivor.claims(f, "grp", "source", {"v": F.col("v")}, "id", F.struct("tier", "age"))
    truths, weights = survivor.truth_discovery(claimed, use_prior=True)
    got = sorted((t["grp"], t["record"]) for t in truths.collect())
    plain = survivor.by_precedence(f, "grp", "id", {"v": F.col("v").isNotNull()}, [F.col("tier"), F.col("age")])
    assert got == sorted((t["grp"], t["id"]) for t in plain.collect()) and len(got) > 30
    assert {w["source"] for w in weights.collect()} == {"x", "y", "z", ""}
    assert survivor.truth_discovery(claimed.limit(0), use_prior=True)[0].count() == 0


def test_more_sources_than_travel_as_a_literal(spark, monkeypatch):
    monkeypatch.setattr(survivor, "MAX_SOURCES", 1)
    f = spark.createDataFrame([(f"g{i}", s, "t" if s != "bad" else "f") for i in range(9) for s in ("s1", "s2", "bad")], "grp string, source string, v string")
    truths, _ = survivor.truth_discovery(survivor.claims(f, "grp", "source", {"v": F.col("v")}))
    assert {t["value"] for t in truths.collect()} == {"t"}


@pytest.mark.parametrize("limit", [leaks.BROADCAST_WORDS, 0])
def test_leaks_are_removed_at_every_size_of_the_items(spark, limit, monkeypatch):
    monkeypatch.setattr(leaks, "BROADCAST_WORDS", limit)
    docs, items, want = leak_case()
    marked = " ".join(items[1][1].split()[2:15]).replace("o", "ó᷄")
    docs = [*docs, (20, f"Vorher {marked} nachher"), (21, "x " + " ".join(items[0][1].split()[0:12]) + " y")]
    d, i = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    found = {tuple(r) for r in leaks.find_leaks(d, i, "doc_id", "item_id").collect()}
    assert found == want | {(20, 1), (21, 0), (21, 7)}
    out = {r["doc_id"]: (r["n_spans"], r["clean_text"]) for r in leaks.remove_leaks(d, i, "doc_id", "item_id").collect()}
    assert set(out) == {x for x, _ in found}
    assert out[1] == (1, "Before.  after.") and out[6][0] == 2 and out[20] == (1, "Vorher  nachher") and out[21] == (1, "x  y")
    assert leaks.remove_leaks(d.limit(0), i, "doc_id", "item_id").count() == 0 and leaks.remove_leaks(d, i.limit(0), "doc_id", "item_id").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("caféΣςİı ﬁ½①́᷄​­가힣Åк")), max_size=60))
def test_one_tokeniser(text):
    placed = leaks.words_with_places(text)
    assert [w for w, _, _ in placed] == leaks.words_of(text)
    for word, a, b in placed:
        assert 0 <= a < b <= len(text) and leaks.words_of(text[a:b])
        assert b == len(text) or not unicodedata.combining(text[b]) or unicodedata.normalize("NFKD", text[b - 1]) != ""
