"""Operators of the llm subpackage against brute force, exact round trips and held-out cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import components, encode, leaks, linkage, pii, survivor


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return sorted((x, find(x)) for x in parent)


@pytest.mark.parametrize("blocks", [None, 1, 3])
def test_components(spark, blocks):
    r = random.Random(1)
    edges = [(f"v{r.randrange(300):04}", f"v{r.randrange(300):04}") for _ in range(200)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]  # a chain
    edges += [("hub", f"h{i:03}") for i in range(120)]  # a hot vertex
    edges += [(None, "x"), ("x", None), ("self", "self"), *edges[:20], *[(b, a) for a, b in edges[:20]]]
    frame = spark.createDataFrame(edges, "u string, v string")
    assert sorted(map(tuple, components.connected_components(frame, "u", "v", blocks).collect())) == brute_components(edges)


def test_components_empty(spark):
    assert components.connected_components(spark.createDataFrame([], "u string, v string"), "u", "v").count() == 0


def test_precedence(spark):
    data = [("g", "b", 1, 5, "x", None), ("g", "a", 0, 9, None, "y"), ("g", "c", 1, 5, "z", None), ("one", "d", 0, 1, "x", "y"), ("none", "e", 0, 1, None, None), ("none", "f", 0, 1, None, None)]
    f = spark.createDataFrame(data + data[:2], "grp string, id string, tier int, age int, p string, q string")
    got = survivor.by_precedence(f, "grp", "id", {"p": F.col("p").isNotNull(), "q": F.col("q").isNotNull()}, [F.col("tier"), F.col("age")])
    assert sorted(map(tuple, got.collect())) == [("g", "p", "b"), ("g", "q", "a")]


def test_truth_discovery_learns_the_bad_source(spark):
    data = [(f"g{i}", s, "t" if s != "bad" else "f") for i in range(30) for s in ("s1", "s2", "bad")] + [("tie", "bad", "f"), ("tie", "s1", "t"), ("lone", None, "v"), (None, "s1", "v"), ("gap", "s1", None)]
    f = spark.createDataFrame(data, "grp string, source string, v string")
    truths, weights = survivor.truth_discovery(survivor.claims(f, "grp", "source", {"v": F.col("v")}))
    assert {r["grp"]: r["value"] for r in truths.collect()} == {f"g{i}": "t" for i in range(30)} | {"tie": "t", "lone": "v"}
    w = {r["source"]: r["weight"] for r in weights.collect()}
    assert w["s1"] > w["bad"]


def test_encoding_equals_the_public_tokenizer_and_round_trips(spark):
    from tokenizers import Tokenizer

    path = f"{encode.FOLDER}/byte_bpe_50k.json"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    texts = ["Grippe aviaire à Trüb\xa0x", "<|endoftext|>", " \n\n  a", "\x00\x01", "👨‍👩‍👧 I'LL don't", "é" * 400, "a" * 20_000, "监测 温度：12", "̈x", None, ""]
    f = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r[0]: r[1] for r in f.select("doc_id", encode.token_ids(F.col("text")).alias("ids")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (tokenizer.encode(t, add_special_tokens=False).ids if t else [])
        assert encode.decode_ids(got[i], f"{encode.FOLDER}/{encode.VOCABULARY}") == (t or "")


WORDS = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]


def leak_case():
    r = random.Random(2)
    items = [(i, " ".join(r.sample(WORDS, 20))) for i in range(4)] + [(8, "too short here"), (9, None)]
    items.append((7, items[0][1].upper()))
    take = lambda i, a, n: " ".join(items[i][1].split()[a : a + n])
    docs = [
        (1, "Before. " + take(0, 3, 12).replace(" ", ",  ").title() + " after."), (2, take(1, 0, 11) + " changed"), (3, "wor​d " + take(2, 5, 12).replace("o", "о")),
        (4, None), (5, ""), (6, take(3, 0, 20) + " x " + take(3, 0, 20)), (10, "nothing at all " * 2000),
    ]
    return docs, items, {(1, 0), (1, 7), (3, 2), (6, 3)}


@pytest.mark.parametrize("limit", [leaks.BROADCAST_WORDS, 0])
def test_leaks(spark, limit, monkeypatch):
    monkeypatch.setattr(leaks, "BROADCAST_WORDS", limit)
    docs, items, want = leak_case()
    d = spark.createDataFrame(docs, "doc_id int, text string")
    i = spark.createDataFrame(items, "item_id int, text string")
    assert {tuple(r) for r in leaks.find_leaks(d, i, "doc_id", "item_id").collect()} == want


def test_leaks_removed(spark):
    docs, items, _ = leak_case()
    d = spark.createDataFrame(docs, "doc_id int, text string")
    i = spark.createDataFrame(items, "item_id int, text string")
    out = {r["doc_id"]: (r["n_spans"], r["clean_text"]) for r in leaks.remove_leaks(d, i, "doc_id", "item_id").collect()}
    assert out[1] == (1, "Before.  after.") and out[6][0] == 2 and set(out) == {1, 3, 6}
    assert leaks.find_leaks(d.limit(0), i, "doc_id", "item_id").count() == 0 and leaks.find_leaks(d, i.limit(0), "doc_id", "item_id").count() == 0


_A = "event_id string, disease string, disease_raw string, species string, country_iso3 string, admin1 string, locality string, latitude double, longitude double, reference_date date, cases long"


def test_linkage(spark):
    D = dt.date(2022, 3, 1)
    alerts = [
        ("A1", "HPAI", "bird flu", "ducks", "QAA", "Norland", "Brinkhof", 10.0, 20.0, D, 5), ("A1", "HPAI", "bird flu", "ducks", "QAA", "Norland", "Brinkhof", 10.0, 20.0, D, 5),
        ("A2", None, None, None, "QAA", None, "near Brinkhoff", None, None, D, None), ("A3", "FMD", None, "pigs", "QAA", "Norland", "Brinkhof", 10.0, 20.0, D, 5),
        ("A4", "HPAI", None, "ducks", "QAA", "Norland", "Brinkhof", 10.0, 20.0, dt.date(2022, 6, 1), 5), ("A5", "HPAI", None, "ducks", None, None, None, 20.0, 10.0, D, 5),
        ("A6", None, None, None, None, None, None, None, None, None, None),
    ]
    events = [("E1", "HPAI", "HPAI", "ducks", "QAA", "Norland", "Brinkhof", 10.01, 20.01, D, 5, D, None), ("E2", "HPAI", "HPAI", "ducks", "QAA", "Sudland", "Farmouth", 15.0, 20.0, D, 70, D, "-")]
    a = spark.createDataFrame(alerts, _A)
    e = spark.createDataFrame(events, _A + ", onset_date date, canonical_event_id string")
    found = linkage.match(a, e).where(F.col("confidence") >= linkage.THRESHOLD)
    assert {tuple(r) for r in found.select("a_id", "e_id").collect()} == {("A1", "E1"), ("A2", "E1"), ("A5", "E1")}
    assert linkage.match(a.limit(0), e).count() == 0


CASES = [
    ("The list is kept. Write to jorik.varnolk@mail.example.org for the full list.", "email", "jorik.varnolk@mail.example.org"),
    ("Snow fell. The keeper can be reached on +44 7700 900727. It was cold.", "phone", "+44 7700 900727"),
    ("National ID QQ220988C was checked. Nothing else.", "id_number", "QQ220988C"),
    ("He lives at Flat 7, 156 Lime Kiln Lane with two dogs.", "street_address", "Flat 7, 156 Lime Kiln Lane"),
    ("The sample was sent. Reported by Dr Hadrel Nakorre on site.", "name", "Hadrel Nakorre"),
]


def test_personal_information(spark):
    long = "The cooperative suspended its weekly market. " * 400
    texts = [(i, t) for i, (t, _, _) in enumerate(CASES)] + [(10, None), (11, ""), (12, long + CASES[1][0] + " " + long), (13, "Tag range 555-4715 to 555-290 was read twice. Accession EPI-4142-358-53107 was logged.")]
    f = spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(r) for r in pii.find(f).collect()}
    want = {(i, k, p) for i, (_, k, p) in enumerate(CASES)} | {(12, CASES[1][1], CASES[1][2])}
    assert got == want
    red = {r["doc_id"]: r["text"] for r in pii.redact(f).collect()}
    assert red[0] == "The list is kept. Write to [EMAIL] for the full list." and red[10] is None and red[11] == ""
    assert red[13] == texts[-1][1]


def test_windows_agree_with_one_pass():
    text = "Lead in text. " * 30 + CASES[0][0] + " More text follows. " * 40 + CASES[4][0]
    spans = {(text[a:b], k) for a, b, k in pii.spans_of([text])[0]}
    assert spans == {(CASES[0][2], "email"), (CASES[4][2], "name")}
