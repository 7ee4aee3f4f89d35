"""New core operators against plain Python: resolution, vintages, families, delays, models, sources, hindsight."""

import datetime as dt
import math
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import labels
from tidewatch.functions import settings as S
from tidewatch.operators import decide, delay, distributions, families, geo, independence, models, pit, resolve, vintage
from tidewatch.sources import adapters, files
from tidewatch.streaming import weekly

D = dt.date


def test_families_partition_the_sixty():
    assert len(S.MODEL_FEATURES) == len(set(S.MODEL_FEATURES)) == 60
    assert [len(v) for v in S.FAMILIES.values()] == [12, 6, 6, 7, 4, 20, 5]


def _triangle(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        w = D(2020, 1, 6) + dt.timedelta(7 * r.randrange(120))
        rows.append((f"C{r.randrange(3)}|X", f"C{r.randrange(3)}", "X", w, w + dt.timedelta(7 * r.randrange(12)), r.randrange(4)))
    rows = [(e, e[:2], x, w, a, c) for e, _, x, w, a, c in rows]
    return rows, spark.createDataFrame(rows, "entity_key string, country string, disease string, week date, available_week date, count long")


def test_vintages_equal_a_plain_fold_and_know_no_hindsight(spark):
    rows, tri = _triangle(spark)
    grid = pit.grid(spark, "2021-01-04", "2022-05-02", 91).select(F.col("as_of").cast("date").alias("as_of"))
    got = {(r["entity_key"], r["as_of"]): r["s"] for r in vintage.visible(tri, grid).frame.collect()}
    first, last = min(r[3] for r in rows), max(r[3] for r in rows)
    for (e, day), s in got.items():
        now = min(day - dt.timedelta(day.weekday()), last)
        want = [sum(c for k, _, _, w, a, c in rows if k == e and a <= day and w == first + dt.timedelta(7 * i)) for i in range((now - first).days // 7 + 1)]
        assert s == want
    later = spark.createDataFrame([("C0|X", "C0", "X", D(2020, 3, 2), D(2022, 6, 6), 99), ("NEW|X", "NEW", "X", D(2020, 3, 2), D(2022, 6, 6), 5)], tri.schema)
    again = {(r["entity_key"], r["as_of"]): r["s"] for r in vintage.visible(tri.unionByName(later), grid).frame.collect()}
    assert again == got
    assert vintage.visible(tri.limit(0), grid).frame.count() == 0


def test_decisions_know_no_hindsight(spark):
    """Rows known after the as-of date change nothing that is stamped with it."""
    rows, tri = _triangle(spark, 300, 2)
    events = tri.select("entity_key", "country", "disease", F.col("week").alias("reference_date"), F.col("available_week").alias("available_from"))
    grid = spark.createDataFrame([(D(2021, 6, 7),)], "as_of date")
    none = spark.createDataFrame([], "entity_key string, as_of date, intel double")
    run = lambda t, e: sorted(map(str, decide.scores(vintage.visible(t, grid), e, none).collect()))
    base = run(tri, events)
    late = spark.createDataFrame([("C1|X", "C1", "X", D(2021, 5, 3), D(2021, 6, 14), 50)], tri.schema)
    more = late.select("entity_key", "country", "disease", F.col("week").alias("reference_date"), F.col("available_week").alias("available_from"))
    # the new row must not be older than the cut of the delays' table, or it would be known to them
    assert base and run(tri.unionByName(late), events.unionByName(more)) == base


def _sequential(rows, cited, best):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in cited:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    sources = {}
    for i, s, *_ in rows:
        sources.setdefault(find(i), set()).add(s)
    for i, s, e, day, *_ in sorted(rows, key=lambda r: (r[2].split("|")[1], r[2].split("|")[0], r[3], r[0])):
        if i in best:
            a, b = find(i), find(best[i])
            if a != b and not sources[a] & sources[b]:
                low, high = min(a, b), max(a, b)
                parent[high] = low
                sources[low] |= sources.pop(high)
    return {i: find(i) for i in parent}


def test_resolution_equals_a_sequential_merge(spark):
    r = random.Random(4)
    rows = [(f"e{i:03}", r.choice(["A", "B", "C"]), f"{r.choice(['QAA', 'QAB'])}|X", D(2022, 1, 1) + dt.timedelta(r.randrange(25)), r.choice(["n", "s", None]), r.choice([None, 10 + r.random() * 0.15]), None, f"e{r.randrange(400):03}" if r.random() < 0.2 else None) for i in range(220)]
    rows = [(*x[:6], None if x[5] is None else 20 + r.random() * 0.15, x[7]) for x in rows]
    f = spark.createDataFrame(rows, "event_id string, source_name string, entity_key string, reference_date date, admin1 string, lat double, lon double, cited string").withColumn("country", F.substring_index("entity_key", "|", 1)).withColumn("disease", F.substring_index("entity_key", "|", -1))
    best = {x["i"]: x["j"] for x in resolve.best_matches(f).collect()}
    ids = {x[0] for x in rows}
    cited = [(x[0], x[7]) for x in rows if x[7] in ids and x[7] != x[0]]
    members, decisions = resolve.resolve(f)
    assert {m["event_id"]: m["cluster"] for m in members.collect()} == _sequential(rows, cited, best)
    named = {m["cluster"]: m["canonical_event_id"] for m in members.collect()}
    assert [named[k] for k in sorted(named)] == [f"CE-{i:07d}" for i in range(1, len(named) + 1)]
    assert {d["rule"] for d in decisions.collect()} == {"explicit_reference", "temporal_spatial_best_match"}


def test_interval_candidates_equal_brute_force_near_edges_and_poles(spark):
    r = random.Random(6)
    spots = [(89.95, 10.0), (89.97, -170.0), (-0.02, 179.98), (0.03, -179.97), (60.0, 0.0), (60.05, 0.1), (10.0, 20.0)]
    rows = [(f"e{i:03}", r.choice("AB"), "Q|X", D(2022, 1, 1) + dt.timedelta(r.randrange(6)), r.choice(["n", None]), *((lambda s: (max(-90.0, min(90.0, s[0] + r.uniform(-0.06, 0.06))), (s[1] + r.uniform(-0.06, 0.06) + 180) % 360 - 180))(r.choice(spots)) if r.random() < 0.85 else (None, None))) for i in range(160)]
    f = spark.createDataFrame(rows, "event_id string, source_name string, entity_key string, reference_date date, admin1 string, lat double, lon double")
    got = {(x["i"], x["j"]) for x in geo.interval_candidates(f).collect()}

    def km(a, b):
        p, q = math.radians(a[5]), math.radians(b[5])
        h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(a[6] - b[6]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    want = set()
    for a in rows:
        for b in rows:
            gap = (a[3] - b[3]).days
            if a[1] != b[1] and 0 <= gap <= 3 and (gap > 0 or b[0] < a[0]):
                both = a[5] is not None and b[5] is not None
                if km(a, b) <= 10 if both else a[4] is not None and a[4] == b[4]:
                    want.add((a[0], b[0]))
    assert got == want and len(want) > 100


def test_effective_sources(spark):
    rows = [("k", "WAHIS", 0.9), ("k", "empres-I", 0.8), ("k", "ERA5", 0.5), ("k", "GLW4", 0.4), ("k", "Other", None), ("k", "GDELT", 0.3), ("k", "GDELT", 0.2), ("z", "GDELT", 0.0), ("n", None, 1.0)]
    got = {r["k"]: r["n_eff"] for r in independence.effective_sources(spark.createDataFrame(rows, "k string, source_name string, reliability double"), ["k"]).collect()}
    names, w = ["official", "official", "environmental", "exposure", "unknown", "media"], np.array([0.9, 0.8, 0.5, 0.4, 0.5, 0.3])
    rho = lambda a, b: 0.95 if a == b else 0.10 if {a, b} == {"environmental", "exposure"} else 0.05
    m = np.array([[1.0 if i == j else rho(names[i], names[j]) for j in range(6)] for i in range(6)])
    assert got["k"] == pytest.approx(w.sum() ** 2 / (w @ m @ w)) and got["z"] == 0.0 and "n" not in got


def test_hysteresis(spark):
    p = [0.1, 0.41, 0.37, 0.34, 0.2, 0.16, 0.14, 0.7, 0.61, 0.59, None]
    f = spark.createDataFrame([("k", i, x) for i, x in enumerate(p)], "k string, t int, p double")
    got = [r["level"] for r in decide.hysteresis(f, "k", "t", "p").orderBy("t").collect()]
    assert got == ["INFO", "ALERT", "ALERT", "WATCH", "WATCH", "WATCH", "INFO", "CRITICAL", "CRITICAL", "ALERT"]
    slow = [r["level"] for r in decide.hysteresis(f, "k", "t", "p", 2).orderBy("t").collect()]
    assert slow[:3] == ["NONE", "NONE", "NONE"] or slow[0] == "NONE"


def test_prefix_sums_and_ranks(spark):
    r = random.Random(1)
    rows = [(f"k{i:03}", r.choice([0.1, 0.5, float("nan"), None, -2.0])) for i in range(300)]
    got = {x["k"]: x["rank"] for x in decide.ranks(spark.createDataFrame(rows, "k string, v double"), "v", "k", "rank").collect()}
    low = lambda v: -math.inf if v is None or v != v else v
    assert got == {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda x: (low(x[1]), x[0])))}


def test_delay_fit_corrects_truncation():
    """Truncated at the as-of date, the naive median is too short; the fit recovers the truth."""
    rng = np.random.default_rng(3)
    waited, t = np.round(rng.lognormal(2.7, 0.6, 6000)), rng.integers(1, 60, 6000)
    seen = waited <= t
    rows = pd.DataFrame({"delay": waited[seen].astype(int), "truncation": t[seen], "n": 1, "disease": "X", "tier": "high"})
    fit = delay._fit(rows, "g", None)
    assert abs(math.exp(fit["p1"]) - math.exp(2.7)) < 1.5 if fit["family"] == "lognormal" else abs(fit["p1"] - math.exp(2.7 + 0.18)) < 2.5
    assert np.median(waited[seen]) < math.exp(2.7) - 1.5
    assert delay._fit(rows.head(3), "few", fit)["weight"] == 0.0


def test_distributions():
    x = np.array([0.3, 1.0, 2.5, 7.9, 8.1, 150.0])
    assert distributions.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-9)
    assert distributions.normal_cdf(np.array([-1.96, 0.0, 1.0])) == pytest.approx([0.0249979, 0.5, 0.8413447], abs=1e-6)
    table = distributions.nb_cdf_table(4.0, 0.5, 300)
    assert table[-1] == pytest.approx(1.0) and np.diff(np.r_[0, table])[:5] == pytest.approx(np.exp(distributions.nb_log_pmf(np.arange(5.0), np.full(5, 4.0), 0.5)))
    draws = np.array([1.0, 4.0, 9.0])
    assert distributions.crps_of_draws(draws, 3.0) == pytest.approx(np.abs(draws - 3).mean() - 0.5 * np.abs(draws[:, None] - draws).mean())
    at, value = distributions.minimise(lambda p: (p[0] - 3) ** 2 + 2 * (p[1] + 1) ** 2, (0.5, 0.5))
    assert at == pytest.approx([3, -1], abs=1e-3) and value < 1e-5
    assert delay.local_level(np.array([1.0]), np.array([0.1])).tolist() == [1.0]
    smooth = delay.local_level(np.array([0.0, 0.0, 3.0, 0.0, 0.0]), np.full(5, 1.0))
    assert smooth.max() < 1.5 and smooth[2] == smooth.max()


def test_count_regression_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = rng.poisson(np.exp(0.5 + 0.6 * x[:, 0] - 0.3 * x[:, 1]))
    f = spark.createDataFrame([(float(a), float(b), 1.0, float(t)) for (a, b), t in zip(x, y)], "a double, b double, same double, y double")
    glm = models.CountGLM(["a", "b", "same"], ridge=2.0).fit(f, "y")
    z = np.column_stack([np.ones(400), (x - x.mean(0)) / x.std(0)])
    beta, penalty = np.array([np.log(y.mean()), 0, 0]), np.diag([0, 2.0, 2.0])
    for _ in range(50):
        mu = np.exp(z @ beta)
        beta = np.linalg.solve(z.T @ (z * mu[:, None]) + penalty, (z * mu[:, None]).T @ (z @ beta + (y - mu) / mu))
    assert glm.kept == ["a", "b"] and glm.beta == pytest.approx(beta, abs=1e-6) and glm.alpha < 0.1


def test_exposure_against_plain_python(spark):
    rows = [("QAA", "chickens", D(2020, 1, 6), D(2021, 1, 1), 10.0), ("QAB", "chickens", D(2020, 1, 6), D(2021, 1, 1), 10.0), ("QAC", "chickens", D(2020, 1, 6), D(2021, 1, 1), 50.0), ("QAA", "chickens", D(2021, 1, 4), D(2022, 1, 1), 20.0), ("QAA", "cattle", D(2020, 1, 6), D(2021, 1, 1), 7.0), (None, "pigs", D(2020, 1, 6), D(2021, 1, 1), 7.0)]
    f = spark.createDataFrame(rows, "country string, species string, week date, available_from date, value double")
    got = {(r["entity_key"], r["week"], r["feature"]): r["value"] for r in families.exposure(f, f).collect()}
    assert got["QAA|HPAI", D(2020, 1, 6), "exp_host_density_rank"] == pytest.approx(0.5) and got["QAC|HPAI", D(2020, 1, 6), "exp_host_density_rank"] == pytest.approx(1.0)
    assert got["QAA|HPAI", D(2021, 1, 4), "exp_stock_trend"] == pytest.approx(math.log(21) - math.log(11)) and got["QAA|HPAI", D(2020, 1, 6), "exp_stock_trend"] == 0.0
    assert {k[0] for k in got} == {"QAA|HPAI", "QAB|HPAI", "QAC|HPAI"}


def test_labels(spark):
    texts = ["HPAI", " asf ", "Low pathogenicity avian influenza", "Classical swine fever", "Influenza A viruses of high pathogenicity", "Peste porcine africaine", "avian influenza and african swine fever", "unknown", None]
    f = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in f.select(labels.disease_of(F.col("t"))).collect()] == ["HPAI", "ASF", None, None, "HPAI", "ASF", None, None, None]
    assert spark.createDataFrame([("ﬁèvre  Ａ-x",)], "t string").select(labels.fold_all(F.col("t"))).first()[0] == "fievre a x"


def test_sources_and_pages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>ID</t></si><si><t>Label</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="s"><v>2</v></c></row><row><c r="A3"><v>8</v></c></row></sheetData></worksheet>')
    assert sorted(map(tuple, files.read_excel(spark, str(tmp_path), ["id", "label", "none"]).collect())) == [("7", "x", None), ("8", None, None)]
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "no.csv"))

    def get(q):
        return {"items": [{"id": f"{q['kind']}{q.get('page', 0)}"}, {"id": "both", "of": q["kind"]}], "totalPages": 2}

    found = adapters.last_by_id(adapters.paged(spark, get, [{"kind": "a"}, {"kind": "b"}], "items", total="totalPages"))
    assert {r["id"] for r in found.collect()} == {"a1", "a2", "b1", "b2", "both"} and '"b"' in found.where("id = 'both'").first()["item"]
    assert list(adapters.pages(lambda q: {"items": [1], "next": None if q.get("next") else "n"}, {}, "items", cursor="next")) == [1, 1]
    assert adapters.rename_plan([" Published", "UID", "x"]) == {"first_seen_date": " Published", "item_id": "UID"}
    cache, read = str(tmp_path / "cache"), lambda p: spark.read.parquet(p)
    with pytest.raises(adapters.SourceUnavailable):
        adapters.cached_or_fetched(cache, read, lambda: 1 / 0, files.write_parquet)
    assert adapters.cached_or_fetched(cache, read, lambda: spark.range(3), files.write_parquet).count() == 3
    assert adapters.cached_or_fetched(cache, read, lambda: 1 / 0, files.write_parquet, refresh=True).count() == 3
    assert adapters.setting({"a": {"b": 1}}, "a.b") == 1 and adapters.setting({}, "a.b", 5, {"TIDEWATCH_A_B": "9"}) == "9"


def test_streams_refuse_nothing_in_one_run_and_resume(spark, tmp_path):
    rows = [("x", dt.datetime(2024, 1, 3)), ("x", dt.datetime(2024, 1, 9)), ("y", dt.datetime(2024, 3, 1)), ("x", dt.datetime(2024, 1, 4))]
    spark.createDataFrame(rows, "event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    out = weekly.run_available(spark, str(tmp_path / "events.parquet"), lambda f: f, weekly.weekly_counts, "ts", str(tmp_path / "run"))
    assert sorted(map(tuple, out.collect())) == [("x", D(2024, 1, 1), 2), ("x", D(2024, 1, 8), 1), ("y", D(2024, 2, 26), 1)]


def test_targets_and_splits_keep_time_apart(spark):
    """Labels look ahead of their as-of date only; a split never mixes dates; truth columns stay out of the features."""
    rows, tri = _triangle(spark, 300, 9)
    grid = pit.grid(spark, "2021-01-04", "2022-01-03", 28).select(F.col("as_of").cast("date").alias("as_of"))
    found = decide.labels(tri, vintage.visible(tri, grid), "2022-12-31").collect()
    for r in found:
        ahead = sum(c for k, _, _, _, a, c in rows if k == r["entity_key"] and r["as_of"] < a <= r["as_of"] + dt.timedelta(28))
        assert r["future_published"] == ahead and r["label"] == int(ahead >= r["label_threshold"])
    assert not {"label", "future_published", "target_reported_final"} & set(S.MODEL_FEATURES)
