"""Models over the design matrix: early-warning classifier with calibration and explanations, count regression.

Fitting runs in Spark over all rows; what reaches the driver are parameters, one row of medians or quantiles per feature,
and sums of a design's squared width. Splits are chronological; calibration sees its own split only.

Defined cases: nulls, NaN and infinities in features are 0; a split with one class (or none) leaves probabilities as they
are; a constant design column is dropped; no rows at all raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import settings as S
from tidewatch.operators import distributions as D

SEED = 20250915
#: Features of the official record alone.
OFFICIAL_ONLY = S.FAMILIES["temporal"] + S.FAMILIES["baseline"]


def finite(x: str) -> Column:
    v = F.col(x).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.least(F.lit(1 - edge), F.greatest(F.lit(edge), p))
    return F.log(q / (1 - q))


@dataclass
class EarlyWarning:
    """P(officially visible activity within the label's horizon). ``kind``: gbt, or logistic on standardised features.
    ``calibration``: isotonic, platt or none."""

    features: Sequence[str] = S.MODEL_FEATURES
    kind: str = "gbt"
    calibration: str = "isotonic"
    rounds: int = 300
    model: object = None
    scaler: object = None
    calibrator: object = None
    medians: dict = field(default_factory=dict)

    def _vectors(self, frame: DataFrame, values: Column | None = None) -> DataFrame:
        values = F.array(*(finite(f) for f in self.features)) if values is None else values
        out = frame.withColumn("_a", values).withColumn("_v", array_to_vector("_a"))
        return self.scaler.transform(out) if self.scaler is not None else out

    def fit(self, panel: DataFrame) -> EarlyWarning:
        """``panel``: the features, label (0 or 1) and split (train, calibration, test)."""
        train, rest = panel.where("split = 'train'"), panel.where("split = 'calibration'")
        row = train.agg(F.count("*").alias("n"), *(F.median(finite(f)).alias(f) for f in self.features)).first()
        if not row["n"]:
            raise ValueError("no training rows")
        self.medians = {f: float(row[f]) for f in self.features}
        data = self._vectors(train)
        if self.kind == "logistic":
            self.scaler = StandardScaler(inputCol="_v", outputCol="_x", withMean=True).fit(data)
            self.model = LogisticRegression(featuresCol="_x", labelCol="label", regParam=0.5 / max(row["n"], 1) * 2, maxIter=200).fit(self.scaler.transform(data))
        else:
            self.model = GBTClassifier(featuresCol="_v", labelCol="label", maxIter=self.rounds, maxDepth=3, stepSize=0.05, minInstancesPerNode=25, subsamplingRate=0.9, seed=SEED).fit(data)
        scored = self.raw(rest).select("_p", "label")
        classes = [r[0] for r in scored.select("label").distinct().limit(3).collect()]
        if self.calibration == "isotonic" and len(classes) > 1:
            self.calibrator = IsotonicRegression(featuresCol="_p", labelCol="label").fit(scored)
        elif self.calibration == "platt" and len(classes) > 1:
            self.calibrator = LogisticRegression(featuresCol="_f", labelCol="label").fit(scored.withColumn("_f", array_to_vector(F.array("_p"))))
        return self

    def raw(self, frame: DataFrame, values: Column | None = None) -> DataFrame:
        """Adds _p, the uncalibrated probability."""
        out = self.model.transform(self._vectors(frame, values))
        p = vector_to_array("probability")[1]
        return out.withColumn("_p", F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))).drop("_v", "_x", "_a", "rawPrediction", "probability", "prediction")

    def calibrated(self, scored: DataFrame) -> DataFrame:
        """Exchanges _p for the calibrated p and the score on the scale of log odds."""
        cols = [c for c in scored.columns if c != "_p"]
        if self.calibrator is None:
            return scored.select(*cols, F.col("_p").alias("p"), logit(F.col("_p")).alias("score"))
        if self.calibration == "platt":
            out = self.calibrator.transform(scored.withColumn("_f", array_to_vector(F.array("_p")))).withColumn("p", vector_to_array("probability")[1])
        else:
            out = self.calibrator.transform(scored).withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))))
        return out.select(*cols, "p", logit(F.col("_p")).alias("score"))

    def predict(self, frame: DataFrame) -> DataFrame:
        return self.calibrated(self.raw(frame))

    def contributions(self, frame: DataFrame, keys: Sequence[str]) -> DataFrame:
        """keys, feature, value, contribution: on the scale of log odds, the coefficient's share (logistic) or what the score
        loses with the feature at its training median. Every row meets every feature once; the model sees them in one pass."""
        medians = F.array(*(F.lit(self.medians[f]) for f in self.features))
        base = frame.select(*keys, F.array(*(finite(f) for f in self.features)).alias("_all"))
        names = F.array(*map(F.lit, self.features))
        if self.kind == "logistic":
            scaled = [c / s if s else 0.0 for c, s in zip(self.model.coefficients, self.scaler.std)]
            each = F.transform(F.sequence(F.lit(1), F.lit(len(self.features))), lambda i: F.struct(F.element_at(names, i).alias("feature"), F.element_at("_all", i).alias("value"), (F.element_at(F.array(*(F.lit(float(x)) for x in scaled)), i) * (F.element_at("_all", i) - F.element_at(medians, i))).alias("contribution")))
            return base.select(*keys, F.inline(each))
        whole = self.raw(base, F.col("_all")).select(*keys, "_all", logit(F.col("_p")).alias("_whole"))
        held = whole.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(self.features)))).alias("_i"))
        other = F.transform("_all", lambda x, i: F.when(i + 1 == F.col("_i"), F.element_at(medians, F.col("_i"))).otherwise(x))
        again = self.raw(held, other)
        return again.select(*keys, F.element_at(names, F.col("_i")).alias("feature"), F.element_at("_all", F.col("_i")).alias("value"), (F.col("_whole") - logit(F.col("_p"))).alias("contribution"))

    def ablations(self, frame: DataFrame, keys: Sequence[str]) -> DataFrame:
        """keys, family, n_features, p_with, p_without: calibrated probability with a family's features at their medians."""
        position = {f: i for i, f in enumerate(self.features)}
        families = [(name, [position[f] for f in members if f in position]) for name, members in S.FAMILIES.items()]
        cases = F.array(*(F.struct(F.lit(n).alias("family"), F.array(*map(F.lit, at)).alias("at")) for n, at in families if at))
        medians = F.array(*(F.lit(self.medians[f]) for f in self.features))
        base = frame.select(*keys, F.array(*(finite(f) for f in self.features)).alias("_all"))
        whole = self.calibrated(self.raw(base, F.col("_all"))).select(*keys, "_all", F.col("p").alias("p_with"))
        held = whole.select("*", F.explode(cases).alias("_c"))
        other = F.transform("_all", lambda x, i: F.when(F.array_contains(F.col("_c.at"), i), F.element_at(medians, i + 1)).otherwise(x))
        return self.calibrated(self.raw(held, other)).select(*keys, "_c.family", F.size("_c.at").alias("n_features"), "p_with", F.col("p").alias("p_without"))

    def importance(self, spark) -> DataFrame:
        """feature, family, importance: impurity reduction, or the absolute standardised coefficient."""
        values = np.abs(self.model.coefficients.toArray()) if self.kind == "logistic" else self.model.featureImportances.toArray()
        return spark.createDataFrame([(f, S.FAMILY_OF.get(f, "unknown"), float(v)) for f, v in zip(self.features, values)], "feature string, family string, importance double")


def metrics(scored: DataFrame) -> DataFrame:
    """Per split: n, positives, Brier score, calibration error (ten right-closed bins), slope and intercept."""
    b = scored.groupBy("split", F.greatest(F.lit(0), F.least(F.lit(9), F.ceil(F.col("p") * 10) - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("label").alias("ml"))
    ece = b.groupBy("split").agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("ml"))) / F.sum("n")).alias("ece"))
    g = scored.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"), F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"), F.regr_slope("label", "p").alias("slope"), F.regr_intercept("label", "p").alias("intercept"))
    # areas by grouped scores: as many rows as distinct probabilities
    d = scored.groupBy("split", "p").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    down = F.sum("n").over(_by_score()), F.sum("pos").over(_by_score())
    r = d.select("split", "n", "pos", down[0].alias("cn"), down[1].alias("cp"))
    areas = r.groupBy("split").agg((F.sum(F.col("pos") * F.col("cp") / F.col("cn")) / F.sum("pos")).alias("pr_auc"), (1 - F.try_divide(F.sum(F.col("pos") * (F.col("cn") - F.col("cp") - (F.col("n") - F.col("pos")) / 2)), F.sum("pos") * F.sum(F.col("n") - F.col("pos")))).alias("roc_auc"))
    return g.join(ece, "split").join(areas, "split")


def _by_score():
    from pyspark.sql import Window

    return Window.partitionBy("split").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)


def stack(panel: DataFrame, members: Sequence[str]) -> tuple[object, DataFrame]:
    """A logistic model on the members' log odds, fitted on the calibration split; (model, panel with stacked)."""
    vector = array_to_vector(F.array(*(logit(F.col(m)) for m in members)))
    data = panel.withColumn("_v", vector)
    model = LogisticRegression(featuresCol="_v", labelCol="label").fit(data.where("split = 'calibration'"))
    return model, model.transform(data).withColumn("stacked", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")


# --- count regression ------------------------------------------------------------------------------------------------


def _partial_sums(frame: DataFrame, columns: Sequence[str], compute, width: int) -> np.ndarray:
    """Adds up vectors of fixed width that ``compute`` makes of Arrow batches; each partition sends one row."""
    rows = frame.select(*columns)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for batch in batches:
            if len(batch):
                total += compute(batch.to_numpy(dtype=float))
        yield pd.DataFrame({"s": [total.tolist()]})

    sums = rows.mapInPandas(part, "s array<double>").select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("v"))
    out = np.zeros(width)
    for r in sums.collect():  # the squared width of the design at most
        out[r["pos"]] = r["v"]
    return out


@dataclass
class CountGLM:
    """Log-link count regression: ridge on the slopes, iteratively reweighted least squares, negative binomial dispersion by
    profile likelihood. Each round is one pass that adds up the normal equations."""

    features: Sequence[str]
    ridge: float = 2.0
    kept: list = field(default_factory=list)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    beta: np.ndarray = field(default_factory=lambda: np.zeros(1))
    alpha: float = 0.05
    rounds: int = 0

    def fit(self, frame: DataFrame, target: str, max_rounds: int = 60, tolerance: float = 1e-8) -> CountGLM:
        clean = frame.select(*(finite(f).alias(f) for f in self.features), F.greatest(F.col(target).cast("double"), F.lit(0.0)).alias("_y")).where("_y is not null")
        row = clean.agg(F.count("*").alias("n"), F.avg("_y").alias("y"), *(F.avg(f).alias(f"m_{f}") for f in self.features), *(F.stddev_pop(f).alias(f"s_{f}") for f in self.features)).first()
        if not row["n"]:
            raise ValueError("no rows to fit")
        self.kept = [f for f in self.features if row[f"s_{f}"] > 1e-9]
        self.mean, self.scale = np.array([row[f"m_{f}"] for f in self.kept]), np.array([row[f"s_{f}"] for f in self.kept])
        k = len(self.kept) + 1
        self.beta = np.zeros(k)
        self.beta[0] = np.log(max(row["y"], D.EPS))
        penalty = np.eye(k) * self.ridge
        penalty[0, 0] = 0
        mean, scale = self.mean, self.scale
        for self.rounds in range(1, (max_rounds if self.kept else 0) + 1):
            beta = self.beta

            def normal(x: np.ndarray) -> np.ndarray:
                design = np.column_stack([np.ones(len(x)), (x[:, :-1] - mean) / scale])
                eta = np.clip(design @ beta, -30, 30)
                mu = np.clip(np.exp(eta), D.EPS, 1e8)
                weighted = design * mu[:, None]
                return np.concatenate([(design.T @ weighted).ravel(), weighted.T @ (eta + (x[:, -1] - mu) / mu)])

            sums = _partial_sums(clean, [*self.kept, "_y"], normal, k * k + k)
            self.beta = np.linalg.solve(sums[: k * k].reshape(k, k) + penalty, sums[k * k :])
            if np.abs(self.beta - beta).max() < tolerance:
                break
        self.alpha = dispersion(clean.withColumn("_mu", self.predicted()), "_y", "_mu")
        return self

    def predicted(self) -> Column:
        eta = F.lit(float(self.beta[0]))
        for f, m, s, b in zip(self.kept, self.mean, self.scale, self.beta[1:]):
            eta = eta + float(b) * (finite(f) - float(m)) / float(s)
        return F.exp(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), eta)))


def dispersion(frame: DataFrame, target: str, mu: str, low: float = 1e-4, high: float = 50.0) -> float:
    """Maximum likelihood dispersion of a negative binomial with given means, on [low, high]: three passes, each of which
    evaluates 25 values and narrows the range. 0.05 for fewer than three rows or equal targets."""
    rows = frame.select(F.col(target).cast("double").alias("y"), F.col(mu).cast("double").alias("m"))
    n, least, most = rows.agg(F.count("*"), F.min("y"), F.max("y")).first()
    if n < 3 or least == most:
        return 0.05
    # equal (y, mu) count once: far fewer than rows where counts are small
    grouped = rows.groupBy("y", "m").agg(F.count("*").cast("double").alias("n"))
    a, b = np.log(low), np.log(high)
    for _ in range(3):
        grid = np.linspace(a, b, 25)

        def likelihood(x: np.ndarray, grid=grid) -> np.ndarray:
            return np.array([(x[:, 2] * D.nb_log_pmf(x[:, 0], x[:, 1], float(np.exp(g)))).sum() for g in grid])

        best = int(np.argmax(_partial_sums(grouped, ["y", "m", "n"], likelihood, len(grid))))
        a, b = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    return float(np.clip(np.exp((a + b) / 2), low, high))


# --- forecast ensemble -----------------------------------------------------------------------------------------------

FORECAST_FEATURES = (
    "obs_last_1w", "obs_last_4w", "obs_last_13w", "obs_ewma_z", "obs_weeks_since_last", "hist_seasonal_baseline_log", "hist_excess_over_baseline", "spa_neighbour_activity_4w",
    "spa_neighbour_active_share", "env_suitability_4w", "exp_host_density_log", "intel_fused_anomaly", "rep_reporting_probability",
)
MEMBERS = ("negbin_glm", "damped_trend", "seasonal_climatology")
QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
# Weekly counts that a forecast is asked to exceed.
EXCEEDANCE = {"HPAI": 5.0, "ASF": 8.0}
FORECAST_SCHEMA = (
    "entity_key string, as_of date, horizon_days int, point double, mean double, lower double, upper double, p_exceed double, p_increase double, p_new double, "
    + ", ".join(f"q{round(q * 100):02d} double" for q in QUANTILES)
)


def glm_frame(panel: DataFrame) -> DataFrame:
    """Adds the regression's columns: counts in logs, two seasonal harmonics of the target week."""
    weeks = F.datediff("target_week", F.lit("2020-01-06").cast("date")) / 7.0
    turn = lambda k: 2 * F.pi() * k * weeks / 52.18
    logs = {f: F.log1p(F.greatest(finite(f), F.lit(0.0))) for f in ("obs_last_1w", "obs_last_4w", "obs_last_13w")}
    return panel.withColumns(logs | {f"season_{fn}{k}": (F.sin if fn == "sin" else F.cos)(turn(k)) for k in (1, 2) for fn in ("sin", "cos")})


GLM_COLUMNS = (*FORECAST_FEATURES, "season_sin1", "season_cos1", "season_sin2", "season_cos2")


@dataclass
class Ensemble:
    """CRPS-weighted negative binomial mixture of its members, one fit per horizon."""

    fits: dict = field(default_factory=dict)

    def fit(self, panel: DataFrame, train_end: str, horizons: Sequence[int] = S.HORIZONS) -> Ensemble:
        """``panel``: entity_key, as_of, horizon_days, target_week, target_reported_final, the features, mu_damped_trend and
        mu_seasonal_climatology. Rows after ``train_end`` validate."""
        framed = glm_frame(panel)
        for h in horizons:
            block = framed.where(F.col("horizon_days") == h)
            train, valid = block.where(F.col("as_of") <= F.lit(train_end).cast("date")), block.where(F.col("as_of") > F.lit(train_end).cast("date"))
            glm = CountGLM(GLM_COLUMNS).fit(train, "target_reported_final")
            spread = {"negbin_glm": glm.alpha} | {m: dispersion(train, "target_reported_final", f"mu_{m}") for m in MEMBERS[1:]}
            scores = self._crps(valid.withColumn("mu_negbin_glm", glm.predicted()), spread)
            self.fits[h] = {"glm": glm, "dispersion": spread, "crps": scores, "weights": weights(scores)}
        return self

    @staticmethod
    def _crps(valid: DataFrame, spread: dict[str, float], draws: int = 300) -> dict[str, float]:
        columns = [f"mu_{m}" for m in MEMBERS]

        def score(x: np.ndarray) -> np.ndarray:
            rng = np.random.default_rng(SEED)
            out = [len(x)]
            for j, m in enumerate(MEMBERS):
                sample = D.nb_draws(x[:, j][:, None], spread[m], (len(x), draws), rng)
                out.append(sum(D.crps_of_draws(sample[i], x[i, -1]) for i in range(len(x))))
            return np.array(out)

        sums = _partial_sums(valid.select(*(finite(c).alias(c) for c in columns), F.col("target_reported_final").cast("double").alias("y")), [*columns, "y"], score, len(MEMBERS) + 1)
        return {m: float(sums[j + 1] / sums[0]) if sums[0] else float("nan") for j, m in enumerate(MEMBERS)}

    def predict(self, panel: DataFrame, draws: int = 800, margin: float = 0.10) -> DataFrame:
        """``panel`` as in ``fit`` without targets, with ``level`` (the nowcast the increase is compared with)."""
        out = None
        for h, fit in self.fits.items():
            block = glm_frame(panel.where(F.col("horizon_days") == h)).withColumn("mu_negbin_glm", fit["glm"].predicted())
            threshold = F.lit(5.0)
            for disease, value in EXCEEDANCE.items():
                threshold = F.when(F.col("disease") == disease, value).otherwise(threshold)
            rows = block.select("entity_key", "as_of", F.lit(h).alias("horizon_days"), *(finite(f"mu_{m}").alias(f"mu_{m}") for m in MEMBERS), threshold.alias("t"), (F.coalesce("level", F.lit(0.0)) * (1 + margin)).alias("ref"), F.pmod(F.xxhash64("entity_key"), F.lit(2**31)).alias("hash"))
            part = rows.mapInPandas(_drawn(fit["weights"], fit["dispersion"], draws), FORECAST_SCHEMA)
            out = part if out is None else out.unionByName(part)
        return out


def weights(scores: dict[str, float], least: float = 0.05, temperature: float = 0.5) -> dict[str, float]:
    """As ``decide.crps_weights``, for the handful of members of a fit."""
    x = np.array(list(scores.values()), dtype=float)
    good = np.isfinite(x)
    if not good.any():
        return {m: 1 / len(x) for m in scores}
    raw = np.where(good, np.exp(-(x - x[good].min()) / max(abs(x[good].mean()) * temperature, D.EPS)), 0.0)
    w = np.maximum(raw / raw.sum(), min(least, 1 / len(x)))
    return {m: round(float(v), 6) for m, v in zip(scores, w / w.sum())}


def _drawn(weights: dict[str, float], spread: dict[str, float], draws: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                rng = np.random.default_rng([SEED, r.as_of.toordinal(), int(r.hash), int(r.horizon_days)])
                x = np.concatenate([D.nb_draws(np.array([getattr(r, f"mu_{m}")]), spread[m], (max(int(round(w * draws)), 1),), rng) for m, w in weights.items() if w > 0])
                q = np.quantile(x, QUANTILES)
                out.append((r.entity_key, r.as_of, r.horizon_days, q[3], x.mean(), q[0], q[6], (x > r.t).mean(), (x > r.ref).mean(), (x >= 1).mean(), *q))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in FORECAST_SCHEMA.split(", ")])

    return run
