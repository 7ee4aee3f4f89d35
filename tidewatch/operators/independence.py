"""How many independent voices stand behind a set of sources.

n_eff = (sum w)^2 / (w' R w), one weight per distinct source, R by clusters of sources: 1 on the diagonal, the cluster's
correlation inside it, a cross-cluster one elsewhere. As R is constant on blocks, the quadratic form needs only the sum
and the sum of squares of each cluster: one map-side combined aggregate, no pairs of sources.

Defined cases: no source gives 0; a sum of weights of 0 gives 0; the result lies between 1 and the number of sources;
a source that speaks twice keeps its largest weight; a null weight is ``missing_weight``; null source names don't count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.settings import CLUSTERS, CROSS, CROSS_DEFAULT, UNKNOWN_WITHIN

_WITHIN = {name: rho for name, (rho, _) in CLUSTERS.items()} | {"unknown": UNKNOWN_WITHIN}


def plain_name(source: Column) -> Column:
    """A source name without case and punctuation."""
    return F.regexp_replace(F.lower(source), "[^a-z0-9]", "")


def cluster_of(source: Column) -> Column:
    """The cluster of a source; ``unknown`` for sources that are in none."""
    out = F.lit("unknown")
    for cluster, (_, members) in CLUSTERS.items():
        out = F.when(plain_name(source).isin(*("".join(c for c in m.lower() if c.isalnum()) for m in members)), F.lit(cluster)).otherwise(out)
    return out


def correlation(a: Column, b: Column) -> Column:
    """Assumed correlation of what two sources say."""
    ca, cb = cluster_of(a), cluster_of(b)
    out = F.lit(CROSS_DEFAULT)
    for (x, y), rho in CROSS.items():
        out = F.when(((ca == x) & (cb == y)) | ((ca == y) & (cb == x)), rho).otherwise(out)
    for cluster, rho in _WITHIN.items():
        out = F.when((ca == cluster) & (cb == cluster), rho).otherwise(out)
    return F.when(plain_name(a) == plain_name(b), 1.0).otherwise(out)


def effective_sources(signals: DataFrame, keys: Sequence[str], source: str = "source_name", weight: str = "reliability", missing_weight: float = 0.5) -> DataFrame:
    """keys, n_sources, n_clusters, n_eff, and the sources of each cluster (a map of sorted lists)."""
    named = signals.where(F.col(source).isNotNull())
    one = named.groupBy(*keys, source).agg(F.max(F.coalesce(F.col(weight).cast("double"), F.lit(missing_weight))).alias("w")).withColumn("c", cluster_of(F.col(source)))
    per = one.groupBy(*keys, "c").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"), F.count("*").alias("n"), F.array_sort(F.collect_set(source)).alias("names"))
    inside = F.lit(0.0)
    for cluster, rho in _WITHIN.items():
        inside = F.when(F.col("c") == cluster, rho * (F.col("s") * F.col("s") - F.col("q")) + F.col("q")).otherwise(inside)
    of = lambda cluster: F.coalesce(F.sum(F.when(F.col("c") == cluster, F.col("s"))), F.lit(0.0))
    extra = F.lit(0.0)
    for (x, y), rho in CROSS.items():
        extra = extra + 2 * (rho - CROSS_DEFAULT) * of(x) * of(y)
    g = per.groupBy(*keys).agg(
        F.sum("s").alias("sw"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(inside).alias("inside"), extra.alias("extra"), F.sum("n").alias("n_sources"), F.count("*").alias("n_clusters"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "names")))).alias("by_cluster"),
    )
    form = F.col("inside") + CROSS_DEFAULT * (F.col("sw") * F.col("sw") - F.col("ss")) + F.col("extra")
    n = F.when(F.col("sw") <= 0, 0.0).when(form <= 0, 1.0).otherwise(F.least(F.col("n_sources").cast("double"), F.greatest(F.lit(1.0), F.col("sw") * F.col("sw") / form)))
    return g.select(*keys, "n_sources", "n_clusters", n.alias("n_eff"), "by_cluster")


def fuse(signals: DataFrame, keys: Sequence[str], value: str = "value", source: str = "source_name", weight: str = "reliability") -> DataFrame:
    """keys, fused, n_eff, strongest, n_strong, available_from: the reliability-weighted mean, discounted by n_eff / n."""
    r = F.coalesce(F.col(weight).cast("double"), F.lit(0.5))
    g = signals.groupBy(*keys).agg(
        (F.sum(r * F.col(value)) / F.greatest(F.sum(r), F.lit(1e-9))).alias("mean"), F.max(value).alias("strongest"), F.count_if(F.col(value) > 1.0).alias("n_strong"), F.max("available_from").alias("available_from")
    )
    found = g.join(effective_sources(signals, keys, source, weight), list(keys), "left")
    n_eff, n = F.coalesce("n_eff", F.lit(0.0)), F.greatest(F.coalesce("n_sources", F.lit(0)), F.lit(1))
    return found.select(*keys, (F.col("mean") * n_eff / n).alias("fused"), n_eff.alias("n_eff"), "strongest", "n_strong", "available_from")
