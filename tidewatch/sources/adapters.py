"""Source adapters: one contract, a registry, results collected into four tables; paged web sources; settings as tables.

An adapter loads its raw table and maps it to events, signals, covariates and provenance. The registry runs the enabled
ones in order and unites what they give. Pages are fetched by a Python data source on executors, or cached as files.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = ("events", "signals", "covariates", "provenance")


class SourceUnavailable(RuntimeError):
    """A source has neither cached nor live records."""


@dataclass(frozen=True)
class Adapter:
    """``load(spark)`` gives the raw table; ``transform(raw)`` gives any of KINDS as DataFrames."""

    name: str
    kind: str
    tier: str
    cluster: str
    reliability: float
    lag_days: int
    load: Callable[[SparkSession], DataFrame]
    transform: Callable[[DataFrame], Mapping[str, DataFrame]]
    downstream_of_official: bool = False
    enabled: bool = True

    def run(self, spark: SparkSession, cutoff: str | None = None) -> dict[str, DataFrame]:
        """The adapter's tables with their source columns; rows available only after ``cutoff`` are left out."""
        made = dict(self.transform(self.load(spark)))
        if unknown := set(made) - set(KINDS):
            raise ValueError(f"{self.name}: unknown tables {sorted(unknown)}")
        out = {}
        for kind, frame in made.items():
            if cutoff and "available_from" in frame.columns:
                frame = frame.where(F.col("available_from") <= F.lit(cutoff).cast("date"))
            out[kind] = frame.withColumns({"source_name": F.lit(self.name), "source_type": F.lit(self.kind), "reliability": F.lit(self.reliability), "is_downstream_of_official": F.lit(self.downstream_of_official)})
        return out

    def describe(self) -> tuple:
        return (self.name, self.kind, self.tier, self.cluster, self.reliability, self.lag_days, self.downstream_of_official, self.enabled)


CATALOGUE = "source_name string, source_type string, source_tier string, evidence_cluster string, reliability double, lag_days int, downstream_of_official boolean, enabled boolean"

# The published sources - name, type, tier, cluster, reliability, lag in days, downstream of official.
SOURCES = (
    ("WAHIS", "official", "primary_official", "official", 0.95, 0, False),
    ("WAHIS_SMR", "official", "secondary_official", "official", 0.85, 0, False),
    ("EMPRES-i", "official_derived", "secondary_official", "official", 0.80, 0, True),
    ("BEACON", "aggregator", "intelligence", "aggregator", 0.70, 1, False),
    ("PADIWeb", "media", "intelligence", "media", 0.58, 1, False),
    ("EIOS", "aggregator", "intelligence", "aggregator", 0.55, 1, False),
    ("GDELT", "media", "intelligence", "media", 0.45, 1, False),
    ("HealthMap", "media", "intelligence", "media", 0.44, 1, False),
    ("ProMED", "media", "intelligence", "media", 0.66, 1, False),
    ("ERA5", "environmental", "covariate", "environmental", 0.90, 6, False),
    ("ERA5-Land", "environmental", "covariate", "environmental", 0.88, 6, False),
    ("WorldClim", "environmental", "covariate", "environmental", 0.92, 0, False),
    ("GLW4", "exposure", "covariate", "exposure", 0.85, 0, False),
    ("FAOSTAT", "exposure", "covariate", "exposure", 0.80, 365, False),
)


@dataclass
class Registry:
    adapters: list[Adapter] = field(default_factory=list)

    def add(self, adapter: Adapter) -> Adapter:
        if any(a.name == adapter.name for a in self.adapters):
            raise ValueError(f"{adapter.name} is registered already")
        self.adapters.append(adapter)
        return adapter

    def run(self, spark: SparkSession, only: Sequence[str] | None = None, strict: bool = False, cutoff: str | None = None) -> tuple[dict[str, DataFrame], list[str]]:
        """(tables, notes) of the enabled adapters in order. An unavailable source raises if ``strict``, else it is a note."""
        parts: dict[str, list[DataFrame]] = {k: [] for k in KINDS}
        notes = []
        for adapter in self.adapters:
            if not adapter.enabled or only is not None and adapter.name not in only:
                continue
            try:
                for kind, frame in adapter.run(spark, cutoff).items():
                    parts[kind].append(frame)
            except SourceUnavailable as error:
                if strict:
                    raise
                notes.append(f"{adapter.name}: {error}")
        return {k: collected(k, frames) for k, frames in parts.items() if frames}, notes

    def catalogue(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([a.describe() for a in self.adapters], CATALOGUE)


def collected(kind: str, frames: Sequence[DataFrame]) -> DataFrame:
    """The union of tables of one kind by column name; provenance entries with one fingerprint count once (the first
    source's, then the earliest retrieval)."""
    out = None
    for i, frame in enumerate(frames):
        frame = frame.withColumn("_o", F.lit(i))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    if kind == "provenance":
        cols = [c for c in out.columns if c != "_o"]
        order = [F.col("_o"), *(F.col(c) for c in ("retrieved_at",) if c in cols)]
        rest = [F.col(c) for c in cols if c != "provenance_id"]
        first = out.groupBy("provenance_id").agg(F.min(F.struct(*(x.alias(f"o{i}") for i, x in enumerate(order)), *rest)).alias("m"))
        return first.select(*(F.col("provenance_id") if c == "provenance_id" else F.col(f"m.{c}") for c in cols))
    return out.drop("_o")


def fingerprint(source, record, published, available):
    """The first 12 hex digits of the SHA-1 of source, record, and both dates; a missing value reads None."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(x.cast("string"), F.lit("None")) for x in (source, record, published, available)))), 1, 12)


# --- column names ----------------------------------------------------------------------------------------------------

# Names under which exports carry each logical column, the preferred first.
ALIASES = {
    "country": ("country", "country_name", "location", "geo", "countries"),
    "disease": ("disease", "disease_name", "category", "threat", "diseases"),
    "first_seen_date": ("first_seen_date", "publication_date", "published", "date", "article_date", "information_date", "created"),
    "item_id": ("item_id", "article_id", "id", "uid", "document_id"),
    "relevance": ("relevance", "score", "relevance_score"),
    "triage_state": ("triage_state", "status", "triage", "state"),
    "n_articles_in_cluster": ("n_articles_in_cluster", "cluster_size", "articles", "n_articles"),
}


def rename_plan(columns: Sequence[str], aliases: Mapping[str, Sequence[str]] = ALIASES) -> dict[str, str]:
    """Logical column -> the first of its aliases that is there, whatever its case and outer blanks."""
    present = {c.strip().lower(): c for c in columns}
    return {logical: next(present[n] for n in names if n in present) for logical, names in aliases.items() if any(n in present for n in names)}


def renamed(frame: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """The logical columns only; those that are missing are null. Columns whose names clash once case is ignored must be told
    apart by the caller."""
    plan = rename_plan(frame.columns, aliases)
    return frame.select(*((F.col(f"`{plan[k]}`") if k in plan else F.lit(None).cast("string")).alias(k) for k in aliases))


# --- paged sources ---------------------------------------------------------------------------------------------------


def pages(get: Callable[[dict], dict], query: Mapping, items: str, total: str | None = None, cursor: str | None = None) -> Iterator[dict]:
    """Items of all pages of one query: by page numbers until ``total`` pages, or by following ``cursor`` until it is empty."""
    page, after = 1, None
    while True:
        answer = get(dict(query) | ({"page": page} if cursor is None else {"next": after} if after else {}))
        yield from answer.get(items) or ()
        if cursor is not None:
            after = answer.get(cursor)
            if not after:
                return
        else:
            if page >= int(answer.get(total) or 1):
                return
            page += 1


class PagedSource(DataSource):
    """Batch source ``paged``: each query of ``queries`` (set by ``paged``) is one input partition that an executor pages through."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "query int, item string"

    def reader(self, schema):
        return _PagedReader(*self.setup)


class _PagedReader(DataSourceReader):
    def __init__(self, get, queries, items, total, cursor):
        self.get, self.queries, self.items, self.total, self.cursor = get, queries, items, total, cursor

    def partitions(self):
        return [InputPartition(i) for i in range(len(self.queries))]

    def read(self, partition):
        import json

        for item in pages(self.get, self.queries[partition.value], self.items, self.total, self.cursor):
            yield partition.value, json.dumps(item)


def paged(spark: SparkSession, get: Callable[[dict], dict], queries: Sequence[Mapping], items: str, total: str | None = None, cursor: str | None = None) -> DataFrame:
    """(query, item): every item as JSON. ``get`` asks the service and must be serialisable; items that several queries return
    are told apart by the caller (``last_by_id``)."""
    source = type("Paged", (PagedSource,), {"setup": (get, list(queries), items, total, cursor)})
    spark.dataSource.register(source)
    return spark.read.format("paged").load()


def last_by_id(frame: DataFrame, id_path: str = "$.id", first: bool = False) -> DataFrame:
    """One item per id: that of the last query (or the first), of equal queries the largest text."""
    keyed = frame.withColumn("id", F.get_json_object("item", id_path)).where("id is not null")
    pick = F.min if first else F.max
    return keyed.groupBy("id").agg(pick(F.struct("query", "item")).alias("m")).select("id", "m.item")


def cached_or_fetched(cache: str, read: Callable[[str], DataFrame], fetch: Callable[[], DataFrame], write: Callable[[DataFrame, str], None], exists: Callable[[str], bool] = os.path.exists, refresh: bool = False) -> DataFrame:
    """The cached table if there is one and no refresh is asked; else the fetched one, which becomes the cache. A failed fetch
    falls back to the cache, and raises SourceUnavailable where there is none."""
    if exists(cache) and not refresh:
        return read(cache)
    try:
        write(fetch(), cache)
    except Exception as error:
        if not exists(cache):
            raise SourceUnavailable(f"no cache at {cache} and fetching failed: {error}") from error
    return read(cache)


# --- settings --------------------------------------------------------------------------------------------------------


def setting(tree: Mapping, path: str, default=None, environment: Mapping[str, str] | None = None):
    """A value by dotted path; an environment variable TIDEWATCH_<PATH> overrides it."""
    key = "TIDEWATCH_" + path.upper().replace(".", "_")
    if environment is not None and key in environment:
        return environment[key]
    for name in path.split("."):
        if not isinstance(tree, Mapping) or name not in tree:
            return default
        tree = tree[name]
    return tree


def enabled(tree: Mapping[str, Mapping]) -> dict[str, Mapping]:
    return {k: v for k, v in tree.items() if v.get("enabled", True)}
