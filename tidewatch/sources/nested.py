"""Nested reports, articles and news-map items flattened to signal rows, with array and struct functions alone.

``countries`` is a dimension (label, iso3) of folded country labels; labels of a row are tried in order and the first known
one stands. Rows without a disease or a country are left out. Missing arrays, structs and fields count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import labels

REPORT = (
    "id string, publishedAt string, locations array<struct<name: string>>, latestVersion struct<title: string, createdAt: string, eventDate: string, severityScore: string, mediaReliability: string, "
    "sources: array<string>, diseaseList: struct<processed: array<string>>, pathogenList: struct<processed: array<string>>, location: array<struct<name: string>>, "
    "map: struct<borders: array<struct<shortCode: string, label: string>>, pins: array<struct<isVerified: boolean>>>>"
)
ARTICLE = (
    "id string, country string, published_at string, created_at string, lang string, source_lang string, source string, title string, url string, category string, "
    "rssfeed struct<source_category: string>, machine_classification_labels array<struct<name: string>>"
)
ITEM = (
    "guid string, pubDate string, language string, disease string, categoryIds array<string>, source struct<country: string>, "
    "detail struct<title: string, enTitle: string, link: string, language: string, categories: array<struct<id: string, name: string, score: double>>>"
)
# Labels that mark an outbreak, and weights of relevance labels.
OUTBREAK_LABELS = ("outbreak declaration", "consequences", "alert, prepardness", "alert, preparedness")
RELEVANT, IRRELEVANT, UNLABELLED = 0.85, 0.15, 0.50


def _list(column: Column, kind: str = "string") -> Column:
    return F.coalesce(column, F.array().cast(f"array<{kind}>"))


def _first(column: Column) -> Column:
    found = F.filter(column, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.element_at(found, 1))


def with_country(frame: DataFrame, tried: Column, countries: DataFrame) -> DataFrame:
    """Adds iso3 of the first label in ``tried`` that the dimension knows; rows without one are left out. The dimension - a few
    labels a country - becomes one map that meets every row, so documents are not shuffled."""
    one = countries.where(F.col("label") != "").groupBy("label").agg(F.min("iso3").alias("iso3"))
    lookup = one.agg(F.map_from_entries(F.collect_list(F.struct("label", "iso3"))).alias("_m"))
    found = _first(F.transform(tried, lambda x: F.try_element_at("_m", labels.fold(x))))
    return frame.crossJoin(F.broadcast(lookup)).withColumn("iso3", found).where("iso3 is not null").drop("_m")  # one row


def _time(column: Column) -> Column:
    return F.try_to_timestamp(column)


def reports(frame: DataFrame, countries: DataFrame) -> DataFrame:
    """Signal rows of curated reports: disease from the lists, then the title; country from borders, places, then the title."""
    v = F.col("latestVersion")
    named = F.concat(_list(v["diseaseList"]["processed"]), _list(v["pathogenList"]["processed"]), F.array(v["title"]))
    disease = _first(F.transform(named, labels.disease_of))
    border = "struct<shortCode:string,label:string>"
    place = "struct<name:string>"
    tail = F.when(v["title"].contains(","), F.trim(F.element_at(F.split(v["title"], ","), -1)))
    tried = F.concat(
        F.flatten(F.transform(_list(v["map"]["borders"], border), lambda b: F.array(b["shortCode"], b["label"]))), F.transform(_list(v["location"], place), lambda x: x["name"]), F.transform(_list(F.col("locations"), place), lambda x: x["name"]), F.array(tail)
    )
    raw = F.expr("try_cast(latestVersion.severityScore as double)")
    strength = F.when(raw.isNull() | F.isnan(raw), 0.65).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.when(raw > 1, raw / 10).otherwise(raw))))
    verified = F.exists(_list(v["map"]["pins"], "struct<isVerified:boolean>"), lambda p: F.coalesce(p["isVerified"], F.lit(False))) | F.coalesce(F.lower(v["mediaReliability"]).isin("high", "verified", "confirmed"), F.lit(False))
    official = F.lower(F.array_join(_list(v["sources"]), " ")).rlike("woah|wahis|ministry|gov")
    published = F.coalesce("publishedAt", v["createdAt"], v["eventDate"])
    return with_country(frame, tried, countries).where(disease.isNotNull()).select(
        F.concat(F.lit("BEACON-"), "id").alias("signal_id"), _time(F.coalesce(v["eventDate"], published)).cast("date").alias("detected"), _time(published).cast("date").alias("screened"), "iso3", disease.alias("disease"), strength.alias("strength"),
        F.when(verified, "verified").otherwise("unverified").alias("verification"), F.when(official, "media;official").otherwise("media").alias("underlying"), F.coalesce(v["title"], F.lit("")).alias("title"),
    )


def articles(frame: DataFrame, countries: DataFrame) -> DataFrame:
    """Signal rows of classified articles: relevance and event flag from the set of labels."""
    names = F.transform(_list(F.col("machine_classification_labels"), "struct<name:string>"), lambda x: F.lower(F.trim(F.coalesce(x["name"], F.lit("")))))
    has = lambda word: F.array_contains(names, word)
    category = F.coalesce(F.col("rssfeed.source_category"), "category")
    disease = F.coalesce(labels.disease_of(category), F.when(F.lower(F.trim(category)).isin("official ai press releases", "ai"), F.lit("HPAI")))
    return with_country(frame, F.array("country"), countries).where(disease.isNotNull()).select(
        F.concat(F.lit("PADI-"), "id").alias("article_id"), _time(F.coalesce("published_at", "created_at")).cast("date").alias("published"), _time(F.coalesce("created_at", "published_at")).cast("date").alias("extracted"), "iso3", disease.alias("disease"),
        F.when(has("relevant"), RELEVANT).when(has("irrelevant"), IRRELEVANT).otherwise(UNLABELLED).alias("relevance"), (F.arrays_overlap(names, F.array(*map(F.lit, OUTBREAK_LABELS))) | has("relevant")).alias("is_event"),
        F.lower(F.substring(F.coalesce("lang", "source_lang", F.lit("en")), 1, 8)).alias("language"), F.coalesce("title", F.lit("")).alias("title"),
    )


def camel_words(column: Column) -> Column:
    """UnitedKingdom -> United Kingdom."""
    return F.trim(F.regexp_replace(column, "([A-Z])", " $1"))


def items(frame: DataFrame, countries: DataFrame) -> DataFrame:
    """Signal rows of news-map items: country and disease from category ids, relevance from the largest category score."""
    kind = "struct<id:string,name:string,score:double>"
    more = _list(F.col("detail.categories"), kind)
    ids = F.concat(_list(F.col("categoryIds")), F.transform(more, lambda x: F.coalesce(x["id"], x["name"], F.lit(""))))
    usable = F.filter(ids, lambda x: x.isNotNull() & (F.trim(x) != "") & ~x.startswith("EIOS.") & ~x.startswith("PAHO"))
    tried = F.concat(F.flatten(F.transform(usable, lambda x: F.array(x, camel_words(x)))), F.array(F.col("source.country")))
    joined = F.lower(F.array_join(ids, " "))
    disease = F.when(F.col("disease").isin(*labels.DISEASE_PATTERNS), F.col("disease")).when(joined.rlike("swinefever|pigdisease|africanswine"), "ASF").when(joined.rlike("avianflu|h5n1|h5n6|h5n8|h7n|influenzahxnxanimal|influenzahumananimalinterface|lowpathogenicavian|birdflu"), "HPAI")
    score = F.aggregate(more, F.lit(0.55), lambda a, x: F.when(x["score"] > 0, F.greatest(a, F.least(x["score"] / 500.0, F.lit(1.0)))).otherwise(a))
    return with_country(frame, tried, countries).where(disease.isNotNull()).select(
        F.concat(F.lit("EIOS-NM-"), "guid").alias("item_id"), _time(F.col("pubDate")).cast("date").alias("first_seen"), "iso3", disease.alias("disease"), score.alias("relevance"),
        F.coalesce("detail.enTitle", "detail.title", F.lit("")).alias("title"), F.substring(F.coalesce("language", "detail.language", F.lit("")), 1, 8).alias("language"),
    )
