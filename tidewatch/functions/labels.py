"""Free-text labels to codes: folding, diseases by keyword groups, countries by an unambiguous name table."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters with accents beside their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# A label has a code when every pattern of one of its groups occurs in the folded label.
DISEASE_PATTERNS = {
    "HPAI": (
        (r"\bhpai\b",), ("high pathogenicity", "influenza"), ("highly pathogenic", "avian influenza"), (r"\bavian influenza\b",), (r"\bbird flu\b",), (r"\bh5n1\b",), (r"\bh5n8\b",),
        (r"\bh5nx\b",), (r"\bgrippe aviaire\b",), (r"\bhigh path ai\b",),
    ),
    "ASF": ((r"\basf\b",), ("african swine fever",), ("swine fever african",), ("peste porcine africaine",), ("peste porcina africana",), (r"peste porcine afr\b",)),
    "FMD": ((r"\bfmd\b",), ("foot", "mouth"), ("fievre aphteuse",)),
    "LSD": ((r"\blsd\b",), ("lumpy skin",), ("dermatose nodulaire",)),
    "PPR": ((r"\bppr\b",), ("peste des petits ruminants",), ("small ruminant plague",)),
}
# Labels that look like a match and are another disease.
NEGATIVE = {"HPAI": ("low pathogenicity", r"\blpai\b"), "ASF": ("classical swine fever", r"\bcsf\b", "hog cholera")}


def fold(column: Column) -> Column:
    """Lower case without accents, anything but letters and digits as single blanks; null stays null. In the JVM: accented
    letters of the table and combining marks; ``fold_all`` decomposes every letter."""
    plain = F.regexp_replace(F.translate(F.lower(column), ACCENTED, PLAIN), "\\p{M}", "")
    return F.trim(F.regexp_replace(plain, "[^\\p{L}\\p{N}]+", " "))


def fold_all(column: Column) -> Column:
    """``fold`` after full compatibility decomposition (ligatures, widths, scripts), for distinct labels: an Arrow UDF."""
    return F.pandas_udf(_fold_all, StringType())(column)


def _fold_all(values: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        marks = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
        return " ".join("".join(ch if ch.isalnum() else " " for ch in marks.lower()).split())

    return values.map(one)


def disease_of(label: Column) -> Column:
    """The code of a label: the code itself, or the only disease whose keyword groups match; else null."""
    text = fold(label)
    hits = []
    for name, groups in DISEASE_PATTERNS.items():
        hit = F.lit(False)
        for group in groups:
            every = F.lit(True)
            for pattern in group:
                every = every & text.rlike(pattern)
            hit = hit | every
        for pattern in NEGATIVE.get(name, ()):
            hit = hit & ~text.rlike(pattern)
        hits.append(F.when(hit, F.lit(name)))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    plain = F.upper(F.trim(label))
    return F.when(plain.isin(*DISEASE_PATTERNS), plain).when(F.size(found) == 1, F.get(found, F.lit(0)))


def country_names(frame: DataFrame, name: str, code: str) -> DataFrame:
    """(folded, iso3): names that stand for one code only; an ambiguous name names no country."""
    rows = frame.select(fold(F.col(name)).alias("folded"), F.upper(F.trim(code)).alias("iso3")).where((F.col("folded") != "") & F.col("iso3").rlike("^[A-Z]{3}$"))
    return rows.groupBy("folded").agg(F.min("iso3").alias("iso3"), F.max("iso3").alias("_m")).where("iso3 = _m").select("folded", "iso3")
