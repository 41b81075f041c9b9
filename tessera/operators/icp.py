"""The sample profile score: a weighted sum of six dimensions, tiers and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The weights, labels and bounds of the sample profile.
DIMENSIONS = (("scale", "Organizational scale", 0.2), ("spend", "Spend complexity", 0.25), ("finance", "Finance complexity", 0.2), ("growth", "Growth", 0.15), ("distributed", "Distributed workforce", 0.1), ("operations", "Operational complexity", 0.1))
STRONG, POTENTIAL = 85, 70


def fit_score() -> Column:
    """The weighted sum, halves rounded up."""
    total = F.lit(0.0)
    for name, _, weight in DIMENSIONS:
        total = total + F.col(name) * F.lit(weight)
    return F.floor(total + F.lit(0.5)).cast("int")


def tier(score: Column) -> Column:
    return F.when(score >= STRONG, "Strong fit").when(score >= POTENTIAL, "Potential").otherwise("Weak fit")


def reasons() -> Column:
    """Labels of the two highest dimensions of STRONG or more; ties in the order of the dimensions."""
    listed = F.array(*(F.struct((-F.col(name)).alias("v"), F.lit(k).alias("k"), F.lit(label).alias("label")) for k, (name, label, _) in enumerate(DIMENSIONS)))
    return F.transform(F.slice(F.array_sort(F.filter(listed, lambda x: x["v"] <= -STRONG)), 1, 2), lambda x: x["label"])


def book(accounts: DataFrame, text: str = "") -> DataFrame:
    """Accounts whose name, industry or location holds `text`, best score first (stable by `ordinal` where there is one)."""
    rows = accounts.withColumns({"fit_score": fit_score(), "reasons": reasons()}).withColumn("tier", tier(F.col("fit_score")))
    if text.strip():
        rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", "name", "industry", "location")), F.lit(text.strip().lower())))
    return rows.orderBy(F.desc("fit_score"), *(["ordinal"] if "ordinal" in rows.columns else ["id"]))
