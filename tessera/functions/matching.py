"""Assessment of a registry entity against an outside company, as column expressions over a joined pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.identity import company_name, country, is_region_code, is_usable, is_useful_city, region, relaxed_name
from tessera.functions.text import dense_length, normalise_text

LONGEST = 512
#: Fixed value: the least similarity of a probable match.
PROBABLE = 0.9


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """1 less the edit distance over the longer length; 0 for an empty name, and for long ones unless equal. What is
    below `least` may be given as 0: the distance is then followed no further than it has to be."""
    longest = F.greatest(F.length(a), F.length(b))
    if least <= 0:
        alike = 1 - F.levenshtein(a, b) / longest
    else:
        edits = F.call_function("levenshtein", a, b, F.floor((1 - least) * longest + 1e-9).cast("int"))
        alike = F.greatest(F.lit(0.0), 1 - edits.bitwiseAND(0x7FFFFFFF) / longest)  # -1, beyond the bound, becomes very many
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(longest > LONGEST, 0.0).otherwise(alike)


def facts(side: str, names: tuple[str, ...], city: str, province: str) -> dict[str, Column]:
    """What `assess` asks about one side of a pair, as columns to be kept with its rows: so that no pair asks again."""
    out = {}
    for n in names:
        out |= {f"{n}_usable": is_usable(F.col(n)), f"{n}_relaxed": relaxed_name(F.col(n)), f"{n}_dense": dense_length(F.col(n))}
    return out | {f"{side}_city_useful": is_useful_city(city, True), f"{side}_province_coded": is_region_code(F.col(province))}


def source_facts() -> dict[str, Column]:
    return facts("s", ("s_name",), "s_city", "s_province")


def registry_facts() -> dict[str, Column]:
    return facts("r", ("r_legal", "r_alternate"), "r_city", "r_province")


def source_identity(name: str, city: str, province: str, country_: str, postal: str | None = None) -> dict[str, Column]:
    """Normalised columns of an outside identity, prefixed s_."""
    tidy = F.upper(F.regexp_replace(F.coalesce(F.col(postal), F.lit("")), r"[\s\p{Z}]", "")) if postal else F.lit("")
    return {"s_name": company_name(name), "s_city": normalise_text(city), "s_province": region(province), "s_country": country(country_), "s_postal": tidy}


def registry_identity(prefix: str = "r_") -> dict[str, Column]:
    """Normalised columns of a registry row (legal_name, alternate_name, city, province_normalized, country)."""
    return {f"{prefix}legal": company_name("legal_name"), f"{prefix}alternate": company_name("alternate_name"), f"{prefix}city": normalise_text("city"), f"{prefix}province": region("province_normalized"), f"{prefix}country": country("country")}


def assess(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """pairs with the assessment's columns: similarity, method, location, strength, confidence and what they rest on.

    Wants r_legal, r_alternate, r_city, r_province, r_country and s_name, s_city, s_province, s_country, all
    normalised, and takes source_facts and registry_facts from them where they are there. Strength grades rules, it is
    no probability; nothing is ever accepted here. Only pairs of `least` similarity are given.
    """
    c = F.col
    missing = {k: v for k, v in (source_facts() | registry_facts()).items() if k not in pairs.columns}
    pairs = pairs.withColumns(missing)

    def of(name: str) -> Column:
        return F.when(c(f"{name}_usable") & c("s_name_usable"), similarity(c(name), c("s_name"), least)).otherwise(0.0)

    step = pairs.withColumns({"sim_legal": of("r_legal"), "sim_alternate": of("r_alternate")})
    differ = lambda a, b: (c(a) != "") & (c(b) != "") & (c(a) != c(b))
    target = c("s_name_relaxed")
    step = step.withColumn("name_similarity", F.greatest("sim_legal", "sim_alternate"))
    if least > 0:
        step = step.filter(c("name_similarity") >= least)
    step = step.withColumns(
        {
            "alternate_name_match": c("sim_alternate") > c("sim_legal"),
            "city_match": c("r_city_useful") & c("s_city_useful") & (c("r_city") == c("s_city")),
            "province_match": c("r_province_coded") & (c("r_province") == c("s_province")),
            "country_conflict": differ("r_country", "s_country"),
            "province_conflict": differ("r_province", "s_province"),
            "city_conflict": differ("r_city", "s_city"),
            "relaxed_name_equal": is_usable(target) & ((c("r_legal_relaxed") == target) | (c("r_alternate_relaxed") == target)),
        }
    )
    step = step.withColumns(
        {
            "location_match": F.when(c("country_conflict") | c("province_conflict"), "conflict").when(c("city_match") & c("province_match"), "city_province").when(c("province_match"), "province").otherwise("none"),
            "exact_name_match": c("name_similarity") == 1,
            "informative_name": (F.when(c("alternate_name_match"), c("r_alternate_dense")).otherwise(c("r_legal_dense")) >= 3) & (c("s_name_dense") >= 3),
        }
    )
    strength = F.when(
        c("informative_name"),
        F.when(c("exact_name_match") & (c("location_match") == "city_province"), "excellent").when(c("exact_name_match") & (c("location_match") == "province"), "strong").when((c("name_similarity") >= PROBABLE) & (c("location_match") == "city_province"), "probable"),
    )
    step = step.withColumn("strength", F.coalesce(strength, F.lit("weak")))
    weak = F.when(c("location_match") == "conflict", F.least(F.lit(0.2), c("name_similarity") * 0.2)).otherwise(F.least(F.lit(0.45), F.greatest(c("name_similarity"), F.when(c("relaxed_name_equal"), 0.5).otherwise(0.0)) * 0.45))
    confidence = F.when(c("strength") == "excellent", 0.95).when(c("strength") == "strong", 0.85).when(c("strength") == "probable", 0.7).otherwise(weak)
    method = F.when(c("exact_name_match"), "exact_normalized_name").when(c("relaxed_name_equal"), "relaxed_name").otherwise("fuzzy_name")
    return step.withColumns({"match_confidence": confidence, "match_method": method, "match_status": F.lit("candidate")}).drop("sim_legal", "sim_alternate", *source_facts(), *registry_facts())


def check_provider_confidence(value: float | None) -> float | None:
    if value is not None and not 0 <= value <= 1:
        raise ValueError("a provider's confidence lies between 0 and 1")
    return value
