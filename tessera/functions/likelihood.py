"""The additive, explained likelihood score of a profiled registry row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.identity import is_usable
from tessera.functions.text import dense_length

SCORE_VERSION = "commercial-likelihood-v1"
# Years, bounds, points and word lists that decide results.
FILING_YEAR = 2026
MOST_DIRECTORS = 25
COMMERCIAL_WORDS = ("software", "technology", "technologies", "systems", "logistics", "manufacturing", "foods", "food", "commerce", "retail", "industrial", "solutions", "services", "media", "health", "energy", "energie")
FIRST_NAMES = ("john", "david", "michael", "robert", "james", "paul", "pierre", "jean", "marc", "marie", "susan", "sarah", "daniel", "andrew", "richard", "william", "joseph", "thomas")
PERSONAL_SERVICES = ("consulting", "services", "contracting", "construction", "advisory")
STREET = r"^\d{1,5} (\p{L}+ ){0,4}(street|st|avenue|ave|road|rd|boulevard|blvd|rue|drive|dr)\z"
HIGH, MEDIUM = 70, 55
SIGNAL = "struct<reason:string,points:int,explanation:string>"


def directors(c: Column) -> Column:
    """A director count of one or two digits between 1 and MOST_DIRECTORS; null for anything else."""
    n = F.when(c.rlike(r"^\d{1,2}\z"), c.try_cast("int"))
    return F.when(n.between(1, MOST_DIRECTORS), n)


# The points of each reason, in the order in which signals are listed. The explanations are our own.
POINTS = {
    "eligible_identity_baseline": (40, "Start for any usable identity."),
    "usable_legal_name": (8, "The legal name is usable."),
    "matched_2024_importer": (18, "Matched with confidence to a listed importer of 2024."),
    "usable_alternate_name": (6, "The other registered name is usable."),
    "recent_annual_filing": (4, "Filed an annual return lately."),
    "useful_registered_location": (2, "Registered at a usable city and province."),
    "minimum_directors_two_or_more": (3, "Must have two directors or more."),
    "multiple_directors_allowed": (1, "May have two directors or more."),
    "compact_name": (4, "The name has one to three words."),
    "four_word_name": (2, "The name has four words."),
    "concise_distinctive_name": (4, "A short name that is neither generic nor a vehicle's."),
    "operating_word_in_name": (3, "A word of the name tells of an operating business."),
    "numbered_corporation": (-22, "The legal name is a number."),
    "professional_corporation": (-11, "Named as a professional corporation."),
    "investment_entity": (-15, "Named as an investment vehicle."),
    "holding_company": (-13, "Named as a holding company."),
    "real_estate_holding": (-7, "Named as a holding of property."),
    "generic_legal_name": (-8, "The legal name is generic."),
    "management_name": (-3, "Named as a management company."),
    "street_address_name": (-10, "The name looks like a street address."),
    "numeric_heavy_name": (-6, "Many of the name's characters are digits."),
    "possible_personal_service_name": (-3, "Looks like a person's name and a trade."),
}


def conditions() -> dict[str, Column]:
    """When each signal is given, over the columns of identity.profiles, name_used and its words."""
    c = F.col
    name, words = c("name_used"), c("_words")
    n = F.size(words)
    filed = c("last_annual_filing_year")
    low, high = directors(c("min_directors")), directors(c("max_directors"))
    digits = F.length(F.regexp_replace(name, r"[^0-9]", ""))
    several = F.coalesce(low >= 2, F.lit(False))
    return {
        "eligible_identity_baseline": F.lit(True),
        "usable_legal_name": is_usable(c("normalized_legal_name")),
        "matched_2024_importer": c("has_importer_evidence"),
        "usable_alternate_name": c("has_alternate_name") & is_usable(c("normalized_alternate_name")),
        "recent_annual_filing": filed.rlike(r"^\d{4}\z") & filed.try_cast("int").between(FILING_YEAR - 1, FILING_YEAR),
        "useful_registered_location": c("has_useful_location"),
        "minimum_directors_two_or_more": several,
        "multiple_directors_allowed": ~several & (high >= 2),
        "compact_name": n.between(1, 3),
        "four_word_name": n == 4,
        "concise_distinctive_name": F.length(name).between(4, 25) & ~(c("is_generic_legal_name") | c("is_holding_company") | c("is_investment_entity")),
        "operating_word_in_name": F.arrays_overlap(words, F.array(*map(F.lit, COMMERCIAL_WORDS))),
        **{reason: c(flag) for reason, flag in FLAGGED.items()},
        "street_address_name": name.rlike(STREET),
        "numeric_heavy_name": (digits >= 4) & (digits / F.greatest(dense_length(name), F.lit(1)) >= 0.3),
        "possible_personal_service_name": (n == 3) & F.get(words, 0).isin(*FIRST_NAMES) & F.get(words, 1).rlike(r"^\p{L}{3,}\z") & F.get(words, 2).isin(*PERSONAL_SERVICES),
    }


FLAGGED = {
    "numbered_corporation": "is_numbered_corporation",
    "professional_corporation": "is_professional_corporation",
    "investment_entity": "is_investment_entity",
    "holding_company": "is_holding_company",
    "real_estate_holding": "is_real_estate_holding_entity",
    "generic_legal_name": "is_generic_legal_name",
    "management_name": "is_management_company",
}


def score(profiled: DataFrame) -> DataFrame:
    """profiled with name_used, signals, raw, score (0 to 100), label and summary.

    Wants the columns of identity.profiles and min_directors, max_directors, last_annual_filing_year (text) and
    has_importer_evidence (boolean). Nulls in them give no signal.
    """
    c = F.col
    step = profiled.withColumn("name_used", F.when(is_usable(c("normalized_legal_name")), c("normalized_legal_name")).otherwise(c("normalized_alternate_name")))
    step = step.withColumn("_words", F.filter(F.split("name_used", " "), lambda w: w != ""))
    when = conditions()
    listed = [F.when(F.coalesce(when[reason], F.lit(False)), F.struct(F.lit(reason).alias("reason"), F.lit(points).alias("points"), F.lit(text).alias("explanation"))) for reason, (points, text) in POINTS.items()]
    step = step.withColumn("signals", F.filter(F.array(*listed), lambda s: s.isNotNull()))
    step = step.withColumn("raw", F.aggregate("signals", F.lit(0), lambda a, s: a + s["points"]))
    step = step.withColumn("score", F.least(F.lit(100), F.greatest(F.lit(0), c("raw"))))

    def first(sign: int) -> Column:  # largest points of that sign, then the first reason
        own = F.filter("signals", lambda s: (s["points"] * sign > 0) & (s["reason"] != "eligible_identity_baseline"))
        return F.array_min(F.transform(own, lambda s: F.struct((-sign * s["points"]).alias("p"), s["reason"].alias("r"), s["explanation"].alias("e"))))["e"]

    lead, worst = first(1), first(-1)
    summary = F.when(worst.isNotNull(), F.concat_ws(" ", F.coalesce(lead, F.lit("A usable identity.")), worst)).otherwise(F.coalesce(lead, F.lit("A usable identity; little else is known.")))
    label = F.when(c("score") >= HIGH, "High commercial likelihood").when(c("score") >= MEDIUM, "Medium commercial likelihood").otherwise("Low commercial likelihood")
    return step.withColumns({"label": label, "summary": summary}).drop("_words")
