"""Tables of cases for the text, identity, matching, score and profile functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import identity, likelihood, matching, text
from tessera.operators import icp


def values(spark, cases, make, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_clean(spark):
    assert values(spark, ["  a\t b ", "", "   ", None, " x﻿ y"], text.clean) == ["a b", None, None, None, "x y"]


def test_normalise_text(spark):
    cases = ["Éléphant & Cie.", "L’Œuvre d'Art", "ﬁne ½ ㎏", "a--b__c", None, "", "Łódź", "École No. 5"]
    assert values(spark, cases, text.normalise_text) == ["elephant and cie", "loeuvre dart", "fine 1 2 kg", "a b c", "", "", "łodz", "ecole no 5"]


def test_company_names_are_fixpoints(spark):
    cases = ["Acme Inc.", "Acme Corp. Inc", "Acme S.A.R.L.", "Incorporée", "Inc. Acme", "Acme Canada Ltd.", "Société Générale Ltée", "Acme I.N.C.", "Corporation", "Acme Limited Partners", "ACME LIMITÉE INC", "9999-1234 Québec Inc.", None]
    want = ["acme", "acme", "acme", "", "inc acme", "acme canada", "societe generale", "acme", "", "acme limited partners", "acme", "9999 1234 quebec", ""]
    got = values(spark, cases, identity.company_name)
    assert got == want
    assert values(spark, got, identity.company_name) == want
    assert values(spark, ["acme canada", "canada", "123 canada"], identity.relaxed_name) == ["acme", "canada", "123 canada"]


def test_regions_countries_cities(spark):
    assert values(spark, ["Québec", "nf", "Colombie-Britannique", "Texas", None], identity.region) == ["QC", "NL", "BC", "texas", ""]
    assert values(spark, ["CANADA", "u.s.a.", "USA", "France"], identity.country) == ["CA", "u s a", "US", "france"]
    assert values(spark, ["Montréal", "K1A 0B1", "Unit 5", "N/A", "X", None], identity.is_useful_city) == [True, False, False, False, False, False]
    assert values(spark, ["k1a0b1", "KIA OB1", " H2X  1Y4 ", ""], identity.postal_code) == ["K1A 0B1", "KIA OB1", "H2X 1Y4", None]
    assert values(spark, ["nf", " on ", None], identity.province_code) == ["NL", "ON", None]


def test_numbered_and_usable(spark):
    assert values(spark, ["1234567 canada", "9012 3456 quebec", "123 canada", "1234567", "12345 acme", "acme"], identity.is_numbered) == [True, True, False, True, False, False]
    assert values(spark, ["acme", "1234567 canada", "none", "42", ""], identity.is_usable) == [True, False, False, False, False]


ACCOUNT = "id int, legal_name string, alternate_name string, city string, province_normalized string, country string"


def profile(spark, *names, city="Ottawa", province="ON", country=None):
    rows = spark.createDataFrame([(i, *(n if isinstance(n, tuple) else (n, None)), city, province, country) for i, n in enumerate(names)], ACCOUNT)
    return identity.profiles(rows).orderBy("id").collect()


def test_flags(spark):
    a, b, c, d, e, f = profile(spark, "Dr. Who Professional Corporation", "Éholdings Inc.", "Blue Holdings Real Estate", "Capital Partners", ("1234567 Canada Inc.", "Acme"), "Services Canada Inc.")
    assert a.is_professional_corporation and not a.is_holding_company
    assert not b.is_holding_company
    assert c.is_holding_company and c.is_real_estate_holding_entity
    assert d.is_investment_entity
    assert e.is_numbered_corporation and e.is_candidate and e.candidate_reason == "usable_alternate_name"
    assert f.is_generic_legal_name and f.has_useful_location


def test_similarity(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("", "a"), ("same", "same"), ("é", "e"), ("x" * 513, "y")], "a string, b string")
    got = [r[0] for r in rows.select(matching.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(1 - 3 / 7), 0, 1, 0, 0]
    with pytest.raises(ValueError):
        matching.check_provider_confidence(1.5)


def assessed(spark, registry, source):
    rows = spark.createDataFrame([(*registry, *source)], "legal_name string, alternate_name string, city string, province_normalized string, country string, name string, c string, p string, y string")
    rows = rows.withColumns(matching.registry_identity()).withColumns(matching.source_identity("name", "c", "p", "y"))
    return matching.assess(rows).first()


def test_assessment_strengths(spark):
    reg = ("Acme Widgets Inc.", None, "Toronto", "ON", "CA")
    assert (x := assessed(spark, reg, ("ACME WIDGETS LTD", "Toronto", "Ontario", None))).strength == "excellent" and x.match_confidence == 0.95
    assert (x := assessed(spark, reg, ("Acme Widgets", "Ottawa", "Ontario", None))).strength == "strong" and x.city_conflict
    assert assessed(spark, reg, ("Acme Widgett", "Toronto", "Ontario", None)).strength == "probable"
    conflict = assessed(spark, reg, ("Acme Widgets", "Toronto", "Quebec", None))
    assert conflict.strength == "weak" and conflict.location_match == "conflict" and conflict.match_confidence == pytest.approx(0.2)
    alternate = assessed(spark, ("1234567 Canada Inc.", "Acme", "Toronto", "ON", None), ("Acme", "Toronto", "ON", None))
    assert alternate.alternate_name_match and alternate.strength == "excellent"
    relaxed = assessed(spark, ("Acme Canada Inc.", None, None, None, None), ("Acme", None, None, None))
    assert relaxed.relaxed_name_equal and relaxed.match_method == "relaxed_name"


def scored(spark, name, alternate=None, low=None, high=None, filed=None, importer=False):
    rows = spark.createDataFrame([(1, name, alternate, "Ottawa", "ON", None, low, high, filed, importer)], ACCOUNT + ", min_directors string, max_directors string, last_annual_filing_year string, has_importer_evidence boolean")
    row = likelihood.score(identity.profiles(rows)).first()
    return row, {s.reason: s.points for s in row.signals}


def test_scores(spark):
    row, s = scored(spark, "Northern Software Inc.", low="2", filed="2025", importer=True)
    assert s == {"eligible_identity_baseline": 40, "usable_legal_name": 8, "matched_2024_importer": 18, "recent_annual_filing": 4, "useful_registered_location": 2, "minimum_directors_two_or_more": 3, "compact_name": 4, "concise_distinctive_name": 4, "operating_word_in_name": 3}
    assert row.raw == row.score == sum(s.values()) and row.label.startswith("High")
    _, s = scored(spark, "12 Main Street Inc.", low="999999", high="7")
    assert s["street_address_name"] == -10 and s["multiple_directors_allowed"] == 1
    _, s = scored(spark, "1234567 Canada Inc.", "Acme Ltd.")
    assert s["numbered_corporation"] == -22 and s["usable_alternate_name"] == 6 and "usable_legal_name" not in s
    _, s = scored(spark, "Jean Tremblay Consulting Inc.", filed="20256", low="0")
    assert s["possible_personal_service_name"] == -3 and "recent_annual_filing" not in s
    row, _ = scored(spark, "Blue Holdings Real Estate Inc.")
    assert row.summary.endswith("Named as a holding company.")


def test_sample_profile(spark):
    shape = "id string, name string, industry string, location string, " + ", ".join(f"{d} int" for d, _, _ in icp.DIMENSIONS)
    rows = spark.createDataFrame([("a", "Alpha", "tools", "Oslo", 90, 90, 90, 90, 90, 90), ("b", "Beta", "Shipping", "Rome", 100, 0, 0, 100, 100, 0), ("c", "Gamma", "toys", "Bern", 75, 75, 75, 60, 95, 86)], shape)
    got = {r.id: (r.fit_score, r.tier, list(r.reasons)) for r in icp.book(rows).collect()}
    assert got == {"a": (90, "Strong fit", ["Organizational scale", "Spend complexity"]), "b": (45, "Weak fit", ["Organizational scale", "Growth"]), "c": (76, "Potential", ["Distributed workforce", "Operational complexity"])}
    assert [r.id for r in icp.book(rows).collect()] == ["a", "c", "b"] and [r.id for r in icp.book(rows, " SHIP ").collect()] == ["b"]


def test_decomposition_of_all_characters(spark):
    """Every assigned code point as the Unicode tables have it, Hangul and those above U+FFFF among them."""
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = ["|".join(chars[i : i + 64]) for i in range(0, len(chars), 64)]
    want = ["".join(x for x in unicodedata.normalize("NFKD", t) if unicodedata.category(x)[0] != "M") for t in texts]
    got = values(spark, texts, text.without_accents)
    assert [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
