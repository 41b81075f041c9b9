"""Registry-shaped views over the driver's tables, as expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import identity, likelihood, matching
from tessera.operators import resolution, search
from tessera.operators.ranks import Ranks
from tessera.operators.store import shared_path

ACCOUNT = {
    "id": "p_partkey",
    "source_id": "substr(concat('0000000', p_partkey), -7)",
    "business_number": "concat('BN', p_partkey % 900)",
    "legal_name": """CASE WHEN p_partkey % 17 = 0 THEN concat(1000000 + p_partkey, ' CANADA INC.')
      WHEN p_partkey % 19 = 0 THEN concat('Gestion ', p_name, ' Limitée')
      WHEN p_partkey % 23 = 0 THEN concat('Dr. ', p_name, ' Professional Corporation')
      WHEN p_partkey % 29 = 0 THEN concat(p_name, ' Investments & Co. Ltd.')
      WHEN p_partkey % 31 = 0 THEN concat(p_name, ' Real Estate Holdings Inc.')
      WHEN p_partkey % 37 = 0 THEN 'Services Canada Inc.'
      WHEN p_partkey % 41 = 0 THEN concat(p_size, ' ', p_name, ' Street')
      WHEN p_partkey % 43 = 0 THEN 'Jean Tremblay Consulting Inc.'
      WHEN p_size % 5 = 0 THEN concat(p_name, ' ', p_brand, ' Inc.')
      WHEN p_size % 5 = 1 THEN concat(p_name, ' ', p_brand, ' Ltd.')
      WHEN p_size % 5 = 2 THEN concat(p_name, ' Holdings Inc.')
      WHEN p_size % 5 = 3 THEN concat(p_name, ' Services Corp.')
      ELSE concat(p_name, ' Canada Inc.') END""",
    "alternate_name": "CASE WHEN p_size % 7 = 0 THEN concat('Compagnie ', p_name, ' Ltée') END",
    "city": "CASE WHEN p_partkey % 13 = 0 THEN 'K1A 0B1' ELSE p_type END",
    "province_normalized": "CASE p_partkey % 4 WHEN 0 THEN 'ON' WHEN 1 THEN 'QC' WHEN 2 THEN 'BC' ELSE 'NF' END",
    "country": "CASE p_partkey % 3 WHEN 0 THEN 'Canada' WHEN 1 THEN 'CA' END",
    "postal_code": "concat('k', p_size % 10, 'a', p_partkey % 10, 'b', p_partkey % 7)",
    "min_directors": "concat('', p_size % 4)",
    "max_directors": "concat('', p_size % 40)",
    "last_annual_filing_year": "concat('', 2020 + p_size % 9)",
    "has_importer_evidence": "p_partkey % 5 = 0",
    "updated_at": "p_partkey % 100",
}
#: Outside identities, one for each part: some with another legal form, some with a slip in the name or elsewhere.
SOURCE = {
    "key": "p_partkey",
    "name": "CASE WHEN p_partkey % 2 = 1 THEN concat(p_name, ' ', p_brand, ' Limited') WHEN p_partkey % 3 = 1 THEN concat(p_name, 'e ', p_brand, ' Inc') ELSE concat(p_name, ' Holding Inc') END",
    "src_city": "p_type",
    "src_province": "CASE p_partkey % 4 WHEN 0 THEN 'Ontario' WHEN 1 THEN 'Québec' WHEN 2 THEN 'British Columbia' ELSE 'Newfoundland and Labrador' END",
    "src_country": "CASE WHEN p_partkey % 9 = 1 THEN 'Canada' WHEN p_partkey % 15 = 1 THEN 'USA' END",
    "src_postal": "concat('K', p_size % 10, 'A ', p_partkey % 10, 'B', p_partkey % 7)",
}


def sql_of(view: dict[str, str], table: str, where: str = "") -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in view.items())} FROM {table}" + (f" WHERE {where}" if where else "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in ACCOUNT.items()))


#: Where each session keeps what is derived from a folder of tables: derived once, then read, as the engine does.
_derived: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """profiles of the accounts, scores of the candidates, registry and sources of resolution, or the search index of the
    accounts, written once a session to the shared folder and read from there; the index in the order of its tokens."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _derived:
        made = {
            "profiles": lambda: identity.profiles(accounts(spark, sf_dir)),
            "scores": lambda: likelihood.score(stored(spark, sf_dir, "profiles").filter("is_candidate")),
            "registry": lambda: resolution.prepared(registry_rows(stored(spark, sf_dir, "profiles")), True),
            "sources": lambda: resolution.prepared(source_rows(spark, sf_dir), False),
            "index": lambda: search.sorted_index(search.index(accounts(spark, sf_dir))),
        }[name]()
        path = shared_path(spark, name)
        made.write.parquet(path)
        _derived[key] = path
    return spark.read.parquet(_derived[key])


def order_ranks(spark: SparkSession, sf_dir: str) -> Ranks:
    """Orders by price, in ranges of some 2,000, built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "ranks")
    if key not in _derived:
        path = shared_path(spark, "ranks")
        Ranks.build(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", path, 2000)
        _derived[key] = path
    return Ranks(spark, _derived[key])


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "profiles")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "sources")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "registry")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in SOURCE.items()))
    return rows.withColumns(matching.source_identity("name", "src_city", "src_province", "src_country", "src_postal"))


def registry_rows(rows: DataFrame) -> DataFrame:
    return rows.select("id", "is_candidate", F.col("normalized_legal_name").alias("r_legal"), F.col("normalized_alternate_name").alias("r_alternate"), identity.normalise_text("city").alias("r_city"), identity.region("province_normalized").alias("r_province"), identity.country("country").alias("r_country"), F.col("postal_code").alias("r_postal"))


# ---- the same rules as DuckDB expressions


def norm(x: str) -> str:
    folded = f"replace(replace(lower(strip_accents(coalesce({x}, ''))), 'œ', 'oe'), 'æ', 'ae')"
    return f"trim(regexp_replace(replace(regexp_replace({folded}, '[’'']', '', 'g'), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def company(n: str) -> str:
    return f"trim(regexp_replace({n}, '((^| )({'|'.join(identity.LEGAL_FORMS)}))+\\z', ''))"


def listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def usable(n: str) -> str:
    return f"({matches(n, chr(92) + 'p{L}')} AND NOT {matches(n, identity.NUMBERED)} AND {n} NOT IN {listed(identity.PLACEHOLDERS)})"


def coded(n: str, codes: dict) -> str:
    return "CASE " + " ".join(f"WHEN {n} IN {listed(names)} THEN '{code}'" for code, names in codes.items()) + f" ELSE {n} END"


def useful_city(n: str) -> str:
    letters = f"length(regexp_replace({n}, '[^\\p{{L}}]', '', 'g'))"
    return f"({letters} >= 2 AND NOT {matches(n, identity.POSTAL_LIKE)} AND NOT {matches(n, identity.UNIT_LIKE)} AND {n} NOT IN {listed(identity.PLACEHOLDERS)})"


def relaxed(n: str) -> str:
    return f"CASE WHEN regexp_matches(regexp_replace({n}, '(^| )canada\\z', ''), '\\p{{L}}') THEN regexp_replace({n}, ' canada\\z', '') ELSE {n} END"


def dense(n: str) -> str:
    return f"length(replace({n}, ' ', ''))"


def says(phrase: str) -> str:
    p = identity.PHRASES[phrase]
    return f"(regexp_matches(n_legal, '\\b({p})\\b') OR regexp_matches(n_alternate, '\\b({p})\\b'))"


PROFILES = f"""
account AS ({sql_of(ACCOUNT, 'part')}),
folded AS (SELECT *, {norm('legal_name')} AS n_legal, {norm('alternate_name')} AS n_alternate, {norm('city')} AS n_city,
  {coded(norm('province_normalized'), identity.REGIONS)} AS n_region, {coded(norm('country'), identity.COUNTRIES)} AS n_country FROM account),
named AS (SELECT *, {company('n_legal')} AS normalized_legal_name, {company('n_alternate')} AS normalized_alternate_name FROM folded),
profile AS (SELECT *, {relaxed('normalized_legal_name')} AS relaxed_legal_name, {relaxed('normalized_alternate_name')} AS relaxed_alternate_name,
  {matches('normalized_legal_name', identity.NUMBERED)} AS is_numbered_corporation,
  {says('professional')} AS is_professional_corporation, {says('holding')} AS is_holding_company, {says('investment')} AS is_investment_entity,
  {says('holding')} AND {says('property')} AS is_real_estate_holding_entity, {says('management')} AS is_management_company,
  NOT {usable('normalized_legal_name')} OR {dense('normalized_legal_name')} < 3 OR list_bool_and([w IN {listed(identity.GENERIC_WORDS)} OR regexp_matches(w, '^[0-9]+\\z') for w in string_split(normalized_legal_name, ' ')]) AS is_generic_legal_name,
  coalesce(trim(alternate_name), '') <> '' AS has_alternate_name,
  {useful_city('n_city')} AND regexp_matches(n_region, '^[A-Z][A-Z]\\z') AND n_country IN ('', 'CA') AS has_useful_location,
  {usable('normalized_legal_name')} OR {usable('normalized_alternate_name')} AS is_candidate,
  CASE WHEN {usable('normalized_legal_name')} THEN 'usable_legal_name' WHEN {usable('normalized_alternate_name')} THEN 'usable_alternate_name' ELSE 'no_usable_identity' END AS candidate_reason
  FROM named)"""


def _directors(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[0-9]{{1,2}}\\z') AND try_cast({c} AS INTEGER) BETWEEN 1 AND {likelihood.MOST_DIRECTORS} THEN try_cast({c} AS INTEGER) END"


def _signal_conditions() -> dict[str, str]:
    words = "string_split(name_used, ' ')"
    digits = "length(regexp_replace(name_used, '[^0-9]', '', 'g'))"
    low, high = _directors("min_directors"), _directors("max_directors")
    return {
        "eligible_identity_baseline": "true",
        "usable_legal_name": usable("normalized_legal_name"),
        "matched_2024_importer": "has_importer_evidence",
        "usable_alternate_name": f"has_alternate_name AND {usable('normalized_alternate_name')}",
        "recent_annual_filing": f"regexp_matches(last_annual_filing_year, '^[0-9]{{4}}\\z') AND try_cast(last_annual_filing_year AS INTEGER) BETWEEN {likelihood.FILING_YEAR - 1} AND {likelihood.FILING_YEAR}",
        "useful_registered_location": "has_useful_location",
        "minimum_directors_two_or_more": f"coalesce({low}, 0) >= 2",
        "multiple_directors_allowed": f"coalesce({low}, 0) < 2 AND coalesce({high}, 0) >= 2",
        "compact_name": "n_words BETWEEN 1 AND 3",
        "four_word_name": "n_words = 4",
        "concise_distinctive_name": "length(name_used) BETWEEN 4 AND 25 AND NOT is_generic_legal_name AND NOT is_holding_company AND NOT is_investment_entity",
        "operating_word_in_name": f"list_has_any({words}, [{', '.join(repr(w) for w in likelihood.COMMERCIAL_WORDS)}])",
        "numbered_corporation": "is_numbered_corporation",
        "professional_corporation": "is_professional_corporation",
        "investment_entity": "is_investment_entity",
        "holding_company": "is_holding_company",
        "real_estate_holding": "is_real_estate_holding_entity",
        "generic_legal_name": "is_generic_legal_name",
        "management_name": "is_management_company",
        "street_address_name": matches("name_used", likelihood.STREET),
        "numeric_heavy_name": f"{digits} >= 4 AND {digits} / greatest({dense('name_used')}, 1) >= 0.3",
        "possible_personal_service_name": f"n_words = 3 AND {words}[1] IN {listed(likelihood.FIRST_NAMES)} AND regexp_matches({words}[2], '^\\p{{L}}{{3,}}\\z') AND {words}[3] IN {listed(likelihood.PERSONAL_SERVICES)}",
    }


def _scores() -> str:
    rules = likelihood.POINTS
    listed_ = ", ".join(f"CASE WHEN {when} THEN {{'reason': '{r}', 'points': {rules[r][0]}, 'explanation': '{rules[r][1].replace(chr(39), chr(39) * 2)}'}} END" for r, when in _signal_conditions().items())
    return f"""{PROFILES},
used AS (SELECT *, CASE WHEN {usable('normalized_legal_name')} THEN normalized_legal_name ELSE normalized_alternate_name END AS name_used FROM profile WHERE is_candidate),
counted AS (SELECT *, len(list_filter(string_split(name_used, ' '), lambda w: w <> '')) AS n_words FROM used),
signalled AS (SELECT *, list_filter([{listed_}], lambda s: s IS NOT NULL) AS signals FROM counted),
summed AS (SELECT *, list_sum([s.points for s in signals])::INTEGER AS raw FROM signalled),
scored AS (SELECT *, least(100, greatest(0, raw)) AS score,
  list_sort([{{'p': -s.points, 'r': s.reason, 'e': s.explanation}} for s in signals if s.points > 0 AND s.reason <> 'eligible_identity_baseline'])[1].e AS lead,
  list_sort([{{'p': s.points, 'r': s.reason, 'e': s.explanation}} for s in signals if s.points < 0])[1].e AS worst FROM summed),
labelled AS (SELECT *, CASE WHEN score >= {likelihood.HIGH} THEN 'High commercial likelihood' WHEN score >= {likelihood.MEDIUM} THEN 'Medium commercial likelihood' ELSE 'Low commercial likelihood' END AS label,
  CASE WHEN worst IS NOT NULL THEN coalesce(lead, 'A usable identity.') || ' ' || worst ELSE coalesce(lead, 'A usable identity; little else is known.') END AS summary FROM scored)"""


SCORES = _scores()


def matching_sql(exact: int, block: int) -> str:
    """CTEs source, registry, outcome and judged: resolution with the given caps."""
    sim = lambda a: f"CASE WHEN {usable(a)} AND {usable('s_name')} THEN CASE WHEN {a} = s_name THEN 1.0 ELSE 1 - levenshtein({a}, s_name)::DOUBLE / greatest(length({a}), length(s_name)) END ELSE 0.0 END::DOUBLE"
    return f"""{PROFILES},
raw_source AS ({sql_of(SOURCE, 'part')}),
source AS (SELECT *, {company(norm('name'))} AS s_name, {norm('src_city')} AS s_city, {coded(norm('src_province'), identity.REGIONS)} AS s_province,
  {coded(norm('src_country'), identity.COUNTRIES)} AS s_country, upper(replace(coalesce(src_postal, ''), ' ', '')) AS s_postal FROM raw_source),
registry AS (SELECT id, normalized_legal_name AS r_legal, normalized_alternate_name AS r_alternate, n_city AS r_city, n_region AS r_province, n_country AS r_country, upper(replace(postal_code, ' ', '')) AS r_postal
  FROM profile WHERE is_candidate),
exact0 AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id) AS rn FROM source JOIN registry ON (r_legal = s_name OR (r_alternate <> '' AND r_alternate = s_name)) WHERE {usable('s_name')}),
near0 AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id) AS rn FROM source JOIN registry ON r_city = s_city AND r_province = s_province
  WHERE {usable('s_name')} AND key NOT IN (SELECT key FROM exact0) AND {useful_city('s_city')} AND regexp_matches(s_province, '^[A-Z][A-Z]\\z')),
found AS (SELECT *, {exact} AS cap FROM exact0 UNION ALL SELECT *, {block} AS cap FROM near0),
over_cap AS (SELECT key, bool_or(rn > cap) AS truncated FROM found GROUP BY key),
pair AS (SELECT s.*, r.*, {sim('r_legal')} AS sim_l, {sim('r_alternate')} AS sim_a FROM found f JOIN source s USING (key) JOIN registry r USING (id) WHERE rn <= cap),
place AS (SELECT *, greatest(sim_l, sim_a) AS name_similarity, sim_a > sim_l AS alternate_name_match,
  {useful_city('r_city')} AND {useful_city('s_city')} AND r_city = s_city AS city_match, regexp_matches(r_province, '^[A-Z][A-Z]\\z') AND r_province = s_province AS province_match,
  r_country <> '' AND s_country <> '' AND r_country <> s_country AS country_conflict, r_province <> '' AND s_province <> '' AND r_province <> s_province AS province_conflict,
  r_city <> '' AND s_city <> '' AND r_city <> s_city AS city_conflict,
  {usable(relaxed('s_name'))} AND ({relaxed('r_legal')} = {relaxed('s_name')} OR {relaxed('r_alternate')} = {relaxed('s_name')}) AS relaxed_name_equal FROM pair),
graded AS (SELECT *, CASE WHEN country_conflict OR province_conflict THEN 'conflict' WHEN city_match AND province_match THEN 'city_province' WHEN province_match THEN 'province' ELSE 'none' END AS location_match,
  {dense('CASE WHEN alternate_name_match THEN r_alternate ELSE r_legal END')} >= 3 AND {dense('s_name')} >= 3 AS informative_name FROM place),
strong AS (SELECT *, CASE WHEN informative_name AND name_similarity = 1 AND location_match = 'city_province' THEN 'excellent' WHEN informative_name AND name_similarity = 1 AND location_match = 'province' THEN 'strong'
  WHEN informative_name AND name_similarity >= 0.9 AND location_match = 'city_province' THEN 'probable' ELSE 'weak' END AS strength FROM graded),
assessed AS (SELECT *, CASE strength WHEN 'excellent' THEN 0.95 WHEN 'strong' THEN 0.85 WHEN 'probable' THEN 0.7
    ELSE CASE WHEN location_match = 'conflict' THEN least(0.2, name_similarity * 0.2) ELSE least(0.45, greatest(name_similarity, CASE WHEN relaxed_name_equal THEN 0.5 ELSE 0 END) * 0.45) END END::DOUBLE AS match_confidence,
  CASE WHEN name_similarity = 1 THEN 'exact_normalized_name' WHEN relaxed_name_equal THEN 'relaxed_name' ELSE 'fuzzy_name' END AS match_method,
  CASE WHEN regexp_matches(s_postal, '^[A-Z][0-9][A-Z][0-9][A-Z][0-9]\\z') AND regexp_matches(r_postal, '^[A-Z][0-9][A-Z][0-9][A-Z][0-9]\\z') THEN s_postal = r_postal END AS postal_match FROM strong),
kept AS (SELECT *, strength IN ('excellent', 'strong') AND NOT city_conflict AND NOT country_conflict AND NOT province_conflict AS eligible, strength = 'probable' AS probable FROM assessed WHERE name_similarity >= 0.5),
tally AS (SELECT key, count(*) FILTER (eligible) AS n_e, count(*) FILTER (probable) AS n_p, min(id) FILTER (eligible) AS eligible_id FROM kept GROUP BY key),
joined AS (SELECT s.key, coalesce(truncated, false) AS truncated, coalesce(n_e, 0) AS n_e, coalesce(n_p, 0) AS n_p, eligible_id FROM source s LEFT JOIN over_cap USING (key) LEFT JOIN tally USING (key)),
decided AS (SELECT *, CASE WHEN truncated OR n_e > 1 OR (n_e = 0 AND n_p > 1) THEN 'ambiguous' WHEN n_e = 1 THEN 'accepted' WHEN n_p = 1 THEN 'candidate' ELSE 'unmatched' END AS outcome FROM joined),
outcome AS (SELECT key, outcome, CASE WHEN truncated THEN 'retrieval_limit_requires_review' WHEN outcome = 'accepted' THEN 'unique_exact_name_and_location' WHEN outcome = 'ambiguous' THEN 'multiple_plausible_identities'
  WHEN outcome = 'candidate' THEN 'fuzzy_match_requires_review' ELSE 'no_confident_identity' END AS reason, CASE WHEN outcome = 'accepted' THEN eligible_id END AS accepted_id, truncated FROM decided),
judged AS (SELECT k.*, CASE WHEN outcome = 'accepted' AND eligible THEN 'accepted' WHEN outcome = 'ambiguous' AND (truncated OR eligible OR probable) THEN 'ambiguous' WHEN probable THEN 'candidate' ELSE 'rejected' END AS status
  FROM kept k JOIN outcome USING (key))"""
