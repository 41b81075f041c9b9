"""Resolution of outside identities to registry rows: blocked retrieval, assessment, outcome.

Outcomes rest on equal names and on names that are nine tenths alike in one place. Places whose rows overflow the limit
are told by their counts, so no place is joined for them; the others meet in a similarity join. The list of all matches
is made apart, for those who read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.identity import is_region_code, is_usable, is_useful_city, same_postal
from tessera.functions.matching import PROBABLE, assess, registry_facts, source_facts
from tessera.operators import similar
from tessera.operators.store import written

EXACT_LIMIT, BLOCK_LIMIT, LEAST_SIMILARITY = 100, 1000, 0.5
PLACE = ["s_city", "s_province"]


def _capped(keyed: DataFrame, key: list[str], limit: int) -> DataFrame:
    """The first rows of each key by id, with _full: whether it has more. Ranked before any join, so a common name or
    place costs each source no more than the limit; counts tell of the overflow, and Spark cuts groups short before
    they are shuffled for the ranking."""
    full = keyed.groupBy(*key).agg((F.count(F.lit(1)) > limit).alias("_full"))
    first = keyed.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy("id"))).filter(F.col("_rank") <= limit).drop("_rank")
    return first.join(full, key)


def prepared(rows: DataFrame, registry: bool) -> DataFrame:
    """Sources or registry rows with what an assessment asks of each, so that no pair asks again."""
    return rows.withColumns({k: v for k, v in (registry_facts() if registry else source_facts()).items() if k not in rows.columns})


def _names(registry: DataFrame) -> DataFrame:
    return registry.filter("is_candidate").select("id", F.explode(F.array_distinct(F.array("r_legal", "r_alternate"))).alias("s_name")).filter("s_name <> ''")


def _exact(sources: DataFrame, registry: DataFrame, limit: int) -> DataFrame:
    return sources.filter(is_usable(F.col("s_name"))).join(_capped(_names(registry), ["s_name"], limit), "s_name")


def _nearby(sources: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources without an equal name that look at their place, and the registry's rows by place."""
    without = sources.filter(is_usable(F.col("s_name"))).join(_names(registry).select("s_name").distinct(), "s_name", "left_anti").filter(is_useful_city("s_city", True) & is_region_code(F.col("s_province")))
    return without, registry.filter("is_candidate").withColumns({"s_city": F.col("r_city"), "s_province": F.col("r_province")})


def _alike(without: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(PLACE, s_name, id and what else rows has): rows of a source's place with a name `least` alike; names of a place
    are compared once, however many rows have them. rows: id, PLACE, r_legal, r_alternate."""
    named = rows.withColumn("b", F.explode(F.array_distinct(F.array("r_legal", "r_alternate")))).drop("r_legal", "r_alternate")
    found = similar.similar_names(without.select(*PLACE, F.col("s_name").alias("a")), named.select(*PLACE, "b"), PLACE, least)
    # a row whose names are both alike is one row
    return found.select(*PLACE, F.col("a").alias("s_name"), "b").join(named, [*PLACE, "b"]).drop("b").distinct()


def retrieve(sources: DataFrame, registry: DataFrame, exact_limit: int = EXACT_LIMIT, block_limit: int = BLOCK_LIMIT, least: float = 0.0) -> DataFrame:
    """(source columns, registry columns, truncated) for each source and candidate; of candidates by place only those
    `least` alike, if that is above 0.

    sources: key and s_ columns of matching.source_identity. registry: id, is_candidate and r_ columns. Rows of
    equal name come first; only sources that have none look at their city and province.
    """
    without, places = _nearby(sources, registry)
    first = _capped(places.select("id", *PLACE, "r_legal", "r_alternate"), PLACE, block_limit)
    near = without.join(_alike(without, first, least), [*PLACE, "s_name"]) if least > 0 else without.join(first.drop("r_legal", "r_alternate"), PLACE)
    # a source has equal names or looks at its one place: all its rows say the same
    found = _exact(sources, registry, exact_limit).unionByName(near).withColumnRenamed("_full", "truncated")
    return found.join(registry.drop("is_candidate"), "id")


def _graded(matches: DataFrame) -> DataFrame:
    c = F.col
    return matches.withColumns({"eligible": c("strength").isin("excellent", "strong") & ~c("city_conflict") & ~c("country_conflict") & ~c("province_conflict"), "probable": c("strength") == "probable"})


def outcomes(sources: DataFrame, registry: DataFrame, exact_limit: int = EXACT_LIMIT, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """(key, outcome, reason, accepted_id, truncated) for all sources. A source whose retrieval overflowed is ambiguous
    whatever it found, and its place is not looked through."""
    c = F.col
    exact = written(_exact(sources, registry, exact_limit), "exact")
    over_name = exact.groupBy("key").agg(F.max("_full").alias("truncated"))
    same = exact.drop("_full").join(registry.drop("is_candidate"), "id")
    without, places = _nearby(sources, registry)
    without, full = written(without, "without"), places.groupBy(*PLACE).agg((F.count(F.lit(1)) > block_limit).alias("truncated"))
    placed = without.join(full, PLACE)
    open_ = placed.filter("NOT truncated").drop("truncated")
    within = places.join(full.filter("NOT truncated").select(*PLACE), PLACE, "left_semi")
    ids = _alike(open_, within.select("id", *PLACE, "r_legal", "r_alternate"), PROBABLE)
    near = open_.join(ids, [*PLACE, "s_name"]).join(registry.drop("is_candidate"), "id")
    pairs = _graded(assess(same.unionByName(near, allowMissingColumns=True), PROBABLE))
    sums = pairs.groupBy("key").agg(F.count_if("eligible").alias("n_eligible"), F.count_if("probable").alias("n_probable"), F.min(F.when(c("eligible"), c("id"))).alias("eligible_id"))
    over = over_name.unionByName(placed.select("key", "truncated")).groupBy("key").agg(F.max("truncated").alias("truncated"))
    none = F.lit(0).cast("long")
    joined = sources.select("key").join(over, "key", "left").join(sums, "key", "left").select("key", F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("n_eligible", none).alias("n_eligible"), F.coalesce("n_probable", none).alias("n_probable"), "eligible_id")
    outcome = F.when(c("truncated") | (c("n_eligible") > 1) | ((c("n_eligible") == 0) & (c("n_probable") > 1)), "ambiguous").when(c("n_eligible") == 1, "accepted").when(c("n_probable") == 1, "candidate").otherwise("unmatched")
    reason = F.when(c("truncated"), "retrieval_limit_requires_review").when(c("outcome") == "accepted", "unique_exact_name_and_location").when(c("outcome") == "ambiguous", "multiple_plausible_identities").when(c("outcome") == "candidate", "fuzzy_match_requires_review").otherwise("no_confident_identity")
    return joined.withColumn("outcome", outcome).withColumn("reason", reason).withColumn("accepted_id", F.when(c("outcome") == "accepted", c("eligible_id"))).select("key", "outcome", "reason", "accepted_id", "truncated")


def judged(sources: DataFrame, registry: DataFrame, decided: DataFrame, exact_limit: int = EXACT_LIMIT, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """(key, id, assessment, status) of all pairs that are half alike, given the outcomes of all sources."""
    c = F.col
    pairs = retrieve(sources, registry, exact_limit, block_limit, LEAST_SIMILARITY)
    matches = _graded(assess(pairs, LEAST_SIMILARITY).withColumn("postal_match", same_postal("s_postal", "r_postal")))
    status = (
        F.when((c("outcome") == "accepted") & c("eligible"), "accepted")
        .when((c("outcome") == "ambiguous") & (c("_over") | c("eligible") | c("probable")), "ambiguous")
        .when(c("probable"), "candidate")
        .otherwise("rejected")
    )
    return matches.join(decided.select("key", "outcome", c("truncated").alias("_over")), "key").withColumn("status", status).drop("_over", "match_status")


def resolve(sources: DataFrame, registry: DataFrame, exact_limit: int = EXACT_LIMIT, block_limit: int = BLOCK_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(outcomes: key, outcome, reason, accepted_id; matches: key, id, assessment, status), for all sources."""
    sources, registry = prepared(sources, False), prepared(registry, True)
    decided = written(outcomes(sources, registry, exact_limit, block_limit), "outcomes")
    return decided.drop("truncated"), judged(sources, registry, decided, exact_limit, block_limit)


def best_first(matches: DataFrame) -> DataFrame:
    """matches with place: 1 for the most confident of each source, ties by id."""
    return matches.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy(F.desc("match_confidence"), "id")))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row: matched, ambiguous and unmatched sources, and of the unmatched those with one probable match."""
    n = lambda *v: F.count_if(F.col("outcome").isin(*v)).cast("long")
    return outcomes.agg(n("accepted").alias("matched"), n("ambiguous").alias("ambiguous"), n("unmatched", "candidate").alias("unmatched"), n("candidate").alias("probable"))
