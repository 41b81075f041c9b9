"""Named queries over the driver's tables, each with the same question in DuckDB SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import identity, matching
from tessera.functions.text import clean, normalise_text
from tessera.operators import changes, evidence, hash_tree, icp, resolution, search, similar, verify
from tessera.operators.store import Store, shared_path
from tessera.plans.entities import (
    ACCOUNT,
    PROFILES,
    SCORES,
    accounts,
    coded,
    company,
    matches,
    matching_sql,
    norm,
    order_ranks,
    registry,
    sources,
    sql_of,
    stored,
    table,
    usable,
    useful_city,
)
from tessera.sources import csv_ranges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "ranked_search"
FLAG_LIST = ", ".join(identity.FLAGS)


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that has to give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- text and identity functions


@query(f"SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned, {norm('text')} AS words FROM documents")
def text_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(clean("text"), F.lit("")).alias("cleaned"), normalise_text("text").alias("words"))


@query(f"WITH {PROFILES} SELECT id, normalized_legal_name AS name, relaxed_legal_name AS relaxed, normalized_alternate_name AS alternate FROM profile")
def company_names(spark, sf_dir):
    rows = accounts(spark, sf_dir)
    name = identity.company_name("legal_name")
    return rows.select("id", name.alias("name"), identity.relaxed_name(name).alias("relaxed"), identity.company_name("alternate_name").alias("alternate"))


@query(f"SELECT n_nationkey, {coded(norm('n_name'), identity.COUNTRIES)} AS country, {coded(norm('n_name'), identity.REGIONS)} AS region FROM nation")
def region_country(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", identity.country("n_name").alias("country"), identity.region("n_name").alias("region"))


@query(f"""WITH a AS ({sql_of(ACCOUNT, 'part')}), b AS (SELECT id, postal_code, upper(replace(trim(postal_code), ' ', '')) AS d, province_normalized AS p FROM a)
SELECT id, CASE WHEN {matches('d', identity.POSTAL_CODE)} THEN substr(d, 1, 3) || ' ' || substr(d, 4, 3) ELSE trim(postal_code) END AS postal, CASE WHEN upper(p) = 'NF' THEN 'NL' ELSE upper(p) END AS province FROM b""")
def postal_province(spark, sf_dir):
    return accounts(spark, sf_dir).select("id", identity.postal_code("postal_code").alias("postal"), identity.province_code("province_normalized").alias("province"))


@query(f"WITH n AS (SELECT c_custkey, {norm('c_name')} AS n FROM customer) SELECT c_custkey, {matches('n', identity.NUMBERED)} AS numbered, {usable('n')} AS usable, {useful_city('n')} AS city FROM n")
def usable_names(spark, sf_dir):
    n = F.col("n")
    return table(spark, sf_dir, "customer").select("c_custkey", normalise_text("c_name").alias("n")).select("c_custkey", identity.is_numbered(n).alias("numbered"), identity.is_usable(n).alias("usable"), identity.is_useful_city(n, True).alias("city"))


@query(f"WITH {PROFILES} SELECT id, {FLAG_LIST}, is_candidate, candidate_reason FROM profile")
def profile_flags(spark, sf_dir):
    return stored(spark, sf_dir, "profiles").select("id", *identity.FLAGS, "is_candidate", "candidate_reason")


@query(f"WITH {PROFILES} SELECT count(*) AS profiles, {', '.join(f'sum({f}::INTEGER)::BIGINT AS {f}' for f in (*identity.FLAGS, 'is_candidate'))}, (SELECT count(*) FROM part) - count(*) AS missing_or_stale FROM profile WHERE updated_at < 90")
def profile_flag_sums(spark, sf_dir):
    rows = stored(spark, sf_dir, "profiles")
    return identity.flag_sums(rows.filter("updated_at < 90"), table(spark, sf_dir, "part").count())


@query(f"WITH {PROFILES}, f AS (SELECT id, unnest([{', '.join(f'CASE WHEN {f} THEN {chr(39)}{f}{chr(39)} END' for f in identity.FLAGS)}]) AS flag FROM profile) SELECT flag, id FROM (SELECT flag, id, row_number() OVER (PARTITION BY flag ORDER BY id) AS n FROM f WHERE flag IS NOT NULL) WHERE n <= 5")
def flag_samples(spark, sf_dir):
    return verify.samples(stored(spark, sf_dir, "profiles"), list(identity.FLAGS))


@query(f"WITH {PROFILES} SELECT id, normalized_legal_name, candidate_reason FROM profile WHERE is_candidate AND updated_at < 90 AND id > 50 ORDER BY id LIMIT 100")
def candidates_keyset(spark, sf_dir):
    fresh = stored(spark, sf_dir, "profiles").filter("is_candidate AND updated_at < 90")
    return search.keyset(fresh.select("id", "normalized_legal_name", "candidate_reason"), after=50, limit=100)


# ---- imports and incremental maintenance

_DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


@query("SELECT row_number() OVER (ORDER BY doc_id) AS ordinal, false AS ragged, doc_id::VARCHAR AS doc_id, text, lang, source, n_chars::VARCHAR AS n_chars FROM documents")
def csv_in_ranges(spark, sf_dir):
    """The documents as one quoted CSV file in the order of their ids, whose texts span lines, read in ranges."""
    path = shared_path(spark, "csv")
    rows = table(spark, sf_dir, "documents").select(*_DOCUMENT)
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    found = csv_ranges.records(spark, path, most=1 << 28)
    # each file has its header: the files before a record are counted by their headers
    heads = found.filter("heads").select("ordinal").withColumn("before", F.row_number().over(W.orderBy("ordinal"))).withColumn("upto", F.lead("ordinal").over(W.orderBy("ordinal")))
    numbered = found.filter("NOT heads").alias("r").join(F.broadcast(heads.alias("h")), F.expr("r.ordinal > h.ordinal AND (h.upto IS NULL OR r.ordinal < h.upto)"))
    return csv_ranges.cells(numbered.select((F.col("r.ordinal") - F.col("before")).alias("ordinal"), "record"), list(_DOCUMENT))



CHANGED = "o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END"


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def import_first_wins(spark, sf_dir):
    return changes.first_wins(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).filter("rn = 1").select("user_id", "event_id", "event_type")


def _orders_import(spark, sf_dir) -> DataFrame:
    """Orders as a file that repeats some keys, against a stored snapshot that lacks some and differs in others."""
    orders = table(spark, sf_dir, "orders")
    stored = orders.filter("o_orderkey % 5 <> 0").select("o_orderkey", F.col("o_totalprice").alias("content"))
    file = orders.select("o_orderkey", F.expr(CHANGED).alias("content"), F.lit(1).alias("line"))
    again = file.filter("o_orderkey % 11 = 0").withColumn("line", F.lit(2))
    first = changes.first_wins(file.unionByName(again), ["o_orderkey"], ["line"])
    kinds = changes.classify(first, stored, "o_orderkey", "content")
    return kinds.withColumn("action", F.when(F.col("o_orderkey") % 13 == 0, "invalid").when(F.col("rn") > 1, "duplicate").otherwise(F.col("action")))


_IMPORT_SQL = f"""stored AS (SELECT o_orderkey, o_totalprice AS content FROM orders WHERE o_orderkey % 5 <> 0),
file AS (SELECT o_orderkey, {CHANGED} AS content, 1 AS line FROM orders UNION ALL SELECT o_orderkey, {CHANGED}, 2 FROM orders WHERE o_orderkey % 11 = 0),
classed AS (SELECT f.o_orderkey, f.line, CASE WHEN f.o_orderkey % 13 = 0 THEN 'invalid' WHEN row_number() OVER (PARTITION BY f.o_orderkey ORDER BY line) > 1 THEN 'duplicate'
  WHEN s.o_orderkey IS NULL THEN 'insert' WHEN s.content = f.content THEN 'skip' ELSE 'update' END AS action FROM file f LEFT JOIN stored s USING (o_orderkey))"""


@query(f"WITH {_IMPORT_SQL} SELECT o_orderkey, line, action FROM classed")
def import_classify(spark, sf_dir):
    return _orders_import(spark, sf_dir).select("o_orderkey", "line", "action")


@query(f"WITH {_IMPORT_SQL} SELECT count(*) AS processed, count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action IN ('skip', 'duplicate')) AS skipped, count(*) FILTER (action = 'invalid') AS invalid, count(*) FILTER (action = 'duplicate') AS duplicates FROM classed")
def import_report(spark, sf_dir):
    return changes.import_report(_orders_import(spark, sf_dir))


@query("SELECT c_custkey, 1000 + row_number() OVER (ORDER BY c_custkey) AS id FROM customer")
def surrogate_ids(spark, sf_dir):
    return changes.new_ids(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 1000)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 4 = 0 OR o_custkey % 9 = 0 OR o_orderkey % 10 = 0")
def stale_backfill(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(1).alias("updated_at"))
    derived = orders.filter("o_custkey % 4 <> 0").select("o_orderkey", F.when(F.col("o_custkey") % 9 == 0, "v1").otherwise("v2").alias("version"), F.when(F.col("o_orderkey") % 10 == 0, 0).otherwise(1).alias("source_updated_at"))
    return changes.stale(orders, derived, "o_orderkey", "v2").select("o_orderkey", "o_custkey")


@query("""SELECT coalesce(s.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN list_contains(provided, 's_name') THEN n.s_name ELSE s.s_name END AS s_name, CASE WHEN list_contains(provided, 's_acctbal') THEN n.s_acctbal ELSE s.s_acctbal END AS s_acctbal
FROM (SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 6 <> 0) s FULL JOIN
(SELECT s_suppkey, upper(s_name) AS s_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal + 1 END AS s_acctbal, CASE WHEN s_suppkey % 2 = 0 THEN ['s_acctbal'] ELSE ['s_name', 's_acctbal'] END AS provided FROM supplier WHERE s_suppkey % 3 = 0) n ON s.s_suppkey = n.s_suppkey""")
def upsert_partial(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = rows.filter("s_suppkey % 3 = 0").select("s_suppkey", F.upper("s_name").alias("s_name"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal") + 1).alias("s_acctbal"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("s_acctbal"))).otherwise(F.array(F.lit("s_name"), F.lit("s_acctbal"))).alias("provided"))
    return changes.patch(rows.filter("s_suppkey % 6 <> 0"), new, ["s_suppkey"])


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS confidence, CASE WHEN s_suppkey % 6 = 0 THEN 'candidate' ELSE 'accepted' END AS match_status FROM supplier""")
def upsert_keep_decision(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("confidence"), F.lit("accepted").alias("match_status"))
    new = rows.filter("s_suppkey % 3 = 0").select("s_suppkey", (F.col("confidence") + 1).alias("confidence"), F.lit("candidate").alias("match_status"))
    return changes.upsert(rows.filter("s_suppkey % 6 <> 0"), new, ["s_suppkey"], kept=("match_status",))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 1013 = 0 THEN 'created' WHEN o_orderkey % 1009 = 0 THEN 'removed' ELSE 'updated' END AS change FROM orders
WHERE (o_orderkey % 1013 = 0) <> (o_orderkey % 1009 = 0) OR (o_orderkey % 997 = 0 AND o_orderkey % 1013 <> 0 AND o_orderkey % 1009 <> 0)""")
def changed_keys(spark, sf_dir):
    """Keys of orders that two versions don't have alike, from the ranges whose digests differ."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    before = orders.filter("o_orderkey % 1013 <> 0")
    after = orders.filter("o_orderkey % 1009 <> 0").withColumn("o_totalprice", F.expr("o_totalprice + CASE WHEN o_orderkey % 997 = 0 THEN 1 ELSE 0 END"))
    trees = [hash_tree.HashTree.build(rows, "o_orderkey", shared_path(spark, "tree"), 256) for rows in (before, after)]
    return hash_tree.changed_keys(*trees)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 50 = 0 AND c_custkey % 100 = 0 THEN 'new' ELSE 'old' END AS status FROM customer WHERE c_custkey % 70 <> 0""")
def bucket_upsert(spark, sf_dir):
    """Customers in buckets after a batch that inserts, updates and removes some: only the buckets of its keys are written."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    store = Store(spark, shared_path(spark, "buckets"))
    store.commit_buckets("customer", rows.filter("c_custkey % 100 <> 0").withColumn("status", F.lit("old")), ["c_custkey"])
    some = rows.filter("c_custkey % 50 = 0").select("c_custkey", F.concat(F.upper("segment"), F.lit("!")).alias("segment"), F.lit("new").alias("status"))
    store.upsert_buckets("customer", some, ("status",), rows.filter("c_custkey % 70 = 0"))
    return store.read_buckets("customer")


# ---- search and access

_PROVINCE = "CASE WHEN province_normalized = 'NF' THEN 'NL' ELSE province_normalized END"
# the tokenizer of search in SQL's own terms: accents off, lower case, runs of letters and digits
_TOKENS = "list_filter(regexp_split_to_array(lower(strip_accents(concat_ws(' ', legal_name, alternate_name, source_id, business_number, city))), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def _hits(*words: str, source: str | None = None) -> str:
    tests = " AND ".join(f"len(list_filter(tokens, lambda w: starts_with(w, '{x}'))) > 0" for x in words)
    return f"WITH a AS ({source or sql_of(ACCOUNT, 'part')}), t AS (SELECT *, {_TOKENS} AS tokens FROM a), hit AS (SELECT id, legal_name, city, province_normalized FROM t WHERE {tests})"


_SHOWN = ("id", "legal_name", "city", "province_normalized")


def _page(n: int) -> str:
    """A page of the hits: the last one where there are fewer."""
    return f"SELECT * FROM hit ORDER BY id LIMIT {search.PAGE} OFFSET (SELECT greatest(0, least({n}, (count(*) + {search.PAGE - 1}) // {search.PAGE}) - 1) * {search.PAGE} FROM hit)"


@query(f"{_hits('re', 'wid')} {_page(2)}")
def search_prefix_page(spark, sf_dir):
    hits = search.filtered(accounts(spark, sf_dir), "Ré wid", tokens=stored(spark, sf_dir, "index")).select(*_SHOWN)
    return search.page_of(hits, 2, ["id"])[0]


@query(f"{_hits('ser')} SELECT * FROM hit WHERE province_normalized = 'ON' ORDER BY id LIMIT 25")
def search_province_page(spark, sf_dir):
    hits = search.filtered(accounts(spark, sf_dir), "ser", " ontario ", tokens=stored(spark, sf_dir, "index")).select(*_SHOWN)
    return search.page_of(hits, float("nan"), ["id"])[0]


@query(f"{_hits('gear')} SELECT count(*) AS total, (count(*) + 24) // 25 AS pages FROM hit")
def search_total(spark, sf_dir):
    hits = search.matching_ids(stored(spark, sf_dir, "index"), search.query_words("gear"))
    return hits.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / search.PAGE))


@query(f"WITH a AS ({sql_of(ACCOUNT, 'part')}) SELECT DISTINCT id, unnest({_TOKENS}) AS token FROM a")
def search_index(spark, sf_dir):
    return search.index(accounts(spark, sf_dir))


# customers by names with apostrophes and ampersands
_QUOTED = {"id": "c_custkey", "legal_name": "CASE c_custkey % 4 WHEN 0 THEN concat('O''Brien & Fils ', c_name) WHEN 1 THEN concat('L’Oréal-Groupe ', c_name) WHEN 2 THEN concat('AT&T n°', c_custkey) ELSE c_name END", "alternate_name": "c_mktsegment", "source_id": "c_custkey::string", "business_number": "''", "city": "''", "province_normalized": "'ON'"}


@query(f"{_hits('o', 'brien', source=sql_of(_QUOTED, 'customer'))} SELECT 'O''Brien' AS asked, id, legal_name FROM hit UNION ALL ({_hits('l', 'oreal', 'groupe', source=sql_of(_QUOTED, 'customer'))} SELECT 'L''Oréal-groupe' AS asked, id, legal_name FROM hit) UNION ALL ({_hits('at', 't', source=sql_of(_QUOTED, 'customer'))} SELECT 'AT&T' AS asked, id, legal_name FROM hit)")
def search_apostrophes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {n}" for n, e in _QUOTED.items()))
    found = [search.filtered(rows, asked, tokens=search.index(rows) if k else None).select(F.lit(asked).alias("asked"), "id", "legal_name") for k, asked in enumerate(("O'Brien", "L'Oréal-groupe", "AT&T"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"WITH {SCORES}, t AS (SELECT *, {_TOKENS} AS tokens FROM labelled) SELECT id, legal_name, score, label FROM t WHERE len(list_filter(tokens, lambda w: starts_with(w, 'wid'))) > 0 ORDER BY score DESC, id LIMIT 25")
def ranked_search(spark, sf_dir):
    hits = search.matching_ids(stored(spark, sf_dir, "index"), search.query_words("wid"))
    rows = stored(spark, sf_dir, "scores").join(hits, "id", "left_semi").select("id", "legal_name", "score", "label")
    return rows.orderBy(F.desc("score"), "id").limit(search.PAGE)


@query(f"WITH {SCORES} SELECT id, score FROM labelled WHERE score < 66 OR (score = 66 AND id > 100) ORDER BY score DESC, id LIMIT 200")
def ranked_keyset(spark, sf_dir):
    return search.ranked_keyset(stored(spark, sf_dir, "scores").select("id", "score"), 66, 100, 200)


_RANKED = "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place, count(*) OVER (PARTITION BY o_totalprice) AS tied FROM orders"


@query(f"SELECT o_orderkey, o_totalprice, place FROM ({_RANKED}) WHERE place BETWEEN 1001 AND 1025")
def rank_page(spark, sf_dir):
    return order_ranks(spark, sf_dir).page(1000, 25)


@query(f"SELECT o_orderkey, o_totalprice FROM ({_RANKED}) WHERE o_totalprice < (SELECT o_totalprice FROM orders WHERE o_orderkey = 77) OR (o_totalprice = (SELECT o_totalprice FROM orders WHERE o_orderkey = 77) AND o_orderkey > 77) ORDER BY place LIMIT 200")
def rank_keyset(spark, sf_dir):
    at = table(spark, sf_dir, "orders").filter("o_orderkey = 77").first()
    return order_ranks(spark, sf_dir).after(at.o_totalprice, at.o_orderkey, 200)


@query(f"SELECT * FROM ({_RANKED}) WHERE place BETWEEN 748 AND 752")
def rank_neighbours(spark, sf_dir):
    return order_ranks(spark, sf_dir).around(750)


_LATER = ACCOUNT | {"city": f"CASE WHEN p_partkey % 7 = 0 THEN concat('Port ', p_brand) ELSE {ACCOUNT['city']} END"}


@query(f"WITH a AS ({sql_of(_LATER, 'part', 'p_partkey % 11 <> 0')}) SELECT DISTINCT id, unnest({_TOKENS}) AS token FROM a")
def index_layers(spark, sf_dir):
    """The search index after an insert, an update and a delete batch, from the layers that they add."""
    first, later = (table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in view.items())) for view in (ACCOUNT, _LATER))
    had = first.filter("id % 5 <> 0")
    tokens, dead = search.base_layer(had, 0), had.select("id").limit(0).withColumn("layer", F.lit(0).cast("long"))
    batches = ((first.filter("id % 5 = 0"), None), (later.filter("id % 7 = 0"), None), (later.limit(0), first.filter("id % 11 = 0")))
    for layer, (changed, removed) in enumerate(batches, 1):
        known = had if layer == 1 else first
        more, ended = search.layer_of(changed, known, removed, layer)
        tokens, dead = tokens.unionByName(more), dead.unionByName(ended)
    return search.live(tokens, dead)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_row(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id", "event_type")


# ---- resolution

_RESOLVED = f"WITH {matching_sql(resolution.EXACT_LIMIT, resolution.BLOCK_LIMIT)}"


def _outcomes(spark, sf_dir):
    return resolution.outcomes(sources(spark, sf_dir), registry(spark, sf_dir))


def _judged(spark, sf_dir):
    return resolution.resolve(sources(spark, sf_dir), registry(spark, sf_dir))[1]


@query(f"{_RESOLVED} SELECT key, id FROM found WHERE rn <= cap")
def retrieval(spark, sf_dir):
    return resolution.retrieve(sources(spark, sf_dir), registry(spark, sf_dir)).select("key", "id")


@query(f"{_RESOLVED} SELECT key, truncated FROM over_cap")
def retrieval_overflow(spark, sf_dir):
    pairs = resolution.retrieve(sources(spark, sf_dir), registry(spark, sf_dir))
    return pairs.groupBy("key").agg(F.max("truncated").alias("truncated"))


@query(f"{_RESOLVED} SELECT key, id, round(name_similarity, 9) AS name_similarity, alternate_name_match, location_match, strength, round(match_confidence, 9) AS match_confidence, match_method, postal_match, status FROM judged")
def pair_assessment(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    return rows.select("key", "id", F.round("name_similarity", 9).alias("name_similarity"), "alternate_name_match", "location_match", "strength", F.round("match_confidence", 9).alias("match_confidence"), "match_method", "postal_match", "status")


@query(f"{_RESOLVED} SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY match_confidence DESC, id)::INTEGER AS place FROM judged QUALIFY place <= 3")
def best_matches(spark, sf_dir):
    return resolution.best_first(_judged(spark, sf_dir)).filter("place <= 3").select("key", "id", "place")


@query(f"{_RESOLVED} SELECT key, outcome, reason, accepted_id FROM outcome")
def resolution_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).drop("truncated")


@query(f"{_RESOLVED} SELECT count(*) FILTER (outcome = 'accepted') AS matched, count(*) FILTER (outcome = 'ambiguous') AS ambiguous, count(*) FILTER (outcome IN ('unmatched', 'candidate')) AS unmatched, count(*) FILTER (outcome = 'candidate') AS probable FROM outcome")
def outcome_counts(spark, sf_dir):
    return resolution.outcome_counts(_outcomes(spark, sf_dir))


@query(f"{_RESOLVED} SELECT outcome, reason, count(*) AS n FROM outcome GROUP BY ALL")
def outcome_histogram(spark, sf_dir):
    return _outcomes(spark, sf_dir).groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_RESOLVED} SELECT strength, count(*) AS n, sum(alternate_name_match::INTEGER)::BIGINT AS alternates, sum(coalesce(postal_match, false)::INTEGER)::BIGINT AS postal_equal FROM judged WHERE status = 'accepted' GROUP BY strength")
def accepted_by_strength(spark, sf_dir):
    rows = _judged(spark, sf_dir).filter("status = 'accepted'")
    return rows.groupBy("strength").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("alternate_name_match").cast("int")).alias("alternates"), F.sum(F.coalesce("postal_match", F.lit(False)).cast("int")).alias("postal_equal"))


@query(f"{_RESOLVED} SELECT count(*) AS unsafe FROM judged WHERE status = 'accepted' AND (NOT eligible OR postal_match = false AND city_conflict)")
def unsafe_matches(spark, sf_dir):
    return _judged(spark, sf_dir).filter("status = 'accepted' AND (NOT eligible OR postal_match = false AND city_conflict)").agg(F.count(F.lit(1)).alias("unsafe"))


@query(f"WITH a AS (SELECT p_partkey, p_brand, p_type, {company(norm('p_name'))} AS n FROM part), p AS (SELECT x.p_partkey AS a, y.p_partkey AS b, x.n AS n, y.n AS m FROM a x JOIN a y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_partkey < y.p_partkey) SELECT a, b, round(CASE WHEN n = m THEN 1 ELSE 1 - levenshtein(n, m)::DOUBLE / greatest(length(n), length(m)) END, 9) AS similarity FROM p")
def name_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", identity.company_name("p_name").alias("n"))

    def alike(n, m):
        """As the SQL has it: two empty names are alike, and long ones are compared too."""
        return F.round(F.when(n == m, 1.0).otherwise(1 - F.levenshtein(n, m) / F.greatest(F.length(n), F.length(m))), 9)

    return similar.all_pairs(rows, ["p_brand", "p_type"], "p_partkey", "n", alike)


_ALIKE = "CASE WHEN a = b THEN 1 ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END"


@query(f"""{_RESOLVED}, l AS (SELECT s_province AS province, s_name AS a, count(*) AS n_sources FROM source WHERE s_name <> '' GROUP BY ALL),
r AS (SELECT r_province AS province, r_legal AS b, count(*) AS n_rows FROM registry WHERE r_legal <> '' GROUP BY ALL)
SELECT province, a, b, n_sources, n_rows, round({_ALIKE}, 9) AS similarity FROM l JOIN r USING (province) WHERE abs(length(a) - length(b)) <= 0.1 * greatest(length(a), length(b)) + 0.001 AND {_ALIKE} >= 0.9""")
def similar_names(spark, sf_dir):
    """Names that are nine tenths alike in each province, whatever its size."""
    left = sources(spark, sf_dir).filter("s_name <> ''").groupBy(F.col("s_province").alias("province"), F.col("s_name").alias("a")).agg(F.count(F.lit(1)).alias("n_sources"))
    right = registry(spark, sf_dir).filter("is_candidate AND r_legal <> ''").groupBy(F.col("r_province").alias("province"), F.col("r_legal").alias("b")).agg(F.count(F.lit(1)).alias("n_rows"))
    found = similar.similar_names(left, right, ["province"], matching.PROBABLE)
    return found.join(left, ["province", "a"]).join(right, ["province", "b"]).select("province", "a", "b", "n_sources", "n_rows", F.round("similarity", 9).alias("similarity"))


# ---- evidence

_DAY = "event_id % 2 = 0"


@query("""SELECT user_id, true AS present, count(*) AS n_rows, count(DISTINCT json_extract(props, '$.k')) AS n_k, max(json_extract(props, '$.k')::DOUBLE) AS max_k FROM events GROUP BY user_id""")
def signal_aggregates(spark, sf_dir):
    wanted = [evidence.Signal("present", "presence"), evidence.Signal("n_rows", "row_count"), evidence.Signal("n_k", "distinct_count", "k"), evidence.Signal("max_k", "max_number", "k")]
    return evidence.aggregate(table(spark, sf_dir, "events"), "user_id", "props", wanted)


@query(f"""WITH old AS (SELECT event_type AS source, user_id, count(*) AS v FROM events WHERE {_DAY} GROUP BY ALL), new AS (SELECT event_type AS source, user_id, count(*) AS v FROM events WHERE NOT ({_DAY}) AND event_type = 'click' GROUP BY ALL)
SELECT source, user_id, v AS value_number, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 1 END AS run_id FROM old WHERE (source <> 'click' OR user_id % 5 = 0) AND NOT (source = 'click' AND user_id IN (SELECT user_id FROM new)) UNION ALL SELECT source, user_id, v, 2 FROM new""")
def evidence_publish(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    count = lambda rows: rows.groupBy(F.col("event_type").alias("source"), "user_id").agg(F.count(F.lit(1)).alias("value_number"))
    published = count(events.filter(_DAY)).withColumn("run_id", F.when(F.col("user_id") % 5 != 0, 1))
    return changes.publish(published, count(events.filter(f"NOT ({_DAY}) AND event_type = 'click'")), ["source", "user_id"], "click", 2)


_VERSION = "SELECT event_type, user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_id % 4 <> {} GROUP BY ALL"


@query(f"""SELECT event_type, user_id, CASE WHEN o.n IS NULL THEN 'created' WHEN w.n IS NULL THEN 'removed' WHEN o.n = w.n AND o.last = w.last THEN 'same' ELSE 'updated' END AS change, o.n AS n_before, w.n AS n_after
FROM ({_VERSION.format(1)}) o FULL JOIN ({_VERSION.format(2)}) w USING (event_type, user_id)""")
def change_feed(spark, sf_dir):
    """What became of each observation between two versions."""
    events = table(spark, sf_dir, "events")
    version = lambda k: events.filter(f"event_id % 4 <> {k}").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    moved = changes.diff(version(1), version(2), ["event_type", "user_id"], ["n", "last"])
    return moved.select("event_type", "user_id", "change", F.col("before.n").alias("n_before"), F.col("after.n").alias("n_after"))


@query("""WITH old AS (SELECT o_custkey AS source_key, count(*) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), new AS (SELECT o_custkey AS source_key, count(*) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
ids AS (SELECT source_key, row_number() OVER (ORDER BY source_key) AS id FROM old), top AS (SELECT max(id) AS m FROM ids),
fresh AS (SELECT source_key, (SELECT m FROM top) + row_number() OVER (ORDER BY source_key) AS id FROM new WHERE source_key NOT IN (SELECT source_key FROM old))
SELECT n.source_key, n.v AS value_number, coalesce(i.id, f.id) AS id, CASE WHEN i.id IS NULL THEN 'b' ELSE 'a' END AS created_at, 'b' AS updated_at FROM new n LEFT JOIN ids i USING (source_key) LEFT JOIN fresh f USING (source_key)""")
def observation_ids(spark, sf_dir):
    """Observations of one source after two runs: ids and creation times stay with their keys, new ones follow."""
    orders = table(spark, sf_dir, "orders")
    run = lambda where: orders.filter(where).groupBy(F.col("o_custkey").alias("source_key")).agg(F.count(F.lit(1)).alias("value_number")).withColumn("source", F.lit("s"))
    none = spark.createDataFrame([], "source string, source_key long, value_number long, run_id long, id long, created_at string, updated_at string")
    first = changes.feed(none, run("o_orderkey % 3 <> 0"), ["source", "source_key"], "s", 1, "a", 0)[0]
    after = first.agg(F.max("id")).first()[0]
    second = changes.feed(first, run("o_orderkey % 2 = 0"), ["source", "source_key"], "s", 2, "b", after)[0]
    return second.select("source_key", "value_number", "id", "created_at", "updated_at")


_URGENT = "o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0"


@query(f"SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_URGENT}) AS has_evidence FROM customer")
def evidence_exists(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").filter(_URGENT).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("s", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(seen, "c_custkey", "left").select("c_custkey", F.coalesce("s", F.lit(False)).alias("has_evidence"))


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {_URGENT})")
def evidence_semi(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").filter(_URGENT).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(seen, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_URGENT})")
def evidence_anti(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").filter(_URGENT).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS shown FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) ON l_orderkey = o_orderkey WHERE rn <= 3 GROUP BY o_orderkey")
def provenance_first_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))).filter("rn <= 3")
    lists = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("shown"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lists, "o_orderkey")


@query("SELECT c_custkey, o_orderkey, l_linenumber, l_partkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND l_quantity > 45")
def provenance_three_way(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return c.join(o, "c_custkey").join(lines, "o_orderkey").select("c_custkey", "o_orderkey", "l_linenumber", "l_partkey")


@query("SELECT sha256(string_agg(k || chr(10), '' ORDER BY k)) AS digest FROM (SELECT DISTINCT o_custkey AS k FROM orders)")
def evidence_hash(spark, sf_dir):
    return verify.presence_hash(table(spark, sf_dir, "orders"), "o_custkey")


_RANGES = f"SELECT r // {verify.RANGE} AS r, sha256(string_agg(d || chr(10), '' ORDER BY r)) AS d FROM"


@query(f"SELECT sha256(string_agg(d || chr(10), '' ORDER BY r)) AS digest FROM ({_RANGES} ({_RANGES} (SELECT DISTINCT o_custkey AS r, o_custkey::VARCHAR AS d FROM orders) GROUP BY ALL) GROUP BY ALL)")
def evidence_range_hash(spark, sf_dir):
    return verify.range_hash(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT coalesce(max(o_orderkey) FILTER (o_orderstatus = 'F'), 0) AS watermark FROM orders")
def change_watermark(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.coalesce(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))), F.lit(0)).alias("watermark"))


# ---- scores


@query(f"WITH {SCORES} SELECT id, s.reason AS reason, s.points AS points FROM (SELECT id, unnest(signals) AS s FROM labelled)")
def score_signals(spark, sf_dir):
    return stored(spark, sf_dir, "scores").select("id", F.inline("signals")).select("id", "reason", "points")


@query(f"WITH {SCORES} SELECT id, name_used, raw, score, label, summary FROM labelled")
def score_labels(spark, sf_dir):
    return stored(spark, sf_dir, "scores").select("id", "name_used", "raw", "score", "label", "summary")


@query(f"WITH {SCORES} SELECT id, score, score <> (CASE WHEN id % 10 = 0 THEN score - 1 ELSE score END) OR id % 21 = 0 AS changed, CASE WHEN id % 10 = 0 OR id % 21 = 0 THEN 2 ELSE 1 END AS scored_at FROM labelled")
def score_refresh(spark, sf_dir):
    fresh = stored(spark, sf_dir, "scores").select("id", "score")
    before = fresh.filter("id % 21 <> 0").select("id", F.when(F.col("id") % 10 == 0, F.col("score") - 1).otherwise(F.col("score")).alias("score"), F.lit(1).alias("scored_at"))
    return changes.refreshed(before, fresh, "id", ["score"], "scored_at", F.lit(2)).select("id", "score", "changed", "scored_at")


@query(f"WITH {SCORES} SELECT score, count(*) AS n FROM labelled GROUP BY score")
def score_histogram(spark, sf_dir):
    return verify.histogram(stored(spark, sf_dir, "scores"))


@query(f"WITH {SCORES} SELECT threshold, count(*) FILTER (score >= threshold) AS n FROM labelled, (SELECT unnest([50, 55, 60, 65, 70, 80]) AS threshold) GROUP BY threshold")
def score_thresholds(spark, sf_dir):
    return verify.thresholds(stored(spark, sf_dir, "scores"), [50, 55, 60, 65, 70, 80])


@query(f"WITH {SCORES}, r AS (SELECT score, row_number() OVER (ORDER BY score DESC, id) - 1 AS pos, count(*) OVER () AS n FROM labelled) SELECT f::DOUBLE AS fraction, score FROM r, (SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS f) WHERE pos = floor((n - 1) * (1 - f::DOUBLE))")
def score_percentiles(spark, sf_dir):
    return verify.percentiles(stored(spark, sf_dir, "scores"), [0.5, 0.9, 0.95, 0.99])


@query(f"WITH {SCORES}, r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS place, count(*) OVER (PARTITION BY score) AS tied FROM labelled) SELECT id, score, place, tied FROM r WHERE place BETWEEN 98 AND 102")
def rank_neighbourhood(spark, sf_dir):
    return verify.around_rank(stored(spark, sf_dir, "scores").select("id", "score"), 100).select("id", "score", "place", "tied")


@query(f"WITH {SCORES} SELECT count(*) FILTER (least(100, greatest(0, list_sum([s.points for s in signals]))) <> score) AS wrong, min(score) FILTER (has_importer_evidence) AS low, max(score) FILTER (has_importer_evidence) AS high, round(avg(score) FILTER (has_importer_evidence), 6) AS mean FROM labelled")
def score_reconciliation(spark, sf_dir):
    rows = stored(spark, sf_dir, "scores")
    again = F.least(F.lit(100), F.greatest(F.lit(0), F.aggregate("signals", F.lit(0), lambda a, s: a + s["points"])))
    own = F.when(F.col("has_importer_evidence"), F.col("score"))
    return rows.agg(F.count_if(again != F.col("score")).alias("wrong"), F.min(own).alias("low"), F.max(own).alias("high"), F.round(F.avg(own), 6).alias("mean"))


# ---- verification


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def shared_keys(spark, sf_dir):
    return verify.repeated(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS excess FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1)")
def repeat_groups(spark, sf_dir):
    return verify.excess(table(spark, sf_dir, "part"), ["p_name"])


@query("SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n, sum((value > 50)::INTEGER)::BIGINT AS high FROM events GROUP BY 1")
def json_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 50).cast("int")).alias("high"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def min_max_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)")
def integrity_orphans(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").filter("o_orderkey % 50 <> 0")
    return verify.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), parents, "l_orderkey", "o_orderkey")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders")
def integrity_unique(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"))


@query("SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE value <= b")
def keyset_order(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value", "user_id", F.col("event_id").alias("ordinal"))
    return verify.in_order(rows, "value", "user_id").select("event_id")


_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query(f"SELECT count(*) AS n, sum(('0x' || substr(sha256(to_json({{{', '.join(f'{c}: {c}' for c in _LINE)}}})::VARCHAR), 1, 15))::BIGINT::HUGEINT) AS checksum FROM lineitem")
def table_checksum(spark, sf_dir):
    return verify.checksum(table(spark, sf_dir, "lineitem"), list(_LINE))


_FRACTIONS = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)


@query(f"WITH r AS (SELECT l_extendedprice AS price, row_number() OVER (ORDER BY l_extendedprice DESC) - 1 AS pos, count(*) OVER () AS n FROM lineitem) SELECT f::DOUBLE AS fraction, price FROM r, (SELECT unnest([{', '.join(map(str, _FRACTIONS))}]) AS f) WHERE pos = floor((n - 1) * (1 - f::DOUBLE))")
def price_percentiles(spark, sf_dir):
    """Percentiles of a column of many distinct values, by rounds of counts."""
    found = verify.selected(table(spark, sf_dir, "lineitem"), list(_FRACTIONS), "l_extendedprice")
    return spark.createDataFrame([(f, float(v)) for f, v in found], "fraction double, price double")


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def table_counts(spark, sf_dir):
    return verify.table_counts({n: table(spark, sf_dir, n) for n in ("customer", "lineitem", "orders", "part")})


@query("SELECT l_returnflag, median(l_quantity) AS middle FROM lineitem GROUP BY 1")
def median_by_group(spark, sf_dir):
    return verify.median(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_returnflag", F.col("median").alias("middle"))


@query("SELECT count(*) AS rows, count(DISTINCT o_custkey) AS keys, bool_and(coalesce(o_orderkey > b, true)) AS in_order FROM (SELECT *, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS b FROM orders)")
def keyset_walk(spark, sf_dir):
    return verify.walk(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")


# ---- the sample profile

_SIX = {d: f"(s_suppkey * {k + 3} + s_nationkey * {k + 7}) % 101" for k, (d, _, _) in enumerate(icp.DIMENSIONS)}
_BOOK = f"""WITH a AS (SELECT s_suppkey AS id, s_name AS name, {', '.join(f'{e} AS {d}' for d, e in _SIX.items())} FROM supplier),
b AS (SELECT *, floor({' + '.join(f'{d} * {w}::DOUBLE' for d, _, w in icp.DIMENSIONS)} + 0.5)::INTEGER AS fit_score,
 [x.label for x in list_sort([x for x in [{', '.join(f"{{'v': -{d}, 'k': {k}, 'label': '{label}'}}" for k, (d, label, _) in enumerate(icp.DIMENSIONS))}] if x.v <= -85])][1:2] AS r FROM a)
SELECT id, name, fit_score, CASE WHEN fit_score >= 85 THEN 'Strong fit' WHEN fit_score >= 70 THEN 'Potential' ELSE 'Weak fit' END AS tier, array_to_string(r, '; ') AS reasons FROM b"""


def _book(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "'' AS industry", "'' AS location", *(f"{e} AS {d}" for d, e in _SIX.items()))
    return rows


@query(_BOOK)
def icp_book(spark, sf_dir):
    return icp.book(_book(spark, sf_dir)).select("id", "name", "fit_score", "tier", F.array_join("reasons", "; ").alias("reasons"))


@query(f"SELECT * FROM ({_BOOK}) WHERE contains(lower(name), '#00000007') OR contains(lower(name), '7')")
def icp_filter(spark, sf_dir):
    return icp.book(_book(spark, sf_dir), " 7 ").select("id", "name", "fit_score", "tier", F.array_join("reasons", "; ").alias("reasons"))


@query(f"SELECT tier, count(*) AS n FROM ({_BOOK}) GROUP BY tier")
def icp_tiers(spark, sf_dir):
    return icp.book(_book(spark, sf_dir)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
