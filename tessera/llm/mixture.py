"""Mixing documents to target weights of domains, by soft membership.

1. A naive Bayes classifier over hashed words learns from the labelled table and gives each document a
   posterior over domains. Its evidence is tempered to that of `EVIDENCE` words, so that memberships stay soft.
2. A document at rate r adds r * tokens * posterior to the domains' expected token totals. Projected gradient
   steps on the squared distance of these totals to the targets, from rate 1 everywhere, fit a nonnegative rate
   for each document. The step is scaled by the inverse of sum(tokens * posterior * posterior'), a matrix as
   wide as there are domains; only that matrix and the totals come to the driver.

All is DataFrame code; a step is one aggregation over a row a document.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

FEATURES = 4096
#: The classifier learns from so many labelled rows at most, those first by a hash of their doc_id.
MOST_LABELLED = 20_000
EVIDENCE = 8.0
STEPS, STEPS_WRITTEN, CLOSE = 60, 6, 1e-7
#: The registered query's domains are language and quality; their target shares of all tokens.
TARGETS = {"en-good": 0.4, "en-poor": 0.06, "de-good": 0.14, "de-poor": 0.04, "fr-good": 0.14, "fr-poor": 0.04, "es-good": 0.14, "es-poor": 0.04}


def word_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each word: the columns of keep and f, its feature; a text without words gives one row with f 0."""
    words = F.explode(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+"))
    return docs.select(*keep, words.alias("w")).select(*keep, F.when(F.col("w") == "", 0).otherwise(1 + F.pmod(F.xxhash64("w"), F.lit(FEATURES))).cast("int").alias("f"))


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], most: int = MOST_LABELLED) -> DataFrame:
    """Naive Bayes weights: for each feature f the log probability in each domain (w0, w1 ...); f 0 has the log priors."""
    spark = docs.sparkSession
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "domain").filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    # one domain a doc_id, and at most `most` rows: broadcast by that bound
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = word_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id"), "domain")
    counts = rows.filter("f > 0").groupBy("f").agg(*(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)))
    sums = counts.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"s{k}") for k in range(len(domains))))
    priors = known.agg(*(F.log((F.count_if(F.col("domain") == d) + 1) / (F.count(F.lit(1)) + len(domains))).alias(f"w{k}") for k, d in enumerate(domains))).select(F.lit(0).alias("f"), *(f"w{k}" for k in range(len(domains))))
    # sums is one row: the join adds its columns
    every = spark.range(1, FEATURES + 1).select(F.col("id").cast("int").alias("f")).join(counts, "f", "left").join(F.broadcast(sums))
    logs = every.select("f", *(F.log((F.coalesce(f"n{k}", F.lit(0)) + F.lit(0.5)) / (F.col(f"s{k}") + F.lit(0.5 * FEATURES))).alias(f"w{k}") for k in range(len(domains))))
    return logs.unionByName(priors)


def posteriors(docs: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """doc_id, n_tokens and the posterior of each domain (p0, p1 ...): a row for each doc_id, null among them."""
    weights = cut(weights.coalesce(1), "weights")  # FEATURES + 1 rows
    prior = weights.filter("f = 0").first()
    rows = word_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").join(F.broadcast(weights), "f")
    real = F.col("f") > 0
    sums = rows.groupBy("doc_id").agg(F.count_if(real).alias("n_tokens"), *(F.sum(F.when(real, F.col(f"w{k}")).otherwise(0.0)).alias(f"l{k}") for k in range(n)))
    tempered = sums.select("doc_id", "n_tokens", *((F.lit(prior[f"w{k}"]) + F.col(f"l{k}") / F.greatest(F.lit(1.0), F.col("n_tokens") / F.lit(EVIDENCE))).alias(f"l{k}") for k in range(n)))
    most = F.greatest(*(F.col(f"l{k}") for k in range(n))) if n > 1 else F.col("l0")
    shifted = tempered.select("doc_id", "n_tokens", *(F.exp(F.col(f"l{k}") - most).alias(f"e{k}") for k in range(n)))
    total = reduce(lambda a, b: a + b, (F.col(f"e{k}") for k in range(n)))
    return shifted.select("doc_id", "n_tokens", *((F.col(f"e{k}") / total).alias(f"p{k}") for k in range(n)))


def fit_rates(members: DataFrame, shares: list[float]) -> DataFrame:
    """members (doc_id, n_tokens, p0 ...) with a column rate, at which expected domain totals are nearest to shares of all tokens."""
    n = len(shares)
    p = [F.col(f"p{k}") for k in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    first = members.agg(F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * p[i] * p[j]) for i, j in pairs)).first()
    tokens = float(first[0] or 0)
    members = members.withColumn("rate", F.lit(1.0))
    if not tokens:
        return members
    scale = np.zeros((n, n))
    for (i, j), x in zip(pairs, first[1:], strict=True):
        scale[i, j] = scale[j, i] = x / tokens
    scale = np.linalg.pinv(scale + 1e-12 * np.eye(n), hermitian=True)
    target, last = np.array(shares), np.inf
    rate: Column = F.col("rate")
    for step in range(1, STEPS + 1):
        totals = members.agg(*(F.sum(rate * F.col("n_tokens") * x) for x in p)).first()
        off = np.array(totals) / tokens - target
        far = float(np.abs(off).max())
        if far < CLOSE or abs(last - far) < 1e-3 * CLOSE:
            break
        last, g = far, scale @ off
        rate = F.greatest(F.lit(0.0), rate - reduce(lambda a, b: a + b, (x * F.lit(float(y)) for x, y in zip(p, g, strict=True))))
        if step % STEPS_WRITTEN == 0:
            members, rate = cut(members.withColumn("rate", rate), "rates"), F.col("rate")
    return members.withColumn("rate", rate)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """A row for each doc_id of docs: doc_id, n_tokens, domain (likeliest), posterior (array in order of domains), rate.

    Wants docs (doc_id, text), labelled (doc_id, domain); other columns are ignored. Targets of domains that no
    labelled row names are left out and the rest scaled to 1; without any, all rates are 1 and domain is null.
    Null texts have no tokens and the prior as posterior; rows with one doc_id, or with none, are one document.
    A doc_id that is labelled twice has the first domain in order. Ties of domain fall to the first in order.
    """
    there = {r[0] for r in labelled.filter(F.col("domain").isin(list(targets))).select("domain").distinct().collect()}
    domains = sorted(there)  # no more than there are targets
    wanted = [max(0.0, float(targets[d])) for d in domains]
    if not sum(wanted):
        rows = word_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").groupBy("doc_id").agg(F.count_if(F.col("f") > 0).alias("n_tokens"))
        return rows.select("doc_id", "n_tokens", F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"))
    members = cut(posteriors(docs, classifier(docs, labelled, domains), len(domains)), "members")
    rated = fit_rates(members, [w / sum(wanted) for w in wanted])
    posterior = F.array(*(F.round(f"p{k}", 9) for k in range(len(domains))))
    names = F.array(*map(F.lit, domains))
    return rated.select("doc_id", "n_tokens", F.element_at(names, F.array_position(posterior, F.array_max(posterior)).cast("int")).alias("domain"), posterior.alias("posterior"), F.round("rate", 6).alias("rate"))


def language_and_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and domain (such as en-good) of labelled rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id is not null and quality is not null")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").filter("lang is not null").join(known, "doc_id").select("doc_id", F.concat("lang", F.when(F.col("quality") == 1, "-good").otherwise("-poor")).alias("domain"))
