"""Queries without SQL against brute force of their own; very long, empty and null texts for all operators."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, licences, lm, minhash, mixture, queries, substrings, token_counts, toxicity, warc
from tessera.llm.common import read_table
from tests.conftest import SF
from tests.llm.test_operators import DOCS, components, corpus, stripped, words


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def overlaps(docs, items):
    """(doc, item) of which 20 tokens in line, or a whole shorter item, agree in 80 % (below 8 tokens: in all)."""
    number: dict = {}
    ids = lambda t: np.array([number.setdefault(w, len(number)) for w in tokens(t)], np.int64)
    wanted = [(i, ids(t)) for i, t in items]
    out = set()
    for d, text in docs:
        a = ids(text)
        for i, b in wanted:
            need = min(20, len(b))
            if not need or len(a) < need or len(np.intersect1d(a, b)) < 0.2 * need:
                continue
            for shift in range(-len(b), len(a)):
                lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                if hi - lo >= need:
                    sums = np.concatenate(([0], np.cumsum(a[lo + shift : hi + shift] == b[lo:hi])))
                    if (sums[need:] - sums[:-need]).max() >= (0.8 * need if len(b) >= 8 else need):
                        out.add((d, i))
                        break
    return out


def test_decontamination_query(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    assert {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, SF).collect()} == overlaps(docs, items)


def test_equal_items(spark):
    bench = spark.createDataFrame([(k, "one two three four five six seven eight nine ten") for k in (5, 3, 9)], "item_id long, text string")
    got = decontaminate.contaminated(corpus(spark, [(1, "x one two three four five six seven eight nine ten y")]), bench).collect()
    assert {(r.doc_id, r.item_id, r.first_word, r.end_word) for r in got} == {(1, k, 1, 11) for k in (3, 5, 9)}


def test_edited_tokens_query(spark):
    count = token_counts.counter(token_counts.VOCABULARY)
    texts = {r.doc_id: r.text or "" for r in read_table(spark, SF, "documents").collect()}
    for r in queries.op9_token_counts(spark, SF).collect():
        t = texts[r.doc_id]
        n = len(t)
        for at, cut, put in ((int(n * 0.5), 7, " (revised)"), (0, 0, "Note: "), (int(n * 0.8), 40, ""), (n + (1 << 20), 0, "\n\nEnd of text.")):
            at = min(at, len(t))
            t = t[:at] + put + t[at + cut :]
        assert (r.edited_chars, r.edited_tokens) == (len(t), len(count.bpe.encode_ordinary(t)))


def test_long_insertions_keep_blocks_even():
    count = token_counts.counter(token_counts.VOCABULARY)
    t = token_counts.tree("a b c", count)
    for k in range(6):
        t.edit(k * 7, 0, "word and " * 700, count)
    assert max(len(b[1]) for b in t.blocks) <= 8 * token_counts.BLOCK and t.tokens == len(count.bpe.encode_ordinary(t.leaves()[0]))


def test_posteriors_and_rates(spark):
    r = random.Random(11)
    rows = [(i, " ".join(r.choices([f"{'ab'[i % 2]}{k}" for k in range(30)] + ["both", "Also"], k=r.randint(0, 40)))) for i in range(60)]
    labelled = [(i, "ab"[i % 2]) for i in range(0, 60, 3)]
    docs, known = corpus(spark, rows), spark.createDataFrame(labelled, "doc_id long, domain string")
    feature = {w: x for w, x in spark.createDataFrame([(w,) for w in {w for _, t in rows for w in t.lower().split()}], "w string").select("w", 1 + F.pmod(F.xxhash64("w"), F.lit(mixture.FEATURES))).collect()}
    seen = {d: Counter(feature[w] for i, t in rows for w in t.lower().split() if (i, d) in labelled) for d in "ab"}
    prior = [math.log((sum(d == x for _, x in labelled) + 1) / (len(labelled) + 2)) for d in "ab"]

    def posterior(text):
        own = [feature[w] for w in text.lower().split()]
        logs = [sum(math.log((seen[d][f] + 0.5) / (sum(seen[d].values()) + 0.5 * mixture.FEATURES)) for f in own) / max(1.0, len(own) / mixture.EVIDENCE) + p for d, p in zip("ab", prior, strict=True)]
        e = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(e) for x in e]

    got = {x.doc_id: x for x in mixture.mix(docs, known, {"a": 0.7, "b": 0.3}).collect()}
    for i, t in rows:
        assert got[i].posterior == pytest.approx(posterior(t), abs=1e-6) and got[i].n_tokens == len(t.split())
    n = np.array([got[i].n_tokens for i, _ in rows])
    p = np.array([posterior(t) for _, t in rows])
    rate, target, scale = np.ones(len(n)), np.array([0.7, 0.3]), np.linalg.inv((p.T * n) @ p / n.sum() + 1e-12 * np.eye(2))
    for _ in range(200):
        rate = np.maximum(0, rate - p @ (scale @ ((n * rate) @ p / n.sum() - target)))
    assert np.array([got[i].rate for i, _ in rows]) == pytest.approx(rate, abs=1e-4)
    # ties of domain fall to the first; an empty text has the prior
    tie = mixture.mix(corpus(spark, [(1, "x"), (2, "x"), (3, None)]), spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string"), {"a": 1, "b": 1}).collect()
    assert {x.domain for x in tie} == {"a"} and {x.n_tokens for x in tie} == {0, 1}


def test_risk_and_slope():
    g = np.random.default_rng(3)
    f = g.standard_normal(40)
    p, u = np.zeros(40), np.zeros(40)
    p[:15], u[15:] = 1 / 15, 1 / 25
    for shift, prior in ((0.0, 0.2), (6.0, 0.9)):
        x = f + shift * (p > 0)
        log = lambda z: math.log1p(math.exp(-z))
        positive = prior * sum(log(z) for z in x[:15]) / 15
        negative = sum(log(-z) for z in x[15:]) / 25 - prior * sum(log(-z) for z in x[:15]) / 15
        assert toxicity.risks(x, p, u, prior) == pytest.approx((positive, negative))
        assert (negative < 0) == (shift > 0)

        def value(z, prior=prior, negative=negative):
            a, b = toxicity.risks(z, p, u, prior)
            return a + b if negative >= 0 else -b

        numeric = [(value(x + 1e-6 * e) - value(x - 1e-6 * e)) / 2e-6 for e in np.eye(40)]
        assert toxicity.slope(x, p, u, prior) == pytest.approx(numeric, abs=1e-6)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage of a run over a small table of our own, with nulls, repeated rows and copies."""
    import corpus_pipeline

    r = random.Random(21)
    mild = [f"m{k}" for k in range(400)]
    say = lambda n: " ".join(r.choices(mild, k=n))
    item = " ".join(f"q{k}" for k in range(30))
    shared = say(40)
    rows = [(i, say(60) + (" vile worthless scum" if i % 5 == 0 else ""), "en" if i % 2 else "de", "s", None) for i in range(300)]
    rows += [(1000 + i, rows[1 + 5 * i][1], "en", "s", 3) for i in range(20)]
    rows += [(2000 + i, say(30) + " " + shared + " " + say(30), "en", "s", None) for i in range(5)]
    rows += [(3000 + i, say(10) + " " + item + " " + say(10), "en", None, None) for i in range(3)]
    rows += [(4000, None, "en", "s", None), (4001, "", None, "s", 0), (None, say(50), "en", "s", None), (4002, say(50), "en", "s", None)]
    rows += rows[-1:]
    labels = [(i, i % 3 and 1, int(i % 5 == 0)) for i in range(0, 300, 2)] + [(None, 1, 1), (7, None, None)]
    spark.createDataFrame(rows, DOCS).withColumn("p", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = read_table(spark, str(tmp_path), "documents").select(*corpus_pipeline.COLUMNS)
    kept = [tuple(x) for x in docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        after = [tuple(x)[:5] for x in out.collect()]
        if k == 0:
            assert Counter(after) == Counter(x for x in kept if "vile" not in (x[1] or ""))
        elif k == 1:
            sets = [(x[0], {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} - {()})) for x in kept for w in [words(x[1], True)]]
            links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[i + 1 :] if None not in (a, b) and s and t and 100 * len(s & t) >= 75 * len(s | t)]
            first = components({a for a, _ in sets if a is not None}, links)
            assert Counter(after) == Counter(x for x in kept if x[0] is None or first[x[0]] == x[0]) and len(after) < len(kept)
        elif k == 2:
            brute = Counter((i, n, gone) for i, n, gone, _ in stripped([x[:2] for x in kept]))
            assert Counter((x[0], len(words(x[1]))) for x in after) == Counter((i, n - gone) for (i, n, gone), m in brute.items() for _ in range(m))
            assert sum(gone for _, _, gone in brute) > 100
        elif k == 3:
            found = {d for d, _ in overlaps([x[:2] for x in kept if x[0] is not None], [(1, item)])}
            assert Counter(after) == Counter(x for x in kept if x[0] not in found) and found
        else:
            assert set(after) <= set(kept) and all(x.rate > 0 for x in out.collect())
        kept = after
        docs = spark.createDataFrame(after, DOCS)
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


LABELS = "doc_id long, toxic int"


def everything(spark, docs):
    """The number of rows that each operator gives for these documents."""
    bench = spark.createDataFrame([(1, "nothing that is in them at all ever")], "item_id long, text string")
    return {
        "licences": licences.scan(docs).count(),
        "lm": lm.scores(docs).count(),
        "toxicity": toxicity.classify(docs, spark.createDataFrame([(1, 1), (2, 0)], LABELS)).count(),
        "decontaminate": decontaminate.contaminated(docs, bench).count(),
        "substrings": substrings.strip_repeats(docs).count(),
        "tokens": token_counts.edited_counts(docs, token_counts.review_edits()).count(),
        "minhash": minhash.near_duplicates(docs).count(),
        "warc": warc.archived_pages(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))).count(),
    }


def test_long_null_and_empty_texts(spark):
    r = random.Random(6)
    long = " ".join(f"w{r.randint(0, 50000)}" for _ in range(450_000))
    assert len(long) > 3_000_000
    got = everything(spark, corpus(spark, [(1, long), (2, long + " more"), (3, None), (4, ""), (None, None)]))
    assert got == {"licences": 0, "lm": 5, "toxicity": 5, "decontaminate": 0, "substrings": 5, "tokens": 5, "minhash": 5, "warc": 5}
    assert set(everything(spark, corpus(spark, []).filter("false")).values()) == {0}
    same = {x.doc_id: x for x in minhash.near_duplicates(corpus(spark, [(1, long), (2, long + " more")])).collect()}
    assert same[2].component_id == 1 and zlib.crc32(b"") == 0
