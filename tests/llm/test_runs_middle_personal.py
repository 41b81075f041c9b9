"""Periodic runs, fill-in-the-middle and personal data against slow versions, on whole tables and on hard cases."""

import hashlib
import re
import zlib
from bisect import insort

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import middle, periodic, personal, queries
from tests.conftest import SF

WORD = re.compile("[^\x20\x09-\x0d]+")
HARD = [
    (1, None, 1), (2, "", 2), (3, " \t\n", 3), (None, "a b a b a b a b a b a b a b", 4), (5, "one", 5), (5, "one", 5), (6, "é <P> x", 6), (7, "x " * 40_000, 7),
    (8, "Ä😀z 　q\x00\x1f " * 9, 8), (9, "<" + "S> P" * 30, 9), (10, "w" * 300_000 + "@" * 2000 + "1" * 200_000 + "." * 5000 + " " * 70_000, 10),
]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def hard(spark):
    """Null, empty, long and repeated rows, with further columns whose names the operators use themselves."""
    return spark.createDataFrame(HARD, "doc_id long, text string, n long").withColumns({"runs": F.lit(1), "form": F.lit("x"), "spans": F.lit(0), "output": F.lit(None), "words": F.lit("w")})


def documents():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


# -- runs


def slow_runs(w, least):
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((*k, q) for k, q in found.items())


@given(st.data(), st.sampled_from([2, 5, 12]))
@settings(max_examples=300, deadline=None)
def test_runs_like_slow_ones(data, least):
    w = data.draw(st.lists(st.integers(0, data.draw(st.sampled_from([0, 1, 2, 9]))), max_size=70))
    if w and data.draw(st.booleans()):
        a = data.draw(st.integers(0, len(w) - 1))
        p = data.draw(st.integers(1, len(w) - a))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    assert sorted(periodic.runs_of(w, least)) == slow_runs(w, least)


def test_many_repeats_are_found_at_once():
    fib, last = [0, 1], [0]
    while len(fib) < 20_000:
        fib, last = fib + last, fib
    assert len(periodic.runs_of(fib)) > 2000
    assert periodic.runs_of([0] * 200_000) == [(0, 200_000, 1)]


def test_ends_tell_neighbours():
    rng = np.random.default_rng(1)
    ends, slow = periodic.Ends(0), [0]
    for x in rng.permutation(np.arange(1, 6000)).tolist():
        before, after = max((v for v in slow if v < x), default=None) if x % 97 == 0 else -1, min((v for v in slow if v > x), default=None) if x % 97 == 0 else -1
        got = ends.add(x)
        assert before == -1 or got == (before, after)
        insort(slow, x)
    assert list(ends) == slow and len(ends.blocks) > 2


def expected_runs(doc, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [(s, length, q) for s, length, q in periodic_slow(w)]
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_slow(w):
    """slow_runs with numpy over the places, for whole documents."""
    ids = np.array([{v: i for i, v in enumerate(dict.fromkeys(w))}[x] for x in w]) if len(w) < 600 else np.unique(np.array(w), return_inverse=True)[1]
    found = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate(([0], (ids[:-q] == ids[q:]).astype(int), [0]))
        edge = np.flatnonzero(np.diff(same))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
    return [(*k, q) for k, q in found.items()]


def test_op11_like_slow(spark):
    docs = documents()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert got.keys() == docs.keys() and sum(v[0] for v in got.values()) > 10
    for doc, text in docs.items():
        assert got[doc] == expected_runs(doc, text), doc


def test_runs_of_hard_rows(spark):
    found = periodic.periodic_runs(hard(spark))
    rows = sorted(found.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(rows) == len(HARD) and rows[0].doc_id is None and [tuple(r) for r in rows[0].runs] == [(0, 14, 2)] and rows[0].collapsed == "a b"
    by = {r.doc_id: r for r in rows}
    assert [by[i].n_words for i in (1, 2, 3, 5, 7)] == [0, 0, 0, 1, 40_000] and by[7].collapsed == "x" and by[1].collapsed == ""
    assert [r for r in rows if r.doc_id == 5][0] == [r for r in rows if r.doc_id == 5][1]
    assert periodic.digest(found).count() == len(HARD) and periodic.periodic_runs(hard(spark).limit(0)).count() == 0


# -- fill in the middle


def expected_middle(doc, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@given(st.text("aZ éß€😀<SPM>\n", max_size=60), st.integers(-3, 300))
@settings(max_examples=300, deadline=None)
def test_middle_like_slow(text, doc):
    *rest, output = middle.rearranged(text.encode(), middle.draws(doc, 1))
    assert (*rest, output.decode()) == expected_middle(doc, text)


def test_op12_like_slow(spark):
    docs = documents()
    rows = queries.op12_fill_in_middle(spark, SF).collect()
    assert len(rows) == len(docs) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        *rest, output = expected_middle(r.doc_id, docs[r.doc_id])
        assert tuple(r)[1:] == (*rest, sha(output), sha(docs[r.doc_id])), r.doc_id


def test_middle_of_hard_rows(spark):
    made = middle.fill_in_middle(hard(spark))
    texts = sorted(made.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("t")).collect(), key=repr)
    assert [tuple(t) for t in texts] == sorted(((d, t or "") for d, t, _ in HARD), key=lambda x: f"Row(doc_id={x[0]!r}, t={x[1]!r})")
    for r in made.collect():
        assert any((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected_middle(d, t) for d, t, _ in HARD if d == r.doc_id)
    assert middle.fill_in_middle(hard(spark).limit(0)).count() == 0


# -- personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow_luhn(d):
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(x)))) for x in even)) % 10 == 0


def slow_spans(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 12 <= len(d) <= 19 and slow_luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


@given(st.one_of(st.text("ab@.-", max_size=60), st.text("0123456789. -+()", max_size=60), st.text("12. -@ax+", max_size=60)))
@settings(max_examples=500, deadline=None)
def test_plain_spans_like_patterns(text):
    assert personal.plain_spans(text) == slow_spans(text)


def test_trees_learn_what_no_single_feature_tells():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    t = personal.Trees.fit(x[:1500], y[:1500])
    assert ((t.scores(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert personal.Trees.fit(x[:0], y[:0]).scores(x[:3]).tolist() == [0.5] * 3


def test_threshold_is_the_lowest_that_keeps_precision():
    assert personal.threshold(np.array([0.9, 0.8, 0.7, 0.6]), np.array([1.0, 1, 0, 1]), 0.75) == 0.6
    assert personal.threshold(np.array([0.9, 0.9, 0.7]), np.array([1.0, 0, 1]), 0.9) == 2.0
    assert personal.threshold(np.zeros(0), np.zeros(0)) == 2.0


@pytest.fixture(scope="module")
def model():
    return personal.learnt([s for d, t in documents().items() for s in personal.stretches(t or "", d)])


def test_examples_kept_aside(model):
    """Recall and precision on values and decoys drawn by another seed, in other texts."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()[-300:]
    x, y = personal.examples([s for t in texts for s in personal.stretches(t or "", 7)], 7)
    p = model.trees.scores(x)
    for k in range(4):
        mine = x[:, 0] == k
        passed = p[mine] >= model.thresholds[k]
        assert y[mine][passed].mean() > 0.95 and passed[y[mine] == 1].mean() > 0.7, personal.KINDS[k]


def all_spans(model, text):
    plain = personal.plain_spans(text)
    met = personal._free(personal.candidates(text), plain)
    scores = model.trees.scores(np.array([personal.features(text, s) for s in met])) if met else np.zeros(0)
    return {(personal.KINDS[k], text[a:b]) for (a, b, k), _ in personal.added(plain, met, scores, model.thresholds)}


def test_what_the_trees_add(model):
    found = [all_spans(model, t) for t in ("please call (416) 555-0199 today", "from 10[.]0[.]0[.]1 it came", "pay with 4111.1111.1111.1111 now", "write to john.smith (at) example.com now", "ann [at] corp [dot] org")]
    assert sum(map(bool, found)) >= 4 and ("phone", "(416) 555-0199") in found[0] and ("card", "4111.1111.1111.1111") in found[2]
    assert not any(all_spans(model, t) for t in ("", "on 1999-12-31 and 2001-01-02", "It was 12.50 at noon. Then we left", "see pages 12-34", "that the and ing", "1,234,567.00 and 3.14159"))


def test_op13_like_patterns(spark):
    docs = documents()
    for r in queries.op13_personal_data(spark, SF).collect():
        slow = [(personal.KINDS[k], a, b) for a, b, k in slow_spans(docs[r.doc_id])]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in slow) for k in personal.KINDS]
        lines = [f"{k}:{a}:{b}" for k, a, b in slow]
        assert r.base_sha256 == sha(",".join(lines)) and set(lines) <= set(filter(None, r.spans.split(",")))


def test_personal_data_of_hard_rows(spark, model):
    docs = hard(spark)
    rows = personal.find(docs, model).collect()
    assert len(rows) == len(HARD) and not any(r.spans for r in rows if r.doc_id in (1, 2, 3))
    assert personal.find(docs.limit(0), model).count() == 0
    assert personal.fit(docs.limit(0)).thresholds.shape == (4,)
    text = "é to a.b@c.de or +49 (30) 1234567, then 10.0.0.1."
    few = spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in personal.redacted(few, personal.find(few, model)).collect()} == {1: "é to [email] or [phone], then [ip].", 2: None, 3: "none"}
