"""Licence scans against brute force and SQL; relatives told apart; notices over several lines and within longer ones."""

import itertools
import random
import re

import duckdb
import pytest

from tessera.llm import licences
from tests.llm.test_operators import corpus


def brute(rows, templates=licences.TEMPLATES, least=licences.DICE):
    grams = [(name, len(licences.words_of(t)), licences.bigrams_of(t)) for name, t in templates]
    related = licences.families(templates)
    out = {}
    for doc, text in dict.fromkeys((i, t) for i, t in rows if i is not None and t):
        w = re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")
        own = [f"{a} {b}" for a, b in zip(w, w[1:])]
        units = []
        for k, (_, n, g) in enumerate(grams):
            for at in range(len(own)):
                if own[at] in g:
                    inside = own[at : at + n - 1]
                    shared = {x for x in inside if x in g}
                    dice = 2 * len(shared) / (len(g) + len(shared) + sum(x not in g for x in inside))
                    if dice >= least:
                        units.append((dice, -k, -at))
        reach = {f: max(grams[k][1] for k in range(len(grams)) if related[k] == f) for f in related}
        for u in units:
            f = related[-u[1]]
            if u == max(x for x in units if related[-x[1]] == f and abs(x[2] / reach[f] - u[2] / reach[f]) <= 0.5):
                old = out.get((doc, grams[-u[1]][0]), ((0, 0, 0), 0))
                out[doc, grams[-u[1]][0]] = max(old[0], u), old[1] + 1
    return {k: (round(u[0], 6), -u[1], -u[2], n) for k, (u, n) in out.items()}


def found(df):
    return {(r.doc_id, r.licence): (r.dice, r.template, r.first_word, r.n_units) for r in df.collect()}


def wrapped(text, mark, r):
    w, out = text.split(), []
    while w:
        n = r.randint(6, 11)
        out.append(mark + " ".join(w[:n]))
        w = w[n:]
    return "\n".join(out)


def cases():
    r = random.Random(1)
    code = "\n".join(f"let v{k} = f({k}); // step {k}" for k in range(120))
    rows = [(k, wrapped(t, ("# ", " * ", "")[k % 3], r) + "\n" + code) for k, (_, t) in enumerate(licences.TEMPLATES)]
    bent = licences._ISC.split()
    for k in (20, 40, 60, 80):
        bent[k] = "other"
    mine = [
        "This package is released under the MIT License, see LICENSE for details", licences._ISC.upper().replace(",", " ;"), "words " * 50, None, "", "x y z\nReleased under the MIT License!\nbye",
        " ".join(bent) + " " + code, "released under the mit license " * 3, "licensed under cc by nc 4 0", "licensed under", licences._PERMIT[: len(licences._PERMIT) // 2], "the " * 40 + licences._APACHE + " in the" * 300 + licences._ZLIB, "under the terms of the " * 50,
    ]
    rows += [(1000 + k, t) for k, t in enumerate(mine)]
    return [*rows, (None, "released under the mit license"), (1000, mine[0]), (1000, mine[0]), (1000, "licensed under the mit license")]


def test_like_brute_force_and_sql(spark):
    rows = cases()
    docs = corpus(spark, rows)
    got = found(licences.scan(docs))
    assert got == brute(rows)
    assert got[1000, "MIT"][3] == 2 and got[1007, "MIT"][3] == 3
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[:2]: r[2:] for r in c.execute(licences.sql()).fetchall()} == got
    assert found(licences.scan(docs, least=0.7)) == brute(rows, least=0.7)
    assert licences.scan(docs.filter("false")).count() == 0


def test_every_template_is_named_after_itself(spark):
    rows = cases()
    got = found(licences.scan(corpus(spark, rows)))
    for k, (name, _) in enumerate(licences.TEMPLATES):
        assert {x for i, x in got if i == k} == {name} and got[k, name][0] == 1.0


def test_anchors_lose_nothing():
    for least in (0.7, licences.DICE, 0.95):
        words = set(licences.anchors(licences.TEMPLATES, least))
        for _, t in licences.TEMPLATES:
            grams = licences.bigrams_of(t)
            without = [g for g in grams if not words & set(g.split())]
            # a unit of these alone stays below
            assert 2 * len(without) / (len(grams) + len(without)) < least


@pytest.mark.parametrize("a, b", list(itertools.combinations(["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"], 2)))
def test_relatives_are_one_family(a, b):
    related = licences.families(licences.TEMPLATES)
    of = {name: {f for (n, t), f in zip(licences.TEMPLATES, related, strict=True) if n == name and len(t) > 200} for name in (a, b)}
    assert of[a] == of[b]
