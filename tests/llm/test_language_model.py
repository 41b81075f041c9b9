"""The language model: its contract against brute force, its bits against a slow scorer, one result at any partitioning."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lm
from tests.llm.test_operators import corpus, words


def test_language_model(spark):
    r = random.Random(2)
    # two languages with words of their own, a third of them common ones
    speak = lambda i: " ".join(r.choices([f"{'wv'[i % 2]}{k}" for k in range(200)], [1 / (k + 1) for k in range(200)], k=60))
    rows = [(i, speak(i)) for i in range(300)] + [(500, None), (501, ""), (None, "w1 unseenword"), (3, "w1 W1")]
    got = lm.scores(corpus(spark, rows)).collect()
    assert len(got) == len(rows)
    folds = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    toks = [(i, [*words(t, True), None]) for i, t in rows]
    c = Counter(w for i, ws in toks if not folds[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, folds[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in toks)
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held) and all(x.score < 0 for x in got)
    assert {x.bits_per_byte for x in got if x.doc_id in (500, 501)} == {None}
    assert lm.scores(corpus(spark, rows).filter("false")).count() == 0


def test_language_model_counts_the_end(spark):
    # more distinct words than have a code, all as rare as the end itself
    rows = [(0, " ".join(f"w{k}" for k in range(20000))), (2, "w1 w1 other")]
    got = {x.doc_id: x for x in lm.scores(corpus(spark, rows), lambda c: c == 0).collect()}
    n, v = 20001, 20001
    share = lambda c: math.log10((c + 1) / (n + v + 1))
    assert [(got[i].n_tokens, got[i].n_known, got[i].train_tokens) for i in (0, 2)] == [(20001, 20001, n), (4, 3, n)]
    assert got[0].base_score == pytest.approx(20001 * share(1)) and got[2].base_score == pytest.approx(3 * share(1) + share(0))


def zipf(r, n, k=400):
    return " ".join(r.choices([f"w{i}" for i in range(k)], [1 / (i + 1) for i in range(k)], k=n))


class Given:
    def __init__(self, value):
        self.value = value


def trained(texts, top=150):
    """A model of these texts as one group, and the exact counts."""
    c = lm.together([lm.counted(t) for t in lm.tokens(pa.array(texts))])
    keep = np.union1d(np.argsort(-c.n, kind="stable")[:top], np.flatnonzero(c.h == lm.END))
    v = lm.Vocabulary(c.h[keep], c.n[keep], int(c.n.sum()), len(c.h), int((c.n == 1).sum()), np.bincount(c.data, minlength=256))
    ready = lm.plan(v)
    group = pa.table({"p": pa.array([0] * len(texts), pa.int32()), "doc_id": list(range(len(texts))), "text": texts, "r": list(range(len(texts)))})
    shard = pa.record_batch({"shard": [0], "words": [lm.planes(c.h)], "spelled": [c.data.tobytes()]})
    rows = pa.concat_tables([lm._learn_words(Given(ready))(group), pa.Table.from_batches(list(lm._learn_letters(Given(ready))([shard])))])
    for last in (False, True):
        rows = pa.Table.from_batches(list(lm._add_up(last)(rows.sort_by([(k, "ascending") for k in ("kind", "part", "p")]).to_batches())))
    return lm.assembled(v, ready, rows), dict(zip(c.h.tolist(), c.n.tolist(), strict=True))


def test_exact_counts_and_spelling():
    texts = ["b a b é", "", "a\tc end", "x" * 70]
    c = lm.together([lm.counted(t) for s in (texts, texts[:1]) for t in lm.tokens(pa.array(s))])
    spelled = c.data.tobytes().split(b" ")[:-1]
    assert dict(zip(spelled, c.n.tolist(), strict=True)) == Counter([*b" ".join(t.encode() for t in [*texts, texts[0]]).split(), *[b""] * 5]) and (np.diff(c.h.astype(object)) > 0).all()
    found = lm.Index(c.h)
    assert found.find(c.h).tolist() == list(range(len(c.h))) and found.find(c.h + np.uint64(1)).tolist() == [len(c.h)] * len(c.h)


def slow_bits(m, symbol, contexts):
    """What `coded` says of one text, bit by bit."""
    n, out = m.shape.inputs, []
    own, sure, pull = np.zeros(n + 1), np.full(n + 1, lm.HOLD), np.zeros(n + 1)
    fine, firm, push = np.zeros(lm.COARSE), np.full(lm.COARSE, lm.FINE_HOLD), np.zeros(lm.COARSE)
    ends = {64 << k for k in range(7)} | set(range(4096, len(symbol) + 1, 4096))
    logit = lambda p: math.log(p / (1 - p))
    for at, s in enumerate(symbol):
        if at in ends:
            own += np.clip(pull / sure, -lm.STEP, lm.STEP)
            fine += np.clip(push / firm, -lm.STEP, lm.STEP)
            pull[:], push[:] = 0, 0
        bits = 0.0
        for e in range(m.code.start[s], m.code.start[s] + m.code.length[s]):
            bit, place = int(m.code.bit[e]), int(m.code.place[e])
            slots = [int(m.code.node[e])] + [((int(c[at]) ^ int(m.code.key[e])) * int(lm.SPREAD) & 0xFFFFFFFF) >> (32 - m.bits) for c in contexts]
            pairs = [(int(t[k]) & 0xFFFF, int(t[k]) >> 16) for t, k in zip(m.tables, slots, strict=True)]
            share = (pairs[0][1] + 0.4) / (sum(pairs[0]) + 0.8)
            x = [logit(share)] + [math.log((ones + lm.SHRINK * share) / (zeros + lm.SHRINK * (1 - share))) for zeros, ones in pairs[1:]] + [1.0]
            levels = [sum(sum(p) > k for k in (0, 3, 31)) for p in pairs[-2:]]
            gate = place * 16 + levels[0] * 4 + levels[1]
            y = sum((m.weights[k][gate] + own[k]) * x[k] for k in range(n + 1))
            where = (min(max(y, -8), 8) + 8) * 2
            low = min(int(where), 31)
            y = 0.5 * (y + m.refined[place * 33 + low] * (1 - where + low) + m.refined[place * 33 + low + 1] * (where - low)) + fine[low // 4]
            p = 1 / (1 + math.exp(-y))
            bits -= math.log2(p if bit else 1 - p)
            for k in range(n + 1):
                pull[k] += (bit - p) * x[k]
                sure[k] += p * (1 - p) * x[k] ** 2
            push[low // 4] += bit - p
            firm[low // 4] += p * (1 - p)
        out.append(bits)
    return np.array(out)


def test_bits_like_a_slow_scorer():
    r = random.Random(8)
    m, counts = trained([zipf(r, 300) for _ in range(30)])
    texts = [zipf(r, 700), "", zipf(r, 90) + " neverseen w1", zipf(r, 10), "fresh fresh fresh unheard"]
    (t,) = lm.tokens(pa.array(texts))
    symbol = lm.Index(m.vocabulary.h).find(t.h)
    own = lm.word_contexts(*lm.before(t, m.words.code.rank[symbol], m.frequent))
    got = lm.coded(m.words, symbol, own, t.bounds)
    for a, b in zip(t.bounds, t.bounds[1:]):
        assert got[a:b] == pytest.approx(slow_bits(m.words, symbol[a:b], [c[a:b] for c in own]), abs=2e-3)
    count = np.array([counts.get(h, 0) for h in t.h.tolist()])
    bits = lm.text_bits(m, t, symbol, count)
    # a word that the text has had before costs less than at first, and all bits are there
    fresh = bits[t.bounds[4] : t.bounds[5]]
    assert fresh[2] < fresh[0] and (bits > 0).all()
    assert bits[symbol < len(m.vocabulary.h)] == pytest.approx(got[symbol < len(m.vocabulary.h)])


def test_rare_words_one_by_one():
    r = random.Random(4)
    text = np.sort(np.array([r.randint(0, 5) for _ in range(300)]))
    h = np.array([r.randint(1, 60) for _ in range(300)], np.uint64)
    new, own = h % np.uint64(3) == 0, np.array([r.uniform(5, 30) for _ in range(300)])
    got, had, k, again, fresh = lm.rare_bits(text, h, own, new, 0.2), Counter(), Counter(), Counter(), Counter()
    for i, t in enumerate(text.tolist()):
        before = had[t, int(h[i])]
        copy, share = (again[t] + 0.2) / (k[t] + 20), (fresh[t] + 16 * 0.2) / (k[t] + 16)
        p = (1 - copy) * (share if new[i] else 1 - share) * 2.0 ** -own[i] + (copy * before / k[t] if before else 0)
        assert got[i] == pytest.approx(-math.log2(p))
        had[t, int(h[i])] += 1
        k[t] += 1
        again[t] += before > 0
        fresh[t] += bool(new[i])


def test_text_adapts():
    r = random.Random(12)
    m, counts = trained([zipf(r, 300) for _ in range(30)])
    odd = " ".join(r.choices([f"w{i}" for i in range(60, 120)], k=3000))  # known words in quite other shares
    (t,) = lm.tokens(pa.array([odd]))
    symbol = lm.Index(m.vocabulary.h).find(t.h)
    own = lm.word_contexts(*lm.before(t, m.words.code.rank[symbol], m.frequent))
    whole = lm.coded(m.words, symbol, own, t.bounds)
    first = np.concatenate([lm.coded(m.words, symbol[a : a + 64], [c[a : a + 64] for c in own], np.array([0, len(symbol[a : a + 64])])) for a in range(0, len(symbol), 64)])
    assert whole[64:].sum() < 0.985 * first[64:].sum()


def test_same_at_any_partitioning(spark):
    r = random.Random(2)
    rows = [(i, zipf(r, 80, 3000) + f" own{i}") for i in range(80)] + [(None, "w1 w2"), (3, None)]
    docs = corpus(spark, rows)
    one, many = ({(x.doc_id, x.n_tokens): x.score for x in lm.scores(docs.repartition(n)).collect()} for n in (1, 16))
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], abs=1e-4) for k in one)


def test_sums_in_two_rounds():
    g = np.random.default_rng(0)
    pieces = {(part, p): g.integers(0, 3, 2 * lm.PIECE) for part in range(2) for p in range(5)}
    rows = [(0, part, p % 2, lm.sparse(x)) for (part, p), x in pieces.items()] + [(1, 0, p % 2, np.full(lm.PART, p / 2).tobytes()) for p in range(5)]
    key = [(c, "ascending") for c in ("kind", "part", "p")]
    once = pa.Table.from_batches(list(lm._add_up(False)(lm.table(rows, lm._learnt).sort_by(key).to_batches(max_chunksize=2))))
    assert once.num_rows == 6
    got = {(k, part): b for k, part, _, b in zip(*pa.Table.from_batches(list(lm._add_up(True)(once.sort_by(key).to_batches()))).to_pydict().values(), strict=True)}
    assert np.frombuffer(got[1, 0], np.float64).tolist() == [5.0] * lm.PART
    for part in range(2):
        zeros, ones = lm.unpacked(np.frombuffer(got[0, part], np.uint32))
        want = sum(pieces[part, p] for p in range(5)).reshape(-1, 2)
        assert (zeros == want[:, 0]).all() and (ones == want[:, 1]).all()
    assert lm.unpacked(lm.packed(np.array([[10**6, 1], [0, 1 << 40]], np.uint64)))[1].tolist() == [1.0, 65535.0]


def test_scoring_parts_texts_once(monkeypatch):
    texts = pa.table({"p": pa.array([0, 0, 0], pa.int32()), "doc_id": pa.array([1, 2, 3]), "text": ["the cat sat", "", "a dog sat on the caät"]})
    c = lm.together([lm.counted(t) for t in lm.tokens(texts["text"].slice(0, 2))])
    v = lm.Vocabulary(c.h, c.n, int(c.n.sum()), len(c.h), 3, np.bincount(c.data, minlength=256))
    ready = lm.plan(v)
    model = lm.assembled(v, ready, lm.table([], lm._learnt))
    rare, passes, tokens = lm._rare(lm.tokens(texts["text"]), v.h), [], lm.tokens
    answers = pa.table({"p": pa.array([0], pa.int32()), "shard": pa.array([0], pa.int32()), "counts": [lm.planes(np.zeros(len(rare), np.int64))]})
    monkeypatch.setattr(lm, "tokens", lambda column: passes.append(1) or tokens(column))
    got = lm._score(type("Sent", (), {"value": model}))(texts, answers)
    assert len(passes) == 1 and got["n_tokens"].to_pylist() == [4, 1, 7] and got["n_known"].to_pylist() == [4, 1, 3]
    for text, score in zip(texts["text"].to_pylist(), got["score"].to_pylist(), strict=True):
        (t,) = tokens(pa.array([text]))
        symbol = lm.Index(v.h).find(t.h)
        assert abs(score + lm.text_bits(model, t, symbol, np.append(v.n, 0)[symbol]).sum() * np.log10(2)) < 1e-6 * abs(score)


def test_counts_are_handed_over_narrow():
    # they took sixteen bytes a count, whatever it was
    r = np.random.default_rng(5)
    for size, most, wide in ((1 << 12, 200, 2), (1 << 17, 60_000, 3), (1 << 17, 1 << 40, 9)):
        x = np.zeros(size, np.uint64)
        at = np.sort(np.append(r.choice(size - 1, size // 8, replace=False), size - 1))
        x[at] = r.integers(1, most, len(at), dtype=np.uint64)
        blob = lm.sparse(x)
        places, n = lm.dense(blob)
        assert (places == at).all() and (n == x[at]).all() and len(blob) == 2 + wide * len(at)
    places, n = lm.dense(lm.sparse(np.zeros(9, np.uint32)))
    assert len(places) == len(n) == 0


def test_distinct_tokens_of_a_chunk():
    texts = ["b a b", "", "a c\u00e9 A zz b", None, "b"]
    (t,) = lm.tokens(pa.array([x or "" for x in texts]))
    got = lm.counted(t)
    h, n = np.unique(t.h, return_counts=True)
    assert (got.h == h).all() and (got.n == n).all()
    ends = np.append(0, got.ends)
    spelled = {int(k): got.data[a:b].tobytes() for k, a, b in zip(got.h, ends, ends[1:], strict=False)}
    words = [w for x in texts if x for w in x.replace("A", "a").encode().split(b" ")]
    assert spelled == {int(lm.END): b" "} | {int(k): w + b" " for k, w in zip(t.words.h, words, strict=True)}


def test_a_learner_predicts_once_what_is_passed_again(monkeypatch):
    g = np.random.default_rng(5)
    code = lm.prefix_code(np.append(2 ** g.integers(0, 40, 300), 7))
    deep = lm.prefix_code(np.array([1 << k for k in range(57)]))  # paths that 53 bits don't tell apart
    assert deep.length.max() > 54
    for c, shape, many in ((code, lm.WORDS, 4), (code, lm.LETTERS, 3), (deep, lm.WORDS, 2)):
        symbol = g.integers(0, len(c.length), 6000)
        contexts = [lm.short(g.integers(0, many, 6000).astype(np.uint64)) for _ in range(shape.inputs - 1)]
        x, made, real = lm.Learner(shape, c, 14), [], lm.predictions
        monkeypatch.setattr(lm, "predictions", lambda nodes, slot, *rest: made.append(len(slot)) or real(nodes, slot, *rest))
        x.learn(symbol, contexts)
        monkeypatch.setattr(lm, "predictions", real)
        e = lm.events(c, symbol, contexts, 14)
        passed = {(e.slots[0][k], *(q[i] for q in contexts)) for i, (a, n) in enumerate(zip(e.starts, c.length[symbol], strict=True)) for k in range(a, a + n) if k - a < 54}
        most = len(passed) + int(np.maximum(c.length[symbol] - 54, 0).sum())
        assert len(passed) <= made[0] <= most and 3 * made[0] < len(e.bits)
        for counts, slot in zip(x.counts, e.slots, strict=True):
            assert np.array_equal(counts, np.bincount(2 * slot + e.bits, minlength=len(counts)))
        # all weights are even before the first block: the pull at the inputs is the sum over events, one by one
        share, odds = lm.shares(*np.zeros((2, len(c.length)), np.float32))
        given, levels = real((share, odds), e.slots[0], [(np.zeros(len(e.bits), np.float32),) * 2] * (shape.inputs - 1), shape.confident)
        y = sum(given) / shape.inputs
        off = e.bits - 1 / (1 + np.exp(-y))
        assert abs(sum(given)).max() < 1e-6 and not np.any(levels)
        for place in range(lm.PLACES):
            here = e.place == place
            gate = place * lm.LEVELS**shape.confident
            moved = off[here].sum() / (lm.KEEP * lm.PRIOR + 0.25 * here.sum())
            assert abs(x.w[gate, -1] - np.clip(moved, -lm.STEP, lm.STEP)) < 1e-4
        zeros, ones = x.seen.reshape(2, lm.PLACES, lm.BINS).sum(2)
        assert np.array_equal(zeros + ones, np.bincount(e.place, minlength=lm.PLACES)) and np.array_equal(ones, np.bincount(e.place, e.bits, lm.PLACES))
