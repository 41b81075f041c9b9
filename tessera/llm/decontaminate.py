"""Benchmark passages in documents by spaced-seed hashes and verified, substitution-tolerant overlaps.

A mask lists the token places that a seed reads; the others may differ. Each class of item lengths has masks
of its own, so that every overlap that the verifier accepts has a seed, wherever the differing tokens are (a
test goes through all patterns). Items too short for a substitution are sought exactly. Each seed of the benchmark sets two
bits of a filter that grows with the number of seeds; one pass over the documents keeps the stretches around seeds that pass it. Seeds
are then joined exactly. A seed carries a byte of each of the 32 tokens around it, which hold every window that the seed can
be in, so the join itself counts agreeing tokens and lets go of places that share a phrase but can't overlap enough: where
thousands of documents and hundreds of items have a phrase in common, tokens aren't looked up for all their pairs. Each diagonal
(document place less item place) that is left is verified on the tokens: `SPAN` tokens in line, or a whole shorter item, of which at
least `SHARE` agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.words import LOWER, WORD_BASE, chunks, mix, powers

SPAN, SHARE = 20, 0.8
#: Masks of items of so many tokens or more: 1, 2, 3 and 4 of the least number of tokens may differ.
MASKS = {
    8: ("111011", "11111"),
    10: ("111011", "11010011", "11111"),
    15: ("1111011", "11010001011", "10001100111", "1100010100011"),
    SPAN: ("11110111", "1110000010111", "110010100000111", "100100110010011", "11000101110001"),
}
EXACT_BELOW = min(MASKS)  #: shorter items have to agree in all tokens
WIDTH = max(len(m) for x in MASKS.values() for m in x)
BEFORE = 12  #: tokens before a seed that a window with it may have; a test holds it against the masks
AROUND = BEFORE + SPAN
SEED_BITS, LEAST_FILTER, MOST_FILTER = 32, 1 << 20, 1 << 30  #: bits of the filter for each seed, and bounds of its size in bits: 128 MB are broadcast at most

# letters, digits and bytes above ASCII make tokens
FOLD = LOWER.copy()
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32


def masks_of(n: int) -> list[tuple[int, str]]:
    """(number, mask) of the seeds of items of n tokens; a shorter item than EXACT_BELOW is one seed of all its tokens."""
    if n < EXACT_BELOW:
        return [(n, "1" * n)] if n else []
    least = max(k for k in MASKS if k <= n)
    return [(64 * least + k, m) for k, m in enumerate(MASKS[least])]


def _seed(h: np.ndarray, at: np.ndarray, number: int, mask: str) -> np.ndarray:
    """Seeds of a mask at token places `at`."""
    up = powers(WORD_BASE, WIDTH + 1)[0]
    out = np.full(len(at), number + 1, np.uint64)
    for i, reads in enumerate(mask):
        if reads == "1":
            out += h[at + i] * up[i + 1]
    return mix(out)


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of a seed are set."""
    out = np.ones(len(h), bool)
    for k in (0, 32):
        at = ((h >> np.uint64(k)) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def _around(h: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, none: int) -> np.ndarray:
    """AROUND bytes for each place, as four longs: one of the token there, or `none` outside lo:hi, the bounds of its text."""
    of = (mix(h) % np.uint64(254)).astype(np.uint8) + np.uint8(2)
    out = np.full((len(at), AROUND), none, np.uint8)
    for j in range(AROUND if len(at) else 0):
        place = at + (j - BEFORE)
        inside = (place >= lo) & (place < hi)
        out[inside, j] = of[place[inside]]
    return out.view("<i8")


#: Bytes that stand for no token; two such places don't agree.
NO_ITEM, NO_DOCUMENT = 0, 1
_AROUND = tuple(f"c{k}" for k in range(AROUND // 8))
SEEDS = "item_id long, n int, h long, at int, tokens array<long>, " + ", ".join(f"{c} long" for c in _AROUND)


def _item_seeds(batches):
    """A row for each seed of each item; the first of an item also has its tokens."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * len(_AROUND))
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), []
        for w in chunks(pc.utf8_lower(batch.column(1)), FOLD):
            for i in range(len(w.bounds) - 1):
                h = w.h[w.bounds[i] : w.bounds[i + 1]]
                n = len(h)
                if ids[w.first + i] is None or not n:
                    continue
                near = _around(h, np.arange(n), np.zeros(n, np.int64), np.full(n, n), NO_ITEM).tolist()
                for j, (number, mask) in enumerate(masks_of(n)):
                    at = np.arange(n - len(mask) + 1)
                    for k, (a, s) in enumerate(zip(at.tolist(), _seed(h, at, number, mask).view(np.int64).tolist(), strict=True)):
                        rows.append((ids[w.first + i], n, s, a, h.view(np.int64).tolist() if j == k == 0 else None, *near[a]))
        cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["item_id", "n", "h", "at", "tokens", *_AROUND])


STRETCHES = "doc_id long, start int, tokens array<long>, seeds array<struct<h:long,at:int," + ",".join(f"{c}:long" for c in _AROUND) + ">>"
_seed_type = pa.struct([("h", pa.int64()), ("at", pa.int32()), *((c, pa.int64()) for c in _AROUND)])


def _stretches(bits: np.ndarray, masks: list[tuple[int, str]]):
    def scan(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for w in chunks(pc.utf8_lower(batch.column(1)), FOLD):
                hits, seeds = [], []
                left = np.repeat(w.bounds[1:], np.diff(w.bounds)) - np.arange(len(w.h))
                for number, mask in masks:
                    at = np.flatnonzero(left >= len(mask))
                    s = _seed(w.h, at, number, mask)
                    hit = _passes(bits, s)
                    hits.append(at[hit])
                    seeds.append(s[hit])
                at, s = np.concatenate([*hits, np.zeros(0, np.int64)]), np.concatenate([*seeds, np.zeros(0, np.uint64)])
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, s = at[order], s[order].view(np.int64)
                text = np.searchsorted(w.bounds, at, "right") - 1
                near = _around(w.h, at, w.bounds[text], w.bounds[text + 1], NO_DOCUMENT)
                new = np.flatnonzero(np.concatenate(([True], (at[1:] - at[:-1] > 2 * SPAN) | (text[1:] != text[:-1]))))
                for a, b in zip(new, [*new[1:], len(at)], strict=True):
                    i = text[a]
                    lo, hi = max(w.bounds[i], at[a] - SPAN), min(w.bounds[i + 1], at[b - 1] + WIDTH + SPAN)
                    out.append((ids[w.first + i].as_py(), int(lo - w.bounds[i]), w.h[lo:hi].view(np.int64), s[a:b], (at[a:b] - lo).astype(np.int32), near[a:b]))
            if out:
                doc, start, tokens, h, at, near = zip(*out, strict=True)
                lists = [pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)) for x in (tokens, h)]
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(h)), pa.array(np.concatenate(at)), *map(pa.array, np.concatenate(near).T)], fields=list(_seed_type))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.ListArray.from_arrays(lists[0], pa.array(np.concatenate(tokens))), pa.ListArray.from_arrays(lists[1], pairs)],
                    names=["doc_id", "start", "tokens", "seeds"],
                )

    return scan


def _aligned(a: np.ndarray, b: np.ndarray, shift: int, whole: int):
    """Longest hull of windows in which enough of a[i + shift] and b[i] agree: (first, last, agreeing), places in a."""
    lo, hi = max(0, -shift), min(len(b), len(a) - shift)
    need = min(SPAN, whole)
    if hi - lo < need:
        return None
    same = a[lo + shift : hi + shift] == b[lo:hi]
    sums = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(sums[need:] - sums[:-need] >= (SHARE * need if whole >= EXACT_BELOW else need))
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + need
    return first + lo + shift, last + lo + shift, int(sums[last] - sums[first])


FOUND = "doc_id long, item_id long, first_word int, end_word int, agreeing int"


def _verify(batches):
    for batch in batches:
        rows = []
        doc, start, item, shift, n = (batch.column(c).to_pylist() for c in ("doc_id", "start", "item_id", "shift", "n"))
        for k, (a, b) in enumerate(zip(batch.column("tokens"), batch.column("item_tokens"), strict=True)):
            got = _aligned(np.asarray(a.values), np.asarray(b.values), shift[k], n[k])
            if got:
                rows.append((doc[k], item[k], start[k] + got[0], start[k] + got[1], got[2]))
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "first_word", "end_word", "agreeing"])


def _may_agree(a: str, b: str):
    """Whether enough of the AROUND bytes of aliases a and b are equal for a window of b's item. Never false for an overlap:
    equal tokens have equal bytes, and all tokens of a window with the seed are among them."""
    equal = F.lit(0)
    for c in _AROUND:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        # the lowest bit of each byte now tells whether it has any; shifts carry bits of other bytes into higher ones only
        equal += F.bit_count(F.bitwise_not(x).bitwiseAND(F.lit(0x0101010101010101)))
    n = F.col(f"{b}.n")
    return 100 * equal >= F.least(n, F.lit(SPAN)) * F.when(n < EXACT_BELOW, 100).otherwise(round(100 * SHARE))


def _diagonals(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Stretches and items to verify, with the shift of each: equal seeds around which enough tokens may agree."""
    hits = found.select("doc_id", "start", F.inline("seeds")).alias("d")
    met = hits.join(seeds.drop("tokens").alias("i"), (F.col("d.h") == F.col("i.h")) & _may_agree("d", "i"))
    return met.select("doc_id", "start", "item_id", "n", (F.col("d.at") - F.col("i.at")).alias("shift")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that overlap: doc_id, item_id, first_word, end_word, agreeing.

    Wants docs (doc_id, text) and benchmark (item_id, text). first_word and end_word bound, in the document's
    tokens, all verified windows of the item; agreeing counts equal tokens on the best diagonal. Null texts
    hold nothing, null ids are left out, items of fewer than 8 tokens are looked for exactly, those without tokens
    not at all. Repeated ids are one document or item. No rows on either side give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null")
    # items of equal text are one until the end
    named = items.groupBy("text").agg(F.min("item_id").alias("first_id"), F.collect_set("item_id").alias("ids"))
    seeds = cut(named.select(F.col("first_id").alias("item_id"), "text").mapInArrow(_item_seeds, SEEDS), "seeds")
    n_bits = min(max(LEAST_FILTER, 1 << (SEED_BITS * seeds.count()).bit_length()), MOST_FILTER)
    places = F.explode(F.array(*(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(n_bits - 1)) for k in (0, 32)))).alias("b")
    # at most n_bits / 64 rows, merged by the executors
    words = seeds.select(places).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    bits = np.zeros(n_bits // 64, np.int64)
    bits[words["w"].to_numpy()] = words["v"].to_numpy()
    masks = sorted({m for r in seeds.select(F.least("n", F.lit(SPAN))).distinct().collect() for m in masks_of(r[0])})
    filter_bytes = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def scan(batches):
        return _stretches(filter_bytes.value, masks)(batches)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    found = cut(texts.mapInArrow(scan, STRETCHES), "stretches")
    lines = _diagonals(found, seeds)
    tokens = seeds.filter("tokens is not null").select("item_id", "n", F.col("tokens").alias("item_tokens"))
    pairs = lines.join(found.select("doc_id", "start", "tokens"), ["doc_id", "start"]).join(tokens, ["item_id", "n"])
    verified = pairs.select("doc_id", "start", "item_id", "shift", "n", "tokens", "item_tokens").mapInArrow(_verify, FOUND)
    best = lambda df: df.groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.max("agreeing").alias("agreeing"))
    each = best(verified).withColumnRenamed("item_id", "first_id").join(named.select("first_id", F.explode("ids").alias("item_id")), "first_id")
    return best(each.select("doc_id", "item_id", "first_word", "end_word", "agreeing"))
