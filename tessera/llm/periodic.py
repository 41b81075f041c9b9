"""Periodic runs of words: a suffix automaton whose end-position sets are merged, the smaller into the larger.

A square uu of words makes u end at two places that are neighbours among all places where u ends. The automaton's
states are sets of words' stretches with equal end positions, and its link tree joins these sets; a pair of end
positions becomes neighbours in the state that stands for the longest stretch that both end. So a pair that is new in
a state of length L and no more than L apart is a square, and every run has one such pair. Squares are extended to
runs once, and a run keeps its smallest period.

Only stretches of a text that may hold a run go through the automaton: each word of a run of `least` words or more is
in some least // 2 consecutive words that recur within the run (in one of its halves if the period is that long, else
within one period of itself), so words that no recurring window covers part the text. This leaves no run out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: End positions in one block of an ordered set.
BLOCK = 1024
#: How often stretches are parted anew by windows that recur within themselves.
ROUNDS = 3
#: Bytes of kept text in one Arrow batch.
FLUSH = 8 << 20


class Ends:
    """An ordered set of end positions in blocks; `add` tells the neighbours of what it puts in."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        i = max(bisect_right(self.heads, x) - 1, 0)
        block = self.blocks[i]
        j = bisect_left(block, x)
        before = block[j - 1] if j else self.blocks[i - 1][-1] if i else None
        after = block[j] if j < len(block) else self.blocks[i + 1][0] if i + 1 < len(self.blocks) else None
        block.insert(j, x)
        self.heads[i] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks.insert(i + 1, block[BLOCK:])
            self.heads.insert(i + 1, block[BLOCK])
            del block[BLOCK:]
        return before, after


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end position (-1: a copied state has none) of each state; the root is 0."""
    length, link, end, steps = [0], [-1], [-1], [{}]
    last = 0
    for at, c in enumerate(words):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(at)
        steps.append({})
        p, last = last, new
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p < 0:
            continue
        q = steps[p][c]
        if length[p] + 1 == length[q]:
            link[new] = q
            continue
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        end.append(-1)
        steps.append(steps[q].copy())
        while p >= 0 and steps[p].get(c) == q:
            steps[p][c] = copy
            p = link[p]
        link[q] = link[new] = copy
    return length, link, end


class Runs:
    """Maximal stretches by period, found from squares."""

    def __init__(self, words: list[int]):
        self.words, self.by_period, self.smallest = words, {}, {}

    def _same(self, a: int, b: int, period: int) -> bool:
        return self.words[a:b] == self.words[a + period : b + period]

    def square(self, end: int, period: int) -> None:
        """Take the square of `period` whose last word is `end`, unless its run is known."""
        first, n = end - 2 * period + 1, len(self.words) - period
        starts, stops = self.by_period.setdefault(period, ([], []))
        i = bisect_right(starts, first)
        if i and stops[i - 1] > end:
            return
        # [low, high): places where the words agree with those a period later
        low, high, step, grow = first, first + period, 16, True
        while step:
            if low >= step and self._same(low - step, low, period):
                low -= step
                step *= 2 if grow else 1
            else:
                grow = False
                step //= 2
        step, grow = 16, True
        while step:
            if high + step <= n and self._same(high, high + step, period):
                high += step
                step *= 2 if grow else 1
            else:
                grow = False
                step //= 2
        starts.insert(i, low)
        stops.insert(i, high + period)
        key = low, high + period
        self.smallest[key] = min(period, self.smallest.get(key, period))


def all_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal stretch that is two periods long at least."""
    length, link, end = automaton(words)
    sets: list = [None if e < 0 else e for e in end]
    found = Runs(words)
    for v in np.argsort(-np.asarray(length), kind="stable").tolist():
        up, small = link[v], sets[v]
        sets[v] = None
        if up <= 0:  # the root stands for no words
            continue
        large = sets[up]
        if large is None:
            sets[up] = small
            continue
        if isinstance(small, int) and not isinstance(large, int):
            small, large = (small,), large
        elif isinstance(large, int) and not isinstance(small, int):
            small, large = (large,), small
        elif isinstance(small, int):
            small, large = (small,), Ends(large)
        elif small.size > large.size:
            small, large = large, small
        most = length[up]
        for x in small:
            before, after = large.add(x)
            if before is not None and x - before <= most:
                found.square(x, x - before)
            if after is not None and after - x <= most:
                found.square(after, after - x)
        sets[up] = large
    return [(a, b - a, period) for (a, b), period in found.smallest.items()]


def stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges of words outside of which no run of `least` words lies."""
    k = max(least // 2, 1)
    found, todo = [], [(0, len(ids), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < max(least, 2):
            continue
        x = ids[a:b].astype(np.uint64)
        h = np.zeros(len(x) - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : len(x) - k + 1 + j]
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        recurs = np.zeros(len(x) + 1, np.int64)
        at = np.union1d(order[1:][same], order[:-1][same])
        recurs[at] += 1
        recurs[at + k] -= 1
        inside = np.cumsum(recurs) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        parts = list(zip((edges[::2] + a).tolist(), (edges[1::2] + a).tolist(), strict=True))
        if parts == [(a, b)] or depth + 1 == ROUNDS:
            found += parts
        else:
            todo += [(*p, depth + 1) for p in parts]
    return sorted(p for p in found if p[1] - p[0] >= max(least, 2))


def runs_of(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of `least` words and two periods at least, by start, then period."""
    if len(words) < least:
        return []
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(words) - len(number) < least // 2:  # too few words recur
        return []
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return sorted(((a + s, n, p) for a, b in stretches(ids, least) for s, n, p in all_runs(ids[a:b].tolist()) if n >= least), key=lambda r: (r[0], r[2]))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run covers after its first period."""
    if not found:
        return words
    covers = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        covers[start + period] += 1
        covers[start + length] -= 1
    return list(compress(words, (np.cumsum(covers[:-1]) == 0).tolist()))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, least: int = LEAST, text: Column | None = None) -> DataFrame:
    """doc_id, n_words, the text's runs of words and the text without their repetitions, a row for each row of docs.

    Words are stretches of other characters than U+0020 and U+0009 to U+000D. A null or empty text has no words, no
    runs and an empty collapsed text; null and repeated doc_ids stay as they are; columns of docs other than doc_id
    and `text` (default: its column) are not read. Runs that overlap are all given; a word goes if any run that covers
    it has begun a period before. A text is one task's work and takes some 400 bytes a word of its recurring stretches.
    """

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (value.as_py() or b"").split()
                found = runs_of(words, least)
                kept = b" ".join(collapsed(words, found))
                rows.append((doc, len(words), found, kept))
                size += len(kept)
                if size > FLUSH:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    text = F.col("text") if text is None else text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("string").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def _batch(rows: list) -> pa.RecordBatch:
    flat = np.array([r for row in rows for r in row[2]], np.int64).reshape(-1, 3)
    runs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN))
    offsets = pa.array(np.cumsum([0, *(len(row[2]) for row in rows)]), pa.int32())
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.ListArray.from_arrays(offsets, runs), pa.array([r[3] for r in rows], pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def looped(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids one whose words from a place on go round: word i >= a is word a + (i - a) % p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def turned(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        loop = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.flatten(F.array_repeat(loop, F.ceil((n - a) / p).cast("int")))), F.lit(1), F.size(w)), " ")

    return F.when((h % 10 == 0) & F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)), F.get(F.transform(F.array(words), turned), F.lit(0))).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """One line a document of what `periodic_runs` found: counts, the longest run, and hashes of runs and kept words."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
