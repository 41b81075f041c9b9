"""Language-model scores of whole texts by online logistic context mixing over hashed-context bit predictors.

A token is coded bit by bit: the bits of its path in a prefix code over frequent words, or the code's escape and then
either the exact share of a known rare word or, for a word never seen in training, its bytes, bit by bit under a
prefix code of bytes. For each bit several predictors, each a pair of counts found by the hash of a context, give
their log odds; weights gated by the place in the code and by how well the longest contexts are known add them up; a
last stage refines the sum by what was seen at such sums before. The sum of the bits' logs is the text's probability,
and divided by its bytes the bits per byte.

Learning is one online pass. Training texts are dealt by a hash of the row into groups, put in order there and coded
block by block: a block is predicted from the counts, weights and refinement that the blocks before it left, and then
changes all three. Symbols of a block that pass one node of the code in the same contexts are learnt from together. The groups' counts add up; their weights are joined by how sure each group is of them. Neither
depends on how the input is partitioned. Word counts are exact, by hash shards, without a limit; the number of coded
words and the width of the tables grow with the square root of the training tokens up to `MOST_TOP` and `MOST_BITS`,
which bound what is broadcast.

Scoring goes on where learning ended, for each text by itself: after every block of a text the text's own weights and
its own refinement follow what the block showed, and the shares of new, known and repeated rare words follow their
counts in the text so far.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, groups_for, shuffle_width
from tessera.llm.words import LOWER, chunks, mix, text_buffers

TOP_ROOT, LEAST_TOP, MOST_TOP = 3, 1 << 12, 1 << 18  #: words in the prefix code, as a multiple of the root of all tokens, and its bounds
LEAST_BITS, MOST_BITS = 14, 24  #: bounds of the log2 of a hashed table's slots
GROUP_CHARS, LEAST_GROUPS = 24 << 20, 12
GROUPS_A_SHARD, LEAST_SHARDS = 2, 24  #: shards of exact counts
END = np.uint64(0x5851F42D4C957F2D)
COMMON = 64  #: so many of the most frequent words make contexts wherever they stood last
PLACES, LEVELS, BINS = 32, 4, 33
BLOCK = 1 << 15  #: symbols that are learnt from at a time
SLICE = 1 << 13  #: symbols that are coded at a time; their arrays stay in the processor's cache
REACH = 8.0


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def numbers(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


# ---- tokens


class Tokens(NamedTuple):
    first: int  #: index of the first text of this chunk
    bounds: np.ndarray  #: tokens of text first + i are bounds[i]:bounds[i + 1], the end among them
    h: np.ndarray
    words: object  #: the chunk's words, in the same order without the ends


def tokens(column: pa.Array):
    for w in chunks(column, LOWER):
        yield Tokens(w.first, w.bounds + np.arange(len(w.bounds)), np.insert(w.h, w.bounds[1:], END), w)


class Kept(NamedTuple):
    """What is left to score of a chunk's texts: a number for each token, and the words without a code."""

    bounds: np.ndarray
    symbol: np.ndarray
    place: np.ndarray  #: of the words without a code among the tokens
    h: np.ndarray
    data: np.ndarray  #: their bytes, one after the other
    ends: np.ndarray


def kept(t: Tokens, symbol: np.ndarray, coded: int) -> Kept:
    place = np.flatnonzero(symbol == coded)
    i = place - np.searchsorted(t.bounds, place, "right") + 1
    starts, ends = t.words.starts[i], t.words.ends[i]
    return Kept(t.bounds, symbol.astype(np.int32), place, t.h[place], pick(t.words.data, starts, ends), np.cumsum(ends - starts))


def before(t: Tokens | Kept, rank: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token, by frequency ranks: the last common word before it, over the whole text so far, and the word
    just before if it is a frequent one; 0 for none."""
    place = np.arange(int(t.bounds[-1]))
    begin = np.repeat(t.bounds[:-1], np.diff(t.bounds))
    at = np.concatenate(([-1], np.maximum.accumulate(np.where(rank < COMMON, place, -1))[:-1]))
    common = np.where(at >= begin, rank[at] + 1, 0)
    just = np.where((place > begin) & (rank[place - 1] < frequent), rank[place - 1] + 1, 0)
    return common.astype(np.uint64), just.astype(np.uint64)


class Index:
    """Places of fingerprints in a sorted array, found by their first bits."""

    def __init__(self, h: np.ndarray):
        bits = max(8, (8 * len(h)).bit_length())
        self.h, self.shift = np.append(h, np.uint64(0)), np.uint64(64 - bits)
        self.first = np.append(np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(h)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each, the array's length for what it lacks."""
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        other = np.flatnonzero((self.h[at] != h) & (at + 1 < end))
        while len(other):
            at[other] += 1
            other = other[(self.h[at[other]] != h[other]) & (at[other] + 1 < end[other])]
        return np.where((at < end) & (self.h[at] == h), at, len(self.h) - 1)


# ---- exact word counts

COUNTS = "shard int, words binary, counts binary, spelled binary, n_tokens long, n_words long, by_size array<long>, by_byte array<long>"
_counts = pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("spelled", pa.binary()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("by_size", pa.list_(pa.int64())), ("by_byte", pa.list_(pa.int64()))])
COUNTED = "shard int, words binary, counts binary, spelled binary"
_counted = pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("spelled", pa.binary())])
MOST_HELD = 1 << 21  #: distinct words that a task holds before it hands over their counts


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int32)


class Counted(NamedTuple):
    """Distinct words, sorted: fingerprints, counts, and bytes with a space after each."""

    h: np.ndarray
    n: np.ndarray
    data: np.ndarray
    ends: np.ndarray  #: of each word in data, with its space


def pick(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of these ranges, one after the other."""
    size = ends - starts
    return data[np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)]


def counted(t: Tokens) -> Counted:
    """Distinct tokens of a chunk; the end has no bytes."""
    w = t.words
    # by a hash table, which numbers words as they first occur; the distinct ones alone are sorted
    numbered = pa.array(w.h).dictionary_encode()
    code, h = numbered.indices.to_numpy(), numbered.dictionary.to_numpy()
    order = np.argsort(h)
    at = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))[order]
    h, n = h[order], np.bincount(code, minlength=len(h))[order]
    size = w.ends[at] - w.starts[at] + 1
    ends = np.cumsum(size)
    data = np.full(int(size.sum()), 32, np.uint8)
    inner = np.ones(len(data), bool)
    inner[ends - 1] = False
    data[inner] = pick(w.data, w.starts[at], w.ends[at])
    i = int(np.searchsorted(h, END))
    before_ = int(ends[i - 1]) if i else 0
    return Counted(np.insert(h, i, END), np.insert(n, i, len(t.bounds) - 1), np.insert(data, before_, 32), np.insert(ends + (np.arange(len(ends)) >= i), i, before_ + 1))


def together(parts: list[Counted]) -> Counted:
    none = np.zeros(0, np.int64)
    h, n, data = (np.concatenate([none.astype(kind), *(p[k] for p in parts)]) for k, kind in ((0, np.uint64), (1, np.int64), (2, np.uint8)))
    base = np.cumsum([0, *(len(p.data) for p in parts)])
    ends = np.concatenate([none, *(p.ends + b for p, b in zip(parts, base, strict=False))])
    starts = np.concatenate([none, *(np.concatenate(([0], p.ends[:-1])) + b if len(p.ends) else none for p, b in zip(parts, base, strict=False))])
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.diff(h[order], prepend=np.uint64(0)) != 0)
    if len(h) and h[order[0]] == 0:
        new = np.union1d([0], new)
    first = order[new]
    return Counted(h[first], np.add.reduceat(n[order], new) if len(new) else n, pick(data, starts[first], ends[first]), np.cumsum(ends[first] - starts[first]))


def by_shard(h: np.ndarray, shards: int):
    """(shard, slice) over sorted fingerprints."""
    s = shard_of(h, shards)
    cuts = np.flatnonzero(np.diff(s, prepend=-1, append=shards))
    return [(int(s[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _count(shards: int):
    def count(batches):
        held, size = [], 0

        def rows():
            c = together(held)
            ends = np.concatenate(([0], c.ends))
            parts = [(s, planes(c.h[i]), planes(c.n[i].astype(np.uint32)), c.data[ends[i.start] : ends[i.stop]].tobytes()) for s, i in by_shard(c.h, shards)]
            return table(parts, _counted).combine_chunks().to_batches()

        for batch in batches:
            for t in tokens(batch.column(0)):
                held.append(counted(t))
                size += len(held[-1].h)
                if size > MOST_HELD:
                    held = [together(held)]
                    size = len(held[0].h)
                    if size > MOST_HELD // 2:
                        yield from rows()
                        held, size = [], 0
        yield from rows()

    return count


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(8 * np.log2(np.maximum(n, 1))).astype(np.int64)


def _sum_words(part: pa.Table) -> pa.Table:
    def one(words, counts, blob):
        data = np.frombuffer(blob, np.uint8)
        return Counted(numbers(words, np.uint64), numbers(counts, np.uint32).astype(np.int64), data, np.flatnonzero(data == 32) + 1)

    c = together([one(*x) for x in zip(*(part[k].to_pylist() for k in ("words", "counts", "spelled")), strict=True)])
    return table([(part["shard"][0].as_py(), planes(c.h), planes(c.n), c.data.tobytes(), int(c.n.sum()), len(c.h), np.bincount(size_class(c.n)).tolist(), np.bincount(c.data, minlength=256).tolist())], _counts)


def word_counts(train: DataFrame, shards: int) -> DataFrame:
    """Exact counts (COUNTS) of all tokens of train (text), a row a shard, with the spelling of each word and the counts
    of bytes over distinct words; in the shared folder."""
    return cut(train.select("text").mapInArrow(_count(shards), COUNTED).groupBy("shard").applyInArrow(_sum_words, COUNTS), "words")


class Vocabulary(NamedTuple):
    """Frequent words and the end, sorted, with their exact counts; totals over all training tokens."""

    h: np.ndarray
    n: np.ndarray
    total: int
    distinct: int
    once: int
    letters: np.ndarray  #: counts of bytes over distinct words, that of the space for their ends


def vocabulary(counts: DataFrame, top: int | None = None) -> Vocabulary:
    """The most frequent words, as many as the square root of all tokens asks for or `top`."""
    sums = counts.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    classes = counts.select(F.posexplode("by_size").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("k")).collect()
    top = top or int(min(max(TOP_ROOT * math.sqrt(sums[0] or 0), LEAST_TOP), MOST_TOP))
    least, room, once = None, top, 0
    for k, n in classes:  # as many classes as there are powers of 2 ** (1 / 8) below the largest count
        once = n if k == 0 else once
        room -= n
        if room >= 0:
            least = k
    if least is None:
        least = 1 << 20  # no class: only the end

    def frequent(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = numbers(b, np.int64)
                h = numbers(a, np.uint64)
                keep = (size_class(n) >= least) | (h == END)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep])], names=["h", "n"])

    got = counts.select("words", "counts").mapInArrow(frequent, "h long, n long").toArrow()  # at most `top` rows and the end
    h, n = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    if END not in h:  # no texts
        h, n = np.append(h, END), np.append(n, 0)
    order = np.argsort(h)
    letters = np.zeros(256, np.int64)
    for r in counts.select(F.posexplode("by_byte").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():  # 256 rows
        letters[r.k] = r.n
    return Vocabulary(h[order], n[order], int(sums[0] or 0), int(sums[1] or 0), int(once), letters)


class Code(NamedTuple):
    """A prefix code; the symbols' paths stand one after the other: nodes, their hashes, bits and places."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    key: np.ndarray
    bit: np.ndarray
    place: np.ndarray
    rank: np.ndarray  #: of each symbol by its count; the last symbol, in a code of words the escape, far behind
    word: np.ndarray  #: the first 64 bits of each symbol's path, the first one highest
    order: np.ndarray  #: of each symbol by its path, so that symbols with a common beginning stand together


def prefix_code(n: np.ndarray) -> Code:
    """Shortest mean path for the given counts, by joining the two lightest trees again and again."""
    heap = [(int(c) + 1, k, k) for k, c in enumerate(n)]
    heapq.heapify(heap)
    up, made = {}, len(n)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[2]], up[b[2]] = (made, 0), (made, 1)
        heapq.heappush(heap, (a[0] + b[0], made, made))
        made += 1
    paths = []
    for k in range(len(n)):
        path, at = [], k
        while at in up:
            at, bit = up[at]
            path.append((made - 1 - at, bit))
        paths.append(path[::-1])
    rank = np.full(len(n), 1 << 30, np.int64)
    rank[np.argsort(-np.asarray(n[:-1]), kind="stable")] = np.arange(len(n) - 1)
    length = np.array([len(p) for p in paths], np.int64)
    flat = np.array([x for p in paths for x in p], np.int64).reshape(-1, 2)
    place = np.minimum(np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length), PLACES - 1)
    node = np.ascontiguousarray(flat[:, 0])
    word = np.array([sum(bit << (63 - d) for d, (_, bit) in enumerate(p[:64])) for p in paths], np.uint64)
    order = np.empty(len(n), np.uint64)
    order[np.argsort(word, kind="stable")] = np.arange(len(n), dtype=np.uint64)
    return Code(np.cumsum(length) - length, length, node, short(node.astype(np.uint64) * NODE), flat[:, 1].astype(np.uint8), place.astype(np.uint8), rank, word, order)


# ---- bit events

NODE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x9E3779B1)


class Events(NamedTuple):
    slots: list[np.ndarray]  #: for each predictor; the first one knows the place in the code only
    bits: np.ndarray
    place: np.ndarray  #: 0 to PLACES - 1, how far down the code
    starts: np.ndarray  #: first event of each symbol


def short(x: np.ndarray) -> np.ndarray:
    """Hashes of contexts, 32 bits."""
    return (mix(x) >> np.uint64(32)).astype(np.uint32)


def events(code: Code, symbol: np.ndarray, contexts: list[np.ndarray], bits: int) -> Events:
    length = code.length[symbol]
    starts = np.cumsum(length) - length
    path = np.arange(int(length.sum())) + np.repeat(code.start[symbol] - starts, length)
    key, shift = code.key.take(path), np.uint32(32 - bits)
    return Events([code.node.take(path), *(((np.repeat(c, length) ^ key) * SPREAD >> shift).astype(np.int64) for c in contexts)], code.bit.take(path), code.place.take(path), starts)


class Passed(NamedTuple):
    """The distinct nodes that symbols pass, by depth; a node passed in other contexts is another one. What is counted
    there is the same for all that pass it."""

    slots: list[np.ndarray]  #: for each predictor, as of events
    place: np.ndarray
    zeros: np.ndarray  #: how many symbols go on by each bit
    ones: np.ndarray


ORDER_BITS = np.uint64(20)  #: more than MOST_TOP asks for


def passed(code: Code, symbol: np.ndarray, contexts: list[np.ndarray], bits: int) -> Passed:
    h = np.zeros(len(symbol), np.uint64)
    for c in contexts:
        h = (h ^ c) * NODE
    sort = np.argsort(h >> ORDER_BITS << ORDER_BITS | code.order.take(symbol))
    # contexts are told apart by themselves: where their hashes agree, less is found to be the same
    same, own = np.ones(len(sort), bool), symbol.take(sort)
    same[:1] = False
    for c in contexts:
        c = c.take(sort)
        same[1:] &= c[1:] == c[:-1]
    begin = np.flatnonzero(~(same & (own == np.roll(own, 1))))
    own, many = own.take(begin), np.diff(begin, append=len(sort))
    word = code.word.take(own)
    # the depth at which each path leaves that of the one before it; numbers of 53 bits are floats exactly
    leaves = np.where(same[begin], 53 - np.frexp(((word ^ np.roll(word, 1)) >> np.uint64(11)).astype(np.float64))[1], -1).astype(np.int16)
    by, length, path = sort.take(begin), code.length.take(own), code.start.take(own)
    out, deep = [], 0
    while True:
        go = np.flatnonzero(length > deep)
        if not len(go):
            break
        by, length, path, many, leaves = (x.take(go) for x in (by, length, path, many, leaves))
        cuts = np.flatnonzero(leaves < deep)  # the first is one of them
        at = path + deep
        ones = np.add.reduceat(many * code.bit.take(at), cuts)
        out.append((by.take(cuts), at.take(cuts), np.add.reduceat(many, cuts) - ones, ones))
        deep += 1
    by, path, zeros, ones = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out, strict=True) if out else [[]] * 4))
    key, shift = code.key.take(path), np.uint32(32 - bits)
    return Passed([code.node.take(path), *(((c.take(by) ^ key) * SPREAD >> shift).astype(np.int64) for c in contexts)], code.place.take(path), zeros, ones)


def word_contexts(common: np.ndarray, just: np.ndarray) -> list[np.ndarray]:
    return [short(common), short(just + np.uint64(1 << 32))]


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bytes of words, a space after each; where each word begins; for each byte contexts of the two, three and four
    bytes before it in its word."""
    size = ends - starts + 1
    first = np.cumsum(size) - size
    rep = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(rep)) - first[rep]
    byte = np.where(at == size[rep] - 1, 32, data[np.minimum(starts[rep] + at, max(len(data) - 1, 0))]) if len(data) else np.full(len(rep), 32, np.uint8)
    own, sum_ = [], np.zeros(len(byte), np.uint64)
    for k in range(1, 5):
        back = np.zeros(len(byte), np.uint64)
        back[k:] = np.where(at[k:] >= k, byte[:-k], 0)
        sum_ = sum_ | back << np.uint64(8 * (k - 1))
        if k > 1:
            own.append(short(sum_ + (np.uint64(k) << np.uint64(56))))
    return byte.astype(np.int64), first, own


# ---- what is learnt


class Shape(NamedTuple):
    """Of a mixer: how many predictors, and how many of them, from the last, have a part in the gate."""

    inputs: int
    confident: int

    @property
    def gates(self) -> int:
        return PLACES * LEVELS**self.confident

    def sizes(self, code: Code, bits: int) -> list[int]:
        return [len(code.length), *[1 << bits] * (self.inputs - 1)]


WORDS, LETTERS = Shape(3, 2), Shape(4, 2)
SHAPES = (WORDS, LETTERS)
PRIOR, STEP = 4.0, 0.5  #: how sure the even weights are, in events; the most that a weight moves in one step
SHRINK = 1.5  #: events that the first predictor's share counts for in any other
KEEP = 0.98  #: a block's share in what weights and refinement rest on shrinks by this with each later block


def level(n: np.ndarray) -> np.ndarray:
    """How well a context is known by what was counted in it."""
    return (n > 0).view(np.int8) + (n > 3).view(np.int8) + (n > 31).view(np.int8)


def shares(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the first predictor says at each node: the share of ones, and its log odds."""
    share = (ones + np.float32(0.4)) / (zeros + ones + np.float32(0.8))
    return share, np.log(share / (1 - share))


def predictions(nodes: tuple[np.ndarray, np.ndarray], slot: np.ndarray, pairs, confident: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Log odds of a one by each predictor, and the levels of the last ones as one number, from the first predictor's
    shares and the others' pairs of counts (zeros, ones). These weigh against the first one's share, so that an unknown
    context says what that one says."""
    share = nodes[0].take(slot) * np.float32(SHRINK)
    x, levels, rest = [nodes[1].take(slot)], 0, np.float32(SHRINK) - share
    for k, (zeros, ones) in enumerate(pairs):
        if k >= len(pairs) - confident:
            levels = levels * LEVELS + level(zeros + ones)
        x.append(np.log((ones + share) / (zeros + rest)))
    return x, levels


def packed(pair: np.ndarray) -> np.ndarray:
    """Pairs of counts as two halves of 32 bits; larger ones keep their ratio."""
    most = np.maximum(pair.max(1), 1)
    small = np.minimum(np.where(most[:, None] > 0xFFFF, np.maximum(pair * (0xFFFF / most[:, None]), pair > 0), pair), 0xFFFF).astype(np.uint32)
    return small[:, 0] | small[:, 1] << np.uint32(16)


def unpacked(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # signed numbers of 32 bits become floats faster, and halves fit them
    return tuple(half.view(np.int32).astype(np.float32) for half in (pair & np.uint32(0xFFFF), pair >> np.uint32(16)))


def bins(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = (np.clip(y, -REACH, REACH) + np.float32(REACH)) * np.float32((BINS - 1) / (2 * REACH))
    low = np.minimum(s.astype(np.int32), BINS - 2)
    return low, s - low.astype(np.float32)


class Learner:
    """Counts, weights and refinement of one mixer, as left by what it coded so far."""

    def __init__(self, shape: Shape, code: Code, bits: int):
        self.shape, self.code, self.bits, n = shape, code, bits, shape.inputs
        self.counts = [np.zeros(2 * size, np.uint32) for size in shape.sizes(code, bits)]
        self.first = np.append(np.full(n, 1 / n), 0.0)
        self.w = np.tile(self.first, (shape.gates, 1))
        self.sure = np.tile(PRIOR * np.eye(n + 1), (shape.gates, 1, 1))
        self.seen = np.zeros(2 * PLACES * BINS)

    def learn(self, symbol: np.ndarray, contexts: list[np.ndarray]) -> None:
        p = passed(self.code, symbol, contexts, self.bits)
        # no group has so many tokens that signed numbers, which become floats faster, would not hold a count
        pairs = (counts.view(np.uint64).take(slot).view(np.int32).reshape(-1, 2).astype(np.float32) for counts, slot in zip(self.counts[1:], p.slots[1:], strict=True))
        nodes = shares(*self.counts[0].reshape(-1, 2).T.astype(np.float32))
        x, levels = predictions(nodes, p.slots[0], [(c[:, 0], c[:, 1]) for c in pairs], self.shape.confident)
        gate = p.place * np.int16(LEVELS**self.shape.confident) + levels
        order = np.argsort(gate, kind="stable")
        gate, zeros, ones = gate.take(order), p.zeros.take(order).astype(np.float32), p.ones.take(order).astype(np.float32)
        x, n = [one.take(order) for one in x], self.shape.inputs  # besides these a last input, which is 1
        cuts = np.flatnonzero(np.diff(gate, prepend=-1))
        size, here = np.diff(cuts, append=len(gate)), gate[cuts]
        w = self.w[here].T.astype(np.float32)
        y = np.repeat(w[n], size)
        for k, one in enumerate(x):
            y += np.repeat(w[k], size) * one
        low, part = bins(y)
        near = p.place.take(order) * np.int16(BINS) + low + (part > 0.5)
        self.seen = KEEP * self.seen + np.concatenate([np.bincount(near, many, PLACES * BINS) for many in (zeros, ones)])
        likely = 1 / (1 + np.exp(-np.clip(y, -30, 30)))
        mean = (zeros + ones) * likely
        off, curve = ones - mean, mean * (1 - likely)
        pull = np.stack([*(np.add.reduceat(off * one, cuts) for one in x), np.add.reduceat(off, cuts)], 1).astype(np.float64)
        bend = np.empty((len(cuts), n + 1, n + 1))
        bend[:, n, n] = np.add.reduceat(curve, cuts)
        for i, a in enumerate(x):
            weighed = curve * a
            bend[:, i, n] = bend[:, n, i] = np.add.reduceat(weighed, cuts)
            for j in range(i + 1):
                bend[:, i, j] = bend[:, j, i] = np.add.reduceat(weighed * x[j], cuts)
        self.sure[here] = KEEP * self.sure[here] + bend
        self.w[here] += np.clip(np.linalg.solve(self.sure[here], pull[:, :, None])[:, :, 0], -STEP, STEP)
        more = p.zeros.astype(np.uint64) | p.ones.astype(np.uint64) << np.uint64(32)
        for counts, slot in zip(self.counts, p.slots, strict=True):
            np.add.at(counts.view(np.uint64), slot, more)

    def sums(self) -> list[np.ndarray]:
        """What adds up over learners: curvature, curvature times weights, and what was seen."""
        return [self.sure, np.einsum("gij,gj->gi", self.sure, self.w), self.seen]


def sum_shapes(shape: Shape) -> list[tuple]:
    return [(shape.gates, shape.inputs + 1, shape.inputs + 1), (shape.gates, shape.inputs + 1), (2 * PLACES * BINS,)]


PIECE, PART = 1 << 16, 1 << 12  #: slots, and numbers of the sums, in a row


def sparse(x: np.ndarray) -> bytes:
    """How far what is not 0 in x is from what came before, then what it is; both in as few bytes as the largest asks for."""
    at = np.flatnonzero(x)
    parts = [y.astype(np.min_scalar_type(int(y.max(initial=0)))) for y in (np.diff(at, prepend=0), x.take(at))]
    return bytes(y.dtype.itemsize for y in parts) + b"".join(planes(y) for y in parts)


def dense(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places, and what is there."""
    a, b = blob[0], blob[1]
    end = 2 + (len(blob) - 2) // (a + b) * a
    return np.cumsum(numbers(blob[2:end], f"u{a}"), dtype=np.int64), numbers(blob[end:], f"u{b}")


#: kind 0: a piece of the counts; 1 and 2: a part of the sums of the mixer of words, and of letters.
LEARNT = "kind int, part int, p int, data binary"
_learnt = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("p", pa.int32()), ("data", pa.binary())])


def _slots(codes: list[Code], bits: list[int]) -> list[np.ndarray]:
    """For each mixer where its tables begin, in slots, at whole pieces; the last number is the end."""
    at, out = 0, []
    for shape, code, b in zip(SHAPES, codes, bits, strict=True):
        out.append(at + np.cumsum([0, *(-(-size // PIECE) * PIECE for size in shape.sizes(code, b))]))
        at = int(out[-1][-1])
    return out


def _handed_over(which: int, at: np.ndarray, p: int, x: Learner) -> pa.Table:
    rows = []
    for a, counts in zip(at.tolist(), x.counts, strict=False):
        rows += [(0, a // PIECE + k, p, sparse(counts[b : b + 2 * PIECE])) for k, b in enumerate(range(0, len(counts), 2 * PIECE))]
    sums = np.concatenate([np.ravel(y) for y in x.sums()])
    return table(rows + [(1 + which, k, p, sums[a : a + PART].tobytes()) for k, a in enumerate(range(0, len(sums), PART))], _learnt)


def _learn_words(model):
    def learn(texts: pa.Table) -> pa.Table:
        words, codes, bits, frequent = model.value
        texts = texts.sort_by([(c, "ascending") for c in ("r", "doc_id", "text")])
        found, x = Index(words), Learner(WORDS, codes[0], bits[0])
        for t in tokens(texts["text"]):
            symbol = found.find(t.h)
            own = word_contexts(*before(t, codes[0].rank[symbol], frequent))
            for a in range(0, len(symbol), BLOCK):
                x.learn(symbol[a : a + BLOCK], [c[a : a + BLOCK] for c in own])
        return _handed_over(0, _slots(codes, bits)[0], texts["p"][0].as_py(), x)

    return learn


def _learn_letters(model):
    """From the words of a shard that have no code, each once, in the order of their fingerprints."""

    def learn(shards):
        words, codes, bits, _ = model.value
        found = Index(words)
        for batch in shards:
            for shard, h, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x, data = Learner(LETTERS, codes[1], bits[1]), np.frombuffer(blob, np.uint8)
                ends = np.flatnonzero(data == 32)
                rare = np.flatnonzero(found.find(numbers(h, np.uint64)) == len(words))
                starts = np.concatenate(([0], ends[:-1] + 1))
                for a in range(0, len(rare), BLOCK // 8):
                    i = rare[a : a + BLOCK // 8]
                    byte, _, own = spelled(data, starts[i], ends[i])
                    x.learn(byte, own)
                yield from _handed_over(1, _slots(codes, bits)[1], shard, x).combine_chunks().to_batches()

    return learn


def _add_up(last: bool):
    """Sums of the rows of each key, which come sorted by it, one key at a time. The last round's key is (kind, part);
    it packs pairs of counts."""

    def made(kind, part, p, x):
        if not kind and last:
            x = packed(x.reshape(-1, 2))
        data = sparse(x) if not kind and not last else x.tobytes()
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in (kind, part, p)), pa.array([data], pa.binary())], names=_learnt.names)

    def add(batches):
        key, x = None, None
        for batch in batches:
            for kind, part, p, blob in zip(*(batch.column(c).to_pylist() for c in _learnt.names), strict=True):
                own = (kind, part, 0 if last else p)
                if own != key and key:
                    yield made(*key, x)
                if own != key:
                    key, x = own, np.zeros(PART if kind else 2 * PIECE, np.float64 if kind else np.uint64)
                if kind:
                    one = np.frombuffer(blob, np.float64)
                    x[: len(one)] += one
                else:
                    at, n = dense(blob)
                    x[at] += n
        if key:
            yield made(*key, x)

    return add


class Mixer(NamedTuple):
    shape: Shape
    code: Code
    bits: int
    tables: list[np.ndarray]  #: packed counts for each slot
    weights: np.ndarray  #: for each input, and then for the bias, a weight for each gate
    refined: np.ndarray  #: for each place and bin of the mixed log odds, the log odds seen


class Model(NamedTuple):
    vocabulary: Vocabulary
    frequent: int
    words: Mixer
    letters: Mixer


def plan(v: Vocabulary) -> tuple:
    """What learning needs to know: coded words, both codes, the log2 of their tables, how many words count as frequent."""
    codes = [prefix_code(np.append(v.n, max(v.total - int(v.n.sum()), 0))), prefix_code(v.letters)]
    wide = int(min(max(9 + math.log2(max(v.total, 1)) / 2, LEAST_BITS), MOST_BITS))
    return v.h, codes, [wide, max(wide - 1, LEAST_BITS)], max(COMMON, len(v.h) // 16)


def assembled(v: Vocabulary, ready: tuple, rows: pa.Table) -> Model:
    """The model from the last round of sums."""
    _, codes, bits, frequent = ready
    at = _slots(codes, bits)
    tables = np.zeros(int(at[-1][-1]), np.uint32)
    sums = [np.zeros(sum(map(math.prod, sum_shapes(shape)))) for shape in SHAPES]
    for kind, part, blob in zip(*(rows[c].to_pylist() for c in ("kind", "part", "data")), strict=True):
        to, step, x = (sums[kind - 1], PART, np.frombuffer(blob, np.float64)) if kind else (tables, PIECE, np.frombuffer(blob, np.uint32))
        to[step * part : step * (part + 1)] = x[: len(to) - step * part]
    prior = 1 / (1 + np.exp(-np.tile(np.linspace(-REACH, REACH, BINS), PLACES)))
    mixers = []
    for k, (shape, code) in enumerate(zip(SHAPES, codes, strict=True)):
        shapes = sum_shapes(shape)
        bend, pull, seen = (x.reshape(y) for x, y in zip(np.split(sums[k], np.cumsum([math.prod(y) for y in shapes])[:-1]), shapes, strict=True))
        none = Learner(shape, code, 0)
        weights = np.linalg.solve(none.sure + bend, (PRIOR * none.first + pull)[:, :, None])[:, :, 0]
        zeros, ones = seen.reshape(2, -1)
        refined = np.log((ones + 8 * prior) / (zeros + 8 * (1 - prior))).astype(np.float32)
        mixers.append(Mixer(shape, code, bits[k], [tables[a : a + n] for a, n in zip(at[k].tolist(), shape.sizes(code, bits[k]), strict=False)], np.ascontiguousarray(weights.T.astype(np.float32)), refined))
    return Model(v, frequent, *mixers)


def train(dealt: DataFrame, counts: DataFrame, groups: int) -> Model:
    """A model of dealt (p, doc_id, text, r: a hash of the row), whose exact word counts are given; p is the group, below `groups`."""
    spark = dealt.sparkSession
    v = vocabulary(counts)
    ready = plan(v)
    model = spark.sparkContext.broadcast(ready)
    pieces = -(-int(_slots(*ready[1:3])[-1][-1]) // PIECE)
    letters = counts.select("shard", "words", "spelled").repartition(shuffle_width(spark), "shard").mapInArrow(_learn_letters(model), LEARNT)
    learnt = dealt.groupBy("p").applyInArrow(_learn_words(model), LEARNT).unionByName(letters).withColumn("p", F.pmod("p", F.lit(math.isqrt(groups) + 1)))
    # two rounds, so that no task adds up more rows than the square root of the groups
    for last, width, key in ((False, shuffle_width(spark), ["kind", "part", "p"]), (True, min(shuffle_width(spark), pieces), ["kind", "part"])):
        learnt = learnt.repartition(width, *key).sortWithinPartitions(*key).mapInArrow(_add_up(last), LEARNT)
    rows = learnt.toArrow()  # four bytes a slot: bounded by MOST_BITS and MOST_TOP
    model.destroy()
    return assembled(v, ready, rows)


# ---- scoring

HOLD, FINE_HOLD, COARSE = 400.0, 100.0, 9  #: how much the trained weights, and the trained refinement, weigh against a text's own; bins of the latter
STEPS = 64 << np.arange(7)  #: a text's own weights follow it after so many symbols, then after every 4096


def _step(place: np.ndarray) -> np.ndarray:
    return np.where(place < STEPS[-1], np.searchsorted(STEPS, place, "right"), len(STEPS) - 1 + place // int(STEPS[-1]))


def coded(m: Mixer, symbol: np.ndarray, contexts: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
    """Bits of each symbol; those of text i are bounds[i]:bounds[i + 1]. Each text starts from the trained mixer and
    has weights and a refinement of its own from then on, changed after each of its steps. Texts take steps together."""
    texts, n, out = len(bounds) - 1, m.shape.inputs, np.zeros(len(symbol))
    text = np.repeat(np.arange(texts), np.diff(bounds))
    step = _step(np.arange(len(symbol)) - bounds[text])
    order = np.argsort(step, kind="stable")
    cuts = np.flatnonzero(np.diff(step[order], prepend=-1, append=np.iinfo(np.int64).max))
    nodes = shares(*unpacked(m.tables[0]))
    own, sure = np.zeros((n + 1, texts), np.float32), np.full((n + 1, texts), float(HOLD))
    fine, firm = np.zeros(texts * COARSE, np.float32), np.full(texts * COARSE, float(FINE_HOLD))
    for a, b in zip(cuts, cuts[1:], strict=False):
        pull, push = np.zeros((n + 1, texts)), np.zeros(texts * COARSE)
        for s in range(a, b, SLICE):
            some = order[s : min(s + SLICE, b)]
            e = events(m.code, symbol[some], [c[some] for c in contexts], m.bits)
            first = np.flatnonzero(np.diff(text[some], prepend=-1))
            who, at = text[some][first], e.starts[first]
            size = np.diff(at, append=len(e.bits))
            x, levels = predictions(nodes, e.slots[0], [unpacked(pair.take(slot)) for pair, slot in zip(m.tables[1:], e.slots[1:], strict=True)], m.shape.confident)
            gate = (e.place.astype(np.int16) * np.int16(LEVELS**m.shape.confident) + levels.astype(np.int16)).astype(np.intp)
            y = m.weights[n].take(gate) + np.repeat(own[n, who], size)
            for k, one in enumerate(x):
                y += (m.weights[k].take(gate) + np.repeat(own[k, who], size)) * one
            low, part = bins(y)
            base = (e.place.astype(np.int32) * np.int32(BINS) + low).astype(np.intp)
            bin_ = np.repeat(who * COARSE, size) + (low >> 2)
            y = np.float32(0.5) * (y + m.refined.take(base) * (1 - part) + m.refined.take(base + 1) * part) + fine.take(bin_)
            # log odds against the bit that came; exp of what is never positive can't overflow
            sign = e.bits.astype(np.float32) * np.float32(2) - np.float32(1)
            against = -sign * y
            t = np.exp(-np.abs(against))
            whole = 1 + t
            out[some] = np.add.reduceat(np.log(whole) + np.maximum(against, 0), e.starts) * np.float32(1 / math.log(2))
            off, curve = sign * np.where(against > 0, np.float32(1), t) / whole, t / (whole * whole)
            for k in range(n + 1):
                pull[k, who] += np.add.reduceat(off * x[k] if k < n else off, at)
                sure[k, who] += np.add.reduceat(curve * x[k] * x[k] if k < n else curve, at)
            push += np.bincount(bin_, off, texts * COARSE)
            firm += np.bincount(bin_, curve, texts * COARSE)
        own += np.clip(pull / sure, -STEP, STEP).astype(np.float32)
        fine += np.clip(push / firm, -STEP, STEP).astype(np.float32)
    return out


def rare_bits(text: np.ndarray, h: np.ndarray, bits: np.ndarray, new: np.ndarray, share: float) -> np.ndarray:
    """Bits of rare words, in order of text: `bits` are those of a word among the known or among the new ones, share is
    that of new ones in training. Shares of new words and of words that the text has had before follow its own counts."""
    if not len(h):
        return bits
    first = np.flatnonzero(np.diff(text, prepend=-1))
    begin = np.repeat(first, np.diff(first, append=len(h)))
    k = np.arange(len(h)) - begin

    def before_(mark):  # how many marks in the text before each word
        sums = np.cumsum(mark) - mark
        return sums - sums[begin]

    back = np.unique(h ^ mix(text.astype(np.uint64) + np.uint64(1)), return_inverse=True)[1]
    order = np.argsort(back, kind="stable")
    runs_ = np.flatnonzero(np.diff(back[order], prepend=-1))
    had = np.empty(len(h), np.int64)
    had[order] = np.arange(len(h)) - np.repeat(runs_, np.diff(runs_, append=len(h)))
    again = (before_((had > 0).astype(np.int64)) + 0.2) / (k + 20)
    fresh = (before_(new.astype(np.int64)) + 16 * share) / (k + 16)
    plain = bits - np.log2(np.where(new, fresh, 1 - fresh)) - np.log2(1 - again)
    copied = -np.log2(again * np.maximum(had, 1) / np.maximum(k, 1))
    return np.where(had > 0, -np.logaddexp2(-plain, -copied), plain)


def spell(m: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Bits that it takes to spell these words, in order of text."""
    if not len(starts):
        return np.zeros(0)
    byte, first, own = spelled(data, starts, ends)
    bounds = np.append(first, len(byte))[np.searchsorted(text, np.arange(texts + 1))]
    return np.add.reduceat(coded(m.letters, byte, own, bounds), first)


ASKED = "shard int, p int, words binary"
_asked = pa.schema([("shard", pa.int32()), ("p", pa.int32()), ("words", pa.binary())])
ANSWER = "p int, shard int, counts binary"
_answers = pa.schema([("p", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary())])


def _rare(chunks_: Iterable[Tokens], vocabulary: np.ndarray) -> np.ndarray:
    """Distinct words without a code, sorted."""
    found = Index(vocabulary)
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(t.words.h[found.find(t.words.h) == len(vocabulary)] for t in chunks_)]))


def _ask(frequent, shards: int):
    def ask(texts: pa.Table) -> pa.Table:
        h, p = _rare(tokens(texts["text"]), frequent.value), texts["p"][0].as_py()
        return table([(s, p, planes(h[i])) for s, i in by_shard(h, shards)], _asked)

    return ask


def _answer(asked: pa.Table, counts: pa.Table) -> pa.Table:
    """For each group that asks, the counts of its words in their order; 0 for new ones."""
    h, n = np.zeros(1, np.uint64), np.zeros(1, np.int64)
    if counts.num_rows:
        h, n = numbers(counts["words"][0].as_py(), np.uint64), numbers(counts["counts"][0].as_py(), np.int64)
    rows = []
    for shard, p, blob in zip(*(asked[c].to_pylist() for c in ("shard", "p", "words")), strict=True):
        mine = numbers(blob, np.uint64)
        i = np.minimum(np.searchsorted(h, mine), len(h) - 1)
        rows.append((p, shard, planes(np.where(h[i] == mine, n[i], 0))))
    return table(rows, _answers)


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
_scores = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def text_bits(m: Model, t: Tokens, symbol: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bits of each token of a chunk's texts, given their places in the vocabulary and exact counts in training."""
    k = kept(t, symbol, len(m.vocabulary.h))
    return kept_bits(m, k, count[k.place])


def kept_bits(m: Model, k: Kept, count: np.ndarray) -> np.ndarray:
    """The same, given the counts of the words without a code."""
    v, texts = m.vocabulary, len(k.bounds) - 1
    symbol = k.symbol.astype(np.int64)
    cost = coded(m.words, symbol, word_contexts(*before(k, m.words.code.rank[symbol], m.frequent)), k.bounds)
    text = np.searchsorted(k.bounds, k.place, "right") - 1
    new = count == 0
    total = max(v.total - int(v.n.sum()), 0)
    own = -np.log2(np.maximum(count, 1) / max(total, 1))
    starts = np.append(0, k.ends)[:-1]
    own[new] = spell(m, k.data, starts[new], k.ends[new], text[new], texts)
    cost[k.place] += rare_bits(text, k.h, own, new, min(max(v.once / max(total, 1), 0.005), 0.95))
    return cost


def _score(broadcast):
    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return table([], _scores)
        m: Model = broadcast.value
        v = m.vocabulary
        # texts are parted and their tokens looked up once; what is kept takes some five bytes a token
        found = Index(v.h)
        held = [kept(t, found.find(t.h), len(v.h)) for t in tokens(texts["text"])]
        # the words that the group asked for, in the order in which it did
        rare = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k.h for k in held)]))
        number = np.concatenate([np.zeros(0, np.int64), *(numbers(x, np.int64) for x in answers.sort_by("shard")["counts"].to_pylist())])
        among = Index(rare)
        n_tokens, n_known, base, bits = [], [], [], []
        for k in held:
            c, count = np.append(v.n, 0)[k.symbol], number[among.find(k.h)]
            c[k.place] = count
            starts = k.bounds[:-1]
            n_tokens.append(np.diff(k.bounds))
            n_known.append(np.add.reduceat((c > 0).astype(np.int64), starts))
            base.append(np.add.reduceat(np.log10((c + 1) / (v.total + v.distinct + 1)), starts))
            bits.append(np.add.reduceat(kept_bits(m, k, count), starts))
        size = np.diff(text_buffers(texts["text"])[0])
        bits = np.concatenate(bits)
        per_byte = pa.array(np.divide(bits, size, out=np.zeros(len(bits)), where=size > 0), pa.float64(), mask=size == 0)
        return pa.table([texts["doc_id"], *(pa.array(np.concatenate(y), k) for y, k in ((n_tokens, pa.int64()), (n_known, pa.int64()), (base, pa.float64()))), pa.array(-bits * math.log10(2)), per_byte], schema=_scores)

    return score


def held_out(doc_id, folds: int = 7, fold: int = 2):
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def scores(docs: DataFrame, learn_from=None) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Wants doc_id (long) and text; other columns are ignored. Learns from rows where learn_from(doc_id) holds, by
    default those that are not held out; a null doc_id is not. A null text is empty: its one token is the end.
    bits_per_byte is null for an empty text. Repeated rows are texts of their own. No rows give no rows. A score
    depends on the rows alone, not on how they are partitioned or ordered.
    """
    learn_from = learn_from or (lambda c: ~held_out(c))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    groups = groups_for(rows.agg(F.sum(F.octet_length("text"))).first()[0], GROUP_CHARS, LEAST_GROUPS)
    shards = max(LEAST_SHARDS, groups // GROUPS_A_SHARD)
    # by id and text, so that rows without an id are dealt out too
    by_row = F.xxhash64("doc_id", "text")
    dealt = rows.select(F.pmod(by_row, F.lit(groups)).cast("int").alias("p"), "doc_id", "text", by_row.alias("r"))
    each = lambda df, n, c: df.repartitionById(n, F.col(c))  # noqa: E731  # one group or shard a task
    learn = learn_from(F.col("doc_id"))
    counts = word_counts(rows.filter(learn), shards)
    model = train(each(dealt.filter(learn), groups, "p"), counts, groups)
    shared, frequent = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(model.vocabulary.h)
    dealt = each(dealt.drop("r"), groups, "p")
    asked = each(dealt.groupBy("p").applyInArrow(_ask(frequent, shards), ASKED), shards, "shard")
    answers = each(asked.groupBy("shard").cogroup(each(counts.select("shard", "words", "counts"), shards, "shard").groupBy("shard")).applyInArrow(_answer, ANSWER), groups, "p")
    found = dealt.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(_score(shared), SCORES)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
