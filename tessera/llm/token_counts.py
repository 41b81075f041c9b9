"""Token counts that follow edits: a segment tree of pre-tokens for each document.

The leaves are the pre-tokens of a byte-level BPE (a piece that the pattern cuts out and the merges never
cross), gathered in blocks; inner nodes hold the sums of characters and tokens. An edit finds its place by the
character sums, cuts pre-tokens anew from two characters before it until a new boundary meets an old one, counts
the tokens of these only and updates the sums above the blocks that it touched.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pre-token's match reads no further than so many characters beyond its end.
AHEAD = 1
BLOCK = 64
MOST_CACHED = 1 << 20


class Counter:
    """Tokens of pre-tokens, remembered for a bounded number of distinct ones."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> np.ndarray:
        new = list(set(pieces).difference(self.known))
        if new:
            if len(self.known) + len(new) > MOST_CACHED:
                self.known = {}
                new = list(set(pieces))
            self.known.update(zip(new, map(len, map(self.bpe.encode_ordinary, new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces))


_counters: dict[str, Counter] = {}


def counter(vocabulary: str) -> Counter:
    if vocabulary not in _counters:
        _counters[vocabulary] = Counter(vocabulary)
    return _counters[vocabulary]


def shipped(spark, vocabulary: str):
    """A function that gives a task its counter; the vocabulary's file goes to the executors with the job."""
    spark.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    return lambda: counter(SparkFiles.get(name))


class Tree:
    """Blocks of pre-tokens (text, lengths, token counts) under a binary tree of (characters, tokens)."""

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray):
        cuts = np.arange(0, max(1, len(lengths)), BLOCK)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        edges = [*ends[cuts].tolist(), len(text)]
        self.blocks = [(text[a:b], lengths[i : i + BLOCK], counts[i : i + BLOCK]) for i, a, b in zip(cuts.tolist(), edges, edges[1:], strict=False)]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        if len(lengths):
            self.sums[self.width : self.width + len(cuts)] = np.stack([np.add.reduceat(lengths, cuts), np.add.reduceat(counts, cuts)], 1)
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaves(self) -> tuple[str, np.ndarray, np.ndarray]:
        text, lengths, counts = zip(*self.blocks, strict=True)
        return "".join(text), np.concatenate(lengths), np.concatenate(counts)

    def _block_at(self, at: int) -> tuple[int, int]:
        """The block that holds character `at`, and where it starts; the last one that holds any at the end."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.width, start

    def _set(self, i: int, block) -> None:
        self.blocks[i] = block
        node = i + self.width
        self.sums[node] = len(block[0]), block[2].sum()
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, at: int, cut: int, put: str, count: Counter) -> int:
        """Put `put` in the place of `cut` characters from `at`; returns how many pre-tokens were counted anew."""
        total = self.chars
        at = min(max(at, 0), total)
        end = min(at + max(cut, 0), total)
        first, base = self._block_at(max(at - AHEAD - 1, 0))
        text, lengths, _ = self.blocks[first]
        starts = base + np.concatenate(([0], np.cumsum(lengths)))[:-1]
        leaf = max(int(np.searchsorted(starts, max(at - AHEAD - 1, 0), "right")) - 1, 0)
        start = int(starts[leaf]) if len(starts) else base
        # old text from the leaf on, as many blocks of it as needed
        last, old, bounds = first, text[start - base :], [starts[leaf:]]
        upto, step = base + len(text), 1
        while True:
            while last + 1 < len(self.blocks) and (upto < end or step):
                last += 1
                more, sizes, _ = self.blocks[last]
                bounds.append(upto + np.concatenate(([0], np.cumsum(sizes)))[:-1])
                old += more
                upto += len(more)
                step -= step > 0
            whole = last + 1 == len(self.blocks)
            window = old[: at - start] + put + old[end - start :]
            pieces = count.cut(window)
            made = np.cumsum([len(p) for p in pieces], dtype=np.int64)
            shift = len(put) - (end - at)
            ends = np.concatenate([*bounds, [upto]]) if whole else np.concatenate(bounds)
            safe = (made >= at - start + len(put)) & (np.isin(made + start - shift, ends)) & (whole | (made + AHEAD < len(window)))
            met = np.flatnonzero(safe)
            if len(met) or whole:
                break
            step = last - first + 1
        n = int(met[0]) + 1 if len(met) else len(pieces)
        stop = int(made[n - 1]) + start - shift if n else upto
        pieces = pieces[:n]
        # leaves from `stop` on stay as they are, in the block where `stop` lies
        keep, at_block = first, base
        while keep < last and at_block + len(self.blocks[keep][0]) <= stop:
            at_block += len(self.blocks[keep][0])
            keep += 1
        tail_text, tail_lengths, tail_counts = self.blocks[keep]
        skip = int(np.searchsorted(np.cumsum(tail_lengths), stop - at_block, "right"))
        tail = (tail_text[stop - at_block :], tail_lengths[skip:], tail_counts[skip:])
        head_text, head_lengths, head_counts = self.blocks[first]
        new = (head_text[: start - base] + "".join(pieces), np.concatenate([head_lengths[:leaf], np.array([len(p) for p in pieces], np.int32)]).astype(np.int32), np.concatenate([head_counts[:leaf], count.counts(pieces)]).astype(np.int32))
        if keep == first:
            new = (new[0] + tail[0], np.concatenate([new[1], tail[1]]), np.concatenate([new[2], tail[2]]))
        else:
            for i in range(first + 1, keep):
                self._set(i, ("", tail_lengths[:0], tail_counts[:0]))
            self._set(keep, tail)
        self._set(first, new)
        if len(new[1]) > 8 * BLOCK:  # a long insertion: blocks of even size again
            self.__init__(*self.leaves())
        return len(pieces)


def tree(text: str | None, count: Counter) -> Tree:
    pieces = count.cut(text or "")
    return Tree(text or "", np.fromiter(map(len, pieces), np.int32, len(pieces)), count.counts(pieces))


EDITS = "array<struct<at:int,cut:int,put:string>>"
COUNTS = "doc_id long, n_chars long, n_tokens long, n_pretokens long, n_edits int, edited_chars long, edited_tokens long, n_recounted long"
TREES = "doc_id long, text string, lengths array<int>, counts array<int>"


def _edited(found: Tree, edits, count: Counter) -> tuple[int, int]:
    edits = [e for e in edits or () if e is not None]
    return len(edits), sum(found.edit(e["at"] or 0, e["cut"] or 0, e["put"] or "", count) for e in edits)


def edited_counts(docs: DataFrame, edits, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each row of docs: its token count before and after `edits`, a column of EDITS in their order.

    Wants doc_id (long) and text; other columns are only read by `edits`. Positions are characters of the text as
    the edits before left it; they are cut to it, and nulls in an edit count as 0 or empty. A null text is empty,
    null edits are none, null edits in the list are passed over. Repeated rows give repeated rows.
    """

    count_of = shipped(docs.sparkSession, vocabulary)

    def run(batches):
        count = count_of()
        for batch in batches:
            rows = []
            for doc, text, changes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                t = tree(text.as_py(), count)
                before = t.chars, t.tokens, sum(len(b[1]) for b in t.blocks)
                n, again = _edited(t, changes.as_py(), count)
                rows.append((doc, *before, n, t.chars, t.tokens, again))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in COUNTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.cast(EDITS).alias("edits")).mapInArrow(run, COUNTS)


def trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The leaves of each document's tree (TREES), to be kept and given to `edit_trees` later.

    A row for each row of docs, repeated and null ids among them; a null text is empty and has no leaves.
    """

    count_of = shipped(docs.sparkSession, vocabulary)

    def run(batches):
        count = count_of()
        for batch in batches:
            found = [tree(text.as_py(), count).leaves() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), *(pa.array([x[k].tolist() for x in found], pa.list_(pa.int32())) for k in (1, 2))], names=["doc_id", "text", "lengths", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TREES)


def edit_trees(kept: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Kept trees (TREES) after edits (doc_id, seq, at, cut, put) in the order of seq; documents without edits stay.

    Only touched regions are encoded. Edits of a doc_id that no tree has, or of none, are left out; trees without a
    doc_id stay, and trees of one doc_id are all edited. Nulls in an edit count as 0 or empty.
    """
    by_doc = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "cut", "put"))).alias("edits"))

    count_of = shipped(kept.sparkSession, vocabulary)

    def run(batches):
        count = count_of()
        for batch in batches:
            doc, out = batch.column(0), []
            for text, lengths, counts, changes in zip(*(batch.column(i) for i in (1, 2, 3, 4)), strict=True):
                t = Tree(text.as_py() or "", np.array(lengths.as_py() or [], np.int32), np.array(counts.as_py() or [], np.int32))
                _edited(t, changes.as_py(), count)
                out.append(t.leaves())
            yield pa.RecordBatch.from_arrays([doc, pa.array([x[0] for x in out], pa.string()), *(pa.array([x[k].tolist() for x in out], pa.list_(pa.int32())) for k in (1, 2))], names=["doc_id", "text", "lengths", "counts"])

    return kept.join(by_doc.select("doc_id", F.transform("edits", lambda e: F.struct(e["at"].cast("int").alias("at"), e["cut"].cast("int").alias("cut"), e["put"].cast("string").alias("put"))).alias("edits")), "doc_id", "left").select("doc_id", "text", "lengths", "counts", "edits").mapInArrow(run, TREES)


def review_edits():
    """The edits that the registered query makes: a word put in the middle, a notice in front, a cut, and an end."""
    n = F.length(F.coalesce(F.col("text"), F.lit("")))

    def edit(at, cut, put):
        return F.struct(at.cast("int").alias("at"), F.lit(cut).alias("cut"), F.lit(put).alias("put"))

    return F.array(edit(n * F.lit(0.5), 7, " (revised)"), edit(F.lit(0), 0, "Note: "), edit(n * F.lit(0.8), 40, ""), edit(n + F.lit(1 << 20), 0, "\n\nEnd of text."))
