"""Removal of repeated word windows: a count-min prefilter, then exact grouping of what it lets through.

Texts are dealt once into groups of about `GROUP_CHARS` characters; Spark reuses that exchange for all
three passes over them.

1. Each group sketches its windows: a count-min sketch of one row of 2 ** `CELL_BITS` counters a shard, sent as
   the list of its counters that aren't 0 and whether they are 1 or more. So it is no smaller than its windows, but
   it is exact where they are few, and shards grow with the input. Shards of all groups are summed, and each group
   learns which of its own cells hold two windows or more. A sum may overestimate, never underestimate, so no
   repeated window is lost; nothing of the sketch is broadcast.
2. Each group sends only windows in such cells, by two independent 64-bit fingerprints, as one row of
   arrays a shard with the earliest start and the count; a shard finds the earliest start of all groups.
3. Each group removes the words that windows with an earlier start elsewhere cover.

A passage that all texts share costs each shard one entry a group, whatever the number of texts.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import groups_for
from tessera.llm.words import WORD_BASE_2, chunks, text_buffers

WINDOW = 20
GROUP_CHARS = 8 << 20
CELL_BITS = 26
LEAST_GROUPS = 128
NO_ID = np.iinfo(np.int64).max


def _windows(table: pa.Table, exact: bool):
    """(first text, bounds, start word, h1, h2) of the windows of each chunk of a group's texts."""
    for w in chunks(table["text"]):
        at, h1 = w.windows(WINDOW)
        yield w, at, h1, w.windows(WINDOW, WORD_BASE_2, w.second())[1] if exact and len(at) else h1


def _cell(h: np.ndarray, shards: int) -> np.ndarray:
    shard = ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return shard << np.uint64(CELL_BITS) | (h & np.uint64((1 << CELL_BITS) - 1))


def _pack(cells: np.ndarray) -> bytes:
    """Sorted cells as the bytes of their steps, high bytes together: the block codec takes out the zeros."""
    return np.diff(cells.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint64)


def _planes(x: np.ndarray) -> bytes:
    """Equal places of all numbers together, so that the block codec takes out the bytes that are always zero."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def _numbers(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _by_shard(keys: np.ndarray, bits: int):
    """(shard, slice) over keys sorted by shard, their high bits."""
    shard = (keys >> np.uint64(bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=np.iinfo(np.int64).max))
    return [(int(shard[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


SKETCH = "shard int, p int, once binary, more binary"


def _sketch(shards: int):
    low = np.uint64((1 << CELL_BITS) - 1)

    def sketch(table: pa.Table) -> pa.Table:
        found = [_cell(h, shards) for _, _, h, _ in _windows(table, False)]
        cells, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
        p, rows = table["p"][0].as_py(), []
        for shard, s in _by_shard(cells, CELL_BITS):
            part, more = cells[s] & low, n[s] > 1
            rows.append((shard, p, _pack(part[~more]), _pack(part[more])))
        return _rows(rows, pa.schema([("shard", pa.int32()), ("p", pa.int32()), ("once", pa.binary()), ("more", pa.binary())]))

    return sketch


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


HITS = "p int, shard int, cells binary"


def _merge(table: pa.Table) -> pa.Table:
    """Sum the sketches of one shard; tell each group its cells that hold two windows or more."""
    once, more = ([_unpack(x) for x in table[c].to_pylist()] for c in ("once", "more"))
    cells, back = np.unique(np.concatenate(once + more), return_inverse=True)
    split = sum(map(len, once))
    n = np.bincount(back[:split], minlength=len(cells)) + 2 * np.bincount(back[split:], minlength=len(cells))
    shard, rows = table["shard"][0].as_py(), []
    often = cells[n > 1]
    for p, a, b in zip(table["p"].to_pylist(), once, more, strict=True):
        mine = np.union1d(a[np.isin(a, often, assume_unique=True)], b)
        if len(mine):
            rows.append((p, shard, _pack(mine)))
    return _rows(rows, pa.schema([("p", pa.int32()), ("shard", pa.int32()), ("cells", pa.binary())]))


EXACT = "shard int, p int, h1 binary, h2 binary, doc binary, at binary, n binary"
_exact_schema = pa.schema([("shard", pa.int32()), ("p", pa.int32()), *((c, pa.binary()) for c in ("h1", "h2", "doc", "at", "n"))])


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _firsts(h1, h2, doc, at, n):
    """For each (h1, h2): the earliest start and the number of windows; sorted by (h1, h2)."""
    order = np.lexsort((at, doc, h2, h1))
    h1, h2, doc, at, n = (x[order] for x in (h1, h2, doc, at, n))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    start = np.flatnonzero(new)
    total = np.add.reduceat(n, start) if len(start) else n
    return h1[start], h2[start], doc[start], at[start], total


def _likely(shards: int):
    def likely(texts: pa.Table, hits: pa.Table) -> pa.Table:
        """Of a group's windows those in cells with two or more: earliest start and count, by shard."""
        if not texts.num_rows or not hits.num_rows:
            return _rows([], _exact_schema)
        often = np.sort(np.concatenate([_unpack(c) | np.uint64(s) << np.uint64(CELL_BITS) for s, c in zip(hits["shard"].to_pylist(), hits["cells"].to_pylist(), strict=True)]))
        ids, found = _ids(texts), []
        for w, at, h1, h2 in _windows(texts, True):
            cell = _cell(h1, shards)
            keep = often[np.minimum(np.searchsorted(often, cell), len(often) - 1)] == cell
            at, text = at[keep], np.searchsorted(w.bounds, at[keep], "right") - 1
            found.append((h1[keep], h2[keep], ids[w.first + text], at - w.bounds[text]))
        h1, h2, doc, at = (np.concatenate(x) for x in zip(*found, strict=True))
        cols = _firsts(h1, h2, doc, at.astype(np.int64), np.ones(len(h1), np.int64))
        shard = _cell(cols[0], shards) >> np.uint64(CELL_BITS)
        p = texts["p"][0].as_py()
        rows = []
        for s, part in _by_shard(shard, 0):
            a, b, d, i, n = (c[part] for c in cols)
            rows.append((s, p, *map(_planes, (a, b, d, i.astype(np.uint32), np.minimum(n, 255).astype(np.uint8)))))
        return _rows(rows, _exact_schema)

    return likely


FOUND = "p int, h1 binary, tag binary, doc binary, at binary"
_found_schema = pa.schema([("p", pa.int32()), *((c, pa.binary()) for c in ("h1", "tag", "doc", "at"))])
_kinds = {"h1": np.uint64, "h2": np.uint64, "tag": np.uint32, "doc": np.int64, "at": np.uint32, "n": np.uint8}


def _columns(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [np.concatenate([_numbers(x, _kinds[c]) for x in table[c].to_pylist()] or [np.zeros(0, _kinds[c])]) for c in names]


def _tag(h2: np.ndarray) -> np.ndarray:
    """What a group is told of the second fingerprint: with the first, 96 bits tell its windows apart."""
    return (h2 >> np.uint64(32)).astype(np.uint32)


def _exact(table: pa.Table) -> pa.Table:
    """Group the likely windows of one shard; tell each group the earliest start of those that repeat."""
    h1, h2, doc, at, n = _columns(table, ["h1", "h2", "doc", "at", "n"])
    sizes = [len(x) // 8 for x in table["h1"].to_pylist()]
    k1, k2, first, start, total = _firsts(h1, h2, doc, at.astype(np.int64), n.astype(np.int64))
    rep = total > 1
    k1, k2, first, start = k1[rep], k2[rep], first[rep], start[rep].astype(np.uint32)
    rows, a = [], 0
    for p, size in zip(table["p"].to_pylist(), sizes, strict=True):
        i, hit = _look(k1, k2, h1[a : a + size], h2[a : a + size])
        if hit.any():
            i = i[hit]
            rows.append((p, *map(_planes, (k1[i], _tag(k2[i]), first[i], start[i]))))
        a += size
    return _rows(rows, _found_schema)


def _look(k1, k2, h1, h2):
    """Places in the keys (sorted by k1, k2) of (h1, h2), and whether they are there."""
    i = np.searchsorted(k1, h1)
    hit = np.zeros(len(h1), bool)
    place = np.zeros(len(h1), np.int64)
    for _ in range(4):  # h1 alone tells nearly all apart
        ok = i < len(k1)
        j = np.minimum(i, max(len(k1) - 1, 0))
        ok &= ~hit & (k1[j] == h1) if len(k1) else False
        if not np.any(ok):
            break
        same = ok & (k2[j] == h2)
        place[same], hit[same] = j[same], True
        i = i + 1
    return place, hit


def _removed(texts: pa.Table, found: pa.Table):
    """(index, mask of removed words) for each text of a group."""
    k1, k2, first, start = _columns(found, ["h1", "tag", "doc", "at"])
    order = np.lexsort((k2, k1))
    k1, k2, first, start = k1[order], k2[order], first[order], start[order].astype(np.int64)
    ids = _ids(texts)
    for w, at, h1, h2 in _windows(texts, len(k1) > 0):
        gone = np.zeros(len(w.h) + 1, np.int32)
        if len(k1) and len(at):
            i, hit = _look(k1, k2, h1, _tag(h2))
            text = np.searchsorted(w.bounds, at, "right") - 1
            later = hit & ((first[i] != ids[w.first + text]) | (start[i] != at - w.bounds[text]))
            np.add.at(gone, at[later], 1)
            np.subtract.at(gone, at[later] + WINDOW, 1)
        gone = np.cumsum(gone[:-1]) > 0
        for i in range(len(w.bounds) - 1):
            yield w.first + i, gone[w.bounds[i] : w.bounds[i + 1]]


def _strip(out: pa.Schema):
    def strip(texts: pa.Table, found: pa.Table) -> pa.Table:
        offsets, data = text_buffers(texts["text"])
        n_words, n_removed, kept = [], [], []
        for i, gone in _removed(texts, found):
            words = data[offsets[i] : offsets[i + 1]].tobytes().split()
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join(compress(words, ~gone) if n_removed[-1] else words))
        made = {
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        if "kept_text" in out.names:
            made["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table([made[f.name] if f.name in made else texts[f.name] for f in out], schema=out)

    return strip


def strip_repeats(docs: DataFrame, carry: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_removed, kept_sha256, columns of `carry`, kept_text if asked for.

    Wants doc_id (long) and text. A word goes if a window of 20 words that covers it starts earlier too
    (smaller doc_id, or same doc_id and earlier start). A null or empty text has no words. A null doc_id
    counts as the largest; rows with one doc_id are one document, so equal starts in them tie and both
    stay. No rows give no rows. Columns that are not named in carry are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    carry = carry or []
    total = docs.agg(F.sum(F.length("text"))).first()[0]
    groups = groups_for(total, GROUP_CHARS, LEAST_GROUPS)
    shards = max(64, groups // 2)
    doc = F.col("doc_id").cast("long")
    # by id and text, so that rows without an id are dealt out too; one group or shard a task
    by_id = lambda df, n, c: df.repartitionById(n, F.col(c))
    dealt = docs.select(F.pmod(F.xxhash64(doc, F.col("text").cast("string")), F.lit(groups)).cast("int").alias("p"), doc.alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    dealt = by_id(dealt, groups, "p")
    hits = by_id(by_id(dealt.groupBy("p").applyInArrow(_sketch(shards), SKETCH), shards, "shard").groupBy("shard").applyInArrow(_merge, HITS), groups, "p")
    likely = dealt.groupBy("p").cogroup(hits.groupBy("p")).applyInArrow(_likely(shards), EXACT)
    found = by_id(by_id(likely, shards, "shard").groupBy("shard").applyInArrow(_exact, FOUND), groups, "p")
    shape = dealt.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_sha256"), *(["carried"] if carry else []), *([F.lit("").alias("kept_text")] if with_text else [])).schema
    for f in shape:
        f.nullable = True
    out = dealt.groupBy("p").cogroup(found.groupBy("p")).applyInArrow(_strip(to_arrow_schema(shape)), shape)
    return out.select(*(c for c in out.columns if c != "carried"), *(["carried.*"] if carry else []))
