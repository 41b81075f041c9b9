"""Near-duplicate texts by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Each text gives its set of 5-word shingles (64-bit fingerprints) and, for every tree, a short path
   of MinHash values. Texts with equal sets form one class; its least doc_id stands for it.
2. Every tree sorts the classes by path. Neighbours whose common prefix is long enough are candidates;
   the depth asked for grows with the number of classes that share the shorter prefix (`DEPTHS`).
3. Candidates chain to clusters of at most what the forest says is near. The full sets of a cluster of up to `BLOCK`
   texts meet at once. Of a larger one all are compared with its representative first, in blocks that each have a copy
   of it. Of what isn't linked with it, up to `BLOCK` texts meet the whole cluster, block by block: each member is
   sent once or twice. Where more is left, as where unlike texts chain by a passage that all of them hold, the cluster
   is parted by rare shingles (`rare_edges`, which loses no link), and its parts are settled in the same way, in
   pairs of blocks at last. A block returns no more links than it has texts.

A pair at similarity 0.75 misses all 40 trees at depth 4 with a chance of 3e-7, at depth 5 with 2e-5 and at depth 6
with 4e-4.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, runs, shuffle_width, small_side
from tessera.llm.graph import Forest, components
from tessera.llm.words import LOWER, chunks, mix, ranges, WORD_BASE

SHINGLE, PERCENT = 5, 75
TREES, LANES = 40, 6
#: (prefix length, most classes that may share it): a longer prefix is asked for where more share it.
DEPTHS = ((4, 2048), (5, 8192), (6, None))
BLOCK = 256

_seeds = mix(np.arange(1, 2 * TREES * LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MULT, PLUS = _seeds[0::2] | np.uint64(1), _seeds[1::2]


def shingle_sets(column: pa.Array):
    """(index, sorted distinct shingle fingerprints) for each text; fewer than five words make one shingle."""
    for w in chunks(column, LOWER):
        at, h = w.windows(SHINGLE)
        cuts = np.searchsorted(at, w.bounds)
        for i in range(len(w.bounds) - 1):
            a, b = w.bounds[i], w.bounds[i + 1]
            if b - a >= SHINGLE:
                yield w.first + i, np.unique(h[cuts[i] : cuts[i + 1]])
            elif b > a:
                yield w.first + i, ranges(w.h, np.array([a]), np.array([b]), WORD_BASE)
            else:
                yield w.first + i, h[:0]


def lowest(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (16 bits) of non-empty sets: one row for each set, one column for each function."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    flat = flat ^ (flat >> np.uint64(32))
    out = np.empty((len(sets), TREES * LANES), np.uint64)
    for f in range(TREES * LANES):
        out[:, f] = np.minimum.reduceat(flat * MULT[f] + PLUS[f], starts)
    return (mix(out) >> np.uint64(48)).astype(np.uint64)


SKETCH = "doc_id long, n_shingles long, fp binary, paths array<struct<head:long,tail:long>>"
_path = pa.struct([("head", pa.int64()), ("tail", pa.int64())])


def _sketch(batches):
    for batch in batches:
        ids, found = batch.column(0), [s for _, s in shingle_sets(batch.column(1))]
        for a in range(0, len(found), 256):
            part = found[a : a + 256]
            full = [s for s in part if len(s)]
            if full:
                low = lowest(full).reshape(len(full), TREES, LANES)
                head = low[:, :, 0] << np.uint64(48) | low[:, :, 1] << np.uint64(32) | low[:, :, 2] << np.uint64(16) | low[:, :, 3]
                tail = low[:, :, 4] << np.uint64(16) | low[:, :, 5]
                values = pa.StructArray.from_arrays([pa.array(x.ravel().view(np.int64)) for x in (head, tail)], fields=list(_path))
            else:
                values = pa.array([], _path)
            offsets = np.cumsum([0, *(TREES * bool(len(s)) for s in part)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, len(part)).cast(pa.int64()),
                    pa.array([len(s) for s in part], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in part], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                ],
                names=["doc_id", "n_shingles", "fp", "paths"],
            )


def _near(tree, head, tail, doc, depth) -> pa.RecordBatch:
    """Candidate links between rows that follow each other in the order of (tree, head, tail, doc)."""
    four = (tree[1:] == tree[:-1]) & (head[1:] == head[:-1])
    five = four & (tail[1:] >> 16 == tail[:-1] >> 16)
    keep = np.select([depth[1:] == 4, depth[1:] == 5], [four, five], four & (tail[1:] == tail[:-1]))
    a, b = doc[:-1][keep], doc[1:][keep]
    none = pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), none[0], none[1], none[1], none[0]], names=["a", "b", "tree", "head", "tail", "depth"])


NEAR = "a long, b long, tree int, head long, tail long, depth int"


def _neighbours(batches):
    """Links (a, b) of a task's stretch, then its first and last row (b null): stretches meet by these."""
    first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy() for i in range(5)]
        if last is not None:
            now = [np.concatenate((y, x)) for x, y in zip(now, last, strict=True)]
        first = first or [x[:1] for x in now]
        last = [x[-1:] for x in now]
        yield _near(*now)
    if first:
        tree, head, tail, doc, depth = (np.concatenate(x) for x in zip(first, last, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.nulls(2, pa.int64()), pa.array(tree, pa.int32()), pa.array(head), pa.array(tail), pa.array(depth, pa.int32())], names=["a", "b", "tree", "head", "tail", "depth"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; rare shingles are paired one by one, common ones multiplied in slices."""
    n = len(sets)
    doc, flat = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    doc, flat = doc[order], flat[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    label = np.cumsum(new) - 1
    df = np.bincount(label)[label]
    out = np.zeros(n * n)
    rare = (df > 1) & (df <= 12)
    d, k = doc[rare], label[rare]
    for s in range(1, 12):
        hit = k[s:] == k[:-s]
        if not hit.any():
            break
        out += np.bincount(d[:-s][hit] * n + d[s:][hit], minlength=n * n)
    out = out.reshape(n, n)
    out += out.T
    d, k = doc[df > 12], label[df > 12]
    if len(k):
        k = np.unique(k, return_inverse=True)[1]
        step = max(1, (1 << 23) // n)
        cuts = np.searchsorted(k, np.arange(0, k[-1] + 1 + step, step))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            m = np.zeros((n, int(min(step, k[-1] + 1 - i * step))), np.float32)
            m[d[a:b], k[a:b] - i * step] = 1
            out += m @ m.T
    return out


def _similar(both, size, other):
    return (100 * both >= PERCENT * (size + other - both)) & (size > 0) & (other > 0)


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _forest(ids, linked, rows) -> list[tuple]:
    forest, out = Forest(len(ids)), []
    for x in rows:
        for y in np.flatnonzero(linked[x]).tolist():
            if x != y and forest.join(x, y) and ids[x] != ids[y]:
                out.append((int(max(ids[x], ids[y])), int(min(ids[x], ids[y]))))
    return out


def _confirm(batches):
    """Links (a, b) of each block; of a cluster in several blocks those with its representative, and (a, null) for texts that have none."""
    for block in runs(batches, ["cluster", "i"]):
        ids, lead = block["doc_id"].to_numpy(), block["lead"].to_numpy(zero_copy_only=False)
        if len(ids) < 2:
            continue
        sets = [s for _, s in shingle_sets(block["text"])]
        size = np.array([len(s) for s in sets])
        if block["n"][0].as_py() == 1:
            both = overlaps(sets)
            out = _forest(ids, _similar(both, size[:, None], size[None, :]), range(len(ids)))
        else:
            linked = np.zeros(len(ids), bool)
            at = np.repeat(np.arange(len(ids)), size)
            flat = np.concatenate(sets)
            for k in np.flatnonzero(lead):
                linked |= _similar(np.bincount(at, np.isin(flat, sets[k], kind="sort"), len(ids)), size, size[k])
            cluster = block["cluster"][0].as_py()
            out = [(int(d), cluster if hit else None) for d, hit in zip(ids[~lead], linked[~lead], strict=True) if d != cluster]
        if out:
            yield _pairs(out)


def _meet(batches):
    """Links (a, b) between the left texts of each pair of blocks and all of them."""
    for block in runs(batches, ["cluster", "i", "j"]):
        ids, left = block["doc_id"].to_numpy(), np.flatnonzero(block["lead"].to_numpy(zero_copy_only=False))
        if not len(left) or len(ids) < 2:
            continue
        sets = [s for _, s in shingle_sets(block["text"])]
        size = np.array([len(s) for s in sets])
        out = _forest(ids, _similar(overlaps(sets), size[:, None], size[None, :]), left.tolist())
        if out:
            yield _pairs(out)


def block_pairs(node: str, size: str, block: int):
    """An array of (i, j): the pairs of blocks in which a member of a group of `size` has to meet others."""
    nb = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(node), nb).cast("int")
    return F.transform(F.sequence(F.lit(0), nb - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))


def _with_depth(rows: DataFrame) -> DataFrame:
    """rows with the depth that each one's region asks for, by how many classes share its shorter prefixes."""
    (_, most), (_, more), _ = DEPTHS
    count = lambda df, *key: df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    five = F.shiftright("tail", 16)
    large = small_side(count(rows, "tree", "head").filter(F.col("n") > most).select("tree", "head", F.lit(5).alias("d4")))
    larger = small_side(count(rows.join(large, ["tree", "head"]).withColumn("mid", five), "tree", "head", "mid").filter(F.col("n") > more).select("tree", "head", "mid", F.lit(6).alias("d5")))
    return rows.join(large, ["tree", "head"], "left").withColumn("mid", five).join(larger, ["tree", "head", "mid"], "left").select("tree", "head", "tail", "doc", F.coalesce("d5", "d4", F.lit(4)).alias("depth"))


def candidate_edges(sketch: DataFrame) -> DataFrame:
    """Links (a, b) between neighbours in the trees' orders. Wants doc_id and paths, a row a class."""
    order = ["tree", "head", "tail", "doc"]
    rows = _with_depth(sketch.select(F.posexplode("paths").alias("tree", "p"), F.col("doc_id").alias("doc")).select("tree", "p.head", "p.tail", "doc"))
    found = cut(rows.repartitionByRange(shuffle_width(sketch.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_neighbours, NEAR), "near")
    # two rows a task, whatever the input
    ends = found.filter("b is null").select("tree", "head", "tail", F.col("a").alias("doc"), "depth").coalesce(1).sortWithinPartitions(*order)
    across = ends.mapInArrow(lambda batches: (_near(*(x.to_numpy() for x in t.columns)) for t in _whole(batches)), NEAR)
    return found.filter("b is not null").unionByName(across).select("a", "b")


def _whole(batches):
    batches = list(batches)
    if batches:
        yield pa.Table.from_batches(batches).combine_chunks()


def _blocks(size: str):
    return F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")


def _own(node: str, blocks: str):
    return F.pmod(F.xxhash64(node), F.col(blocks)).cast("int")


def _texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of the nodes of rows; the same join at every size: broadcast rows would not stay small."""
    return docs.select("doc_id", "text").join(rows.hint("merge"), F.col("doc_id") == F.col("node"))


def _settle(docs: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, rest) of clusters (node, cluster): a cluster of one block is compared at once, a larger one with its
    representative. rest are the members of larger ones that aren't linked with it, and n is a member's number of blocks."""
    large = small_side(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK).select("cluster", _blocks("size").alias("n")))
    members = cut(clusters.join(large, "cluster", "left").withColumn("n", F.coalesce("n", F.lit(1))), "members")
    lead = (F.col("node") == F.col("cluster")) & (F.col("n") > 1)
    dealt = _texts(docs, members.withColumn("own", _own("node", "n"))).select("cluster", "n", lead.alias("lead"), F.explode(F.when(lead, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array("own"))).alias("i"), "doc_id", "text")
    first = cut(dealt.repartition(shuffle_width(docs.sparkSession), "cluster", "i").sortWithinPartitions("cluster", "i").mapInArrow(_confirm, "a long, b long"), "first")
    rest = first.filter("b is null").select(F.col("a").alias("node")).distinct().join(members.hint("merge"), "node")
    return members, first.filter("b is not null"), cut(rest.select("node", "cluster", "n"), "rest")


def _meeting(docs: DataFrame, members: DataFrame, rest: DataFrame) -> DataFrame:
    """The texts of every pair of blocks (i, j) of a cluster's rest (lead) and of its members."""
    few = small_side(rest.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).select("cluster", _blocks("size").alias("m")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.join(few, "cluster").select("cluster", F.lit(True).alias("lead"), _own("node", "m").alias("i"), spread("n").alias("j"), "node")
    right = members.join(few, "cluster").select("cluster", F.lit(False).alias("lead"), _own("node", "n").alias("j"), spread("m").alias("i"), "node")
    return _texts(docs, left.unionByName(right)).select("cluster", "i", "j", "lead", "doc_id", "text")


KEYS = "doc_id long, own long, size int, key long"


def _keys(batches):
    """A row for each shingle of each text: key tells shingles apart by cluster, own the texts of one doc_id."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            sets = [s for _, s in shingle_sets(part.column(2))]
            size = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            salt = mix(part.column(0).to_numpy().view(np.uint64) + np.uint64(1))
            own = np.array([np.bitwise_xor.reduce(mix(s)) for s in sets], np.uint64).view(np.int64)
            each = [part.column(1).to_numpy(), own, size.astype(np.int32)]
            key = mix(flat ^ np.repeat(salt, size)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(x, size)) for x in each), pa.array(key)], names=["doc_id", "own", "size", "key"])


def rare_edges(held: DataFrame) -> DataFrame:
    """Links (a, b) that connect all texts of a cluster which share one of their rarest shingles. Wants cluster, doc_id, text.

    With the shingles of a cluster in one order, two sets at the threshold hold at least PERCENT of either set in common, so
    their first common shingle has PERCENT of each set at or after it. Order by the number of texts that hold a
    shingle, the rarest first, leaves out what a whole cluster shares; shingles of one text come first and link nothing.
    """
    rows = cut(held.select("cluster", "doc_id", "text").mapInArrow(_keys, KEYS), "keys")
    # counts and least ids are written, so that the joins stand on two exchanges of their own and a common shingle can be split
    often = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "often")
    shared = rows.join(often.hint("merge"), "key")
    from_end = F.row_number().over(Window.partitionBy("doc_id", "own").orderBy(F.desc("n"), F.desc("key")))
    rare = cut(shared.withColumn("q", from_end).filter(100 * F.col("q") >= PERCENT * F.col("size")).select("doc_id", "key"), "rare")
    least = cut(rare.groupBy("key").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "least")
    return rare.join(least.hint("merge"), "key").filter(F.col("doc_id") != F.col("b")).select(F.col("doc_id").alias("a"), "b").distinct()


def links(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that connect what is linked inside the candidate clusters of edges."""
    members, found, rest = _settle(docs, cut(components(edges), "clusters").withColumnRenamed("component", "cluster"))
    sizes = small_side(rest.groupBy("cluster").agg(F.count(F.lit(1)).alias("left")))
    if not sizes.limit(1).count():
        return found
    of = lambda rows, which: rows.join(sizes.filter(which), "cluster").drop("left")
    held = cut(_texts(docs, members.join(sizes, "cluster")).select("cluster", "left", "doc_id", "text"), "held")
    small, big = F.col("left") <= BLOCK, F.col("left") > BLOCK
    members, rest, crowded = of(members, small), of(rest, small), held.filter(big)
    if crowded.limit(1).count():
        narrow = cut(components(rare_edges(crowded)), "narrow").withColumnRenamed("component", "cluster")
        closer, more, others = _settle(crowded, narrow)
        members, found, rest = members.unionByName(closer), found.unionByName(more), rest.unionByName(others)
    key = ["cluster", "i", "j"]
    met = _meeting(held, members, rest).repartition(shuffle_width(docs.sparkSession), *key).sortWithinPartitions(*key)
    return found.unionByName(met.mapInArrow(_meet, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept.

    Wants doc_id (long) and text; other columns are ignored. A null or wordless text has n_shingles 0 and
    links with nothing; so does a row without doc_id, whose component_id is null and which is kept. Rows
    with one doc_id are judged by their own texts. Ties fall to the least doc_id; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = cut(docs.mapInArrow(_sketch, SKETCH), "sketch")
    full = sketch.filter("doc_id is not null and n_shingles > 0")
    classes = full.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    firsts = full.groupBy("fp").agg(F.min_by("paths", "doc_id").alias("paths"), F.min("doc_id").alias("doc_id"))
    linked = cut(components(cut(links(docs, candidate_edges(firsts)), "links")), "components")
    # written, so that the last join stands on two exchanges of its own and a class with many copies can be split
    of_class = cut(classes.join(linked.hint("merge"), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "classes")
    out = sketch.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")).join(of_class.hint("merge"), "fp", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
