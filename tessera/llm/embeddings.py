"""Near-duplicate vectors by randomly rotated binary codes with stored correction factors.

A code holds the signs of a unit vector after padding and a random rotation; its factor is the inner product
of the vector with its own code. For a rotated query q, <code, q> / factor is an unbiased estimate of the
cosine, and the factor gives its confidence bound: only pairs whose bound reaches the threshold are
recomputed from the vectors in double precision.

1. Equal vectors form one class, by 128 bits of a digest, counted by its size.
2. Bands of the codes deal the classes into buckets, large ones in pairs of blocks. The angle estimated from two codes
   says which pairs are near enough to be candidates. A pair is judged in the first band that it shares only.
3. Classes with a candidate in a block meet there once more, now with their vectors: estimate, bound, exact cosine, the
   count of links for each class, and a spanning forest of the true links. Components are those of true links.

The bits of a band grow with the number of classes, and the number of bands with them, so that a pair at the
threshold shares no band with a chance of `MISS` at most.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, runs, shuffle_width, small_side
from tessera.llm.graph import Forest, components
from tessera.llm.minhash import block_pairs

COSINE = 0.95
LEAST_BITS = 256
MISS = 1e-5
#: Width of the confidence bounds, in standard deviations of an estimate.
DEVIATIONS = 4.0
IN_BUCKET, BLOCK = 64, 512
_rotations: dict[int, np.ndarray] = {}


def rotation(width: int) -> np.ndarray:
    if width not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
        _rotations[width] = (q * np.sign(np.diag(r))).astype(np.float32)
    return _rotations[width]


def code_width(dims: int, least: int) -> int:
    return -(-max(dims, least) // 64) * 64


def rotated(units: np.ndarray, width: int) -> np.ndarray:
    return units.astype(np.float32) @ rotation(width)[: units.shape[1]]


def codes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs (uint64 words) of rotated unit vectors, and the factor of each."""
    packed = np.packbits(turned >= 0, axis=1, bitorder="little")
    return packed.view(np.uint64), np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def estimates(turned: np.ndarray, packed: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of queries (rows) with coded vectors (columns), and the bound of each column's error."""
    width = turned.shape[1]
    signs = np.unpackbits(packed.view(np.uint8), axis=1, bitorder="little").astype(np.float32) * 2 - 1
    est = turned @ signs.T / math.sqrt(width) / factor
    return est, DEVIATIONS * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(width - 1)


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision; None for what links with nothing."""
    out = []
    for x in column:
        if not x.is_valid or x.values.null_count or not len(x.values):
            out.append(None)
            continue
        v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        out.append(v if np.isfinite(v).all() and v.any() else None)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def _keys(batches):
    """vec_id and the class (a 128-bit digest of the vector) of each row; no class for what links with nothing."""
    for batch in batches:
        ids = batch.column(0)
        keys = [None if v is None or i is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest() for i, v in zip(ids.to_pylist(), rows_of(batch.column(1)), strict=True)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), batch.column(1)], names=["vec_id", "rep", "vector"])


BANDS = "rep binary, dims int, code binary, keys array<long>"


def _banded(bits: int, bands: int):
    def banded(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), rows_of(batch.column(1))
            for dims in sorted({len(v) for v in rows}):
                at = [i for i, v in enumerate(rows) if len(v) == dims]
                turned = rotated(np.stack([unit(rows[i]) for i in at]), code_width(dims, max(LEAST_BITS, bits * bands)))
                signs = turned[:, : bits * bands].reshape(len(at), bands, bits) >= 0
                keys = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)
                packed, _ = codes(turned)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in at], pa.binary()), pa.array([dims] * len(at), pa.int32()), pa.array([c.tobytes() for c in packed], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))],
                    names=["rep", "dims", "code", "keys"],
                )

    return banded


def band_shape(classes: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits of a band, number of bands."""
    bits = min(24, max(8, math.ceil(math.log2(max(1, classes) / IN_BUCKET))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def _first_band(apart: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """For differences of two codes the first band in which they agree."""
    off = np.unpackbits(np.ascontiguousarray(apart).view(np.uint8), axis=1, bitorder="little")[:, : bits * bands]
    return off.reshape(len(apart), bands, bits).any(2).argmin(1)


BLOCK_KEY = ["dims", "band", "key", "i", "j"]
MEMBERS = "dims int, band int, key long, i int, j int, own int, rep binary"


def _near(cosine: float, bits: int, bands: int):
    share = math.acos(cosine) / math.pi

    def near(batches):
        """The members of each pair of blocks that have a candidate on the other side, or in the block itself."""
        for block in runs(batches, BLOCK_KEY):
            if block.num_rows < 2:
                continue
            c = np.stack([np.frombuffer(x, np.uint64) for x in block["code"].to_pylist()])
            own, (i, j, band) = block["own"].to_numpy(), (block[k][0].as_py() for k in ("i", "j", "band"))
            # bits of one vector depend on each other, so at most as many count as it has dimensions
            free = min(c.shape[1] * 64, block["dims"][0].as_py())
            most = c.shape[1] * 64 * (share + DEVIATIONS * math.sqrt(share * (1 - share) / free))
            met = np.zeros(len(c), bool)
            for x in np.flatnonzero(own == i):
                others = np.arange(x + 1, len(c)) if i == j else np.flatnonzero(own == j)
                apart = c[others] ^ c[x]
                hit = np.flatnonzero(np.bitwise_count(apart).sum(1) <= most)
                hit = hit[_first_band(apart[hit], bits, bands) == band] if len(hit) else hit
                if len(hit):
                    met[x] = met[others[hit]] = True
            if met.any():
                kept = block.filter(pa.array(met)).select([f.split()[0] for f in MEMBERS.split(", ")])
                yield from kept.combine_chunks().to_batches()

    return near


def _linked(cosine: float, bits: int, bands: int):
    def linked(batches):
        """(a, b, n): b null and n the weight that a links with in this pair of blocks, or a link (a, b)."""
        for block in runs(batches, BLOCK_KEY):
            ids, own = block["rep"].to_pylist(), block["own"].to_numpy()
            i, j, band = (block[k][0].as_py() for k in ("i", "j", "band"))
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(left) or not len(right):
                continue
            u, weight = np.stack([unit(v) for v in rows_of(block["vector"].combine_chunks())]), block["weight"].to_numpy()
            turned = rotated(u, code_width(u.shape[1], max(LEAST_BITS, bits * bands)))
            packed, factor = codes(turned)
            est, bound = estimates(turned[left], packed[right], factor[right])
            if i == j:
                est[np.tril_indices(len(left))] = -9
            x, y = np.nonzero(est + bound >= cosine)
            hit = np.zeros(len(x), bool)
            for s in range(0, len(x), 1 << 15):
                a, b = left[x[s : s + (1 << 15)]], right[y[s : s + (1 << 15)]]
                hit[s : s + (1 << 15)] = ((u[a] * u[b]).sum(1) >= cosine) & (_first_band(packed[a] ^ packed[b], bits, bands) == band)
            x, y = left[x[hit]], right[y[hit]]
            n = np.bincount(x, weight[y], len(ids)) + np.bincount(y, weight[x], len(ids))
            forest = Forest(len(ids))
            edges = [(ids[p], ids[q]) for p, q in zip(x.tolist(), y.tolist(), strict=True) if forest.join(p, q)]
            seen = np.flatnonzero(n).tolist()
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([*(ids[k] for k in seen), *(max(e) for e in edges)], pa.binary()), pa.array([*[None] * len(seen), *(min(e) for e in edges)], pa.binary()), pa.array([*n[seen].astype(np.int64).tolist(), *[None] * len(edges)], pa.int64())], names=["a", "b", "n"])

    return linked


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """A row for each row of vectors: vec_id, n_links, component_id, kept.

    Wants vec_id (long) and embedding (array of float or double); other columns are ignored. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths or rows without vec_id (component_id null, kept). Repeated rows count as vectors of their own with
    one vec_id. No rows give no rows.
    """
    spark = vectors.sparkSession
    width = shuffle_width(spark)
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    keyed = source.mapInArrow(_keys, "vec_id long, rep binary, vector array<double>")
    classes = cut(keyed.filter("rep is not null").groupBy("rep").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector")), "classes")
    bits, bands = band_shape(classes.count(), cosine)
    coded = cut(classes.select("rep", "vector").repartition(width, "rep").mapInArrow(_banded(bits, bands), BANDS), "codes")
    slots = coded.select("rep", "dims", "code", F.posexplode("keys").alias("band", "key"))
    bucket = ["dims", "band", "key"]
    # only what is larger than a block has to know its size
    large = small_side(slots.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK))
    sized = slots.join(large, bucket, "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    dealt = sized.select(*bucket, F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")).cast("int").alias("own"), F.explode(block_pairs("rep", "size", BLOCK)).alias("p"), "rep", "code").select(*bucket, "p.i", "p.j", "own", "rep", "code")
    near = cut(dealt.repartition(width, *BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY).mapInArrow(_near(cosine, bits, bands), MEMBERS), "near")
    met = near.join(classes.select("rep", "vector", "weight").hint("merge"), "rep")
    found = cut(met.repartition(width, *BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY).mapInArrow(_linked(cosine, bits, bands), "a binary, b binary, n long"), "links")
    degrees = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = cut(components(found.filter("b is not null").select("a", "b")), "components").select(F.col("node").alias("rep"), "component")
    of_class = classes.select("rep", "first_id", "weight").join(degrees.hint("merge"), "rep", "left").join(joined.hint("merge"), "rep", "left").select("rep", "first_id", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # written, so that both sides of the join are plain exchanges and a large component can be split
    of_class = cut(of_class, "components")
    least = cut(of_class.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    of_class = of_class.join(least.hint("merge"), "component").select("rep", "n_links", "component_id")
    out = keyed.select("vec_id", "rep").join(cut(of_class, "of-class").hint("merge"), "rep", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
