"""The order-statistics index: every rank, page and keyset walk as a sort has it, from one or two ranges."""

import math
import random

import pytest

from pyspark.sql import functions as F

from tessera.operators import search, verify
from tessera.operators.ranks import Ranks


def files(df):
    return len(df.inputFiles())


def test_ranks(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 2, 50, 7]) if i % 3 else rng.randint(0, 1000), f"n{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, score int, name string")
    index = Ranks.build(df, "score", "id", f"file://{tmp_path}/ranks", 250)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert index.total() == 3000 and index.ranges.count() > 8
    for offset, limit in ((0, 1), (1, 300), (1234, 25), (2990, 50), (3000, 5)):
        page = index.page(offset, limit)
        assert [tuple(r) for r in page.orderBy("place").collect()] == [(*r, offset + k + 1) for k, r in enumerate(order[offset : offset + limit])]
        assert files(page) <= 2 + limit // 150
    for k in (0, 777, 2999):
        after = index.after(order[k][1], order[k][0], 100)
        assert [tuple(r) for r in after.collect()] == order[k + 1 : k + 101]
        assert files(after) <= 3
    assert index.after(1001, 0, 5).collect() == [tuple(r) for r in order[:5]]
    for v in (50, 2, 999, -1, 2000):
        assert (index.above(v), index.above(v, True)) == (sum(r[1] > v for r in rows), sum(r[1] >= v for r in rows))
    near = index.around(1500).orderBy("place").collect()
    assert [(r.id, r.place, r.tied) for r in near] == [(r[0], 1498 + k, sum(x[1] == r[1] for x in rows)) for k, r in enumerate(order[1497:1502])]
    assert [r.place for r in index.around(1).orderBy("place").collect()] == [1, 2, 3]


def test_no_rows(spark, tmp_path):
    index = Ranks.build(spark.createDataFrame([], "id long, score int"), "score", "id", f"file://{tmp_path}/none")
    assert index.total() == 0 and index.page(0, 5).count() == 0 and index.after(100, 0, 5).count() == 0 and index.above(1) == 0


def test_layers_like_an_index_made_anew(spark):
    columns = ("name",)
    state = {i: f"alpha{i} beta" for i in range(30)}

    def frame(d):
        return spark.createDataFrame(list(d.items()), "id long, name string")

    tokens, dead = search.base_layer(frame(state), 0, columns=columns), spark.createDataFrame([], "id long, layer long")
    for layer, (put, gone) in enumerate(((({i: f"gamma{i}" for i in range(5)}), [7, 8]), ({7: "back again", 40: "new"}, [2]), ({2: "alpha2 beta"}, [])), 1):
        more, ended = search.layer_of(frame(put), frame(state), spark.createDataFrame([(g,) for g in gone], "id long"), layer, columns=columns)
        assert more.select("id").distinct().count() == len(put)
        tokens, dead = tokens.unionByName(more), dead.unionByName(ended)
        state = {k: v for k, v in state.items() if k not in gone} | put
        anew = search.index(frame(state), columns=columns)
        assert sorted(map(tuple, search.live(tokens, dead).select("id", "token").collect())) == sorted(map(tuple, anew.select("id", "token").collect()))
    assert not search.wants_compaction(tokens.filter(F.col("layer") == 0), dead.limit(0)) and search.wants_compaction(tokens.unionByName(tokens.withColumn("layer", F.lit(9).cast("long"))), dead)


@pytest.mark.parametrize("kind", ["double", "long", "int"])
def test_selection_is_exact(spark, kind):
    rng = random.Random(kind)
    pools = {"double": [-1.7e308, 1.7e308, 0.0, 1e-300, 2.5, float("inf"), float("-inf")] + [rng.gauss(0, 10**k) for k in range(0, 30)], "long": [-(2**63), 2**63 - 1, 0, 7, *range(50)], "int": [3]}
    for n in (1, 2, 701):
        x = [rng.choice(pools[kind]) for _ in range(n)]
        rows = spark.createDataFrame([(v,) for v in [*x, None]], f"v {kind}")
        down, fractions = sorted(x, reverse=True), [0.0, 0.1, 0.5, 0.99, 1.0]
        assert verify.selected(rows, fractions, "v") == [(f, down[math.floor((n - 1) * (1 - f))]) for f in fractions]
    assert verify.selected(rows.limit(0), [0.5], "v") == []
