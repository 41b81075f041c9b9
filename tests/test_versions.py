"""Hash trees of two versions, and tables in buckets."""

import glob
import random

from pyspark.sql import functions as F

from tessera.operators import hash_tree
from tessera.operators.hash_tree import HashTree
from tessera.operators.store import Store, bucket_of


def test_changed_keys_from_few_ranges(spark, tmp_path):
    rng = random.Random(2)
    old = {k: rng.random() for k in rng.sample(range(-20_000, 60_000), 8000)}
    new = dict(old)
    for k in rng.sample(sorted(old), 4):
        new[k] += 1
    gone = rng.sample(sorted(old), 3)
    for k in gone:
        new.pop(k)
    new[70_001] = None
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, v double")
    a, b = (HashTree.build(frame(d), "id", f"file://{tmp_path}/{n}", 64) for n, d in (("a", old), ("b", new)))
    want = {(k, "removed") for k in old if k not in new} | {(k, "created") for k in new if k not in old} | {(k, "updated") for k in old if k in new and old[k] != new[k]}
    assert {tuple(r) for r in hash_tree.changed_keys(a, b).collect()} == want and len(want) >= 5
    ranges, compared = hash_tree.different(a, b)
    assert ranges.count() <= 8 and compared < 700 < a.levels.filter("level = 0").count()
    assert hash_tree.changed_keys(a, a).count() == 0 and hash_tree.different(a, a)[1] <= 2
    read = b.rows(ranges)
    assert read.count() < 8 * 64 and "PushedFilters" in read._jdf.queryExecution().executedPlan().toString()
    assert hash_tree.root(frame(old), "id") == hash_tree.root(frame(old).repartition(7), "id") != hash_tree.root(frame(new), "id")


def test_trees_of_other_heights_and_without_rows(spark, tmp_path):
    none, few, many = (HashTree.build(spark.range(n).withColumn("v", F.lit(1)), "id", f"file://{tmp_path}/{n}", 4) for n in (0, 3, 5000))
    assert hash_tree.changed_keys(none, none).count() == 0
    for a, b, n, change in ((none, few, 3, "created"), (few, none, 3, "removed"), (few, many, 4997, "created"), (many, few, 4997, "removed")):
        assert hash_tree.changed_keys(a, b).groupBy("change").count().collect() == [(change, n)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.range(5000).select("id", F.lit("a").alias("v"), F.lit("x").alias("kept"))
    store.commit_buckets("t", rows, ["id"], 32)
    before = set(glob.glob(f"{tmp_path}/store/t/*/*/*.parquet"))
    assert len(before) == 32 and store.read_buckets("t").count() == 5000
    ids = [7, 4999, 6000]
    batch = spark.createDataFrame([(i, "b", "y") for i in ids], "id long, v string, kept string")
    touched = store.upsert_buckets("t", batch, ("kept",), spark.createDataFrame([(8,)], "id long"))
    want = {r[0] for r in spark.createDataFrame([(i,) for i in (*ids, 8)], "id long").select(bucket_of(["id"], 32)).collect()}
    assert set(touched) == want and len(set(glob.glob(f"{tmp_path}/store/t/*/*/*.parquet")) - before) == len(want)
    got = {r.id: (r.v, r.kept) for r in store.read_buckets("t").collect()}
    assert len(got) == 5000 and 8 not in got and [got[i] for i in (7, 6000, 9)] == [("b", "x"), ("b", "y"), ("a", "x")]
    version = store.manifest()["version"]
    assert store.upsert_buckets("t", batch.limit(0)) == [] and store.manifest()["version"] == version
    store.commit({"other": rows})
    assert store.read_buckets("t").count() == 5000 and store.read("other").count() == 5000
    alone = Store(spark, f"file://{tmp_path}/one")
    alone.commit_buckets("t", rows.limit(1), ["id"], 4)
    alone.upsert_buckets("t", batch.limit(0), (), rows.limit(1))
    assert alone.read_buckets("t").count() == 0
