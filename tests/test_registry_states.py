"""The stream with a state by source id: like one import after another, across batches and restarts."""

import json

import pytest

from tessera.operators.store import Store
from tessera.sources import registry_csv
from tessera.streaming import registry_states as states

HEADER = list(registry_csv.COLUMNS)


def text(*rows, header=HEADER):
    """A file of (id, name) rows, or of raw lines."""
    out = [",".join(f'"{h}"' for h in header)]
    for r in rows:
        cell = {"Corporation number": r[0], "Corporate name - form 1": r[1]} if isinstance(r, tuple) else None
        out.append(",".join(f'"{cell.get(h, "")}"' for h in header) if cell else r)
    return "\n".join(out) + "\n"


@pytest.fixture
def rocks(spark):
    keys = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], states.ROCKS)
    yield
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def test_rows_of_files():
    rows = list(states.rows_of("f", text(("1", 'A ""quoted""'), "x,y", ("", "none"), header=HEADER[::-1])))
    assert [(r[1], r[2], r[3], r[5]) for r in rows] == [(1, False, "1", 'A "quoted"'), (2, True, None, None), (3, False, None, "none")]
    for bad in (text(header=["a"]), "", text() + '"open'):
        with pytest.raises(registry_csv.SourceError):
            list(states.rows_of("f", bad))


def test_first_row_wins_across_batches_and_restarts(spark, tmp_path, rocks):
    folder = tmp_path / "in"
    folder.mkdir()
    store = Store(spark, f"file://{tmp_path}/store")
    told = []

    def run(name, body):
        (folder / name).write_text(body)
        q = states.follow(spark, str(folder), store, f"{tmp_path}/checkpoint")
        if not q.awaitTermination(90):
            q.stop()
            raise TimeoutError("the stream goes on without new files")
        told.append([p["observedMetrics"]["intake"] for p in map(lambda p: json.loads(p.json) if not isinstance(p, dict) else p, q.recentProgress) if "intake" in p["observedMetrics"]])
        return {(r.source_id, r.legal_name, r.action, r.duplicates) for r in store.read("stream").filter(f"_batch = {store.manifest()['state']['batch_stream']}").collect()}

    assert run("a.csv", text(("1", "One"), ("2", "Two"), ("1", "Later"), "ragged,row", ("", "no id"))) == {("1", "One", "insert", 1), ("2", "Two", "insert", 0)}
    assert run("b.csv", text(("1", "One"), ("3", "Three"), ("2", "Changed"), header=HEADER[::-1])) == {("3", "Three", "insert", 0), ("2", "Changed", "update", 0)}
    assert {(r.source_id, r.legal_name) for r in states.current(store).collect()} == {("1", "One"), ("2", "Changed"), ("3", "Three")}
    assert [(x["rows"], x["ragged"], x["without_id"]) for batch in told for x in batch if x["rows"]] == [(5, 1, 1), (3, 0, 0)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "other")
    with pytest.raises(RuntimeError):
        states.changes(spark, str(folder))
