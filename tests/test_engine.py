"""The engine end to end: import, evidence runs, scores, freshness."""

import hashlib
import json
import os
import time

import pytest

from tessera.operators import intake
from tessera.operators.evidence import Signal
from tessera.operators.store import Busy, Store
from tessera.plans.engine import LINKS, Cancelled, Engine
from tessera.sources import registry_csv
from tessera.sources.workbook import json_lines
from tests.test_registry import line, write

SIGNALS = (Signal("is_importer", "presence"), Signal("n", "row_count"), Signal("last", "max_number", "year"))


def rows(tmp_path, name, *cases):
    path = tmp_path / name
    path.write_text("".join(json.dumps({"source_key": k, "name": n, "city": c, "province": "NL", "country": None, "postal": None, "source_row_number": i + 1, "raw": "{}", "attributes": json.dumps(a), "observed_at": t}) + "\n" for i, (k, n, c, a, t) in enumerate(cases)))
    return str(path)


def test_engine(spark, tmp_path):
    told = []
    e = Engine(spark, f"file://{tmp_path}/engine", told.append)
    report = e.import_registry(write(tmp_path, line("1", "Northern Software Inc."), line("2", "Blue Holdings Inc."), line("3", "1234567 Canada Inc.")), "t1")
    assert report["inserted"] == 3 and e.summary()["total"] == 3 and e.get("2").legal_name == "Blue Holdings Inc."
    assert e.profile_summary()["is_candidate"] == 2 and e.search("north")["total"] == 1
    with pytest.raises(ValueError):
        e.import_registry(write(tmp_path, header="a,b", name="bad.csv"), "t2")
    assert e.summary()["latest_import"]["status"] == "failed" and e.summary()["total"] == 3
    source = json_lines("listing", "1", SIGNALS)
    report = e.import_evidence(rows(tmp_path, "a.jsonl", ("k", "NORTHERN SOFTWARE", "Ottawa", {"year": 2023}, None), ("k", "NORTHERN SOFTWARE", "Ottawa", {"year": 2024}, "2024-05-01"), ("z", "Nobody", "Ottawa", {}, None)), source, "t3")
    assert {k: report[k] for k in ("rows", "identities", "matched", "unmatched")} == {"rows": 3, "identities": 2, "matched": 1, "unmatched": 1}
    seen = e.coverage(1)
    assert {o.signal_type: (o.value_boolean, o.value_number) for o in seen["observations"]} == {"is_importer": (True, None), "n": (None, 2.0), "last": (None, 2024.0)}
    assert len(seen["observations"][0].source_rows) == 2 and not e.coverage(2)["has_evidence"]
    assert e.ranked() == []
    assert e.prepare_scores("listing", "t4") == {"scored": 2, "changed": 2, "removed": 0}
    assert e.prepare_scores("listing", "t5") == {"scored": 2, "changed": 0, "removed": 0}
    assert [r.id for r in e.ranked()] == [1, 2] and e.score(1).scored_at == "t4" and e.score(1).has_importer_evidence
    with pytest.raises(ValueError):
        e.import_evidence(rows(tmp_path, "b.jsonl", ("k", "A", "Ottawa", {}, None), ("k", "B", "Ottawa", {}, None)), source, "t6")
    assert e.coverage(1)["has_evidence"] and e.state()["ready"]
    e.import_evidence(rows(tmp_path, "c.jsonl", ("y", "Blue Holdings", "Ottawa", {}, None)), source, "t7")
    assert not e.coverage(1)["has_evidence"] and e.coverage(2)["has_evidence"] and not e.state()["ready"] and e.ranked() == []
    assert e.prepare_scores("listing", "t8") == {"scored": 2, "changed": 2, "removed": 0}
    assert e.search("ottawa", ranked=True)["rows"][0].score >= e.search("ottawa", ranked=True)["rows"][1].score
    with pytest.raises(LookupError):
        e.decide("k", 99, 1, "rejected")
    e.decide("k", 1, 1, "rejected")
    e.decide("k", 1, 1, "candidate")
    assert {(r.source_key, r.id, r.run_id): r.status for r in e.matches().collect()}["k", 1, 1] == "candidate"
    assert [(r.id, r.status, r.file_name) for r in e.imports()] == [(2, "failed", "bad.csv"), (1, "completed", "registry.csv")] and len(e.imports()[1].file_sha256) == 64
    assert [(r.run_id, r.status, r.stage) for r in e.workflows()] == [(3, "completed", "evidence_ready"), (2, "failed", "failed"), (1, "completed", "evidence_ready")]
    assert json.loads(e.workflows()[2].report)["corporations"] == 1
    assert {"error", "complete"} < {x["type"] for x in told} and [x["stage"] for x in told if x.get("run_id") == 1 and x["type"] == "progress"] == ["source_ready", "preparing_candidates", "matching_evidence", "evidence_ready"]
    assert e.observe("listing", "hand", "n", 1, 3)["created"]
    e.observe("listing", "hand", "is_importer", 1, False)
    assert {(o.signal_type, o.value_number, o.value_boolean) for o in e.coverage(1)["observations"]} == {("n", 3.0, None), ("is_importer", None, False)}
    assert e.observe("listing", "hand", "n", 1, None)["removed"]
    assert len(e.coverage(1)["observations"]) == 1
    for bad in ((" ", "k", "n", 1, 1), ("s", "k", "n", 1, float("nan"))):
        with pytest.raises(ValueError):
            e.observe(*bad)
    report = e.verify()
    assert json.loads(json.dumps(report))["tables"]["accounts"] == 3 and report["evidence_orphans"] == 0 and report["walk"] == {"rows": 3, "keys": 3, "in_order": True}
    e.cancelled = lambda: True
    with pytest.raises(Cancelled):
        e.import_registry(write(tmp_path, line("8", "Eighth"), name="late.csv"), "t9")
    assert e.summary()["total"] == 3 and e.summary()["latest_import"]["status"] == "failed"


def test_runs_of_one_source(spark, tmp_path):
    """Ids and times of observations over runs, rows of their own run, outcomes, unknown targets, fresh scores, index layers."""
    e = Engine(spark, f"file://{tmp_path}/engine")
    e.import_registry(write(tmp_path, line("1", "Northern Software Inc."), line("2", "Blue Holdings Inc.")), "t1")
    source = json_lines("listing", "1", SIGNALS)
    case = lambda n, year=2023: ("k", "NORTHERN SOFTWARE", "Ottawa", {"year": year, "n": n}, None)
    other = ("z", "Nobody", "Ottawa", {}, None)
    first = e.import_evidence(rows(tmp_path, "a.jsonl", case(1), case(2), case(3), other), source, "t2")
    assert [first[f"evidence_{k}"] for k in ("created", "updated", "removed")] == [3, 0, 0]
    before = {o.signal_type: (o.id, o.created_at) for o in e.coverage(1)["observations"]}
    again = e.import_evidence(rows(tmp_path, "a.jsonl", case(1), case(2), case(3), other), source, "t3")
    assert [again[f"evidence_{k}"] for k in ("created", "updated", "removed")] == [0, 3, 0] and e.feed(2).count() == 0
    assert {o.signal_type: (o.id, o.created_at) for o in e.coverage(1)["observations"]} == before and sorted(i for i, _ in before.values()) == [1, 2, 3]
    third = e.import_evidence(rows(tmp_path, "b.jsonl", case(9)), source, "t4")
    seen = e.coverage(1)["observations"]
    assert third["evidence_updated"] == 3 and [json.loads(r.raw) for o in seen for r in o.source_rows] == [{}] * 3 and {(o.id, o.created_at, o.updated_at) for o in seen} == {(i, "t2", "t4") for i, _ in before.values()}
    assert {r.change for r in e.feed(3).collect()} == {"updated"} and [(r.file_name, len(r.file_sha256)) for r in e.workflows()] == [("b.jsonl", 64), ("a.jsonl", 64), ("a.jsonl", 64)]
    about = json.loads(seen[0].metadata)
    assert about["filename"] == "b.jsonl" and about["source_row_count"] == 1 and about["matching"]["strength"] == "excellent"
    assert {(r.source_key, r.outcome, r.accepted_id) for r in e.outcomes(1).collect()} == {("k", "accepted", 1), ("z", "unmatched", None)}
    last = e.import_evidence(rows(tmp_path, "c.jsonl", ("y", "Blue Holdings", "Ottawa", {"year": 1}, None)), source, "t5")
    assert [last[f"evidence_{k}"] for k in ("created", "updated", "removed")] == [3, 0, 3] and not e.coverage(1)["has_evidence"]
    assert sorted((r.id, r.change) for r in e.feed(4).collect()) == [*((i, "removed") for i in (1, 2, 3)), *((i, "created") for i in (4, 5, 6))]
    with pytest.raises(LookupError):
        e.observe("listing", "hand", "n", 999, 1)
    with pytest.raises(LookupError):
        e.observe("listing", "hand", "n", None, 1, company_id=5)
    with pytest.raises(ValueError):
        e.observe("listing", "hand", "n", None, 1)
    assert e.observe("listing", "hand", "n", 1, 5, now="t6") == {"id": 7, "created": True, "removed": False} and e.observe("listing", "hand", "n", 1, 6, now="t7") == {"id": 7, "created": False, "removed": False}
    assert [(o.id, o.value_number, o.created_at, o.updated_at, o.source_rows) for o in e.coverage(1)["observations"]] == [(7, 6.0, "t6", "t7", None)]
    # ranked pages have fresh scores only
    e.prepare_scores("listing", "t8")
    assert [r.id for r in e.search(ranked=True)["rows"]] == [r.id for r in e.ranked()] and e.search(ranked=True)["total"] == 2 and e.search(ranked=True)["rows"][0].score >= 1
    folders = lambda: len(e.store.manifest()["tables"]["tokens"])
    layers = folders()
    e.import_registry(write(tmp_path, line("1", "Northern Software Inc."), line("2", "Blue Holdings Inc.")), "t9")
    assert folders() == layers and e.search("north")["total"] == 1  # an unchanged import adds no index rows
    e.import_registry(write(tmp_path, line("1", "Southern Software Inc."), line("2", "Blue Holdings Inc."), line("3", "Third Inc.")), "t10")
    assert folders() == layers + 1 and [e.search(q)["total"] for q in ("north", "south", "third", "blue", "software")] == [0, 1, 1, 1, 1]
    assert [r.id for r in e.search(ranked=True)["rows"]] == [2] and e.search("software", ranked=True)["total"] == 0 and e.ranked() == []


def test_a_running_job_is_ended(spark, tmp_path, monkeypatch):
    """Cancellation inside a step: the job ends within seconds, progress was told meanwhile, and the audit row says so."""
    told, began = [], []

    def slowly(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    def slow_import(*_):
        began.append(time.time())
        spark.range(0, 8, 1, 8).mapInArrow(slowly, "id long").count()

    e = Engine(spark, f"file://{tmp_path}/engine", told.append, lambda: bool(began) and time.time() - began[0] > 4)
    path = write(tmp_path, line("1", "Northern Software Inc."))
    monkeypatch.setattr(registry_csv, "import_file", slow_import)
    with pytest.raises(Cancelled, match="while reading"):
        e.import_registry(path, "t1")
    assert time.time() - began[0] < 40 and (e.imports()[0].status, e.imports()[0].error) == ("failed", "ended while reading")
    assert any(x.get("of") == 8 for x in told) and spark.range(5).count() == 5
    with e.store.lock():
        pass


def test_the_lock_has_an_owner(spark, tmp_path):
    one, two = Store(spark, f"file://{tmp_path}/store"), Store(spark, f"file://{tmp_path}/store")
    rows = spark.range(1)
    with one.lock():
        with pytest.raises(Busy), two.lock():
            pass
        with two.lock(stale=-1):
            with pytest.raises(Busy):
                one.commit({"t": rows})
            two.commit({"t": rows})
        assert one._holder() is None
    with one.lock():
        one.commit({"t": rows})


def test_uploads_and_rules(spark, tmp_path):
    path = write(tmp_path, line("1", "O'Brien Inc."))
    file = intake.identify(spark, path)
    assert file.name == "registry.csv" and file.size == os.path.getsize(path) and file.sha256 == hashlib.sha256(open(path, "rb").read()).hexdigest()
    assert intake.check_upload(file, [file.sha256.upper()]) == file
    for bad, kind in ((file._replace(name="a.txt"), "name"), (file._replace(name=".csv"), "name"), (file._replace(size=0), "empty"), (file._replace(size=(200 << 20) + 1), "size"), (file._replace(sha256="0"), "content")):
        with pytest.raises(intake.Refused) as e:
            intake.check_upload(bad, [file.sha256])
        assert e.value.kind == kind
    intake.check_unchanged(spark, path, file)
    write(tmp_path, line("1", "Other"), line("2", "More"))
    with pytest.raises(RuntimeError, match="changed"):
        intake.check_unchanged(spark, path, file)
    e = Engine(spark, f"file://{tmp_path}/store")
    with pytest.raises(intake.Refused):
        e.import_registry(path, "t", allowed=[file.sha256])
    e.import_registry(path, "t", allowed=[intake.identify(spark, path).sha256])
    rows = spark.createDataFrame([("a", 1, None), ("z", 2, 3)], "k string, x int, y int")
    rules = {"k": intake.one_of("k", ("a", "z")), "x": intake.between("x", 0, 2), "one": intake.exactly_one(("x",))}
    assert intake.check(rows, rules).count() == 2
    with pytest.raises(ValueError, match=r"k \(1\), one \(1\)"):
        intake.check(rows, {"k": intake.one_of("k", ("a",)), "one": intake.exactly_one(("x", "y"))})


def test_companies_and_links(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/engine")
    shape = "provider string, provider_company_id string, name string, industry string, employee_count double, provided array<string>"
    e.upsert_companies(spark.createDataFrame([("p", "1", "Acme Ltd.", "tools", 5.0, ["name", "industry", "employee_count"]), ("p", "2", "Beta", None, None, ["name"])], shape), "t1")
    got = {r.provider_company_id: r for r in e.upsert_companies(spark.createDataFrame([("p", "1", None, None, 7.0, ["industry", "employee_count"]), ("q", "1", "Gamma", None, None, ["name"])], shape), "t2").collect()}
    both = {(r.provider, r.provider_company_id): r for r in e._table("companies").collect()}
    assert len(both) == 3 and sorted(r.id for r in both.values()) == [1, 2, 3] and got
    one = both["p", "1"]
    assert (one.id, one.name, one.industry, one.employee_count, one.normalized_name, one.created_at, one.updated_at) == (1, "Acme Ltd.", None, 7.0, "acme", "t1", "t2") and both["p", "2"].updated_at == "t1"
    with pytest.raises(ValueError):
        e.upsert_companies(spark.createDataFrame([(" ", "1", None, None, -1.0, [])], shape), "t3")
    shape = "corporation_id long, company_id long, match_method string, name_similarity double, location_match string, match_confidence double"
    e.upsert_links(spark.createDataFrame([(1, 1, "exact", 1.0, "province", 0.8)], shape), "t1")
    e.decide_link(1, "accepted", "t1")
    for bad, kind in (((1, "maybe", "t"), ValueError), ((9, "rejected", "t"), LookupError)):
        with pytest.raises(kind):
            e.decide_link(*bad)
    got = {r.company_id: (r.id, r.match_status, r.match_confidence, r.created_at, r.updated_at) for r in e.upsert_links(spark.createDataFrame([(1, 1, "exact", 1.0, "none", 0.4), (1, 2, "fuzzy", 0.9, "none", 0.3)], shape), "t2").collect()}
    assert got == {1: (1, "accepted", 0.4, "t1", "t2"), 2: (2, "candidate", 0.3, "t2", "t2")}
    with pytest.raises(ValueError):
        e.upsert_links(spark.createDataFrame([(1, 1, "exact", 1.5, "none", 0.4)], shape), "t3")
    more = shape + ", provider_confidence double, city_match boolean, evidence_json string"
    for bad in ((1.2, "{}"), (0.5, "{")):
        with pytest.raises(ValueError):
            e.upsert_links(spark.createDataFrame([(1, 2, "fuzzy", 0.9, "none", 0.3, bad[0], True, bad[1])], more), "t4")
    got = {r.company_id: r for r in e.upsert_links(spark.createDataFrame([(1, 2, "fuzzy", 0.9, "none", 0.3, None, True, '{"a": 1}')], more), "t4").collect()}
    assert (got[2].city_match, got[2].evidence_json, got[2].provider_confidence, got[1].city_match, e._table("links", LINKS).filter("company_id = 1").first().evidence_json) == (True, '{"a": 1}', None, None, "{}")
