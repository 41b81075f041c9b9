"""Registry files, snapshots, search, evidence and resolution, end to end on small inputs of our own."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes, evidence, resolution, search, verify
from tessera.operators.store import Busy, Store, check_counters, config_hash
from tessera.sources import registry_csv, workbook
from tessera.streaming import registry_stream

HEADER = list(registry_csv.COLUMNS)


def line(number, name="Acme Inc.", city="Ottawa", **more):
    cells = {"Corporation number": number, "Corporate name - form 1": name, "City/town": city, "Province/territory": "NF", "Postal code": "k1a0b1"} | more
    return ",".join('"' + cells.get(h, "").replace('"', '""') + '"' for h in HEADER)


def write(tmp_path, *lines, name="registry.csv", header=",".join(HEADER)):
    path = tmp_path / name
    path.write_text("﻿" + "\n".join([header, *lines]) + "\n", encoding="utf-8")
    return str(path)


def test_import_and_reimport(spark, tmp_path):
    body = [line("0001", 'Café "Nord", Inc.\nSuite', BN="x"), "", line("2", "Other", **{"Business number (BN)": "7"}), line("3", "", ""), line("2", "Again"), line(" "), "only,two"]
    path = write(tmp_path, *body)
    snapshot, report = registry_csv.import_file(spark, path, None, "t1")
    assert {k: v for k, v in report.items() if k != "issues"} == {"processed": 6, "inserted": 3, "updated": 0, "skipped": 1, "invalid": 2, "duplicates": 1}
    check_counters({k: v for k, v in report.items() if k != "issues"})
    assert len(report["issues"]) == 2
    rows = {r.source_id: r for r in snapshot.collect()}
    assert rows["0001"].legal_name == 'Café "Nord", Inc. Suite' and rows["0001"].postal_code_normalized == "K1A 0B1"
    assert rows["0001"].province_normalized == "NL" and rows["0001"].province_raw == "NF" and rows["3"].legal_name is None
    assert sorted(r.id for r in rows.values()) == [1, 2, 3]
    stored = spark.createDataFrame(snapshot.collect(), snapshot.schema)
    again, report = registry_csv.import_file(spark, path, stored, "t2")
    assert (report["inserted"], report["updated"], report["skipped"], report["invalid"]) == (0, 0, 4, 2)
    changed = write(tmp_path, line("2", "New name", "Gatineau"), line("9", "Ninth"), name="b.csv")
    after, report = registry_csv.import_file(spark, changed, stored, "t3")
    got = {r.source_id: r for r in after.collect()}
    assert (report["inserted"], report["updated"]) == (1, 1) and got["2"].legal_name == "New name" and got["2"].id == rows["2"].id
    assert got["2"].imported_at == "t1" and got["2"].updated_at == "t3" and got["9"].id == 4 and len(got) == 4


def test_bad_files(spark, tmp_path):
    for lines, header in (([line("1")], "a,b"), ([line("1") + '\n"open'], ",".join(HEADER)), ([], ",".join(HEADER)), ([line(" ")], ",".join(HEADER))):
        with pytest.raises(registry_csv.SourceError):
            registry_csv.import_file(spark, write(tmp_path, *lines, header=header), None, "t")
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(registry_csv.SourceError):
        registry_csv.import_file(spark, str(tmp_path / "empty.csv"), None, "t")


ACCOUNTS = "id int, source_id string, business_number string, legal_name string, alternate_name string, city string, province_normalized string, country string, postal_code string"


def accounts(spark, *rows):
    return spark.createDataFrame([(i + 1, f"{i:05}", None, *r) for i, r in enumerate(rows)], ACCOUNTS)


def test_search_and_pages(spark):
    rows = accounts(spark, *[(f"Fixture {k} Ltd.", None, "Montréal", "QC", None, None) for k in range(61)], ("Other", "Étoile", "Québec", "QC", None, None))
    tokens = search.index(rows)
    hits = search.filtered(rows, "fix mont", tokens=tokens)
    sizes = [search.page_of(hits, p, ["id"]) for p in (1, 2, 3, 1e6, float("nan"))]
    assert [(s[0].count(), s[1], s[2]) for s in sizes] == [(25, 1, 61), (25, 2, 61), (11, 3, 61), (11, 3, 61), (25, 1, 61)]
    assert [r.id for r in search.filtered(rows, "etoi", tokens=tokens).collect()] == [r.id for r in search.filtered(rows, "étoi").collect()] == [62]
    assert search.filtered(rows, "*").count() == 0 and search.filtered(rows, "x").count() == 0 and search.filtered(rows, "", "qc").count() == 62
    assert search.filtered(rows, None, "Quebec").count() == 0
    with pytest.raises(ValueError):
        search.keyset(rows, limit=0)
    with pytest.raises(ValueError):
        search.ranked_keyset(rows, 102)


def test_resolution_outcomes(spark):
    from tessera.functions import identity, matching

    reg = accounts(
        spark,
        ("Plain Goods Inc.", None, "Toronto", "ON", "CA", "K1A 0B1"),
        ("1234567 Canada Inc.", "Autre Nom Ltée", "Montréal", "QC", None, None),
        ("Twin Corp.", None, "Ottawa", "ON", None, None),
        ("Twin Limited", None, "Ottawa", "ON", None, None),
        ("Nameless Place", None, None, None, None, None),
        ("Fuzzy Target Works", None, "Halifax", "NS", None, None),
    )
    p = identity.profiles(reg)
    registry = p.select("id", "is_candidate", F.col("normalized_legal_name").alias("r_legal"), F.col("normalized_alternate_name").alias("r_alternate"), identity.normalise_text("city").alias("r_city"), identity.region("province_normalized").alias("r_province"), identity.country("country").alias("r_country"), F.col("postal_code").alias("r_postal"))
    src = spark.createDataFrame(
        [(1, "PLAIN GOODS", "Toronto", "Ontario", None, "k1a0b1"), (2, "Autre nom", "Montreal", "Québec", None, None), (3, "Twin", "Ottawa", "ON", None, None), (4, "Nameless Place", "Ottawa", "ON", None, None), (5, "Fuzzy Target Work", "Halifax", "NS", None, None), (6, "Nobody", "Regina", "SK", None, None), (7, "1234567 Canada", "Toronto", "ON", None, None), (8, "Plain Goods", "Toronto", "ON", "USA", None)],
        "key int, name string, city string, province string, country string, postal string",
    ).withColumns(matching.source_identity("name", "city", "province", "country", "postal")).drop("city", "province", "country")
    outcomes, judged = resolution.resolve(src, registry)
    got = {r.key: (r.outcome, r.accepted_id) for r in outcomes.collect()}
    assert got == {1: ("accepted", 1), 2: ("accepted", 2), 3: ("ambiguous", None), 4: ("unmatched", None), 5: ("candidate", None), 6: ("unmatched", None), 7: ("unmatched", None), 8: ("unmatched", None)}
    assert {(r.key, r.id): r.status for r in judged.filter("key in (1, 3, 5)").collect()} == {(1, 1): "accepted", (3, 3): "ambiguous", (3, 4): "ambiguous", (5, 6): "candidate"}
    assert judged.filter("key = 1").first().postal_match is True
    assert resolution.outcome_counts(outcomes).first().asDict() == {"matched": 2, "ambiguous": 1, "unmatched": 5, "probable": 1}
    capped = resolution.resolve(src, registry, exact_limit=1)[0]
    assert capped.filter("key = 3").first().reason == "retrieval_limit_requires_review"


def test_signals(spark):
    rows = spark.createDataFrame([("a", '{"y": 2024, "c": "x"}'), ("a", '{"y": "2024", "c": " "}'), ("a", '{"y": null, "c": "z"}'), ("b", "{}")], "key string, attributes string")
    wanted = [evidence.Signal("seen", "presence"), evidence.Signal("n", "row_count"), evidence.Signal("years", "distinct_count", "y"), evidence.Signal("kinds", "distinct_count", "c"), evidence.Signal("last", "max_number", "y")]
    got = {r.key: tuple(r)[1:] for r in evidence.aggregate(rows, "key", "attributes", wanted).collect()}
    assert got == {"a": (True, 3, 2, 2, 2024.0), "b": (True, 1, None, None, None)}
    for bad in (evidence.Signal("x", "median"), evidence.Signal("x", "max_number"), evidence.Signal("x", "max_number", "a.b")):
        with pytest.raises(ValueError):
            evidence.check(bad)


def test_publish_retires_and_clears(spark):
    shape = "source string, key string, value_number int, run_id int"
    old = spark.createDataFrame([("s", "a", 1, 1), ("s", "b", 2, 1), ("s", "hand", 3, None), ("t", "c", 4, 1)], shape)
    new = spark.createDataFrame([("s", "a", 9), ("s", "hand", None), ("s", "d", 0)], "source string, key string, value_number int")
    got = {(r.source, r.key): r.value_number for r in changes.publish(old, new, ["source", "key"], "s", 2).collect()}
    assert got == {("s", "a"): 9, ("t", "c"): 4, ("s", "d"): 0}


def test_conflicts_and_contract(spark):
    rows = spark.createDataFrame([("k", "A", "2024-01-01", 1, "x"), ("k", "B", "2024-01-01", 2, "x"), ("m", "C", "2024-01-01", 3, "x")], "source_key string, name string, observed_at string, source_row_number int, city string")
    evidence.check_rows(rows)
    assert [r[0] for r in evidence.conflicting_keys(rows, ["name", "city"]).collect()] == ["k"]
    with pytest.raises(ValueError, match="observed_at"):
        evidence.check_rows(rows.withColumn("observed_at", F.lit("never")))


def xlsx(path, rows, sheet=workbook.SHEET, formula=False):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = ""
    for n, cells in rows:
        body += f'<row r="{n}">' + "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{c}</t></is></c>' if isinstance(c, str) else f'<c r="{chr(65 + k)}{n}">{"<f>1+1</f>" * formula}<v>{c}</v></c>' for k, c in enumerate(cells) if c is not None) + "</row>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    path.write_bytes(out.getvalue())
    return str(path)


def test_workbooks_as_a_format(spark, tmp_path):
    """One partition a file, an option chooses files, the same rows as the other reader."""
    rows = [(1, workbook.HEADERS), (2, ("Ottawa", "Acme", "ON", "ON", "K1A 0B1", 2024)), (4, ("Laval", "Beta", "QC", "QC", None, 2024))]
    for name in "abc":
        xlsx(tmp_path / f"{name}.xlsx", rows[: 2 + (name == "b")])
    (tmp_path / "other.txt").write_text("no workbook")
    workbook.register(spark)
    read = spark.read.format("importer_workbook").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 3 and read.count() == 4
    one = spark.read.format("importer_workbook").option("only", "b.xlsx").load(str(tmp_path))
    assert read.filter(F.col("path") == f"{tmp_path}/b.xlsx").count() == 2
    assert one.rdd.getNumPartitions() == 1 and [r.row_number for r in one.orderBy("row_number").collect()] == [2, 4]
    plain = workbook.read_workbook(spark, f"{tmp_path}/*.xlsx")
    assert sorted(map(repr, read.drop("path").collect())) == sorted(map(repr, plain.collect()))
    xlsx(tmp_path / "d.xlsx", rows, formula=True)
    with pytest.raises(Exception, match="formula"):
        spark.read.format("importer_workbook").load(str(tmp_path)).count()


def test_workbook(spark, tmp_path):
    rows = [(1, workbook.HEADERS), (2, ("Montréal", "Société A Inc.", "Quebec", "Québec", "H1A 1A1", 2024)), (3, (None,) * 6), (4, ("Montreal", "SOCIETE A LTD", "Quebec", None, "H1A1A1", "2024")), (5, ("Laval", "Société A Inc.", "Quebec", None, None, 2024))]
    got = workbook.IMPORTERS.read(spark, xlsx(tmp_path / "a.xlsx", rows)).orderBy("source_row_number").collect()
    assert [r.source_row_number for r in got] == [2, 4, 5]
    assert got[0].source_key == got[1].source_key != got[2].source_key
    for bad in (xlsx(tmp_path / "b.xlsx", rows, "Other"), xlsx(tmp_path / "c.xlsx", [rows[0], (2, ("x", "y", "z", None, None, 2023))]), xlsx(tmp_path / "d.xlsx", rows, formula=True)):
        with pytest.raises(Exception, match="sheet|row"):
            workbook.read_workbook(spark, bad).collect()


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.read("t") is None
    store.commit({"t": spark.range(3)}, {"x": 1})
    store.commit({"t": spark.range(5)})
    assert store.read("t").count() == 5 and store.manifest()["version"] == 2 and store.manifest()["state"] == {"x": 1}
    with store.lock(), pytest.raises(Busy):
        with Store(spark, f"file://{tmp_path}/store").lock():
            pass
    with store.lock():
        pass
    assert config_hash({"b": 1, "a": [1, 2]}) == config_hash({"a": [1, 2], "b": 1})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.csv").write_text("k,v\na,1\nb,2\na,9\n")
    (tmp_path / "in/2.csv").write_text("k,v\nb,3\nc,4\n")
    os.utime(tmp_path / "in/1.csv", (1, 1))
    live = Store(spark, f"file://{tmp_path}/live")
    registry_stream.follow(spark, str(tmp_path / "in"), "k string, v string", live, "k", "v", str(tmp_path / "cp")).awaitTermination()
    assert {r.k: r.v for r in registry_stream.current(live, "k").collect()} == {"a": "1", "b": "3", "c": "4"} and live.read("accounts").count() == 4


def test_search_words(spark):
    rows = accounts(spark, ("O'Brien & Sons", None, None, "ON", None, None), ("Café L’Oréal", None, None, "QC", None, None), ("AT&T", "ŒUVRE n°5", None, "ON", None, None))
    tokens = search.index(rows)
    for asked, want in (("O'Brien", {1}), ("brien", {1}), ("L'Oréal", {2}), ("loreal", set()), ("at&t", {3}), ("AT", {3}), ("oréal café", {2}), ("sons brie", {1}), ("œuv", {3})):
        for own in (tokens, None):
            assert {r.id for r in search.filtered(rows, asked, tokens=own).collect()} == want, asked


def test_locks_and_layers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit({"t": spark.range(2).select("id")})
    store.commit({}, {}, {"t": spark.range(1).selectExpr("id + 5 as id", "'new' as note")})
    assert sorted((r.id, r.note) for r in store.read("t").collect()) == [(0, None), (1, None), (5, "new")]
    (tmp_path / "store/run.lock").write_text("held")
    os.utime(tmp_path / "store/run.lock", (1, 1))
    with store.lock(), pytest.raises(Busy), store.lock():
        pass


def test_times_and_attributes(spark):
    rows = spark.createDataFrame([("2024-01-01T00:30:00+02:00",), ("2024-01-01",), (None,)], "t string")
    assert [r[0] for r in rows.select(evidence.in_utc("t")).collect()] == ["2023-12-31T22:30:00.000Z", "2024-01-01T00:00:00.000Z", None]
    base = spark.createDataFrame([("k", "A", "2024-01-01", 1, '{"a": 1, "b": "x", "c": null, "d": -2.5e3}')], "source_key string, name string, observed_at string, source_row_number int, attributes string")
    evidence.check_rows(base)
    for bad in ('{"a": [1]}', '{"a": {"b": 1}}', '{"a": true}', "[1]", "no"):
        with pytest.raises(ValueError, match="attributes"):
            evidence.check_rows(base.withColumn("attributes", F.lit(bad)))


def test_quotes_of_each_file(spark, tmp_path):
    (tmp_path / "two").mkdir()
    for k in (1, 2):
        write(tmp_path / "two", line(str(k)) + '\n"open', name=f"{k}.csv")
    with pytest.raises(registry_csv.SourceError):
        registry_csv.read(spark, str(tmp_path / "two"))


def test_range_hash(spark):
    import hashlib

    keys = [1, 5, 4096, 4097, 9000, 1 << 30]
    got = verify.range_hash(spark.createDataFrame([(k,) for k in keys * 3 + [None]], "k long"), "k").first()[0]

    def fold(pairs):
        return hashlib.sha256("".join(t + "\n" for _, t in sorted(pairs)).encode()).hexdigest()

    level = [(k, str(k)) for k in keys]
    for _ in range(2):
        level = [(r, fold([(k, t) for k, t in level if k // 4096 == r])) for r in {k // 4096 for k, _ in level}]
    assert got == fold(level)


def test_percentiles_and_checksum(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(100)], "id int, score int")
    order = sorted((i % 7 for i in range(100)), reverse=True)
    got = {r.fraction: r.score for r in verify.percentiles(rows, [0.5, 0.9, 1.0]).collect()}
    assert got == {f: order[int(99 * (1 - f))] for f in (0.5, 0.9, 1.0)}
    assert verify.checksum(rows).first() == verify.checksum(rows.orderBy(F.rand(1)).repartition(7)).first()
