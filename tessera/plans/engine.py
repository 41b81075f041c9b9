"""The registry engine: imports, evidence runs, scores and reads over one snapshot store."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions import identity, likelihood, matching
from tessera.functions.text import normalise_text
from tessera.operators import changes, evidence, hash_tree, intake, resolution, search, verify
from tessera.operators.ranks import Ranks
from tessera.operators.store import STAGES, Store, check_counters, config_hash, written
from tessera.operators.watch import Cancelled, watched
from tessera.sources import registry_csv
from tessera.sources.workbook import Adapter

IMPORTS = "id long, file string, file_name string, file_size long, file_modified string, file_sha256 string, status string, processed long, inserted long, updated long, skipped long, invalid long, duplicates long, error string, finished_at string"
RUNS = "run_id long, source string, version string, config_hash string, status string, stage string, processed long, created long, updated long, failed long, error string, report string, started_at string, finished_at string, file_name string, file_sha256 string"
DECISIONS = "source_key string, id long, run_id long, status string, seq long"
COMPANY = ("name", "domain", "industry", "description", "employee_count", "employee_range", "revenue_range", "hq_city", "hq_region", "hq_country", "location_count", "subsidiary_count", "parent_company", "headcount_growth_12m", "latest_funding_date", "latest_funding_amount", "raw_json", "enriched_at")
NUMBERS = ("employee_count", "location_count", "subsidiary_count", "latest_funding_amount")
COMPANIES = "id long, provider string, provider_company_id string, " + ", ".join(f"{c} {'double' if c in (*NUMBERS, 'headcount_growth_12m') else 'string'}" for c in COMPANY) + ", normalized_name string, created_at string, updated_at string"
LINKS = "id long, corporation_id long, company_id long, match_method string, name_similarity double, location_match string, provider_confidence double, match_confidence double, match_status string, run_id long, created_at string, updated_at string, exact_name_match boolean, city_match boolean, province_match boolean, alternate_name_match boolean, evidence_json string"
#: What rows have in columns that came after they were written.
DEFAULTS = {"links": {"match_status": "candidate", "evidence_json": "{}"}, "evidence": {"metadata": "{}"}}
STATUSES = ("accepted", "candidate", "ambiguous", "rejected")
EVIDENCE = "source string, source_key string, signal_type string, corporation_id long, company_id long, value_text string, value_number double, value_boolean boolean, match_confidence double, observed_at string, run_id long, id long, created_at string, updated_at string, metadata string"
EVIDENCE_KEY = ["source", "source_key", "signal_type", "corporation_id", "company_id"]
SCORED = "id long, score int, label string, summary string, version string, source_updated_at string"
TOKENS, ENDED = "id long, token string, layer long", "id long, layer long"


class Engine:
    """All writes hold the store's lock and become visible in one commit; a failed run changes its audit row only.

    Runs tell `progress` about their steps: dicts with type (progress, complete or error) and what the step knows, and
    while a step's jobs run how many of their tasks are done. A run ends if `cancelled` says so, between two steps or by
    ending the jobs of one; both are then called by another thread.
    """

    def __init__(self, spark: SparkSession, folder: str, progress: Callable[[dict], None] = lambda event: None, cancelled: Callable[[], bool] = lambda: False):
        self.spark, self.store, self.progress, self.cancelled = spark, Store(spark, folder), progress, cancelled

    def _step(self, stage: str, **known) -> None:
        if self.cancelled():
            raise Cancelled(f"ended before {stage}")
        self.progress({"type": "progress", "stage": stage, **known})

    def _watched(self, stage: str):
        return watched(self.spark, stage, self.progress, self.cancelled)

    def _table(self, name: str, schema: str | None = None) -> DataFrame:
        found = self.store.read(name)
        if found is None:
            if schema is None:
                raise LookupError(f"there is no table {name} yet")
            found = self.spark.createDataFrame([], schema)
        elif schema is not None:  # columns that came later have their default in older rows, or null
            known = self.spark.createDataFrame([], schema).schema
            value = lambda f: F.coalesce(F.col(f.name) if f.name in found.columns else F.lit(None), F.lit(DEFAULTS.get(name, {}).get(f.name))).cast(f.dataType).alias(f.name)
            found = found.select(*map(value, known))
        return found

    def _next(self, name: str, schema: str, key: str) -> int:
        return self._table(name, schema).agg(F.coalesce(F.max(key), F.lit(0)) + 1).first()[0]

    def _audited(self, name: str, schema: str, **values) -> dict[str, DataFrame]:
        """The audit table with this row in the place of the one of its key."""
        columns = [c.split()[0] for c in schema.split(", ")]
        others = self._table(name, schema).filter(F.col(columns[0]) != values[columns[0]])
        return {name: others.unionByName(self.spark.createDataFrame([tuple(values.get(c) for c in columns)], schema))}

    def _failed(self, name: str, schema: str, error: Exception, **values) -> None:
        self.store.commit(self._audited(name, schema, status="failed", error=str(error)[:500], **values))
        self.progress({"type": "error", "error": str(error)[:500]})

    # ---- registry

    def import_registry(self, path: str, now: str, allowed: Iterable[str] | None = None) -> dict:
        """Import a registry file; with `allowed`, SHA-256 digests, as an upload whose name, size and content are checked first."""
        file = intake.identify(self.spark, path)
        if allowed is not None:
            intake.check_upload(file, allowed)
        with self.store.lock():
            run = self._next("imports", IMPORTS, "id")
            audit = dict(id=run, file=path, file_name=file.name, file_size=file.size, file_modified=file.modified, file_sha256=file.sha256)
            self.store.commit(self._audited("imports", IMPORTS, status="running", **audit))
            try:
                self._step("reading", file=file.name)
                with self._watched("reading"):
                    snapshot, report = registry_csv.import_file(self.spark, path, self.store.read("accounts"), now)
                counters = check_counters({k: v for k, v in report.items() if k != "issues"})
                self._step("writing", **counters)
                with self._watched("writing"):
                    snapshot = written(snapshot, "snapshot")
                    derived, layers = self._derived(snapshot)
                intake.check_unchanged(self.spark, path, file)
                self.store.commit({"accounts": snapshot, **derived, **self._audited("imports", IMPORTS, status="completed", finished_at=now, **audit, **counters)}, None, layers)
            except Exception as e:
                self._failed("imports", IMPORTS, e, finished_at=now, **audit)
                raise
            self.progress({"type": "complete", "id": run, **counters})
            return report | {"id": run}

    def _derived(self, accounts: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """(tables to replace, rows to add): profiles, of which those of unchanged rows under the same rules are kept, and
        the search index, to which changed rows add a layer until layers are worth writing anew."""
        had, tokens = self.store.read("profiles"), self.store.read("tokens")
        layer = self.store.manifest()["version"] + 1
        stamped = lambda rows: identity.profiles(rows).withColumns({"rules_version": F.lit(identity.RULES_VERSION), "source_updated_at": F.col("updated_at")})
        anew = {"tokens": search.base_layer(accounts, layer), "tokens_ended": self.spark.createDataFrame([], ENDED)}
        if had is None or "rules_version" not in had.columns:
            return {"profiles": stamped(accounts), **anew}, {}
        old = written(changes.stale(accounts, had.select("id", F.col("rules_version").alias("version"), "source_updated_at"), "id", identity.RULES_VERSION), "changed")
        gone = had.join(old.select("id"), "id", "left_anti").join(accounts.select("id"), "id", "left_semi")
        profiles = {"profiles": gone.unionByName(stamped(old))}
        ended = self._table("tokens_ended", ENDED)
        if tokens is None or "layer" not in tokens.columns or search.wants_compaction(tokens, ended):
            return profiles | anew, {}
        if not old.limit(1).count():
            return profiles, {}
        more, dead = search.layer_of(old, had, None, layer)
        return profiles, {"tokens": more, "tokens_ended": dead}

    def _tokens(self) -> DataFrame:
        """The search index: its layers, without rows that later ones put an end to."""
        return search.live(self._table("tokens", TOKENS), self._table("tokens_ended", ENDED))

    def imports(self) -> list[Row]:
        """The audit rows of registry imports, the latest first."""
        return self._table("imports", IMPORTS).orderBy(F.desc("id")).collect()

    def summary(self) -> dict:
        latest = self._table("imports", IMPORTS).orderBy(F.desc("id")).limit(1).collect()
        accounts = self.store.read("accounts")
        return {"total": 0 if accounts is None else accounts.count(), "latest_import": latest[0].asDict() if latest else None}

    def get(self, source_id: str) -> Row | None:
        return self._table("accounts").filter(F.col("source_id") == source_id).limit(1).first()

    def profiles(self) -> DataFrame:
        return self._table("profiles")

    def profile_summary(self) -> dict:
        return identity.flag_sums(self.profiles(), self._table("accounts").count()).first().asDict()

    def candidates(self, after: int = 0, limit: int = 1000) -> DataFrame:
        return search.keyset(self.profiles().filter("is_candidate"), "id", after, limit)

    def search(self, query: str | None = None, province: str | None = None, page: float | None = 1, ranked: bool = False) -> dict:
        """A page of accounts in the order of the source; with `ranked`, of those that have a score of this version and of
        the row as it is now, by score. Without a query or province a ranked page is read from the ranks."""
        asked, ranks = bool((query or "").strip()), self._ranks() if ranked else None
        if ranks is not None and not asked and not (province or "").strip():
            total = ranks.total()
            number = search.page_number(page, total)
            shown = ranks.page((number - 1) * search.PAGE, search.PAGE).select("id", "score", "label", "summary", "place")
            rows = self._table("accounts").drop("raw_data").join(F.broadcast(shown), "id").orderBy("place").drop("place")  # a page's rows
            return {"rows": rows.collect(), "page": number, "total": total, "pages": -(-total // search.PAGE)}
        accounts, order = self._table("accounts"), ["id"]
        if ranked:
            scores = self._table("scores", SCORED).filter(F.col("version") == likelihood.SCORE_VERSION).select("id", "score", "label", "summary", F.col("source_updated_at").alias("_at"))
            accounts, order = accounts.join(scores, "id").filter(F.col("updated_at").eqNullSafe(F.col("_at"))).drop("_at"), [F.desc("score"), "id"]
        hits = search.filtered(accounts, query, province, tokens=self._tokens()).drop("raw_data")
        hits = written(hits, "hits") if asked else hits
        rows, number, total = search.page_of(hits, page, order)
        return {"rows": rows.collect(), "page": number, "total": total, "pages": -(-total // search.PAGE)}

    def _ranks(self) -> Ranks | None:
        """The order of all scores, if they rest on what the store holds now."""
        state = self.state()
        return Ranks(self.spark, state["ranks"]) if state["ready"] and state["ranks"] else None

    # ---- evidence

    def import_evidence(self, path: str, adapter: Adapter, now: str) -> dict:
        """Stage the source's rows, resolve its identities, publish signals of accepted ones, retire older runs."""
        if not adapter.source.strip() or not adapter.version.strip() or not adapter.signals or len({x.name for x in adapter.signals}) < len(adapter.signals):
            raise ValueError("an adapter has a source, a version and signals of different names")
        file = intake.identify(self.spark, path)
        with self.store.lock():
            run = self._next("runs", RUNS, "run_id")
            settings = config_hash({"sha256": file.sha256, "source": adapter.source, "version": adapter.version, "rules": identity.RULES_VERSION, "signals": [list(x) for x in adapter.signals]})
            audit = dict(run_id=run, source=adapter.source, version=adapter.version, config_hash=settings, started_at=now, file_name=file.name, file_sha256=file.sha256)

            def at(stage: str, status: str = "running", tables=(), more=None, **values) -> None:
                self._step(stage, run_id=run)
                self.store.commit({**dict(tables), **self._audited("runs", RUNS, stage=stage, status=status, **audit, **values)}, None, more)

            try:
                at(STAGES[0])
                rows = written(adapter.read(self.spark, path), "rows")
                with self._watched("matching"):
                    tables, history, report = self._evidence(rows, adapter, run, at, now, {"filename": file.name, "file_sha256": file.sha256, "adapter_version": adapter.version})
                intake.check_unchanged(self.spark, path, file)
                counters = dict(processed=report["rows"], created=report["identities"], updated=0, failed=0)
                if counters["created"] > counters["processed"]:
                    raise ValueError("a run can't create more than it processed")
                at(STAGES[3], "completed", tables, history, finished_at=now, report=json.dumps(report), **counters)
            except Exception as e:
                self._failed("runs", RUNS, e, stage=STAGES[4], finished_at=now, processed=0, created=0, updated=0, failed=0, **audit)
                raise
            self.progress({"type": "complete", "run_id": run, **report})
            return report | {"run_id": run}

    def workflows(self) -> list[Row]:
        """The runs of evidence sources with the stage that each is in, the latest first."""
        return self._table("runs", RUNS).orderBy(F.desc("run_id")).collect()

    def _evidence(self, rows: DataFrame, adapter: Adapter, run: int, at, now: str, origin: dict) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict]:
        """(tables to replace, rows to add to the history, report)."""
        evidence.check_rows(rows)
        rows = rows.withColumn("observed_at", evidence.in_utc("observed_at"))
        own = matching.source_identity("name", "city", "province", "country", "postal")
        staged = rows.withColumns(own)
        if evidence.conflicting_keys(staged, list(own)).limit(1).count():
            raise ValueError("one key of the source stands for different identities")
        sources = staged.groupBy(F.col("source_key").alias("key")).agg(*(F.first(c).alias(c) for c in own))
        if not sources.limit(1).count():
            raise ValueError("the source has no rows")
        at(STAGES[1])
        p = self.profiles()
        registry = p.select("id", "is_candidate", F.col("normalized_legal_name").alias("r_legal"), F.col("normalized_alternate_name").alias("r_alternate"), normalise_text("city").alias("r_city"), identity.region("province_normalized").alias("r_province"), identity.country("country").alias("r_country"), F.col("postal_code_normalized").alias("r_postal"))
        at(STAGES[2])
        outcomes, judged = resolution.resolve(sources, written(registry, "registry"))
        judged = written(judged, "judged")
        accepted = judged.filter("status = 'accepted'").select(F.col("key").alias("source_key"), F.col("id").cast("long").alias("corporation_id"), "match_confidence", F.struct("strength", "match_method", "name_similarity", "location_match", "postal_match").alias("matching"))
        sums = evidence.aggregate(staged, "source_key", "attributes", list(adapter.signals)).join(staged.groupBy("source_key").agg(F.max("observed_at").alias("observed_at"), F.count(F.lit(1)).alias("source_row_count")), "source_key")
        kinds = dict(sums.dtypes)

        def value(name: str, kind: str):
            fits = {"boolean": kinds[name] == "boolean", "double": kinds[name] in ("bigint", "double"), "string": kinds[name] == "string"}[kind]
            return (F.col(name) if fits else F.lit(None)).cast(kind)

        def about(signal):
            return F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in origin.items()), F.col("source_row_count"), F.struct(F.lit(signal.kind).alias("kind"), F.lit(signal.attribute).alias("attribute")).alias("aggregation"), F.col("matching")))

        listed = F.array(*(F.struct(F.lit(s.name).alias("signal_type"), value(s.name, "string").alias("value_text"), value(s.name, "double").alias("value_number"), value(s.name, "boolean").alias("value_boolean"), about(s).alias("metadata")) for s in adapter.signals))
        observed = accepted.join(sums, "source_key").select(F.lit(adapter.source).alias("source"), "source_key", "corporation_id", F.lit(None).cast("long").alias("company_id"), "match_confidence", "observed_at", F.inline(listed))
        published, told = changes.feed(self._table("evidence", EVIDENCE), observed, EVIDENCE_KEY, adapter.source, run, now, self._next("evidence", EVIDENCE, "id") - 1)
        published, told = written(published, "published"), written(told, "feed")
        done = {r.change: r.n for r in told.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        moved = {"evidence_created": done.get("created", 0), "evidence_updated": done.get("updated", 0) + done.get("same", 0), "evidence_removed": done.get("removed", 0)}
        run_id = F.lit(run).cast("long").alias("run_id")
        history = {
            "source_rows": rows.withColumn("run_id", run_id),
            "matches": judged.select(F.col("key").alias("source_key"), "id", "status", "strength", "match_method", "match_confidence", "name_similarity", "location_match", "postal_match").withColumn("run_id", run_id),
            "outcomes": outcomes.select(F.col("key").alias("source_key"), "outcome", "reason", F.col("accepted_id").cast("long").alias("accepted_id"), run_id),
            "evidence_feed": told.filter("change <> 'same'"),
        }
        counted = rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source_key").alias("identities")).first().asDict()
        found = accepted.agg(F.countDistinct("corporation_id").alias("corporations")).first().asDict()
        return {"evidence": published}, history, counted | found | moved | resolution.outcome_counts(outcomes).first().asDict()

    def outcomes(self, run_id: int) -> DataFrame:
        """(source_key, outcome, reason, accepted_id) of each identity of a run."""
        return self._table("outcomes").filter(F.col("run_id") == run_id).drop("run_id")

    def feed(self, run_id: int) -> DataFrame:
        """The observations that a run created, updated (another value) or removed."""
        return self._table("evidence_feed").filter(F.col("run_id") == run_id)

    def coverage(self, corporation_id: int | None = None, company_id: int | None = None) -> dict:
        """The evidence of an entity, each observation with source rows of its own run: known false counts as evidence,
        none means unknown."""
        if not corporation_id and not company_id:
            raise ValueError("choose a corporation or a company")
        own = self._table("evidence", EVIDENCE).filter(F.col("corporation_id") == corporation_id if corporation_id else F.col("company_id") == company_id)
        rows = self.store.read("source_rows")
        shown = evidence.coverage(own, rows.select("source_key", "run_id", "source_row_number", "raw").distinct()) if rows is not None else own.orderBy("source", "signal_type")
        found = shown.collect()
        return {"has_evidence": bool(found), "sources": list(dict.fromkeys(r.source for r in found)), "observations": found}

    # ---- scores

    def _basis(self, source: str) -> dict:
        """What scores rest on: versions, a hash of the entities with evidence, the last import that changed anything."""
        present = self._table("evidence", EVIDENCE).filter((F.col("source") == source) & F.col("value_boolean"))
        changed = self._table("imports", IMPORTS).filter("status = 'completed' and (inserted > 0 or updated > 0)").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        return {"score_version": likelihood.SCORE_VERSION, "rules_version": identity.RULES_VERSION, "evidence": hash_tree.root(present.select("corporation_id").distinct(), "corporation_id"), "import": changed, "source": source}

    def prepare_scores(self, source: str, now: str) -> dict:
        """Score all candidates anew; rows that come out the same keep the time of their last change."""
        with self.store.lock():
            present = self._table("evidence", EVIDENCE).filter((F.col("source") == source) & F.col("value_boolean")).select(F.col("corporation_id").alias("id")).distinct().withColumn("has_importer_evidence", F.lit(True))
            rows = self.profiles().filter("is_candidate").join(present, "id", "left").withColumn("has_importer_evidence", F.coalesce("has_importer_evidence", F.lit(False)))
            scored = likelihood.score(rows)
            fresh = scored.select("id", "score", "raw", "label", "summary", "name_used", "signals", "has_importer_evidence", F.lit(likelihood.SCORE_VERSION).alias("version"), "source_updated_at")
            stored = self.store.read("scores")
            if stored is None or "version" not in stored.columns:
                stored = self.spark.createDataFrame([], fresh.withColumn("scored_at", F.lit("")).schema)
            compared = ["score", "raw", "label", "summary", "name_used", "signals", "has_importer_evidence"]
            judged = written(changes.refreshed(stored, fresh, "id", compared, "scored_at", F.lit(now)), "scores")
            report = judged.agg(F.count(F.lit(1)).alias("scored"), F.count_if("changed").alias("changed")).first().asDict()
            report["removed"] = stored.join(judged, "id", "left_anti").count()
            ranks = f"{self.store.folder}/ranks/{uuid.uuid4().hex}"
            Ranks.build(judged.drop("changed"), "score", "id", ranks)
            self.store.commit({"scores": judged.drop("changed")}, {"scores": self._basis(source), "ranks": ranks})
            return report

    def state(self) -> dict:
        """ready: the scores rest on what the store holds now."""
        state = self.store.manifest()["state"]
        basis = state.get("scores")
        return {"ready": basis is not None and basis == self._basis(basis["source"]), "basis": basis, "ranks": state.get("ranks")}

    def ranked(self, after_score: int = 101, after_id: int = 0, limit: int = 1000) -> list[Row]:
        """The next candidates by score; none while the scores are stale."""
        search.check_ranked(after_score, after_id, limit)
        ranks = self._ranks()
        return [] if ranks is None else ranks.after(after_score, after_id, limit).collect()

    def score(self, corporation_id: int) -> Row | None:
        return self._table("scores").filter(F.col("id") == corporation_id).limit(1).first()

    # ---- decisions and single rows

    def matches(self) -> DataFrame:
        """The history of matches with the latest decision on each."""
        latest = self._table("decisions", DECISIONS).groupBy("source_key", "id", "run_id").agg(F.max_by("status", "seq").alias("_decided"))
        return self._table("matches").join(latest, ["source_key", "id", "run_id"], "left").withColumn("status", F.coalesce("_decided", "status")).drop("_decided")

    def decide(self, source_key: str, corporation_id: int, run_id: int, status: str) -> None:
        """Set the status of one match; raises if there is none. A decision is a row more, the history stays as it is."""
        if status not in STATUSES:
            raise ValueError("no such status")
        with self.store.lock():
            rows = self._table("matches")
            mine = reduce(lambda a, b: a & b, (F.col(c) == v for c, v in (("source_key", source_key), ("id", corporation_id), ("run_id", run_id))))
            if not rows.filter(mine).limit(1).count():
                raise LookupError("there is no such match")
            seq = self._next("decisions", DECISIONS, "seq")
            self.store.commit({}, None, {"decisions": self.spark.createDataFrame([(source_key, corporation_id, run_id, status, seq)], DECISIONS)})

    def upsert_companies(self, incoming: DataFrame, now: str) -> DataFrame:
        """Companies after partial rows (provider, provider_company_id, columns of COMPANY, provided: the fields that
        change; a null clears). Ids stay; new ones follow the largest."""
        key = ["provider", "provider_company_id"]
        rows = intake.check(incoming, {"key": (F.trim("provider") != "") & (F.trim("provider_company_id") != ""), **{c: F.col(c).isNull() | (F.col(c) >= 0) for c in NUMBERS if c in incoming.columns}, **({"raw_json": F.col("raw_json").isNull() | F.try_parse_json("raw_json").isNotNull()} if "raw_json" in incoming.columns else {})})
        with self.store.lock():
            stored = self._table("companies", COMPANIES)
            have = [c for c in COMPANY if c in rows.columns]
            named = rows.select(*(F.trim(k).alias(k) for k in key), *have, "provided")
            new = named.join(stored.select(*key), key, "left_anti").select(*key)
            ids = changes.new_ids(new, key, self._next("companies", COMPANIES, "id") - 1).withColumns({"created_at": F.lit(now), "updated_at": F.lit(now)})
            known = changes.upsert(stored, ids, key)
            filled = named.select(*key, *(F.col(c) if c in have else F.lit(None).alias(c) for c in COMPANY), F.array_intersect("provided", F.array(*map(F.lit, COMPANY))).alias("provided"))
            patched = changes.patch(known.drop("id", "normalized_name", "created_at", "updated_at"), filled, key)
            touched = named.select(*key, F.lit(now).alias("_now"))
            rest = known.select(*key, "id", "created_at", "updated_at").join(touched, key, "left").withColumn("updated_at", F.coalesce("_now", "updated_at")).drop("_now")
            out = patched.join(rest, key).withColumn("normalized_name", identity.company_name("name"))
            self.store.commit({"companies": out.select(*(c.split()[0] for c in COMPANIES.split(", ")))})
        return self._table("companies")

    def upsert_links(self, incoming: DataFrame, now: str) -> DataFrame:
        """Links of corporations and companies after computed ones; what a person decided stays."""
        share = {c: intake.between(c, 0, 1) for c in ("name_similarity", "match_confidence", "provider_confidence") if c in incoming.columns}
        json_ = {"evidence_json": F.try_parse_json("evidence_json").isNotNull()} if "evidence_json" in incoming.columns else {}
        rows = intake.check(incoming, {"location_match": intake.one_of("location_match", ("city_province", "province", "none", "conflict")), **share, **json_}, nullable=("provider_confidence", "evidence_json"))
        key = ["corporation_id", "company_id"]
        with self.store.lock():
            stored = self._table("links", LINKS)
            new = changes.new_ids(rows.join(stored.select(*key), key, "left_anti").select(*key), key, self._next("links", LINKS, "id") - 1)
            known = changes.upsert(stored, new.withColumns({"match_status": F.lit("candidate"), "created_at": F.lit(now)}), key)
            out = changes.upsert(known, rows.select(*(c for c in rows.columns if c not in ("id", "match_status", "created_at"))).withColumn("updated_at", F.lit(now)), key)
            self.store.commit({"links": out})
        return self._table("links")

    def decide_link(self, link_id: int, status: str, now: str) -> None:
        """Set the status of a link of a corporation and a company; raises if there is none. Computed links leave it."""
        if status not in STATUSES:
            raise ValueError("no such status")
        with self.store.lock():
            links, mine = self._table("links", LINKS), F.col("id") == link_id
            if not links.filter(mine).limit(1).count():
                raise LookupError("there is no such link")
            put = {"match_status": F.when(mine, F.lit(status)).otherwise(F.col("match_status")), "updated_at": F.when(mine, F.lit(now)).otherwise(F.col("updated_at"))}
            self.store.commit({"links": links.withColumns(put)})

    def observe(self, source: str, source_key: str, signal: str, corporation_id: int | None, value, observed_at: str | None = None, match_confidence: float | None = None, company_id: int | None = None, metadata: dict | None = None, now: str | None = None) -> dict:
        """Set one observation of a corporation, a company or both by hand, or clear it with None; it belongs to no run,
        and runs leave it. Returns its id, and whether it was created or removed. Unknown targets are refused."""
        if not (source.strip() and source_key.strip() and signal.strip()) or not (corporation_id or company_id):
            raise ValueError("an observation has a source, an identity, a signal and a corporation or company")
        if isinstance(value, float) and value - value != 0:
            raise ValueError("numbers of observations are finite")
        for table, schema, wanted in (("accounts", "id long", corporation_id), ("companies", COMPANIES, company_id)):
            if wanted and not self._table(table, schema).filter(F.col("id") == wanted).limit(1).count():
                raise LookupError(f"there is no row {wanted} in {table}")
        kind = "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text"
        row = dict(source=source, source_key=source_key, signal_type=signal, corporation_id=corporation_id, company_id=company_id, match_confidence=match_confidence, observed_at=observed_at, metadata=json.dumps(metadata or {}, allow_nan=False))
        if value is not None:
            row[f"value_{kind}"] = float(value) if kind == "number" else value
        columns = [c.split()[0] for c in EVIDENCE.split(", ")]
        with self.store.lock():
            stored = self._table("evidence", EVIDENCE)
            mine = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(row[k])) for k in EVIDENCE_KEY))
            had = stored.filter(mine).select("id", "created_at").first()
            if value is None and had is None:
                return {"id": None, "created": False, "removed": False}
            table = stored.filter(~mine)
            if value is not None:
                row |= dict(id=had.id if had else self._next("evidence", EVIDENCE, "id"), created_at=had.created_at if had else now, updated_at=now)
                table = table.unionByName(self.spark.createDataFrame([tuple(row.get(c) for c in columns)], EVIDENCE))
            self.store.commit({"evidence": table})
            return {"id": row.get("id"), "created": had is None, "removed": value is None}

    # ---- verification

    def verify(self) -> dict:
        """What can be told of the store without changing it: counts, checksums, orphans, and how the scores stand."""
        tables = {n: self.store.read(n) for n in self.store.manifest()["tables"]}
        accounts = tables["accounts"]
        report = {"tables": {r.name: r.n for r in verify.table_counts(tables).collect()}, "accounts": verify.checksum(accounts).first().asDict()}
        report["accounts"]["checksum"] = str(report["accounts"]["checksum"])
        report["walk"] = verify.walk(accounts, "id", "source_id").first().asDict()
        report["profiles"] = self.profile_summary()
        report["samples"] = {flag: [r.id for r in rows] for flag, rows in _grouped(verify.samples(self.profiles(), list(identity.FLAGS)).orderBy("flag", "id").collect(), "flag")}
        if "evidence" in tables:
            report["evidence_orphans"] = verify.orphans(tables["evidence"], accounts, "corporation_id", "id").count()
        if "scores" in tables:
            scores = tables["scores"]
            report["scores"] = {"state": self.state(), "distribution": {str(r.score): r.n for r in verify.histogram(scores).orderBy("score").collect()}, "at_least": {str(r.threshold): r.n for r in verify.thresholds(scores, [50, 55, 60, 65, 66, 67, 68, 69, 70, 75]).collect()}, "percentiles": {str(r.fraction): r.score for r in verify.percentiles(scores, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]).collect()}}
        return report


def _grouped(rows: list[Row], key: str):
    out: dict = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out.items()
