"""python -m tessera COMMAND FOLDER ...: imports, evidence, scores, search and reports over one store, as JSON lines."""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from pyspark.sql import SparkSession

from tessera.plans.engine import Engine
from tessera.sources.workbook import IMPORTERS


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name, more in {"import": ("path",), "evidence": ("path",), "scores": (), "verify": ("output",), "imports": (), "search": ("query",)}.items():
        c = commands.add_parser(name)
        c.add_argument("folder")
        for x in more:
            c.add_argument(x)
    a = p.parse_args(args)
    say = lambda x: print(json.dumps(x, ensure_ascii=False, default=str), flush=True)
    engine = Engine(SparkSession.builder.appName("tessera").getOrCreate(), a.folder, say)
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    if a.command == "import":
        say(engine.import_registry(a.path, now))
    elif a.command == "evidence":
        say(engine.import_evidence(a.path, IMPORTERS, now))
    elif a.command == "scores":
        say(engine.prepare_scores(IMPORTERS.source, now))
    elif a.command == "imports":
        for row in engine.imports():
            say(row.asDict())
    elif a.command == "search":
        found = engine.search(a.query)
        say(found | {"rows": [r.asDict() for r in found["rows"]]})
    else:
        report = engine.verify()
        with open(a.output, "w", encoding="utf-8") as f:
            json.dump(report, f, ensure_ascii=False, indent=2, default=str)
        say(report)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
