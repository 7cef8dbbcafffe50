"""Command line: run, explain, validate, schema.

    python -m sluice.cli run -d FOLDER -o csv 'events | count'
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from sluice.engine import Engine
from sluice.lang.diagnostics import QueryError
from sluice.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluice")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("run", "explain", "validate", "schema"):
        c = commands.add_parser(name)
        c.add_argument("query", help="the query, or @file")
        c.add_argument("-d", "--data", action="append", default=[], help="a file, or a folder whose files become tables")
        c.add_argument("-o", "--output", default="table", choices=["table", "csv", "json"])
        c.add_argument("--compat", default="language", choices=["language", "sql"])
        c.add_argument("-p", "--param", action="append", default=[], help="name=value of a query parameter")
        c.add_argument("--save", help="write the result there as Parquet instead of printing it")
    return p


def load(engine: Engine, places: list[str]) -> None:
    for place in places:
        path = Path(place)
        files = sorted(path.iterdir()) if path.is_dir() and path.suffix != ".parquet" else [path]
        for f in files:
            if f.suffix.lower() in (".csv", ".tsv", ".json", ".jsonl", ".ndjson", ".parquet", ".orc"):
                engine.load_file(str(f), f.stem)


def value(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sluice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, compat=args.compat)
    text = Path(args.query[1:]).read_text() if args.query.startswith("@") else args.query
    try:
        load(engine, args.data)
        if args.command == "validate":
            found = engine.validate(text)
            print("\n".join(map(str, found)) or "ok", file=out)
            return int(any(d.severity == "error" for d in found))
        if args.command == "explain":
            e = engine.explain(text)
            print(f"{e.tree}\n\n{e.plan}", file=out)
            return 0
        params = dict(p.split("=", 1) for p in args.param)
        df = engine.query(text, {k: value(v) for k, v in params.items()})
        if args.command == "schema":
            print("\n".join(f"{n}: {t}" for n, t in sinks.schema_of(df)), file=out)
        elif args.save:
            sinks.write(df, args.save)
        else:
            print(sinks.render(df, args.output), end="", file=out)
        return 0
    except QueryError as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
