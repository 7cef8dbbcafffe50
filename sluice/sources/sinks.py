"""Writers: results as text for a terminal, and tables for files."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame

from sluice.lang.diagnostics import PARAMETER, QueryError
from sluice.plans.types import language_type

#: Column types of DDL texts by dialect.
DDL_TYPES = {
    "spark": {"bool": "BOOLEAN", "int": "INT", "long": "BIGINT", "real": "DOUBLE", "decimal": "DECIMAL(38,18)", "string": "STRING", "datetime": "TIMESTAMP_NTZ", "timespan": "INTERVAL DAY TO SECOND", "guid": "STRING", "dynamic": "VARIANT"},
    "ansi": {"bool": "BOOLEAN", "int": "INTEGER", "long": "BIGINT", "real": "DOUBLE PRECISION", "decimal": "NUMERIC", "string": "TEXT", "datetime": "TIMESTAMP", "timespan": "INTERVAL", "guid": "TEXT", "dynamic": "TEXT"},
}


def ddl(table: str, columns: list[tuple[str, str]], dialect: str = "spark") -> str:
    quote = "`" if dialect == "spark" else '"'
    body = ", ".join(f"{quote}{n}{quote} {DDL_TYPES[dialect][t]}" for n, t in columns)
    return f"CREATE TABLE {quote}{table}{quote} ({body})"


def _cell(v) -> object:
    return v if v is None or isinstance(v, bool | int | float | str) else v.isoformat(" ") if hasattr(v, "isoformat") else json.loads(v.toJson()) if hasattr(v, "toJson") else v.asDict(True) if hasattr(v, "asDict") else [_cell(x) for x in v] if isinstance(v, list) else str(v)


def to_csv(df: DataFrame) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    for row in df.toLocalIterator():
        w.writerow(["" if (c := _cell(v)) is None else json.dumps(c) if isinstance(c, list | dict) else c for v in row])
    return out.getvalue()


def to_json(df: DataFrame) -> str:
    return json.dumps([{n: _cell(v) for n, v in zip(df.columns, row, strict=True)} for row in df.toLocalIterator()], default=str)


def to_table(df: DataFrame) -> str:
    rows = [["" if (c := _cell(v)) is None else str(c) for v in row] for row in df.toLocalIterator()]
    widths = [max([len(n), *(len(r[k]) for r in rows)]) for k, n in enumerate(df.columns)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in widths]), *map(line, rows)]) + "\n"


def render(df: DataFrame, kind: str) -> str:
    try:
        return {"csv": to_csv, "json": to_json, "table": to_table}[kind](df)
    except KeyError:
        raise QueryError(PARAMETER, f"unknown output {kind!r}") from None


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Files written by the executors."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("json", "jsonl"):
        writer.json(path)
    elif kind in ("parquet", "orc"):
        writer.format(kind).save(path)
    elif kind == "table":
        writer.saveAsTable(path)
    else:
        raise QueryError(PARAMETER, f"unknown format {kind!r}")


def schema_of(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, language_type(f.dataType)) for f in df.schema.fields]
