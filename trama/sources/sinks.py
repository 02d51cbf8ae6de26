"""Exports: edge and correlation tables, graph documents, reports."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, *order) -> None:
    """One CSV file with a header, in order; for tables of report size."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_registry_csv(df: DataFrame, path: str) -> None:
    """In the layout of registry files: semicolons, all quoted, Latin-1, no header."""
    df.write.mode("overwrite").csv(path, sep=";", quoteAll=True, encoding="ISO-8859-1", header=False)


def graph_json(entities: DataFrame, edges: DataFrame, most: int = 100_000) -> str:
    """The graph as one document, for graphs of report size; a larger one is an error, not a cut."""
    for name, df in (("entities", entities), ("edges", edges)):
        if df.limit(most + 1).count() > most:
            raise ValueError(f"too many {name} for one document; write tables instead")
    return json.dumps({"entidades": [json.loads(r) for r in entities.toJSON().collect()], "arestas": [json.loads(r) for r in edges.toJSON().collect()]}, ensure_ascii=False)


def report_markdown(title: str, sections: list[tuple[str, DataFrame, int]]) -> str:
    """A report of tables: (heading, frame in its order, rows shown). The rows shown are a limit of the report."""
    out = [f"# {title}"]
    for heading, df, n in sections:
        out += ["", f"## {heading}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in df.limit(n).collect()]
    return "\n".join(out) + "\n"


def report_html(title: str, sections: list[tuple[str, DataFrame, int]]) -> str:
    e = lambda v: html.escape("" if v is None else str(v))
    out = [f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><h1>{e(title)}</h1>"]
    for heading, df, n in sections:
        out.append(f"<h2>{e(heading)}</h2><table><tr>" + "".join(f"<th>{e(c)}" for c in df.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{e(v)}" for v in r) + "</tr>" for r in df.limit(n).collect()]
        out.append("</table>")
    return "".join(out)


def write_snapshot(df: DataFrame, path: str, run_id: str) -> None:
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
