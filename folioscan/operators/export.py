"""Extractions as JSON, Markdown or CSV, one string each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

FORMATS = ("json", "markdown", "csv")


def _shown():
    return F.coalesce(F.array_join("value_list", "|"), "value_str", F.lit(""))


def _quoted(c):
    return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def markdown(fields: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- **"), "field_path", F.lit("**: "), _shown(), F.lit(" (confidence: "), F.format_string("%.2f", "confidence"), F.lit(", "), F.coalesce("citation", F.lit("no citation")), F.lit(")"))
    lines = graph.in_order(fields, ["document_id", "schema_id"], ["ordinal"], line, "lines")
    return lines.select("document_id", F.concat(F.lit("# Extraction: "), "schema_id", F.lit("\n\n"), F.array_join("lines", "\n")).alias("content"))


def csv(fields: DataFrame) -> DataFrame:
    line = F.concat_ws(",", "field_path", _quoted(_shown()), F.format_string("%.2f", "confidence"), _quoted(F.coalesce("citation", F.lit(""))))
    lines = graph.in_order(fields, ["document_id"], ["ordinal"], line, "lines")
    return lines.select("document_id", F.concat(F.lit("field,value,confidence,citation\n"), F.array_join("lines", "\n")).alias("content"))


def json(fields: DataFrame) -> DataFrame:
    item = F.struct("field_path", "value_kind", "value_str", "value_num", "value_list", "confidence", "citation")
    lists = graph.in_order(fields, ["document_id", "schema_id"], ["ordinal"], item, "fields")
    return lists.select("document_id", F.to_json(F.struct("document_id", "schema_id", "fields")).alias("content"))


def export(fields: DataFrame, fmt: str) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}")
    return {"json": json, "markdown": markdown, "csv": csv}[fmt](fields)
