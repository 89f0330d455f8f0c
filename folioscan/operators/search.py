"""Ranked search over blocks and sheet cells of a whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences, tokens_of


def search_corpus(blocks: DataFrame | None, cells: DataFrame | None, query: str, scope: DataFrame | list[str] | None = None, max_results: int = 20, offset: int = 0) -> DataFrame:
    """The best hits by the number of non-overlapping occurrences of the query's tokens. cells need sheet_name. An empty scope list means all documents. Only the top rows of each task meet."""
    parts = []
    if blocks is not None:
        parts.append(blocks.select("document_id", F.lit("text").alias("kind"), "ordinal", F.col("text").alias("value"), F.concat(F.lit("page "), F.col("page_number").cast("string")).alias("citation")))
    if cells is not None:
        where = F.concat(F.lit("sheet '"), "sheet_name", F.lit("', cell "), F.coalesce("source_cell_ref", F.concat(F.lit("R"), "row_index", F.lit("C"), "column_index")))
        parts.append(cells.select("document_id", F.lit("cell").alias("kind"), "ordinal", "value", where.alias("citation")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if isinstance(scope, DataFrame):
        rows = rows.join(scope.select("document_id").distinct(), "document_id", "left_semi")
    elif scope:
        rows = rows.where(F.col("document_id").isin(*scope))
    low = F.lower("value")
    score = sum((occurrences(low, t) for t in tokens_of(query)), F.lit(0).cast("long"))
    hits = rows.withColumn("score", score).where("score > 0")
    top = hits.orderBy(F.desc("score"), "document_id", "kind", "ordinal").offset(offset).limit(max_results)
    return top.select("document_id", "kind", "ordinal", F.substring("value", 1, 200).alias("snippet"), "citation", "score")
