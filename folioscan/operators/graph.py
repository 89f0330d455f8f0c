"""Accessors over the document model: pages, texts, grids, markdown, short references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..functions.text import strip


def in_order(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Values of each key collected in order: a partial aggregate, then a sort within the group."""
    item = F.struct(*order, value.alias("_v"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_a")).select(*keys, F.transform("_a", lambda x: x["_v"]).alias(name))


def page_texts(blocks: DataFrame) -> DataFrame:
    lines = in_order(blocks, ["document_id", "page_number"], ["reading_order_index", "ordinal"], F.col("text"), "lines")
    return lines.select("document_id", "page_number", F.array_join("lines", "\n").alias("text"))


def document_texts(blocks: DataFrame) -> DataFrame:
    pages = in_order(page_texts(blocks), ["document_id"], ["page_number"], F.col("text"), "pages")
    return pages.select("document_id", F.array_join("pages", "\n\n").alias("text"))


def grids(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, table_id, row_index, row array<string>): dense rows, "" where there is no cell, the last cell where there are two, none out of bounds; tables without cells have no rows."""
    sized = cells.join(tables.select("document_id", "table_id", "row_count", "column_count"), ["document_id", "table_id"])
    kept = sized.where("row_index between 0 and row_count - 1 and column_index between 0 and column_count - 1")
    one = kept.groupBy("document_id", "table_id", "row_index", "column_index").agg(F.max_by("value", "ordinal").alias("value"))
    rows = one.groupBy("document_id", "table_id", "row_index").agg(F.map_from_entries(F.collect_list(F.struct("column_index", "value"))).alias("m"))
    some = cells.select("document_id", "table_id").distinct()
    shape = tables.join(some, ["document_id", "table_id"]).where("row_count > 0").select("document_id", "table_id", "column_count", F.explode(F.sequence(F.lit(0), F.col("row_count") - 1)).alias("row_index"))
    columns = F.when(F.col("column_count") > 0, F.sequence(F.lit(0), F.col("column_count") - 1)).otherwise(F.array().cast("array<int>"))
    full = shape.join(rows, ["document_id", "table_id", "row_index"], "left")
    return full.select("document_id", "table_id", "row_index", F.transform(columns, lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))).alias("row"))


def table_markdown(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, table_id, markdown): row 0 is the header."""
    line = F.concat(F.lit("| "), F.array_join("row", " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("row", lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = grids(cells, tables).select("document_id", "table_id", "row_index", F.when(F.col("row_index") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("line"))
    return in_order(lines, ["document_id", "table_id"], ["row_index"], F.col("line"), "lines").select("document_id", "table_id", F.array_join("lines", "\n").alias("markdown"))


def search_text(blocks: DataFrame, query: str) -> DataFrame:
    return blocks.where(F.contains(F.lower("text"), F.lit(query.lower())))


def search_cells(cells: DataFrame, tables: DataFrame, query: str) -> DataFrame:
    """Cells of sheets whose value holds the query; address is the reference or R{row}C{column}."""
    hits = cells.where(F.contains(F.lower("value"), F.lit(query.lower())))
    found = hits.join(tables.where("sheet_name is not null").select("document_id", "table_id", "sheet_name"), ["document_id", "table_id"])
    return found.withColumn("address", F.coalesce("source_cell_ref", F.concat(F.lit("R"), "row_index", F.lit("C"), "column_index")))


def short_ref(page: Column, sheet: Column, cell: Column, rng: Column, start: Column, end: Column) -> Column:
    parts = F.concat_ws(
        ", ", F.when(page.isNotNull(), F.concat(F.lit("page "), page.cast("string"))), F.when(sheet.isNotNull(), F.concat(F.lit("sheet '"), sheet, F.lit("'"))),
        F.when(cell.isNotNull(), F.concat(F.lit("cell "), cell)), F.when(rng.isNotNull(), F.concat(F.lit("range "), rng)),
        F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("bytes "), start.cast("string"), F.lit("-"), end.cast("string"))),
    )
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("unknown location"))


def document_markdown(documents: DataFrame, blocks: DataFrame, sections: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(document_id, markdown): title, pages in order with their tables, then sheets."""
    turn = Window.partitionBy("document_id", "title").orderBy("ordinal")
    levels = sections.withColumn("_k", F.row_number().over(turn)).where("_k = 1").select("document_id", "title", "heading_level")
    kept = blocks.where(~F.col("block_type").isin(*schema.FURNITURE)).withColumn("title", strip(F.col("text")))
    kept = kept.join(levels, ["document_id", "title"], "left")
    kind = F.col("block_type")
    line = (
        F.when(kind == "heading", F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.coalesce("heading_level", F.lit(2)) + 1), F.lit(" "), "text", F.lit("\n")))
        .when(kind == "list_item", F.concat(F.lit("- "), "text"))
        .when(kind == "footnote", F.concat(F.lit("\n> *"), "text", F.lit("*\n")))
        .otherwise(F.col("text"))
    )
    title = documents.select("document_id", F.lit(-1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"), F.concat(F.lit("# "), "filename", F.lit("\n")).alias("line"))
    body = kept.select("document_id", F.col("page_number").alias("a"), F.lit(0).alias("b"), F.col("reading_order_index").alias("c"), F.col("ordinal").alias("d"), line.alias("line"))
    md = table_markdown(cells, tables).join(tables.select("document_id", "table_id", "ordinal", "page_number", "sheet_name"), ["document_id", "table_id"])
    paged = md.where("page_number is not null").select("document_id", F.col("page_number").alias("a"), F.lit(1).alias("b"), F.lit(0).alias("c"), F.col("ordinal").alias("d"), F.concat(F.lit("\n"), "markdown", F.lit("\n")).alias("line"))
    sheet = md.where("page_number is null").select("document_id", F.lit(1 << 30).alias("a"), F.lit(2).alias("b"), F.lit(0).alias("c"), F.col("ordinal").alias("d"), F.concat(F.lit("\n## Sheet: "), "sheet_name", F.lit("\n\n"), "markdown", F.lit("\n")).alias("line"))
    lines = in_order(title.unionByName(body).unionByName(paged).unionByName(sheet), ["document_id"], ["a", "b", "c", "d"], F.col("line"), "lines")
    return lines.select("document_id", F.array_join("lines", "\n").alias("markdown"))
