"""Inspection tools, each for all documents at once; filter by document_id to ask about one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import a1
from . import graph


def profile(documents: DataFrame, pages: DataFrame, tables: DataFrame, figures: DataFrame, formulas: DataFrame, sheets: DataFrame, classes: DataFrame, confidence: DataFrame) -> DataFrame:
    """One row a document: type, sizes and what it holds."""
    per = lambda df, *aggs: df.groupBy("document_id").agg(*aggs)
    out = documents.select("document_id", "filename", "file_type", "page_count", "sheet_count")
    parts = [
        per(pages, F.bool_or("ocr_used").alias("has_scanned_pages")),
        per(tables, F.lit(True).alias("has_tables")),
        per(figures, F.lit(True).alias("has_images")),
        per(formulas, F.lit(True).alias("has_formulas")),
        per(sheets, F.bool_or(~F.col("is_visible")).alias("has_hidden_sheets")),
        classes,
        confidence.select("document_id", "overall", F.size("low_confidence_regions").alias("low_confidence_count")),
    ]
    for p in parts:
        out = out.join(p, "document_id", "left")
    flags = ["has_scanned_pages", "has_tables", "has_images", "has_formulas", "has_hidden_sheets"]
    out = out.na.fill(False, flags).na.fill({"overall": 1.0, "low_confidence_count": 0})
    return out.withColumn("recommended_tools", recommended(F.col("file_type"), F.col("has_tables"), F.col("has_formulas")))


def recommended(file_type, has_tables, has_formulas):
    """Tools worth calling next, in order."""
    paged, book = file_type == "pdf", file_type.isin("xlsx", "xls", "csv")
    steps = F.array(
        F.when(paged, "list_structure"), F.when(paged & has_tables, "get_table"), F.when(paged, "get_page"), F.when(paged, "search_document"),
        F.when(book, "list_sheets"), F.when(book, "read_range"), F.when(book, "find_cells"), F.when(book & has_formulas, "inspect_formula"), F.lit("extract"),
    )
    return F.filter(steps, lambda x: x.isNotNull())


def structure(documents: DataFrame, sections: DataFrame, blocks: DataFrame, tables: DataFrame, sheets: DataFrame) -> DataFrame:
    """sections, pages, tables and sheets of each document as nested summaries."""
    nest = lambda df, order, name, *fields: graph.in_order(df, ["document_id"], order, F.struct(*fields), name)
    pages = blocks.groupBy("document_id", "page_number").agg(F.count("*").alias("text_blocks"))
    out = documents.select("document_id")
    for part in (
        nest(sections, ["ordinal"], "sections", "section_id", "title", "heading_level", "parent_section_id", "start_page", "end_page"),
        nest(pages, ["page_number"], "pages", "page_number", "text_blocks"),
        nest(tables, ["ordinal"], "tables", "table_id", "title", "page_number", "sheet_name", "row_count", "column_count"),
        nest(sheets, ["index"], "sheets", "name", "is_visible", "row_count", "column_count"),
    ):
        out = out.join(part, "document_id", "left")
    return out


def search_document(blocks: DataFrame, cells: DataFrame, tables: DataFrame, query: str, max_results: int = 20) -> DataFrame:
    """Per document: text matches and cell matches (each at most max_results, in order) and every table whose header holds the query (its first such header)."""
    turn = Window.partitionBy("document_id").orderBy("page_number", "ordinal")
    text = graph.search_text(blocks, query).withColumn("k", F.row_number().over(turn)).where(F.col("k") <= max_results)
    text = text.select("document_id", F.lit("text").alias("category"), "k", F.substring("text", 1, 500).alias("match"), F.concat(F.lit("page "), F.col("page_number").cast("string")).alias("location"))
    found = graph.search_cells(cells, tables, query)
    found = found.withColumn("k", F.row_number().over(Window.partitionBy("document_id").orderBy("table_id", "ordinal"))).where(F.col("k") <= max_results)
    found = found.select("document_id", F.lit("cell").alias("category"), "k", F.col("value").alias("match"), F.concat(F.lit("sheet '"), "sheet_name", F.lit("', cell "), "address").alias("location"))
    heads = cells.where("row_index = 0").where(F.contains(F.lower("value"), F.lit(query.lower())))
    heads = heads.groupBy("document_id", "table_id").agg(F.min_by("value", "ordinal").alias("match"))
    heads = heads.withColumn("k", F.row_number().over(Window.partitionBy("document_id").orderBy("table_id")))
    heads = heads.select("document_id", F.lit("table").alias("category"), "k", "match", F.concat(F.lit("table "), "table_id").alias("location"))
    return text.unionByName(found).unionByName(heads)


def get_page(pages: DataFrame, blocks: DataFrame, page_number: int) -> DataFrame:
    """The page of each document with its text and block count; error where the document has no such page."""
    counts = pages.groupBy("document_id").agg(F.count("*").alias("page_count"))
    here = pages.where(F.col("page_number") == page_number)
    some = blocks.where(F.col("page_number") == page_number)
    texts = graph.page_texts(some).join(some.groupBy("document_id").agg(F.count("*").alias("block_count")), "document_id")
    out = counts.join(here, "document_id", "left").join(texts.drop("page_number"), "document_id", "left")
    error = F.when(F.col("page_number").isNull(), F.format_string("Page %d not found", F.lit(page_number)))
    return out.select("document_id", "page_count", "page_number", "width", "height", F.coalesce("text", F.when(error.isNull(), F.lit(""))).alias("text"), F.coalesce("block_count", F.lit(0)).alias("block_count"), error.alias("error"))


def get_table(tables: DataFrame, cells: DataFrame, table_id: str) -> DataFrame:
    here = tables.where(F.col("table_id") == table_id)
    some = cells.where(F.col("table_id") == table_id)
    data = graph.in_order(graph.grids(some, here), ["document_id", "table_id"], ["row_index"], F.col("row"), "data")
    return here.join(data, ["document_id", "table_id"], "left").join(graph.table_markdown(some, here), ["document_id", "table_id"], "left")


def list_sheets(sheets: DataFrame, tables: DataFrame, formulas: DataFrame) -> DataFrame:
    """Metrics of each sheet."""
    n = lambda df, name: df.groupBy("document_id", "sheet_name").agg(F.count("*").alias(name)).withColumnRenamed("sheet_name", "name")
    out = sheets.join(n(tables.where("sheet_name is not null"), "tables"), ["document_id", "name"], "left").join(n(formulas, "formulas"), ["document_id", "name"], "left")
    sizes = [F.greatest(F.size(c), F.lit(0)).alias(c) for c in ("hidden_rows", "hidden_columns", "merged_cells", "comments")]
    return out.select("document_id", "name", "index", "is_visible", "used_range", "row_count", "column_count", F.coalesce("tables", F.lit(0)).alias("tables"), F.coalesce("formulas", F.lit(0)).alias("formulas"), *sizes)


def _first_formulas(formulas: DataFrame) -> DataFrame:
    one = formulas.groupBy("document_id", "sheet_name", F.upper("cell_address").alias("address")).agg(F.min_by(F.struct("formula_text", "calculated_value"), "ordinal").alias("f"))
    return one.select("document_id", "sheet_name", "address", F.col("f.formula_text").alias("formula"), F.col("f.calculated_value").alias("calculated_value"))


def read_range(cells: DataFrame, tables: DataFrame, sheets: DataFrame, formulas: DataFrame, sheet: str, box: str) -> DataFrame:
    """Cells of a sheet inside a rectangle, with formula, type and whether their row or column is hidden. A malformed range raises ValueError."""
    area = a1.parse_range(box)
    if area is None:
        raise ValueError(f"not a range: {box}")
    here = cells.join(tables.where(F.col("sheet_name") == sheet).select("document_id", "table_id", "sheet_name"), ["document_id", "table_id"])
    here = here.withColumn("row", a1.row_of(F.col("source_cell_ref"))).withColumn("col", a1.col_of(F.col("source_cell_ref"))).where(a1.in_range(F.col("row"), F.col("col"), area))
    found = here.withColumn("address", F.upper("source_cell_ref")).join(_first_formulas(formulas), ["document_id", "sheet_name", "address"], "left")
    found = found.join(sheets.where(F.col("name") == sheet).select("document_id", "hidden_rows", "hidden_columns"), "document_id", "left")
    hidden = F.coalesce(F.array_contains("hidden_rows", F.col("row")) | F.array_contains("hidden_columns", F.col("col")), F.lit(False))
    return found.select("document_id", "sheet_name", "address", "row", "col", "value", "formula", "data_type", hidden.alias("is_hidden"), F.lit(False).alias("is_merged"))


def find_cells(cells: DataFrame, tables: DataFrame, formulas: DataFrame, query: str, sheet: str | None = None, max_results: int = 20) -> DataFrame:
    """Cells of sheets that hold the query, at most max_results a document, with formula and the other cells of their row."""
    hits = graph.search_cells(cells, tables, query)
    hits = hits.where(F.col("sheet_name") == sheet) if sheet else hits
    hits = hits.withColumn("k", F.row_number().over(Window.partitionBy("document_id").orderBy("table_id", "ordinal"))).where(F.col("k") <= max_results)
    place = F.coalesce("source_cell_ref", F.concat(F.lit("R"), "row_index", F.lit("C"), "column_index"))
    rows = hits.select("document_id", "table_id", "row_index").distinct().join(cells, ["document_id", "table_id", "row_index"])
    context = graph.in_order(rows, ["document_id", "table_id", "row_index"], ["column_index", "ordinal"], F.concat(place, F.lit("="), "value"), "row_context")
    out = hits.join(context, ["document_id", "table_id", "row_index"]).withColumn("address", F.upper("address"))
    return out.join(_first_formulas(formulas), ["document_id", "sheet_name", "address"], "left").select("document_id", "k", "sheet_name", "address", "value", "formula", F.array_join("row_context", "; ").alias("row_context"))


def inspect_formula(formulas: DataFrame, sheet: str, address: str) -> DataFrame:
    """The formula at an address of each document, what it refers to and which formulas of the sheet refer to it. formulas need the columns of formula_references."""
    here = formulas.where((F.col("sheet_name") == sheet) & (F.upper("cell_address") == address.upper()))
    here = here.groupBy("document_id", "sheet_name").agg(F.min_by(F.struct("formula_text", "calculated_value", "referenced_cells", "referenced_ranges", "referenced_sheets", "external_references"), "ordinal").alias("f")).select("document_id", "sheet_name", "f.*")
    users = formulas.where((F.col("sheet_name") == sheet) & F.exists("referenced_cells", lambda r: F.upper(r) == address.upper()))
    users = users.groupBy("document_id").agg(F.array_sort(F.collect_set("cell_address")).alias("dependents"))
    return here.join(users, "document_id", "left").withColumn("dependents", F.coalesce("dependents", F.array().cast("array<string>")))


def dependents(formulas: DataFrame) -> DataFrame:
    """(document_id, sheet_name, cell, dependents): for every cell that formulas of its sheet name, how many do."""
    refs = formulas.select("document_id", "sheet_name", "cell_address", F.explode(F.transform("referenced_cells", F.upper)).alias("cell")).distinct()
    return refs.groupBy("document_id", "sheet_name", "cell").agg(F.count("*").alias("dependents"))
