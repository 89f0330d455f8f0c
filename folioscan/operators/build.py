"""From parsed elements to the document model: typing, sections, citations, classification, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..functions.text import strip

ORDER = ("page_number", "reading_order_index", "ordinal")


def block_type(raw: Column, font_size: Column) -> Column:
    """Known block types; large paragraphs are headings."""
    known = F.when(raw.isin(*schema.BLOCK_TYPES), raw).otherwise("paragraph")
    return F.when((known == "paragraph") & (F.coalesce(font_size, F.lit(12.0)) > 16), "heading").otherwise(known)


def positional_type(y0: Column, y1: Column, height: Column) -> Column:
    """Header in the top 8 % of a page, footer in the bottom 8 %, by the block's middle."""
    middle = (y0 + y1) / 2
    return F.when(middle < height * 0.08, "header").when(middle > height * 0.92, "footer").otherwise("paragraph")


def typed_blocks(raw: DataFrame) -> DataFrame:
    return raw.withColumn("block_type", block_type(F.col("block_type"), F.col("font_size")))


def dominant_font(spans: DataFrame) -> DataFrame:
    """The most frequent span size of each block, the smallest on ties."""
    return spans.groupBy("document_id", "block_id").agg(F.coalesce(F.mode("font_size", deterministic=True), F.lit(12.0)).alias("font_size"))


def byte_offsets(blocks: DataFrame) -> DataFrame:
    """byte_start and byte_end of each block in the document's text, one separator byte after each."""
    before = Window.partitionBy("document_id").orderBy("page_number", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0)).cast("long")
    return blocks.withColumn("byte_start", start).withColumn("byte_end", F.col("byte_start") + F.octet_length("text"))


def scanned_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Warnings for wide pages with next to no text."""
    chars = blocks.groupBy("document_id", "page_number").agg(F.sum(F.length("text") + 1).alias("chars"))
    joined = pages.join(chars, ["document_id", "page_number"], "left").where("width > 100 and coalesce(chars, 1) - 1 < 20")
    return joined.select("document_id", F.lit("POSSIBLY_SCANNED").alias("code"), F.format_string("Page %d has little text and may be scanned", "page_number").alias("message"), F.col("page_number").alias("page"), F.lit(None).cast("string").alias("sheet"))


def sections(blocks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """One section for each heading. Levels by font size (over 20: 1, over 16: 2, else 3); the parent is the last
    heading before with a smaller level; a section ends where the next of its level or above begins, else with the document."""
    font = F.coalesce("font_size", F.lit(12.0))
    level = F.when(font > 20, 1).when(font > 16, 2).otherwise(3)
    heads = blocks.where("block_type = 'heading'").withColumn("heading_level", level)
    run = Window.partitionBy("document_id").orderBy(*ORDER)
    before, after = run.rowsBetween(Window.unboundedPreceding, -1), run.rowsBetween(1, Window.unboundedFollowing)
    last = lambda most: F.last(F.when(F.col("heading_level") < most, F.col("block_id")), ignorenulls=True).over(before)
    ends = lambda most: F.first(F.when(F.col("heading_level") <= most, F.col("page_number")), ignorenulls=True).over(after)
    lv = F.col("heading_level")
    heads = heads.select(
        "document_id", F.col("block_id").alias("section_id"), (F.row_number().over(run) - 1).alias("ordinal"), strip(F.col("text")).alias("title"), "heading_level",
        F.when(lv == 2, last(2)).when(lv == 3, last(3)).alias("parent_section_id"), F.col("page_number").alias("start_page"),
        F.when(lv == 1, ends(1)).when(lv == 2, ends(2)).otherwise(ends(3)).alias("end_page"),
    )
    return heads.join(page_counts.select("document_id", "page_count"), "document_id", "left").withColumn("end_page", F.coalesce("end_page", "page_count")).drop("page_count")


def block_citations(blocks: DataFrame) -> DataFrame:
    kind = F.when(F.col("bbox").isNotNull(), "bounding_box").otherwise("page") if "bbox" in blocks.columns else F.lit("page")
    return blocks.select("document_id", F.col("block_id").alias("target_object_id"), kind.alias("citation_type"), "page_number", F.substring("text", 1, 200).alias("text_snippet"), "confidence")


def table_citations(tables: DataFrame) -> DataFrame:
    return tables.where("page_number is not null").select("document_id", F.col("table_id").alias("target_object_id"), F.lit("table").alias("citation_type"), "page_number", "confidence")


def formula_citations(formulas: DataFrame) -> DataFrame:
    return formulas.select("document_id", F.lit("formula").alias("citation_type"), "sheet_name", "cell_address", F.substring("formula_text", 1, 200).alias("text_snippet"))


def sheet_dimensions(cells: DataFrame) -> DataFrame:
    """Rows and columns of each sheet's table: distinct or largest index, whichever is more (indexes count from 0)."""
    size = lambda c: F.greatest(F.count_distinct(c), F.max(c) + 1).cast("int")
    return cells.groupBy("document_id", "table_id").agg(size("row_index").alias("row_count"), size("column_index").alias("column_count"))


def normalised_cells(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.coalesce(F.col("value").cast("string"), F.lit("")))


def classified(documents: DataFrame, blocks: DataFrame, formulas: DataFrame | None = None, least: int = 2) -> DataFrame:
    """likely_document_types of each document, by distinct keywords in its text; no text meets another document's."""
    found = [F.max(F.contains(F.lower("text"), F.lit(k)).cast("int")).alias(f"{kind}:{k}") for kind, ks in schema.KEYWORDS.items() for k in ks]
    hits = blocks.groupBy("document_id").agg(*found)
    score = lambda kind: sum((F.coalesce(F.col(f"`{kind}:{k}`"), F.lit(0)) for k in schema.KEYWORDS[kind]), F.lit(0))
    docs = documents.select("document_id", "file_type").join(hits, "document_id", "left")
    calc = formulas.select("document_id").distinct().withColumn("has_formulas", F.lit(True)) if formulas is not None else None
    docs = docs.join(calc, "document_id", "left") if calc is not None else docs.withColumn("has_formulas", F.lit(False))
    book = F.col("file_type").isin("xlsx", "xls")
    financial = book & ((score("financial_model") >= least) | (F.coalesce("has_formulas", F.lit(False)) & (score("financial_model") >= 1)))
    kinds = [F.when(score(k) >= least, k) for k in ("invoice", "contract", "bank_statement", "resume")]
    kinds += [F.when(F.col("file_type") == "pptx", "presentation"), F.when(book, "spreadsheet"), F.when(financial, "financial_model")]
    types = F.filter(F.array(*kinds), lambda x: x.isNotNull())
    return docs.select("document_id", F.when(F.size(types) > 0, types).otherwise(F.array(F.lit("unknown"))).alias("likely_document_types"))


def confidence_summary(documents: DataFrame, blocks: DataFrame, tables: DataFrame, warnings: DataFrame) -> DataFrame:
    """Mean confidences (1 where there is nothing) and the messages of warnings that lower them."""
    both = blocks.select("document_id", F.col("confidence").alias("t"), F.lit(None).cast("double").alias("b")).unionByName(
        tables.where("page_number is not null").select("document_id", F.lit(None).cast("double").alias("t"), F.col("confidence").alias("b")))
    means = both.groupBy("document_id").agg(F.avg(F.coalesce("t", "b")).alias("overall"), F.avg("t").alias("text_confidence"), F.avg("b").alias("table_confidence"))
    low = warnings.where(F.col("code").isin(*schema.LOW_CONFIDENCE_CODES)).groupBy("document_id").agg(F.sort_array(F.collect_list("message")).alias("low_confidence_regions"))
    out = documents.select("document_id").join(means, "document_id", "left").join(low, "document_id", "left")
    return out.na.fill(1.0, ["overall", "text_confidence", "table_confidence"]).withColumn("low_confidence_regions", F.coalesce("low_confidence_regions", F.array().cast("array<string>")))


# The grammar of references in formulas.
_SHEET, _REF = r"(?:('?[A-Za-z0-9_ ]+'?)!)?", r"\$?[A-Z]{1,3}\$?\d+"
RANGE_PATTERN, CELL_PATTERN = f"{_SHEET}({_REF}:{_REF})", f"{_SHEET}({_REF})"


def formula_references(formulas: DataFrame) -> DataFrame:
    """referenced_ranges, referenced_cells, referenced_sheets, external_references of each formula; ranges are taken out before cells are read."""
    text = F.col("formula_text")
    rest = F.regexp_replace(text, RANGE_PATTERN, "")
    every = lambda c, p, g: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    names = F.transform(F.concat(every(text, RANGE_PATTERN, 1), every(rest, CELL_PATTERN, 1)), lambda s: F.regexp_replace(s, "^'+|'+$", ""))
    return formulas.select(
        "*", every(text, RANGE_PATTERN, 0).alias("referenced_ranges"), every(rest, CELL_PATTERN, 0).alias("referenced_cells"),
        F.array_sort(F.array_distinct(F.filter(names, lambda s: s != ""))).alias("referenced_sheets"),
        F.when(F.contains(text, F.lit("[")), F.array(text)).otherwise(F.array().cast("array<string>")).alias("external_references"),
    )


def sheet_warnings(sheets: DataFrame) -> DataFrame:
    """HIDDEN_SHEET, HIDDEN_ROWS and HIDDEN_COLUMNS, one row each."""
    made = F.array(
        F.when(~F.col("is_visible"), F.struct(F.lit("HIDDEN_SHEET").alias("code"), F.format_string("Sheet '%s' is hidden", "name").alias("message"))),
        F.when(F.size("hidden_rows") > 0, F.struct(F.lit("HIDDEN_ROWS").alias("code"), F.format_string("Sheet '%s' has %d hidden rows", F.col("name"), F.size("hidden_rows")).alias("message"))),
        F.when(F.size("hidden_columns") > 0, F.struct(F.lit("HIDDEN_COLUMNS").alias("code"), F.format_string("Sheet '%s' has %d hidden columns", F.col("name"), F.size("hidden_columns")).alias("message"))),
    )
    return sheets.select("document_id", F.explode(F.filter(made, lambda w: w.isNotNull())).alias("w"), F.col("name").alias("sheet")).select("document_id", "w.code", "w.message", "sheet")
