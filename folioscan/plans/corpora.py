"""The document model over the relational test tables: lines of `documents` as paged blocks, orders as workbooks, orders as invoices, web pages and conversations as paged documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import a1
from ..operators import build


@dataclass
class Corpora:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # Paged documents

    @cached_property
    def blocks(self) -> DataFrame:
        lines = self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
        k = (F.col("doc_id") + F.col("ordinal")) % 9
        raw = lines.select(
            F.concat(F.lit("doc-"), "doc_id").alias("document_id"), F.concat(F.lit("doc-"), "doc_id", F.lit("-b"), "ordinal").alias("block_id"),
            (F.floor(F.col("ordinal") / 20) + 1).cast("int").alias("page_number"), "ordinal", F.col("ordinal").alias("reading_order_index"), "text",
            F.when(F.col("ordinal") % 20 == 19, "footer").when(k == 7, "list_item").when(k == 8, "footnote").when(k == 2, "heading").otherwise("paragraph").alias("block_type"),
            F.when(k == 0, 24.0).when(k == 4, 18.0).when(k == 2, 14.0).otherwise(12.0).alias("font_size"),
            ((80 + (F.col("doc_id") + F.col("ordinal")) % 5 * 5) / 100.0).alias("confidence"),
        )
        return build.typed_blocks(raw)

    @cached_property
    def documents(self) -> DataFrame:
        n = F.size(F.split("text", "\n"))
        return self.table("documents").select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"), F.concat(F.lit("file-"), "doc_id", F.lit(".pdf")).alias("filename"), F.lit("pdf").alias("file_type"), (F.floor((n - 1) / 20) + 1).cast("int").alias("page_count"), F.lit(0).alias("sheet_count"))

    @cached_property
    def pages(self) -> DataFrame:
        pages = self.documents.select("document_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page_number"))
        return pages.select("document_id", "page_number", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(0).alias("rotation"), (F.col("page_number") % 3 == 0).alias("ocr_used"))

    @cached_property
    def sections(self) -> DataFrame:
        return build.sections(self.blocks, self.documents)

    @cached_property
    def figures(self) -> DataFrame:
        return self.table("documents").where("doc_id % 7 = 0").select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.lit("chart").alias("figure_type"))

    # Pipe-delimited lines as tables on pages

    @cached_property
    def page_cells(self) -> DataFrame:
        lines = self.blocks.where("text like '% | %'").select("document_id", F.concat("document_id", F.lit("-t")).alias("table_id"), "ordinal", "page_number", F.split("text", " \\| ").alias("parts"))
        row = F.row_number().over(Window.partitionBy("document_id").orderBy("ordinal")) - 1
        rows = lines.withColumn("row_index", row.cast("int"))
        cells = rows.select("document_id", "table_id", "page_number", "row_index", F.posexplode("parts").alias("column_index", "value"))
        return cells.select("document_id", "table_id", "page_number", (F.col("row_index") * 10000 + F.col("column_index")).alias("ordinal"), "row_index", "column_index", "value", F.lit(None).cast("string").alias("source_cell_ref"), F.lit("string").alias("data_type"))

    @cached_property
    def page_tables(self) -> DataFrame:
        return self.page_cells.groupBy("document_id", "table_id").agg(F.lit(0).alias("ordinal"), F.min("page_number").alias("page_number"), F.lit(None).cast("string").alias("sheet_name"), F.lit(None).cast("string").alias("title"), (F.max("row_index") + 1).alias("row_count"), (F.max("column_index") + 1).alias("column_count"), F.lit(0.9).alias("confidence"))

    # Orders as workbooks

    @cached_property
    def cells(self) -> DataFrame:
        turn = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        rows = self.table("lineitem").select("l_orderkey", F.row_number().over(turn).alias("r"), "l_linenumber", "l_quantity", "l_extendedprice")
        text = F.array(F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("decimal(18,0)").cast("string"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.concat(F.lit("=B"), F.col("r") + 1, F.lit("*C"), F.col("r") + 1))
        body = rows.select("l_orderkey", "r", F.posexplode(text).alias("column_index", "value"))
        head = self.table("lineitem").select("l_orderkey").distinct().select("l_orderkey", F.lit(0).alias("r"), F.posexplode(F.array(*map(F.lit, ("Line", "Quantity", "Price", "Total")))).alias("column_index", "value"))
        every = head.unionByName(body)
        doc = F.concat(F.lit("ord-"), "l_orderkey")
        return every.select(
            doc.alias("document_id"), F.concat(doc, F.lit("-t0")).alias("table_id"), (F.col("r") * 4 + F.col("column_index")).alias("ordinal"), F.col("r").alias("row_index"), "column_index", "value",
            F.lit("string").alias("data_type"), a1.address(F.col("r") + 1, F.col("column_index") + 1).alias("source_cell_ref"),
        )

    @cached_property
    def books(self) -> DataFrame:
        return self.table("lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n")).select(F.concat(F.lit("ord-"), "l_orderkey").alias("document_id"), "l_orderkey", "n", F.concat(F.lit("order-"), "l_orderkey", F.lit(".xlsx")).alias("filename"), F.lit("xlsx").alias("file_type"), F.lit(0).alias("page_count"), F.lit(1).alias("sheet_count"))

    @cached_property
    def tables(self) -> DataFrame:
        return self.books.select("document_id", F.concat("document_id", F.lit("-t0")).alias("table_id"), F.lit(0).alias("ordinal"), F.lit(None).cast("int").alias("page_number"), F.lit("Lines").alias("sheet_name"), F.lit("Lines").alias("title"), (F.col("n") + 1).alias("row_count"), F.lit(4).alias("column_count"), F.lit(1.0).alias("confidence"))

    @cached_property
    def sheets(self) -> DataFrame:
        none = F.array().cast("array<int>")
        return self.books.select(
            "document_id", F.lit("Lines").alias("name"), F.lit(0).alias("index"), (F.col("l_orderkey") % 10 != 0).alias("is_visible"), F.concat(F.lit("A1:D"), F.col("n") + 1).alias("used_range"), (F.col("n") + 1).alias("row_count"), F.lit(4).alias("column_count"),
            F.array().cast("array<string>").alias("merged_cells"), F.when(F.col("l_orderkey") % 5 == 0, F.array(F.lit(3))).otherwise(none).alias("hidden_rows"), F.when(F.col("l_orderkey") % 7 == 0, F.array(F.lit(2))).otherwise(none).alias("hidden_columns"), F.array().cast("array<string>").alias("comments"),
        )

    @cached_property
    def formulas(self) -> DataFrame:
        found = self.cells.where("column_index = 3 and row_index > 0")
        return build.formula_references(found.select("document_id", F.lit("Lines").alias("sheet_name"), F.col("row_index").alias("ordinal"), F.col("source_cell_ref").alias("cell_address"), F.col("value").alias("formula_text"), F.lit(None).cast("string").alias("calculated_value")))

    # Orders as invoices

    @cached_property
    def invoices(self) -> DataFrame:
        total = F.round(F.col("o_totalprice") * 100).cast("long").alias("total")
        rows = self.table("orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), total).withColumn("tax", F.expr("total div 10"))
        usd = lambda c: F.concat(F.lit("$"), F.expr(f"cast(({c}) div 100 as string)"), F.lit("."), F.lpad(F.expr(f"cast(({c}) % 100 as string)"), 2, "0"))
        shown = F.concat(F.lit("Total: "), usd("case when o_orderkey % 4 = 0 then total + 500 else total end"))
        lines = F.array(
            F.concat(F.lit("Vendor Name: Supplier "), F.col("o_custkey") % 97), F.concat(F.lit("Invoice Number: INV-"), "o_orderkey"), F.concat(F.lit("Invoice Date: "), "day"),
            F.when(F.col("o_orderkey") % 2 == 0, shown), F.concat(F.lit("Subtotal: "), usd("total - tax")), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("Tax: "), usd("tax"))), F.when(F.col("o_orderkey") % 2 != 0, shown),
            F.concat(F.lit("Payment Terms: net "), F.col("o_custkey") % 60, F.lit(";")),
        )
        kept = F.filter(lines, lambda x: x.isNotNull())
        out = rows.select(F.concat(F.lit("inv-"), "o_orderkey").alias("document_id"), F.posexplode(kept).alias("ordinal", "text"))
        return out.select("document_id", F.concat("document_id", F.lit("-b"), "ordinal").alias("block_id"), F.lit(1).alias("page_number"), "ordinal", F.col("ordinal").alias("reading_order_index"), "text", F.lit("paragraph").alias("block_type"), F.lit(12.0).alias("font_size"), F.lit(1.0).alias("confidence"))


# The same tables in SQL, as common table expressions.
BLOCKS = r"""
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents),
    raw AS (
        SELECT 'doc-' || doc_id AS document_id, 'doc-' || doc_id || '-b' || ordinal AS block_id, (ordinal // 20 + 1)::INT AS page_number, ordinal::INT AS ordinal, text,
               CASE WHEN ordinal % 20 = 19 THEN 'footer' WHEN (doc_id + ordinal) % 9 = 7 THEN 'list_item' WHEN (doc_id + ordinal) % 9 = 8 THEN 'footnote' WHEN (doc_id + ordinal) % 9 = 2 THEN 'heading' ELSE 'paragraph' END AS raw_type,
               CASE (doc_id + ordinal) % 9 WHEN 0 THEN 24.0 WHEN 4 THEN 18.0 WHEN 2 THEN 14.0 ELSE 12.0 END::DOUBLE AS font_size,
               ((80 + (doc_id + ordinal) % 5 * 5) / 100.0)::DOUBLE AS confidence FROM lines),
    blocks AS (SELECT *, CASE WHEN raw_type = 'paragraph' AND font_size > 16 THEN 'heading' ELSE raw_type END AS block_type FROM raw),
    docs AS (SELECT 'doc-' || doc_id AS document_id, 'file-' || doc_id || '.pdf' AS filename, ((len(string_split(text, chr(10))) - 1) // 20 + 1)::INT AS page_count FROM documents),
    page_texts AS (SELECT document_id, page_number, string_agg(text, chr(10) ORDER BY ordinal) AS text FROM blocks GROUP BY ALL),
    doc_texts AS (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM page_texts GROUP BY ALL)"""
SECTIONS = BLOCKS + r""",
    heads AS (SELECT *, CASE WHEN font_size > 20 THEN 1 WHEN font_size > 16 THEN 2 ELSE 3 END AS lv FROM blocks WHERE block_type = 'heading'),
    sections AS (
        SELECT h.document_id, h.block_id AS section_id, regexp_replace(h.text, '^\s+|\s+$', '', 'g') AS title, h.lv AS heading_level,
               (SELECT arg_max(p.block_id, p.ordinal) FROM heads p WHERE p.document_id = h.document_id AND p.ordinal < h.ordinal AND p.lv < h.lv) AS parent_section_id,
               h.page_number AS start_page,
               coalesce((SELECT arg_min(n.page_number, n.ordinal) FROM heads n WHERE n.document_id = h.document_id AND n.ordinal > h.ordinal AND n.lv <= h.lv), d.page_count) AS end_page,
               (row_number() OVER (PARTITION BY h.document_id ORDER BY h.ordinal) - 1)::INT AS ordinal
        FROM heads h JOIN docs d USING (document_id)),
    paths AS (
        SELECT s.*, list_filter([g.title, p.title, s.title], lambda x: x IS NOT NULL) AS section_path
        FROM sections s LEFT JOIN sections p ON s.parent_section_id = p.section_id LEFT JOIN sections g ON p.parent_section_id = g.section_id)"""
PAGE_CELLS = BLOCKS + r""",
    piped AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) - 1 AS row_index FROM blocks WHERE text LIKE '% | %'),
    page_cells AS (
        SELECT document_id, page_number, row_index::INT AS row_index, unnest(string_split(text, ' | ')) AS value, (generate_subscripts(string_split(text, ' | '), 1) - 1)::INT AS column_index FROM piped)"""
BOOKS = r"""
    numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS r FROM lineitem),
    flat AS (
        SELECT l_orderkey, r, unnest([l_linenumber::VARCHAR, l_quantity::DECIMAL(18,0)::VARCHAR, l_extendedprice::DECIMAL(18,2)::VARCHAR, '=B' || (r + 1) || '*C' || (r + 1)]) AS value, unnest([0, 1, 2, 3]) AS column_index FROM numbered
        UNION ALL SELECT l_orderkey, 0, unnest(['Line', 'Quantity', 'Price', 'Total']), unnest([0, 1, 2, 3]) FROM (SELECT DISTINCT l_orderkey FROM lineitem)),
    cells AS (SELECT l_orderkey, 'ord-' || l_orderkey AS document_id, r AS row_index, column_index, value, chr(65 + column_index) || (r + 1) AS ref, r * 4 + column_index AS ordinal FROM flat)"""
INVOICES = r"""
    priced AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, round(o_totalprice * 100)::BIGINT AS total, round(o_totalprice * 100)::BIGINT // 10 AS tax FROM orders),
    shown AS (
        SELECT *, 'Total: $' || ((total + CASE WHEN o_orderkey % 4 = 0 THEN 500 ELSE 0 END) // 100) || '.' || lpad(((total + CASE WHEN o_orderkey % 4 = 0 THEN 500 ELSE 0 END) % 100)::VARCHAR, 2, '0') AS total_line FROM priced),
    texts AS (
        SELECT 'inv-' || o_orderkey AS document_id, o_orderkey, concat_ws(chr(10), 'Vendor Name: Supplier ' || (o_custkey % 97), 'Invoice Number: INV-' || o_orderkey, 'Invoice Date: ' || day,
               CASE WHEN o_orderkey % 2 = 0 THEN total_line END, 'Subtotal: $' || ((total - tax) // 100) || '.' || lpad(((total - tax) % 100)::VARCHAR, 2, '0'),
               CASE WHEN o_orderkey % 3 <> 0 THEN 'Tax: $' || (tax // 100) || '.' || lpad((tax % 100)::VARCHAR, 2, '0') END, CASE WHEN o_orderkey % 2 <> 0 THEN total_line END,
               'Payment Terms: net ' || (o_custkey % 60) || ';') AS text FROM shown)"""
