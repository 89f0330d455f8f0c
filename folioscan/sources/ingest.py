"""Files to model tables: a binaryFile scan, one parser call a file in the Python workers, all else in the JVM."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import build
from . import registry

#: kind: the model table an element belongs to; data: its fields as JSON.
ELEMENTS = "document_id string, filename string, file_type string, checksum string, source_uri string, kind string, ordinal int, data string"


def read_files(spark: SparkSession, path: str, recursive: bool = True, extensions: list[str] | None = None) -> DataFrame:
    """(path, length, content) of the files of a folder or pattern, filtered by extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    if extensions:
        wanted = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]
        files = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*wanted))
    return files.select("path", "length", "content")


def from_bytes(spark: SparkSession, named: dict[str, bytes]) -> DataFrame:
    for name in named:
        if ".." in name or name.startswith(("/", "\\")):
            raise ValueError(f"not a file name: {name}")
    return spark.createDataFrame([(n, len(d), bytearray(d)) for n, d in named.items()], "path string, length long, content binary")


def elements(files: DataFrame) -> DataFrame:
    """Every element of every file; a file that cannot be parsed gives its document row with errors. The content of files above the size limit is not read."""
    known = dict(registry.PARSERS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ELEMENTS.split(", ")]
        for batch in batches:
            for path, kind, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                path, kind, data = path.as_py(), kind.as_py(), content.as_py()
                name = path.rsplit("/", 1)[-1]
                checksum = hashlib.sha256(data or b"").hexdigest()
                doc = hashlib.sha256(f"{path}\n{checksum}".encode()).hexdigest()[:16]
                found = registry.parse(kind, data, name, known)
                about = {k: found[k] for k in ("metadata", "named_ranges", "external_links", "errors")} | {"page_count": len(found["pages"]), "sheet_count": len(found["sheets"])}
                rows = [("documents", 0, about)]
                rows += [(t, k, e) for t in ("pages", "text_blocks", "tables", "table_cells", "sheets", "formulas", "figures", "parse_warnings") for k, e in enumerate(found[t])]
                for start in range(0, len(rows), 20_000):
                    some = rows[start : start + 20_000]
                    columns = [[doc] * len(some), [name] * len(some), [kind] * len(some), [checksum] * len(some), [path] * len(some), [r[0] for r in some], [r[1] for r in some], [json.dumps(r[2], ensure_ascii=False) for r in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "ordinal" else pa.string()) for n, c in zip(names, columns, strict=True)], names=names)

    fits = F.col("length") <= registry.MAX_BYTES
    kind = registry.file_type(F.col("path")).alias("file_type")
    typed = files.where(fits).select("path", kind, F.coalesce("content", F.lit(b"")).alias("content"))
    typed = typed.union(files.where(~fits).select("path", kind, F.lit(None).cast("binary")))
    return typed.mapInArrow(parse, ELEMENTS)


def model(found: DataFrame) -> dict[str, DataFrame]:
    """The tables of the document model from elements()."""

    def table(kind: str, fields: str) -> DataFrame:
        rows = found.where(F.col("kind") == kind)
        return rows.select("document_id", "filename", "file_type", "checksum", "source_uri", "ordinal", F.from_json("data", fields).alias("e"))

    doc = table("documents", "page_count int, sheet_count int, metadata map<string,string>, named_ranges map<string,string>, external_links array<string>, errors array<string>")
    doc = doc.select("document_id", "filename", "file_type", registry.mime_type(F.col("file_type")).alias("mime_type"), "checksum", "source_uri", F.when(F.size("e.errors") > 0, "failed").otherwise("completed").alias("processing_status"), "e.*")
    blocks = table("text_blocks", f"page_number int, text string, block_type string, font_size double, confidence double, bbox {schema.BBOX}")
    blocks = blocks.select("document_id", F.concat("document_id", F.lit("-b"), "ordinal").alias("block_id"), "ordinal", F.lit(0).alias("reading_order_index"), "e.*")
    name = lambda k: F.concat("document_id", F.lit("-t"), k)
    tables = table("tables", "page_number int, sheet_name string, title string, row_count int, column_count int, confidence double").select("document_id", name("ordinal").alias("table_id"), "ordinal", "e.*")
    cells = table("table_cells", "table int, row_index int, column_index int, value string, data_type string, source_cell_ref string")
    cells = cells.select("document_id", name("e.table").alias("table_id"), "ordinal", "e.row_index", "e.column_index", "e.value", "e.data_type", "e.source_cell_ref")
    sheets = table("sheets", "name string, index int, is_visible boolean, used_range string, row_count int, column_count int, merged_cells array<string>, hidden_rows array<int>, hidden_columns array<int>, comments array<struct<cell:string,author:string,text:string>>")
    formulas = table("formulas", "sheet_name string, cell_address string, formula_text string, calculated_value string").select("document_id", "ordinal", "e.*")
    blocks = build.typed_blocks(blocks)
    return {
        "documents": doc,
        "pages": table("pages", "page_number int, width double, height double, rotation int, ocr_used boolean").select("document_id", "e.page_number", "e.width", "e.height", F.coalesce("e.rotation", F.lit(0)).alias("rotation"), F.coalesce("e.ocr_used", F.lit(False)).alias("ocr_used")),
        "text_blocks": blocks,
        "sections": build.sections(blocks, doc),
        "tables": tables,
        "table_cells": build.normalised_cells(cells),
        "sheets": sheets.select("document_id", "e.*"),
        "formulas": build.formula_references(formulas),
        "figures": table("figures", "page_number int, figure_type string, caption string").select("document_id", "e.*"),
        "parse_warnings": table("parse_warnings", "code string, message string, page int, sheet string").select("document_id", "e.*"),
    }


def batch_summary(documents: DataFrame) -> DataFrame:
    failed = F.col("processing_status") == "failed"
    return documents.agg(F.count("*").alias("total_files"), F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed"))
