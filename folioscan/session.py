"""The engine's front door: ingest, store and ask, corpus-wide by default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import build, chunk, export, extract, graph, inspect, schemas, search, validate
from .operators.store import Store
from .sources import ingest

WORKBOOKS = ("xlsx", "xls", "csv")


class Engine:
    """Tables of the model, from files or from a store; every method answers for all documents, or for those named."""

    def __init__(self, spark: SparkSession, store: Store | None = None):
        self.spark, self.store, self.registry = spark, store, schemas.Registry()
        self.tables: dict[str, DataFrame] = {}
        self._held: DataFrame | None = None  # elements of the last upload, without a store

    # Ingest

    def upload(self, path: str, recursive: bool = True, extensions: list[str] | None = None) -> DataFrame:
        """Reads a file or a folder; the counts of files read and failed."""
        return self._take(ingest.read_files(self.spark, path, recursive, extensions))

    def upload_bytes(self, data: bytes, filename: str) -> DataFrame:
        return self._take(ingest.from_bytes(self.spark, {filename: data}))

    def _take(self, files: DataFrame) -> DataFrame:
        found = ingest.elements(files).persist()
        self.tables = ingest.model(found)
        if self.store is not None:
            for name, rows in self.tables.items():
                self.store.save(name, rows)
            self.tables = {name: self.store.load(name) for name in self.tables}
            found.unpersist()
        elif self._held is not None:
            self._held.unpersist()
        self._held = found if self.store is None else None
        return ingest.batch_summary(self.tables["documents"])

    def open(self) -> Engine:
        """All tables of the store."""
        names = ("documents", "pages", "text_blocks", "sections", "tables", "table_cells", "sheets", "formulas", "figures", "parse_warnings")
        self.tables = {name: self.store.load(name) for name in names}
        return self

    def _t(self, name: str, ids: list[str] | DataFrame | None = None) -> DataFrame:
        rows = self.tables[name]
        if isinstance(ids, DataFrame):
            return rows.join(ids.select("document_id").distinct(), "document_id", "left_semi")
        return rows.where(F.col("document_id").isin(*ids)) if ids else rows

    # Ask

    def list_files(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return self._t("documents").orderBy("filename", "document_id").offset(offset).limit(min(limit, 200))

    def to_markdown(self, ids: list[str] | None = None) -> DataFrame:
        return graph.document_markdown(*(self._t(n, ids) for n in ("documents", "text_blocks", "sections", "tables", "table_cells")))

    def search_corpus(self, query: str, ids: list[str] | None = None, max_results: int = 20, offset: int = 0) -> DataFrame:
        cells = self._t("table_cells").join(self._t("tables").where("sheet_name is not null").select("document_id", "table_id", "sheet_name"), ["document_id", "table_id"])
        return search.search_corpus(self._t("text_blocks"), cells, query, ids, max_results, offset)

    def chunk(self, config: chunk.Chunking = chunk.Chunking(), ids: list[str] | None = None) -> DataFrame:
        return chunk.chunk(*(self._t(n, ids) for n in ("text_blocks", "sections", "tables", "table_cells")), config)

    def classes(self, ids: list[str] | None = None) -> DataFrame:
        return build.classified(self._t("documents", ids), self._t("text_blocks", ids), self._t("formulas", ids))

    def profile(self, ids: list[str] | None = None) -> DataFrame:
        t = lambda n: self._t(n, ids)
        confidence = build.confidence_summary(t("documents"), t("text_blocks"), t("tables"), t("parse_warnings"))
        return inspect.profile(t("documents"), t("pages"), t("tables"), t("figures"), t("formulas"), t("sheets"), self.classes(ids), confidence)

    def structure(self, ids: list[str] | None = None) -> DataFrame:
        return inspect.structure(*(self._t(n, ids) for n in ("documents", "sections", "text_blocks", "tables", "sheets")))

    def search(self, query: str, ids: list[str] | None = None, max_results: int = 20) -> DataFrame:
        return inspect.search_document(*(self._t(n, ids) for n in ("text_blocks", "table_cells", "tables")), query, max_results)

    def get_page(self, number: int, ids: list[str] | None = None) -> DataFrame:
        return inspect.get_page(self._t("pages", ids), self._t("text_blocks", ids), number)

    def get_table(self, table_id: str) -> DataFrame:
        return inspect.get_table(self._t("tables"), self._t("table_cells"), table_id)

    def list_sheets(self, ids: list[str] | None = None) -> DataFrame:
        return inspect.list_sheets(*(self._t(n, ids) for n in ("sheets", "tables", "formulas")))

    def read_range(self, sheet: str, box: str, ids: list[str] | None = None) -> DataFrame:
        return inspect.read_range(*(self._t(n, ids) for n in ("table_cells", "tables", "sheets", "formulas")), sheet, box)

    def find_cells(self, query: str, sheet: str | None = None, max_results: int = 20, ids: list[str] | None = None) -> DataFrame:
        return inspect.find_cells(*(self._t(n, ids) for n in ("table_cells", "tables", "formulas")), query, sheet, max_results)

    def inspect_formula(self, sheet: str, address: str, ids: list[str] | None = None) -> DataFrame:
        return inspect.inspect_formula(self._t("formulas", ids), sheet, address)

    # Extract, validate, export

    def extract(self, schema: str | dict | None = None, ids: list[str] | DataFrame | None = None) -> DataFrame:
        """Fields of a schema (an id or a JSON Schema) for every document: labels in paged ones, neighbours in workbooks. Without a schema each document gets the one that fits its likely type."""
        if schema is None:
            chosen = extract.auto_schema(self.classes(ids))
            parts = [self.extract(s, chosen.where(F.col("schema_id") == s).select("document_id")) for s in sorted({*schemas.AUTO.values(), "table"})]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out
        found = self.registry.from_json_schema(schema) if isinstance(schema, dict) else self.registry.get(schema)
        if found is None:
            raise ValueError(f"unknown schema {schema!r}; known are {', '.join(self.registry.ids())}")
        t = lambda n: self._t(n, ids)
        if found.id == "register_spec":
            return extract.register_fields(t("text_blocks"), t("tables"), t("table_cells"))
        if found.id == "data_table":
            return extract.data_table_fields(t("tables"), t("table_cells"))
        book = F.col("file_type").isin(*WORKBOOKS)
        some = lambda n, docs: t(n).join(docs, "document_id", "left_semi")
        done = t("documents").where("processing_status = 'completed'")
        paged, books = done.where(~book).select("document_id"), done.where(book).select("document_id")
        fields = extract.text_fields(some("text_blocks", paged), found, some("tables", paged), some("table_cells", paged), paged)
        return fields.unionByName(extract.adjacent_fields(some("sheets", books), some("tables", books), some("table_cells", books), found))

    # Extractions that are kept

    def save_extraction(self, fields: DataFrame) -> DataFrame:
        """Keeps the fields of extractions; (extraction_id, document_id, schema_id) of each. An extraction of the same document and schema is replaced, others of the document stay."""
        new = fields.withColumn("extraction_id", extract.extraction_id())
        if self.store.has("extractions"):
            old = self.store.load("extractions")
            mine = old.join(new.select("document_id").distinct(), "document_id", "left_semi")
            new = new.unionByName(mine.join(new.select("extraction_id").distinct(), "extraction_id", "left_anti"))
        self.store.save("extractions", new)
        ids = fields.select("document_id", "schema_id").distinct()
        return ids.select(extract.extraction_id().alias("extraction_id"), "document_id", "schema_id")

    def get_extraction(self, extraction_id: str) -> DataFrame:
        """The fields kept under an id, in order."""
        found = self.store.load("extractions").where(F.col("extraction_id") == extraction_id).drop("extraction_id")
        if found.isEmpty():
            raise KeyError(f"no extraction {extraction_id}")
        return found.orderBy("ordinal")

    def list_extractions(self, document_id: str | None = None) -> DataFrame:
        rows = self.store.load("extractions", document_id)
        return rows.groupBy("extraction_id", "document_id", "schema_id").agg(F.count("*").alias("fields"), F.avg("confidence").alias("confidence"))

    def validate_extraction(self, extraction_id: str) -> DataFrame:
        return self.validate(self.get_extraction(extraction_id))

    def export_extraction(self, extraction_id: str, fmt: str) -> DataFrame:
        return self.export(self.get_extraction(extraction_id), fmt)

    def validate(self, fields: DataFrame) -> DataFrame:
        return validate.validate(fields, schemas.schema_fields(self.spark, [self.registry.get(i) for i in self.registry.ids()]))

    def export(self, fields: DataFrame, fmt: str) -> DataFrame:
        return export.export(fields, fmt)
