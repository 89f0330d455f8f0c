"""Extraction schemas: the built-in ones, a registry, JSON Schema both ways, and a dimension table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class FieldDef:
    name: str
    field_type: str = "string"
    required: bool = False
    description: str = ""
    constraints: dict = field(default_factory=dict)
    items_type: str | None = None


@dataclass(frozen=True)
class Schema:
    id: str
    name: str
    fields: tuple[FieldDef, ...]
    description: str = ""
    version: str = "1.0"


# Ids, fields, types and required flags of the built-in schemas.
BUILT_IN = (
    Schema(
        "invoice",
        "Invoice",
        (
            FieldDef("vendor_name", "string", True, "Who sends the invoice"),
            FieldDef("vendor_address", "string", False, "Where the sender is"),
            FieldDef("invoice_number", "string", True, "The invoice's own number"),
            FieldDef("invoice_date", "date", True, "When it was issued"),
            FieldDef("due_date", "date", False, "When it must be paid"),
            FieldDef("purchase_order", "string", False, "The order that it bills"),
            FieldDef("line_items", "array", True, "What is billed, line by line"),
            FieldDef("subtotal", "currency", True, "Sum of the lines, before tax"),
            FieldDef("tax", "currency", False, "Tax on the sum"),
            FieldDef("total", "currency", True, "What is to be paid"),
            FieldDef("currency", "string", False, "Code of the currency, such as EUR"),
            FieldDef("payment_terms", "string", False, "How and when to pay"),
        ),
        "An invoice: who bills whom, when, and how much.",
    ),
    Schema(
        "contract",
        "Contract",
        (
            FieldDef("parties", "array", True, "Who signs"),
            FieldDef("effective_date", "date", True, "When it takes effect"),
            FieldDef("termination_clause", "string", True, "How it can be ended"),
            FieldDef("renewal_terms", "string", False, "Whether and how it renews"),
            FieldDef("governing_law", "string", True, "Whose law applies"),
            FieldDef("payment_terms", "string", False, "What is paid and when"),
            FieldDef("obligations", "array", True, "What each party must do"),
            FieldDef("liability_limit", "string", False, "Up to what a party is liable"),
            FieldDef("confidentiality_clause", "string", False, "What must be kept secret"),
            FieldDef("notice_address", "string", False, "Where notices go"),
        ),
        "A contract: who agrees to what, for how long.",
    ),
    Schema(
        "financial_model",
        "Financial Model",
        (
            FieldDef("workbook_summary", "string", True, "What the workbook models"),
            FieldDef("key_sheets", "array", True, "Sheets that matter most"),
            FieldDef("assumption_cells", "array", True, "Cells that hold inputs"),
            FieldDef("revenue_drivers", "array", True, "Cells that drive income"),
            FieldDef("cost_drivers", "array", False, "Cells that drive costs"),
            FieldDef("output_metrics", "array", True, "Cells that hold results"),
            FieldDef("hidden_sheet_warnings", "array", False, "What hidden sheets may conceal"),
        ),
        "A workbook that models finances: its inputs, drivers and results.",
    ),
    Schema(
        "table",
        "Table",
        (
            FieldDef("headers", "array", True, "Names of the columns"),
            FieldDef("rows", "array", True, "The records"),
            FieldDef("row_count", "integer", True, "How many records there are"),
        ),
        "One table as records.",
    ),
    Schema(
        "register_spec",
        "Register Spec",
        (
            FieldDef("register_name", "string", True, "The register's name"),
            FieldDef("base_address", "string", True, "Its address, hexadecimal"),
            FieldDef("register_width", "integer", False, "Its width in bits"),
            FieldDef("description", "string", False, "What it does"),
            FieldDef("bit_fields", "array", True, "Its fields: bits, name, access, reset value"),
        ),
        "One hardware register and its bits.",
    ),
    Schema(
        "data_table",
        "Data Table",
        (
            FieldDef("table_name", "string", False, "The table's title"),
            FieldDef("columns", "array", True, "Names and types of its columns"),
            FieldDef("rows", "array", True, "Its records"),
            FieldDef("row_count", "integer", True, "How many records there are"),
        ),
        "The largest table, with the types of its columns.",
    ),
)
# Synonyms of field labels, in order.
SYNONYMS = {
    "vendor_name": ("vendor", "supplier", "from", "bill from", "sold by"),
    "invoice_number": ("invoice #", "invoice no", "inv no", "inv #", "invoice number"),
    "invoice_date": ("invoice date", "date", "inv date"),
    "due_date": ("due date", "payment due", "due by"),
    "purchase_order": ("po", "po #", "purchase order", "po number"),
    "subtotal": ("subtotal", "sub total", "sub-total"),
    "total": ("total", "amount due", "total due", "total amount", "balance due", "grand total"),
    "tax": ("tax", "vat", "gst", "sales tax", "tax amount"),
    "payment_terms": ("payment terms", "terms", "net 30", "net 60"),
}
AUTO = {"invoice": "invoice", "contract": "contract", "financial_model": "financial_model", "spreadsheet": "financial_model"}


def label_variants(name: str) -> list[str]:
    base = name.replace("_", " ")
    return [base, base.title(), base.upper(), *SYNONYMS.get(name, ())]


class Registry:
    def __init__(self) -> None:
        self._schemas = {s.id: s for s in BUILT_IN}

    def get(self, schema_id: str) -> Schema | None:
        return self._schemas.get(schema_id)

    def register(self, schema: Schema) -> None:
        self._schemas[schema.id] = schema

    def ids(self) -> list[str]:
        return sorted(self._schemas)

    def from_json_schema(self, definition: dict, schema_id: str = "custom") -> Schema:
        """A schema of the definition's properties, registered under schema_id (an earlier one of that id is replaced)."""
        needed = set(definition.get("required", ()))
        fields = []
        for name, p in definition.get("properties", {}).items():
            kind = p.get("type", "string")
            kind = "date" if kind == "string" and p.get("format") == "date" else kind
            extra = {k: p[k] for k in ("enum", "minimum", "maximum", "minLength", "maxLength", "pattern") if k in p}
            fields.append(FieldDef(name, kind, name in needed, p.get("description", ""), extra, p.get("items", {}).get("type")))
        schema = Schema(schema_id, definition.get("title", schema_id), tuple(fields), definition.get("description", ""))
        self.register(schema)
        return schema


def to_json_schema(schema: Schema) -> dict:
    properties = {}
    for f in schema.fields:
        p: dict = {"type": {"date": "string", "currency": "number"}.get(f.field_type, f.field_type)}
        if f.field_type == "date":
            p["format"] = "date"
        if f.description:
            p["description"] = f.description
        if f.items_type:
            p["items"] = {"type": f.items_type}
        properties[f.name] = p | f.constraints
    return {"title": schema.name, "description": schema.description, "type": "object", "properties": properties, "required": [f.name for f in schema.fields if f.required]}


def schema_fields(spark: SparkSession, schemas: list[Schema]) -> DataFrame:
    """(schema_id, ordinal, field, field_type, required): as many rows as fields are defined, fit to be broadcast."""
    rows = [(s.id, k, f.name, f.field_type, f.required) for s in schemas for k, f in enumerate(s.fields)]
    return spark.createDataFrame(rows, "schema_id string, ordinal int, field string, field_type string, required boolean")
