"""Schema-driven extraction: labels in text, table columns, neighbours in sheets, register specs, data tables.

Results are rows (document_id, schema_id, ordinal, field_path, value_kind, value_str, value_num, value_list,
confidence, citation): a tagged union instead of an untyped value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_pattern, strip, to_number
from . import graph
from .schemas import AUTO, Schema, label_variants

FIELDS = "document_id string, schema_id string, ordinal int, field_path string, value_kind string, value_str string, value_num double, value_list array<string>, confidence double, citation string"


def coerce(value: Column, field_type: str) -> tuple[Column, Column]:
    """(kind, number) of a raw value: numbers lose all but digits, dots, signs and commas; what then is no number stays a string."""
    if field_type in ("number", "currency"):
        number = to_number(F.replace(F.regexp_replace(value, r"[^\d.\-,]", ""), F.lit(","), F.lit("")))
    elif field_type == "integer":
        number = to_number(F.regexp_replace(value, r"[^\d\-]", ""))
    else:
        number = F.lit(None).cast("double")
    return F.when(value.isNull(), "null").when(number.isNotNull(), "number").otherwise("string"), number


def auto_schema(classes: DataFrame) -> DataFrame:
    """schema_id by the first of a document's likely types that has one, else table."""
    named = F.transform("likely_document_types", lambda t: F.coalesce(*[F.when(t == k, v) for k, v in AUTO.items()]))
    return classes.select("document_id", F.coalesce(F.try_element_at(F.filter(named, lambda x: x.isNotNull()), F.lit(1)), F.lit("table")).alias("schema_id"))


def text_fields(blocks: DataFrame, schema: Schema, tables: DataFrame | None = None, cells: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Every field of the schema for every document (those of documents, or with blocks): after its label in the text (the first variant with a value), else below it in a table.

    Patterns are literals, compiled once, and tried in turn only where the label occurs; variants that differ in case alone are one."""
    texts = graph.document_texts(blocks)
    if documents is not None:
        texts = documents.select("document_id").join(texts, "document_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    texts = texts.withColumn("folded", F.lower(F.upper("text")))  # holds a label wherever its pattern, which ignores case, can match

    def found(k: int, f) -> Column:
        variants: dict[str, int] = {}
        for place, v in enumerate(label_variants(f.name)):
            variants.setdefault(v.lower(), place)
        place = lambda v, k: F.struct(F.when(F.contains("folded", F.lit(v)), F.regexp_extract("text", label_pattern(v), 1)).alias("raw"), F.lit(k).alias("k"))
        tries = F.array(*(place(v, k) for v, k in variants.items()))
        clean = F.transform(tries, lambda x: F.struct(F.regexp_replace(strip(x["raw"]), "[;,]+$", "").alias("raw"), x["k"].alias("k")))
        best = F.try_element_at(F.filter(clean, lambda x: x["raw"] != ""), F.lit(1))
        return F.struct(F.lit(k).alias("ordinal"), F.lit(f.name).alias("field_path"), F.lit(f.field_type).alias("field_type"), best.alias("best"))

    rows = texts.select("document_id", F.explode(F.array(*(found(k, f) for k, f in enumerate(schema.fields)))).alias("e"))
    rows = rows.select("document_id", "e.ordinal", "e.field_path", "e.field_type", F.col("e.best.raw").alias("value_str"), F.col("e.best.k").alias("k"))
    raw = F.col("value_str")
    number = F.when(F.col("field_type").isin("number", "currency"), coerce(raw, "number")[1]).when(F.col("field_type") == "integer", coerce(raw, "integer")[1])
    kind = F.when(raw.isNull(), "null").when(number.isNotNull(), "number").otherwise("string")
    out = rows.select("document_id", F.lit(schema.id).alias("schema_id"), "ordinal", "field_path", kind.alias("value_kind"), "value_str", number.alias("value_num"), F.when(raw.isNull(), 0.0).when(F.col("k") == 0, 0.85).otherwise(0.6).alias("confidence"))
    out = out.withColumn("value_list", F.lit(None).cast("array<string>")).withColumn("citation", F.when(F.col("value_kind") != "null", "text"))
    if tables is not None and cells is not None:
        cols = column_values(tables, cells, schema).select("document_id", "field_path", F.col("value_list").alias("t_list"))
        out = out.join(cols, ["document_id", "field_path"], "left")
        use = (F.col("value_kind") == "null") & F.col("t_list").isNotNull()
        one = F.size("t_list") == 1
        out = out.withColumn("value_str", F.when(use & one, F.col("t_list")[0]).otherwise(F.col("value_str")))
        out = out.withColumn("value_list", F.when(use & ~one, F.col("t_list")))
        out = out.withColumn("value_kind", F.when(use, F.when(one, "string").otherwise("list")).otherwise(F.col("value_kind")))
        out = out.withColumn("confidence", F.when(use, 0.8).otherwise(F.col("confidence"))).withColumn("citation", F.when(use, "table").otherwise(F.col("citation")))
    return out.select(*[c.split()[0] for c in FIELDS.split(", ")])


def column_values(tables: DataFrame, cells: DataFrame, schema: Schema) -> DataFrame:
    """(document_id, field_path, value_list): the column under the first header that holds a label of the field."""
    heads = cells.where("row_index = 0").join(tables.select("document_id", "table_id", F.col("ordinal").alias("t")), ["document_id", "table_id"])
    tests = [F.when(F.lit(False) if not (vs := sorted({v.lower() for v in label_variants(f.name)})) else _any(F.lower("value"), vs), F.lit(f.name)) for f in schema.fields]
    heads = heads.select("document_id", "table_id", "t", "column_index", F.col("ordinal").alias("h"), F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("field_path"))
    body = cells.where("row_index > 0").select("document_id", "table_id", "column_index", "ordinal", "value")
    lists = heads.join(body, ["document_id", "table_id", "column_index"])
    lists = graph.in_order(lists, ["document_id", "field_path", "t", "h"], ["ordinal"], F.col("value"), "value_list")
    return lists.groupBy("document_id", "field_path").agg(F.min_by("value_list", F.struct("t", "h")).alias("value_list"))


def _any(text: Column, labels: list[str]) -> Column:
    out = F.lit(False)
    for v in labels:
        out = out | F.contains(text, F.lit(v))
    return out


def adjacent_fields(sheets: DataFrame, tables: DataFrame, cells: DataFrame, schema: Schema) -> DataFrame:
    """Every field of the schema for every document with sheets: the value right of a cell that holds the field's name (of the first sheet, its last table, the first such cell), null with confidence 0 where there is none."""
    placed = cells.join(tables.where("sheet_name is not null").select("document_id", "table_id", "sheet_name", F.col("ordinal").alias("t")), ["document_id", "table_id"])
    placed = placed.join(sheets.select("document_id", F.col("name").alias("sheet_name"), F.col("index").alias("s")), ["document_id", "sheet_name"])
    names = [F.when(F.contains(F.lower("value"), F.lit(f.name.replace("_", " "))), F.struct(F.lit(k).alias("ordinal"), F.lit(f.name).alias("field_path"), F.lit(f.field_type).alias("field_type"))) for k, f in enumerate(schema.fields)]
    labels = placed.select("document_id", "table_id", "row_index", (F.col("column_index") + 1).alias("column_index"), "s", "t", F.col("ordinal").alias("c"), F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())).alias("f"))
    right = cells.groupBy("document_id", "table_id", "row_index", "column_index").agg(F.min_by(F.struct("value", "source_cell_ref"), "ordinal").alias("n"))
    found = labels.join(right, ["document_id", "table_id", "row_index", "column_index"])
    best = found.groupBy("document_id", F.col("f.ordinal").alias("ordinal")).agg(F.min_by("n", F.struct("s", (-F.col("t")).alias("t"), "c")).alias("n"))
    fields = F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(f.name).alias("field_path"), F.lit(f.field_type).alias("field_type")) for k, f in enumerate(schema.fields)))
    wanted = sheets.select("document_id").distinct().select("document_id", F.explode(fields).alias("f")).select("document_id", "f.*")
    best = wanted.join(best, ["document_id", "ordinal"], "left")
    value, kind_of = F.col("n.value"), F.col("field_type")
    number = F.when(kind_of.isin("number", "currency"), coerce(value, "number")[1]).when(kind_of == "integer", coerce(value, "integer")[1])
    kind = F.when(F.col("n").isNull(), "null").when(number.isNotNull(), "number").otherwise("string")
    cited = F.when(F.col("n").isNotNull(), F.coalesce(F.concat(F.lit("cell "), "n.source_cell_ref"), F.lit("cell")))
    sure = F.when(F.col("n").isNull(), 0.0).otherwise(0.8)
    return best.select("document_id", F.lit(schema.id).alias("schema_id"), "ordinal", "field_path", kind.alias("value_kind"), value.alias("value_str"), number.alias("value_num"), F.lit(None).cast("array<string>").alias("value_list"), sure.alias("confidence"), cited.alias("citation"))


def warnings(fields: DataFrame, schema: Schema) -> DataFrame:
    """(document_id, schema_id, field_path, message) of required fields without a value."""
    needed = [f.name for f in schema.fields if f.required]
    return fields.where((F.col("value_kind") == "null") & F.col("field_path").isin(*needed)).select("document_id", "schema_id", "field_path", F.concat(F.lit("Required field not found: "), "field_path").alias("message"))


def extraction_id() -> Column:
    """The id of a document's extraction by a schema; the same whenever it is made."""
    return F.substring(F.sha2(F.concat_ws("\n", "document_id", "schema_id"), 256), 1, 16)


# Patterns of register specifications and the headers of bit tables.
REGISTER = {
    "register_name": (r"(?i)(?:register\s*(?:name)?|reg(?:ister)?\s*:)\s*[:\-]?\s*(\S+)", 0.8),
    "base_address": (r"(?i)(?:base\s*)?address\s*[:\-]?\s*(0x[0-9A-Fa-f]+|[0-9A-Fa-f]{4,}h?)", 0.8),
    "register_width": (r"(?i)(?:register\s*)?width\s*[:\-]?\s*(\d+)", 0.7),
    "description": (r"(?i)description\s*[:\-]\s*(.+?)(?:\n|$)", 0.7),
}
BIT_HEADERS = ("bits", "bit", "field", "name", "bit field", "bit range")


def register_fields(blocks: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Register name, address, width and description of each document, and its bit tables' rows as JSON objects."""
    texts = graph.document_texts(blocks)
    entries = []
    for k, (name, (pattern, confidence)) in enumerate(REGISTER.items()):
        raw = F.nullif(strip(F.regexp_extract("text", pattern, 1)), F.lit(""))
        entries.append(F.struct(F.lit(k).alias("ordinal"), F.lit(name).alias("field_path"), F.when(raw.isNull(), "null").otherwise("string").alias("value_kind"), raw.alias("value_str"), F.lit(None).cast("array<string>").alias("value_list"), F.when(raw.isNull(), 0.0).otherwise(confidence).alias("confidence")))
    found = texts.select("document_id", F.explode(F.array(*entries)).alias("e")).select("document_id", "e.*")
    rows = graph.grids(cells, tables)
    heads = rows.where("row_index = 0").where(F.exists("row", lambda h: F.lower(strip(h)).isin(*BIT_HEADERS))).select("document_id", "table_id", F.col("row").alias("head"))
    bits = rows.where("row_index > 0").join(heads, ["document_id", "table_id"]).join(tables.select("document_id", "table_id", F.col("ordinal").alias("t")), ["document_id", "table_id"])
    item = F.to_json(F.map_from_entries(F.array_distinct(F.arrays_zip("head", "row"))))
    lists = graph.in_order(bits, ["document_id"], ["t", "row_index"], item, "value_list")
    fields = texts.select("document_id").join(lists, "document_id", "left").select("document_id", F.lit(4).alias("ordinal"), F.lit("bit_fields").alias("field_path"), F.lit("list").alias("value_kind"), F.lit(None).cast("string").alias("value_str"), F.coalesce("value_list", F.array().cast("array<string>")).alias("value_list"), F.when(F.col("value_list").isNull(), 0.0).otherwise(0.7).alias("confidence"))
    return found.unionByName(fields).select("document_id", F.lit("register_spec").alias("schema_id"), "ordinal", "field_path", "value_kind", "value_str", F.lit(None).cast("double").alias("value_num"), "value_list", "confidence", F.lit(None).cast("string").alias("citation"))


def column_types(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(document_id, table_id, column_index, header, column_type) from the values under row 0."""
    v = strip(F.col("value"))
    number = to_number(F.regexp_replace(v, "[,$%]", "")).isNotNull()
    body = cells.where("row_index > 0").where(v != "").select("document_id", "table_id", "column_index", number.alias("num"), (number & ~F.contains(v, F.lit("."))).alias("whole"), (~number & v.rlike(r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}")).alias("day"))
    n = body.groupBy("document_id", "table_id", "column_index").agg(F.count("*").alias("n"), F.count_if("num").alias("nums"), F.count_if("whole").alias("wholes"), F.count_if("day").alias("days"))
    kind = F.when(F.col("nums") / F.col("n") > 0.7, F.when(F.col("wholes") == F.col("nums"), "integer").otherwise("number")).when(F.col("days") / F.col("n") > 0.5, "date").otherwise("string")
    heads = cells.where("row_index = 0").groupBy("document_id", "table_id", "column_index").agg(F.max_by("value", "ordinal").alias("header"))
    return heads.join(n, ["document_id", "table_id", "column_index"], "left").select("document_id", "table_id", "column_index", "header", F.coalesce(kind, F.lit("string")).alias("column_type"))


def largest_tables(tables: DataFrame) -> DataFrame:
    """The table with the most cells of each document, the first on ties."""
    best = F.max_by(F.struct("table_id", "title", "sheet_name", "row_count", "column_count"), F.struct(F.col("row_count") * F.col("column_count"), -F.col("ordinal")))
    return tables.groupBy("document_id").agg(best.alias("b")).select("document_id", "b.*")


def data_tables(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(document_id, table_name, columns array<struct<name,type>>, row_count): the largest table of each document, described."""
    best = largest_tables(tables)
    mine = cells.join(best.select("document_id", "table_id"), ["document_id", "table_id"], "left_semi")
    columns = graph.in_order(column_types(tables, mine), ["document_id"], ["column_index"], F.struct(F.col("header").alias("name"), F.col("column_type").alias("type")), "columns")
    return best.join(columns, "document_id", "left").select("document_id", F.coalesce("title", "sheet_name", F.lit("Table 1")).alias("table_name"), "columns", (F.col("row_count") - 1).alias("row_count"))


def data_table_fields(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """table_name, columns, rows and row_count of the largest table of each document, as extraction fields; rows are JSON objects by header."""
    best = largest_tables(tables)
    about = data_tables(tables, cells)
    mine = cells.join(best.select("document_id", "table_id"), ["document_id", "table_id"], "left_semi")
    grid = graph.grids(mine, tables.join(best.select("document_id", "table_id"), ["document_id", "table_id"], "left_semi"))
    heads = grid.where("row_index = 0").select("document_id", F.col("row").alias("head"))
    item = F.to_json(F.map_from_entries(F.array_distinct(F.arrays_zip("head", "row"))))
    rows = graph.in_order(grid.where("row_index > 0").join(heads, "document_id"), ["document_id"], ["row_index"], item, "rows")
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    field = lambda k, name, kind, text, number, values, conf, cite: F.struct(F.lit(k).alias("ordinal"), F.lit(name).alias("field_path"), F.lit(kind).alias("value_kind"), text.alias("value_str"), number.alias("value_num"), values.alias("value_list"), F.lit(conf).alias("confidence"), F.lit(cite).cast("string").alias("citation"))
    columns = F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["type"]))
    entries = F.array(
        field(0, "table_name", "string", F.col("table_name"), F.lit(None).cast("double"), F.lit(None).cast("array<string>"), 0.9, None),
        field(1, "columns", "list", none, F.lit(None).cast("double"), F.coalesce(columns, empty), 0.9, "table"),
        field(2, "rows", "list", none, F.lit(None).cast("double"), F.coalesce("rows", empty), 0.9, "table"),
        field(3, "row_count", "number", F.col("row_count").cast("string"), F.col("row_count").cast("double"), F.lit(None).cast("array<string>"), 1.0, None),
    )
    out = about.join(rows, "document_id", "left").select("document_id", F.explode(entries).alias("e"))
    return out.select("document_id", F.lit("data_table").alias("schema_id"), "e.*").select(*[c.split()[0] for c in FIELDS.split(", ")])


def confidence(fields: DataFrame) -> DataFrame:
    """One row an extraction: mean confidence of its fields (zeros count) and its values as a map, the last of equal names."""
    shown = F.coalesce(F.array_join("value_list", "|"), "value_str")
    last = fields.groupBy("document_id", "schema_id", "field_path").agg(F.max_by(shown, "ordinal").alias("v"), F.avg("confidence").alias("c"), F.min("ordinal").alias("o"))
    return last.groupBy("document_id", "schema_id").agg(F.avg("c").alias("confidence"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_path", "v")))).alias("output"))


