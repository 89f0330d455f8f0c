"""Validation rules over extraction fields; each gives (document_id, severity, rule_name, field, message, status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_number


def _result(rows: DataFrame, severity: str, rule: str, field: Column, message: Column, status: str = "failed") -> DataFrame:
    return rows.select("document_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule_name"), field.alias("field"), message.alias("message"), F.lit(status).alias("status"))


def required(fields: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """Required fields that are missing, and those that are there without a value (the first of a name counts)."""
    needed = schema_fields.where("required").select("schema_id", F.col("field").alias("field_path"))
    first = fields.groupBy("document_id", "schema_id", "field_path").agg(F.min_by("value_kind", "ordinal").alias("value_kind"))
    wanted = fields.select("document_id", "schema_id").distinct().join(F.broadcast(needed), "schema_id")
    both = wanted.join(first, ["document_id", "schema_id", "field_path"], "left")
    name = F.col("field_path")
    missing = _result(both.where("value_kind is null"), "error", "required_field_missing", name, F.concat(F.lit("Required field missing: "), name))
    null = _result(both.where("value_kind = 'null'"), "error", "required_field_null", name, F.concat(F.lit("Required field is null: "), name))
    return missing.unionByName(null)


def types(fields: DataFrame, schema_fields: DataFrame) -> DataFrame:
    kinds = schema_fields.where("field_type in ('number', 'currency', 'integer')").select("schema_id", F.col("field").alias("field_path"), "field_type")
    typed = fields.where("value_kind in ('string', 'list')").join(F.broadcast(kinds), ["schema_id", "field_path"])
    bad = typed.where((F.col("value_kind") == "list") | to_number(F.regexp_replace("value_str", "[,$€]", "")).isNull())
    return _result(bad, "warning", "type_mismatch", F.col("field_path"), F.concat(F.lit("Expected "), "field_type", F.lit(" but got "), F.when(F.col("value_kind") == "list", "list").otherwise("str")))


def citations(fields: DataFrame) -> DataFrame:
    bad = fields.where("value_kind <> 'null' and citation is null")
    return _result(bad, "warning", "missing_citation", F.col("field_path"), F.concat(F.lit("No citation for field: "), "field_path"))


def low_confidence(fields: DataFrame, least: float = 0.5) -> DataFrame:
    bad = fields.where(F.col("value_kind") != "null").where(F.col("confidence") < least)
    return _result(bad, "warning", "low_confidence", F.col("field_path"), F.format_string("Low confidence %.2f", "confidence"))


def arithmetic(fields: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Invoices: subtotal + tax = total. Skipped where a value is there but is no number, silent where subtotal or total is missing."""
    mine = fields.where("schema_id = 'invoice' and field_path in ('subtotal', 'tax', 'total')")
    number = F.coalesce("value_num", to_number(F.regexp_replace("value_str", "[,$]", "")))
    pick = lambda name: [F.max(F.when(F.col("field_path") == name, number)).alias(name), F.max(F.when(F.col("field_path") == name, F.col("value_kind") != "null")).alias(f"has_{name}")]
    rows = mine.groupBy("document_id").agg(*pick("subtotal"), *pick("tax"), *pick("total")).where("has_subtotal and has_total")
    odd = (F.col("subtotal").isNull() | F.col("total").isNull() | (F.coalesce("has_tax", F.lit(False)) & F.col("tax").isNull()))
    gap = F.abs(F.col("subtotal") + F.coalesce("tax", F.lit(0.0)) - F.col("total"))
    name = F.lit("subtotal,tax,total")
    text = F.format_string("subtotal %.2f + tax %.2f vs total %.2f", F.col("subtotal"), F.coalesce("tax", F.lit(0.0)), F.col("total"))
    wrong = _result(rows.where(~odd & (gap > tolerance)), "error", "arithmetic_mismatch", name, text)
    right = _result(rows.where(~odd & (gap <= tolerance)), "info", "arithmetic_valid", name, text, "passed")
    skipped = _result(rows.where(odd), "warning", "arithmetic_check_skipped", name, F.lit("a value is not a number"))
    return wrong.unionByName(right).unionByName(skipped)


def validate(fields: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """All rules, in one pass: the fields of an extraction meet in one row (as many as its schema has), its findings are an array."""
    item = F.struct("ordinal", "field_path", "value_kind", "value_str", "value_num", "confidence", "citation")
    docs = fields.groupBy("document_id", "schema_id").agg(F.sort_array(F.collect_list(item)).alias("f"))
    kinds = schema_fields.groupBy("schema_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "field", "field_type", "required"))).alias("s"))
    docs = docs.join(F.broadcast(kinds), "schema_id", "left").withColumn("s", F.coalesce("s", F.expr("slice(array(struct(0 as ordinal, '' as field, '' as field_type, false as required)), 1, 0)")))

    def finding(severity: str, rule: str, field: Column, message: Column, status: str = "failed") -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule_name"), field.alias("field"), message.alias("message"), F.lit(status).alias("status"))

    first = lambda x: F.try_element_at(F.filter("f", lambda y: y["field_path"] == x["field"]), F.lit(1))["value_kind"]
    missing = F.transform(F.filter("s", lambda x: x["required"] & first(x).isNull()), lambda x: finding("error", "required_field_missing", x["field"], F.concat(F.lit("Required field missing: "), x["field"])))
    null = F.transform(F.filter("s", lambda x: x["required"] & (first(x) == "null")), lambda x: finding("error", "required_field_null", x["field"], F.concat(F.lit("Required field is null: "), x["field"])))
    kind_of = lambda y: F.try_element_at(F.filter("s", lambda x: x["field"] == y["field_path"]), F.lit(1))["field_type"]
    odd = lambda y: (y["value_kind"] == "list") | to_number(F.regexp_replace(y["value_str"], "[,$€]", "")).isNull()
    typed = F.filter("f", lambda y: y["value_kind"].isin("string", "list") & kind_of(y).isin("number", "currency", "integer") & odd(y))
    name = lambda y: F.when(y["value_kind"] == "list", "list").otherwise("str")
    types_ = F.transform(typed, lambda y: finding("warning", "type_mismatch", y["field_path"], F.concat(F.lit("Expected "), kind_of(y), F.lit(" but got "), name(y))))
    cited = F.transform(F.filter("f", lambda y: (y["value_kind"] != "null") & y["citation"].isNull()), lambda y: finding("warning", "missing_citation", y["field_path"], F.concat(F.lit("No citation for field: "), y["field_path"])))
    low = F.transform(F.filter("f", lambda y: (y["value_kind"] != "null") & (y["confidence"] < 0.5)), lambda y: finding("warning", "low_confidence", y["field_path"], F.format_string("Low confidence %.2f", y["confidence"])))
    out = docs.select("document_id", F.explode(F.concat(missing, null, types_, cited, low)).alias("r")).select("document_id", "r.*")
    return out.unionByName(arithmetic(fields.where("schema_id = 'invoice'")))


def passed(results: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, passed, errors, warnings) of every document; no error is a pass."""
    n = results.groupBy("document_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = documents.select("document_id").join(n, "document_id", "left").na.fill(0, ["errors", "warnings"])
    return out.select("document_id", (F.col("errors") == 0).alias("passed"), "errors", "warnings")
