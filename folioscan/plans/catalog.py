"""The registered queries of the document operators, each with equivalent SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import a1
from ..functions.text import token_estimate, tokens_of
from ..operators import build, chunk, export, extract, graph, inspect, schemas, search, validate
from ..sources import registry
from .corpora import BLOCKS, BOOKS, INVOICES, PAGE_CELLS, SECTIONS, Corpora

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def query(sql: str | None = None):
    def add(f: Callable[[Corpora], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpora(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def flat(c: str, sep: str = "|"):
    return F.array_join(c, sep).alias(c)


# Search


def _score(text: str, q: str) -> str:
    return " + ".join(f"(length({text}) - length(replace({text}, '{t}', ''))) // {len(t)}" for t in tokens_of(q))


def _search_sql(q: str, where: str = "true", limit: int = 20, offset: int = 0) -> str:
    return f"""WITH {BLOCKS} SELECT document_id, 'text' AS kind, ordinal, substr(text, 1, 200) AS snippet, 'page ' || page_number AS citation, ({_score('lower(text)', q)})::BIGINT AS score
        FROM blocks WHERE {_score('lower(text)', q)} > 0 AND {where} ORDER BY score DESC, document_id, ordinal LIMIT {limit} OFFSET {offset}"""


@query(_search_sql("the"))
def corpus_search_topk(c: Corpora) -> DataFrame:
    return search.search_corpus(c.blocks, None, "the")


@query(_search_sql("the on and on", limit=50))
def corpus_search_multi_token(c: Corpora) -> DataFrame:
    return search.search_corpus(c.blocks, None, "the on and on", max_results=50)


@query(_search_sql("the", "document_id IN (SELECT 'doc-' || doc_id FROM labels WHERE quality = 1)"))
def corpus_search_scoped(c: Corpora) -> DataFrame:
    good = c.table("labels").where("quality = 1").select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"))
    return search.search_corpus(c.blocks, None, "the", good)


@query(_search_sql("and", limit=10, offset=30))
def corpus_search_paged(c: Corpora) -> DataFrame:
    return search.search_corpus(c.blocks, None, "and", max_results=10, offset=30)


@query(f"""WITH {BOOKS} SELECT document_id, 'cell' AS kind, ordinal, substr(value, 1, 200) AS snippet, 'sheet ''Lines'', cell ' || ref AS citation, ({_score('lower(value)', '99')})::BIGINT AS score
    FROM cells WHERE {_score('lower(value)', '99')} > 0 ORDER BY score DESC, document_id, ordinal LIMIT 20""")
def corpus_search_cells(c: Corpora) -> DataFrame:
    return search.search_corpus(None, c.cells.withColumn("sheet_name", F.lit("Lines")), "99")


# Sources


def _types_sql(column: str, pairs: dict[str, str], default: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE '{default}' END"


_PATHS = "SELECT page_id, url || ([{}])[(page_id % 8 + 1)::INT] AS path FROM pages".format(", ".join(f"'{x}'" for x in ("/a.PDF", "/b.xlsx", "/c.csv", "/d.docx", "/e.jpeg", "/f", "/g.zip", "/h.tar.rtf")))


_EXTENSION = r"lower(regexp_extract(path, '(\.[^./]+)$', 1))"


def _paths(c: Corpora) -> DataFrame:
    ends = F.array(*map(F.lit, ("/a.PDF", "/b.xlsx", "/c.csv", "/d.docx", "/e.jpeg", "/f", "/g.zip", "/h.tar.rtf")))
    return c.table("pages").select("page_id", F.concat("url", F.element_at(ends, (F.col("page_id") % 8 + 1).cast("int"))).alias("path"))


@query(f"WITH p AS ({_PATHS}) SELECT page_id, path, {_types_sql(_EXTENSION, schema.FILE_TYPES, 'unknown')} AS file_type FROM p")
def file_type_detect(c: Corpora) -> DataFrame:
    return _paths(c).withColumn("file_type", registry.file_type(F.col("path")))


@query(f"""WITH p AS ({_PATHS}), t AS (SELECT page_id, {_types_sql(_EXTENSION, schema.FILE_TYPES, 'unknown')} AS file_type FROM p)
    SELECT page_id, file_type, {_types_sql('file_type', schema.MIME_TYPES, 'application/octet-stream')} AS mime_type FROM t""")
def mime_map(c: Corpora) -> DataFrame:
    return _paths(c).select("page_id", registry.file_type(F.col("path")).alias("file_type")).withColumn("mime_type", registry.mime_type(F.col("file_type")))


@query(f"""WITH p AS ({_PATHS}), t AS (SELECT {_types_sql(_EXTENSION, schema.FILE_TYPES, 'unknown')} AS file_type FROM p)
    SELECT count(*) AS total_files, count(*) FILTER (file_type IN ('csv', 'xlsx', 'docx', 'pptx', 'rtf')) AS successful, count(*) FILTER (file_type NOT IN ('csv', 'xlsx', 'docx', 'pptx', 'rtf')) AS failed FROM t""")
def batch_summary(c: Corpora) -> DataFrame:
    typed = _paths(c).select(registry.file_type(F.col("path")).alias("file_type"))
    ok = F.col("file_type").isin(*sorted(registry.PARSERS))
    return typed.agg(F.count("*").alias("total_files"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"))


@query("SELECT doc_id, sha256(text) AS checksum FROM documents")
def doc_checksum(c: Corpora) -> DataFrame:
    return c.table("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))


# Building


@query(f"WITH {BLOCKS} SELECT block_id, block_type, font_size FROM blocks")
def block_typing(c: Corpora) -> DataFrame:
    return c.blocks.select("block_id", "block_type", "font_size")


@query(f"""WITH {BLOCKS} SELECT block_id, CASE WHEN ordinal % 20 * 40.0 + 10 < 792 * 0.08 THEN 'header' WHEN ordinal % 20 * 40.0 + 10 > 792 * 0.92 THEN 'footer' ELSE 'paragraph' END AS place FROM blocks""")
def positional_block_class(c: Corpora) -> DataFrame:
    y = F.col("ordinal") % 20 * 40.0
    return c.blocks.select("block_id", build.positional_type(y, y + 20, F.lit(792.0)).alias("place"))


@query(f"""WITH {BLOCKS}, spans AS (SELECT document_id, page_number, font_size, count(*) AS n FROM blocks GROUP BY ALL)
    SELECT document_id, page_number, arg_max(font_size, n * 1000 - font_size) AS font_size FROM spans GROUP BY ALL""")
def dominant_font(c: Corpora) -> DataFrame:
    spans = c.blocks.select(F.concat("document_id", F.lit("#"), "page_number").alias("document_id"), F.col("page_number").alias("block_id"), "font_size")
    return build.dominant_font(spans).select(F.substring_index("document_id", "#", 1).alias("document_id"), F.col("block_id").alias("page_number"), "font_size")


@query(f"""WITH {BLOCKS} SELECT block_id, coalesce(sum(octet_length(encode(text)) + 1) OVER w, 0)::BIGINT AS byte_start, (coalesce(sum(octet_length(encode(text)) + 1) OVER w, 0) + octet_length(encode(text)))::BIGINT AS byte_end
    FROM blocks WINDOW w AS (PARTITION BY document_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def block_byte_offsets(c: Corpora) -> DataFrame:
    return build.byte_offsets(c.blocks).select("block_id", "byte_start", "byte_end")


@query(f"""WITH {BLOCKS} SELECT document_id, page_number AS page, 'POSSIBLY_SCANNED' AS code FROM page_texts WHERE length(text) < 20""")
def scanned_pages(c: Corpora) -> DataFrame:
    return build.scanned_pages(c.blocks, c.pages).select("document_id", "page", "code")


@query(f"WITH {SECTIONS} SELECT section_id, title, heading_level, parent_section_id, start_page, end_page, ordinal FROM sections")
def section_tree(c: Corpora) -> DataFrame:
    return c.sections.select("section_id", "title", "heading_level", "parent_section_id", "start_page", "end_page", "ordinal")


@query(f"WITH {BLOCKS} SELECT document_id, block_id AS target_object_id, 'page' AS citation_type, page_number, substr(text, 1, 200) AS text_snippet, confidence FROM blocks")
def citations_blocks(c: Corpora) -> DataFrame:
    return build.block_citations(c.blocks)


@query(f"WITH {PAGE_CELLS} SELECT document_id, document_id || '-t' AS target_object_id, 'table' AS citation_type, min(page_number) AS page_number, 0.9::DOUBLE AS confidence FROM page_cells GROUP BY document_id")
def citations_tables(c: Corpora) -> DataFrame:
    return build.table_citations(c.page_tables)


@query(f"WITH {BOOKS} SELECT document_id, 'formula' AS citation_type, 'Lines' AS sheet_name, ref AS cell_address, substr(value, 1, 200) AS text_snippet FROM cells WHERE column_index = 3 AND row_index > 0")
def citations_formulas(c: Corpora) -> DataFrame:
    return build.formula_citations(c.formulas)


@query(f"WITH {PAGE_CELLS} SELECT document_id, greatest(count(DISTINCT row_index), max(row_index) + 1)::INT AS row_count, greatest(count(DISTINCT column_index), max(column_index) + 1)::INT AS column_count FROM page_cells GROUP BY document_id")
def cells_to_table(c: Corpora) -> DataFrame:
    return build.sheet_dimensions(c.page_cells).select("document_id", "row_count", "column_count")


@query("SELECT event_id, coalesce((CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END)::VARCHAR, '') AS value FROM events")
def cell_normalise(c: Corpora) -> DataFrame:
    return build.normalised_cells(c.table("events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("value")))


def _classify_sql(text: str) -> str:
    score = lambda k: " + ".join(f"contains(t, '{w}')::INT" for w in schema.KEYWORDS[k])
    cases = ", ".join(f"CASE WHEN {score(k)} >= 2 THEN '{k}' END" for k in ("invoice", "contract", "bank_statement", "resume"))
    return f"SELECT document_id, coalesce(nullif(concat_ws('|', {cases}), ''), 'unknown') AS types FROM (SELECT document_id, lower(text) AS t FROM {text})"


@query(f"WITH {BLOCKS} {_classify_sql('doc_texts')}")
def classify_documents(c: Corpora) -> DataFrame:
    return build.classified(c.documents, c.blocks).select("document_id", F.array_join("likely_document_types", "|").alias("types"))


_KEYWORDY = r"""seeded AS (SELECT 'kw-' || p_partkey AS document_id, p_name || ' ' || ([{}])[(p_partkey % 6 + 1)::INT] AS text FROM part)""".format(
    ", ".join(f"'{x}'" for x in ("Invoice. Bill to: you", "This Agreement and Contract, whereas", "account balance", "education only", "invoice: total due; statement of account", "none")))


@query(f"WITH {_KEYWORDY} {_classify_sql('seeded')}")
def classify_keywords(c: Corpora) -> DataFrame:
    texts = F.array(*map(F.lit, ("Invoice. Bill to: you", "This Agreement and Contract, whereas", "account balance", "education only", "invoice: total due; statement of account", "none")))
    docs = c.table("part").select(F.concat(F.lit("kw-"), "p_partkey").alias("document_id"), F.concat("p_name", F.lit(" "), F.element_at(texts, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("text"), F.lit("pdf").alias("file_type"))
    return build.classified(docs, docs).select("document_id", F.array_join("likely_document_types", "|").alias("types"))


@query(f"""WITH {PAGE_CELLS}, both_ AS (SELECT document_id, confidence AS t, NULL::DOUBLE AS b FROM blocks UNION ALL SELECT DISTINCT document_id, NULL::DOUBLE, 0.9::DOUBLE FROM page_cells)
    SELECT document_id, round(avg(coalesce(t, b)), 6) AS overall, round(avg(t), 6) AS text_confidence, round(coalesce(avg(b), 1.0), 6) AS table_confidence,
           (SELECT count(*) FROM page_texts p WHERE p.document_id = x.document_id AND length(p.text) < 20) AS low FROM both_ x GROUP BY document_id""")
def confidence_summary(c: Corpora) -> DataFrame:
    warnings = build.scanned_pages(c.blocks, c.pages)
    out = build.confidence_summary(c.documents, c.blocks, c.page_tables, warnings)
    return out.select("document_id", *(F.round(x, 6).alias(x) for x in ("overall", "text_confidence", "table_confidence")), F.size("low_confidence_regions").cast("long").alias("low"))


_FORMULAS = r"""made AS (SELECT p_partkey, ([{}])[(p_partkey % 6 + 1)::INT] AS f FROM part)"""
_FORMULA_TEXTS = ("=SUM(A1:B9)+C2", "=Sheet1!A1*2", "=SUM(Data!$A$1:$B$2,X9)", "=LOG10(D4)", "=[budget.xlsx]Sheet1!A1", "=1+2")


@query(f"""WITH {_FORMULAS.format(', '.join(f"'{x}'" for x in _FORMULA_TEXTS))},
    r AS (SELECT *, regexp_replace(f, '{build.RANGE_PATTERN.replace("'", "''")}', '', 'g') AS rest FROM made)
    SELECT p_partkey, array_to_string(regexp_extract_all(f, '{build.RANGE_PATTERN.replace("'", "''")}'), '|') AS referenced_ranges,
           array_to_string(regexp_extract_all(rest, '{build.CELL_PATTERN.replace("'", "''")}'), '|') AS referenced_cells, CASE WHEN contains(f, '[') THEN f ELSE '' END AS external_references FROM r""")
def formula_refs(c: Corpora) -> DataFrame:
    texts = F.array(*map(F.lit, _FORMULA_TEXTS))
    made = c.table("part").select("p_partkey", F.element_at(texts, (F.col("p_partkey") % 6 + 1).cast("int")).alias("formula_text"))
    return build.formula_references(made).select("p_partkey", flat("referenced_ranges"), flat("referenced_cells"), flat("external_references"))


@query(f"WITH {BOOKS} SELECT document_id, 'A1:D' || (max(row_index) + 1) AS used_range FROM cells GROUP BY document_id")
def used_range(c: Corpora) -> DataFrame:
    ends = c.cells.groupBy("document_id").agg(F.max("row_index").alias("r"), F.max("column_index").alias("k"))
    return ends.select("document_id", F.concat(F.lit("A1:"), a1.address(F.col("r") + 1, F.col("k") + 1)).alias("used_range"))


@query("""WITH k AS (SELECT DISTINCT l_orderkey FROM lineitem)
    SELECT 'ord-' || l_orderkey AS document_id, 'HIDDEN_SHEET' AS code, 'Sheet ''Lines'' is hidden' AS message FROM k WHERE l_orderkey % 10 = 0
    UNION ALL SELECT 'ord-' || l_orderkey, 'HIDDEN_ROWS', 'Sheet ''Lines'' has 1 hidden rows' FROM k WHERE l_orderkey % 5 = 0
    UNION ALL SELECT 'ord-' || l_orderkey, 'HIDDEN_COLUMNS', 'Sheet ''Lines'' has 1 hidden columns' FROM k WHERE l_orderkey % 7 = 0""")
def sheet_warnings(c: Corpora) -> DataFrame:
    return build.sheet_warnings(c.sheets).select("document_id", "code", "message")


@query("""WITH n AS (SELECT unnest(range(1, 18279))::INT AS col)
    SELECT col, CASE WHEN col > 702 THEN chr((65 + ((col - 703) // 676) % 26)::INT) ELSE '' END || CASE WHEN col > 26 THEN chr((65 + (((col - 1) // 26) - 1) % 26)::INT) ELSE '' END || chr((65 + (col - 1) % 26)::INT) || '7' AS address, 7 AS row FROM n""")
def a1_roundtrip(c: Corpora) -> DataFrame:
    n = c.spark.range(1, 18279).select(F.col("id").cast("int").alias("n"))
    made = n.select(a1.address(F.lit(7), F.col("n")).alias("address"))
    return made.select(a1.col_of(F.col("address")).alias("col"), "address", a1.row_of(F.col("address")).alias("row"))


# Accessors


@query(f"WITH {BLOCKS} SELECT block_id, text FROM blocks WHERE page_number = 2")
def get_page_blocks(c: Corpora) -> DataFrame:
    return c.blocks.where("page_number = 2").select("block_id", "text")


@query(f"WITH {PAGE_CELLS}, {BOOKS} SELECT document_id, document_id || '-t' AS table_id FROM (SELECT DISTINCT document_id FROM page_cells) UNION ALL SELECT document_id, document_id || '-t0' FROM (SELECT DISTINCT document_id FROM cells)")
def all_tables(c: Corpora) -> DataFrame:
    return c.page_tables.select("document_id", "table_id").unionByName(c.tables.select("document_id", "table_id"))


@query(f"WITH {BOOKS} SELECT document_id, max(row_index) + 1 AS row_count FROM cells WHERE document_id = 'ord-7' GROUP BY document_id")
def table_by_id(c: Corpora) -> DataFrame:
    return c.tables.where("table_id = 'ord-7-t0'").select("document_id", "row_count")


@query("SELECT 'ord-' || l_orderkey AS document_id, l_orderkey % 10 <> 0 AS is_visible FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def sheet_by_name(c: Corpora) -> DataFrame:
    return c.sheets.where("name = 'Lines'").select("document_id", "is_visible")


@query(f"WITH {BLOCKS} SELECT document_id, page_number, md5(text) AS text_md5, length(text)::INT AS chars FROM page_texts")
def page_full_text(c: Corpora) -> DataFrame:
    return graph.page_texts(c.blocks).select("document_id", "page_number", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("chars"))


@query(f"WITH {BLOCKS} SELECT document_id, md5(text) AS text_md5, length(text)::INT AS chars FROM doc_texts")
def document_text(c: Corpora) -> DataFrame:
    return graph.document_texts(c.blocks).select("document_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("chars"))


_GRID = PAGE_CELLS + r""",
    shape AS (SELECT document_id, max(row_index) + 1 AS n_rows, max(column_index) + 1 AS n_cols FROM page_cells GROUP BY ALL),
    places AS (SELECT document_id, r, unnest(range(n_cols)) AS k FROM (SELECT *, unnest(range(n_rows)) AS r FROM shape)),
    dense AS (SELECT p.document_id, p.r::INT AS row_index, string_agg(coalesce(c.value, ''), ' | ' ORDER BY p.k) AS row FROM places p LEFT JOIN page_cells c ON c.document_id = p.document_id AND c.row_index = p.r AND c.column_index = p.k GROUP BY ALL)"""


@query(f"WITH {_GRID} SELECT document_id, row_index, row FROM dense")
def grid_densify(c: Corpora) -> DataFrame:
    return graph.grids(c.page_cells, c.page_tables).select("document_id", "row_index", flat("row", " | "))


@query(f"""WITH {_GRID}, md AS (SELECT d.document_id, row_index, '| ' || row || ' |' || CASE WHEN row_index = 0 THEN chr(10) || '| ' || array_to_string(list_transform(range(n_cols), lambda x: '---'), ' | ') || ' |' ELSE '' END AS line FROM dense d JOIN shape USING (document_id))
    SELECT document_id, string_agg(line, chr(10) ORDER BY row_index) AS markdown FROM md GROUP BY document_id""")
def table_markdown(c: Corpora) -> DataFrame:
    return graph.table_markdown(c.page_cells, c.page_tables).select("document_id", "markdown")


@query(f"WITH {BLOCKS} SELECT block_id, page_number FROM blocks WHERE contains(lower(text), 'license')")
def search_text(c: Corpora) -> DataFrame:
    return graph.search_text(c.blocks, "License").select("block_id", "page_number")


@query(f"WITH {BOOKS} SELECT document_id, ref AS address, value FROM cells WHERE contains(value, '77')")
def search_cells(c: Corpora) -> DataFrame:
    return graph.search_cells(c.cells, c.tables, "77").select("document_id", "address", "value")


@query(f"""WITH {_GRID.replace(BLOCKS, SECTIONS)},
    mds AS (SELECT d.document_id, string_agg('| ' || row || ' |' || CASE WHEN row_index = 0 THEN chr(10) || '| ' || array_to_string(list_transform(range(n_cols), lambda x: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY row_index) AS markdown FROM dense d JOIN shape USING (document_id) GROUP BY d.document_id),
    firsts AS (SELECT document_id, title, arg_min(heading_level, ordinal) AS lv FROM sections GROUP BY ALL),
    rendered AS (
        SELECT document_id, -1 AS a, 0 AS b, 0 AS c, '# ' || filename || chr(10) AS line FROM docs
        UNION ALL SELECT b.document_id, page_number, 0, ordinal, CASE block_type WHEN 'heading' THEN chr(10) || repeat('#', coalesce(f.lv, 2) + 1) || ' ' || text || chr(10) WHEN 'list_item' THEN '- ' || text WHEN 'footnote' THEN chr(10) || '> *' || text || '*' || chr(10) ELSE text END
        FROM blocks b LEFT JOIN firsts f ON f.document_id = b.document_id AND f.title = {STRIP.format('b.text')} WHERE block_type <> 'footer'
        UNION ALL SELECT m.document_id, (SELECT min(page_number) FROM page_cells p WHERE p.document_id = m.document_id), 1, 0, chr(10) || markdown || chr(10) FROM mds m)
    SELECT document_id, md5(string_agg(line, chr(10) ORDER BY a, b, c)) AS markdown_md5 FROM rendered GROUP BY document_id""")
def document_markdown(c: Corpora) -> DataFrame:
    out = graph.document_markdown(c.documents, c.blocks, c.sections, c.page_tables, c.page_cells)
    return out.select("document_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


@query("""SELECT event_id, coalesce(nullif(concat_ws(', ', CASE WHEN event_id % 2 = 0 THEN 'page ' || (event_id % 9) END, CASE WHEN event_id % 3 = 0 THEN 'sheet ''' || event_type || '''' END,
    CASE WHEN event_id % 5 = 0 THEN 'cell B' || (event_id % 50) END, CASE WHEN event_id % 7 = 0 THEN 'range A1:C9' END, CASE WHEN event_id % 11 = 0 THEN 'bytes ' || event_id || '-' || (event_id + 10) END), ''), 'unknown location') AS ref FROM events""")
def citation_short_ref(c: Corpora) -> DataFrame:
    e = F.col("event_id")
    return c.table("events").select("event_id", graph.short_ref(F.when(e % 2 == 0, e % 9), F.when(e % 3 == 0, F.col("event_type")), F.when(e % 5 == 0, F.concat(F.lit("B"), e % 50)), F.when(e % 7 == 0, F.lit("A1:C9")), F.when(e % 11 == 0, e), F.when(e % 11 == 0, e + 10)).alias("ref"))


# Tools


@query(f"""WITH {PAGE_CELLS} SELECT d.document_id, filename, page_count, page_count >= 3 AS has_scanned_pages, EXISTS (FROM page_cells p WHERE p.document_id = d.document_id) AS has_tables, substr(d.document_id, 5)::BIGINT % 7 = 0 AS has_images,
    false AS has_formulas, (SELECT round(avg(coalesce(t, b)), 6) FROM (SELECT confidence AS t, NULL::DOUBLE AS b FROM blocks x WHERE x.document_id = d.document_id UNION ALL (SELECT NULL, 0.9::DOUBLE FROM page_cells y WHERE y.document_id = d.document_id LIMIT 1))) AS overall,
    CASE WHEN EXISTS (FROM page_cells p WHERE p.document_id = d.document_id) THEN 'list_structure|get_table|get_page|search_document|extract' ELSE 'list_structure|get_page|search_document|extract' END AS recommended_tools FROM docs d""")
def profile(c: Corpora) -> DataFrame:
    classes = build.classified(c.documents, c.blocks)
    conf = build.confidence_summary(c.documents, c.blocks, c.page_tables, build.scanned_pages(c.blocks, c.pages))
    none = c.sheets.where("false")
    out = inspect.profile(c.documents, c.pages, c.page_tables, c.figures, c.formulas.where("false"), none, classes, conf)
    return out.select("document_id", "filename", "page_count", "has_scanned_pages", "has_tables", "has_images", "has_formulas", F.round("overall", 6).alias("overall"), flat("recommended_tools"))


@query(f"""WITH {SECTIONS} SELECT document_id, coalesce((SELECT string_agg(section_id || ':' || heading_level, '|' ORDER BY ordinal) FROM sections s WHERE s.document_id = d.document_id), '') AS sections,
    (SELECT string_agg(page_number || ':' || n, '|' ORDER BY page_number) FROM (SELECT page_number, count(*) AS n FROM blocks b WHERE b.document_id = d.document_id GROUP BY 1)) AS pages FROM docs d""")
def structure(c: Corpora) -> DataFrame:
    out = inspect.structure(c.documents, c.sections, c.blocks, c.page_tables, c.sheets.where("false"))
    part = lambda n, a, b: F.coalesce(F.array_join(F.transform(n, lambda x: F.concat(x[a].cast("string"), F.lit(":"), x[b].cast("string"))), "|"), F.lit("")).alias(n)
    return out.select("document_id", part("sections", "section_id", "heading_level"), part("pages", "page_number", "text_blocks"))


@query(f"""WITH {BLOCKS} SELECT document_id, 'text' AS category, k::INT AS k, substr(text, 1, 500) AS match, 'page ' || page_number AS location
    FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS k FROM blocks WHERE contains(lower(text), 'tion')) WHERE k <= 5""")
def search_document(c: Corpora) -> DataFrame:
    return inspect.search_document(c.blocks, c.page_cells.where("false"), c.page_tables.where("false"), "tion", 5)


@query(f"""WITH {BOOKS}, m AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS k FROM cells WHERE contains(lower(value), 'tity'))
    SELECT document_id, 'cell' AS category, k::INT AS k, value AS match, 'sheet ''Lines'', cell ' || ref AS location FROM m WHERE k <= 20
    UNION ALL SELECT document_id, 'table', 1, 'Quantity', 'table ' || document_id || '-t0' FROM (SELECT DISTINCT document_id FROM cells)""")
def search_workbook(c: Corpora) -> DataFrame:
    return inspect.search_document(c.blocks.where("false"), c.cells, c.tables, "tity")


@query(f"""WITH {BLOCKS} SELECT d.document_id, page_count::BIGINT AS page_count, CASE WHEN page_count >= 2 THEN md5(coalesce(p.text, '')) END AS text_md5, CASE WHEN page_count < 2 THEN 'Page 2 not found' END AS error
    FROM docs d LEFT JOIN page_texts p ON p.document_id = d.document_id AND p.page_number = 2""")
def get_page(c: Corpora) -> DataFrame:
    return inspect.get_page(c.pages, c.blocks, 2).select("document_id", "page_count", F.md5(F.col("text").cast("binary")).alias("text_md5"), "error")


@query(f"""WITH {BOOKS}, rows_ AS (SELECT row_index, string_agg(value, ' | ' ORDER BY column_index) AS row FROM cells WHERE document_id = 'ord-7' GROUP BY 1)
    SELECT 'ord-7' AS document_id, string_agg('| ' || row || ' |' || CASE WHEN row_index = 0 THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END, chr(10) ORDER BY row_index) AS markdown, count(*)::INT AS rows FROM rows_ HAVING count(*) > 0""")
def get_table(c: Corpora) -> DataFrame:
    return inspect.get_table(c.tables, c.cells, "ord-7-t0").select("document_id", "markdown", F.size("data").alias("rows"))


@query("""SELECT 'ord-' || l_orderkey AS document_id, 'Lines' AS name, (count(*) + 1)::INT AS row_count, 1::BIGINT AS tables, count(*) AS formulas, (l_orderkey % 5 = 0)::INT AS hidden_rows FROM lineitem GROUP BY l_orderkey""")
def list_sheets(c: Corpora) -> DataFrame:
    return inspect.list_sheets(c.sheets, c.tables, c.formulas).select("document_id", "name", "row_count", "tables", "formulas", "hidden_rows")


@query(f"""WITH {BOOKS} SELECT document_id, ref AS address, value, CASE WHEN column_index = 3 AND row_index > 0 THEN value END AS formula, (l_orderkey % 5 = 0 AND row_index = 2) OR (l_orderkey % 7 = 0 AND column_index = 1) AS is_hidden, false AS is_merged
    FROM cells WHERE row_index BETWEEN 1 AND 3 AND column_index BETWEEN 1 AND 3""")
def read_range(c: Corpora) -> DataFrame:
    return inspect.read_range(c.cells, c.tables, c.sheets, c.formulas, "Lines", "B2:D4").select("document_id", "address", "value", "formula", "is_hidden", "is_merged")


@query(f"""WITH {BOOKS}, m AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS k FROM cells WHERE contains(lower(value), '50'))
    SELECT document_id, k::INT AS k, ref AS address, value, CASE WHEN column_index = 3 AND row_index > 0 THEN value END AS formula,
           (SELECT string_agg(x.ref || '=' || x.value, '; ' ORDER BY x.column_index) FROM cells x WHERE x.document_id = m.document_id AND x.row_index = m.row_index) AS row_context FROM m WHERE k <= 3""")
def find_cells(c: Corpora) -> DataFrame:
    return inspect.find_cells(c.cells, c.tables, c.formulas, "50", max_results=3).select("document_id", "k", "address", "value", "formula", "row_context")


@query(f"""WITH {BOOKS} SELECT document_id, value AS formula_text, 'B2|C2' AS referenced_cells, '' AS dependents FROM cells WHERE column_index = 3 AND row_index = 1""")
def inspect_formula(c: Corpora) -> DataFrame:
    return inspect.inspect_formula(c.formulas, "Lines", "d2").select("document_id", "formula_text", flat("referenced_cells"), flat("dependents"))


@query(f"""WITH {BOOKS} SELECT document_id, chr(65 + column_index) || (row_index + 1) AS cell, 1::BIGINT AS dependents FROM cells WHERE row_index > 0 AND column_index IN (1, 2)""")
def formula_dependents(c: Corpora) -> DataFrame:
    return inspect.dependents(c.formulas).select("document_id", "cell", "dependents")


@query("""SELECT page_id, concat_ws('|', CASE WHEN k = 'pdf' THEN 'list_structure' END, CASE WHEN k = 'pdf' AND t THEN 'get_table' END, CASE WHEN k = 'pdf' THEN 'get_page|search_document' END, CASE WHEN k IN ('xlsx', 'csv') THEN 'list_sheets|read_range|find_cells' END,
    CASE WHEN k IN ('xlsx', 'csv') AND f THEN 'inspect_formula' END, 'extract') AS tools FROM (SELECT page_id, (['pdf', 'xlsx', 'csv', 'rtf'])[(page_id % 4 + 1)::INT] AS k, page_id % 3 = 0 AS t, page_id % 5 = 0 AS f FROM pages)""")
def recommend_tools(c: Corpora) -> DataFrame:
    p = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "xlsx", "csv", "rtf"))), (p % 4 + 1).cast("int"))
    return c.table("pages").select("page_id", F.array_join(inspect.recommended(kind, p % 3 == 0, p % 5 == 0), "|").alias("tools"))


# Chunks


@query("SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents")
def token_estimates(c: Corpora) -> DataFrame:
    return c.table("documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query(f"""WITH {BLOCKS}, starts AS (SELECT document_id, text, unnest(range(0, length(text), 600)) AS s FROM doc_texts WHERE {STRIP.format('text')} <> ''),
    cut AS (SELECT document_id, (s // 600)::INT AS ordinal, {STRIP.format('substr(text, s + 1, 800)')} AS chunk FROM starts),
    heads AS (SELECT document_id, page_number, unnest(list_filter(string_split(text, chr(10))[1:3], lambda x: {STRIP.format('x')} <> '')) AS head FROM page_texts)
    SELECT document_id, ordinal, chunk AS text, coalesce((SELECT string_agg(page_number, ',' ORDER BY page_number) FROM (SELECT DISTINCT page_number FROM heads h WHERE h.document_id = c.document_id AND contains(c.chunk, h.head))), '') AS page_numbers, greatest(1, length(chunk) // 4)::INT AS token_count FROM cut c WHERE chunk <> ''""")
def chunk_fixed(c: Corpora) -> DataFrame:
    return chunk.fixed_size(c.blocks, chunk.Chunking("fixed_size", 200, 50)).select("document_id", "ordinal", "text", flat("page_numbers", ","), "token_count")


@query(f"""WITH RECURSIVE {SECTIONS},
    kept AS (SELECT *, sum((block_type = 'heading')::INT) OVER (PARTITION BY document_id ORDER BY ordinal) AS seg FROM blocks WHERE block_type <> 'footer'),
    placed AS (SELECT *, row_number() OVER (PARTITION BY document_id, seg ORDER BY ordinal) AS k, count(*) OVER (PARTITION BY document_id, seg) AS n FROM kept),
    walk AS (
        SELECT document_id, seg, k, n, text AS cur, text AS last, length(text) AS size, CASE WHEN length(text) >= 400 THEN text END AS out FROM placed WHERE k = 1
        UNION ALL
        SELECT p.document_id, p.seg, p.k, p.n,
               CASE WHEN w.out IS NULL THEN w.cur || chr(10) || p.text WHEN w.last = '' THEN p.text ELSE w.last || chr(10) || p.text END,
               p.text,
               CASE WHEN w.out IS NULL THEN w.size ELSE length(w.last) END + length(p.text),
               CASE WHEN CASE WHEN w.out IS NULL THEN w.size ELSE length(w.last) END + length(p.text) >= 400
                    THEN CASE WHEN w.out IS NULL THEN w.cur || chr(10) || p.text WHEN w.last = '' THEN p.text ELSE w.last || chr(10) || p.text END END
        FROM walk w JOIN placed p ON p.document_id = w.document_id AND p.seg = w.seg AND p.k = w.k + 1),
    emitted AS (SELECT document_id, seg, k AS turn, out AS t FROM walk WHERE out IS NOT NULL UNION ALL SELECT document_id, seg, k + 1, CASE WHEN out IS NULL THEN cur ELSE last END FROM walk WHERE k = n)
    SELECT document_id, seg::BIGINT AS segment, (row_number() OVER (PARTITION BY document_id, seg ORDER BY turn) - 1)::INT AS ordinal, {STRIP.format('t')} AS text, greatest(1, length({STRIP.format('t')}) // 4)::INT AS token_count FROM emitted WHERE {STRIP.format('t')} <> ''""")
def chunk_section(c: Corpora) -> DataFrame:
    return chunk.section_aware(c.blocks, c.sections, chunk.Chunking(max_chunk_size=100)).select("document_id", "segment", "ordinal", "text", "token_count")


@query(f"""WITH {_GRID}, md AS (SELECT d.document_id, row_index, '| ' || row || ' |' || CASE WHEN row_index = 0 THEN chr(10) || '| ' || array_to_string(list_transform(range(n_cols), lambda x: '---'), ' | ') || ' |' ELSE '' END AS line FROM dense d JOIN shape USING (document_id)),
    t AS (SELECT document_id, string_agg(line, chr(10) ORDER BY row_index) AS text FROM md GROUP BY document_id)
    SELECT document_id, text, 'table' AS chunk_type, greatest(1, length(text) // 4)::INT AS token_count FROM t""")
def chunk_tables(c: Corpora) -> DataFrame:
    return chunk.tables_only(c.page_tables, c.page_cells, c.sections).select("document_id", "text", "chunk_type", "token_count")


@query(f"WITH {SECTIONS} SELECT section_id, array_to_string(section_path, ' > ') AS section_path FROM paths")
def section_path(c: Corpora) -> DataFrame:
    return chunk.section_paths(c.sections).select("section_id", flat("section_path", " > "))


@query(f"""WITH {SECTIONS}, pages_ AS (SELECT DISTINCT document_id, page_number FROM blocks), hits AS (SELECT p.document_id, p.page_number, s.section_path, row_number() OVER (PARTITION BY p.document_id, p.page_number ORDER BY s.heading_level DESC, s.ordinal) AS k
    FROM pages_ p JOIN paths s ON s.document_id = p.document_id AND p.page_number BETWEEN s.start_page AND s.end_page)
    SELECT p.document_id, p.page_number, coalesce(array_to_string(h.section_path, ' > '), '') AS section_path FROM pages_ p LEFT JOIN hits h ON h.document_id = p.document_id AND h.page_number = p.page_number AND h.k = 1""")
def section_path_by_page(c: Corpora) -> DataFrame:
    return chunk.path_by_page(c.sections, c.pages).select("document_id", "page_number", flat("section_path", " > "))


# Extraction


def _invoice() -> schemas.Schema:
    return schemas.Registry().get("invoice")


def _variant_sql(name: str) -> tuple[str, str]:
    """(raw value, index of the variant) of a field, first variant with a value."""
    raws = []
    for label in schemas.label_variants(name):
        quoted = "".join("\\" + ch if ch in "#.+*?()[]{}|^$-" else ch for ch in label)
        pattern = f"(?i){quoted}\\s*[:\\-]?\\s*(.{{1,500}}?)(?:\\n|$)"
        raws.append(f"nullif(regexp_replace({STRIP.format(f'''regexp_extract(text, '{pattern}', 1)''')}, '[;,]+$', ''), '')")
    index = "CASE " + " ".join(f"WHEN {r} IS NOT NULL THEN {k}" for k, r in enumerate(raws)) + " END"
    return f"coalesce({', '.join(raws)})", index


def _number_sql(raw: str, kind: str) -> str:
    if kind in ("number", "currency"):
        return rf"TRY_CAST(replace(regexp_replace({raw}, '[^\d.\-,]', '', 'g'), ',', '') AS DOUBLE)"
    if kind == "integer":
        return rf"TRY_CAST(regexp_replace({raw}, '[^\d\-]', '', 'g') AS DOUBLE)"
    return "NULL::DOUBLE"


def _fields_sql() -> str:
    parts = []
    for k, f in enumerate(_invoice().fields):
        raw, index = _variant_sql(f.name)
        parts.append(f"SELECT document_id, {k} AS ordinal, '{f.name}' AS field_path, raw AS value_str, {_number_sql('raw', f.field_type)} AS value_num, CASE WHEN raw IS NULL THEN 0.0 WHEN i = 0 THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence FROM (SELECT document_id, {raw} AS raw, {index} AS i FROM texts)")
    return f"{INVOICES}, fields_raw AS ({' UNION ALL '.join(parts)}), fields AS (SELECT *, CASE WHEN value_str IS NULL THEN 'null' WHEN value_num IS NOT NULL THEN 'number' ELSE 'string' END AS value_kind FROM fields_raw)"


_FIELDS = _fields_sql()


def _fields(c: Corpora) -> DataFrame:
    return extract.text_fields(c.invoices, _invoice())


@query(f"WITH {_FIELDS} SELECT document_id, ordinal, field_path, value_kind, value_str, value_num, confidence FROM fields")
def extract_text_invoice(c: Corpora) -> DataFrame:
    return _fields(c).select("document_id", "ordinal", "field_path", "value_kind", "value_str", "value_num", "confidence")


@query(f"WITH {_FIELDS} SELECT document_id, round(avg(confidence), 6) AS confidence, string_agg(field_path || '=' || coalesce(value_str, ''), '|' ORDER BY field_path) AS output FROM fields GROUP BY document_id")
def extraction_summary(c: Corpora) -> DataFrame:
    out = extract.confidence(_fields(c))
    return out.select("document_id", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform(F.map_entries("output"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "|").alias("output"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f.name}', {k}, '{label}')" for f in _invoice().fields for k, label in enumerate(schemas.label_variants(f.name))) + ") v(field, i, label)")
def label_variants(c: Corpora) -> DataFrame:
    names = c.spark.createDataFrame([(f.name, schemas.label_variants(f.name)) for f in _invoice().fields], "field string, labels array<string>")
    return names.select("field", F.posexplode("labels").alias("i", "label"))


@query(r"""SELECT p_partkey, TRY_CAST(replace(regexp_replace(v, '[^\d.\-,]', '', 'g'), ',', '') AS DOUBLE) AS number, TRY_CAST(regexp_replace(v, '[^\d\-]', '', 'g') AS DOUBLE) AS whole
    FROM (SELECT p_partkey, (['$' || p_size || ',500.25', 'about ' || p_size, 'n/a', '-' || p_size || '%'])[(p_partkey % 4 + 1)::INT] AS v FROM part)""")
def coerce_values(c: Corpora) -> DataFrame:
    size = F.col("p_size")
    texts = F.array(F.concat(F.lit("$"), size, F.lit(",500.25")), F.concat(F.lit("about "), size), F.lit("n/a"), F.concat(F.lit("-"), size, F.lit("%")))
    v = F.element_at(texts, (F.col("p_partkey") % 4 + 1).cast("int"))
    return c.table("part").select("p_partkey", extract.coerce(v, "number")[1].alias("number"), extract.coerce(v, "integer")[1].alias("whole"))


@query(f"WITH {BOOKS} SELECT document_id, 'total' AS field_path, string_agg(value, '|' ORDER BY ordinal) AS value_list FROM cells WHERE column_index = 3 AND row_index > 0 GROUP BY document_id")
def extract_table_column(c: Corpora) -> DataFrame:
    return extract.column_values(c.tables, c.cells, _invoice()).select("document_id", "field_path", flat("value_list"))


_NEIGHBOURS = """pairs AS (SELECT 'nb-' || s_suppkey AS document_id, unnest(['Vendor Name', 'Invoice Number', 'Total']) AS label, unnest([s_name, 'INV ' || s_suppkey, s_acctbal::DECIMAL(18,2)::VARCHAR]) AS value FROM supplier)"""


@query(f"""WITH {_NEIGHBOURS}, named AS (SELECT document_id, CASE label WHEN 'Vendor Name' THEN 'vendor_name' WHEN 'Invoice Number' THEN 'invoice_number' ELSE 'total' END AS field_path, value FROM pairs),
    wanted AS (SELECT 'nb-' || s_suppkey AS document_id, unnest(['vendor_name', 'vendor_address', 'invoice_number', 'invoice_date', 'due_date', 'purchase_order', 'line_items', 'subtotal', 'tax', 'total', 'currency', 'payment_terms']) AS field_path FROM supplier)
    SELECT document_id, field_path, value AS value_str, CASE WHEN field_path = 'total' THEN value::DOUBLE END AS value_num, CASE WHEN value IS NULL THEN 0.0 ELSE 0.8 END::DOUBLE AS confidence,
           CASE WHEN value IS NULL THEN 'null' WHEN field_path = 'total' THEN 'number' ELSE 'string' END AS value_kind FROM wanted LEFT JOIN named USING (document_id, field_path)""")
def extract_adjacent(c: Corpora) -> DataFrame:
    rows = c.table("supplier").select(F.concat(F.lit("nb-"), "s_suppkey").alias("document_id"), F.posexplode(F.array(
        F.array(F.lit("Vendor Name"), "s_name"), F.array(F.lit("Invoice Number"), F.concat(F.lit("INV "), "s_suppkey")), F.array(F.lit("Total"), F.col("s_acctbal").cast("decimal(18,2)").cast("string")))).alias("row_index", "row"))
    cells = rows.select("document_id", F.lit("t").alias("table_id"), "row_index", F.posexplode("row").alias("column_index", "value")).withColumn("ordinal", F.col("row_index") * 2 + F.col("column_index")).withColumn("source_cell_ref", a1.address(F.col("row_index") + 1, F.col("column_index") + 1))
    tables = rows.select("document_id").distinct().select("document_id", F.lit("t").alias("table_id"), F.lit("S").alias("sheet_name"), F.lit(0).alias("ordinal"))
    sheets = tables.select("document_id", F.col("sheet_name").alias("name"), F.lit(0).alias("index"))
    return extract.adjacent_fields(sheets, tables, cells, _invoice()).select("document_id", "field_path", "value_str", "value_num", "confidence", "value_kind")


@query("""SELECT 'reg-' || p_partkey AS document_id, f AS field_path, v AS value_str FROM (SELECT p_partkey, unnest(['register_name', 'base_address', 'register_width', 'description']) AS f,
    unnest(['CTRL_' || p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '0x' || (p_partkey * 16) END, p_size::VARCHAR, p_name]) AS v FROM part)""")
def extract_register(c: Corpora) -> DataFrame:
    text = F.concat_ws("\n", F.concat(F.lit("Register: CTRL_"), "p_partkey"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("Address: 0x"), F.col("p_partkey") * 16)), F.concat(F.lit("Width: "), "p_size"), F.concat(F.lit("Description: "), "p_name"))
    blocks = c.table("part").select(F.concat(F.lit("reg-"), "p_partkey").alias("document_id"), F.lit(1).alias("page_number"), F.lit(0).alias("reading_order_index"), F.lit(0).alias("ordinal"), text.alias("text"))
    out = extract.register_fields(blocks, c.page_tables.where("false"), c.page_cells.where("false"))
    return out.where("field_path <> 'bit_fields'").select("document_id", "field_path", "value_str")


@query(f"""WITH {BOOKS} SELECT document_id, 'Lines' AS table_name, 'Line:integer|Quantity:integer|Price:' || CASE WHEN bool_and(NOT contains(value, '.')) FILTER (column_index = 2 AND row_index > 0) THEN 'integer' ELSE 'number' END || '|Total:string' AS columns, max(row_index)::INT AS row_count FROM cells GROUP BY document_id""")
def data_table_infer(c: Corpora) -> DataFrame:
    out = extract.data_tables(c.tables, c.cells)
    return out.select("document_id", "table_name", F.array_join(F.transform("columns", lambda x: F.concat(x["name"], F.lit(":"), x["type"])), "|").alias("columns"), "row_count")


@query(f"""WITH {PAGE_CELLS}, v AS (SELECT document_id, column_index, {STRIP.format('value')} AS v FROM page_cells WHERE row_index > 0),
    s AS (SELECT document_id, column_index, regexp_matches(regexp_replace(v, '[,$%]', '', 'g'), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') AS num, contains(v, '.') AS dot, regexp_matches(v, '^\\d{{1,4}}[-/]\\d{{1,2}}[-/]\\d{{1,4}}') AS day FROM v WHERE v <> ''),
    n AS (SELECT document_id, column_index, count(*) AS n, count(*) FILTER (num) AS nums, count(*) FILTER (num AND NOT dot) AS wholes, count(*) FILTER (NOT num AND day) AS days FROM s GROUP BY ALL)
    SELECT h.document_id, h.column_index, CASE WHEN nums / n > 0.7 THEN CASE WHEN wholes = nums THEN 'integer' ELSE 'number' END WHEN days / n > 0.5 THEN 'date' ELSE 'string' END AS column_type FROM (SELECT document_id, column_index FROM page_cells WHERE row_index = 0) h LEFT JOIN n USING (document_id, column_index)""")
def column_types(c: Corpora) -> DataFrame:
    return extract.column_types(c.page_tables, c.page_cells).select("document_id", "column_index", "column_type")


@query(f"""WITH {_KEYWORDY}, t AS ({_classify_sql('seeded')}) SELECT document_id, CASE WHEN contains(types, 'invoice') THEN 'invoice' WHEN contains(types, 'contract') THEN 'contract' ELSE 'table' END AS schema_id FROM t""")
def schema_autodetect(c: Corpora) -> DataFrame:
    return extract.auto_schema(classify_keywords(c).select("document_id", F.split("types", "\\|").alias("likely_document_types")))


# Schemas

_ALL = [schemas.Registry().get(k) for k in schemas.Registry().ids()]


# The expected fields, written out.
_CATALOG = """(VALUES
    ('invoice', 0, 'vendor_name', 'string', true),
    ('invoice', 1, 'vendor_address', 'string', false),
    ('invoice', 2, 'invoice_number', 'string', true),
    ('invoice', 3, 'invoice_date', 'date', true),
    ('invoice', 4, 'due_date', 'date', false),
    ('invoice', 5, 'purchase_order', 'string', false),
    ('invoice', 6, 'line_items', 'array', true),
    ('invoice', 7, 'subtotal', 'currency', true),
    ('invoice', 8, 'tax', 'currency', false),
    ('invoice', 9, 'total', 'currency', true),
    ('invoice', 10, 'currency', 'string', false),
    ('invoice', 11, 'payment_terms', 'string', false),
    ('contract', 0, 'parties', 'array', true),
    ('contract', 1, 'effective_date', 'date', true),
    ('contract', 2, 'termination_clause', 'string', true),
    ('contract', 3, 'renewal_terms', 'string', false),
    ('contract', 4, 'governing_law', 'string', true),
    ('contract', 5, 'payment_terms', 'string', false),
    ('contract', 6, 'obligations', 'array', true),
    ('contract', 7, 'liability_limit', 'string', false),
    ('contract', 8, 'confidentiality_clause', 'string', false),
    ('contract', 9, 'notice_address', 'string', false),
    ('financial_model', 0, 'workbook_summary', 'string', true),
    ('financial_model', 1, 'key_sheets', 'array', true),
    ('financial_model', 2, 'assumption_cells', 'array', true),
    ('financial_model', 3, 'revenue_drivers', 'array', true),
    ('financial_model', 4, 'cost_drivers', 'array', false),
    ('financial_model', 5, 'output_metrics', 'array', true),
    ('financial_model', 6, 'hidden_sheet_warnings', 'array', false),
    ('table', 0, 'headers', 'array', true),
    ('table', 1, 'rows', 'array', true),
    ('table', 2, 'row_count', 'integer', true),
    ('register_spec', 0, 'register_name', 'string', true),
    ('register_spec', 1, 'base_address', 'string', true),
    ('register_spec', 2, 'register_width', 'integer', false),
    ('register_spec', 3, 'description', 'string', false),
    ('register_spec', 4, 'bit_fields', 'array', true),
    ('data_table', 0, 'table_name', 'string', false),
    ('data_table', 1, 'columns', 'array', true),
    ('data_table', 2, 'rows', 'array', true),
    ('data_table', 3, 'row_count', 'integer', true)
) v(schema_id, ordinal, field, field_type, required)"""


@query(f"SELECT * FROM {_CATALOG}")
def schema_catalog(c: Corpora) -> DataFrame:
    return schemas.schema_fields(c.spark, _ALL)


@query(f"SELECT schema_id, field, CASE WHEN field_type = 'currency' THEN 'number' ELSE field_type END AS field_type, required FROM {_CATALOG}")
def json_schema_roundtrip(c: Corpora) -> DataFrame:
    registry_ = schemas.Registry()
    again = [registry_.from_json_schema(json.loads(json.dumps(schemas.to_json_schema(s))), s.id) for s in _ALL]
    return schemas.schema_fields(c.spark, again).select("schema_id", "field", "field_type", "required")


# Validation


def _schema_fields(c: Corpora) -> DataFrame:
    return schemas.schema_fields(c.spark, [_invoice()])


_NEEDED = ", ".join(f"'{f.name}'" for f in _invoice().fields if f.required)


@query(f"WITH {_FIELDS} SELECT document_id, 'error' AS severity, 'required_field_missing' AS rule_name, f AS field FROM (SELECT DISTINCT document_id FROM fields), (SELECT unnest([{_NEEDED}]) AS f) WHERE f IN ('line_items', 'total')")
def validate_required_missing(c: Corpora) -> DataFrame:
    some = _fields(c).where("field_path not in ('line_items', 'total')")
    return validate.required(some, _schema_fields(c)).where("rule_name = 'required_field_missing'").select("document_id", "severity", "rule_name", "field")


@query(f"WITH {_FIELDS} SELECT document_id, 'error' AS severity, field_path AS field, 'Required field is null: ' || field_path AS message FROM fields WHERE value_kind = 'null' AND field_path IN ({_NEEDED})")
def validate_required_null(c: Corpora) -> DataFrame:
    return validate.required(_fields(c), _schema_fields(c)).where("rule_name = 'required_field_null'").select("document_id", "severity", "field", "message")


@query(rf"""WITH {_FIELDS}, broken AS (SELECT *, CASE WHEN ordinal = 9 AND substr(document_id, 5)::BIGINT % 6 = 0 THEN 'unknown' ELSE value_str END AS v, CASE WHEN ordinal = 9 AND substr(document_id, 5)::BIGINT % 6 = 0 THEN 'string' ELSE value_kind END AS k FROM fields)
    SELECT document_id, field_path AS field, 'Expected currency but got str' AS message FROM broken WHERE k = 'string' AND field_path IN ('subtotal', 'tax', 'total') AND TRY_CAST(regexp_replace(v, '[,$€]', '', 'g') AS DOUBLE) IS NULL""")
def validate_types(c: Corpora) -> DataFrame:
    bad = (F.col("ordinal") == 9) & (F.substring("document_id", 5, 20).cast("long") % 6 == 0)
    fields = _fields(c).withColumn("value_str", F.when(bad, "unknown").otherwise(F.col("value_str"))).withColumn("value_kind", F.when(bad, "string").otherwise(F.col("value_kind")))
    return validate.types(fields, _schema_fields(c)).select("document_id", "field", "message")


@query(f"WITH {_FIELDS} SELECT document_id, field_path AS field, 'No citation for field: ' || field_path AS message FROM fields WHERE value_kind <> 'null' AND ordinal % 2 = 0")
def validate_citations(c: Corpora) -> DataFrame:
    fields = _fields(c).withColumn("citation", F.when(F.col("ordinal") % 2 == 1, F.col("citation")))
    return validate.citations(fields).select("document_id", "field", "message")


@query(f"WITH {_FIELDS} SELECT document_id, field_path AS field, 'Low confidence 0.30' AS message FROM fields WHERE value_kind <> 'null' AND ordinal = 7")
def validate_confidence(c: Corpora) -> DataFrame:
    fields = _fields(c).withColumn("confidence", F.when(F.col("ordinal") == 7, 0.3).otherwise(F.col("confidence")))
    return validate.low_confidence(fields).select("document_id", "field", "message")


_ARITHMETIC = f"""{_FIELDS}, sums AS (SELECT document_id, max(value_num) FILTER (field_path = 'subtotal') AS s, coalesce(max(value_num) FILTER (field_path = 'tax'), 0) AS x, max(value_num) FILTER (field_path = 'total') AS t FROM fields GROUP BY document_id)"""


@query(f"WITH {_ARITHMETIC} SELECT document_id, CASE WHEN abs(s + x - t) > 0.01 THEN 'error' ELSE 'info' END AS severity, CASE WHEN abs(s + x - t) > 0.01 THEN 'arithmetic_mismatch' ELSE 'arithmetic_valid' END AS rule_name, CASE WHEN abs(s + x - t) > 0.01 THEN 'failed' ELSE 'passed' END AS status FROM sums")
def validate_arithmetic(c: Corpora) -> DataFrame:
    return validate.arithmetic(_fields(c)).select("document_id", "severity", "rule_name", "status")


@query(f"""WITH {_ARITHMETIC}, nulls AS (SELECT document_id, count(*) FILTER (value_kind = 'null' AND field_path IN ({_NEEDED})) AS e FROM fields GROUP BY document_id)
    SELECT document_id, e + (abs(s + x - t) > 0.01)::INT = 0 AS passed, (e + (abs(s + x - t) > 0.01)::INT)::BIGINT AS errors, 0::BIGINT AS warnings FROM nulls JOIN sums USING (document_id)""")
def validate_summary(c: Corpora) -> DataFrame:
    return validate.passed(validate.validate(_fields(c), _schema_fields(c)), c.invoices.select("document_id").distinct())


# Export

_CITED = "CASE WHEN value_kind <> 'null' THEN 'text' END"


@query(f"""WITH {_FIELDS} SELECT document_id, '# Extraction: invoice' || chr(10) || chr(10) || string_agg('- **' || field_path || '**: ' || coalesce(value_str, '') || ' (confidence: ' || printf('%.2f', confidence) || ', ' || coalesce({_CITED}, 'no citation') || ')', chr(10) ORDER BY ordinal) AS content FROM fields GROUP BY document_id""")
def export_markdown(c: Corpora) -> DataFrame:
    return export.export(_fields(c), "markdown").select("document_id", "content")


@query(f"""WITH {_FIELDS} SELECT document_id, 'field,value,confidence,citation' || chr(10) || string_agg(field_path || ',' || CASE WHEN regexp_matches(coalesce(value_str, ''), '[",\\n]') THEN '"' || replace(value_str, '"', '""') || '"' ELSE coalesce(value_str, '') END || ',' || printf('%.2f', confidence) || ',' || coalesce({_CITED}, ''), chr(10) ORDER BY ordinal) AS content FROM fields GROUP BY document_id""")
def export_csv(c: Corpora) -> DataFrame:
    return export.export(_fields(c), "csv").select("document_id", "content")


@query(f"WITH {_FIELDS} SELECT document_id, count(*) AS fields, count(value_str) AS filled FROM fields GROUP BY document_id")
def export_json(c: Corpora) -> DataFrame:
    kind = "document_id string, schema_id string, fields array<struct<field_path:string,value_str:string>>"
    back = export.export(_fields(c), "json").select(F.from_json("content", kind).alias("j"))
    return back.select("j.document_id", F.size("j.fields").cast("long").alias("fields"), F.size(F.filter("j.fields", lambda f: f["value_str"].isNotNull())).cast("long").alias("filled"))


# Web pages and streams (extensions)


@query(r"""SELECT page_id, regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g') AS title, len(regexp_extract_all(html, '<li[ >]'))::INT AS items FROM pages""")
def web_page_outline(c: Corpora) -> DataFrame:
    html = F.col("html")
    return c.table("pages").select("page_id", F.regexp_replace(F.regexp_extract(html, "<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", "").alias("title"), F.regexp_count(html, F.lit("<li[ >]")).alias("items"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, count(*) AS n, count(value) AS valued FROM events GROUP BY ALL")
def event_windows(c: Corpora) -> DataFrame:
    from ..streaming.ingest import windowed

    return windowed(c.table("events"), "1 hour").select("event_type", F.col("window.start").alias("start"), "n", "valued")


