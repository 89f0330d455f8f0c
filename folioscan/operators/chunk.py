"""Chunks for retrieval: fixed size, along sections, tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..functions.text import strip, token_estimate
from . import graph

CHARS = 4  # of an estimated token


@dataclass(frozen=True)
class Chunking:
    strategy: str = "section_aware"
    max_chunk_size: int = 1000
    overlap: int = 200
    include_tables: bool = True

    def __post_init__(self) -> None:
        if self.max_chunk_size <= 0:
            raise ValueError("max_chunk_size must be positive")


def fixed_size(blocks: DataFrame, config: Chunking = Chunking(strategy="fixed_size")) -> DataFrame:
    """Windows of max_chunk_size * 4 characters over the document's text, overlap * 4 shared; a page belongs to a chunk that holds one of its first three lines."""
    window = config.max_chunk_size * CHARS
    step = (config.max_chunk_size - config.overlap) * CHARS
    step = step if step > 0 else window
    pages = graph.page_texts(blocks)
    heads = F.filter(F.slice(F.split("text", "\n"), 1, 3), lambda x: strip(x) != "")
    lists = graph.in_order(pages.withColumn("heads", heads), ["document_id"], ["page_number"], F.struct("page_number", "heads", "text"), "pages")
    texts = lists.withColumn("text", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n")).where(strip(F.col("text")) != "")
    starts = texts.select("document_id", "text", F.transform("pages", lambda p: F.struct(p["page_number"].alias("page_number"), p["heads"].alias("heads"))).alias("pages"), F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))).alias("ordinal", "start"))
    cut = starts.withColumn("chunk", strip(F.substring(F.col("text"), F.col("start") + 1, F.lit(window)))).where("chunk <> ''")
    cut = cut.select("document_id", "ordinal", "chunk", "pages")
    found = F.transform(F.filter("pages", lambda p: F.exists(p["heads"], lambda h: F.contains(F.col("chunk"), h))), lambda p: p["page_number"])
    return cut.select("document_id", "ordinal", F.col("chunk").alias("text"), F.lit("text").alias("chunk_type"), found.alias("page_numbers"), token_estimate(F.col("chunk")).alias("token_count"))


def section_paths(sections: DataFrame) -> DataFrame:
    """section_path of each section: titles of its ancestors, then its own. Three levels, so two parents at most."""
    p = lambda a: sections.select("document_id", F.col("section_id").alias(f"{a}_id"), F.col("title").alias(f"{a}_title"), F.col("parent_section_id").alias(f"{a}_parent"))
    up = sections.alias("s").join(p("p").alias("p"), (F.col("s.document_id") == F.col("p.document_id")) & (F.col("s.parent_section_id") == F.col("p.p_id")), "left")
    up = up.join(p("g").alias("g"), (F.col("s.document_id") == F.col("g.document_id")) & (F.col("p.p_parent") == F.col("g.g_id")), "left")
    path = F.filter(F.array("g_title", "p_title", "title"), lambda x: x.isNotNull())
    return up.select("s.*", path.alias("section_path"))


def _path_by_title(sections: DataFrame) -> DataFrame:
    first = Window.partitionBy("document_id", "title").orderBy("ordinal")
    return section_paths(sections).withColumn("_k", F.row_number().over(first)).where("_k = 1").select("document_id", "title", "section_path")


def section_aware(blocks: DataFrame, sections: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Blocks gathered under their heading, cut when they reach max_chunk_size * 4 characters; the last block opens the next chunk.

    The running number of headings splits a document into independent segments; within one, a fold over its
    ordered blocks emits the chunks, all inside the JVM."""
    limit = config.max_chunk_size * CHARS
    kept = blocks.where(~F.col("block_type").isin(*schema.FURNITURE))
    run = Window.partitionBy("document_id").orderBy("page_number", "reading_order_index", "ordinal")
    kept = kept.withColumn("segment", F.sum(F.when(F.col("block_type") == "heading", 1).otherwise(0)).over(run))
    item = F.struct("page_number", "reading_order_index", "ordinal", "text", (F.col("block_type") == "heading").alias("head"))
    groups = kept.groupBy("document_id", "segment").agg(F.sort_array(F.collect_list(item)).alias("items"))
    state = "struct<parts:array<string>,size:long,pages:array<int>,out:array<struct<text:string,pages:array<int>>>>"
    zero = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("pages"), F.array().cast("array<struct<text:string,pages:array<int>>>").alias("out")).cast(state)

    def add(acc, x):
        parts = F.concat(acc["parts"], F.array(x["text"]))
        size = acc["size"] + F.length(x["text"])
        pages = F.array_union(acc["pages"], F.array(x["page_number"]))
        text = F.array_join(parts, "\n")
        emitted = F.when(strip(text) != "", F.concat(acc["out"], F.array(F.struct(strip(text).alias("text"), F.array_sort(pages).alias("pages"))))).otherwise(acc["out"])
        carried = F.when(x["text"] != "", F.array(x["text"])).otherwise(F.array().cast("array<string>"))
        full = F.struct(carried.alias("parts"), F.length(x["text"]).cast("long").alias("size"), pages.alias("pages"), emitted.alias("out")).cast(state)
        return F.when(size >= limit, full).otherwise(F.struct(parts.alias("parts"), size.alias("size"), pages.alias("pages"), acc["out"].alias("out")).cast(state))

    def done(acc):
        text = F.array_join(acc["parts"], "\n")
        return F.when(strip(text) != "", F.concat(acc["out"], F.array(F.struct(strip(text).alias("text"), F.array_sort(acc["pages"]).alias("pages"))))).otherwise(acc["out"])

    folded = groups.select("document_id", "segment", F.when(F.col("items")[0]["head"], strip(F.col("items")[0]["text"])).alias("title"), F.when(F.col("items")[0]["head"], F.col("items")[0]["text"]).alias("raw"), F.aggregate("items", zero, add, done).alias("chunks"))
    rows = folded.select("document_id", "segment", "title", "raw", F.posexplode("chunks").alias("ordinal", "c"))
    rows = rows.join(_path_by_title(sections), ["document_id", "title"], "left")
    path = F.coalesce("section_path", F.when(F.col("raw").isNotNull(), F.array("raw")), F.array().cast("array<string>"))
    return rows.select("document_id", "segment", "ordinal", F.col("c.text").alias("text"), F.lit("text").alias("chunk_type"), path.alias("section_path"), F.col("c.pages").alias("page_numbers"), token_estimate(F.col("c.text")).alias("token_count"))


def path_by_page(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """section_path of each page: that of the deepest section (the first on ties) that spans it. Sections are met by the pages they span, an equi-join."""
    spans = section_paths(sections).withColumn("page_number", F.explode(F.sequence("start_page", F.greatest("start_page", F.coalesce("end_page", "start_page")))))
    best = spans.groupBy("document_id", "page_number").agg(F.max_by("section_path", F.struct("heading_level", (-F.col("ordinal")).alias("o"))).alias("section_path"))
    return pages.select("document_id", "page_number").distinct().join(best, ["document_id", "page_number"], "left").withColumn("section_path", F.coalesce("section_path", F.array().cast("array<string>")))


def tables_only(tables: DataFrame, cells: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Each table with text as one markdown chunk."""
    md = graph.table_markdown(cells, tables).where(strip(F.col("markdown")) != "")
    out = md.join(tables.select("document_id", "table_id", "ordinal", "page_number", "sheet_name"), ["document_id", "table_id"])
    if sections is not None:
        out = out.join(path_by_page(sections, tables.where("page_number is not null")), ["document_id", "page_number"], "left")
    else:
        out = out.withColumn("section_path", F.lit(None).cast("array<string>"))
    pages = F.when(F.col("page_number").isNotNull(), F.array("page_number")).otherwise(F.array().cast("array<int>"))
    return out.select("document_id", "ordinal", F.col("markdown").alias("text"), F.lit("table").alias("chunk_type"), F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path"), pages.alias("page_numbers"), "sheet_name", token_estimate(F.col("markdown")).alias("token_count"))


def cited(chunks: DataFrame) -> DataFrame:
    """Chunks with what any of them may lack, and a citation for each page (or the sheet) that they come from: its number, the sheet and the chunk's first 100 characters."""
    for name, kind in (("section_path", "array<string>"), ("sheet_name", "string")):
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, (F.array() if kind.startswith("array") else F.lit(None)).cast(kind))
    pages = F.when((F.size("page_numbers") == 0) & F.col("sheet_name").isNotNull(), F.array(F.lit(None).cast("int"))).otherwise(F.col("page_numbers"))
    cite = F.transform(pages, lambda p: F.struct(F.col("document_id"), p.alias("page_number"), F.col("sheet_name"), F.substring("text", 1, 100).alias("snippet")))
    return chunks.select("document_id", "text", "chunk_type", "section_path", "page_numbers", "sheet_name", "token_count", cite.alias("citations"))


STRATEGIES = ("fixed_size", "section_aware", "table_only")


def chunk(blocks: DataFrame, sections: DataFrame, tables: DataFrame, cells: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """(document_id, text, chunk_type, section_path, page_numbers, sheet_name, token_count, citations) by the configured strategy."""
    if config.strategy == "fixed_size":
        return cited(fixed_size(blocks, config))
    if config.strategy == "table_only":
        return cited(tables_only(tables, cells, sections))
    if config.strategy == "section_aware":
        out = cited(section_aware(blocks, sections, config))
        return out.unionByName(cited(tables_only(tables, cells, sections))) if config.include_tables else out
    raise ValueError(f"unknown strategy {config.strategy!r}; known are {', '.join(STRATEGIES)}")
