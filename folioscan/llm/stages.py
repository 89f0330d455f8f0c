"""The pipeline's stages: toxicity, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet
in the shared folder and reads them back as the next one's docs, then removes what the stage left there. All but the last return docs' columns,
whatever their names; columns other than doc_id, text and source are only carried along. Rows with a null id are judged by their text in
every stage, null texts are empty, long texts are read whole, an empty table passes all stages.

A stage's result is to be written before the next stage is called: the broadcasts and working tables of a stage
are let go when the next one starts, but for tables that its docs still read. Token files stay.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import decontam, mixing, ngram_join, token_files, toxicity
from .common import gathered, let_go, materialise, own, remove, roots, sweep, table, unused

#: Working tables of the stages called so far.
_LEFT: list[str] = []


def _stage(work: Callable) -> Callable:
    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        let_go()
        _LEFT[:] = remove(spark, _LEFT, roots(docs))
        made: list[str] = []
        with gathered(made):
            out = work(spark, docs, sf_dir)
        if work.__name__ != "write_tokens":
            _LEFT.extend(made)
        return out

    return stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model is fitted on labelled rows of these documents. Repeated rows share their fate; a null or empty text is scored like any other."""
    return toxicity.accepted(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows (5-word shingles, Jaccard 0.75 or more) the one with the smallest id, one without an id last; rows without words are no group.

    Rows are told apart by a hash of id and text, so null ids and ids with several texts are compared by text like all others. Of rows
    that agree in both, one stays: that with the smallest hash of its columns (maps left out).
    """
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")
    keyed = docs.select("doc_id", "text", row.alias("row"))
    members = ngram_join.components(keyed.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    ids = materialise(keyed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("times")), "ids")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    found = members.distinct().join(ids, "row").groupBy("component_id").agg(first).select(F.col("first.row").alias("row"), F.lit(True).alias("stays"))
    decided = ids.join(found, "row", "left").where("stays is null or times > 1")
    key = unused(docs.columns, "row")
    decided = materialise(decided.select(F.col("row").alias(key), F.coalesce("stays", F.lit(False)).alias("stays")), "decided")
    clear, met = _parted(docs.select(*own(docs.columns), row.alias(key)), decided, key)
    out = clear.select(own(docs.columns)).union(met.join(decided, key, "left_anti").select(own(docs.columns)))
    again = decided.where("stays").select(key)
    if not again.isEmpty():
        mark = F.xxhash64(*own([f.name for f in docs.schema if not isinstance(f.dataType, T.MapType)]))
        one = met.join(again, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(own(docs.columns)), mark).alias("kept"))
        out = out.union(one.select("kept.*"))
    return out


def _parted(rows: DataFrame, found: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows whose key (a hash) is surely not among those of found, and the others: a join need deal only these, texts and all.

    A bit is set for each key of found in a table of 16 to 32 bits a key, 2^27 bits (16 MB) at most; where more keys fill that, fewer rows are told apart, none wrongly.
    """
    bits = min(27, max(15, found.count().bit_length() + 4))
    place = F.pmod(F.col(key), F.lit(1 << bits))
    part, bit = F.shiftright(place, 15).cast("int"), (place % (1 << 15)).cast("int")
    part_name, table_name = unused(rows.columns, "part"), unused(rows.columns, "bits")
    table = found.groupBy(part.alias(part_name)).agg(F.bitmap_construct_agg(bit.cast("long")).alias(table_name))
    shown = F.conv(F.hex(F.substring(F.col(table_name), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(shown.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit % 8)) > 0, F.lit(False))
    tested = rows.withColumn(part_name, part).join(F.broadcast(table), part_name, "left")
    part_of = lambda mask: tested.where(mask).select(own(rows.columns))
    return part_of(~is_set), part_of(is_set)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edit budget; null and empty texts hold none, repeated rows share their fate."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; documents without words are not taken. Rows that agree in id, source and text are interchangeable."""
    taken = mixing.mixed(docs).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


@_stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; for each document what its frame holds. A repeated document has a frame each time; a null or empty text is the end id alone."""
    return token_files.tokenised(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: The toxicity scores come from fitted trees, which SQL cannot express; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with sweep(spark) as keep:
            docs = keep(materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
