r"""Mixing sources to target weights by Pareto order sampling, DataFrame operations only.

Sources in code point order (null last) have the weights 5, 2, 1, repeating; together they take 150 % of
all words. A source's target stops at twice its size, and the excess is shared among the others by weight
until none is above: target = min(2 * size, level * weight), where one running sum over the sources in the
order of 2 * size / weight finds the level.

Within a source a document's expected copies grow with its length: e = min(2, c * w), w the square root (a parameter) of
its length class, the power of two at or below its words, and c such that the expected words, e * size over the source's documents, make
the target; the same running sum over at most 63 classes finds c. Of e, the whole copies are certain. Its fraction p is the
document's inclusion probability for one more copy, unequal between documents: with u uniform, documents are ranked by the random odds divided by
the inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in this order as long as half of the next
one still fits what the certain copies leave of the target. The selection's size in words is thus fixed to half a document.

u comes from the md5 of id, source, text and a turn: rows that agree in all three are numbered (in each part of the table
by itself, after the counts of the parts before it), so that some of them may be taken and others not, and reruns agree.

Words are counted once: ids, counts and the columns asked for are written to the shared folder, all else reads
that. No source is sorted as a whole: sizes are summed by 4,096 ranges of the rank first (a partial aggregate), only
the range in which a source's target runs out is ranked, and its last document taken is the source's
cut. At most 63 rows for each source remain; they are counted, broadcast if they are at most
`broadcast_rows` and joined by shuffle otherwise. The targets' running sums see one row for each source, in one task.

Defined cases: null or empty text has size 0 and is taken 0 times. Null source is a source of its own.
A null id is like any other. Rows that agree in id, source and text are interchangeable: how many of them are taken how often is
fixed, not which. An empty table gives no rows. Only doc_id, text and source are read; other columns stay untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialise, own, table


@dataclass(frozen=True)
class Mix:
    """weights: repeated over the sources; total: share of all words; most: copies of one document at most; power: of a document's length by which its expected copies grow; ranges: of the rank, summed before ranking; broadcast_rows: a larger table is joined by shuffle."""

    weights: tuple[int, ...] = (5, 2, 1)
    total: float = 1.5
    most: int = 2
    power: float = 0.5
    ranges: int = 4096
    broadcast_rows: int = 200_000

    def class_weights(self) -> list[int]:
        """Of the length classes 1, 2, 4, 8, ...; integers, so that sums are exact."""
        return [round(16 * 2 ** (k * self.power)) for k in range(63)]


def _level(amount: Column, parts: Window, weight: str, cap: str, order: list[Column]) -> tuple[Column, Column]:
    """(level if all before this row are at their cap, whether this row then is below its own)."""
    before = parts.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = (amount - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum(weight).over(parts) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
    return here, here * F.col(weight) <= F.col(cap)


def source_targets(by: DataFrame, mix: Mix) -> DataFrame:
    """by(source, source_size) with the target of each source."""
    everything = Window.partitionBy()
    weights = F.array(*map(F.lit, mix.weights))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("weight", F.element_at(weights, ((turn - 1) % len(mix.weights) + 1).cast("int"))).withColumn("cap", mix.most * F.col("source_size"))
    here, fits = _level(mix.total * F.sum("source_size").over(everything), everything, "weight", "cap", [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()])
    by = by.withColumn("here", here).withColumn("fits", fits)
    by = by.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "here"))).over(everything)["here"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return by.select("source", "source_size", target.alias("target"))


def _classes(sized: DataFrame, mix: Mix) -> DataFrame:
    """(source, class, source_size, target, whole, p, rest): for each source and length class the certain copies and the probability of one more; rest: words that the source takes beyond the certain copies."""
    each = sized.groupBy("source", "class").agg(F.sum("size").alias("words"))
    each = materialise(each, "classes")
    targets = source_targets(each.groupBy("source").agg(F.sum("words").alias("source_size")), mix)
    each = each.withColumnRenamed("source", "c_source").join(targets, F.col("c_source").eqNullSafe(F.col("source"))).drop("c_source")
    weights = F.array(*(F.lit(w).cast("long") for w in mix.class_weights()))
    each = each.withColumn("unit", F.when(F.col("words") > 0, F.element_at(weights, F.col("class") + 1)).otherwise(1))
    each = each.withColumn("weight", F.col("unit").cast("double") * F.col("words")).withColumn("cap", mix.most * F.col("words"))
    source = Window.partitionBy("source")
    here, fits = _level(F.col("target"), source, "weight", "cap", [F.col("class").desc_nulls_last()])
    each = each.withColumn("here", F.when(F.col("words") > 0, here)).withColumn("fits", F.col("here").isNotNull() & fits)
    each = each.withColumn("level", F.max(F.when(F.col("fits"), F.struct("class", "here"))).over(source)["here"])
    most = F.lit(float(mix.most))
    copies = F.when(F.col("words") > 0, F.least(most, F.coalesce(F.col("level") * F.col("unit"), most))).otherwise(0.0)
    each = each.withColumn("copies", copies).withColumn("whole", F.floor("copies"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(source)
    return each.select("source", "class", "source_size", "target", "whole", (F.col("copies") - F.col("whole")).alias("p"), rest.alias("rest"))


def _small(df: DataFrame, label: str, mix: Mix) -> DataFrame:
    """A table of some rows for each source, written; broadcast if its counted rows are few."""
    df = materialise(df, label)
    return F.broadcast(df) if df.count() <= mix.broadcast_rows else df


def _numbered(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows with their turn among those of the same mark. Only marks that several rows have are dealt, a part of a mark at a time."""
    several = rows.groupBy("mark").count().where("count > 1").select(F.col("mark").alias("s_mark"))
    several = materialise(several, "several")
    number = several.count()
    if not number:
        return rows.withColumn("turn", F.lit(1).cast("long"))
    several = F.broadcast(several) if number <= mix.broadcast_rows else several
    same = F.col("mark") == F.col("s_mark")
    often = rows.join(several, same, "left_semi")
    parts = often.groupBy(F.col("mark").alias("p_mark"), F.col("part").alias("p_part")).agg(F.count("*").alias("rows"))
    before = Window.partitionBy("p_mark").orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    local = F.row_number().over(Window.partitionBy("mark", "part").orderBy("mark"))
    often = often.withColumn("local", local).join(parts, (F.col("mark") == F.col("p_mark")) & (F.col("part") == F.col("p_part")))
    often = often.select(*rows.columns, (F.col("before") + F.col("local")).alias("turn"))
    return rows.join(several, same, "left_anti").withColumn("turn", F.lit(1).cast("long")).unionByName(often)


def mixed(docs: DataFrame, mix: Mix = Mix(), carry: list[str] | None = None) -> DataFrame:
    """(row, size, source_size, target, copies): row is a struct of the columns named in carry (None: all of docs)."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    blank = F.lit("")
    mark = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), blank), source.isNull().cast("int").cast("string"), F.coalesce(source, blank), F.coalesce(F.md5(text), blank)))
    made = docs.select(F.struct(*own(carry or docs.columns)).alias("row"), source.alias("source"), size.alias("size"), mark.alias("mark"), F.spark_partition_id().alias("part"))
    made = materialise(made, "sized")
    made = made.withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size")) - 1))
    plan = _small(_classes(made, mix), "plan", mix)
    rows = _numbered(made, mix)
    plan = plan.select(*(F.col(c).alias("p_" + c if c in ("source", "class") else c) for c in plan.columns))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & F.col("class").eqNullSafe(F.col("p_class"))).drop("p_source", "p_class", "class")
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", "mark", F.col("turn").cast("string"))), 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))
    p = F.col("p")
    rows = rows.withColumn("u", u).withColumn("rank", F.when((p > 0) & (p < 1), (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))))
    rows = rows.withColumn("range", F.floor(F.col("rank") / (1 + F.col("rank")) * mix.ranges).cast("int"))

    ranked = rows.where("rank is not null").select("source", "size", "rest", "rank", "range", "mark", "turn")
    sums = ranked.groupBy("source", "range", "rest").agg(F.sum("size").alias("words"))
    rising = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(rising), F.lit(0))).where("before <= rest")
    edge = sums.groupBy("source").agg(F.max(F.struct("range", "before")).alias("at"))
    edge = _small(edge.select(F.col("source").alias("e_source"), F.col("at.range").alias("e_range"), F.col("at.before").alias("before")), "edge", mix)
    inside = ranked.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("range") == F.col("e_range")))
    turn = Window.partitionBy("source").orderBy("rank", "mark", "turn").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum("size").over(turn), F.lit(0))
    last = inside.withColumn("upto", upto).where(F.col("upto") + F.col("size") / 2 <= F.col("rest"))
    place = F.struct("rank", "mark", "turn")
    cut = last.groupBy(F.col("source").alias("l_source")).agg(F.max(place).alias("cut"))
    cut = edge.join(cut, F.col("e_source").eqNullSafe(F.col("l_source")), "left").select("e_source", "e_range", "cut")
    rows = rows.join(_small(cut, "cut", mix), F.col("source").eqNullSafe(F.col("e_source")), "left")
    more = (F.col("range") < F.col("e_range")) | (F.col("range") == F.col("e_range")) & (place <= F.col("cut"))
    copies = (F.col("whole") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).cast("int")
    return rows.select("row", "size", "source_size", "target", copies.alias("copies"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


ORACLE = r"""
    WITH counted AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), (source IS NULL)::INT::VARCHAR, coalesce(source, ''), coalesce(md5(text), ''))) AS mark
        FROM documents),
    sized AS (
        SELECT *, CASE WHEN size > 0 THEN len(bin(size)) - 1 END AS class, row_number() OVER (PARTITION BY mark) AS turn FROM counted),
    by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (
        SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap
        FROM by_source),
    levelled AS (
        SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER climb, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER climb, 0))::DOUBLE AS here
        FROM weighed WINDOW climb AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    found AS (
        SELECT *, (SELECT arg_min(here, cap::DOUBLE / weight) FROM levelled WHERE here * weight <= cap) AS level FROM levelled),
    targets AS (
        SELECT source, source_size, least(cap::DOUBLE, coalesce(level * weight, cap::DOUBLE)) AS target FROM found),
    classes AS (SELECT source, class, sum(size)::BIGINT AS words FROM sized GROUP BY source, class),
    units AS (
        SELECT c.source, class, words, source_size, target, (CASE WHEN words > 0 THEN ({weights})[class + 1] ELSE 1 END)::DOUBLE AS unit
        FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
    climbed AS (
        SELECT *, CASE WHEN words > 0 THEN
            (target - coalesce(sum(2 * words) OVER climb, 0)::DOUBLE) / (sum(unit * words) OVER (PARTITION BY source) - coalesce(sum(unit * words) OVER climb, 0)) END AS here
        FROM units WINDOW climb AS (PARTITION BY source ORDER BY class DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    fitted AS (
        SELECT *, first_value(CASE WHEN here * (unit * words) <= 2 * words THEN here END) OVER (
            PARTITION BY source ORDER BY CASE WHEN here * (unit * words) <= 2 * words THEN class END DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level
        FROM climbed),
    expected AS (SELECT *, CASE WHEN words > 0 THEN least(2.0::DOUBLE, coalesce(level * unit, 2.0::DOUBLE)) ELSE 0.0::DOUBLE END AS copies FROM fitted),
    shares AS (
        SELECT source, class, source_size, target, floor(copies) AS whole, copies - floor(copies) AS p,
               target - sum(floor(copies) * words) OVER (PARTITION BY source) AS rest
        FROM expected),
    tossed AS (
        SELECT *, (('0x' || substr(md5(concat_ws('|', mark, turn::VARCHAR)), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM sized),
    ranked AS (
        SELECT s.doc_id, s.size, s.mark, s.turn, h.*, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank
        FROM tossed s JOIN shares h ON s.source IS NOT DISTINCT FROM h.source AND s.class IS NOT DISTINCT FROM h.class),
    summed AS (
        SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (
            PARTITION BY source ORDER BY rank NULLS LAST, mark, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
        FROM ranked)
    SELECT doc_id, size, source_size, target, ((whole + (rank IS NOT NULL AND upto + size / 2.0::DOUBLE <= rest)::INT)::BIGINT * size)::BIGINT AS taken
    FROM summed"""


def oracle() -> str:
    return ORACLE.replace("{weights}", str(Mix().class_weights()))
